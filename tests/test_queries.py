import pytest

from wordloom import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(catalog.queries()[name], SQL[name])


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(SQL)


def test_packed_batches_hold_the_rows_in_order(spark):
    from tests.conftest import DATA
    from wordloom.plans.queries import BATCH, SIZE

    rows = catalog.queries()["packed_batches"](spark, DATA).collect()
    for r in rows:
        places, ids = r.correlation.split(" "), r.input_ids.split(" ")
        assert len(places) == BATCH and len(ids) == BATCH * SIZE
        for k, place in enumerate(places):
            assert (place == "") == (set(ids[k * SIZE : (k + 1) * SIZE]) == {"0"})


def test_added_tokens_are_found_inside_words(spark):
    from tests.conftest import DATA

    rows = catalog.queries()["added_tokens"](spark, DATA).collect()
    assert all(r.segments.startswith(f"doc [CLS] {r.doc_id} [SEP] end") for r in rows)


def test_every_id_is_looked_up(spark):
    from wordloom.plans.fixture import model

    rows = {r.id: r.token for r in catalog.queries()["vocab_lookup"](spark, "").collect()}
    ids = {r.id for r in catalog.queries()["vocab"](spark, "").collect()}
    assert ids == {i for i, t in rows.items() if t is not None} and rows[-1] is None and rows[max(ids) + 1] is None
    assert all(model().token(i) == rows[i] for i in ids)
    for outside in (-1, max(ids) + 1):
        with pytest.raises(IndexError):
            model().token(outside)


def test_whole_turns_are_encoded(spark):
    from tests.conftest import DATA

    whole = {(r.conv_id, r.turn): r.n_tokens for r in catalog.queries()["chat_encode"](spark, DATA).collect()}
    assert max(whole.values()) > 64


def test_missing_dependencies_leave_the_core(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    if entry.corpus is None:
        pytest.skip("there are no corpus operators")
    with monkeypatch.context() as m:
        for name in [n for n in sys.modules if n.startswith("wordloom.llm") or n == "corpus_pipeline"]:
            m.delitem(sys.modules, name)
        m.setitem(sys.modules, "xxhash", None)
        with pytest.warns(UserWarning, match="xxhash"):
            importlib.reload(entry)
        assert set(entry.queries()) == set(catalog.queries())
    importlib.reload(entry)
    assert len(entry.queries()) > len(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r.lang for r in entry.entry(spark).collect()} <= {"en", "fr", "de", "es"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
