"""What workers hold follows a piece of a column, not the batch; whole texts and sums need no shuffle of words."""

import inspect
import tracemalloc
import unicodedata
from dataclasses import replace
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from wordloom import catalog
from wordloom.functions import columns as C
from wordloom.functions import vector as vector_module
from wordloom.functions.kernel import Kernel
from wordloom.functions.vector import VectorKernel
from wordloom.operators import words as W
from wordloom.plans.fixture import model
from wordloom.sources.vocabulary import AddedToken

TEXT = "the cat, in the hat; école ﬁn and on with is was this from 3 12 " * 32


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def worker(monkeypatch, make):
    """The function of a column function's UDF, over one batch."""
    found = []
    with monkeypatch.context() as m:
        m.setattr(C.F, "arrow_udf", lambda run, kind: found.append(run) or (lambda column: column))
        make()
    run = found[0]
    if inspect.isgeneratorfunction(run):
        return lambda values: sum(len(x) for x in run(iter([values])))
    return lambda values: len(run(values))


def flat(monkeypatch, make, text=TEXT):
    """Whether four times the rows in a batch take no more memory than a little."""
    run, peaks = worker(monkeypatch, make), []
    for rows in (600, 600, 2400):
        values = pa.array([text] * rows)
        tracemalloc.start()
        assert run(values) == rows
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[2] < 1.5 * peaks[1], peaks


def test_pretokenize_holds_a_piece_and_cuts_texts_once(spark, monkeypatch):
    flat(monkeypatch, lambda: C.segments("text", model()))
    assert plan(catalog.queries()["pretokenize"](spark, DATA)).count("ArrowEvalPython") == 1


ODD = [
    "Rhône, ÉCOLE! 漢字 \U0001f600 789", "", None, " \t ", "İΑΣ Σ", "a[CLS]b cat", "x.y CONCATENATE [cls]", "​�", "é ﬁnａ", "the-end", None,
    "[SEP]", "z", "KK ẞ",
]


def test_segments_of_columns_are_those_of_texts():
    added = replace(model(), added=(*model().added, AddedToken("cat", True), AddedToken("x.y", False)))
    for own in (model(), model("NFC"), model("NFKC"), replace(model(), lowercase=False), added, replace(added, form="NFKD")):
        kernel = Kernel(own)
        for odd in (ODD, ODD[3:], [t for t in ODD if t and "[" not in t], [None], [""], ["[CLS]"]):
            count, text, start = VectorKernel(kernel).segments(pa.array(odd, pa.string()))
            text.validate(full=True)
            want = [kernel.segments(t) if t is not None else [] for t in odd]
            assert count.tolist() == [len(x) for x in want]
            assert list(zip(text.to_pylist(), start.to_pylist())) == [x for y in want for x in y]


def test_segments_keep_nulls(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "key long, text string").select("key", C.segments("text", model()).alias("s")).collect()
    kernel = Kernel(model())
    assert {r.key: r.s and [tuple(x) for x in r.s] for r in rows} == {k: None if t is None else kernel.segments(t) for k, t in enumerate(ODD)}


def test_added_tokens_hold_a_piece(spark, monkeypatch):
    flat(monkeypatch, lambda: C.segments("text", model()), "doc[CLS]1[SEP]end " + TEXT)


STATISTICS = [("a", "the cat école"), ("a", None), ("a", "[UNK] x"), ("b", " \t"), ("b", None), ("c", "​�"), (None, "漢字 the"), ("d", "a[CLS]b CAT x.y"), ("a", "the cat école")]


def test_statistics_shuffle_sums_only(spark):
    added = replace(model(), added=(*model().added, AddedToken("cat", True), AddedToken("x.y", False)))
    texts = spark.createDataFrame(STATISTICS, "g string, text string")
    for own in (model(), model("NFKC"), added):
        kernel, want = Kernel(own), {}
        for g, t in STATISTICS:
            if t and kernel.segments(t):
                ids = kernel.encode_all(t)[1:-1]
                n, lost = want.get(g, (0, 0))
                want[g] = n + len(ids), lost + ids.count(own.unk[1])
        assert {r.g: (r.n_tokens, r.n_unknown) for r in W.token_statistics(texts, own, "g").collect()} == want
    for name in ("tokens_by_source", "tokens_by_lang"):
        assert "explode" not in plan(catalog.queries()[name](spark, DATA))


def test_memoised_texts_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "the cat école"), (None, "a[CLS]b"), (1, None), (2, "")], "key long, text string")
    assert "Exchange" not in plan(W.encode_memoised(texts, model()))
    kernel = Kernel(model())
    assert sorted(map(repr, (tuple(r) for r in W.encode_memoised(texts, model()).collect()))) == sorted(repr((r.key, kernel.encode_all(r.text))) for r in texts.collect() if r.text is not None)


def test_memoised_repeated_keys_are_not_shuffled(spark):
    assert "hashpartitioning" not in plan(catalog.queries()["memoised_repeated_keys"](spark, DATA))


def test_chunks_with_stride_hold_a_piece(spark, monkeypatch):
    """As stream_chunks has them."""
    flat(monkeypatch, lambda: C.chunks("text", model(), 128, 25))


def test_compatibility_forms_hold_a_piece(spark, monkeypatch):
    flat(monkeypatch, lambda: C.chunks("text", model("NFKC"), 128))


def test_chunks_hold_a_piece(spark, monkeypatch):
    """As batches and batches_repeated_keys have them, too."""
    flat(monkeypatch, lambda: C.chunks("text", model(), 128))


def test_passages_hold_a_piece(spark, monkeypatch):
    flat(monkeypatch, lambda: C.passages("text", model(), 128))


def test_composed_forms_hold_a_piece(spark, monkeypatch):
    flat(monkeypatch, lambda: C.chunks("text", model("NFC"), 128))
    flat(monkeypatch, lambda: C.normalize_unicode("text", "NFD"))


def test_long_and_short_chunks_hold_a_piece(spark, monkeypatch):
    flat(monkeypatch, lambda: C.chunks("text", model(), 333, 77))
    flat(monkeypatch, lambda: C.chunks("text", model(), 27))


def test_arrow_memory_goes_back_with_each_piece(spark, monkeypatch):
    """As added_tokens has them: what Arrow's pool kept was more than half of what a worker held."""
    run, calls = worker(monkeypatch, lambda: C.segments("text", model())), []

    class Memory:
        def release_unused(self):
            calls.append(1)

    values = pa.array(["doc[CLS]1[SEP]end " + TEXT] * 600)
    monkeypatch.setattr(C.pa, "default_memory_pool", Memory)
    assert run(values) == 600
    assert len(calls) >= values.nbytes // C.BLOCK


def test_words_at_limits_stay_out_of_the_memo():
    kernel = Kernel(model())
    texts = [" ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + i)}" for i in range(26)) for k in range(300)]
    for size, stride in ((27, 0), (128, 0), (333, 77), (16, 5)):
        got = [rows for _, rows in VectorKernel(kernel).chunks(pa.array(texts), size, stride)]
        assert len(kernel.memo) == 0
        want = [Kernel(model()).chunks(t, size, stride) for t in texts[:20]]
        assert [[(x, y, ids.tolist(), lost) for x, y, ids, lost in rows] for rows in got[:20]] == want


def test_a_pool_holds_few_bytes_a_word():
    kernel = Kernel(model())
    words, vector = [f"{chr(97 + i % 26)}{i:06d}x" for i in range(100_000)], VectorKernel(kernel)
    pieces = [" ".join(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
    tracemalloc.start()
    first = [vector.encode(pa.array([p]), None).to_pylist() for p in pieces]
    rows = vector.pool.rows
    size = tracemalloc.get_traced_memory()[0]
    again = [vector.encode(pa.array([p]), None).to_pylist() for p in pieces]
    tracemalloc.stop()
    assert first == again and vector.pool.rows == rows == len(words) + 2
    assert vector.pool.hashes.tolist() == sorted(set(vector.pool.hashes.tolist()))
    held = sum(x.nbytes for x in (vector.pool.held, vector.pool.begin, vector.pool.size, vector.pool.attempt, vector.pool.hashes, vector.pool.by_hash))
    assert held < 200 * len(words) and size < 1 << 27


class _Rows:
    """A DataFrame as far as a worker's function is asked for."""

    def where(self, _):
        return self

    def select(self, *_):
        return self


def test_memoised_ids_hold_a_piece(spark, monkeypatch):
    flat(monkeypatch, lambda: W.encode_memoised(_Rows(), model()))


def test_normalised_texts_are_given_back_by_pieces(spark, monkeypatch):
    """A whole batch of them was put together before."""
    texts, found = pa.array([TEXT, None, ""] * 400), []
    with monkeypatch.context() as m:
        m.setattr(C.F, "arrow_udf", lambda run, kind: found.append(run) or (lambda column: column))
        C.normalize_unicode("text", "NFD")
    made = list(found[0](iter([texts, texts.slice(0, 0), texts])))
    assert len(made) > 2 and max(x.nbytes for x in made) < 2 * C.BLOCK
    assert [x for y in made for x in y.to_pylist()] == 2 * [t and unicodedata.normalize("NFD", t) for t in texts.to_pylist()]


LONG = [" ".join(f"{chr(97 + k)}{chr(97 + i)}" + "caterpillars" * 120 for i in range(26)) for k in range(24)]


def memory(memo):
    return sum(len(word) + len(ids) + sum(map(len, attempts)) for word, (ids, attempts) in memo.items())


def long_words(make, chunked):
    """What a worker holds of words of more than a thousand characters follows neither their number nor their length."""
    kernel = Kernel(model())
    vector = VectorKernel(kernel)
    for text in LONG:
        assert chunked(make(vector, pa.array([text]))) == chunked(make(Kernel(model()), text))
        assert memory(kernel.memo) <= 1 << 20
    most = 0
    for _ in range(120):
        list(make(vector, pa.array(LONG[:4])))
        most = max(most, vector.pool.used)
    assert most < (1 << 21) + C.BLOCK


def rows_of(found):
    found = next(found)[1] if inspect.isgenerator(found) else found
    return [(x, y, [int(i) for i in ids], lost) for x, y, ids, lost in found]


def test_long_words_leave_the_memo_and_the_pool():
    """As batches has them; both were bounded by the number of words only."""
    long_words(lambda kernel, texts: kernel.chunks(texts, 128, 0), rows_of)


def test_passages_of_long_words_leave_the_memo(spark, monkeypatch):
    vector = VectorKernel(Kernel(model()))
    monkeypatch.setattr(C, "Shared", lambda *_: SimpleNamespace(vector=vector))
    run = worker(monkeypatch, lambda: C.passages("text", model(), 128))
    for text in LONG:
        assert run(pa.array([text])) == 1
        assert memory(vector.kernel.memo) <= 1 << 20


def test_chunks_with_stride_of_long_words_leave_the_memo():
    long_words(lambda kernel, texts: kernel.chunks(texts, 333, 77), rows_of)


def test_short_chunks_of_long_words_leave_the_memo():
    long_words(lambda kernel, texts: kernel.chunks(texts, 27, 0), rows_of)


def small(spark, monkeypatch, make):
    """What a worker holds of one batch of new words: its pool, tables and one piece; and Spark sends small batches."""
    spark.conf.unset(BATCH)
    make()
    assert int(spark.conf.get(BATCH)) <= 1 << 22
    run = worker(monkeypatch, make)
    texts = [" ".join(f"{chr(97 + i % 26)}{k}x{i}é" for i in range(1000)) for k in range(160)]
    tracemalloc.start()
    assert run(pa.array(texts)) == len(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 56 << 20, peak


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_workers_for_passages_are_small(spark, monkeypatch):
    small(spark, monkeypatch, lambda: C.passages("text", model(), 128))


def test_workers_for_chunks_are_small(spark, monkeypatch):
    """As batches and batches_repeated_keys have them, too."""
    small(spark, monkeypatch, lambda: C.chunks("text", model(), 128))


def test_a_limit_for_batches_stays(spark):
    spark.conf.set(BATCH, "9000000")
    C.passages("text", model(), 128)
    assert spark.conf.get(BATCH) == "9000000"
    spark.conf.unset(BATCH)


def test_a_full_pool_keeps_what_it_found_again(monkeypatch):
    monkeypatch.setattr(vector_module, "_ROWS", 1000)
    vector = VectorKernel(Kernel(model()))
    made, make = [], vector.pool._make
    monkeypatch.setattr(vector.pool, "_make", lambda segments, which: made.append([segments.text(i) for i in which.tolist()]) or make(segments, which))
    for k in range(40):
        text = "the école caterpillar " + " ".join(f"w{k}x{i}" for i in range(100))
        assert vector.encode(pa.array([text]), None).to_pylist() == [Kernel(model()).encode_all(text)]
    assert vector.pool.rows < 1200
    assert sum(x.count("école") for x in made) == 1
    # where all words come again, the pool begins anew
    for k in range(40):
        text = " ".join(f"y{k // 4 * 100 + i}" for i in range(400))
        assert vector.encode(pa.array([text]), None).to_pylist() == [Kernel(model()).encode_all(text)]
        assert vector.pool.rows < 1500
