import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wordloom import runtime
from wordloom.functions import columns as C
from wordloom.functions.kernel import Kernel
from wordloom.operators import batches as B
from wordloom.operators import search as S
from wordloom.operators import words as W
from wordloom.plans.fixture import model
from wordloom.sources.vocabulary import AddedToken
from wordloom.streaming import streams

TEXTS = [(1, "the cat in the hat"), (2, ""), (3, None), (4, "Rhône, école! 漢字 \U0001f600 789"), (5, "tion " * 300)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "key long, text string")


def test_both_forms_agree_and_nulls_stay_null(spark, texts):
    whole = {r.key: r.ids for r in texts.select("key", C.token_ids("text", model(), None).alias("ids")).collect()}
    assert whole.pop(3) is None and whole[2] == [model().cls[1], model().sep[1]]
    assert {r.key: r.input_ids for r in W.encode_memoised(texts, model()).collect()} == whole


def test_encode_pads(spark, texts):
    row = texts.where("key = 1").select(C.encode("text", model(), 16, pad_to=16).alias("e")).first().e
    assert len(row.input_ids) == len(row.attention_mask) == len(row.token_type_ids) == 16
    assert sum(row.attention_mask) == 16 - row.input_ids.count(model().pad[1]) and set(row.token_type_ids) == {0}
    for bad in (lambda: C.encode("text", model(), 1), lambda: C.encode("text", model(), 8, 9), lambda: C.chunks("text", model(), 8, 6)):
        with pytest.raises(ValueError):
            bad()


def test_utf16_offsets(spark):
    rows = spark.createDataFrame([(1, "\U0001f600 a b c")], "key long, text string")
    at = lambda unit: [r.offset for r in B.chunk_rows(rows, model(), 4, offset_unit=unit).orderBy("chunk").collect()]
    points = at("codepoint")
    assert points[0] == 0 and at("utf16") == [0] + [p + 1 for p in points[1:]]


def test_numbers_and_batches(spark, texts):
    chunks = B.chunk_rows(texts, model(), 16, 2)
    n = chunks.count()
    numbered = B.number_rows(chunks.select("key", "chunk"), ["key", "chunk"]).orderBy("row").collect()
    assert [r.row for r in numbered] == list(range(n)) and numbered == sorted(numbered, key=lambda r: (r.key, r.chunk))
    rows = B.batch_rows(chunks, 7, 16).collect()
    assert len(rows) == -(-n // 7) * 7
    assert all(set(r.input_ids) == {0} for r in rows if r.key is None)
    with pytest.raises(ValueError):
        B.batch_rows(chunks, 0, 16)


def test_search(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.u for r in v.orderBy("vec_id").select(S.unit_norm("embedding").alias("u")).collect()] == [[0.6, 0.8], [0, 0], [1, 0]]
    best = S.top_k(v, v.where("vec_id = 3").select(F.col("embedding").alias("query")), 2).collect()
    assert [(r.vec_id, r.score) for r in best] == [(1, 3.0), (3, 1.0)]


def test_search_for_many_queries(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(50)] + [(50, None), (51, [9.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0]), (3, [0.0, 0.0]), (4, None)], "query_id long, query array<float>")
    plain = {r.query_id: sorted((-sum(x * y for x, y in zip(r.query, w.embedding)), w.vec_id) for w in v.collect() if w.embedding and len(w.embedding) == 2)[:4] for r in q.collect() if r.query}
    for block in (8192, 20, 2):
        got = {}
        for r in S.top_k_each(v, q, 4, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert got == plain
    with pytest.raises(Exception, match="one query"):
        S.top_k(v, q.select("query"), 2).collect()


def test_upsert_and_pending(spark):
    old = spark.createDataFrame([(1, None, 1), (2, 5, 1)], "key long, offset long, v long")
    new = spark.createDataFrame([(1, None, 2), (3, 0, 1), (3, 0, 4)], "key long, offset long, v long")
    assert sorted((r.key, r.v) for r in S.upsert(old, new, ["key", "offset"]).collect()) == [(1, 2), (2, 1), (3, 4)]
    done = spark.createDataFrame([(1, None), (2, 7)], "key long, next_offset int")
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "key long, text string")
    assert [r.key for r in S.pending(texts, done).collect()] == [2]


def test_upsert_stream(spark, tmp_path):
    schema, out = "key long, v long", str(tmp_path / "out")
    rows = lambda: {(r.key, r.v) for r in streams.upserted(spark, ["key"], out).collect()}
    for k, new in enumerate([[(1, 1), (2, 1), (2, 0), (None, 5)], [(1, 2)], [(3, 3), (None, 6)]]):
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.upsert_stream(stream, ["key"], out).awaitTermination()
        written = spark.read.parquet(f"{out}/changes/number={k}").count()
        assert written == len({key for key, _ in new})
        if k == 1:
            before = rows()
            streams.compact(spark, ["key"], out)
            assert rows() == before == {(1, 2), (2, 1), (None, 5)}
            assert [p.name for p in (tmp_path / "out" / "changes").iterdir()] == ["number=1"]
    assert rows() == {(1, 2), (2, 1), (3, 3), (None, 6)}
    streams.compact(spark, ["key"], out)
    assert rows() == {(1, 2), (2, 1), (3, 3), (None, 6)}


REPEATED = [(1, "the cat in the hat " * 4), (1, "école tion " * 9), (None, "the the"), (None, ""), (None, None), (2, "a b c"), (1, "the cat in the hat " * 4)]


def test_repeated_and_null_keys(spark):
    kernel, size = Kernel(model()), 8
    texts = spark.createDataFrame(REPEATED, "key long, text string").repartition(3)
    told = [(k, t) for k, t in REPEATED if t is not None]
    count = lambda rows: sorted(map(repr, rows))
    chunks = [(k, n, at, following, ids, t) for k, t in told for n, (at, following, ids, _) in enumerate(kernel.chunks(t, size, 2))]
    rows = B.batch_rows(B.chunk_rows(texts, model(), size, 2), 4, size).collect()
    used = [r for r in rows if r.chunk is not None]
    full = lambda ids: ids + [model().pad[1]] * (size - len(ids))
    assert count((r.key, r.chunk, r.offset, r.next_offset, r.input_ids) for r in used) == count((k, n, at, after, full(ids)) for k, n, at, after, ids, _ in chunks)
    assert sorted(r.batch_id * 4 + r.row_in_batch for r in rows) == list(range(-(-len(chunks) // 4) * 4))
    order = [(r.key, r.chunk) for r in sorted(used, key=lambda r: (r.batch_id, r.row_in_batch))]
    assert [k for k, _ in order] == sorted((k for k, _ in order), key=lambda k: (k is not None, k))
    assert all(b[1] in (0, a[1] + 1) for a, b in zip(order, order[1:]))
    assert count(tuple(r) for r in S.passages(texts, model(), size, 2).collect()) == count((k, n, t[at:after]) for k, n, at, after, _, t in chunks)
    assert count(tuple(r) for r in W.encode_memoised(texts, model()).collect()) == count((k, kernel.encode_all(t)) for k, t in told)


def test_batches_by_partition(spark):
    texts = spark.createDataFrame([(k, "the cat in the hat " * (k % 5)) for k in range(40)] + [(None, "a")], "key long, text string")
    plain = [tuple(r) for r in B.chunk_rows(texts, model(), 8).collect()]
    for degree in (1, 3):
        rows = B.partition_batches(texts, model(), 4, 8, degree=degree).collect()
        sizes = {}
        for r in rows:
            sizes.setdefault((r.partition, r.batch), []).append(r.row_in_batch)
        assert all(sorted(v) == [0, 1, 2, 3] for v in sizes.values()) and len({p for p, _ in sizes}) == degree
        assert sorted(map(repr, (tuple(r)[3:] for r in rows if r.chunk is not None))) == sorted(map(repr, plain))
        assert all(set(r.input_ids) == {0} and r.offset is None for r in rows if r.chunk is None)
    assert B.partition_batches(texts.limit(0), model(), 4, 8).count() == 0
    with pytest.raises(ValueError):
        B.partition_batches(texts, model(), 0, 8)


def test_decode_of_unknown_ids(spark):
    the = model().prefixes["the"]
    rows = spark.createDataFrame([(1, [the, 10**6, the]), (2, [10**6, the]), (3, []), (4, None)], "key long, ids array<bigint>")
    assert {r.key: r.t for r in rows.select("key", C.decode("ids", model()).alias("t")).collect()} == {1: "the the", 2: None, 3: "", 4: None}
    with pytest.raises(Exception, match="no token"):
        rows.select(C.decode("ids", model(), on_unknown="raise")).collect()
    with pytest.raises(ValueError):
        C.decode("ids", model(), on_unknown="skip")


def test_prompts_before_queries(spark):
    rows = spark.createDataFrame([("hat",), (None,)], "q string").select(S.encode_query("q", model(), "the ", 16, 16).alias("e"), C.encode(F.lit("the hat"), model(), 16, pad_to=16).alias("w")).collect()
    assert rows[0].e == rows[0].w and rows[1].e.input_ids is None


def test_words_of_models_with_added_tokens_and_other_forms(spark):
    added = replace(model(), added=(*model().added, AddedToken("cat", True), AddedToken("x.y", False)), prefixes=dict(model().prefixes, **{"cat": 7, "x.y": 8}))
    texts = spark.createDataFrame([(1, "concatenate [CLS] CAT x.y.x [cls]"), (2, "e\u0301cole \ufb01n"), (3, "x.yx.y"), (4, "")], "key long, text string")
    for own in (added, replace(added, form="NFC"), replace(added, form="NFKC"), model("NFKD")):
        kernel = Kernel(own)
        assert {r.key: r.input_ids for r in W.encode_memoised(texts, own).collect()} == {r.key: kernel.encode_all(r.text) for r in texts.collect()}


def test_whole_texts_are_normalised_for_other_forms():
    text = "e\u0301cole \ufb01n \uff41b"
    for form, want in {"NFC": "\xe9cole \ufb01n \uff41b", "NFKC": "\xe9cole fin ab", "NFKD": "e\u0301cole fin ab"}.items():
        kernel = Kernel(model(form))
        assert kernel.prepare(text) == want and [s for s, _ in kernel.segments(text)] == want.split()
        assert kernel.chunks(text, 64, 0)[0][2] == kernel.encode_all(want)
        assert kernel.encode_all(text) == kernel.encode_all(want)


def test_small_inputs_only_are_spread(spark, monkeypatch, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    assert runtime.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(runtime, "SPREAD_BYTES", 10)
    assert runtime.spread(rows).rdd.getNumPartitions() == 1


def test_scratch_folders_go(spark):
    path = runtime.scratch(spark, "some")
    spark.range(1).write.parquet(path)
    runtime.remove(spark, path)
    assert not os.path.exists(path)
    runtime.remove(spark, path)
