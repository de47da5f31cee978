import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.functions import distance, quantize
from quiverlake.functions.text import tokens
from quiverlake.operators import dml, fts, fusion, graph, ivf, knn
from quiverlake.plans.exprs import ExpressionError, compile_expression
from quiverlake.plans.filters import FilterError, compile_filter, where
from quiverlake.sources.collection import Collection
from quiverlake.sources.schema import CollectionSchema, Field, Index, SchemaError

ROWS = [(f"pk_{i}", i, i % 100 == 0, f"user_{i % 100}", i % 100, None if i % 100 == 0 else i % 100, None if i % 100 == 0 else list(range(1, i % 100 + 1)), float(i)) for i in range(1000)]
SCHEMA = "pk string, id long, bool boolean, name string, age int, optional_age long, category_set array<int>, weight float"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def _like(prefix):
    return lambda r: r[3].startswith(prefix)


@pytest.mark.parametrize(
    ("text", "keep"),
    [
        ("age = 1", lambda r: r[4] == 1),
        ("id > 900", lambda r: r[1] > 900),
        ("id <= 100 and id > 50", lambda r: 50 < r[1] <= 100),
        ("id < 100 or id > 200 and age = 3", lambda r: r[1] < 100 or r[1] > 200 and r[4] == 3),
        ("(id < 100 OR id > 200) AND age = 3", lambda r: (r[1] < 100 or r[1] > 200) and r[4] == 3),
        ("name >= 'user_5'", lambda r: r[3] >= "user_5"),
        ("name IN ('user_1', \"user_2\")", lambda r: r[3] in ("user_1", "user_2")),
        ("name NOT IN ('user_1')", lambda r: r[3] != "user_1"),
        ("optional_age not in (1, 2)", lambda r: r[5] is not None and r[5] not in (1, 2)),
        ("name like 'user_9%'", _like("user_9")),
        (r"name like 'user\_9_'", lambda r: r[3].startswith("user_9") and len(r[3]) == 7),
        ("optional_age is null", lambda r: r[5] is None),
        ("optional_age is NOT null", lambda r: r[5] is not None),
        ("category_set contain_all (1, 50)", lambda r: r[6] is not None and {1, 50} <= set(r[6])),
        ("category_set not contain_all (1, 50)", lambda r: r[6] is not None and not {1, 50} <= set(r[6])),
        ("category_set contain_any (98, 99, 100)", lambda r: r[6] is not None and bool({98, 99} & set(r[6]))),
        ("category_set not contain_any (98, 99)", lambda r: r[6] is not None and not {98, 99} & set(r[6])),
        ("category_set contain_all ()", lambda r: r[6] is not None),
        ("category_set not contain_all ()", lambda r: False),
        ("category_set contain_any ()", lambda r: False),
        ("category_set not contain_any ()", lambda r: r[6] is not None),
        ("array_length(category_set) >= 32", lambda r: r[6] is not None and len(r[6]) >= 32),
        ("bool = TRuE", lambda r: r[2]),
        ("id != 1 or id != 2", lambda r: True),
        ("weight = 3", lambda r: r[7] == 3),
    ],
)
def test_filters(rows, text, keep):
    assert sorted(r[0] for r in where(rows, text).select("pk").collect()) == sorted(r[0] for r in ROWS if keep(r))


@pytest.mark.parametrize("text", ["bool > true", "age like 'x'", "nope = 1", "age = 'x'", "name = 3", "age in (1", "sqrt(age) = 1", "not age = 1", "age between 1 and 2", "category_set = 1", "age = 1.5", "age ="])
def test_bad_filters(rows, text):
    with pytest.raises(FilterError):
        compile_filter(text, rows.schema)


def test_filter_compat_and_vector(rows):
    assert where(rows, "id != 1 or id != 2", compat=True).count() == 998
    assert compile_filter("age = 1 and dense = [1, 2.5]", rows.schema).vector == ("dense", (1.0, 2.5))
    with pytest.raises(FilterError):
        where(rows, "dense = [1.0, 2.5]")


def test_expressions(spark):
    df = spark.createDataFrame([(7, 2, 1.5), (-7, 2, 0.0)], "a int, b long, c double")
    got = df.select(*[compile_expression(e, df.schema).alias(str(i)) for i, e in enumerate(["a / b", "(a + b) * c - c / 2", "-(a - 1)", "a / c", "2 + 3 * 4"])]).collect()
    assert tuple(got[0]) == (3, 12.75, -6, 7 / 1.5, 14)
    assert got[1][0] == -3 and got[1][3] == float("-inf")
    for bad in ("'x'", "sqrt(a)", "nope + 1", "a +", "true", "(a"):
        with pytest.raises(ExpressionError):
            compile_expression(bad, df.schema)


def test_distances(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(20, 8))
    q = r.normal(size=8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = df.select("id", *[distance.score(m, F.col("v"), distance.literal(q)).alias(m) for m in ("l2", "ip", "cosine", "euclidean")]).orderBy("id").toPandas()
    np.testing.assert_allclose(got.l2, ((x - q) ** 2).sum(1))
    np.testing.assert_allclose(got.ip, x @ q)
    np.testing.assert_allclose(got.cosine, 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q))
    np.testing.assert_allclose(got.euclidean, np.sqrt(((x - q) ** 2).sum(1)))
    back = df.select(quantize.dequantize(quantize.quantize("v")).alias("d")).toPandas()
    np.testing.assert_allclose(np.stack(back.d), x, atol=0.02)
    half = df.select(quantize.fp16("v").alias("h")).toPandas()
    np.testing.assert_allclose(np.stack(half.h), x.astype(np.float16).astype(np.float32))
    sparse = spark.createDataFrame([(([1, 3], [2.0, 4.0]), ([3, 5], [0.5, 9.0]))], "a struct<indices:array<int>,vals:array<float>>, b struct<indices:array<int>,vals:array<float>>")
    assert tuple(sparse.select(distance.sparse_ip("a", "b"), distance.sparse_l2("a", "b")).first()) == (2.0, 4 + 12.25 + 81)


def test_knn_kinds(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 16))
    q = r.normal(size=16)
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(1).cache()
    want = np.lexsort((np.arange(1500), ((x - q) ** 2).sum(1)))[:10].tolist()
    assert [r[0] for r in knn.knn(df, q, 10).collect()] == want
    batch = knn.knn_batch(df, spark.createDataFrame([(0, q.tolist())], "query_id int, query array<double>"), 10).orderBy("rank")
    assert [r["vec_id"] for r in batch.collect()] == want
    assert len({r[0] for r in graph.search(df, q, 10, m=8, ef=100).collect()} & set(want)) >= 9
    c = ivf.train(df, 8, 4)
    assert len({r[0] for r in ivf.search(ivf.assign(df, c), c, q, 10, nprobe=7).collect()} & set(want)) >= 9
    assert [r[0] for r in knn.knn_refined(df, q, 10).collect()] == want
    groups = knn.knn_group_by(df, q, "label", 2, 3).collect()
    assert len(groups) == 6 and len({g["group_key"] for g in groups}) == 3


def test_knn_batch_far_from_zero_and_with_ties(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 16)) / 1000
    x[1000:2600] = x[5]
    x += 1e6  # the squares alone have more digits than the distances
    ids = r.permutation(3000)
    df = spark.createDataFrame([(f"k{i:04}", v.tolist()) for i, v in zip(ids, x)], "vec_id string, embedding array<double>").repartition(3).cache()
    asked = [5, 17, 2999]
    got = knn.knn_batch(df, spark.createDataFrame([(i, x[i].tolist()) for i in asked], "query_id int, query array<double>"), 10).collect()
    for i in asked:
        want = np.lexsort((ids, np.round(np.square(x - x[i]).sum(1), 9)))[:10]
        assert [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == i] == [f"k{ids[j]:04}" for j in want]


def test_knn_batch_memory(spark):
    r = np.random.default_rng(4)
    q, x = r.normal(size=(4096, 8)), r.normal(size=(10000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10000)), pa.array(list(x), pa.list_(pa.float64()))], names=["vec_id", "embedding"])
    tracemalloc.start()
    best = knn._nearest(iter([batch]), q, 10, "l2", pa.int64())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6  # one matrix of all scores has 328 MB
    assert sum(len(b.score) for b in best) == 40960
    assert best[1].ids.to_pylist()[:10] == np.argsort(np.square(x - q[len(best[0].last)]).sum(1))[:10].tolist()


def _bm25(texts, query, match):
    docs = {i: (t or "").lower().split() for i, t in texts}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, d in docs.items():
        terms = set(query.split())
        if (all if match == "and" else any)(t in d for t in terms):
            s = 0.0
            for t in terms & set(d):
                df = sum(t in x for x in docs.values())
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg))
            out[i] = s
    return out


@pytest.mark.parametrize("match", ["or", "and"])
def test_bm25(spark, tmp_path, match):
    texts = [(0, "the quick brown fox"), (1, "fox fox den"), (2, "lazy dog"), (3, None), (4, "quick quick silver the the")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r[0]: r[1] for r in fts.search(df, "quick fox", 10, match).collect()}
    want = _bm25(texts, "quick fox", match)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    fts.write_index(df, str(tmp_path / "index"))
    stored = {r[0]: r[1] for r in fts.search_index(spark, str(tmp_path / "index"), "quick fox", 10, match).collect()}
    assert stored == got
    assert fts.search_index(spark, str(tmp_path / "index"), "nowhere", 10, match).count() == 0


def test_postings_stay_where_their_rows_are(spark, tmp_path, monkeypatch):
    texts = [(i, None if i % 7 == 3 else " ".join(f"w{(i * j) % 11}" for j in range(i % 9)) + " a" + "\u4e2d" * (60 if i == 4 else 1)) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id int, text string").repartition(3).localCheckpoint()
    lists = fts.inverted(df)
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t in texts:
        words = [w if len(w) < 50 else w.encode()[:128].decode("utf-8", "replace") for w in (t or "").split()]
        want |= {(w, i): (words.count(w), len(words)) for w in words}
    fts.write_index(df, str(tmp_path / "index"))
    read = spark.read.parquet(str(tmp_path / "index/postings")).collect()
    assert {(r["term"], i): (tf, n) for r in read for i, tf, n in zip(r["id"], r["tf"], r["doc_len"], strict=True)} == want
    assert tuple(spark.read.parquet(str(tmp_path / "index/stats")).first()) == (40, sum(tf for tf, _ in want.values()))
    stored = [tuple(r) for r in fts.search_index(spark, str(tmp_path / "index"), "w3 w5", 10, digits=6).collect()]
    assert stored == [tuple(r) for r in fts.search(df, "w3 w5", 10, digits=6).collect()] and len(stored) == 10
    # blocks that end within batches and go over them
    monkeypatch.setattr(fts, "BLOCK", 5)
    rows = [(i, t.split()) for i, t in texts if t]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in part], pa.int32()), "t": pa.array([r[1] for r in part], pa.list_(pa.string()))}) for part in (rows[:2], rows[2:25], [], rows[25:])]
    blocks = [r for b in fts._invert(iter(batches)) for r in b.to_pylist()]
    assert {(r["term"], i): (tf, n) for r in blocks for i, tf, n in zip(r["id"], r["tf"], r["doc_len"], strict=True)} == want
    assert sum(r["n"] for r in blocks) == sum(tf for tf, _ in want.values()) and len(blocks) > len({w for w, _ in want})


def test_and_over_stored_lists(spark, tmp_path):
    # words that are cut within a character stay out of the way
    df = spark.createDataFrame([(i, f"{'red ' * (i % 3)}{'blue ' * (i % 5)}a{chr(0x4E2D) * 60}") for i in range(60)], "doc_id int, text string").repartition(4).localCheckpoint()
    fts.write_index(df, str(tmp_path / "index"))
    got = [tuple(r) for r in fts.search_index(spark, str(tmp_path / "index"), "red blue", 100, "and", digits=6).collect()]
    assert got == [tuple(r) for r in fts.search(df, "red blue", 100, "and", digits=6).collect()]
    assert {r[0] for r in got} == {i for i in range(60) if i % 3 and i % 5}


def test_long_terms(spark):
    long = "a" * 200
    df = spark.createDataFrame([(0, long), (1, "a" * 128), (2, "a" * 127)], "doc_id int, text string")
    assert {r[0] for r in fts.search(df, long, 10).collect()} == {0, 1}


def test_tokens(spark):
    got = spark.createDataFrame([("Élan VITAL-x9!", ), ("a" * 200,), (None,)], "t string").select(tokens("t")).collect()
    assert got[0][0] == ["Élan", "vital", "x9"] and got[1][0] == ["a" * 128] and got[2][0] == []


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "doc_id int, score double")
    b = spark.createDataFrame([(2, 0.1), (3, 0.2)], "doc_id int, score double")
    got = {r[0]: r[1] for r in fusion.rrf([(a, True), (b, False)]).collect()}
    assert got[2] == pytest.approx(1 / 62 + 1 / 61) and got[1] == pytest.approx(1 / 61)
    assert fusion.rrf([(a, True)]).count() == 2


def test_dml_against_a_dict(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "pk string, x int")
    rows, status = dml.insert(base, spark.createDataFrame([("c", 9, 0), ("d", 4, 1), ("d", 5, 2)], "pk string, x int, n int"), "pk", "n")
    assert {tuple(r) for r in rows.collect()} == {("a", 1), ("b", 2), ("c", 3), ("d", 4)}
    assert sorted((r["n"], r["status"]) for r in status.collect()) == [(0, "ALREADY_EXISTS"), (1, "OK"), (2, "ALREADY_EXISTS")]
    rows = dml.upsert(base, spark.createDataFrame([("c", 9, 0), ("c", 8, 1), ("e", 5, 2)], "pk string, x int, n int"), "pk", "n")
    assert {tuple(r) for r in rows.collect()} == {("a", 1), ("b", 2), ("c", 8), ("e", 5)}
    rows, status = dml.update(base, spark.createDataFrame([("a", None), ("z", 1)], "pk string, x int"), "pk")
    assert {tuple(r) for r in rows.collect()} == {("a", None), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in status.collect()} == {("a", "OK"), ("z", "NOT_FOUND")}
    assert dml.delete_by_filter(base, "x >= 2").count() == 1


def test_collection(spark, tmp_path):
    fields = (Field("title", "STRING", index=Index("FTS")), Field("price", "INT32", nullable=True), Field("dense", "VECTOR_FP32", dimension=4, index=Index("FLAT", "L2")))
    c = Collection.create(spark, str(tmp_path / "c"), CollectionSchema("books", fields))
    df = spark.createDataFrame([(f"k{i}", f"word{i} common", i, [float(i)] * 4) for i in range(30)], "pk string, title string, price int, dense array<float>")
    assert {r["status"] for r in c.insert(df).collect()} == {"OK"}
    # two rows of one key: the first is kept, and the status says the same
    twice = spark.createDataFrame([("k90", "first", 90, [90.0] * 4), ("k90", "second", 91, [91.0] * 4)], df.schema).coalesce(1)
    assert sorted(r["status"] for r in c.insert(twice).collect()) == ["ALREADY_EXISTS", "OK"]
    assert c.fetch(["k90"]).first()["title"] == "first"
    c.delete(["k90"])
    assert [r["pk"] for r in c.query(where="dense = [5.0, 5.0, 5.0, 5.0] and price > 2", topk=2).collect()] == ["k5", "k4"]
    with pytest.raises(FilterError):
        c.delete_by_filter("dense = [5.0, 5.0, 5.0, 5.0]")
    assert c.stats()["index_completeness"] == {"title": 0.0, "dense": 1.0}
    assert [r["pk"] for r in c.query(("dense", [3.0] * 4), topk=3, where="price > 2").collect()] == ["k3", "k4", "k5"]
    assert [r["pk"] for r in c.query_text("title", "word7", topk=5).collect()] == ["k7"]
    assert c.query_hybrid([("dense", [3.0] * 4)], ("title", "word3"), topk=5).first()["pk"] == "k3"
    c.upsert(df.where("price = 3").withColumn("price", F.lit(100)))
    c.delete(["k4"])
    c.delete_by_filter("price < 2")
    c.add_column(Field("twice", "INT64", nullable=True), "price * 2")
    c.optimize()
    again = Collection.open(spark, str(tmp_path / "c"))
    assert again.stats()["doc_count"] == 27
    assert [tuple(r) for r in again.fetch(["k3", "k4"]).select("pk", "twice").collect()] == [("k3", 200)]
    assert again.stats()["index_completeness"] == {"title": 1.0, "dense": 1.0}
    assert [r["pk"] for r in again.query_text("title", "word7", topk=5).collect()] == ["k7"]
    assert again.query_text("title", "word4", topk=5).count() == 0
    again.drop_index("dense")
    assert again.query_hybrid([("dense", [3.0] * 4)], ("title", "word3"), topk=5).count() == 5
    again.create_index("dense", Index("IVF", "L2", params=(("n_list", 4),)))
    assert again.query(("dense", [9.0] * 4), topk=1, nprobe=2).first()["pk"] == "k9"
    again.delete(["k9"])
    assert again.stats()["index_completeness"] == {"title": 0.0, "dense": 0.0}
    with pytest.warns(UserWarning):
        assert again.query(("dense", [9.0] * 4), topk=1, nprobe=2).first()["pk"] in ("k8", "k10")
    again.optimize()
    assert again.stats()["index_completeness"] == {"title": 1.0, "dense": 1.0}
    assert again.query(("dense", [9.0] * 4), topk=1, nprobe=2).first()["pk"] in ("k8", "k10")
    with pytest.raises(SchemaError):
        again.insert(df.withColumn("other", F.lit(1)))
    with pytest.raises(SchemaError):
        again.insert(df.withColumn("dense", F.array(F.lit(1.0))))
    again.destroy()


def test_schema_checks():
    dense = Field("v", "VECTOR_FP32", dimension=8)
    CollectionSchema("abc", (dense,)).validate()
    for bad in (CollectionSchema("a", (dense,)), CollectionSchema("abc", (Field("s", "STRING"),)), CollectionSchema("abc", (Field("v", "VECTOR_FP32"),)), CollectionSchema("abc", (Field("v", "VECTOR_INT8", dimension=8, index=Index("FLAT", "COSINE")),)), CollectionSchema("abc", (dense,), max_docs_per_segment=10)):
        with pytest.raises(SchemaError):
            bad.validate()
    assert T.LongType() == Field("u", "UINT32").spark_type()
