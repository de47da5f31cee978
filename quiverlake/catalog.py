"""Queries of the engine by name, each with SQL that gives the same rows.

A query's text, filter or vector is a constant here, as a user would pass it; each runs over its whole table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.functions import distance as D
from quiverlake.functions import quantize as Q
from quiverlake.functions.text import tokens
from quiverlake.operators import dml, fts, fusion, graph, ivf, knn
from quiverlake.plans.filters import where
from quiverlake.streaming.ingest import latest_stream

DIM = 64
QUERY = [round(((i * 37) % 64 - 31.5) / 160, 6) for i in range(DIM)]
_Q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in QUERY) + "]"
_E = "embedding::DOUBLE[]"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOK = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')" % (UP, LOW)
TEXT = "The that ing"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


# ---------------------------------------------------------------- nearest neighbours

_SCORE = {"l2": f"round(pow(list_distance({_E}, {_Q}), 2), 6)", "ip": f"round(list_inner_product({_E}, {_Q}), 6)", "cosine": f"round(list_cosine_distance({_E}, {_Q}), 6)", "euclidean": f"round(list_distance({_E}, {_Q}), 6)"}
for _m, _s in _SCORE.items():
    _add(f"knn_{_m}", f"SELECT vec_id, {_s} AS score FROM embeddings ORDER BY score {'DESC' if D.DESCENDING[_m] else 'ASC'}, vec_id LIMIT 10")(lambda s, d, m=_m: knn.knn(_t(s, d, "embeddings"), QUERY, 10, m, digits=6).select("vec_id", "score"))

_add("knn_filtered", f"SELECT vec_id, label, {_SCORE['l2']} AS score FROM embeddings WHERE label IN (1, 3, 5) AND vec_id >= 20 ORDER BY score, vec_id LIMIT 10")(
    lambda s, d: knn.knn(_t(s, d, "embeddings"), QUERY, 10, "l2", where="label in (1, 3, 5) and vec_id >= 20", digits=6).select("vec_id", "label", "score"))
_add("knn_range_l2", f"SELECT vec_id, {_SCORE['l2']} AS score FROM embeddings WHERE {_SCORE['l2']} <= 1.9 ORDER BY score, vec_id LIMIT 50")(
    lambda s, d: knn.knn(_t(s, d, "embeddings"), QUERY, 50, "l2", radius=1.9, digits=6).select("vec_id", "score"))
_add("knn_range_ip", f"SELECT vec_id, {_SCORE['ip']} AS score FROM embeddings WHERE {_SCORE['ip']} >= 0.2 ORDER BY score DESC, vec_id LIMIT 50")(
    lambda s, d: knn.knn(_t(s, d, "embeddings"), QUERY, 50, "ip", radius=0.2, digits=6).select("vec_id", "score"))
_add("knn_by_id", f"SELECT vec_id, round(pow(list_distance({_E}, (SELECT {_E} FROM embeddings WHERE vec_id = 7)), 2), 6) AS score FROM embeddings ORDER BY score, vec_id LIMIT 10")(
    lambda s, d: knn.knn_by_id(_t(s, d, "embeddings"), 7, 10, "l2", digits=6).select("vec_id", "score"))
_add("knn_by_keys", f"SELECT vec_id, {_SCORE['l2']} AS score FROM embeddings WHERE vec_id IN (3, 5, 8, 13, 21, 34, 55, 89) ORDER BY score, vec_id LIMIT 5")(
    lambda s, d: knn.knn_by_keys(_t(s, d, "embeddings"), [3, 5, 8, 13, 21, 34, 55, 89], QUERY, 5, "l2", digits=6).select("vec_id", "score"))
_add("knn_batch", "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(pow(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 2), 9) AS score FROM embeddings q, embeddings e WHERE q.label = 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank::INT AS rank FROM r WHERE rank <= 10")(
    lambda s, d: knn.knn_batch(_t(s, d, "embeddings"), where(_t(s, d, "embeddings"), "label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10, "l2").select("query_id", "vec_id", "rank"))
_add("knn_group_by", f"WITH s AS (SELECT vec_id, label::VARCHAR AS group_key, {_SCORE['l2']} AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY score, vec_id) AS group_rank FROM s), g AS (SELECT group_key FROM r WHERE group_rank = 1 ORDER BY score, group_key LIMIT 3) SELECT r.group_key, r.vec_id, r.score, r.group_rank::INT AS group_rank FROM r JOIN g USING (group_key) WHERE r.group_rank <= 2")(
    lambda s, d: knn.knn_group_by(_t(s, d, "embeddings"), QUERY, "label", 2, 3, digits=6).select("group_key", "vec_id", "score", "group_rank"))
_add("knn_refine_int8", f"SELECT vec_id, {_SCORE['l2']} AS score FROM embeddings ORDER BY score, vec_id LIMIT 10")(
    lambda s, d: knn.knn_refined(_t(s, d, "embeddings"), QUERY, 10, digits=6).select("vec_id", "score"))
_add("knn_multi_vector", f"WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY s, vec_id) - 1 AS r FROM (SELECT vec_id, {_SCORE['l2']} AS s FROM embeddings ORDER BY s, vec_id LIMIT 20)), b AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS r FROM (SELECT vec_id, {_SCORE['ip']} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20)) SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r + 1)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 10")(
    lambda s, d: fusion.rrf([(knn.knn(_t(s, d, "embeddings"), QUERY, 20, "l2", digits=6), False), (knn.knn(_t(s, d, "embeddings"), QUERY, 20, "ip", digits=6), True)], 10, id_col="vec_id", digits=9))


@_add("ivf_probe")
def _ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "embeddings")
    c = ivf.train(df, 16, 5)
    return ivf.search(ivf.assign(df, c), c, QUERY, 10, nprobe=8, digits=6).select("vec_id", "score")


_add("graph_search")(lambda s, d: graph.search(_t(s, d, "embeddings"), QUERY, 10).select("vec_id", F.round("score", 6).alias("score")))

# distances and norms over the whole table
_add("distance_hamming", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (embedding[i] > 0) <> (e[i] > 0) THEN 1 ELSE 0 END))::INT AS bits FROM embeddings, q")(
    lambda s, d: _t(s, d, "embeddings").crossJoin(F.broadcast(_t(s, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q")))).select("vec_id", D.hamming(D.sign_bits("embedding"), D.sign_bits("q")).alias("bits")))
_add("distance_norms", f"SELECT vec_id, round(list_sum(list_transform({_E}, lambda x: abs(x))), 6) AS l1, round(sqrt(list_sum(list_transform({_E}, lambda x: x * x))), 6) AS l2, round(1 - list_inner_product({_E}, {_Q}), 6) AS normalized FROM embeddings")(
    lambda s, d: _t(s, d, "embeddings").select("vec_id", F.round(D.norm1("embedding"), 6).alias("l1"), F.round(D.norm2("embedding"), 6).alias("l2"), F.round(D.normalized_cosine("embedding", D.literal(QUERY)), 6).alias("normalized")))


@_add("mips_spherical", f"WITH m AS (SELECT max(sqrt(list_inner_product({_E}, {_E}))) AS m, sqrt(list_inner_product({_Q}, {_Q})) AS n FROM embeddings), s AS (SELECT vec_id, list_transform({_E}, lambda x: x / m) AS v, list_transform({_Q}, lambda x: x / n) AS q FROM embeddings, m) SELECT vec_id, round(pow(list_distance(list_append(v, sqrt(greatest(0, 1 - list_inner_product(v, v)))), list_append(q, 0.0::DOUBLE)), 2), 5) AS score FROM s ORDER BY score, vec_id LIMIT 10")
def _mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "embeddings")
    longest = df.agg(F.max(D.norm2("embedding")).alias("longest"))
    lifted = df.crossJoin(F.broadcast(longest)).withColumn("v", D.mips_spherical("embedding", F.col("longest")))
    return lifted.select("vec_id", F.round(D.squared_l2("v", D.mips_spherical(D.literal(QUERY), F.lit(1.0), query=True)), 5).alias("score")).orderBy("score", "vec_id").limit(10)


_add("quantize_int8", f"WITH q AS (SELECT vec_id, {_E} AS v, list_min({_E}) AS lo, list_max({_E}) AS hi FROM embeddings), c AS (SELECT vec_id, list_transform(v, lambda x: round(x * (254 / (hi - lo)) + (-lo * (254 / (hi - lo)) - 127))) AS c FROM q) SELECT vec_id, list_sum(c)::BIGINT AS total, list_min(c)::INT AS low, list_max(c)::INT AS high FROM c")(
    lambda s, d: _t(s, d, "embeddings").select("vec_id", Q.quantize("embedding", "int8")["codes"].alias("c")).select("vec_id", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("c").alias("low"), F.array_max("c").alias("high")))
_add("quantize_int4", f"WITH q AS (SELECT vec_id, {_E} AS v, list_min({_E}) AS lo, list_max({_E}) AS hi FROM embeddings), c AS (SELECT vec_id, list_transform(v, lambda x: round(x * (15 / (hi - lo)) + (-lo * (15 / (hi - lo)) - 8))) AS c FROM q) SELECT vec_id, list_sum(c)::BIGINT AS total, list_min(c)::INT AS low, list_max(c)::INT AS high FROM c")(
    lambda s, d: _t(s, d, "embeddings").select("vec_id", Q.quantize("embedding", "int4")["codes"].alias("c")).select("vec_id", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("c").alias("low"), F.array_max("c").alias("high")))
_add("quantize_fp16")(lambda s, d: _t(s, d, "embeddings").select("vec_id", Q.fp16("embedding").alias("v")))
_add("sparse_ip_knn", f"WITH p AS (SELECT doc_id, unnest({_TOK}) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM p GROUP BY ALL) SELECT doc_id, sum(n * CASE t WHEN 'the' THEN 0.25 WHEN 'that' THEN 1.5 ELSE 2.0 END)::DOUBLE AS score FROM c WHERE t IN ('the', 'that', 'with') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")(
    lambda s, d: knn.sparse_knn(fts.postings(_t(s, d, "documents")), {"the": 0.25, "that": 1.5, "with": 2.0}, 10, index="term", value="tf"))

# ---------------------------------------------------------------- filters

#: name: table, key columns, filter, the same in SQL where it differs
FILTERS: dict[str, tuple[str, list[str], str, str | None]] = {
    "filter_eq": ("orders", ["o_orderkey", "o_orderstatus"], "o_orderstatus = 'O'", None),
    "filter_ne": ("orders", ["o_orderkey", "o_orderpriority"], "o_orderpriority != '1-URGENT'", None),
    "filter_lt": ("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity < 5", None),
    "filter_le": ("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity <= 5.0", None),
    "filter_gt": ("orders", ["o_orderkey", "o_totalprice"], "o_totalprice > 200000", None),
    "filter_ge_string": ("customer", ["c_custkey", "c_name"], "c_name >= 'Customer#000000700'", None),
    "filter_in": ("lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"], "l_returnflag IN ('A', 'R')", None),
    "filter_not_in": ("embeddings", ["vec_id", "label"], "label not in (1, 2, 3)", None),
    "filter_like_prefix": ("part", ["p_partkey", "p_name"], "p_name like 's%'", None),
    "filter_like_suffix": ("part", ["p_partkey", "p_name"], "p_name like '%ring'", None),
    "filter_like_middle": ("pages", ["page_id", "url"], "url like 'http%a%html%'", None),
    "filter_like_underscore": ("part", ["p_partkey", "p_name"], "p_name like '_mall r_ng'", None),
    "filter_like_escape": ("events", ["event_id", "props"], r"props like '%\_%' or event_type like 'p%'", r"props LIKE '%\_%' ESCAPE '\' OR event_type LIKE 'p%'"),
    "filter_and_or_paren": ("lineitem", ["l_orderkey", "l_linenumber"], "(l_quantity < 10 or l_quantity > 45) AND l_returnflag = 'N' and l_discount >= 0.05", None),
    "filter_precedence": ("lineitem", ["l_orderkey", "l_linenumber"], "l_quantity < 3 or l_quantity > 48 and l_returnflag = 'N'", None),
    "filter_timestamp": ("orders", ["o_orderkey"], "o_orderdate < '1995-03-15'", "o_orderdate < TIMESTAMP '1995-03-15'"),
    "filter_unsatisfiable": ("lineitem", ["l_orderkey", "l_linenumber"], "l_returnflag in ()", "false"),
    "filter_or_of_ne": ("orders", ["o_orderkey"], "o_orderstatus != 'O' or o_orderstatus != 'F'", None),
}
for _n, (_table, _cols, _f, _w) in FILTERS.items():
    _add(_n, f"SELECT {', '.join(_cols)} FROM {_table} WHERE {_w or _f}")(lambda s, d, t=_table, c=_cols, f=_f: where(_t(s, d, t), f).select(*c))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the words of their names; null for those of size 1 to 10."""
    return _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.split("p_name", " ")).alias("words"))


_WORDS = "(SELECT p_partkey, CASE WHEN p_size > 10 THEN string_split(p_name, ' ') END AS words FROM part)"
ARRAYS: dict[str, tuple[str, str]] = {
    "contain_all": ("words contain_all ('small', 'ring')", "list_has_all(words, ['small', 'ring'])"),
    "contain_any": ("words contain_any ('small', 'ring')", "list_has_any(words, ['small', 'ring'])"),
    "not_contain_all": ("words not contain_all ('small', 'ring')", "NOT list_has_all(words, ['small', 'ring'])"),
    "not_contain_any": ("words not contain_any ('small', 'ring')", "NOT list_has_any(words, ['small', 'ring'])"),
    "contain_all_empty": ("words contain_all ()", "words IS NOT NULL"),
    "contain_any_empty": ("words contain_any ()", "false"),
    "array_length": ("array_length(words) >= 2", "len(words) >= 2"),
    "filter_null": ("words is null", "words IS NULL"),
    "filter_not_null": ("words is not null", "words IS NOT NULL"),
}
for _n, (_f, _w) in ARRAYS.items():
    _add(_n, f"SELECT p_partkey FROM {_WORDS} WHERE {_w}")(lambda s, d, f=_f: where(_words(s, d), f).select("p_partkey"))
_add("filter_prefix_suffix", "SELECT p_partkey FROM part WHERE starts_with(p_name, 's') AND ends_with(p_name, 'g')")(lambda s, d: _t(s, d, "part").where(F.col("p_name").startswith("s") & F.col("p_name").endswith("g")).select("p_partkey"))

# ---------------------------------------------------------------- full text and fusion

_INDEXES: dict[tuple[str, str], str] = {}


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode only."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return tempfile.mkdtemp()


def text_index(spark: SparkSession, sf_dir: str) -> str:
    """Stored postings of documents, written at the first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = f"{_shared(spark)}/postings-{uuid.uuid4().hex}"
        fts.write_index(_t(spark, sf_dir, "documents"), path)
        _INDEXES[key] = path
    return _INDEXES[key]


_BM25 = f"""t AS (SELECT doc_id, {_TOK} AS t FROM documents), b AS (SELECT doc_id, len(t) AS dl, unnest(['the', 'that', 'ing']) AS term, t FROM t),
f AS (SELECT doc_id, dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM b), n AS (SELECT count(*)::DOUBLE AS n, sum(len(t))::DOUBLE / count(*) AS avgdl FROM t), d AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM f GROUP BY term),
s AS (SELECT doc_id, count(*) AS hits, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM f JOIN d USING (term), n WHERE tf > 0 GROUP BY doc_id)"""
_add("fts_or", f"WITH {_BM25} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")(lambda s, d: fts.search_index(s, text_index(s, d), TEXT, 10, digits=6))
_add("fts_and", f"WITH {_BM25} SELECT doc_id, score FROM s WHERE hits = 3 ORDER BY score DESC, doc_id LIMIT 10")(lambda s, d: fts.search_index(s, text_index(s, d), TEXT, 10, "and", digits=6))
_add("fts_scan_or", _SQL["fts_or"])(lambda s, d: fts.search(_t(s, d, "documents"), TEXT, 10, digits=6))
_add("fts_scan_and", _SQL["fts_and"])(lambda s, d: fts.search(_t(s, d, "documents"), TEXT, 10, "and", digits=6))
_add("fts_stats", f"SELECT count(*) AS total_docs, sum(len({_TOK}))::BIGINT AS total_tokens FROM documents")(lambda s, d: fts.stats(_t(s, d, "documents")))
_add("fts_tokenize", f"SELECT doc_id, len({_TOK})::INT AS n, md5(array_to_string({_TOK}, ' ')) AS digest FROM documents")(lambda s, d: _t(s, d, "documents").select("doc_id", tokens("text").alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.concat_ws(" ", "t").cast("binary")).alias("digest")))
_add("fts_postings", f"WITH p AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL")(lambda s, d: fts.postings(_t(s, d, "documents")).select("doc_id", "term", "tf"))
_add("fts_conversations", "WITH t AS (SELECT role, len(regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')) AS n FROM conversations) SELECT role, count(*) AS turns, sum(n)::BIGINT AS words FROM t GROUP BY role" % (UP, LOW))(
    lambda s, d: _t(s, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size(tokens("text"))).alias("words")))
_add("rrf_two_metrics", f"WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY {_SCORE['cosine']}, vec_id) - 1 AS r FROM embeddings QUALIFY r < 20), b AS (SELECT vec_id, row_number() OVER (ORDER BY {_SCORE['ip']} DESC, vec_id) - 1 AS r FROM embeddings QUALIFY r < 20) SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r + 1)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 10")(
    lambda s, d: fusion.rrf([(knn.knn(_t(s, d, "embeddings"), QUERY, 20, "cosine", digits=6), False), (knn.knn(_t(s, d, "embeddings"), QUERY, 20, "ip", digits=6), True)], 10, id_col="vec_id", digits=9))
_add("weighted_fusion", f"WITH a AS (SELECT vec_id, {_SCORE['l2']} AS s FROM embeddings ORDER BY s, vec_id LIMIT 20), b AS (SELECT vec_id, round(pow(list_distance({_E}, (SELECT {_E} FROM embeddings WHERE vec_id = 7)), 2), 6) AS s FROM embeddings ORDER BY s, vec_id LIMIT 20) SELECT vec_id, round(sum(w * (1 - 2 * atan(s) / 3.141592653589793::DOUBLE)), 9) AS score FROM (SELECT *, 0.7::DOUBLE AS w FROM a UNION ALL SELECT *, 0.3::DOUBLE AS w FROM b) GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 10")(
    lambda s, d: fusion.weighted([(knn.knn(_t(s, d, "embeddings"), QUERY, 20, "l2", digits=6), 0.7), (knn.knn_by_id(_t(s, d, "embeddings"), 7, 20, "l2", digits=6), 0.3)], "l2", 10, id_col="vec_id", digits=9))
_add("hybrid_vec_text", f"WITH {_BM25}, va AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_SCORE['l2']}, vec_id) - 1 AS r FROM embeddings QUALIFY r < 20), tb AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM s QUALIFY r < 20) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r + 1)), 9) AS score FROM (SELECT * FROM va UNION ALL SELECT * FROM tb) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")(
    lambda s, d: fusion.rrf([(knn.knn(_t(s, d, "embeddings"), QUERY, 20, "l2", digits=6).withColumnRenamed("vec_id", "doc_id"), False), (fts.search_index(s, text_index(s, d), TEXT, 20, digits=6), True)], 10, digits=9))

# ---------------------------------------------------------------- scans and changes

_add("scan_project_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20")(lambda s, d: dml.scan(_t(s, d, "orders"), ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F'", 20, key="o_orderkey"))
_add("order_by_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")(lambda s, d: dml.scan(_t(s, d, "orders"), ["o_orderkey", "o_totalprice"], None, 15, "o_totalprice", True, key="o_orderkey"))
_add("fetch_by_pk", "SELECT * FROM customer WHERE c_custkey IN (1, 5, 9, 999999999)")(lambda s, d: dml.fetch(_t(s, d, "customer"), [1, 5, 9, 999999999], "c_custkey"))
_add("upsert_dedupe", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")(lambda s, d: dml.latest(_t(s, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value"))
_add("upsert_merge", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")(
    lambda s, d: dml.upsert((o := _t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")), o.where("o_orderstatus = 'F'").withColumns({"o_totalprice": F.lit(0.0), "__order": F.lit(1)}), "o_orderkey", "__order"))
_add("insert_new", "SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey + 1000000 FROM supplier")(
    lambda s, d: dml.insert((c := _t(s, d, "customer").select("c_custkey")), c.withColumn("n", F.lit(1)).unionByName(_t(s, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.lit(1).alias("n"))), "c_custkey", "n")[0])
_add("insert_status", "SELECT status, count(*) AS n FROM (SELECT 'ALREADY_EXISTS' AS status FROM customer UNION ALL SELECT 'OK' FROM supplier) GROUP BY status")(
    lambda s, d: dml.insert((c := _t(s, d, "customer").select("c_custkey")), c.withColumn("n", F.lit(1)).unionByName(_t(s, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.lit(1).alias("n"))), "c_custkey", "n")[1].groupBy("status").agg(F.count("*").alias("n")))
_add("update_merge", "SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL ELSE p_name END AS p_name, p_size FROM part")(
    lambda s, d: dml.update((p := _t(s, d, "part").select("p_partkey", "p_name", "p_size")), p.where("p_size < 10").select("p_partkey", F.lit(None).cast("string").alias("p_name")), "p_partkey")[0])
_add("delete_by_pk", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")(lambda s, d: dml.delete(_t(s, d, "orders").select("o_orderkey"), _t(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"))
_add("delete_by_filter", "SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders) WHERE NOT coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false)")(
    lambda s, d: dml.delete_by_filter(_t(s, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority")), "o_orderpriority in ('1-URGENT', '2-HIGH')"))
_add("add_column_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax / 2 AS net, (-l_partkey * 2 + 7) // 3 AS whole FROM lineitem")(
    lambda s, d: dml.add_column(dml.add_column(_t(s, d, "lineitem"), "net", T.DoubleType(), "l_extendedprice * (1 - l_discount) + l_tax / 2"), "whole", T.LongType(), "(-l_partkey * 2 + 7) / 3").select("l_orderkey", "l_linenumber", "net", "whole"))
_add("alter_cast", "SELECT p_partkey, p_size::DOUBLE AS p_size FROM part")(lambda s, d: dml.alter_column(_t(s, d, "part").select("p_partkey", "p_size"), "p_size", kind=T.DoubleType()))
_add("alter_rename", "SELECT p_partkey, p_size AS size FROM part")(lambda s, d: dml.alter_column(_t(s, d, "part").select("p_partkey", "p_size"), "p_size", rename="size"))
_add("drop_column", "SELECT s_suppkey, s_name FROM supplier")(lambda s, d: dml.drop_column(_t(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_nationkey"))
_add("compaction_live_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")(
    lambda s, d: dml.compact((o := _t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")), o.where("o_orderstatus = 'F'"), "o_orderkey", 5000, "o_orderkey").select("o_orderkey", "o_totalprice"))


@_add("stream_upsert", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    latest_stream(stream, f"{folder}/out", f"{folder}/log", "user_id", "ts", "event_id").awaitTermination()
    return spark.read.parquet(f"{folder}/out/0").select("user_id", "event_id", "value")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
