"""Full-text search by BM25: postings, corpus statistics, OR and AND matching.

search() tokenises the whole table; write_index() stores postings and search_index() reads only those of
the query's terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions.text import LONGEST, cut, tokens, uncut_tokens

K1, B = 1.2, 0.75
MAX_TOPK = 1024
#: A term's postings are in one of BUCKETS folders. Each task inverts its own rows, in blocks of about BLOCK tokens.
BUCKETS, BLOCK = 16, 1 << 20


def query_terms(df: DataFrame, text: str) -> list[str]:
    """Distinct terms of a query text, in order; the tokenizer runs in Spark as for documents."""
    row = df.sparkSession.range(1).select(F.array_distinct(tokens(F.lit(text))).alias("t")).first()
    return list(row[0])


def lengths(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Number of tokens of each row; 0 for null and empty texts, which count in the statistics."""
    return df.select(id_col, F.size(uncut_tokens(text)).alias("doc_len"))


def postings(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, term, tf, doc_len: a table that can be written and partitioned by a hash of term."""
    held = df.select(id_col, uncut_tokens(text).alias("__t"))
    rows = held.select(id_col, F.size("__t").alias("doc_len"), F.explode("__t").alias("term")).withColumn("term", cut(F.col("term")))
    return rows.groupBy(id_col, "term", "doc_len").agg(F.count("*").alias("tf"))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def stats(df: DataFrame, text: str = "text") -> DataFrame:
    n = F.size(uncut_tokens(text))
    return df.agg(F.count("*").alias("total_docs"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"))


def _terms(df: DataFrame, query: str, topk: int, match: str) -> list[str]:
    if not query or not 0 < topk <= MAX_TOPK:
        raise ValueError(f"a query text and a topk of 1 to {MAX_TOPK} are needed")
    if match not in ("or", "and"):
        raise ValueError("match is 'or' or 'and'")
    return query_terms(df, query)


def _ranked(base: DataFrame, whole: DataFrame, terms: int, topk: int, match: str, id_col: str, digits: int | None, k1: float, b: float) -> DataFrame:
    """base: id, dl, tf0, tf1 ...; whole, one row: n, total, df0, df1 ..."""
    avg = F.col("total") / F.col("n")
    norm = F.when(avg > 0, 1 - b + b * F.col("dl") / avg).otherwise(F.lit(1.0))
    score = F.lit(0.0)
    for i in range(terms):
        tf, d = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(F.greatest(F.col("n") - d + 0.5, F.lit(0.0)) / (d + 0.5) + 1)
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * norm)).otherwise(F.lit(0.0))
    wanted = F.col("tf0") > 0
    for i in range(1, terms):
        wanted = wanted | (F.col(f"tf{i}") > 0) if match == "or" else wanted & (F.col(f"tf{i}") > 0)
    # the test names a column of whole, or it would be pushed to the scan and tokenise the text for each term again
    found = base.crossJoin(F.broadcast(whole)).where(F.when(F.col("n") > 0, wanted))
    return found.select(id_col, (F.round(score, digits) if digits is not None else score).alias("score")).orderBy(F.desc("score"), id_col).limit(topk)


def search(df: DataFrame, query: str, topk: int = 10, match: str = "or", *, text: str = "text", id_col: str = "doc_id", digits: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """id, score of the topk rows with any (or all) query terms, without an index.

    Only the query's terms are counted; the global sums join back as one row.
    """
    terms = _terms(df, query, topk, match)
    if not terms:
        return df.select(id_col, F.lit(0.0).alias("score")).limit(0)
    # a cut token has over LONGEST - 4 bytes, so shorter terms are found among uncut ones
    cut = any(len(w.encode()) > LONGEST - 4 for w in terms)
    base = df.select(id_col, (tokens(text) if cut else uncut_tokens(text)).alias("__t")).select(id_col, F.size("__t").alias("dl"), *[F.size(F.filter("__t", _equals(w))).alias(f"tf{i}") for i, w in enumerate(terms)])
    whole = base.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    return _ranked(base, whole, len(terms), topk, match, id_col, digits, k1, b)


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _inverted(ids: pa.Array, held: pa.ListArray) -> pa.RecordBatch:
    """A row for each term of these rows, in order: term, n (its occurrences), and id, tf, doc_len of each row that has it."""
    lens = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(held.flatten())
    words = [w if len(w) <= LONGEST else w[:LONGEST] for w in coded.dictionary.cast(pa.binary()).to_pylist()]
    names = sorted({w.decode("utf-8", "replace") for w in words}, key=str.encode)
    place = {w: i for i, w in enumerate(names)}
    code = np.array([place[w.decode("utf-8", "replace")] for w in words], np.int64)
    # a token is its term's place and its row's in one number, so that a sort brings postings together
    key, tf = np.unique(code[coded.indices.to_numpy()] * len(lens) + np.repeat(np.arange(len(lens)), lens), return_counts=True)
    term, row = np.divmod(key, len(lens))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), x)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.add.reduceat(tf, starts), pa.int64()), lists(ids.take(pa.array(row))), lists(pa.array(tf, pa.int32())), lists(pa.array(lens[row], pa.int32()))], names=["term", "n", "id", "tf", "doc_len"])


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of id and tokens; a block goes over batches, and ends with the row that fills it."""
    ids, held, full = [], [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
        at, before = 0, 0
        while at < batch.num_rows:
            to = min(batch.num_rows, int(np.searchsorted(ends, before + BLOCK - full)) + 1)
            ids.append(batch.column(0).slice(at, to - at))
            held.append(batch.column(1).slice(at, to - at))
            full, at, before = full + int(ends[to - 1]) - before, to, int(ends[to - 1])
            if full >= BLOCK:
                yield _inverted(pa.concat_arrays(ids), pa.concat_arrays(held))
                ids, held, full = [], [], 0
    if full:
        yield _inverted(pa.concat_arrays(ids), pa.concat_arrays(held))


def inverted(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Postings in lists: bucket, term, n, id, tf, doc_len, by bucket and term in each partition.

    They are counted where their rows are, and never shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()
    held = df.select(id_col, uncut_tokens(text).alias("__t")).where(F.size("__t") > 0)
    rows = held.mapInArrow(_invert, f"term string, n long, id array<{kind}>, tf array<int>, doc_len array<int>")
    return rows.withColumn("bucket", _bucket("term")).sortWithinPartitions("bucket", "term")


def write_index(df: DataFrame, path: str, *, text: str = "text", id_col: str = "doc_id") -> None:
    """Writes postings by bucket of term, sorted by term, and one row of statistics. Ids are unique."""
    inverted(df, text, id_col).write.partitionBy("bucket").parquet(f"{path}/postings")
    total = df.sparkSession.read.schema("n long").parquet(f"{path}/postings").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    df.agg(F.count("*").alias("n")).crossJoin(total).coalesce(1).write.parquet(f"{path}/stats")


def search_index(spark: SparkSession, path: str, query: str, topk: int = 10, match: str = "or", *, id_col: str = "doc_id", digits: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """What search() gives, from a written index: only the postings of the query's terms are read."""
    stats_row = spark.read.schema("n long, total long").parquet(f"{path}/stats")
    terms = _terms(stats_row, query, topk, match)
    rows = spark.read.parquet(f"{path}/postings")
    if dict(rows.dtypes)["tf"].startswith("array"):  # else one written before lists were
        rows = rows.select("bucket", "term", F.inline(F.arrays_zip("id", "tf", "doc_len")).alias(id_col, "tf", "doc_len"))
    if not terms:
        return rows.select(id_col, F.lit(0.0).alias("score")).limit(0)
    # constants of the plan, so they prune folders
    rows = rows.where(F.col("bucket").isin([_bucket(F.lit(w)) for w in terms]) & F.col("term").isin(terms))
    base = rows.groupBy(id_col).agg(F.max("doc_len").alias("dl"), *[F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(terms)])
    whole = rows.agg(*[F.count_if(F.col("term") == w).alias(f"df{i}") for i, w in enumerate(terms)]).crossJoin(stats_row)
    return _ranked(base, whole, len(terms), topk, match, id_col, digits, k1, b)
