"""Mixing sources to target weights by Poisson replication.

The sizes (characters) of all documents by source give each source a mean repetition rate: its
target share of the listed sources' total over its size. A document's count is the inverse of the Poisson
distribution with that mean at a uniform number hashed from seed and doc_id; it is exploded by its count and
the copies are shuffled globally by another hash.

Sources without a weight, and null sources, keep every document once (rate 1). Rates over RATE_LIMIT
are spread over whole copies and a Poisson rest, so exp() never vanishes. A null text has no characters;
if all of a source's texts are empty its rate is 1. A null doc_id hashes as the empty text; repeated ids have the
same count. Empty tables give none. Extra columns are kept; replicate()
puts copy_no and mix_key last, with underscores after a name that docs has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import free, need, table

#: src0 alone holds a third of some corpora: every source gets the same share.
WEIGHTS = {f"src{i}": 0.05 for i in range(20)}
SEED = 17
RATE_LIMIT = 20.0
#: Terms of the inverse; beyond, a Poisson number of mean 20 has a probability under 1e-17.
TERMS = 80


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from 13 hex digits of an md5 of seed and the columns' texts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16**13))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k of which the Poisson distribution function is over u."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.when(u < acc["cdf"], acc).otherwise(F.struct(k.cast("int").alias("k"), p.alias("p"), (acc["cdf"] + p).alias("cdf")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["k"])


def rates(docs: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """source, rate: one row per source of a weight that has characters."""
    spark = docs.sparkSession
    target = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
    size = docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars")).where("chars > 0")
    mine = size.join(F.broadcast(target), "source")  # as many rows as there are weights
    total = mine.agg(F.sum("chars").alias("all_chars"), F.sum(F.col("weight").cast("decimal(20,10)")).cast("double").alias("all_weights"))
    return mine.crossJoin(F.broadcast(total)).select("source", (F.col("weight") / F.col("all_weights") * F.col("all_chars") / F.col("chars")).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] = WEIGHTS, seed: int = SEED, rate_table: DataFrame | None = None) -> DataFrame:
    """docs with each row as often as its count says, copy_no from 1 and mix_key, the global shuffle's key."""
    need(docs, "doc_id", "text", "source")
    rate_table = rates(docs, weights) if rate_table is None else rate_table
    names = docs.columns
    rate, source, count, copy_no, mix_key = (free(n, names) for n in ("rate", "rate_source", "count", "copy_no", "mix_key"))
    r = F.coalesce(F.col(rate), F.lit(1.0))
    whole = F.when(r > RATE_LIMIT, F.floor(r - RATE_LIMIT)).otherwise(F.lit(0)).cast("int")
    number = F.when(F.col(rate).isNull(), F.lit(1)).otherwise(whole + poisson_inverse(uniform(seed, "doc_id"), r - whole))
    told = rate_table.select(F.col("rate").alias(rate), F.col("source").alias(source))
    held = docs.join(F.broadcast(told), F.col("source") == F.col(source), "left").withColumn(count, number).where(F.col(count) > 0)
    out = held.withColumn(copy_no, F.explode(F.sequence(F.lit(1), F.col(count)))).select(*names, copy_no)
    return out.withColumn(mix_key, F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(copy_no).cast("string")).cast("binary")))


def mix_sources(docs: DataFrame, weights: dict[str, float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """replicate(), shuffled globally: ordered by mix_key over all partitions; repeated rows have the same key and stand together."""
    out = replicate(docs, weights, seed)
    return out.orderBy(out.columns[-1])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs).select("doc_id", "source", F.col("copy_no").cast("long").alias("copy_no"), "mix_key")


ORACLE_SQL = """
WITH RECURSIVE s AS (SELECT source, sum(length(text)) AS chars FROM documents GROUP BY source HAVING sum(length(text)) > 0),
m AS (SELECT * FROM s WHERE source IN (%s)),
r AS (SELECT source, 0.05::DOUBLE / (SELECT sum(0.05::DECIMAL(20, 10)) FROM m)::DOUBLE * (SELECT sum(chars) FROM m)::DOUBLE / chars::DOUBLE AS rate FROM m),
d AS (SELECT doc_id, d.source, rate, ('0x' || substr(md5('17|' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents d LEFT JOIN r ON r.source = d.source),
p AS (
  SELECT doc_id, source, rate, u, 0 AS k, exp(-coalesce(rate, 1)) AS p, exp(-coalesce(rate, 1)) AS cdf FROM d
  UNION ALL
  SELECT doc_id, source, rate, u, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM p WHERE NOT u < cdf AND k < 80
),
c AS (SELECT doc_id, source, CASE WHEN rate IS NULL THEN 1 ELSE max(k) END AS n FROM p GROUP BY doc_id, source, rate),
e AS (SELECT doc_id, source, unnest(range(1, n + 1)) AS copy_no FROM c)
SELECT doc_id, source, copy_no::BIGINT AS copy_no, md5('17:order|' || doc_id::VARCHAR || '|' || copy_no::VARCHAR) AS mix_key FROM e
""" % ", ".join(f"'{k}'" for k in WEIGHTS)
