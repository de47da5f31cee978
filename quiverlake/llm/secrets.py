"""Secret scans, in DataFrame functions only.

Base patterns: assignments to a password, secret, token or API key; access key ids; long hex
runs. The method adds spans of kind entropy: candidate strings of 20 and more key characters are
slid over with a window of 20; the Shannon entropy of each window comes from counts by character
that are updated for the one that enters and the one that leaves; a candidate whose highest window reaches its
character class's threshold is a secret unless the allow-list suppresses it. Base spans always stay. The work is
linear in a candidate's length.

Positions are code points, from 0, end exclusive. They come from the lengths of the pieces between
matches, so each pattern is matched once more only in texts that hold it. A null text is empty. Empty tables and repeated rows
need no care: each row is handled by itself, in one narrow pass. If docs has a column secret_spans, the new one
has underscores after its name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import free, need, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: What each pattern can only match in, as a cheap first test.
HEX_HINT = r"[0-9a-f]{32}"
ACCESS_HINT = r"AKIA[A-Z0-9]{12}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: Bits: the highest window must reach them; a window of 20 has at most 4.32, of hex digits 4.
HEX_BITS, KEY_BITS = 3.0, 3.9
#: Character classes and their bits, the first that fits; others need KEY_BITS. But for hex, 99% of the windows of 20
#: random characters reach them: of 32 characters 3.34, of 36 3.41, of 62 or 64 3.65. KEY_BITS is for what slugs and paths look like.
CLASSES = [
    (r"^[0-9a-fA-F]+$", HEX_BITS),
    (r"^([A-Z2-7]+|[a-z2-7]+)={0,2}$", 3.3),
    (r"^([A-Z0-9]+|[a-z0-9]+)={0,2}$", 3.4),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", 3.6),
]
#: Candidates that look random and are not secret.
ALLOWED = [
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|test[_-]?key",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"^sha(256|384|512)-",
    r"^[A-Za-z]+([_/+-][A-Za-z]+)*={0,2}$",
    r"^[0-9_/+-]+={0,2}$",
]
#: The character that stands for a count of 0, spans that are put on at once.
COUNT, RUN = 48, 256
KINDS = ["assign", "access", "hex", "entropy"]
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _found(text: Column, pattern: str, hint: str, rank: int, ok, group: int = 0) -> Column:
    """Spans of the matches of which ok(the group's text) holds."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.zip_with(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), whole, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"))), tested, lambda a, t: F.struct(a["gap"].alias("gap"), a["n"].alias("n"), ok(t).alias("ok")))
    # spans are put on in runs of RUN, so that a text with many matches isn't copied for each
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("run"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["n"]).alias("end"))
        full = x["ok"] & (F.size(acc["run"]) >= RUN)
        run = F.when(full, F.array(span)).when(x["ok"], F.array_append(acc["run"], span)).otherwise(acc["run"])
        out = F.when(full, F.array_append(acc["out"], acc["run"])).otherwise(acc["out"])
        return F.struct((begin + x["n"]).alias("pos"), run.alias("run"), out.alias("out"))

    return F.when(text.rlike(hint), F.aggregate(rows, start, step, lambda acc: F.flatten(F.array_append(acc["out"], acc["run"])))).otherwise(F.array().cast(SPAN))


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of the windows of s (ASCII), by incremental counts; 0 for shorter s.

    The counts are a string of 128 characters: character k stands for how often code k is in the window, counted from COUNT.
    """
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
    weight = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    held = lambda counts, code: F.ascii(F.substr(counts, code + 1, F.lit(1))) - COUNT
    put = lambda counts, code, n: F.overlay(counts, F.char(n + COUNT), code + 1, F.lit(1))
    start = F.struct(F.lit(chr(COUNT) * 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def leave(acc: Column, x: Column) -> Column:
        n = held(acc["counts"], x["leaves"])
        less = F.struct(put(acc["counts"], x["leaves"], n - 1).alias("counts"), (acc["sum"] + weight(n - 1) - weight(n)).alias("sum"))
        return F.when(x["leaves"] >= 0, less).otherwise(F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum")))

    def enter(acc: Column, left: Column, x: Column) -> Column:
        n = held(left["counts"], x["enters"])
        total = left["sum"] + weight(n + 1) - weight(n)
        bits = F.when(x["full"], F.log2(F.lit(float(window))) - total / F.lit(float(window))).otherwise(F.lit(0.0))
        return F.struct(put(left["counts"], x["enters"], n + 1).alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    # a lambda's variable holds a value that is computed once; an expression in a lambda is computed for each element
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    step = lambda acc, x: once(leave(acc, x), lambda left: enter(acc, left, x))
    move = lambda all_: lambda c, i: F.struct(c.alias("enters"), F.when(i >= window, F.get(all_, i - window)).otherwise(F.lit(-1)).alias("leaves"), (i >= window - 1).alias("full"))
    return once(codes, lambda all_: F.aggregate(F.transform(all_, move(all_)), start, step, lambda acc: acc["best"]))


def _is_secret(s: Column) -> Column:
    allowed = reduce(lambda a, b: a | b, [s.rlike(p) for p in ALLOWED])
    bits = reduce(lambda rest, c: F.when(s.rlike(c[0]), F.lit(c[1])).otherwise(rest), reversed(CLASSES), F.lit(KEY_BITS))
    return F.when(s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~allowed, peak_entropy(s) >= bits).otherwise(F.lit(False))


def scan(docs: DataFrame) -> DataFrame:
    """docs and last secret_spans: array of (start, rank of its kind in KINDS, end), in that order."""
    need(docs, "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.array_sort(F.concat(
        _found(text, ASSIGN, ASSIGN, 0, lambda t: F.length(t) >= 8, group=2),
        _found(text, ACCESS, ACCESS_HINT, 1, lambda t: F.length(t) >= 16),
        _found(text, HEX, HEX_HINT, 2, lambda t: F.length(t) >= 32),
        _found(text, CANDIDATE, CANDIDATE, 3, _is_secret),
    ))
    return docs.withColumn(free("secret_spans", docs.columns), spans)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def redact(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """docs, in its own columns, with each secret in the text replaced by mask; a null text stays null."""
    names, found = docs.columns, scan(docs)
    text, spans = F.col("text"), F.col(found.columns[-1])
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        between = F.when(x["start"] >= acc["pos"], F.concat(text.substr(acc["pos"] + 1, x["start"] - acc["pos"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.concat(acc["out"], between).alias("out"))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["pos"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text)).select(*names)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("secret_spans", lambda x: x["rank"] == rank)).cast("long")
    base = F.filter("secret_spans", lambda x: x["rank"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 16), ('hex', 2, '[0-9a-f]+', 0, 32), ('entropy', 3, '[A-Za-z0-9+/_-]{20,}={0,2}', 0, 20)) t(kind, rank, pat, grp, least)),
m AS (
  SELECT doc_id, kind, rank, least, string_split_regex(t, pat) AS gaps, regexp_extract_all(t, pat) AS ms, CASE WHEN grp = 2 THEN regexp_extract_all(t, pat, 2) ELSE regexp_extract_all(t, pat) END AS tested
  FROM d, p WHERE regexp_matches(t, pat) AND (rank <> 2 OR regexp_matches(t, '[0-9a-f]{32}'))
),
f AS (
  SELECT doc_id, kind, rank, i, tested[i] AS s, ms[i] AS whole, least,
    sum(length(gaps[i])) OVER w + sum(length(ms[i])) OVER w - length(ms[i]) AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m) WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)
),
c AS (
  SELECT *, CASE
    WHEN regexp_matches(s, '^[0-9a-fA-F]+$') THEN 3.0
    WHEN regexp_matches(s, '^([A-Z2-7]+|[a-z2-7]+)={0,2}$') THEN 3.3
    WHEN regexp_matches(s, '^([A-Z0-9]+|[a-z0-9]+)={0,2}$') THEN 3.4
    WHEN regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[0-9]') THEN 3.6
    ELSE 3.9 END AS bits,
    regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')
    AND NOT regexp_matches(s, '(?i)example|sample|dummy|placeholder|changeme|your[_-]|test[_-]?key')
    AND NOT regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
    AND NOT regexp_matches(s, '(?i)0123456789|abcdefghij|qwertyuiop') AND NOT regexp_matches(s, '^sha(256|384|512)-')
    AND NOT regexp_matches(s, '^[A-Za-z]+([_/+-][A-Za-z]+)*={0,2}$') AND NOT regexp_matches(s, '^[0-9_/+-]+={0,2}$') AS wanted
  FROM f WHERE length(s) >= least
),
e AS (
  SELECT * FROM c WHERE rank < 3 OR (wanted AND list_max(list_transform(range(1, length(s) - 18), lambda i: list_sum(list_transform(list_distinct(string_split(s[i:i + 19], '')),
    lambda x: -((20 - length(replace(s[i:i + 19], x, ''))) / 20.0) * log2((20 - length(replace(s[i:i + 19], x, ''))) / 20.0))))) >= bits)
),
g AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || (start + length(whole)), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start || ':' || (start + length(whole)), ',' ORDER BY start, rank) AS spans
  FROM e GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
