"""Benchmark decontamination with a generalised suffix automaton.

The words of all items (lower-cased A-Z; digits, letters and everything beyond ASCII) make one
suffix automaton. Documents stream through it; at each word it holds the longest match that ends
there. A match of WINDOW words or more marks the last WINDOW words as hit and gives the items that
hold them; items of fewer words hit as a whole. Runs of words that no item has are skipped before.

Items are read on the driver in blocks of at most BLOCK_CHARS characters (one longer item alone),
each an automaton of bounded size that is broadcast; every block makes one more narrow pass. After CHAINED
passes a checkpoint ends the stage and their automata are freed, so a benchmark of any size holds few of them at once.

Nulls and empty texts have no words and no hits. Items with a null id or without words are left
out; rows that repeat an item_id count as one item. Every input row gives a row, repeated doc_ids
too. An empty benchmark hits nothing. Other columns of documents are kept by decontaminate(), whatever their names; result columns of
contamination() that have the name of a kept one get underscores after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.llm.common import LOWER, NOT_ALNUM, buffers, cut, free, need, packed, table, words_of

WINDOW = 8
BLOCK_CHARS = 1_000_000
CHAINED = 2
#: A document of which more than this share of words is hit goes as a whole.
COVERAGE = 0.5
#: So does one with windows of as many items.
ITEMS = 2


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, str, int]] = []
        for item, words in items:
            last = 0
            for w in words:
                last = self._add(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, item, 0))
            if words and len(words) < window:
                ends[-1] = (last, item, len(words))
        self._finish(ends)

    def _new(self, n: int, link: int, onward: dict[int, int]) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.len.append(n)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        now, p = self._new(self.len[last] + 1, 0, {}), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = now
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[now] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return now

    def _finish(self, ends: list[tuple[int, str, int]]) -> None:
        """holds: items by state whose substrings have WINDOW words; short: whole short items by state."""
        self.holds: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for state, item, whole in ends:
            if whole:
                self.short.setdefault(state, {}).setdefault(whole, set()).add(item)
            v = state
            while v > 0 and self.len[v] >= self.window:
                if item in (have := self.holds.setdefault(v, set())):
                    break
                have.add(item)
                v = self.link[v]
        self.least = min([self.window, *(n for x in self.short.values() for n in x)])

    def stream(self, words: list[int], hit: np.ndarray, found: set[str]) -> None:
        """Marks in hit the words within occurring windows and adds their items to found."""
        state = n = 0
        onward, link, length, window = self.next, self.link, self.len, self.window
        for i, c in enumerate(words):
            while state and c not in onward[state]:
                state = link[state]
                n = length[state]
            if c not in onward[state]:
                continue
            state = onward[state][c]
            n += 1
            if n >= window:
                hit[i + 1 - window : i + 1] = True
                v = state
                while length[link[v]] >= window:
                    v = link[v]
                found |= self.holds[v]
            if self.short:
                v = state
                while v > 0:
                    for size, items in self.short.get(v, {}).items():
                        if size <= n:
                            hit[i + 1 - size : i + 1] = True
                            found |= items
                    v = link[v]


def item_words(texts: pa.Array) -> list[list[bytes]]:
    _, data = buffers(texts)
    out: list[list[bytes]] = [[] for _ in range(len(texts))]
    for w in words_of(texts, NOT_ALNUM):
        for d, s, e in zip(w.doc.tolist(), w.start.tolist(), w.end.tolist(), strict=True):
            out[w.lo + d].append(LOWER[data[s:e]].tobytes())
    return out


def _vocabulary(auto: Automaton) -> tuple[np.ndarray, np.ndarray]:
    words = sorted(auto.ids)
    column = pa.array(words, pa.binary())
    hashes = np.concatenate([np.zeros(0, np.uint64), *(w.hash for w in words_of(column, NOT_ALNUM))])
    order = np.argsort(hashes)
    return hashes[order], np.array([auto.ids[x] for x in words], np.int64)[order]


def _pass(held, cleaned: bool):
    """Adds to each row what one automaton finds; cleaned: text without the words that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, hashes, ids = held.value
        for batch in batches:
            texts = batch.column("text")
            _, data = buffers(texts)
            rows = batch.num_rows
            n_words, hits, items = [0] * rows, batch.column("hits").to_pylist(), [set(x or ()) for x in batch.column("items").to_pylist()]
            cuts: dict[int, list[tuple[int, int]]] = {}
            at = buffers(texts)[0]
            for w in words_of(texts, NOT_ALNUM):
                counts = np.bincount(w.doc, minlength=w.hi - w.lo) if len(w.doc) else np.zeros(w.hi - w.lo, np.int64)
                first = np.cumsum(counts) - counts
                for i, n in enumerate(counts.tolist()):
                    n_words[w.lo + i] = n
                if not len(w.doc) or not len(hashes):
                    runs = []
                else:
                    where = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
                    known = hashes[where] == w.hash
                    start = np.flatnonzero(known & np.append(True, ~known[:-1] | (w.doc[1:] != w.doc[:-1])))
                    stop = np.flatnonzero(known & np.append(~known[1:] | (w.doc[1:] != w.doc[:-1]), True)) + 1
                    long = stop - start >= auto.least
                    runs = list(zip(start[long].tolist(), stop[long].tolist(), strict=True))
                for a, b in runs:
                    words = [auto.ids.get(LOWER[data[s:e]].tobytes(), -1) for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
                    hit, i = np.zeros(b - a, bool), w.lo + int(w.doc[a])
                    auto.stream(words, hit, items[i])
                    if hit.any():
                        new = np.flatnonzero(hit) + a - first[w.doc[a]]
                        hits[i] = packed(np.union1d(np.frombuffer(hits[i] or b"", "<u4"), new), "<u4")
                if cleaned:
                    for i in range(w.lo, w.hi):
                        if hits[i]:
                            which = np.frombuffer(hits[i], "<u4").astype(np.int64)
                            lo = which[np.append(True, np.diff(which) > 1)] + first[i - w.lo]
                            hi = which[np.append(np.diff(which) > 1, True)] + first[i - w.lo]
                            cuts[i] = list(zip(w.start[lo].tolist(), w.end[hi].tolist(), strict=True))
            out = {f.name: batch.column(f.name) for f in batch.schema}
            out |= {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, pa.binary()), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            if cuts:
                texts_out = texts.to_pylist()
                for i, spans in cuts.items():
                    parts, here = [], int(at[i])
                    for s, e in spans:
                        parts.append(data[here:s].tobytes())
                        here = e
                    texts_out[i] = b"".join([*parts, data[here : at[i + 1]].tobytes()]).decode("utf-8", "replace")
                out["text"] = pa.array(texts_out, texts.type)
            yield pa.RecordBatch.from_pydict(out)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], cleaned: bool = False) -> DataFrame:
    """The columns in keep and text, n_words, n_hit, items (distinct item ids as sorted strings).

    cleaned: text comes without the words that are hit.
    """
    need(docs, "text", *keep)
    need(benchmark, "item_id", "text")
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    columns = [c for c in dict.fromkeys(keep) if c != "text"]
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None).cast("int")
    out = docs.select(kept.alias("kept"), "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    alive = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        auto = Automaton([(r[0], w) for r, w in zip(rows, item_words(pa.array([r[1] for r in rows], pa.string())), strict=True) if w])
        alive.append(spark.sparkContext.broadcast((auto, *_vocabulary(auto))))
        out = out.mapInArrow(_pass(alive[-1], cleaned and k == blocks - 1), schema)
        if len(alive) == CHAINED and k < blocks - 1:
            out = cut(out)
            while alive:
                alive.pop().destroy()
    names = result_names(columns)
    n_hit = (F.coalesce(F.length("hits"), F.lit(0)) / 4).cast("long")
    found = [F.col("n_words"), n_hit, F.coalesce("items", F.array().cast("array<string>"))]
    return out.select(*[F.col("kept").getField(c).alias(c) for c in columns], "text", *[c.alias(n) for c, n in zip(found, names, strict=True)])


def result_names(columns: list[str]) -> list[str]:
    """Names of n_words, n_hit and items beside kept columns."""
    return [free(n, [*columns, "text"]) for n in ("n_words", "n_hit", "items")]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, in its own columns, without what the benchmark has.

    A document with windows of ITEMS items or hit in more than COVERAGE of its words is dropped;
    from the others each span that is hit is cut out of the text.
    """
    columns = docs.columns
    n_words, n_hit, items = (F.col(n) for n in result_names([c for c in columns if c != "text"]))
    found = contamination(docs, benchmark, columns, cleaned=True)
    return found.where((F.size(items) < ITEMS) & (n_hit <= COVERAGE * n_words)).select(*[F.col(f"`{c}`") for c in columns])


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (n >= ITEMS).alias("contaminated"))


ORACLE_SQL = r"""
WITH bw AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 8) AS l, unnest(list_transform(range(1, len(ws) - least(len(ws), 8) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 8) - 1], ' '))) AS g FROM bw WHERE len(ws) > 0
), dwin AS (
  SELECT doc_id, l, unnest(range(1, len(ws) - l + 2)) AS i, unnest(list_transform(range(1, len(ws) - l + 2), lambda i: array_to_string(ws[i:i + l - 1], ' '))) AS g
  FROM dw, (SELECT DISTINCT l FROM win) WHERE len(ws) >= l
), occ AS (SELECT d.doc_id, d.i, d.l, w.item_id FROM dwin d JOIN win w ON w.g = d.g AND w.l = d.l),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(it.n, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""
