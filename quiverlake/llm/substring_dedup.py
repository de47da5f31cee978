"""Substring dedup: repeated passages, found with an FM-index per shard.

A window is WINDOW consecutive words of one document; a word goes if a window over it also starts in
a document with a smaller doc_id. Text is parted by content first:

1. Each window has an anchor: the smallest hash of its GRAM-word sequences. The same window has the
   same anchor anywhere, so anchors of one document only can't be in a repeated window. A map task
   settles the anchors that several of its own documents have and asks, for each of these, for two of them only; so an
   anchor in a third of all documents sends two values for each CHUNK of text.
2. The stretch of words of the windows that have a shared anchor goes, as text, to the shard of
   the anchor's hash. Equal stretches of a map task are sent once, for the smallest doc_id: for others all their windows are repeats.
3. A shard's distinct stretches make an FM-index: a wavelet matrix over the Burrows-Wheeler transform.
   The stretches are streamed backwards through it: an interval of suffixes stands for the words read so far, and the least doc_id in
   it says if a smaller document has them. The longest such matches are their matching statistics; from WINDOW words on they are
   intervals to remove.
4. The intervals go back to their documents, one row for each.

Words are told apart by 64-bit hashes, stretches by a hash of their words. A null or empty text has no words. A null doc_id neither
removes nor loses words. Rows with a repeated doc_id each get a row and don't remove from each other. Empty tables give none;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm import sharing
from quiverlake.llm.common import BLANKS, buffers, cut, long_ids, mix, need, ngrams, packed, table, unpacked, words_of
from quiverlake.llm.fm_index import FMIndex

WINDOW = 13
GRAM = 7
#: Bytes of text whose repeats a map task settles by itself.
CHUNK = 4 << 20
#: Words of stretches that a shard gets on average; the number of shards grows with the data.
PER_SHARD = 600_000
STRETCHES = "shard int, labels binary, rows binary, starts binary, sizes binary, which binary, texts binary"
HITS = "part long, ids binary, rows binary, starts binary, counts binary"


def anchors(w) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a run of documents: its first word and its anchor, as indexes of words."""
    grams = ngrams(w.hash, GRAM)
    m = len(w.hash) - WINDOW + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none, grams
    best, at = grams[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, WINDOW - GRAM + 1):
        less = grams[j : j + m] < best
        best[less] = grams[j : j + m][less]
        at[less] = j
    start = np.flatnonzero(w.doc[:m] == w.doc[WINDOW - 1 :])
    return start, start + at[start], grams


def _firsts(w) -> np.ndarray:
    counts = np.bincount(w.doc, minlength=w.hi - w.lo) if len(w.doc) else np.zeros(w.hi - w.lo, np.int64)
    return np.cumsum(counts) - counts


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(key):
        return iter(())
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return zip(edge.tolist(), np.append(edge[1:], len(key)).tolist(), strict=True)


def _settled(values: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values two labels have here, and which still have to be asked for: the others, and two of each of those."""
    order = np.lexsort((labels, values))
    ranked, whose = values[order], labels[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    last = np.append(first[1:], len(ranked)) - 1
    twice = whose[first] != whose[last]
    known, asked = np.empty(len(values), bool), np.zeros(len(values), bool)
    known[order] = np.repeat(twice, last - first + 1)
    asked[order[first]] = asked[order[last]] = True
    return known, asked | ~known


def _spread(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = long_ids(batch.column("doc_id"))
            for w in words_of(batch.column("text"), BLANKS, False, CHUNK):
                _, where, grams = anchors(w)
                own = np.unique(where)
                if not len(own):
                    continue
                doc = w.doc[own]
                label, place = ids[doc + w.lo], (own - _firsts(w)[doc]).astype(np.uint32)
                known, asked = _settled(grams[own], label)
                yield from sharing.blobs(label[asked], None, mix(grams[own][asked]), place[asked], bits)  # anchors are minima: mixed, they spread evenly
                if known.any():
                    yield from sharing.direct(label[known], place[known], bits)

    return run


def _flagged(bits: int):
    def run(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() < 0:
            return sharing.passed_on(rows)
        items, sizes, flags, places = sharing.shared(rows, once=False)
        count = np.diff(np.append(0, np.cumsum(flags)[np.cumsum(sizes) - 1]))
        keep = count > 0
        return sharing.sent_back(items[keep], count[keep], places[flags], bits)

    return run


def _gathered(rows: pa.Table) -> pa.Table:
    """One row for each document with its anchors that others have."""
    items, counts, places, _ = sharing.gathered(rows)
    ends = np.cumsum(counts)
    return pa.table({"id": items, "places": pa.array([packed(places[e - n : e], "<u4") for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())})


def _hit_rows(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray, bits: int) -> dict[str, list]:
    """Cells of HITS by parts of the documents; row: a hash of the text, which tells rows of one doc_id apart."""
    part = (mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, ids, rows, starts, counts = part[order], ids[order], rows[order], starts[order], counts[order]
    out: dict[str, list] = {"part": [], "ids": [], "rows": [], "starts": [], "counts": []}
    for a, b in _runs(part):
        out["part"].append(int(part[a]))
        for name, values, kind in (("ids", ids, "<i8"), ("rows", rows, "<i8"), ("starts", starts, "<u4"), ("counts", counts, "<u2")):
            out[name].append(packed(values[a:b], kind))
    return out


def _stretch_rows(w, ids: np.ndarray, hashes: np.ndarray, flagged: list, data: np.ndarray, shards: int, bits: int) -> Iterator[pa.RecordBatch]:
    start, where, grams = anchors(w)
    firsts = _firsts(w)
    counts = np.diff(np.append(firsts, len(w.hash)))
    marked = np.zeros(len(w.hash), bool)
    for i, cell in enumerate(flagged):
        place = np.frombuffer(cell, "<u4").astype(np.int64)
        marked[place[place < counts[i]] + firsts[i]] = True
    keep = marked[where]
    start, where = start[keep], where[keep]
    if not len(start):
        return
    new = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1)))
    last = np.append(new[1:], len(start)) - 1
    begin, size = start[new], start[last] - start[new] + WINDOW
    shard, doc = (grams[where[new]] % np.uint64(shards)).astype(np.int64), w.doc[begin]
    digest = _digests(w.hash, begin, size)
    order = np.lexsort((begin, ids[doc], digest, shard))
    begin, size, shard, doc, digest = begin[order], size[order], shard[order], doc[order], digest[order]
    label, place, row = ids[doc], (begin - firsts[doc]).astype(np.uint32), hashes[doc]
    lead = np.append(True, (digest[1:] != digest[:-1]) | (shard[1:] != shard[:-1]))
    piece = np.cumsum(lead) - 1
    own = label == label[np.flatnonzero(lead)][piece]  # occurrences in the document with the smallest doc_id
    none: dict[str, list] = {"shard": [], "labels": [], "rows": [], "starts": [], "sizes": [], "which": [], "texts": []}
    out, raw, base = none, data[w.start[0] : w.end[-1]].tobytes(), int(w.start[0])
    head, mine = np.flatnonzero(lead), np.flatnonzero(own)
    ends = np.searchsorted(shard[mine], np.arange(shards + 1))
    for a, b in _runs(shard[head]):
        s, h = int(shard[head[a]]), head[a:b]
        occ = mine[ends[s] : ends[s + 1]]
        out["shard"].append(s)
        out["labels"].append(packed(label[h], "<i8"))
        out["sizes"].append(packed(size[h], "<u2"))
        out["texts"].append(b"\n".join([raw[x:y] for x, y in zip((w.start[begin[h]] - base).tolist(), (w.end[begin[h] + size[h] - 1] - base).tolist(), strict=True)]))
        out["rows"].append(packed(row[occ], "<i8"))
        out["starts"].append(packed(place[occ], "<u4"))
        out["which"].append(packed(piece[occ] - a, "<u4"))
    if not own.all():
        hits = _hit_rows(label[~own], row[~own], place[~own], size[~own] - WINDOW + 1, bits)
        out["shard"] += [-1 - p for p in hits["part"]]
        for name, cells in (("labels", hits["ids"]), ("rows", hits["rows"]), ("starts", hits["starts"]), ("sizes", hits["counts"]), ("which", None), ("texts", None)):
            out[name] += cells or [None] * len(hits["part"])
    yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), *(pa.array(v, pa.binary()) for k, v in out.items() if k != "shard")], names=list(out))


def _digests(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each run of values: of a mixed value for each place, added up."""
    total = size.astype(np.uint64)
    for j in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > j)
        total[some] += mix(hashes[begin[some] + j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
    return mix(total)


def _stretches(shards: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, flagged, text = long_ids(batch.column("doc_id")), long_ids(batch.column("row")), batch.column("places").to_pylist(), batch.column("text")
            _, data = buffers(text)
            for w in words_of(text, BLANKS, False, CHUNK):
                if len(w.hash) >= WINDOW:
                    yield from _stretch_rows(w, ids[w.lo : w.hi], hashes[w.lo : w.hi], flagged[w.lo : w.hi], data, shards, bits)

    return run


def repeats(words: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct stretches: stretch, begin and end of each longest match, of WINDOW words or more, with one of a smaller label."""
    alphabet, text = np.unique(words, return_inverse=True)
    _, rank = np.unique(labels, return_inverse=True)
    index = FMIndex(text + 1, sizes, len(alphabet) + 1)
    return index.matches(text + 1, sizes, rank, WINDOW)


def _removed(bits: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        cells = {n: rows.column(n).to_pylist() for n in ("labels", "rows", "starts", "sizes", "which")}
        labels, row, starts, sizes = unpacked(cells["labels"], "<i8"), unpacked(cells["rows"], "<i8"), unpacked(cells["starts"], "<u4"), unpacked(cells["sizes"], "<u2").astype(np.int64)
        if key[0].as_py() < 0:
            return pa.table({"part": pa.array([-1 - key[0].as_py()], pa.int64()), "ids": [packed(labels, "<i8")], "rows": [packed(row, "<i8")], "starts": [packed(starts, "<u4")], "counts": [packed(sizes, "<u2")]})
        each = np.array([len(x) // 8 for x in cells["labels"]])
        which = np.concatenate([np.frombuffer(x, "<u4") + k for x, k in zip(cells["which"], (np.cumsum(each) - each).tolist(), strict=True)]).astype(np.int64)
        words = np.concatenate([w.hash for w in words_of(rows.column("texts").combine_chunks(), BLANKS, False, CHUNK)])
        first = np.cumsum(sizes) - sizes
        digest = _digests(words, first, sizes)
        order = np.lexsort((labels, digest))
        lead = np.append(True, digest[order][1:] != digest[order][:-1])
        one = order[lead]  # of equal stretches the one with the smallest doc_id
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(lead) - 1
        size1 = sizes[one]
        pick = np.arange(int(size1.sum())) - np.repeat(np.cumsum(size1) - size1 - first[one], size1)
        piece, begin, end = repeats(words[pick], size1, labels[one])

        whose = of[which]
        later = labels[which] > labels[one][whose]
        ids, rws, at, n = [labels[which[later]]], [row[later]], [starts[later]], [sizes[which[later]] - WINDOW + 1]
        owner = np.flatnonzero(~later)
        by_piece = owner[np.argsort(whose[owner], kind="stable")]
        lo, hi = np.searchsorted(whose[by_piece], piece), np.searchsorted(whose[by_piece], piece, "right")
        match = np.repeat(np.arange(len(piece)), hi - lo)
        occ = by_piece[np.arange(len(match)) - np.repeat(np.cumsum(hi - lo) - (hi - lo) - lo, hi - lo)]
        ids.append(labels[which[occ]])
        rws.append(row[occ])
        at.append(starts[occ] + begin[match].astype(np.uint32))
        n.append((end - begin)[match] - WINDOW + 1)
        out = _hit_rows(np.concatenate(ids), np.concatenate(rws), np.concatenate(at), np.concatenate(n), bits)
        return pa.table({k: pa.array(v, pa.int64() if k == "part" else pa.binary()) for k, v in out.items()})

    return run


def _hits(rows: pa.Table) -> pa.Table:
    """One row for each row of documents that loses words."""
    cells = {n: rows.column(n).to_pylist() for n in ("ids", "rows", "starts", "counts")}
    ids, row, starts, counts = unpacked(cells["ids"], "<i8"), unpacked(cells["rows"], "<i8"), unpacked(cells["starts"], "<u4"), unpacked(cells["counts"], "<u2")
    order = np.lexsort((row, ids))
    ids, row, starts, counts = ids[order], row[order], starts[order], counts[order]
    edge = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (row[1:] != row[:-1]))) if len(ids) else np.zeros(0, np.int64)
    spans = list(zip(edge.tolist(), np.append(edge[1:], len(ids)).tolist(), strict=False))
    return pa.table({"id": ids[edge], "row": row[edge], "starts": pa.array([packed(starts[a:b], "<u4") for a, b in spans], pa.binary()), "counts": pa.array([packed(counts[a:b], "<u2") for a, b in spans], pa.binary())})


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = buffers(batch.column("text"))
            starts, counts = batch.column("starts").to_pylist(), batch.column("counts").to_pylist()
            n_words, n_removed, digest, texts = [], [], [], []
            for i in range(batch.num_rows):
                words = data[at[i] : at[i + 1]].tobytes().split()
                gone = 0
                if starts[i]:
                    edge = np.zeros(len(words) + 1, np.int64)
                    begin = np.frombuffer(starts[i], "<u4").astype(np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + np.frombuffer(counts[i], "<u2") + WINDOW - 1, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    gone = int(len(words) - keep.sum())
                    kept = b" ".join(compress(words, keep.tolist()))
                else:
                    kept = b" ".join(words)
                n_words.append(len(words))
                n_removed.append(gone)
                digest.append(sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept)
            out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                out["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text (the kept words, one space between) of each row."""
    need(docs, "doc_id", "text")
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = mine.where("doc_id is not null and text is not null")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = sharing.bits_for(int(chars) // 24)  # about a word in four is an anchor, of six characters
    sent = known.mapInArrow(_spread(bits), sharing.BLOBS).groupBy("bucket").applyInArrow(_flagged(bits), sharing.BACK)
    flags = cut(sent.groupBy("part").applyInArrow(_gathered, "id long, places binary"))
    flagged = flags.agg(F.sum(F.length("places"))).first()[0] or 0
    shards = max(8, int(flagged // 4 * 17 // PER_SHARD) + 1)
    pieces = known.withColumn("row", F.xxhash64("text")).join(flags, known["doc_id"] == flags["id"]).select("doc_id", "row", "text", "places").mapInArrow(_stretches(shards, bits), STRETCHES)
    removed = pieces.groupBy("shard").applyInArrow(_removed(bits), HITS)
    hits = cut(removed.groupBy("part").applyInArrow(_hits, "id long, row long, starts binary, counts binary"))
    told = mine.join(hits, (mine["doc_id"] == hits["id"]) & (F.xxhash64("text") == hits["row"]), "left").select("doc_id", "text", "starts", "counts")
    return told.mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM w WHERE len(ws) >= 13),
f AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE first_id < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN r ON r.doc_id = x.doc_id AND r.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(len(w.ws), 0)::BIGINT AS n_words, (coalesce(len(w.ws), 0) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
