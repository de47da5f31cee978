"""Language-model scoring: a causal self-attention model over subword ids.

A text's tokens are its words (lower-cased A-Z) and one end. Each word is split into subwords of a
public vocabulary. The attention model, in numpy, reads and predicts the subword ids themselves: the class of
the next one (the HEAD most frequent are classes of their own, the others come by frequency), then the id within the
class, both by learned weights. It is trained on every token of all training documents: in each of ROUNDS rounds
the batches of that round make a pass over their windows, and their changes are averaged. Overlapping
windows score each token once, with half a window of context.

The base score is a smoothed word model over all training documents. Documents are dealt to batches
of about BATCH_CHARS; each batch sends its distinct words (64-bit hashes, with counts) to the
buckets of the hash space and gets their totals back, so no table of words is ever in one place.
Texts are split into words once: training and scoring read each batch's word numbers and subwords.

A null or empty text is its end alone. Repeated rows are texts each; a null doc_id has the fold of the empty text.
An empty table gives none; without training documents all counts are 0. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import copy
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.attention import WIDTH, Attention, windows
from quiverlake.llm.common import BLANKS, LOWER, buffers, crc_mod, cut, need, packed, table, words_of

VOCABULARY = os.environ.get("QUIVERLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
FOLDS, HELD_OUT = 5, 1
BATCH_CHARS = 12_000_000
#: Subwords that are classes of their own; the least size of other classes and its growth from one to the next.
HEAD, FIRST, GROWTH = 52, 32, 1.15
#: Rounds of training, windows a step, and the steps that small inputs get by repeated passes.
ROUNDS, TRAIN_BATCH, LEAST_STEPS = 4, 128, 500
SHARD = 1024
PER_BUCKET = 400_000

_encoders: dict[str, object] = {}


class Subwords:
    """Subword ids of words; words longer than 64 characters are split there."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.newline = ranks[b"\n"]
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.coder = tiktoken.Encoding("words", pat_str=r"[^\n]{1,64}|\n", mergeable_ranks=ranks, special_tokens={})

    def of(self, words: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n words, each begun by a blank and ended by a newline, one after another; how many each has."""
        ids = np.asarray(self.coder.encode_to_numpy(words.decode("utf-8", "replace"), disallowed_special=()), np.int64)
        stop = np.flatnonzero(ids == self.newline)
        sizes = np.diff(np.append(-1, stop)) - 1
        return ids[ids != self.newline], sizes


def encoder(path: str) -> Subwords:
    if path not in _encoders:
        _encoders[path] = Subwords(path)
    return _encoders[path]


def squeezed(values: np.ndarray, kind: str) -> bytes:
    """packed() numbers, compressed: all first bytes, then all second ones and so on, after their number."""
    flat = np.ascontiguousarray(values, kind)
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, flat.itemsize).T)
    return packed(np.array([len(flat)]), "<i8") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(cell: bytes, kind: str) -> np.ndarray:
    n, width = int(np.frombuffer(cell, "<i8", 1)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(memoryview(cell)[8:], n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def vocabulary_of(column: pa.Array):
    """Distinct word hashes, each word's place among them, its text, and the distinct words as bytes."""
    _, data = buffers(column)
    docs, hashes, starts, ends = [], [], [], []
    for w in words_of(column, BLANKS):
        docs.append(w.doc + w.lo)
        hashes.append(w.hash)
        starts.append(w.start)
        ends.append(w.end)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), b""
    doc, hashed = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(hashed)
    ranked = hashed[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    distinct, first = ranked[new], order[new]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    start, end = np.concatenate(starts)[first], np.concatenate(ends)[first]
    size = end - start
    out = np.full(int(size.sum()) + 2 * len(size), 10, np.uint8)
    at = np.cumsum(size + 2) - size - 1
    out[at - 1] = 32
    spot = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + spot] = LOWER[data[np.repeat(start, size) + spot]]
    return distinct, place, doc, out.tobytes()


#: Of a batch's own row: its subword counts; its distinct words' subwords and how many each has; its words' places
#: among the distinct ones; each text's words, fold and id.
OWN = ("ids", "id_counts", "split", "pieces", "place", "words", "held", "doc_ids")


def _asked(bits: int, path: str):
    """Of a batch: its distinct words by bucket with counts in training texts; and all its texts as numbers."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        batch, n = key[0].as_py(), rows.num_rows
        rows = rows.sort_by("turn")
        held = np.asarray(rows.column("held_out").combine_chunks())
        distinct, place, doc, words = vocabulary_of(rows.column("text").combine_chunks())
        train = np.bincount(place, ~held[doc], minlength=len(distinct)).astype(np.int64)
        bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64)
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(distinct) else bucket
        ranges = list(zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist(), strict=False))
        ids, sizes = encoder(path).of(words, len(distinct))
        count = np.bincount(ids, np.repeat(train, sizes)).astype(np.int64)
        some = np.flatnonzero(count)
        none, doc_ids = [None] * len(ranges), rows.column("doc_id").combine_chunks()
        own = {"ids": packed(some, "<u4"), "id_counts": packed(count[some], "<i8"), "split": squeezed(ids, "<u4"), "pieces": squeezed(sizes, "<u4"), "place": squeezed(place, "<u4"), "words": squeezed(np.bincount(doc, minlength=n), "<u4"), "held": squeezed(held, "u1")}
        return pa.table({
            "batch": pa.array([batch] * (len(ranges) + 1), pa.int64()), "bucket": pa.array([*bucket[edge].tolist(), None], pa.int64()),
            "hashes": pa.array([*(squeezed(distinct[a:b], "<u8") for a, b in ranges), None], pa.binary()), "counts": pa.array([*(squeezed(train[a:b], "<u4") for a, b in ranges), None], pa.binary()),
            **{c: pa.array([*none, x], pa.binary()) for c, x in own.items()},
            "doc_ids": pa.concat_arrays([pa.nulls(len(ranges), pa.list_(doc_ids.type)), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), doc_ids)]),
        })

    return run


def _answered(rows: pa.Table) -> pa.Table:
    """Totals of a bucket's words for each batch that asked; on the first row also their number and sum."""
    asked = [unsqueezed(x, "<u8") for x in rows.column("hashes").to_pylist()]
    counts = np.concatenate([unsqueezed(x, "<u4") for x in rows.column("counts").to_pylist()])
    distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, counts, minlength=len(distinct)).astype(np.int64)
    answers = np.split(total[place], np.cumsum([len(x) for x in asked])[:-1])
    none = [0] * (rows.num_rows - 1)
    return pa.table({
        "batch": rows.column("batch"), "bucket": rows.column("bucket"), "totals": pa.array([squeezed(x, "<i8") for x in answers], pa.binary()),
        "kinds": pa.array([int((total > 0).sum()), *none], pa.int64()), "tokens": pa.array([int(total.sum()), *none], pa.int64()),
    })


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of subwords in training texts, of each batch's own row."""
    for rows in batches:
        for ids, counts in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            yield pa.record_batch({"id": np.frombuffer(ids, "<u4").astype(np.int64), "n": np.frombuffer(counts, "<i8")})


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Class of each subword: the HEAD most frequent alone, the others by frequency in classes that grow by GROWTH."""
    sizes = [1] * min(HEAD, len(counts))
    while (left := len(counts) - sum(sizes)) > 0:
        sizes.append(min(left, max(FIRST, int(sizes[-1] * GROWTH))))
    of = np.empty(len(counts), np.int64)
    of[np.argsort(-counts, kind="stable")] = np.repeat(np.arange(len(sizes)), sizes)
    return of


def _sequences(place: np.ndarray, doc: np.ndarray, ids: np.ndarray, sizes: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of n texts, each with its end, and how many each has; place: words in order of text."""
    each = sizes[place]
    total = np.bincount(doc, each, minlength=n).astype(np.int64) + 1
    out = np.empty(int(total.sum()), ids.dtype)
    stop = np.cumsum(total) - 1
    inside = np.ones(len(out), bool)
    inside[stop] = False
    first = np.cumsum(sizes) - sizes
    out[inside] = ids[np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each - first[place], each)]
    out[stop] = end
    return out, total


def _texts(row: dict, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's own row: subword ids of its texts and how many each has; which are held out; its words' places and texts."""
    split, pieces, place, words = (unsqueezed(row[c], "<u4").astype(np.int64) for c in ("split", "pieces", "place", "words"))
    doc = np.repeat(np.arange(len(words)), words)
    return *_sequences(place, doc, split, pieces, len(words), end), unsqueezed(row["held"], "u1").astype(bool), place, doc


def _trained(held):
    """A batch's share in a round: one pass over every window of its training texts; what it changed, by shards of rows."""

    def one(row: dict) -> pa.RecordBatch:
        net, end, done, share, least = held.value
        sequence, length, apart, _, _ = _texts(row, end)
        learn = ~apart
        out: dict[str, list] = {"shard": [], "ids": [], "change": [], "tokens": []}
        if learn.any():
            before, target = windows(sequence[np.repeat(learn, length)], length[learn], net.begin)
            net = copy.deepcopy(net)
            dense, each = net.dense(), net.rows()
            passes = max(1, -(-least // -(-len(before) // TRAIN_BATCH)))
            net.train(before, target, passes, TRAIN_BATCH, done=done, share=share)
            each = net.rows() - each
            some = np.flatnonzero(each.any(1))
            n = int(length[learn].sum())
            for a in range(0, len(each), SHARD):
                if len(inside := some[(some >= a) & (some < a + SHARD)]):
                    out["shard"].append(a // SHARD)
                    out["ids"].append(packed(inside, "<u4"))
                    out["change"].append(packed(each[inside], "<f4"))
                    out["tokens"].append(n)
            out["shard"].append(-1)
            out["ids"].append(b"")
            out["change"].append(packed(net.dense() - dense, "<f4"))
            out["tokens"].append(n)
        kinds = {"shard": pa.int64(), "ids": pa.binary(), "change": pa.binary(), "tokens": pa.int64()}
        return pa.record_batch({k: pa.array(v, kinds[k]) for k, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                yield one(rows.slice(i, 1).to_pylist()[0])

    return run


def _averaged(rows: pa.Table) -> pa.Table:
    """Mean change of a shard over the batches that changed a row, weighed by their tokens."""
    shard, tokens = rows.column("shard")[0].as_py(), rows.column("tokens").to_numpy().astype(float)
    ids, cells = rows.column("ids").to_pylist(), rows.column("change").to_pylist()
    width = len(cells[0]) // 4 if shard < 0 else 2 * WIDTH + 1
    total, weight = np.zeros((1 if shard < 0 else SHARD, width)), np.zeros(1 if shard < 0 else SHARD)
    for i, c, n in zip(ids, cells, tokens, strict=True):
        at = np.zeros(1, np.int64) if shard < 0 else np.frombuffer(i, "<u4") - shard * SHARD
        total[at] += np.frombuffer(c, "<f4").reshape(-1, width) * n
        weight[at] += n
    some = np.flatnonzero(weight)
    return pa.table({"shard": pa.array([shard], pa.int64()), "ids": pa.array([packed(some, "<u4")], pa.binary()), "change": pa.array([packed(total[some] / weight[some, None], "<f4")], pa.binary()), "tokens": pa.array([int(tokens.sum())], pa.int64())})


CHANGES = "shard long, ids binary, change binary, tokens long"


def train(own: DataFrame, net: Attention, end: int, batches: int) -> int:
    """Trains net on every training text, in rounds of batches whose changes are averaged; the tokens it learned from."""
    spark, rounds, seen = own.sparkSession, min(batches, ROUNDS), 0
    for r in range(rounds):
        mine = F.pmod(F.col("batch"), F.lit(rounds)) == r
        held = spark.sparkContext.broadcast((net, end, r / rounds, 1 / rounds, -(-LEAST_STEPS // rounds)))
        changed = own.where(mine).select("split", "pieces", "place", "words", "held").mapInArrow(_trained(held), CHANGES)
        found = changed.groupBy("shard").applyInArrow(_averaged, CHANGES).collect()  # the model's size, whatever the input's
        dense, rows = net.dense(), net.rows()
        for x in found:
            change = np.frombuffer(x["change"], "<f4")
            if x["shard"] < 0:
                dense, seen = dense + change, seen + x["tokens"]
            else:
                rows[np.frombuffer(x["ids"], "<u4").astype(np.int64) + x["shard"] * SHARD] += change.reshape(-1, rows.shape[1])
        net.put(dense, rows)
        held.destroy()
        del changed
    net.ready()
    return seen


def _scored(held):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        net, end, docs, tokens, kinds = held.value
        doc_ids = rows.column("doc_ids").combine_chunks().flatten()
        sequence, length, apart, place, doc = _texts(rows.drop_columns("doc_ids").to_pylist()[0], end)
        n = len(length)
        order = np.argsort(answers.column("bucket").to_numpy())
        cells = answers.column("totals").to_pylist()
        below = np.log10(tokens + 0.5 * (kinds + 1))
        base = np.full(n, np.log10(docs + 0.5) - below)
        known = np.full(n, int(docs > 0), np.int64)
        n_tokens = np.ones(n, np.int64)
        if len(place):
            count = np.concatenate([unsqueezed(cells[i], "<i8") for i in order]).astype(float)
            base += np.bincount(doc, (np.log10(count + 0.5) - below)[place], minlength=n)
            known += np.bincount(doc, (count > 0)[place], minlength=n).astype(np.int64)
            n_tokens += np.bincount(doc, minlength=n)
        nats = net.log_probability(sequence, length)
        return pa.table({"doc_id": doc_ids, "held_out": apart, "n_tokens": n_tokens, "n_known": known, "train_tokens": np.full(n, int(tokens), np.int64), "base_score": base, "score": nats / np.log(10)})

    return run


def score_texts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.when(~F.col("held_out"), 1).otherwise(0)).alias("docs")).first()
    chars, train_docs = size["chars"] or 0, size["docs"] or 0
    batches = max(1, chars // BATCH_CHARS)
    bits = int(max(2, np.ceil(np.log2(max(1, chars / 80) / PER_BUCKET + 1)) + 1))
    kind = dict(docs.dtypes)["doc_id"]
    dealt = rows.withColumn("turn", F.xxhash64("doc_id", "text")).withColumn("batch", F.pmod("turn", F.lit(batches)))
    blobs = ", ".join(f"{c} binary" for c in OWN[:-1])
    asked = cut(dealt.groupBy("batch").applyInArrow(_asked(bits, path), f"batch long, bucket long, hashes binary, counts binary, {blobs}, doc_ids array<{kind}>"))
    own = asked.where("bucket is null").select("batch", *OWN)
    asking = asked.where("bucket is not null").select("batch", "bucket", "hashes", "counts")
    answers = cut(asking.groupBy("bucket").applyInArrow(_answered, "batch long, bucket long, totals binary, kinds long, tokens long"))
    whole = answers.agg(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens")).first()
    kinds, tokens = (whole["kinds"] or 0) + (train_docs > 0), (whole["tokens"] or 0) + train_docs
    sub = encoder(path)
    counts = np.zeros(sub.size)
    pairs = own.select("ids", "id_counts").mapInArrow(_id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for r in pairs.collect():  # at most one row for each subword of the vocabulary
        counts[r[0]] = r[1]
    counts[sub.end] = train_docs
    net = Attention(sub.size, classes_of(counts), counts)
    train(own, net, sub.end, batches)
    held = spark.sparkContext.broadcast((net, sub.end, train_docs, tokens, kinds))
    replies = answers.select("batch", "bucket", "totals")
    scored = own.drop("ids", "id_counts").groupBy("batch").cogroup(replies.groupBy("batch"))
    return scored.applyInArrow(_scored(held), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
