"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of lexicon words (a fixed list, and words and word beginnings learned
from labels), how many of them stand near a second-person word, capitals, punctuation and
obfuscation rates. The lexicon is learned on one part of the labelled sample, the trees on another, the
isotonic steps on a third, so that none is judged on what it was fitted to. At most TRAIN_ROWS labelled
rows are read, those first by a hash of doc_id; all documents are scored, whole.

A null or empty text has all features zero and gets the score of such a text. Null labels and labels of no document
are left out. Without labels of both kinds the fixed lexicon alone decides; with too few to calibrate the trees' own probability does. Each row of documents gives a row; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.llm.common import BLANKS, LOWER, NOT_ALNUM, SAME, beginnings, buffers, crc_mod, eights, free, need, packed, table
from quiverlake.llm.quality import NOT_PUNCTUATION, sample
from quiverlake.llm.common import _words as split_words

TRAIN_ROWS = 24_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Learned lexicon: entries in at least SUPPORT toxic texts, of whose texts PURITY or more are toxic.
LEXICON, SUPPORT, PURITY = 4000, 3, 0.85
#: Rows of each label that the isotonic steps need; with fewer the trees' own probability stands.
LEAST = 5
PREFIXES = (4, 5, 6)
NEAR = 5
CHUNK = 1 << 19

# fixed values: a starting lexicon of insults
INSULTS = """idiot idiots moron morons stupid loser losers trash scum clown pathetic worthless disgusting dumb fool imbecile garbage vermin
idiota imbécil estúpido basura crétin abruti connard ordure dummkopf trottel abschaum vollidiot""".split()
# fixed values: words for the one spoken to
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta vous votre tú ti usted ustedes vos su".split()
# fixed values: signs that stand for letters
DISGUISES = str.maketrans("013457@$!|*+", "oieastasil t")

NAMES = ["seed", "seed_any", "learned", "learned_any", "prefix", "prefix_any", "near_second", "second", "capitals", "shouting", "exclaim", "punct", "runs", "mixed", "disguised", "log_words"]


def _hash_of(words: list[str]) -> np.ndarray:
    column = pa.array([w for w in words], pa.string())
    at, data = buffers(column)
    found = split_words(data[at[0] : at[-1]], at - at[0], 0, 0, len(words), NOT_ALNUM, LOWER)
    return np.unique(found.hash)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _beginnings(at: np.ndarray, w, k: int) -> np.ndarray:
    """Hash of the first k bytes of each word, 0 for shorter ones; at: eights() of the text."""
    out = np.zeros(len(w.start), np.uint64)
    long = np.flatnonzero(w.end - w.start >= k)
    out[long] = beginnings(at, w.start[long], k) | np.uint64(1)
    return out


def _chunks(column: pa.Array):
    at, data = buffers(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = min(max(int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1, lo + 1), n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def stems(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Index and distinct hashes of words and their beginnings of each text."""
    for lo, hi, raw, own in _chunks(column):
        w = split_words(raw, own, 0, lo, hi, NOT_ALNUM, LOWER)
        if not len(w.doc):
            continue
        at = eights(LOWER[raw])
        kinds = [w.hash, *(_beginnings(at, w, k) for k in PREFIXES)]
        cut = np.searchsorted(w.doc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            found = np.unique(np.concatenate([x[cut[i] : cut[i + 1]] for x in kinds]))
            yield lo + i, found[found != 0]


def dense(column: pa.Array, lexicon: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of NAMES for each text; lexicon: hashes of fixed words, learned words, beginnings."""
    seeds, learned, begins = lexicon
    spoken_to = _hash_of(SECOND_PERSON)
    insults = set(INSULTS)
    out = np.zeros((len(column), len(NAMES)))
    for lo, hi, raw, own in _chunks(column):
        n = hi - lo
        w = split_words(raw, own, 0, lo, hi, NOT_ALNUM, LOWER)
        if not len(w.doc):
            continue
        text = LOWER[raw]
        each = lambda doc, v=None: np.bincount(doc, v, minlength=n)  # noqa: E731, B023
        words = np.maximum(each(w.doc), 1)
        seed, known = _member(w.hash, seeds), _member(w.hash, learned)
        begin = np.zeros(len(w.doc), bool)
        if len(begins):
            at = eights(text)
            for k in PREFIXES:
                begin |= _member(_beginnings(at, w, k), begins)
        bad, second = seed | known | begin, _member(w.hash, spoken_to)
        near = np.zeros(len(w.doc), bool)
        for j in range(1, NEAR + 1):
            same = w.doc[j:] == w.doc[:-j]
            near[j:] |= same & second[:-j]
            near[:-j] |= same & second[j:]
        capital, letter = (raw >= 65) & (raw <= 90), (text >= 97) & (text <= 122) | (raw >= 128)
        bytes_ = np.maximum(np.diff(own), 1)
        some = np.flatnonzero(np.diff(own) > 0)  # reduceat needs pieces that aren't empty

        def total(mask: np.ndarray) -> np.ndarray:
            got = np.zeros(n)  # noqa: B023
            got[some] = np.add.reduceat(mask.astype(np.int32), own[:-1][some])  # noqa: B023
            return got

        tokens = split_words(raw, own, 0, lo, hi, BLANKS, SAME)
        caps_before = np.append(0, np.cumsum(capital))
        letters_before = np.append(0, np.cumsum(letter))
        token_caps = caps_before[tokens.end] - caps_before[tokens.start]
        token_letters = letters_before[tokens.end] - letters_before[tokens.start]
        token_len = tokens.end - tokens.start
        shout = (token_caps >= 3) & (token_caps * 2 > token_len)
        core = (token_letters > 0) & letter[tokens.start] & letter[tokens.end - 1]
        odd = core & (token_letters < token_len)
        disguised = np.zeros(n)
        for i in np.flatnonzero(odd & (token_len <= 24)).tolist():
            plain = raw[tokens.start[i] : tokens.end[i]].tobytes().decode("utf-8", "ignore").lower()
            if plain.translate(DISGUISES).replace(" ", "") in insults or "".join(c for c in plain if c.isalpha()) in insults:
                disguised[tokens.doc[i]] += 1
        marks = split_words(raw, own, 0, lo, hi, NOT_PUNCTUATION, SAME)
        long_marks = marks.end - marks.start >= 2
        columns = [
            each(w.doc, seed) / words, np.minimum(each(w.doc, seed), 5), each(w.doc, known) / words, np.minimum(each(w.doc, known), 5),
            each(w.doc, begin) / words, np.minimum(each(w.doc, begin), 5), np.minimum(each(w.doc, bad & near), 5), each(w.doc, second) / words,
            total(capital) / bytes_, each(tokens.doc, shout) / words, total(raw == 33) / bytes_, each(marks.doc) / words, each(marks.doc, long_marks) / words,
            each(tokens.doc, odd) / words, np.minimum(disguised, 5), np.log1p(each(w.doc)),
        ]
        out[lo:hi] = np.stack(columns, 1)
    return out


# ---------------------------------------------------------------- trees


class Boosted:
    """Histogram gradient boosting for the logistic loss; trees of fixed depth in arrays."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, lam: float = 1.0, leaf: float = 8.0):
        self.rounds, self.depth, self.rate, self.bins, self.lam, self.leaf = rounds, depth, rate, bins, lam, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        coded = np.stack([np.searchsorted(self.edges[j], x[:, j], "left") for j in range(f)], 1)
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        margin, self.trees = np.full(n, self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, split = np.full(2**self.depth, -1), np.zeros(2**self.depth, np.int64)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    own = np.flatnonzero(node == k - 2**level)
                    best = self._best(coded[own], g[own], h[own]) if len(own) >= 2 * self.leaf else None
                    if best:
                        feature[k], split[k] = best
                right = np.zeros(n, np.int64)
                for k in range(2**level, 2 ** (level + 1)):
                    if feature[k] >= 0:
                        own = node == k - 2**level
                        right[own] = coded[own, feature[k]] > split[k]
                node = 2 * node + right
            size = 2**self.depth
            value = -self.rate * np.bincount(node, g, minlength=size) / (np.bincount(node, h, minlength=size) + self.lam)
            margin += value[node]
            self.trees.append((feature, split, value))
        return self

    def _best(self, coded: np.ndarray, g: np.ndarray, h: np.ndarray):
        top, best, whole_g, whole_h = 1e-3, None, g.sum(), h.sum()
        for j in range(coded.shape[1]):
            if not len(self.edges[j]):
                continue
            m = len(self.edges[j]) + 1
            a, b = np.cumsum(np.bincount(coded[:, j], g, minlength=m))[:-1], np.cumsum(np.bincount(coded[:, j], h, minlength=m))[:-1]
            c = np.cumsum(np.bincount(coded[:, j], minlength=m))[:-1]
            gain = a * a / (b + self.lam) + (whole_g - a) ** 2 / (whole_h - b + self.lam) - whole_g**2 / (whole_h + self.lam)
            gain[(c < self.leaf) | (len(g) - c < self.leaf)] = 0
            k = int(gain.argmax())
            if gain[k] > top:
                top, best = gain[k], (j, k)
        return best

    def margin(self, x: np.ndarray) -> np.ndarray:
        coded = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, split, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = 2**level + node
                f = feature[k]
                node = 2 * node + ((f >= 0) & (coded[rows, np.maximum(f, 0)] > split[k]))
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) of the pool-adjacent-violators fit, smoothed by one pseudo-row each way."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[2] / b[1] for b in blocks])
    p = np.array([(b[0] + 0.5 * (b[0] / b[1])) / (b[1] + 0.5) for b in blocks])
    return at, np.clip(p, 0.001, 0.999)


class Model:
    def __init__(self, lexicon, trees: Boosted | None, knots):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, column: pa.Array) -> np.ndarray:
        x = dense(column, self.lexicon)
        if self.trees is None:
            return np.where(x[:, 1] + x[:, NAMES.index("disguised")] > 0, 0.9, 0.1)
        m = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-m))
        if self.knots is None:
            return raw
        # a hundredth of the raw probability keeps the order within a step
        return 0.99 * np.interp(m, *self.knots) + 0.01 * raw


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column("y").to_numpy()
        got = list(stems(batch.column("text")))
        if got:
            all_, lab = np.concatenate([s for _, s in got]), np.repeat(y[[i for i, _ in got]], [len(s) for _, s in got])
            values, inverse = np.unique(all_, return_inverse=True)
            pos = np.bincount(inverse, lab, minlength=len(values)).astype(np.int64)
            count = np.bincount(inverse, minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"stem": values.view(np.int64), "pos": pos, "cnt": count})


def _dense_rows(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column("text"), held.value)
            yield pa.RecordBatch.from_pydict({"turn": batch.column("turn"), "part": batch.column("part"), "y": batch.column("y"), "x": pa.array([packed(r, "<f8") for r in x], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """What the driver gets: at most LEXICON stems and limit rows of len(NAMES) numbers."""
    spark = docs.sparkSession
    rows = sample(docs, labels, "toxic", crc_mod("doc_id", FOLDS) != HELD_OUT, limit).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(5)).cast("int"))
    found = rows.where("part < 2").dropDuplicates(["text"]).select("y", "text").mapInArrow(_stem_rows, "stem long, pos long, cnt long")
    best = found.groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("cnt").alias("cnt")).where((F.col("pos") >= SUPPORT) & (F.col("pos") >= PURITY * F.col("cnt"))).orderBy(F.desc("pos"), "stem").limit(LEXICON)
    learned = np.unique(np.array([r[0] for r in best.select("stem").collect()], np.int64).view(np.uint64))
    lexicon = (_hash_of(INSULTS), learned, learned)
    held = spark.sparkContext.broadcast(lexicon)
    got = rows.where("part >= 2").select("turn", "part", "y", "text").mapInArrow(_dense_rows(held), "turn long, part int, y int, x binary").collect()
    got.sort(key=lambda r: (r["turn"], r["y"], r["x"]))
    y = np.array([r["y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, None)
    x = np.stack([np.frombuffer(r["x"], "<f8") for r in got])
    part = np.array([r["part"] for r in got])
    fit, calibrate = part < 4, part == 4
    if y[fit].min() == y[fit].max():
        return Model(lexicon, None, None)
    trees = Boosted().fit(x[fit], y[fit])
    if y[calibrate].sum() < LEAST or (1 - y[calibrate]).sum() < LEAST:
        return Model(lexicon, trees, None)
    return Model(lexicon, trees, isotonic(trees.margin(x[calibrate]), y[calibrate]))


def _scored(held, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = held.value.score(batch.column("text")) if batch.num_rows else np.zeros(0)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score, pa.float64())], names=[*names, name])

    return run


def toxicity(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep and last toxicity, the calibrated probability; with underscores if a kept column has that name."""
    need(docs, "text", *keep)
    held = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*[c for c in keep if c != "text"], "text")
    name = free("toxicity", chosen.columns)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in chosen.schema if f.name != "text"), T.StructField(name, T.DoubleType())])
    return chosen.mapInArrow(_scored(held, name), schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    score = F.col("toxicity")
    return found.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
