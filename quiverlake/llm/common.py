"""What several operators share: checkpoints in the shared folder, column handling, and
vectorised word hashing over Arrow string buffers.

Words are found and hashed with numpy on the UTF-8 bytes of a whole Arrow column, half a MB at
a time, so no Python object is made for a word or a text.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19


# ---------------------------------------------------------------- Spark helpers


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local session, as in tests, gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quiverlake-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


#: With it, Spark removes a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint() in the shared folder: what follows doesn't depend on executors that are lost.

    The shuffle files that led to it go, as the checkpoint stands for them.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for frames made under it
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def free(wanted: str, taken: list[str]) -> str:
    """wanted, with as many underscores after it as it takes to be none of the columns in taken."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def crc_mod(column: str, m: int):
    """crc32 of the id's decimal text, modulo m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(m))


# ---------------------------------------------------------------- words in Arrow buffers


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: White space: 0x20 and 0x09-0x0D.
BLANKS = _separators((0x20, 0x20), (0x09, 0x0D))
#: Everything in ASCII but digits and letters a-z; text is lower-cased first.
NOT_ALNUM = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_NGRAM = np.random.default_rng(20240607).integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The low bytes of a little-endian number that a piece of so many bytes fills.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column without copying; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


class Words(NamedTuple):
    """Words of documents lo..hi of a column; doc counts from lo, start and end are byte offsets."""

    lo: int
    hi: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of text as one number, little-endian; zeros follow the end."""
    held = np.zeros(len(text) + 8, np.uint8)
    held[: len(text)] = text
    return np.ndarray((len(text) + 1,), "<u8", held, strides=(1,))


def beginnings(at: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hash of the first k (8 at most) bytes from each of starts; at: eights() of the text."""
    return mix((at[starts] & _FILLED[k]) + _STEP * np.uint64(k + 1000))


def word_hashes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: its pieces of eight bytes are mixed with their places, then added up.

    A sum of mixed values, not a polynomial, so no two words are made to agree by their letters' order.
    """
    at = eights(text)
    total = mix((at[starts] & _FILLED[np.minimum(lengths, 8)]) + _STEP)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) >> 3
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        begin, left = np.repeat(starts[long], more) + 8 * place, np.repeat(lengths[long], more) - 8 * place
        piece = mix((at[begin] & _FILLED[np.minimum(left, 8)]) + _STEP * (place + 1).astype(np.uint64))
        total[long] += np.add.reduceat(piece, first)
    return mix(total + lengths.astype(np.uint64))


def words_of(column: pa.Array, blanks: np.ndarray = BLANKS, fold: bool = True, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of each text, half a MB of whole documents at a time; fold lower-cases A-Z.

    A longer document than chunk makes a chunk of its own.
    """
    at, data = buffers(column)
    table_ = (LOWER if fold else SAME)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + chunk, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        raw = data[at[lo] : at[hi]]
        yield _words(raw, at[lo : hi + 1] - at[lo], int(at[lo]), lo, hi, blanks, table_)
        lo = hi


def _words(raw: np.ndarray, at: np.ndarray, base: int, lo: int, hi: int, blanks: np.ndarray, fold: np.ndarray) -> Words:
    size = len(raw)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(lo, hi, none, none, none, np.zeros(0, np.uint64))
    text = fold[raw]
    inside = ~blanks[text]
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = at[:-1][at[:-1] < size]
    before[edge] = False  # a word ends where its document ends
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = at[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    lengths = ends - starts
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(lo, hi, none, none, none, np.zeros(0, np.uint64))
    hashed = word_hashes(text, starts, lengths)
    doc = np.searchsorted(at, starts, "right") - 1
    return Words(lo, hi, doc, starts + base, ends + base, hashed)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; n - 1 fewer than there are values."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += hashes[j : j + m] * _NGRAM[j]
    return mix(total)


def packed(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def unpacked(cells, kind: str) -> np.ndarray:
    """All numbers of a column of packed values, one cell after another."""
    return np.frombuffer(b"".join(c for c in cells if c is not None), kind)


def long_ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
