"""Which values of an item another item has as well: a packed, hash-bucketed count.

Items are documents or classes of them; values are 64-bit hashes. Every map task sends, for each
bucket of the hash space, one binary row with its items and 32 bits of each of their values that
fall there. A bucket's task sorts them once and finds the values that occur under two labels or
more. No pair of items is made, so one value in a third of all items costs a third of a sort.
Two values agree by chance with about 1e-3 for each; callers use the counts as an upper bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quiverlake.llm.common import mix, packed, unpacked

BLOBS = "bucket int, items binary, labels binary, sizes binary, vals binary, places binary"
BLOBS_ARROW = pa.schema([("bucket", pa.int32()), ("items", pa.binary()), ("labels", pa.binary()), ("sizes", pa.binary()), ("vals", pa.binary()), ("places", pa.binary())])
#: Values that a bucket holds on average; their number grows with the data.
PER_BUCKET = 1_500_000


def bits_for(total: int) -> int:
    """Buckets as a power of two, so that each holds about PER_BUCKET values."""
    return int(min(20, max(3, np.ceil(np.log2(max(total, 1) / PER_BUCKET + 1)) + 1)))


def blobs(items: np.ndarray, labels: np.ndarray | None, values: np.ndarray, places: np.ndarray | None, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of BLOBS for values[i] of items[i] (int64), those of an item standing together.

    labels: whom an item belongs to (the item itself where None). places: uint32 to carry along.
    """
    if not len(values):
        return
    bucket = (values >> np.uint64(64 - bits)).astype(np.uint32 if bits > 16 else np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket, items = bucket[order].astype(np.int64), items[order]
    short = ((values[order] << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    places = places[order] if places is not None else None
    labels = labels[order] if labels is not None else None
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (bucket[1:] != bucket[:-1])
    runs = np.flatnonzero(new)
    sizes = np.diff(np.append(runs, len(items)))
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(cut[1:], len(items))
    out: dict[str, list] = {n: [] for n in BLOBS_ARROW.names}
    for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
        r0, r1 = np.searchsorted(runs, [a, b])
        own = runs[r0:r1]
        out["bucket"].append(int(bucket[a]))
        out["items"].append(packed(items[own], "<i8"))
        out["labels"].append(packed(labels[own], "<i8") if labels is not None else None)
        out["sizes"].append(packed(sizes[r0:r1], "<u4"))
        out["vals"].append(packed(short[a:b], "<u4"))
        out["places"].append(packed(places[a:b], "<u4") if places is not None else None)
    yield pa.RecordBatch.from_pydict(out, schema=BLOBS_ARROW)


def direct(items: np.ndarray, places: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of BLOBS for values that are known to be shared: their buckets are -1 - part, and passed_on() takes them."""
    order = np.argsort(items, kind="stable")
    items, places = items[order], places[order]
    first = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
    back = sent_back(items[first], np.diff(np.append(first, len(items))), places, bits)
    none = pa.nulls(back.num_rows, pa.binary())
    yield from pa.table([pa.array(-1 - back.column("part").to_numpy(), pa.int32()), back.column("items"), none, back.column("counts"), none, back.column("places")], schema=BLOBS_ARROW).to_batches()


def passed_on(rows: pa.Table) -> pa.Table:
    """Rows of BACK for those of direct()."""
    part = pa.array(-1 - rows.column("bucket").to_numpy().astype(np.int64))
    return pa.table({"part": part, "items": rows.column("items"), "counts": rows.column("sizes"), "places": rows.column("places")})


def shared(table: pa.Table, once: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's rows: items and sizes of its runs, which values two labels have, and places.

    once: a run that comes again for the same item (from another task) is left out.
    """
    cells = {n: table.column(n).to_pylist() for n in ("items", "labels", "sizes", "vals", "places")}
    items, sizes = unpacked(cells["items"], "<i8"), unpacked(cells["sizes"], "<u4").astype(np.int64)
    vals, places = unpacked(cells["vals"], "<u4"), unpacked(cells["places"], "<u4")
    labels = unpacked(cells["labels"], "<i8") if cells["labels"][0] is not None else items
    first = np.unique(items, return_index=True)[1] if once else items
    if len(first) < len(items):
        keep = np.zeros(len(items), bool)
        keep[first] = True
        each = np.repeat(keep, sizes)
        vals, places = vals[each], places[each] if len(places) else places
        items, labels, sizes = items[keep], labels[keep], sizes[keep]
    order = np.argsort(vals, kind="stable")
    ranked = vals[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    whose = np.repeat(labels, sizes)[order]
    twice = np.minimum.reduceat(whose, start) != np.maximum.reduceat(whose, start)
    flags = np.empty(len(vals), bool)
    flags[order] = np.repeat(twice, np.diff(np.append(start, len(vals))))
    return items, sizes, flags, places


#: What buckets send back: for each group of items one row, so rows don't grow with buckets times items.
BACK = "part long, items binary, counts binary, places binary"


def sent_back(items: np.ndarray, counts: np.ndarray, places: np.ndarray | None, bits: int) -> pa.Table:
    """Rows of BACK for items (int64) with counts, and counts[i] places (uint32) of each."""
    part = (mix(items.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, items = part[order], items[order]
    if places is not None:
        first = (np.cumsum(counts) - counts)[order]
        size = counts[order]
        places = places[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first, size)]
    counts = counts[order]
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(part)) if len(part) else edge
    total = np.append(0, np.cumsum(counts))
    rows = list(zip(edge.tolist(), ends.tolist(), strict=True))
    return pa.table({
        "part": pa.array(part[edge], pa.int64()), "items": pa.array([packed(items[a:b], "<i8") for a, b in rows], pa.binary()), "counts": pa.array([packed(counts[a:b], "<u4") for a, b in rows], pa.binary()),
        "places": pa.array([packed(places[total[a] : total[b]], "<u4") if places is not None else None for a, b in rows], pa.binary()),
    })


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one part: items, their counts, and the places of all in order of the items with their owners' indexes."""
    items, counts = unpacked(table.column("items").to_pylist(), "<i8"), unpacked(table.column("counts").to_pylist(), "<u4").astype(np.int64)
    places = unpacked(table.column("places").to_pylist(), "<u4")
    distinct, which = np.unique(items, return_inverse=True)
    owner = np.repeat(which, counts) if len(places) else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return distinct, np.bincount(which, counts, minlength=len(distinct)).astype(np.int64), places[order] if len(places) else places, owner[order]
