"""N-gram Jaccard join by a token-group matrix.

Documents are sets of five-word shingles (64-bit hashes); two link when their Jaccard similarity
is 0.75 or more; a component is what links reach. The steps, each exact or an upper bound:

1. Classes: documents with equal sets become one class (its 64-bit digest).
2. Alive classes: a class links with another only if three quarters of its shingles occur in
   another class (sharing.py). Most documents end here; their sets are never shuffled.
3. Groups: alive classes are put together by the smallest shingle under a permutation and join
   the first leader there that they link with; the leaders go through further permutations.
   Each class then has a group, linked through leaders. Hot groups are salted in the first round.
   Classes of which too few shingles occur in other groups are done.
4. Families: leaders go through the same turns with a lower similarity, so that groups of near
   copies that don't link, as after several turns of edits, still come together.
5. Token-group matrix: each family's union of shingles. The overlap of a class with another
   family's union bounds its overlap with any member. The matrix is joined on the rarest
   shingles that could still allow a link, from the smaller family to the larger only; overlaps
   with those unions are counted, and only families that reach three quarters are opened, besides
   a class's own.
6. Opening: members of a family go to tasks as pairs of blocks; overlaps of two blocks are one
   product of 0-1 matrices, and a task sends back a spanning forest of the groups that link there.
7. Components of groups over these links, by label propagation with pointer jumping.

Nulls and empty texts have no shingles: n_shingles 0, their own component. A null doc_id is kept
as a row with a null component_id and links nothing. Rows with a repeated doc_id each get a row. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm import sharing
from quiverlake.llm.common import cut, long_ids, mix, need, ngrams, words_of
from quiverlake.llm.components import components

WIDTH = 5
SHARE = (3, 4)  # a similarity of 0.75
ALIKE = (1, 2)  # the similarity within families; it decides on cost, not on results
ROUNDS = 4
ALIKE_ROUNDS = 3
SALTS = 32
BLOCK = 512
CARRIED = 16
MEMBERS = 1024
COLUMNS = 4096


def least(n):
    """The smallest overlap that a set of n values needs to link with anything."""
    return (SHARE[0] * n + SHARE[1] - 1) // SHARE[1]


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """Index and sorted distinct shingle hashes of each text that has words."""
    for w in words_of(column):
        if not len(w.doc):
            continue
        grams = ngrams(w.hash, width)
        counts = np.bincount(w.doc, minlength=w.hi - w.lo)
        first = np.cumsum(counts) - counts
        for i in np.flatnonzero(counts).tolist():
            n, a = int(counts[i]), int(first[i])
            if n >= width:
                found = np.sort(grams[a : a + n - width + 1])
                yield w.lo + i, found[np.append(True, found[1:] != found[:-1])]
            else:
                whole = np.array([n], np.uint64)
                for h in w.hash[a : a + n]:
                    whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h)
                yield w.lo + i, whole


def class_of(values: np.ndarray) -> int:
    return int.from_bytes(blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for i, values in shingle_sets(batch.column("text")):
            n[i], cls[i] = len(values), class_of(values)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(n), pa.array(cls)], names=["doc_id", "text_hash", "n_shingles", "cls"])


def _spread(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = ~np.asarray(batch.column("doc_id").is_null())
            seen: set[int] = set()
            items, sets, held = [], [], 0
            for i, values in shingle_sets(batch.column("text")):
                if not known[i] or (c := class_of(values)) in seen:
                    continue
                seen.add(c)
                items.append(c)
                sets.append(values)
                held += len(values)
                if held >= 1_000_000:
                    yield from _blobs(items, sets, None, bits)
                    items, sets, held = [], [], 0
            yield from _blobs(items, sets, None, bits)

    return run


def _blobs(items: list[int], sets: list[np.ndarray], labels: list[int] | None, bits: int) -> Iterator[pa.RecordBatch]:
    if items:
        sizes = [len(x) for x in sets]
        yield from sharing.blobs(np.repeat(np.array(items, np.int64), sizes), None if labels is None else np.repeat(np.array(labels, np.int64), sizes), np.concatenate(sets), None, bits)


def _potential(bits: int):
    def run(rows: pa.Table) -> pa.Table:
        items, sizes, flags, _ = sharing.shared(rows)
        p = np.diff(np.append(0, np.cumsum(flags)[np.cumsum(sizes) - 1]))
        keep = p > 0
        return sharing.sent_back(items[keep], p[keep], None, bits)

    return run


def _totals(rows: pa.Table) -> pa.Table:
    items, p, _, _ = sharing.gathered(rows)
    return pa.table({"cls": items, "p": p})


def _kept_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets and keys of the rows whose class is the wanted one."""
    seeds = [np.uint64(0x51ED270B * (r + 1)) for r in range(ROUNDS)]
    for batch in batches:
        wanted = long_ids(batch.column("cls"))
        cls, n, sets, keys = [], [], [], []
        for i, values in shingle_sets(batch.column("text")):
            if class_of(values) == wanted[i]:
                cls.append(int(wanted[i]))
                n.append(len(values))
                sets.append(values.view(np.int64))
                keys.append([int(mix(values ^ s).min().view(np.int64)) for s in seeds])
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["cls", "n", "vals", "keys"])


def _linked(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = SHARE) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if share[1] * len(small) < share[0] * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return share[1] * both >= share[0] * (len(a) + len(b) - both)


def _leaders(table: pa.Table, share: tuple[int, int]) -> pa.Table:
    """For each class of a group its leader: the first class before it, in order, that is as similar as share.

    Classes whose shingles most others of the group have come first: what copies were made from so
    leads them, though they don't link with each other. Leaders of one block at a time are held,
    with those of earlier blocks that most follow.
    """
    cls = table.column("cls").to_numpy()
    lists = table.column("vals").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    _, which, often = np.unique(flat[at[0] : at[-1]], return_inverse=True, return_counts=True)
    central = np.add.reduceat(often[which], at[:-1] - at[0]) / np.diff(at)
    order = np.lexsort((cls, -central))
    heads: list[list] = []
    led = np.empty(len(cls), np.int64)
    for k, i in enumerate(order.tolist()):
        if k % BLOCK == 0:
            heads = sorted(heads, key=lambda x: -x[2])[:CARRIED]
        values = flat[at[i] : at[i + 1]].view(np.uint64)
        for head in heads:
            if _linked(values, head[1], share):
                led[i] = head[0]
                head[2] += 1
                break
        else:
            led[i] = cls[i]
            heads.append([int(cls[i]), values, 0])
    return pa.table({"cls": cls, "leader": led})


def _grouped(table: pa.Table) -> pa.Table:
    return _leaders(table, SHARE)


def _alike(table: pa.Table) -> pa.Table:
    return _leaders(table, ALIKE)


def _led(active: DataFrame, r: int, find) -> DataFrame:
    """cls, leader of one turn over active (cls, vals, keys); the first turn is salted."""
    key = [F.element_at("keys", r + 1), F.pmod(F.xxhash64("cls"), F.lit(SALTS if r == 0 else 1))]
    return cut(active.select("cls", "vals", key[0].alias("key"), key[1].alias("salt")).groupBy("key", "salt").applyInArrow(find, "cls long, leader long"))


class _Sets:
    """Rows of a task: groups, and sets as positions in one flat array."""

    def __init__(self, rows: pa.Table) -> None:
        lists = rows.column("vals").combine_chunks()
        self.at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        self.flat = flat[self.at[0] : self.at[-1]]
        self.at = self.at - self.at[0]
        self.n = np.diff(self.at)
        self.grp = long_ids(rows.column("grp"))

    def ones(self, columns: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The 0-1 matrix of sets lo..hi over the sorted columns."""
        values = self.flat[self.at[lo] : self.at[hi]]
        place = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
        there = columns[place] == values
        out = np.zeros((hi - lo, len(columns)), np.float32)
        out[np.repeat(np.arange(hi - lo), self.n[lo:hi])[there], place[there]] = 1
        return out


def _compared(rows: pa.Table) -> pa.Table:
    """Links between the rows of side 0 and those of side 1, or among side 0 if there are no others.

    Whole overlaps are counted, MEMBERS times MEMBERS rows and COLUMNS shingles at a time (float32
    counts are exact below 2 ** 24). Groups that link are given as edges to the first group they reach.
    """
    side = rows.column("side").to_numpy()
    left = _Sets(rows.filter(pa.array(side == 0)))
    right = _Sets(rows.filter(pa.array(side == 1))) if (side == 1).any() else left
    common = np.intersect1d(left.flat, right.flat)
    if right is left:
        value, often = np.unique(left.flat, return_counts=True)
        common = value[often > 1]
    groups, node = np.unique(np.concatenate([left.grp, right.grp]), return_inverse=True)
    node_left, node_right = node[: len(left.grp)], node[len(left.grp) :]
    label = np.arange(len(groups))
    for a in range(0, len(left.n), MEMBERS):
        a2 = min(a + MEMBERS, len(left.n))
        for b in range(a if right is left else 0, len(right.n), MEMBERS):
            b2 = min(b + MEMBERS, len(right.n))
            both = np.zeros((a2 - a, b2 - b), np.float32)
            for c in range(0, len(common), COLUMNS):
                columns = common[c : c + COLUMNS]
                both += left.ones(columns, a, a2) @ right.ones(columns, b, b2).T
            both = both.astype(np.int64)
            x, y = np.nonzero(SHARE[1] * both >= SHARE[0] * (left.n[a:a2, None] + right.n[None, b:b2] - both))
            x, y = node_left[a:a2][x], node_right[b:b2][y]
            x, y = label[x], label[y]
            while (apart := x != y).any():  # every label is a root here; roots hook to lower ones, so earlier tiles' links stay
                x, y = x[apart], y[apart]
                low = np.minimum(x, y)
                np.minimum.at(label, x, low)
                np.minimum.at(label, y, low)
                while (label[label] != label).any():
                    label = label[label]
                x, y = label[x], label[y]
    moved = np.flatnonzero(label != np.arange(len(groups)))
    return pa.table({"a": groups[moved], "b": groups[label[moved]]})


def _spread_groups(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, group, lists = long_ids(batch.column("cls")).tolist(), long_ids(batch.column("grp")).tolist(), batch.column("vals")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            items, labels, sets, held = [], [], [], 0
            for i in range(len(cls)):
                items.append(cls[i])
                labels.append(group[i])
                sets.append(flat[at[i] : at[i + 1]].view(np.uint64))
                held += len(sets[-1])
                if held >= 1_000_000:
                    yield from _blobs(items, sets, labels, bits)
                    items, labels, sets, held = [], [], [], 0
            yield from _blobs(items, sets, labels, bits)

    return run


def _promising(blobs: DataFrame, sized: DataFrame, bits: int) -> DataFrame:
    """Classes of sized (cls, n, ...) of which enough values occur under another label."""
    p = blobs.groupBy("bucket").applyInArrow(_potential(bits), sharing.BACK).groupBy("part").applyInArrow(_totals, "cls long, p long")
    return sized.join(p, "cls").where(SHARE[1] * F.col("p") >= SHARE[0] * F.col("n")).drop("p")


def _links(member: DataFrame) -> DataFrame:
    """Links (a, b) between groups of member (cls, grp, family, n, vals), by the token-group matrix."""
    spark = member.sparkSession
    opened = cut(_opened(member))
    sizes = member.groupBy("family").agg(F.count("*").alias("members"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    asked = opened.groupBy(F.col("other").alias("family")).agg(F.count("*").alias("queries"))
    blocks = sizes.join(asked, "family", "left").select(
        "family",
        (F.col("lo") < F.col("hi")).alias("several"),
        F.ceil(F.col("members") / MEMBERS).alias("blocks"),
        F.ceil(F.coalesce("queries", F.lit(0)) / MEMBERS).alias("parts"),
    )
    blocks = cut(blocks.where("several or parts > 0"))
    # part 0 has the pairs of blocks of a family; parts from 1 have one block and queries of other families
    none = "cast(array() as array<struct<i:bigint,j:bigint,part:bigint,side:bigint>>)"
    own = f"if(several, transform(sequence(0L, blocks - 1), x -> struct(least(b, x) as i, greatest(b, x) as j, 0L as part, if(b > x, 1L, 0L) as side)), {none})"
    for_others = f"if(parts > 0, transform(sequence(1L, greatest(parts, 1L)), x -> struct(b as i, b as j, x as part, 0L as side)), {none})"
    members = member.join(blocks, "family").withColumn("b", F.expr("pmod(xxhash64(cls), blocks)")).select("family", "grp", "vals", F.explode(F.expr(f"concat({own}, {for_others})")).alias("at"))
    queries = opened.withColumnRenamed("other", "family").join(member.select("cls", "grp", "vals"), "cls").join(blocks, "family")
    queries = queries.select("family", "grp", "vals", F.explode(F.expr("transform(sequence(0L, blocks - 1), x -> struct(x as i, x as j, 1 + pmod(xxhash64(cls), parts) as part, 1L as side))")).alias("at"))
    tasks = members.unionByName(queries).select("family", "grp", "vals", "at.i", "at.j", "at.part", "at.side")
    return tasks.groupBy("family", "i", "j", "part").applyInArrow(_compared, "a long, b long")


def _opened(member: DataFrame) -> DataFrame:
    """cls, other: families larger than its own whose union of shingles has enough of a class's.

    A link between two families shows from either of them, so only classes of the smaller one (of
    the lower id, among equals) ask: a large family's classes aren't held against each small one.
    """
    token = member.select("cls", "family", "n", F.explode("vals").alias("v"))
    held = token.select("v", "family").distinct().groupBy("v").agg(F.count("*").alias("families")).where("families > 1")
    ranked = token.join(held, "v").groupBy("cls", "family", "n").agg(F.array_sort(F.collect_list(F.struct("families", "v"))).alias("ranked"))
    # a link needs `least` of the n values, so in any fixed order both sides have one of their first
    # n - least + 1 in common; values of one family come first and can't be it, so they only take places
    places = F.size("ranked") - F.expr(f"int(({SHARE[0]} * n + {SHARE[1] - 1}) div {SHARE[1]})") + 1
    first = ranked.where(places > 0).select("cls", "family", F.explode(F.slice("ranked", F.lit(1), places)).alias("x")).select("cls", "family", F.col("x.v").alias("v"))
    sizes = member.groupBy("family").agg(F.count("*").alias("members"))
    first = cut(first.join(sizes, "family").select("cls", "v", F.struct("members", "family").alias("own")))
    del ranked
    some = first.select("v", F.col("own").alias("to")).distinct()
    near = cut(first.join(some, "v").where("own < to").select("cls", F.col("to.family").alias("other")).distinct())
    del some, first
    union = token.select("v", F.col("family").alias("other")).join(near.select("other").distinct(), "other", "left_semi").distinct()
    mine = token.join(near.select("cls").distinct(), "cls", "left_semi").select("cls", "n", "v")
    bound = mine.join(near, "cls").join(union, ["v", "other"]).groupBy("cls", "n", "other").agg(F.count("*").alias("both"))
    return bound.where(SHARE[1] * F.col("both") >= SHARE[0] * F.col("n")).select("cls", "other")


def labelled(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_hash, n_shingles, grp, which is null without shingles or doc_id."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = cut(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sizes, "doc_id long, text_hash long, n_shingles long, cls long"))
    total = sized.agg(F.sum("n_shingles")).first()[0] or 0
    bits = sharing.bits_for(total)
    classes = sized.where("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    alive = _promising(docs.mapInArrow(_spread(bits), sharing.BLOBS), classes, bits)
    alive = cut(alive.select("cls", "doc_id"))
    sets = cut(docs.join(alive, "doc_id").select("cls", "text").mapInArrow(_kept_sets, "cls long, n long, vals array<long>, keys array<long>").dropDuplicates(["cls"]))

    group, active = sets.select("cls", F.col("cls").alias("grp")), sets
    for r in range(ROUNDS):
        led = _led(active, r, _grouped)
        group = cut(group.join(led.withColumnRenamed("cls", "grp"), "grp").select("cls", F.col("leader").alias("grp")))
        active = active.join(led.where("cls = leader").select("cls"), "cls", "left_semi")
    family = active.select(F.col("cls").alias("grp"), F.col("cls").alias("family"))
    for r in range(ALIKE_ROUNDS):
        led = _led(active, r, _alike)
        family = cut(family.join(led.withColumnRenamed("cls", "family"), "family").select("grp", F.col("leader").alias("family")))
        active = active.join(led.where("cls = leader").select("cls"), "cls", "left_semi")

    member = sets.select("cls", "n", "vals").join(group, "cls").join(family, "grp")
    while True:  # a link is between two classes that stay, so what only others share stops counting
        held = member.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
        bits = sharing.bits_for(held["n"] or 0)
        member = cut(_promising(member.select("cls", "grp", "vals").mapInArrow(_spread_groups(bits), sharing.BLOBS), member, bits))
        left = member.count()
        if left >= 0.9 * held["rows"]:
            break
    links = cut(_links(member))
    root = components(links)
    if root is not None:
        group = group.join(root.withColumnRenamed("node", "grp"), "grp", "left").select("cls", F.coalesce("root", "grp").alias("grp"))
    group = cut(group)
    return sized.join(group, "cls", "left").select("doc_id", "text_hash", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("grp", "cls")).alias("grp"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    whole = labelled(docs)
    smallest = whole.where("grp is not null").groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    return whole.join(smallest, "grp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from quiverlake.llm.common import table

    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(m.m, d.doc_id), d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id
"""
