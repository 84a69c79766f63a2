"""N-gram Jaccard join: count-vector R-trees inside the blocks of an exact prefix filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, arrow_schema, column, map_batches, read, released, small_batches, utf8
from lectern.operators.graph import connected_components

#: Words of a shingle; two sets link when PERCENT * union <= 100 * intersection.
WORDS, PERCENT = 5, 80
#: Groups that shingles are hashed to; a document's counts in them are its point.
GROUPS = 128
#: Shingles that more documents than this are seen to hold come last in the order of prefixes;
#: at most so many of them, the commonest. It sets the order only; results don't depend on it.
COMMON, COMMON_ROWS = 32, 2_000_000
#: Shingles that a task counts before it sends those met twice.
COUNTED = 3_000_000
#: Points of a leaf and boxes of a box; boxes compared at once; blocks from HUB_FROM classes
#: meet a hub first, those beyond a leaf then meet their nearest in so many rounds.
FANOUT, AT_ONCE, HUB_FROM, NEAREST_ROUNDS = 16, 1024, 8, 1
#: First shared prefix shingles that settle which block owns a pair; classes of a block that
#: are compared in one place (larger blocks are cut to tiles).
OWNERS, TILE = 4, 4096
#: Rows of an Arrow batch that a task gives out.
BATCH = 20_000
#: Pairs or ids of classes that a broadcast may hold; more are joined.
BROADCAST_IDS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles (its whole words, if fewer)."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in tokens], np.uint64)
    n = max(1, len(own) - size + 1)
    out = np.full(n, np.uint64(min(len(own), size)))
    for i in range(min(size, len(own))):
        out = (out ^ (out >> np.uint64(29))) * _MIX + own[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def set_id(own: np.ndarray) -> int:
    """64 bits that stand for a whole set; n sets collide with odds of n * n / 2 ** 65."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def point(own: np.ndarray) -> bytes:
    """Counts of shingles in each group, a byte each, after the power of two that scales them.

    Counts over 255 are scaled with rounding up, so minima still bound an overlap.
    """
    counts = np.bincount((own >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS)
    shift = max(0, int(counts.max(initial=0)).bit_length() - 8)
    counts = -(-counts >> shift) if shift else counts
    if counts.max(initial=0) > 255:
        shift += 1
        counts = -(-np.bincount((own >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS) >> shift)
    return bytes([shift]) + counts.astype(np.uint8).tobytes()


def counts_of(points: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(points), np.uint8).reshape(-1, GROUPS + 1)
    return raw[:, 1:].astype(np.int32) << raw[:, :1].astype(np.int32)


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in the order (common last, then by hash): linked sets share one."""
    size = len(own) - (-(-len(own) * PERCENT // 100)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        late = common[at] == own
        if late.any():
            own = np.concatenate((own[~late], own[late]))
    return own[:size]


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """The least overlap with which sets of a and b members link."""
    return -(-(np.asarray(a) + b) * PERCENT // (100 + PERCENT))


class CountTree:
    """An R-tree of count vectors; leaves hold FANOUT points, a box keeps its upper corner.

    The overlap of anything in one box with anything in another is at most the sum of their
    corners' coordinate minima, and what it needs is least for the smallest sets inside that
    may link at all. The tree is joined with itself, from pairs of boxes down to pairs of points.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        spread = points.var(axis=0).argsort()[::-1][:2]
        slab = np.argsort(sizes, kind="stable")
        order = np.concatenate([
            part[np.lexsort((points[part, spread[1]], points[part, spread[0]] // 4))]
            for part in np.array_split(slab, max(1, len(slab) // (FANOUT * FANOUT)))
        ])
        self.order = order
        level = [(points[order], sizes[order], sizes[order], labels[order])]
        while len(level) == 1 or len(level[-1][0]) > FANOUT:
            corner, low, high, label = level[-1]
            cut = np.arange(0, len(corner), FANOUT)
            same = np.minimum.reduceat(label, cut) == np.maximum.reduceat(label, cut)
            level.append((
                np.maximum.reduceat(corner, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut),
                np.where(same & (np.minimum.reduceat(label, cut) >= 0), label[cut], -1),
            ))
        self.levels = level

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points with two labels, each once, whose boxes' bounds allow a link."""
        held = [(len(self.levels) - 1, *np.triu_indices(len(self.levels[-1][0])))]
        while held:
            depth, i, j = held.pop()
            if len(i) > AT_ONCE:
                held += [(depth, i[k : k + AT_ONCE], j[k : k + AT_ONCE]) for k in range(0, len(i), AT_ONCE)]
                continue
            corner, low, high, label = self.levels[depth]
            keep = (label[i] != label[j]) | (label[i] < 0)
            keep &= (low[i] * PERCENT <= 100 * high[j]) & (low[j] * PERCENT <= 100 * high[i])
            i, j = i[keep], j[keep]
            a, b = np.maximum(low[i], -(-low[j] * PERCENT // 100)), np.maximum(low[j], -(-low[i] * PERCENT // 100))
            keep = overlap_bound(corner, i, j) >= needed(a, b)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            child = np.arange(FANOUT)
            x = np.repeat((i[:, None] * FANOUT + child), FANOUT, axis=1).ravel()
            y = np.tile((j[:, None] * FANOUT + child), FANOUT).ravel()
            below = len(self.levels[depth - 1][0])
            keep = (x < below) & (y < below) & ((x < y) if depth == 1 else (x <= y))
            if depth == 1:
                yield self.order[x[keep]], self.order[y[keep]]
            else:
                held.append((depth - 1, x[keep], y[keep]))


def overlap_bound(points: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima, for pairs of points by their numbers."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 14):
        out[s : s + (1 << 14)] = np.minimum(points[i[s : s + (1 << 14)]], points[j[s : s + (1 << 14)]]).sum(axis=1)
    return out


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, cls (null for empty sets) and point of every
    whole text, kind 0; and in further rows, kind 1, shingles that a task meets twice or more (s)
    and how often (c)."""
    schema = "kind int, doc_id long, h long, n_shingles long, cls long, point binary, s array<long>, c array<long>"
    fields = arrow_schema(docs.sparkSession, schema)

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        found, times = found[times > 1].view(np.int64), times[times > 1]
        cuts = range(0, max(1, len(found)), 1 << 16)
        none = [None] * len(cuts)
        return rows([1] * len(cuts), none, none, none, none, none, [found[i : i + (1 << 16)] for i in cuts], [times[i : i + (1 << 16)] for i in cuts])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            own = [shingles(t) for t in column(batch, "text")]
            none = [None] * len(own)
            ids = [set_id(x) if len(x) else None for x in own]
            yield rows([0] * len(own), column(batch, "doc_id"), column(batch, "h"), [len(x) for x in own], ids, [point(x) for x in own], none, none)
            held += own
            size += sum(map(len, own))
            if size >= COUNTED:
                yield counts(held)
                held, size = [], 0
        if held:
            yield counts(held)

    small_batches(docs.sparkSession)
    return _texts(docs).mapInArrow(released(run), schema)


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return rows.withColumn("h", F.xxhash64("text"))


def common_shingles(counted: DataFrame) -> np.ndarray:
    """Sorted hashes of the commonest shingles, counted over all documents.

    A shingle that no task meets twice isn't common. The table is bounded by COMMON_ROWS (16 MB).
    """
    each = counted.where("kind = 1").select(F.explode(F.arrays_zip("s", "c")).alias("x")).groupBy("x.s").agg(F.sum("x.c").alias("c"))
    top = each.where(F.col("c") > COMMON).orderBy(F.desc("c"), "s").limit(COMMON_ROWS)
    return np.sort(top.select("s").toPandas()["s"].to_numpy(np.int64).view(np.uint64))


def _blocks(docs: DataFrame, common: np.ndarray, classes: DataFrame) -> DataFrame:
    """key, cls, n, m, r, s, first, point: the m classes that share a prefix shingle with another.

    Of the class's s shingles that are shared so, the key is number r, from 0; `first` has the
    first OWNERS of them (0 where there are fewer). A task holds its share of the rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        seen: set[int] = set()

        def step(batch: pa.RecordBatch) -> dict | None:
            keys, ids, sizes = [], [], []
            for text in column(batch, "text"):
                own = shingles(text)
                if not len(own) or (cls := set_id(own)) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(cls)
                keys.append(prefix(own, shared.value))
                ids.append(cls)
                sizes.append(len(own))
            if not keys:
                return None
            many = [len(k) for k in keys]
            return {
                "key": pa.array(np.concatenate(keys).view(np.int64)), "cls": pa.array(np.repeat(np.array(ids, np.int64), many)),
                "n": pa.array(np.repeat(np.array(sizes, np.int32), many)), "i": pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in many])),
            }

        return step

    rows = map_batches(docs.select(utf8().alias("text")), "key long, cls long, n int, i int", make)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("i", pa.int32()), ("m", pa.int32())])

    def meet(batches):
        got = [[b.column(i).to_numpy() for i in range(4)] for b in batches if b.num_rows]
        if not got:
            return
        key, cls, n, at = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.lexsort((cls, key))
        key, cls, n, at = key[order], cls[order], n[order], at[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, n, at = key[first], cls[first], n[first], at[first]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        m = np.diff(np.append(starts, len(key)))
        m = np.repeat(m, m).astype(np.int32)
        keep = np.flatnonzero(m > 1)
        for k in range(0, len(keep), BATCH):
            rows = keep[k : k + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (key, cls, n, at, m)], schema=fields)

    met = rows.repartition(parts, "key").mapInArrow(released(meet), "key long, cls long, n int, i int, m int")
    # A class's point comes as one more row of it, so that no join need sort them.
    none = {c: F.lit(None).cast(k) for c, k in (("key", "long"), ("n", "int"), ("i", "int"), ("m", "int"))}
    both = met.withColumn("point", F.lit(None).cast("binary")).unionByName(classes.select("cls", "point", *[v.alias(c) for c, v in none.items()]))
    schema = "key long, cls long, n int, m int, r int, s int, first array<long>, point binary"
    made = arrow_schema(docs.sparkSession, schema)

    def rank(batches):
        rows, ids, points = [], [], []
        for b in batches:
            own = b.filter(b.column("key").is_valid())
            if own.num_rows:
                rows.append([own.column(c).to_numpy() for c in ("cls", "i", "key", "n", "m")])
            own = b.filter(b.column("point").is_valid())
            ids.append(own.column("cls").to_numpy())
            points += own.column("point").to_pylist()
        if not rows:
            return
        cls, at, key, n, m = (np.concatenate(x) for x in zip(*rows, strict=True))
        rows.clear()
        order = np.lexsort((at, cls))
        cls, key, n, m = cls[order], key[order], n[order], m[order]
        starts = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
        count = np.diff(np.append(starts, len(cls)))
        begin, s = np.repeat(starts, count), np.repeat(count, count)
        r = np.arange(len(cls)) - begin
        first = np.stack([np.where(s > k, key[np.minimum(begin + k, len(key) - 1)], 0) for k in range(OWNERS)], axis=1)
        ids = np.concatenate(ids)
        place = np.argsort(ids, kind="stable")
        place = place[np.searchsorted(ids, cls, sorter=place)]
        held = pa.array(points, pa.binary())
        for k in range(0, len(cls), BATCH):
            x = slice(k, k + BATCH)
            firsts = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(first[x]) + 1) * OWNERS, OWNERS), pa.int32()), pa.array(first[x].ravel()))
            columns = (key[x], cls[x], n[x], m[x], r[x], s[x], firsts, held.take(pa.array(place[x])))
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(columns, made, strict=True)], schema=made)

    return both.repartition(parts, "cls").mapInArrow(released(rank), schema)


def _hubs(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: each class of a large block and the class there whose prefix is shared most.

    In a group of copies that class is likely what the others were copied from. Pairs that
    share too few prefix shingles to link are left out.
    """
    large = blocks.where(F.col("m") >= HUB_FROM)
    hub = large.groupBy("key").agg(F.max(F.struct("s", "cls", "n")).alias("h"))
    hub = scratch.save(hub.select("key", F.col("h.cls").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.s").alias("hub_s")))
    met = large.join(_small(hub, hub.count() <= BROADCAST_IDS), "key").where("cls <> hub")
    most = f"(least(s, hub_s) + {_UNSHARED.format(n='greatest(n, hub_n)')})"
    met = met.where(f"{most} * {100 + PERCENT} >= (n + hub_n) * {PERCENT} and least(n, hub_n) * 100 >= {PERCENT} * greatest(n, hub_n)")
    best = met.groupBy("cls", "hub").agg(F.count("*").alias("c"), F.max("n").alias("n")).groupBy("cls").agg(F.max(F.struct("c", "hub", "n")).alias("x"))
    return best.where("x.c * 20 >= x.n").select(F.col("cls").alias("a"), F.col("x.hub").alias("b"))


#: Shingles of a set that aren't in its prefix.
_UNSHARED = f"(({{n}} * {PERCENT} + 99) div 100 - 1)"


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (-(-n * PERCENT // 100)) + 1


def _tiles(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with p, q and side: a block of more than TILE classes is dealt to parts, and
    each pair of parts meets in a tile of its own. Of such a block that has one label, nothing
    is left to compare."""
    whole = rows.withColumns({"p": F.lit(0), "q": F.lit(0), "side": F.lit(0)})
    large = rows.where(F.col("m") > TILE)
    open_keys = scratch.save(large.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"))
    if open_keys.isEmpty():
        return whole.where(F.col("m") <= TILE)
    large = large.join(_small(open_keys, open_keys.count() <= BROADCAST_IDS), "key", "left_semi")
    parts = F.ceil(F.col("m") / TILE).cast("int")
    large = large.withColumn("side", F.pmod(F.xxhash64("cls"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    large = large.withColumns({"p": F.least("side", "other"), "q": F.greatest("side", "other")}).drop("other")
    return whole.where(F.col("m") <= TILE).unionByName(large)


def _by_blocks(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole blocks, of `least` rows and at most a block more."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table)
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1]))
            held = table.slice(int(starts[-1])).to_batches()
            rows = sum(b.num_rows for b in held)
    if rows:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table) -> np.ndarray:
    """Where the rows of another block start."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in ("key", "p", "q"):
        own = table.column(name).to_numpy()
        new[1:] |= own[1:] != own[:-1]
    return np.flatnonzero(new)


def _cross_pairs(blocks: DataFrame, labels: DataFrame | None, scratch: Scratch, nearest: bool = False) -> DataFrame:
    """a, b: pairs of classes that meet in blocks, not yet in one component, that may link.

    A block's R-tree (of one leaf, where the block is small) finds the pairs whose points allow
    it. If a block's key is the first that two sets share, they share at most what both have
    from there to where the first of their prefixes ends, and what that set has beyond it. A
    pair that shares one of the first OWNERS keys of both is left to the block of that key.
    nearest: of large blocks alone, and for each class only the pair of the greatest bound.
    """
    if nearest:
        blocks = blocks.where(F.col("m") > FANOUT)
    rows, label = blocks, F.col("cls")
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        label = F.coalesce("component", "cls")
    rows = rows.withColumn("label", label)
    if nearest:
        part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / TILE)).cast("int")
        rows = rows.withColumns({"p": part, "q": part, "side": part})
    else:
        rows = _tiles(rows, scratch)
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("spare", pa.int32())])

    def compare(batches):
        for table in _by_blocks(batches):
            cls, first, own = np.unique(table.column("cls").to_numpy(), return_index=True, return_inverse=True)
            n, r, s, side, label = (table.column(x).to_numpy().astype(np.int64) for x in ("n", "r", "s", "side", "label"))
            at = counts_of(table.column("point").take(pa.array(first)).to_pylist())
            label = np.unique(label, return_inverse=True)[1]
            whole = table.column("p").to_numpy() == table.column("q").to_numpy()
            keys = table.column("first").combine_chunks().flatten().to_numpy().reshape(-1, OWNERS)
            left, beyond = s - r, n - prefix_size(n)
            starts = _starts(table)
            sizes = np.diff(np.append(starts, table.num_rows))
            best: dict[int, tuple[int, int]] = {}
            codes = [np.empty(0, np.int64)]

            def met(x: np.ndarray, y: np.ndarray) -> None:
                """Takes up those pairs of rows that may link and are this block's own."""
                least = needed(n[x], n[y])
                fit = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * 100 >= PERCENT * np.maximum(n[x], n[y]))
                fit &= np.minimum(left[x], left[y]) + np.maximum(beyond[x], beyond[y]) >= least
                fit &= whole[x] | (side[x] != side[y])
                x, y, least = x[fit], y[fit], least[fit]
                if not nearest:
                    fit = np.ones(len(x), bool)
                    for i in range(OWNERS):
                        for j in range(OWNERS):
                            fit &= (keys[x, i] != keys[y, j]) | (r[x] <= i) | (r[y] <= j)
                    x, y, least = x[fit], y[fit], least[fit]
                spare = overlap_bound(at, own[x], own[y]) - least
                fit = spare >= 0
                a, b, spare = own[x[fit]], own[y[fit]], spare[fit]
                if not nearest:
                    codes.append(np.minimum(a, b) * len(cls) + np.maximum(a, b))
                    return
                for a, b in ((a, b), (b, a)):
                    order = np.lexsort((spare, a))
                    last = order[np.append(a[order][1:] != a[order][:-1], True)] if len(order) else order
                    for i, j, k in zip(a[last].tolist(), b[last].tolist(), spare[last].tolist(), strict=True):
                        if k > best.get(i, (-1, -1))[0]:
                            best[i] = (k, j)

            for m in np.unique(sizes).tolist():
                of_size = starts[sizes == m]
                if 1 < m <= FANOUT:
                    for i, j in zip(*np.triu_indices(m, 1), strict=True):
                        met(of_size + i, of_size + j)
                elif m > 1:
                    for k in of_size.tolist():
                        mine = slice(k, k + m)
                        if (label[mine] != label[k]).any():
                            for x, y in CountTree(at[own[mine]], n[mine], label[mine]).pairs():
                                met(x + k, y + k)
            if nearest:
                found = (list(best), [b for _, b in best.values()], [v for v, _ in best.values()])
            else:
                code = np.unique(np.concatenate(codes))
                found = (code // len(cls), code % len(cls), np.zeros(len(code)))
            if len(found[0]):
                a, b, spare = (np.asarray(v, np.int64) for v in found)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((cls[a], cls[b], spare), fields, strict=True)], schema=fields)

    rows = rows.select("key", "p", "q", "side", "cls", "n", "r", "s", "first", "point", "label")
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(released(compare), "a long, b long, spare int")
    if nearest:
        return found.groupBy("a").agg(F.max(F.struct("spare", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose whole sets link. Only their classes' texts are read again; the two texts
    of a pair meet in one task, pair by pair."""
    few = pairs.count() <= BROADCAST_IDS
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("cls"))
    asked = ends.join(classes.select("cls", "of"), "cls").select("a", "b", (F.col("cls") == F.col("b")).alias("second"), "of")
    texts = _texts(docs)
    met = texts["doc_id"].eqNullSafe(F.col("of.doc_id")) & (texts["h"] == F.col("of.h"))
    rows = texts.join(_small(asked, few), met).select("a", "b", "second", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches):
        last, own, first = None, None, None
        for batch in batches:
            found = []
            for a, b, second, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not second:
                    if last == a and own is not None:
                        continue
                    this = shingles(text)
                    if len(this) and set_id(this) == a:
                        last, own = a, this
                elif last == a and own is not None and first != (a, b):
                    this = shingles(text)
                    if len(this) and set_id(this) == b:
                        first = (a, b)
                        both = len(np.intersect1d(own, this, assume_unique=True))
                        if 100 * both >= PERCENT * (len(own) + len(this) - both):
                            found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=fields)

    dealt = rows.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "second")
    return dealt.mapInArrow(released(verify), "a long, b long")


def _small(df: DataFrame, is_small: bool) -> DataFrame:
    return F.broadcast(df) if is_small else df


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: every document with the smallest doc_id that links
    lead to from it, itself included.

    1. Equal sets are one class; copies go no further. 2. Classes meet in blocks, one for each
    prefix shingle that two or more have; linked sets always share one. 3. In large blocks,
    classes first meet one hub, so that a group of copies needs no pairs among its members.
    4. What is in one component by then is settled; in each block an R-tree over count vectors
    finds the other pairs that may link, each once or a few times, and whole sets decide. Null and empty texts: no
    shingles, linked with nothing. Repeated rows link if they have words; null ids are no
    one's smallest.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.save(classes_of(docs))
    common = common_shingles(counted)
    base = scratch.save(counted.where("kind = 0").select("doc_id", "n_shingles", "cls"))
    classes = scratch.save(counted.where("kind = 0 and cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max(F.struct("doc_id", "h")).alias("of"), F.min("point").alias("point")))
    scratch.drop(base, classes)
    blocks = scratch.save(_blocks(docs, common, classes))
    hubs = scratch.save(_hubs(blocks, scratch))
    labels = links = None

    def more_links(pairs: DataFrame) -> bool:
        """Adds the pairs that link, and labels their components anew."""
        nonlocal links, labels
        found = scratch.save(_linked(pairs, docs, classes))
        if found.isEmpty():
            return False
        links = found if links is None else scratch.save(links.unionByName(found))
        labels = scratch.save(connected_components(links, "a", "b"))
        scratch.drop(base, classes, blocks, links, labels)
        return True

    if not hubs.isEmpty() and more_links(hubs):
        for _ in range(NEAREST_ROUNDS):
            if not more_links(scratch.save(_cross_pairs(blocks, labels, scratch, nearest=True))):
                break
    more = scratch.save(_cross_pairs(blocks, labels, scratch))
    if not more.isEmpty():
        more_links(more)
    rooted = classes.select("cls", "rep")
    if labels is None:
        rooted = rooted.withColumn("root", F.col("cls"))
    else:
        rooted = rooted.join(labels, rooted.cls == labels.node, "left").select("cls", "rep", F.coalesce("component", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = scratch.save(rooted.join(least, "root").select(F.col("cls").alias("own"), "component_id"))
    scratch.drop(base, ids)
    return base.join(ids, base.cls == ids.own, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, but for those that link to one with a smaller
    doc_id: each group keeps one. Where a kept doc_id is on several rows, equal texts of it
    are one row; documents without an id stay."""
    groups = Scratch(docs.sparkSession).save(components(docs).where("doc_id = component_id or doc_id is null").groupBy("doc_id").agg(F.count("*").alias("times")))
    few = groups.count() <= BROADCAST_IDS
    ids = groups.select(F.col("doc_id").alias("_kept"))
    kept = docs.join(F.broadcast(ids) if few else ids, docs.doc_id.cast("long").eqNullSafe(ids["_kept"]), "left_semi")
    again = groups.where("doc_id is not null and times > 1").select(F.col("doc_id").alias("_kept"))
    if again.isEmpty():
        return kept
    many = kept.join(again, kept.doc_id.cast("long") == again["_kept"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, kept.doc_id.cast("long") == again["_kept"], "left_anti").unionByName(many)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"))
