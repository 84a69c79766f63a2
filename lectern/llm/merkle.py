"""A Merkle manifest of a table: a subtree a group over its range-sorted rows, and proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import Scratch, arrow_schema, read, released, small_batches
from lectern.operators.order import ranked

#: Nodes that a parent is made of. A constant of the format: the code below shifts by its bits.
FANOUT, BITS = 16, 4
#: Levels that a task builds by itself: its subtrees have up to FANOUT ** LOCAL leaves.
LOCAL = 3
#: Fields of a leaf of `documents`, in their order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_KEPT = "grp string, doc_id long, leaf binary, other binary, part int, pos long"
_PIECES = "grp string, level int, idx long, digest binary, doc_ids array<long>, leaves binary, others array<binary>"


def sha256(column: Column) -> Column:
    return F.unhex(F.sha2(column, 256))


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: each field `-` if null, else its length in UTF-8 bytes, `:`, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return sha256(F.concat(*parts).cast("binary"))


@dataclass
class Manifest:
    """pieces: subtrees that tasks built, with their leaves; above: what stands above each."""

    pieces: DataFrame
    above: DataFrame
    scratch: Scratch


def sorted_rows(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """leaves (grp, doc_id, leaf, other) sorted over the cluster by group, doc_id and leaf, with
    `part` and `pos`, the place among the rows of the group in that part of the order.

    Equal rows may go to either side of a border between parts: a last key tells them apart.
    """
    rows = scratch.save(leaves.withColumn("_row", F.monotonically_increasing_id()))
    fields = arrow_schema(leaves.sparkSession, _KEPT)
    small_batches(leaves.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, pos = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for g in batch.column(0).to_pylist():
                pos = pos + 1 if g == last else 0
                last = g
                places.append(pos)
            own = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], schema=fields)

    placed = rows.orderBy("grp", "doc_id", "leaf", "_row").select("grp", "doc_id", "leaf", "other").mapInArrow(released(number), _KEPT)
    return scratch.save(placed)


def offsets(rows: DataFrame) -> DataFrame:
    """part, before: rows of the part's first group that stand in earlier parts, if any.

    Rows are sorted, so only the first group of a part can have begun before: the result has a
    row a part at most, whatever the number of groups.
    """
    counts = rows.groupBy("grp", "part").agg(F.count("*").alias("n"))
    by = Window.partitionBy("grp").orderBy("part")
    return counts.select("part", F.col("grp").alias("first"), (F.sum("n").over(by) - F.col("n")).alias("before")).where("before > 0")


def _hash_run(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def _blocks(start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """level, first and end of the largest aligned subtrees of the leaves start to end."""
    while start < end:
        level = 0
        while level < LOCAL and not start & (1 << BITS * (level + 1)) - 1 and start + (1 << BITS * (level + 1)) <= end:
            level += 1
        yield level, start, start + (1 << BITS * level)
        start += 1 << BITS * level


def subtrees(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Complete aligned subtrees of rows that lie together; what is ragged stays a leaf or a
    smaller subtree. A task holds the leaves of one largest subtree at a time."""
    size = 1 << BITS * LOCAL
    fields = arrow_schema(rows.sparkSession, _PIECES)
    # A row a part at most: broadcast, so that rows stay where and as they are.
    start = F.broadcast(offsets(rows))
    own = rows.join(start, (rows.part == start.part) & (rows.grp == start["first"]), "left")
    own = own.select("grp", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("idx"), "doc_id", "leaf", "other")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, first, held = None, 0, []
        out: list[dict] = []

        def close() -> None:
            for level, a, b in _blocks(first, first + len(held)):
                block = held[a - first : b - first]
                nodes = [x[1] for x in block]
                for _ in range(level):
                    nodes = [_hash_run(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
                out.append({
                    "grp": grp, "level": level, "idx": a >> BITS * level, "digest": nodes[0], "doc_ids": [x[0] for x in block],
                    "leaves": b"".join([x[1] for x in block]), "others": [x[2] for x in block] if any(x[2] is not None for x in block) else None,
                })
            held.clear()

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, schema=fields)
            out.clear()
            return made

        for batch in batches:
            for g, i, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (g != grp or i != first + len(held) or not i % size):
                    close()
                if not held:
                    grp, first = g, i
                held.append(row)
            if len(out) >= 256:
                yield emit()
        if held:
            close()
        if out:
            yield emit()

    small_batches(rows.sparkSession)
    return scratch.save(own.mapInArrow(released(build), _PIECES))


def _climb(nodes: Callable[[int], DataFrame | None], local: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame | None]:
    """Runs of each level and the top node of each group.

    nodes(level): grp, idx, digest of the nodes known at a level (up to `local`). Nodes meet
    by the coordinate of their parent, FANOUT at most; a run of one node at the very left is a
    top. Only nodes that no task could finish move, a level at a time.
    """
    levels: list[DataFrame] = []
    tops = None
    up, level = None, 0
    while True:
        own = nodes(level) if level <= local else None
        here = own if up is None else up if own is None else up.unionByName(own)
        if here is None:
            break
        run = here.groupBy("grp", F.shiftright("idx", BITS).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        run = scratch.save(run)
        alone = (F.col("parent") == 0) & (F.size("run") == 1)
        top = run.where(alone).select("grp", F.lit(level).alias("level"), F.col("run")[0]["digest"].alias("digest"))
        tops = top if tops is None else tops.unionByName(top)
        open_ = run.where(~alone)
        levels.append(open_)
        joined = F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["digest"]))), "")
        up = open_.select("grp", F.col("parent").alias("idx"), sha256(joined.cast("binary")).alias("digest"))
        level += 1
        if level > local and open_.isEmpty():
            break
    return levels, tops


def _siblings(at: str, run: str) -> Column:
    """The digests of a run but the one at a place, one after another."""
    others = F.transform(F.filter(run, lambda x: x["idx"] != F.col(at)), lambda x: F.hex(x["digest"]))
    return F.unhex(F.array_join(others, ""))


def _descend(levels: list[DataFrame], tops: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For each level, grp, idx and `above` of its nodes: place and siblings at each step up.

    tops: grp, level, above and columns to hand down. Each node meets its parent by its own
    coordinate: no run is met by more than its FANOUT nodes.
    """
    hand = [c for c in tops.columns if c not in ("grp", "level", "above")]
    found: list[DataFrame] = []
    parents = None
    for level in range(len(levels) - 1, -1, -1):
        here = tops.where(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), "above", *hand)
        if parents is not None:
            kids = levels[level].join(parents.withColumnRenamed("idx", "parent"), ["grp", "parent"])
            kids = kids.select("grp", F.explode("run.idx").alias("idx"), "run", "above", *hand)
            step = F.struct(F.pmod("idx", F.lit(FANOUT)).cast("int").alias("at"), _siblings("idx", "run").alias("siblings"))
            here = here.unionByName(kids.select("grp", "idx", F.concat(F.array(step), "above").alias("above"), *hand))
        parents = scratch.save(here)
        found.append(parents)
    return found[::-1]


def build(leaves: DataFrame) -> Manifest:
    """The tree over leaves: grp, doc_id, leaf and other (a second leaf for the row, or null).

    grp must not be null (see group_key). Leaves of a group ascend by doc_id (null first), equal
    ids by leaf. An empty table has no root and no proofs. All tables are written; the caller
    drops them.
    """
    scratch = Scratch(leaves.sparkSession)
    rows = sorted_rows(leaves, scratch)
    pieces = subtrees(rows, scratch)
    levels, tops = _climb(lambda level: pieces.where(F.col("level") == level).select("grp", "idx", "digest"), LOCAL, scratch)
    # The tops are the leaves of one more tree, in the order of their groups.
    tops = scratch.save(ranked(tops, ["grp"], "idx"))
    upper, root = _climb(lambda level: tops.select(F.lit("").alias("grp"), "idx", "digest"), 0, scratch)
    none = F.array().cast("array<struct<at:int,siblings:binary>>")
    root = root.select("grp", "level", none.alias("above"), F.col("digest").alias("root"))
    over = _descend(upper, root, scratch)[0]
    tops = tops.join(over.select("idx", "above", "root"), "idx").select("grp", "level", "above", F.col("digest").alias("subroot"), "root")
    below = _descend(levels, scratch.save(tops), scratch)
    above = below[0].withColumn("level", F.lit(0))
    for level in range(1, min(LOCAL + 1, len(below))):
        above = above.unionByName(below[level].withColumn("level", F.lit(level)))
    return Manifest(pieces, above, scratch)


def _folded(digest: bytes, steps: list[tuple[int, str]]) -> bytes:
    """The root that a leaf and the siblings beside it at each step lead to."""
    for at, others in steps:
        digest = hashlib.sha256((others[: 64 * at] + digest.hex() + others[64 * at :]).encode()).digest()
    return digest


def _each_leaf(manifest: Manifest, schema: str, row: Callable[[int, bytes, bytes | None, list[tuple[int, str]], bytes, bytes], dict]) -> DataFrame:
    """A row a leaf: row(doc_id, leaf, other, steps, subroot, root), where a step is the leaf's
    or its ancestor's place among FANOUT and the hex digests of the others."""
    fields = arrow_schema(manifest.pieces.sparkSession, schema)
    small_batches(manifest.pieces.sparkSession)
    own = manifest.pieces.join(manifest.above, ["grp", "level", "idx"])
    own = own.select("level", "doc_ids", "leaves", "others", "above", "subroot", "root")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                level, ids, packed, others, above, subroot, root = (c[k].as_py() for c in batch.columns)
                nodes = [packed[i : i + 32] for i in range(0, len(packed), 32)]
                runs: list[list[str]] = []
                for _ in range(level):
                    runs.append(["".join([x.hex() for x in nodes[i : i + FANOUT]]) for i in range(0, len(nodes), FANOUT)])
                    nodes = [hashlib.sha256(r.encode()).digest() for r in runs[-1]]
                top = [(s["at"], s["siblings"].hex()) for s in above]
                out = []
                for i, doc_id in enumerate(ids):
                    steps, at = [], i
                    for run in runs:
                        at, here = at >> BITS, at & FANOUT - 1
                        steps.append((here, run[at][: 64 * here] + run[at][64 * here + 64 :]))
                    out.append(row(doc_id, packed[32 * i : 32 * i + 32], others[i] if others else None, steps + top, subroot, root))
                    if len(out) >= 1024:
                        yield pa.RecordBatch.from_pylist(out, schema=fields)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=fields)

    return own.mapInArrow(released(expand), schema)


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root and proof: the leaf's and its ancestors' places among their
    runs, with the hex digests of the others, from the leaf up to the root."""

    def row(doc_id, leaf_, other, steps, subroot, root):
        return {"doc_id": doc_id, "leaf": leaf_.hex(), "subroot": subroot.hex(), "root": root.hex(), "proof": [{"at": a, "siblings": s} for a, s in steps]}

    return _each_leaf(manifest, "doc_id long, leaf string, subroot string, root string, proof array<struct<at:int,siblings:string>>", row)


def verify(leaves: DataFrame, proven: DataFrame) -> DataFrame:
    """doc_id, verified: whether rows' leaves (doc_id, leaf as hex) lead to the root of their
    proofs. Rows without a proof aren't verified; doc_id must be unique."""

    def root_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, root, proof = (c.to_pylist() for c in batch.columns)
            right = [
                x is not None and p is not None and _folded(bytes.fromhex(x), [(s["at"], s["siblings"]) for s in p]).hex() == r
                for x, r, p in zip(own, root, proof, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(right)], names=["doc_id", "verified"])

    small_batches(leaves.sparkSession)
    both = leaves.select("doc_id", F.col("leaf").alias("own")).join(proven.select("doc_id", "root", "proof"), "doc_id", "left")
    return both.select("doc_id", "own", "root", "proof").mapInArrow(root_of, "doc_id long, verified boolean")


def group_key(column: Column) -> Column:
    """A key that is never null and sorts as the column does in UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


def leaves_of(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """grp, doc_id, leaf and other of documents; other is the leaf with `text` where `tampered`.

    Nulls in any field have a mark of their own; other columns play no part.
    """
    fields = {c: F.col(c) for c in FIELDS}
    other = F.lit(None).cast("binary") if tampered is None else F.when(tampered, leaf(fields | {"text": text}))
    return docs.select(group_key(F.col("source")).alias("grp"), F.col("doc_id").cast("long"), leaf(fields).alias("leaf"), other.alias("other"))


def digest(docs: DataFrame) -> DataFrame:
    """Leaves, roots and digests of proofs of all rows, checked against tampered rows.

    Where 5 divides the checksum of doc_id (null: it doesn't), the text's A-Z are lower-cased
    before the root is recomputed. Of repeated rows each has a leaf and a proof of its own.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    manifest = build(leaves_of(docs, tampered, F.translate(F.col("text").cast("string"), ascii_uppercase, ascii_lowercase)))

    def row(doc_id, leaf_, other, steps, subroot, root):
        folded = _folded(other or leaf_, steps)
        return {
            "doc_id": doc_id, "leaf": leaf_.hex(), "subroot": subroot.hex(), "root": root.hex(),
            "proof_sha256": hashlib.sha256("".join([s for _, s in steps]).encode()).hexdigest(), "folded_root": folded.hex(), "verified": folded == root,
        }

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = _each_leaf(manifest, schema, row)
    manifest.scratch.drop(manifest.pieces, *_tables(manifest))
    return found


def _tables(manifest: Manifest) -> list[DataFrame]:
    """The written tables that the manifest reads."""
    used = set(manifest.above.inputFiles())
    return [df for path, df in manifest.scratch.paths.values() if any(path.rsplit("/", 1)[1] in u for u in used)]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
