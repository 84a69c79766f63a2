"""Document fingerprints: Merkle trees over the paragraphs and sections of texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import _GEAR
from lectern.llm.common import column, map_batches, read

#: Paragraphs are cut where a rolling hash of 16 bytes has LEAF_BITS zero bits, about every
#: 2 ** LEAF_BITS bytes; a section ends after a paragraph with SECTION_BITS zero bits.
LEAF_BITS, SECTION_BITS = 6, 2


def _digest(raw: bytes, size: int = 8) -> str:
    return hashlib.blake2b(raw, digest_size=size).hexdigest()


def leaves(text: bytes) -> list[tuple[bytes, bool]]:
    """The pieces of a text, and whether each ends its paragraph (a line)."""
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    line = set(ends.tolist())
    cuts = ends
    if len(data) > 16:
        rolling = _GEAR[data]
        for shift in (1, 2, 4, 8):
            older = rolling[:-shift] << np.uint32(shift)
            rolling = rolling.copy()
            rolling[shift:] += older
        own = np.flatnonzero(((rolling >> np.uint32(16 - LEAF_BITS)) & np.uint32((1 << LEAF_BITS) - 1))[15:] == 0) + 16
        cuts = np.union1d(ends, own)
    cuts = cuts[cuts < len(data)].tolist()
    return [(text[a:b], b in line) for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]


def fingerprint(text: str) -> str:
    """`root:section,section...`; a section is `digest=paragraph|paragraph...`, a paragraph
    `digest(leaf+leaf...)`, and a leaf its digest and, after a point, its bytes in hex.

    A digest is that of the digests below it, so equal roots mean equal texts, and a branch
    whose digest is found again needs no further look. Null and empty texts: a root alone.
    """
    raw = text.encode("utf-8", "surrogatepass")
    sections: list[str] = []
    paragraphs: list[str] = []
    below: list[str] = []
    own: list[str] = []

    def close_section() -> None:
        if paragraphs:
            sections.append(f"{_digest(''.join(below).encode())}={'|'.join(paragraphs)}")
            paragraphs.clear()
            below.clear()

    def close_paragraph() -> None:
        if own:
            made = _digest("".join(own).encode())
            paragraphs.append(f"{made}({'+'.join(own)})")
            below.append(made)
            own.clear()
            if int(made[-1], 16) % (1 << SECTION_BITS) == 0:
                close_section()

    for piece, last in leaves(raw):
        own.append(f"{_digest(piece)}.{len(piece):x}")
        if last:
            close_paragraph()
    close_paragraph()
    close_section()
    root = _digest("".join(s[:16] for s in sections).encode(), 16)
    return f"{root}:{','.join(sections)}"


def _branches(print_: str) -> list[tuple[str, str]]:
    body = print_.partition(":")[2]
    return [tuple(s.split("=", 1)) for s in body.split(",")] if body else []


def _pieces(paragraphs: str) -> list[list[str]]:
    return [p[p.index("(") + 1 : -1].split("+") for p in paragraphs.split("|")]


def _size(leaf: str) -> int:
    return int(leaf.rpartition(".")[2], 16)


def likeness(a: str, b: str) -> float:
    """The share of bytes in branches and leaves that both trees hold, from 0 to 1.

    Equal roots give 1 at once. Sections that both hold count whole; only those that differ
    are opened, down to their leaves.
    """
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    left, right = _branches(a), _branches(b)
    size = [sum(_size(x) for _, s in side for p in _pieces(s) for x in p) for side in (left, right)]
    total = sum(size)
    if not total:
        return 1.0
    counts = Counter(d for d, _ in left) & Counter(d for d, _ in right)
    shared, opened = 0, []
    for side in (left, right):
        rest, open_ = counts.copy(), Counter()
        for d, s in side:
            if rest[d]:
                rest[d] -= 1
                if side is left:
                    shared += sum(_size(x) for p in _pieces(s) for x in p)
            else:
                open_.update(x for p in _pieces(s) for x in p)
        opened.append(open_)
    shared += sum(_size(x) * n for x, n in (opened[0] & opened[1]).items())
    return 2.0 * shared / total


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Byte spans of the first text whose leaves the second lacks: where edits are."""
    held = Counter(x for _, s in _branches(b) for p in _pieces(s) for x in p)
    at, out = 0, []
    for _, s in _branches(a):
        for p in _pieces(s):
            for x in p:
                n = _size(x)
                if held[x]:
                    held[x] -= 1
                elif out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + n)
                else:
                    out.append((at, at + n))
                at += n
    return out


def edited(text: str, following: str) -> str:
    """text, its last third replaced by the first as many code points of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and place, dealt into ranges of descending doc_id.

    place 0 rows are the documents; a place 1 row at the end of a range repeats the document
    that comes next, from the following range (after the last: the very first). Range bounds
    are quantiles of doc_id, as many as there are shuffle partitions; texts move once. Ties
    of doc_id follow their texts; null ids come last.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = sorted({int(b) for b in own.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    if bounds:
        limits = F.array(*[F.lit(b).cast("long") for b in bounds])
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(limits, lambda b: b <= F.col("doc_id"))))
    else:
        bucket = F.lit(0)
    own = own.withColumn("bucket", bucket.cast("int"))
    # At most one row a range: its first document's id, for the range that comes before it.
    heads = own.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()
    order = sorted(heads, key=lambda r: -r.bucket)
    if not order:
        return own.select("doc_id", "text", "bucket", F.lit(0).alias("place"))
    targets = [(order[(i + 1) % len(order)].top, r.bucket) for i, r in enumerate(order)]
    first = spark.createDataFrame(targets, "doc_id long, target int")
    heads_text = (
        own.join(F.broadcast(first), own.doc_id.eqNullSafe(first.doc_id), "inner")
        .groupBy(first.doc_id, "target").agg(F.min(own.text).alias("text"))
    )
    rows = own.select("doc_id", "text", "bucket", F.lit(0).alias("place")).unionByName(
        heads_text.select("doc_id", "text", F.col("target").alias("bucket"), F.lit(1).alias("place"))
    )
    return rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "place", F.col("doc_id").desc_nulls_last(), "text")


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses."""
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def make():
        held: list[tuple] = []

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {f.split()[0]: [] for f in fields.split(", ")}
            for doc, text, bucket, _place in zip(*(column(batch, c) for c in ("doc_id", "text", "bucket", "place")), strict=True):
                own = fingerprint(text)
                if held and held[0][3] == bucket:
                    before, old, old_print, _ = held[0]
                    changed = edited(old, text)
                    changed_print = fingerprint(changed)
                    for n, v in (
                        ("doc_id", before), ("n_chars", len(old)), ("edited_sha256", hashlib.sha256(changed.encode()).hexdigest()),
                        ("fingerprint", old_print), ("edited_fingerprint", changed_print),
                        ("near_edited", likeness(old_print, changed_print)), ("near_next", likeness(old_print, own)),
                    ):
                        out[n].append(v)
                held[:] = [(doc, text, own, bucket)]
            return out

        return step

    return map_batches(with_next(docs), fields, make)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
