"""Suffix-array dedup: distributed merge sort of suffixes with known common prefixes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lectern.llm.common import column, map_batches, read, released, utf8

#: Bytes of a repeated string, and of the k-grams that suffixes start with. Of each LENGTH
#: bytes, the leftmost k-gram of least hash is an anchor, so equal strings have an anchor at
#: the same place, and only suffixes at anchors (about one in 70) need sorting.
LENGTH, GRAM = 200, 60
REACH = LENGTH - GRAM  # how far before its anchor a string can start
PIECE = LENGTH + REACH  # bytes around an anchor, and of a piece of a periodic stretch
#: Bytes of text hashed at once, and suffixes in a run.
SLICE_BYTES, RUN_SUFFIXES = 1 << 20, 1 << 16
#: Bytes of a run decompressed at once.
READ_BYTES = 1 << 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240902).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place: halves are combined, so it takes log steps."""
    now, size = _BYTE[data], 1
    while size * 2 <= GRAM:
        now = (now[:-size] * _A) ^ (now[size:] + (now[:-size] >> np.uint64(31)))
        size *= 2
    if size < GRAM:
        now = (now[: len(now) - (GRAM - size)] * _A) ^ (now[GRAM - size :] * _B)
    return now ^ (now >> np.uint64(32))


def anchors(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of at least LENGTH bytes: its index, anchor places, their hashes, and the
    starts of the pieces of PIECE bytes that repeat within a periodic stretch of their own.

    Short texts are hashed together, long ones a slice at a time, so memory doesn't grow with
    a text. Windows that start in a slice see the bytes they need of the next.
    """
    at = 0
    long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    while at < len(long):
        some, size = [], 0
        while at < len(long) and (not some or size + len(texts[long[at]]) <= SLICE_BYTES):
            some.append(long[at])
            size += len(texts[long[at]])
            at += 1
        if size > SLICE_BYTES:
            text, found = texts[some[0]], []
            for s in range(0, len(text) - LENGTH + 1, SLICE_BYTES):
                data = np.frombuffer(text, np.uint8)[s : s + SLICE_BYTES + LENGTH - 1]
                place, full = _chosen(data)
                own, pieces = _thinned(data, np.unique(place), full, 0)
                found.append((own.astype(np.int64) + s, full[own], pieces.astype(np.int64) + s))
            places, hashes, pieces = (np.concatenate(x) for x in zip(*found, strict=True))
            places, first = np.unique(places, return_index=True)
            yield some[0], places.astype(np.int32), hashes[first], np.unique(pieces).astype(np.int32)
            continue
        data = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
        place, full = _chosen(data)
        start = 0
        for i in some:
            end = start + len(texts[i])
            own, pieces = _thinned(data, np.unique(place[start : end - LENGTH + 1]), full, start)
            yield i, (own - start).astype(np.int32), full[own], pieces
            start = end


def _chosen(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the LENGTH bytes at each place, and the hash of the k-gram at each place."""
    full = gram_hashes(data)
    value, place = (full >> np.uint64(32)).astype(np.uint32), np.arange(len(full), dtype=np.int32)
    window, width = REACH + 1, 1
    while width * 2 <= window:
        value, place = _lesser(value, place, width)
        width *= 2
    if width < window:
        value, place = _lesser(value, place, window - width)
    return place, full


def _thinned(data: np.ndarray, own: np.ndarray, full: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors without those that a periodic stretch makes superfluous, and its pieces.

    Equal k-grams at a distance of d < GRAM bytes make the bytes from the first to the end of
    the last of them periodic. Anchors that stand deep enough in there see the same bytes on
    both sides, so one of them is enough for strings elsewhere; within the stretch, every
    string of LENGTH bytes is found again d bytes on, so all of it is covered.
    """
    none = np.empty(0, np.int32)
    if len(own) < 4:
        return own, none
    apart = np.diff(own)
    same = (apart < GRAM) & (full[own[1:]] == full[own[:-1]])
    if not same.any():
        return own, none
    begins = np.flatnonzero(same & np.concatenate(([True], ~same[:-1] | (apart[1:] != apart[:-1]))))
    ends = np.flatnonzero(same & np.concatenate((~same[1:] | (apart[1:] != apart[:-1]), [True]))) + 1
    keep, pieces = np.ones(len(own), bool), []
    for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
        d, first, end = int(apart[i]), int(own[i]), int(own[j]) + GRAM
        a, b = np.searchsorted(own[i : j + 1], (first + REACH, end - LENGTH + 1)) + i
        if b - a < 2 or not np.array_equal(data[first : end - d], data[first + d : end]):
            continue
        keep[a + 1 : b] = False
        pieces.append(np.append(np.arange(first, end - PIECE, PIECE), end - PIECE) - start)
    return own[keep], np.concatenate(pieces).astype(np.int32) if pieces else none


def _lesser(value: np.ndarray, place: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    right = value[apart:] < value[:-apart]
    return np.where(right, value[apart:], value[:-apart]), np.where(right, place[apart:], place[:-apart])


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Bytes that a and b share, of which `known` need no look."""
    end = min(len(a), len(b))
    differ = int.from_bytes(a[known:end]) ^ int.from_bytes(b[known:end])
    return end - (differ.bit_length() + 7) // 8


def neighbour_prefixes(texts: list[bytes]) -> np.ndarray:
    """Bytes that each text shares with the one before it."""
    out = np.zeros(len(texts), np.int64)
    for s in range(0, len(texts), 1 << 14):
        part = texts[max(0, s - 1) : s + (1 << 14)]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        width = int(sizes.max())
        if not width:
            continue
        rows = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in part), np.uint8).reshape(len(part), width)
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        found = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
        out[max(1, s) : s + len(part) - (s > 0)] = found
    return out


_ENTRY = struct.Struct("<BBBBqiB")  # bytes shared with the run's suffix before, further bytes; the same of what stands before; text, place, many


def encode_run(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run, front-coded and packed: of each suffix only the bytes that its predecessor lacks."""
    rights, lefts = [e[0] for e in entries], [e[1] for e in entries]
    shared, before = neighbour_prefixes(rights).tolist(), neighbour_prefixes(lefts).tolist()
    parts = []
    for (right, left, text, place, many), a, b in zip(entries, shared, before, strict=True):
        parts += (_ENTRY.pack(a, len(right) - a, b, len(left) - b, text, place, many), right[a:], left[b:])
    return pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def decode_run(run: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, int, int, int]]]:
    """Each suffix of a packed run with the bytes that it shares with the one before, as they
    were sent; the run is decompressed as it is read."""
    stream = pa.CompressedInputStream(pa.BufferReader(pa.py_buffer(run)), "zstd")
    held, at, right, left = b"", 0, b"", b""
    while True:
        if len(held) - at < _ENTRY.size + LENGTH + REACH:
            held, at = held[at:] + stream.read(READ_BYTES), 0
            if not held:
                return
        a, more, b, more_left, text, place, many = _ENTRY.unpack_from(held, at)
        at += _ENTRY.size
        right = right[:a] + held[at : at + more]
        at += more
        left = left[:b] + held[at : at + more_left]
        at += more_left
        yield a, right, (left, text, place, many)


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merges sorted runs by a loser tree; each suffix comes with what it shares with the last.

    A head keeps how many bytes it shares with the last winner. The head that shares more is
    less; only equally long shares need a look, and that from the first unknown byte on. So
    no byte known to be equal is compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple[bytes, tuple] | None] = [None] * k
    known = [0] * k
    losers = [0] * k

    def advance(r: int) -> None:
        got = next(runs[r], None) if r < len(runs) else None
        heads[r] = None if got is None else got[1:]
        known[r] = -1 if got is None else got[0]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads; the loser then keeps what it shares with the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = heads[a][0], heads[b][0]
        n = common_prefix(x, y, known[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    for r in range(k):
        advance(r)
        known[r] = min(known[r], 0)
    winner = build(1)
    while heads[winner] is not None:
        yield known[winner], *heads[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def covered(shared: np.ndarray, rights: list[bytes], lefts: list[bytes], many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in sorted order the least and largest distance before its anchor at
    which a string of LENGTH bytes starts that is found at another one; -1: none.

    Suffixes that share their first LENGTH - d bytes are neighbours in the sorted order, what
    stands before them is sorted alike, and a pair that is equal on both sides is found at
    distance d.
    """
    n = len(rights)
    least, most = np.full(n, -1), np.full(n, -1)
    alone = shared < GRAM
    group = np.cumsum(alone) - 1
    weight = 1 + many.astype(np.int64)
    some = np.bincount(group, weight)[group] > 1
    if not some.any():
        return least, most
    right_size, left_size = (np.fromiter(map(len, x), np.int64, n) for x in (rights, lefts))
    order = np.array(sorted(range(n), key=lefts.__getitem__))
    before = neighbour_prefixes([lefts[i] for i in order.tolist()])
    for d in range(REACH + 1):
        fits = some & (left_size >= d) & (right_size >= LENGTH - d)
        if not fits.any():
            continue
        ahead = np.cumsum(shared < LENGTH - d)
        behind = np.empty(n, np.int64)
        behind[order] = np.cumsum(before < d)
        at = np.flatnonzero(fits)
        _, kind = np.unique(ahead[at] * (n + 1) + behind[at], return_inverse=True)
        hit = at[np.bincount(kind, weight[at])[kind] > 1]
        most[hit] = d
        least[hit] = np.where(least[hit] < 0, d, least[hit])
    return least, most


def _keyed(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return own.withColumn("h", F.xxhash64("doc_id", "text"))


def _anchors_met(own: DataFrame, parts: int) -> DataFrame:
    """h, place: anchors whose k-gram another anchor has too.

    Anchors that meet within a batch are found at once; for all of them only one row goes to
    those of other batches, so a k-gram of any number of texts costs a row a batch. A place
    under 0 is no anchor but the complement of where a piece of a periodic stretch starts.
    """
    alone, met, stands = 0, 1, 2

    def make():
        def step(batch: pa.RecordBatch) -> dict | None:
            keys = batch.column(0).to_numpy()
            got, own = [], []
            for i, p, g, pieces in anchors(column(batch, "text")):
                got.append((np.full(len(p), keys[i]), p, g))
                if len(pieces):
                    own.append((np.full(len(pieces), keys[i]), ~pieces))
            if not got:
                return None
            h, place, gram = (np.concatenate(x) for x in zip(*got, strict=True))
            within, piece = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (h[:0], place[:0])
            gram = gram.view(np.int64)
            each, back, counts = np.unique(gram, return_inverse=True, return_counts=True)
            many = counts[back] > 1
            first = each[counts > 1]
            kind = np.concatenate((np.where(many, met, alone), np.full(len(first), stands), np.full(len(piece), met)))
            none = np.zeros(len(first), np.int64)
            return {
                "gram": pa.array(np.concatenate((np.where(many, h, gram), first, within))), "h": pa.array(np.concatenate((h, none, within))),
                "place": pa.array(np.concatenate((place, none.astype(np.int32), piece))), "kind": pa.array(kind.astype(np.int32)),
            }

        return step

    rows = map_batches(own.select("h", "text"), "gram long, h long, place int, kind int", make)
    fields = pa.schema([("h", pa.int64()), ("place", pa.int32())])

    def meet(batches):
        got = []
        for batch in batches:
            gram, h, place, kind = (batch.column(i).to_numpy() for i in range(4))
            sure = kind == met
            if sure.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[sure]), pa.array(place[sure])], schema=fields)
            got.append((gram[~sure], h[~sure], place[~sure], kind[~sure]))
        if not got:
            return
        gram, h, place, kind = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        same = gram[1:] == gram[:-1]
        again = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(gram) else order
        again = again[kind[again] == alone]
        for s in range(0, len(again), 1 << 18):
            part = again[s : s + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(h[part]), pa.array(place[part])], schema=fields)

    return rows.repartition(parts, "gram").mapInArrow(released(meet), "h long, place int")


def _merge_intervals(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _runs(placed: DataFrame, parts: int) -> DataFrame:
    """bucket, run, covers: front-coded sorted runs of suffixes, by the hash of their k-gram.

    Equal suffixes with equal text before them, within a run, are covered at once and sent as
    one, so a passage that many texts share costs a suffix a run. A run ends after RUN_SUFFIXES,
    in the middle of a text too.
    """
    fields = pa.schema([("bucket", pa.int32()), ("run", pa.binary()), ("covers", pa.binary())])

    def write(held: list[list], covers: dict[int, list], counted: int) -> Iterator[pa.RecordBatch]:
        out = []
        for bucket, entries in enumerate(held):
            if not entries:
                continue
            entries.sort()
            kept, i = [], 0
            while i < len(entries):
                right, left = entries[i][0], entries[i][1]
                j = i + 1
                while j < len(entries) and entries[j][0] == right and entries[j][1] == left:
                    j += 1
                kept.append((*entries[i], int(j - i > 1)))
                if j - i > 1 and len(right) + len(left) >= LENGTH:
                    for _, _, h, place in entries[i:j]:
                        covers.setdefault(h, []).append((place - len(left), place + len(right)))
                i = j
            out.append((bucket, encode_run(kept), b""))
            entries.clear()
        rows = [(h, s, e) for h, found in covers.items() for s, e in _merge_intervals(found)]
        covers.clear()
        for i, s in enumerate(range(0, len(rows), 1 << 14)):
            out.append(((counted + i) % parts, b"", np.array(rows[s : s + (1 << 14)], np.int64).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    def run(batches):
        held, covers, count, written = [[] for _ in range(parts)], {}, 0, 0
        for batch in batches:
            for h, text, places in zip(*(column(batch, c) for c in ("h", "text", "places")), strict=True):
                for place in places:
                    count += 1
                    if (place + GRAM if place >= 0 else ~place + PIECE) > len(text):
                        continue  # h names another text too
                    if place < 0:
                        covers.setdefault(h, []).append((~place, ~place + PIECE))
                    else:
                        right = text[place : place + LENGTH]
                        left = text[max(0, place - REACH) : place][::-1]
                        held[xxhash.xxh3_64_intdigest(right[:GRAM]) % parts].append((right, left, h, place))
                    if count >= RUN_SUFFIXES:
                        yield from write(held, covers, written)
                        count, written = 0, written + 1
        yield from write(held, covers, written)

    return placed.mapInArrow(released(run), "bucket int, run binary, covers binary")


def _merged(runs: DataFrame, parts: int) -> DataFrame:
    """h, s, e: byte spans covered by strings found elsewhere."""
    fields = pa.schema([("h", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])

    def rows(h, s, e) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x), f.type) for x, f in zip((h, s, e), fields, strict=True)], schema=fields)

    def run(batches):
        own: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, blob, covers in zip(*(column(batch, c) for c in ("bucket", "run", "covers")), strict=True):
                if covers:
                    got = np.frombuffer(covers, np.int64).reshape(-1, 3)
                    yield rows(got[:, 0], got[:, 1], got[:, 2])
                else:
                    own.setdefault(bucket, []).append(blob)
        for blobs in own.values():
            shared, rights, found = [], [], []
            for n, right, rest in merge([decode_run(b) for b in blobs]):
                if n < GRAM and len(rights) >= RUN_SUFFIXES:
                    if got := _spans(shared, rights, found):
                        yield rows(*got)
                    shared, rights, found = [], [], []
                shared.append(n if rights else 0)
                rights.append(right)
                found.append(rest)
            if rights and (got := _spans(shared, rights, found)):
                yield rows(*got)

    return runs.repartition(parts, "bucket").mapInArrow(released(run), "h long, s int, e int")


def _spans(shared: list[int], rights: list[bytes], found: list[tuple]) -> tuple | None:
    lefts, texts, places, many = zip(*found, strict=True)
    least, most = covered(np.array(shared), rights, list(lefts), np.array(many))
    hit = np.flatnonzero(most >= 0)
    place = np.array(places)[hit]
    return (np.array(texts)[hit], place - most[hit], place - least[hit] + LENGTH) if len(hit) else None


def spans(docs: DataFrame) -> DataFrame:
    """docs as doc_id, text (bytes) and h, with the byte spans to remove, sorted and merged
    later: every byte covered by a string of LENGTH bytes that also starts elsewhere.

    1. Anchors are exchanged by the hash of their k-gram; those met once are left. 2. At the
    others, suffixes are sorted and exchanged as front-coded runs. 3. A loser tree merges the
    runs of a bucket, and neighbours in the merged order decide. Each text moves once, by h.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = _keyed(docs)
    met = _anchors_met(own, parts).groupBy("h").agg(F.collect_set("place").alias("places"))
    placed = own.join(met, "h").select("h", "doc_id", "text", "places")  # the same exchange of texts as below
    found = _merged(_runs(placed, parts), parts).groupBy("h").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return own.join(found, "h", "left")


def remaining(text: bytes, spans_: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What spans leave of a text, the bytes removed and the maximal runs of them."""
    merged = _merge_intervals(spans_)
    at, parts = 0, []
    for s, e in merged:
        parts.append(text[at:s])
        at = e
    parts.append(text[at:])
    return b"".join(parts), sum(e - s for s, e in merged), len(merged)


def _pairs(spans_: list[dict] | None) -> list[tuple[int, int]]:
    return [(x["s"], x["e"]) for x in spans_] if spans_ else []


def digest(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes and runs, and a digest of what is left, of every whole text.

    Null texts are empty; repeated rows repeat each other's strings. Texts under LENGTH bytes
    lose nothing.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = column(batch, "text")
            left = [remaining(t, _pairs(s)) for t, s in zip(texts, column(batch, "spans"), strict=True)]
            return {
                "doc_id": batch.column(0), "n_bytes": [len(t) for t in texts], "n_removed": [x[1] for x in left],
                "n_spans": [x[2] for x in left], "kept_sha256": [hashlib.sha256(x[0]).hexdigest() for x in left],
            }

        return step

    return map_batches(spans(docs).select("doc_id", "text", "spans"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)


def cut(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without the repeated spans.

    A character cut in the middle goes whole; n_chars, if there, is counted anew; a document
    of which only white space is left goes.
    """
    kinds = StructType(docs.schema.fields)
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = spans(docs).select("h", "spans").dropDuplicates(["h"])
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.xxhash64(F.col("doc_id").cast("long"), utf8()).alias("h"))
    text, chars = names[docs.columns.index("text")], names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
    source = keyed.join(found.where("spans is not null"), "h", "left").select(*names, "spans")

    def make():
        def step(batch: pa.RecordBatch) -> dict | None:
            keep, texts = [], []
            for i, (own, gone) in enumerate(zip(column(batch, text), column(batch, "spans"), strict=True)):
                if gone:
                    own = remaining(own.encode("utf-8", "surrogatepass"), _pairs(gone))[0].decode("utf-8", "ignore")
                    if not own.strip():
                        continue
                keep.append(i)
                texts.append(own)
            if not keep:
                return None
            rows = batch.take(pa.array(keep, pa.int32()))
            out = {n: rows.column(i) for i, n in enumerate(names)} | {text: texts}
            if chars:
                out[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(rows.column(names.index(chars)).type)
            return out

        return step

    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, kinds, strict=True)])
    made = map_batches(source, schema.toDDL(), make)
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
