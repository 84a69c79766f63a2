"""Byte-level BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import column, map_batches, read, utf8

#: A space after something else: every scan of the split pattern starts a piece here,
#: whatever stands around, since no piece has white space after another character.
BOUNDARY = re.compile(rb"(?<=[^\s\x80-\xff\x1c-\x1f])[ \n](?=[0-9A-Za-z])")
#: The split pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Mean chunk length is 2 ** CUT_BITS bytes; a task's cache holds up to CACHE_BYTES, where a
#: byte of text counts six with its ids.
CUT_BITS, LEAST_CHUNK, CACHE_BYTES = 9, 64, 24 << 20
_GEAR = np.random.default_rng(20240901).integers(0, 1 << 32, 256, dtype=np.uint32)


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def chunks(text: bytes) -> Iterator[bytes]:
    """Cuts text where a rolling hash of the last 32 bytes has CUT_BITS zero bits.

    Equal passages are cut alike wherever they stand. Cuts keep characters whole.
    """
    if len(text) <= LEAST_CHUNK:
        if text:
            yield text
        return
    data = np.frombuffer(text, np.uint8)
    rolling = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        older = rolling[:-shift] << np.uint32(shift)
        rolling = rolling.copy()
        rolling[shift:] += older
        if len(rolling) <= shift * 2:
            break
    cuts = np.flatnonzero((rolling >> np.uint32(32 - CUT_BITS)) == 0) + 1
    cuts = cuts[cuts < len(data)]
    cuts = cuts[(data[cuts] & 0xC0) != 0x80]
    at = 0
    for cut in cuts.tolist():
        if cut - at >= LEAST_CHUNK:
            yield text[at:cut]
            at = cut
    yield text[at:]


class ChunkEncoder:
    """Encodes as the tokenizers library does for a byte-level BPE file, chunk by chunk."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in vocabulary.items()
            if token.encode() not in self.special
        }
        merges = spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(vocabulary[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        self.core = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in [*ranks.items(), *self.special.items()]:
            self.bytes_of[i] = token
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.split = re.compile(b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.cache: dict[bytes, tuple | None] = {}
        self.held = 0

    def _plain(self, text: bytes) -> list[int]:
        return self.core.encode_ordinary(text.decode("utf-8", "replace"))

    def _chunk(self, chunk: bytes) -> tuple | None:
        """Ids of a chunk between its first and last certain boundary, encoded once.

        None: it has no two boundaries, so it is all join.
        """
        found = self.cache.get(chunk, 0)
        if found != 0:
            return found
        first = BOUNDARY.search(chunk)
        value = None
        if first:
            lo = first.start()
            hi = max(m.start() for m in BOUNDARY.finditer(chunk, lo))
            if hi > lo:
                ids = self._plain(chunk)
                ends = np.cumsum(self.sizes[ids])
                a, b = np.searchsorted(ends, (lo, hi))
                if ends[a] == lo and ends[b] == hi:  # both ends agree with the chunk's own tokens
                    value = (lo, hi, ids[a + 1 : b + 1])
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        self.cache[chunk] = value
        self.held += 6 * len(chunk)
        return value

    def encode(self, text: bytes) -> list[int]:
        """Ids of a whole text; special strings in it have their own ids."""
        if not self.split:
            return self._piece(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self._piece(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._piece(text[at:]) if at else self._piece(text)

    def _piece(self, text: bytes) -> list[int]:
        """Chunk encodings, with each join encoded anew.

        A join grows from the cut to the next certain boundary on either side, over further
        chunks if need be; there the tokens of both sides agree with those of the whole.
        """
        out: list[int] = []
        join = b""
        for chunk in chunks(text):
            if (core := self._chunk(chunk)) is None:
                join += chunk
                continue
            lo, hi, ids = core
            out += self._plain(join + chunk[:lo])
            out += ids
            join = chunk[hi:]
        if join:
            out += self._plain(join)
        return out

    def decode(self, ids: list[int]) -> str:
        own = self.bytes_of
        return b"".join([own[i] for i in ids]).decode("utf-8", "replace")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the token ids of every whole text. Null: empty, no ids."""
    path = path or default_path()

    def make():
        own = ChunkEncoder(path)

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "ids": [own.encode(t) for t in column(batch, "text")]}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")), "doc_id long, ids array<int>", make)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of ids."""
    path = path or default_path()

    def make():
        own = ChunkEncoder(path)

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "text": [own.decode(x or []) for x in column(batch, "ids")]}

        return step

    return map_batches(encoded.select(F.col("doc_id").cast("long"), "ids"), "doc_id long, text string", make)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them."""
    path = path or default_path()

    def make():
        own = ChunkEncoder(path)
        decimal = [str(i) for i in range(len(own.bytes_of))]

        def step(batch: pa.RecordBatch) -> dict:
            counts, ids_sha, text_sha = [], [], []
            for text in column(batch, "text"):
                ids = own.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return step

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), utf8().alias("text")),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        make,
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
