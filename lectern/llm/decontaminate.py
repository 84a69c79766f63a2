"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import WORD, Scratch, column, map_batches, read, utf8, words

WINDOW = 10
#: Test words in one automaton (about 90 MB in a Python worker). More test items make more
#: automata, one pass each.
BLOCK_WORDS = 100_000
#: How the names of items with and without an id start.
NAMED, NAMELESS = "=", "?"


class SuffixAutomaton:
    """All word sequences within the items, with the items that hold each window.

    A window is `window` consecutive words of an item; an item of fewer words, but not
    none, is one window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs = set()
        coded = []
        for item, tokens in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens]
            pairs.update(zip(ids, ids[1:], strict=False))
            coded.append((item, ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.pairs = np.array(sorted(a * max(len(self.vocabulary), 1) + b for a, b in pairs), np.int64)
        self.sizes = sorted({min(len(ids), window) for _, ids in coded if ids})
        self.holders: dict[tuple[int, int], set[str]] = {}
        for item, ids in coded:
            size = min(len(ids), window)
            state = at = 0
            for c in ids:
                state, at = self._step(state, at, c)
                if size and at >= size:
                    self.holders.setdefault((self._suffix(state, size), size), set()).add(item)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        state = self._new(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return state

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _step(self, state: int, at: int, c: int) -> tuple[int, int]:
        """The state and the longest matching length after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            at = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], at + 1
        return 0, 0

    def _suffix(self, state: int, size: int) -> int:
        """The state of the last `size` words of what `state` stands for."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, tokens: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside an occurrence of a window, and the items concerned."""
        hit, found = np.zeros(len(tokens), bool), set()
        if not self.sizes:
            return hit, found
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        for start, end in self._runs(ids):
            state = at = 0
            for i in range(start, end):
                state, at = self._step(state, at, int(ids[i]))
                for size in self.sizes:
                    if at < size:
                        break
                    if items := self.holders.get((self._suffix(state, size), size)):
                        hit[i - size + 1 : i + 1] = True
                        found |= items
        return hit, found

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches whose neighbouring words all stand side by side in some item.

        No window reaches over their ends, so only they need the automaton.
        """
        known = ids >= 0
        if not known.any():
            return []
        joined = np.zeros(len(ids) + 1, bool)
        if len(self.pairs) and len(ids) > 1:
            codes = ids[:-1] * len(self.vocabulary) + ids[1:]
            at = np.searchsorted(self.pairs, codes)
            at[at == len(self.pairs)] = 0
            joined[1:-1] = (self.pairs[at] == codes) & known[:-1] & known[1:]
        starts = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        keep = ends - starts >= self.sizes[0]
        return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def blocks_of(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with their words, in blocks of at most block_words; one block at a time is held.

    An item of more words is cut to pieces that overlap by all but one word of a window, so
    each of its windows is whole in one of them. A first character tells items with an
    id from those without, which are named by their number.
    """
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), utf8().alias("text"))
    block_words = max(block_words, window)
    step = block_words - window + 1
    for k, row in enumerate(rows.toLocalIterator()):
        tokens = words(bytes(row.text))
        item = f"{NAMELESS}{k}" if row.item_id is None else NAMED + row.item_id
        for at in range(0, max(1, len(tokens) - window + 1) if tokens else 0, step):
            piece = tokens[at : at + block_words]
            if block and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += len(piece)
    yield block


#: The automaton that this Python worker built last, and the block it is of.
_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, block: list[tuple[str, list[bytes]]], window: int) -> SuffixAutomaton:
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton(block, window)
    return _built[key]


def _marked(rows: DataFrame, items: DataFrame, window: int, block_words: int, finish, schema: str, text: str) -> DataFrame:
    """What `finish` makes of batches of rows and their spans and items found.

    A block's words are broadcast (they are few megabytes); each worker builds the automaton of
    the block at hand alone. With more blocks than one, each but the last is a streaming pass
    whose finds are written beside the rows, so no pass holds two automata.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    spans, found = "_spans", "_items"
    while {spans, found} & set(rows.columns):
        spans, found = f"_{spans}", f"_{found}"
    now = rows.withColumns({spans: F.array().cast("array<int>"), found: F.array().cast("array<string>")})
    blocks = blocks_of(items, window, block_words)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared, key = spark.sparkContext.broadcast(block), uuid4().hex

        def make(shared=shared, key=key, last=after is None):
            automaton = _automaton(key, shared.value, window)

            def step(batch: pa.RecordBatch) -> dict | None:
                hits, held = [], []
                texts = column(batch, text)
                for own, old, before in zip(texts, column(batch, spans), column(batch, found), strict=True):
                    raw = own if isinstance(own, bytes) else (own or "").encode("utf-8", "surrogatepass")
                    hit, more = automaton.scan(words(raw))
                    for a, b in zip(old[::2], old[1::2], strict=True):
                        hit[a:b] = True
                    hits.append(_runs_of(hit) if more or old else [])
                    held.append(sorted(more.union(before)) if more else before)
                if last:
                    return finish(batch, texts, hits, held)
                return {f.name: batch.column(i) for i, f in enumerate(batch.schema)} | {spans: hits, found: held}

            return step

        if after is None:
            return map_batches(now, schema, make)
        now = scratch.save(map_batches(now, StructType(now.schema.fields).toDDL(), make))
        scratch.drop(now)
        block = after


def _runs_of(hit: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()


def digest(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Counts of a document's words and hits, and a digest of the ids of its items.

    Null texts: no words; null doc_ids and repeated rows stay as they are. Items without words
    match nothing; the windows of an item without an id hit, and it counts, but has no id to
    digest. Rows of one item_id are one item.
    """

    def finish(batch: pa.RecordBatch, texts: list[bytes], spans: list[list[int]], items: list[list[str]]) -> dict:
        hits = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        return {
            "doc_id": batch.column(0),
            "n_words": [len(words(t)) for t in texts],
            "n_hit": hits,
            "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(sorted(i[1:] for i in x if i.startswith(NAMED))).encode("utf-8", "surrogatepass")).hexdigest() for x in items],
            "contaminated": [h > 0 for h in hits],
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return _marked(rows, items, window, block_words, finish, schema, "text")


def cut(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Removes the spans found from the texts, and documents covered beyond max_coverage.

    Returns the columns of docs; n_chars, if there, is counted anew. Words that stand
    outside the spans keep the characters between them.
    """
    columns = docs.columns

    def finish(batch: pa.RecordBatch, texts: list[str | None], spans: list[list[int]], items: list[list[str]]) -> dict:
        keep, kept = [], []
        for i, (text, runs) in enumerate(zip(texts, spans, strict=True)):
            if runs:
                raw = text.encode("utf-8", "surrogatepass")
                places = [m.span() for m in WORD.finditer(raw.lower())]
                if sum(runs[1::2]) - sum(runs[::2]) > max_coverage * len(places):
                    continue
                at, parts = 0, []
                for a, b in zip(runs[::2], runs[1::2], strict=True):
                    parts.append(raw[at : places[a][0]])
                    at = places[b - 1][1]
                text = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            keep.append(i)
            kept.append(text)
        rows = batch.take(pa.array(keep, pa.int32()))
        out = {c: rows.column(rows.schema.get_field_index(c)) for c in columns}
        out["text"] = pa.array(kept, pa.string())
        if "n_chars" in out:
            out["n_chars"] = pa.array([None if t is None else len(t) for t in kept], pa.int64()).cast(out["n_chars"].type)
        return out

    return _marked(docs, items, window, block_words, finish, StructType(docs.schema.fields).toDDL(), "text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
