"""SentencePiece BPE encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import column, map_batches, read, utf8

#: The mark that stands for a space in pieces (fixed value).
MARK = "▁"
#: Code points that merge rounds take at once; longer words go through an agenda, for a round
#: takes one rank of a word and looks at all of it.
ROUND_CHARS, LONG_WORD = 1 << 20, 2000
#: Words and ids that a task remembers, and may exceed by those of a batch.
CACHE_WORDS, CACHE_IDS = 400_000, 4 << 20
_NONE = np.iinfo(np.int32).max

# The library writes one replacement character for each byte that decodes to nothing.
codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at starts, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def word_pattern(pieces: dict[str, int]) -> re.Pattern:
    """What finds the words of a text: stretches that no piece joins to their neighbours.

    Words start at marks, for no piece has a mark after anything else. ASCII signs are words
    apart from other characters where no piece holds both, and so are characters in no piece.
    """
    signs = {chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()} & set(pieces)
    met = [(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False) if MARK not in (a, b)]
    while mixed := {c for a, b in met if (a in signs) != (b in signs) for c in (a, b) if c in signs}:
        signs -= mixed
    alone = {chr(c) for c in range(0x80)} - set(pieces)
    listed = ["".join(map(re.escape, sorted(x))) for x in (signs, alone)]
    own = [f"{MARK}*[{x}]+" if k == 0 else f"[{x}]+" for k, x in enumerate(listed) if x]
    return re.compile("|".join([*own, f"{MARK}*[^{MARK}{''.join(listed)}]+", f"{MARK}+"]))


class PieceEncoder:
    """Encodes and decodes as the sentencepiece library does for a BPE model with byte fallback.

    Merging takes the pair of the best score, and of equal ones the leftmost, until no pair
    makes a piece. Words can't share a piece, so each is merged by itself; equal words once.
    """

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        names = [own.id_to_piece(i) for i in range(n)]
        kind = [0 if own.is_byte(i) else 1 if own.is_control(i) else 2 if own.is_unknown(i) else 3 for i in range(n)]
        self.eos, self.size = own.eos_id(), n
        self.byte = [names.index(f"<0x{b:02X}>") for b in range(256)]
        pieces = {names[i]: i for i in range(n) if kind[i] == 3}
        if own.normalize(" a  éﬁ\t") != f"{MARK}{MARK}a{MARK}{MARK}éﬁ\t" or own.normalize("") or any(own.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: only models that leave texts as they are, but for a mark before them, are supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or not {c for p in pieces for c in p} <= set(pieces):
            raise ValueError(f"{path}: pieces cross words, or have characters that are no pieces")
        self.word = word_pattern(pieces)
        self.bytes_of = [b"" if k == 1 else " ⁇ ".encode() if k == 2 else x.replace(MARK, " ").encode() for x, k in zip(names, kind, strict=True)]
        for b, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([b])
        self.normal = [k == 3 for k in kind]
        self.silent = frozenset(i for i in range(n) if kind[i] == 1)

        # Ranks: 0 for the best score; pieces of equal scores share one.
        scores = {p: own.get_score(i) for p, i in pieces.items()}
        place = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {p: place[s] for p, s in scores.items()}
        pairs, unsafe = {}, set()
        for p, i in pieces.items():
            for k in range(1, len(p)):
                x, y = p[:k], p[k:]
                if x in pieces and y in pieces:
                    pairs[pieces[x] * n + pieces[y]] = (rank[p], i)
                    # Where a longer piece goes before its part, a merge may open a better pair.
                    unsafe.update(rank[q] for q in (x, y) if len(q) > 1 and rank[p] <= rank[q])
        self.pairs = pairs
        self._table(pairs)
        self.unsafe = np.zeros(len(place) + 1, bool)
        self.unsafe[list(unsafe)] = True
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.forget()

    def _symbols(self, text: str) -> np.ndarray:
        """A symbol a code point: its piece, or -1 - the code point where it has none."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found = self.of_char[points].astype(np.int64)
        return np.where(found < 0, -1 - points, found)

    def _table(self, pairs: dict[int, tuple[int, int]]) -> None:
        """An open-addressed table of pairs, at most an eighth full, for whole arrays of look-ups."""
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 1, -1, np.int64)
        self.ranks = np.full((1 << bits) + 1, _NONE, np.int32)
        self.made = np.full((1 << bits) + 1, -1, np.int32)
        known = np.array(list(pairs), np.int64)
        for key, slot in zip(known.tolist(), self._slot(known).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = slot + 1 & (1 << bits) - 1
            self.keys[slot] = key
            self.ranks[slot], self.made[slot] = pairs[key]
        self.none = 1 << bits  # the slot of pairs that make no piece

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; no rank where the pair makes no piece."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -2)
        at = np.where(key < 0, self.none, self._slot(key))
        there = self.keys[at]
        probe = np.flatnonzero((there != key) & (there >= 0))
        at[(there < 0)] = self.none
        while len(probe):
            at[probe] = at[probe] + 1 & self.none - 1
            there = self.keys[at[probe]]
            at[probe[there < 0]] = self.none
            probe = probe[(there >= 0) & (there != key[probe])]
        return self.ranks[at], self.made[at]

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words (none empty) once no pair is left, and how many each word has.

        All words lie in one flat array. A round finds the least pair rank of each word and
        merges all its pairs of that rank, leftmost first where they overlap; only the leftmost
        one where the piece made could at once be part of a better pair. That is the order in
        which one pair at a time would go. Merged-away symbols and finished words are taken out.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self._symbols("".join(words))
        ids = np.arange(len(words))  # of the words still open
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            word = np.repeat(np.arange(len(ids)), sizes)
            rank = np.full(len(sym), _NONE, np.int32)
            made = np.full(len(sym), -1, np.int32)
            rank[:-1], made[:-1] = self._look(sym[:-1], sym[1:])
            rank[starts + sizes - 1] = _NONE  # a word's last symbol has no right neighbour
            best = np.minimum.reduceat(rank, starts)
            over = best == _NONE
            if over.any():
                stay = ~over[word]
                done.append((ids[over], sizes[over], sym[~stay]))
                renumber = np.cumsum(~over) - 1
                sym, rank, made, word = sym[stay], rank[stay], made[stay], renumber[word[stay]]
                ids, sizes, best = ids[~over], sizes[~over], best[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best[word])
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            # Of pairs that overlap in a row, every other one is merged.
            opens = first | np.r_[True, at[1:] != at[:-1] + 1]
            since = at - at[np.flatnonzero(opens)][np.cumsum(opens) - 1]
            at = at[(since % 2 == 0) & (first | ~self.unsafe[rank[at]])]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sizes = sizes - np.bincount(word[at], minlength=len(ids))
            sym = sym[keep]
        if not done:
            return sym, sizes
        ids, sizes, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(ids)
        starts = (np.cumsum(sizes) - sizes)[order]
        return sym[_ranges(starts, sizes[order])], sizes[order]

    def agenda(self, word: str) -> list[int]:
        """Symbols of one word, merged pair by pair from a heap: n log n for any length."""
        sym = self._symbols(word).tolist()
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (found := self.pairs.get(sym[i] * self.size + sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, x, y, piece = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or sym[i] != x or sym[j] != y:
                continue
            sym[i], gone[j], after[i] = piece, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def _spelt(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: characters without a piece become the pieces of their bytes."""
        odd = np.flatnonzero(sym < 0)
        if not len(odd):
            return sym, sizes
        points = -1 - sym[odd]
        raw = np.frombuffer("".join(map(chr, points.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        times = np.ones(len(sym), np.int64)
        times[odd] = width
        out = np.repeat(sym, times)
        out[out < 0] = np.array(self.byte)[raw]
        word = np.repeat(np.arange(len(sizes)), sizes)
        return out, np.bincount(word, weights=times, minlength=len(sizes)).astype(np.int64)

    def learn(self, words: list[str]) -> None:
        """Appends the ids of words to the table, in their order."""
        group: list[str] = []
        size = 0
        for w in words:
            if size > ROUND_CHARS or group and len(w) > LONG_WORD:
                self._put(*self.merge_rounds(group))
                group, size = [], 0
            if len(w) > LONG_WORD:
                sym = np.array(self.agenda(w), np.int64)
                self._put(sym, np.array([len(sym)]))
            else:
                group.append(w)
                size += len(w)
        if group:
            self._put(*self.merge_rounds(group))

    def _put(self, sym: np.ndarray, sizes: np.ndarray) -> None:
        ids, sizes = self._spelt(sym, sizes)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def forget(self) -> None:
        """An empty table of words: each gets the next number, and under it lie its ids."""
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.starts, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def encode(self, texts: list[str], end: bool = False) -> list[list[int]]:
        """Ids of whole texts, with the end id if asked."""
        if len(self.index) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self.forget()
        number, known = self.index.__getitem__, len(self.index)
        words = [np.array(list(map(number, self.word.findall(MARK + t.replace(" ", MARK)))) if t else [], np.int64) for t in texts]
        self.learn(list(islice(self.index, known, None)))
        out = []
        for which in words:
            ids = self.flat[_ranges(self.starts[which], self.sizes[which])].tolist()
            if end:
                ids.append(self.eos)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that stands for the first mark.

        Ids without a text (begin, end) end a run of bytes.
        """
        own = self.bytes_of
        if ids and not own[ids[-1]]:
            ids = ids[:-1]
        if not self.silent.isdisjoint(ids):
            cuts = [-1, *(k for k, i in enumerate(ids) if i in self.silent), len(ids)]
            parts = [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
            parts = [p for p in parts if p]
            return "".join([self._decode(p, k == 0) for k, p in enumerate(parts)])
        return self._decode(ids, True)

    def _decode(self, ids: list[int], first: bool) -> str:
        own = self.bytes_of
        raw = b"".join([own[i] for i in ids])
        if first and raw[:1] == b" " and self.normal[ids[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "each_byte")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, end: bool = False) -> DataFrame:
    """doc_id and the piece ids of every whole text, with the end id if asked. Null: empty.

    Rows are encoded one by one: repeated ids, ties and extra columns change nothing.
    """
    path = path or default_path()

    def make():
        own = PieceEncoder(path)

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "ids": own.encode([t.decode() for t in column(batch, "text")], end)}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")), "doc_id long, ids array<int>", make)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of ids; null ids are none."""
    path = path or default_path()

    def make():
        own = PieceEncoder(path)

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "text": [own.decode(x or []) for x in column(batch, "ids")]}

        return step

    return map_batches(encoded.select(F.col("doc_id").cast("long"), "ids"), "doc_id long, text string", make)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number of ids, the end id too, and digests of the ids and of the text decoded from them."""
    path = path or default_path()

    def make():
        own = PieceEncoder(path)
        decimal = [str(i) for i in range(own.size)]

        def step(batch: pa.RecordBatch) -> dict:
            counts, ids_sha, text_sha = [], [], []
            for ids in own.encode([t.decode() for t in column(batch, "text")], end=True):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return step

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), utf8().alias("text")),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        make,
    )


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
