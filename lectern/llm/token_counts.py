"""Token counts of every prefix by dynamic programming over BPE with word ends."""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import byte_letters
from lectern.llm.common import column, map_batches, read

LIMIT = 2048
#: Words whose prefix counts are kept by a task.
CACHED_WORDS = 800_000
#: Pairs of tokens of which a task remembers whether they may stand side by side.
MOST_FITS = 500_000
#: Bytes at the start of words whose tables are kept.
HEAD = 6
#: The split pattern of the word vocabulary (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters on which every Unicode release and library agrees; others go through the
#: tokenizers library's own normaliser and splitter.
UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7E\xA1-ȶ‐-…€]")


class PrefixCounter:
    """Exact token counts at every prefix of a word, and from these of a text.

    In BPE, the tokens before the last one are the encoding of the prefix before it. So the
    last token of each prefix is the one token that ends there and is compatible with the
    last token of the prefix before it, and its count is that prefix's count and one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.library = Tokenizer.from_file(path)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.parts: list[tuple[bytes, bool]] = [(b"", False)] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in spec["model"]["vocab"].items():
            if token in self.special:
                continue
            last = token.endswith(self.end) and token != self.end
            raw = bytes(letters[c] for c in (token.removesuffix(self.end) if last else token))
            (self.final if last else self.inner)[raw] = i
            self.parts[i] = (raw, last)
        vocabulary = spec["model"]["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.fits: dict[tuple[int, int], bool] = {}
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.heads: dict[bytes, tuple[list[int], list[int]]] = {}

    def _merge(self, raw: bytes, last: bool) -> list[int]:
        """Plain BPE of a few bytes; settles which two tokens may stand side by side."""
        ids = [self.inner[raw[i : i + 1]] for i in range(len(raw))]
        if last:
            ids[-1] = self.final[raw[-1:]]
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 60, 0)) + (k,) for k, p in enumerate(zip(ids, ids[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            a, b = ids[best[2]], ids[best[2] + 1]
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and ids[k] == a and ids[k + 1] == b:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _fit(self, before: int, token: int) -> bool:
        """Whether BPE leaves these two side by side; before -1: at the start."""
        found = self.fits.get((before, token))
        if found is None:
            raw, last = self.parts[token]
            if before < 0:
                found = self._merge(raw, last) == [token]
            else:
                found = self._merge(self.parts[before][0] + raw, last) == [before, token]
            if len(self.fits) >= MOST_FITS:
                self.fits.clear()
            self.fits[before, token] = found
        return found

    def prefix_counts(self, word: bytes) -> list[int]:
        """Tokens of word[:i] for each i from 0 to its length, each prefix a word of its own."""
        inner, final = self.inner, self.final
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        out = [0] * (n + 1)
        for i in range(1, n + 1):
            out[i] = self._last(final, word, i, last, count)[1]
            if i < n:
                last[i], count[i] = self._last(inner, word, i, last, count)
        return out

    def _last(self, tokens: dict[bytes, int], word: bytes, i: int, last: list[int], count: list[int]) -> tuple[int, int]:
        fits = self.fits
        for j in range(max(0, i - self.longest), i):
            token = tokens.get(word[j:i])
            if token is not None:
                fit = fits.get((last[j], token))
                if fit or (fit is None and self._fit(last[j], token)):
                    return token, count[j] + 1
        raise ValueError(f"no encoding of {word[:i]!r}")

    def _begun(self, head: bytes) -> tuple[list[int], list[int]]:
        """The tables up to a word's first few bytes, which many words share."""
        found = self.heads.get(head)
        if found is None:
            if not head:
                return [-1], [0]
            last, count = self._begun(head[:-1])
            last, count = [*last, -1], [*count, 0]
            last[-1], count[-1] = self._last(self.inner, head, len(head), last, count)
            found = last, count
            if len(self.heads) < CACHED_WORDS // 2:
                self.heads[head] = found
        return found

    def word(self, word: str) -> int:
        """Tokens of a whole word: the last step of the recurrence alone needs word ends."""
        found = self.counts.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                raw = word.encode()
                n = len(raw)
                last, count = self._begun(raw[: min(n - 1, HEAD)])
                last, count = [*last, *[-1] * (n + 1 - len(last))], [*count, *[0] * (n + 1 - len(count))]
                for i in range(min(n - 1, HEAD) + 1, n):
                    last[i], count[i] = self._last(self.inner, raw, i, last, count)
                found = self._last(self.final, raw, n, last, count)[1]
            if len(self.counts) >= CACHED_WORDS // 2:
                self.older, self.counts = self.counts, {}
            self.counts[word] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """The words of a text, as the library normalises and splits it."""
        if UNUSUAL.search(text):
            letters = byte_letters()
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(letters[c] for c in piece).decode() for piece, _ in pieces]
        return PIECES.findall(text.lower())

    def _segments(self, text: str) -> list[str | None]:
        """Text between special strings; None for each of these."""
        if not self.specials or "<|" not in text:
            return [text]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [text[at : m.start()], None]
            at = m.end()
        return [*out, text[at:]]

    def total(self, text: str) -> int:
        n, known, word = 0, self.counts, self.word
        for segment in self._segments(text):
            if segment is None:
                n += 1
            else:
                n += sum([known.get(p) or word(p) for p in self.pieces(segment)])
                known = self.counts
        return n

    def table(self, text: str) -> tuple[list[str | None], list[int]]:
        """The text's words (None: a special string) and the count at each one's end."""
        pieces: list[str | None] = []
        for segment in self._segments(text):
            pieces += [None] if segment is None else self.pieces(segment)
        sums, n = [], 0
        for p in pieces:
            n += 1 if p is None else self.word(p)
            sums.append(n)
        return pieces, sums

    def fit(self, text: str, budget: int) -> tuple[int, int, int]:
        """The longest prefix within a budget: whole words, bytes of the next one, tokens.

        Answered from the stored counts; nothing is encoded again.
        """
        from bisect import bisect_right

        pieces, sums = self.table(text)
        k = bisect_right(sums, budget)
        used = sums[k - 1] if k else 0
        if k == len(pieces) or pieces[k] is None:
            return k, 0, used
        raw = pieces[k].encode()
        inside = self.prefix_counts(raw)
        i = max(i for i, c in enumerate(inside) if used + c <= budget and (i == len(raw) or raw[i] & 0xC0 != 0x80))
        return k, i, used + inside[i]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """UTF-8 bytes and exact tokens of every whole text; null: empty, no tokens."""
    path = path or default_path()

    def make():
        own = PrefixCounter(path)

        def step(batch: pa.RecordBatch) -> dict:
            texts = column(batch, "text")
            tokens = [own.total(t) for t in texts]
            return {
                "doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens, "over_limit": [n > limit for n in tokens],
            }

        return step

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return map_batches(
        docs.select(F.col("doc_id").cast("long"), text),
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
        make,
    )


def fit_budget(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """For each document the longest prefix of at most `budget` tokens: its whole words,
    the bytes of the next word and its tokens, counted on the normalised text."""
    path = path or default_path()

    def make():
        own = PrefixCounter(path)

        def step(batch: pa.RecordBatch) -> dict:
            k, i, n = zip(*[own.fit(t, budget) for t in column(batch, "text")], strict=True)
            return {"doc_id": batch.column(0), "n_pieces": list(k), "n_more_bytes": list(i), "n_tokens": list(n)}

        return step

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return map_batches(
        docs.select(F.col("doc_id").cast("long"), text),
        "doc_id long, n_pieces long, n_more_bytes long, n_tokens long",
        make,
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
