"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import column, map_batches, read

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Documents whose crc32(doc_id as text) leaves this remainder are never learned from.
FOLDS, HELD_OUT = 3, 1
#: The bound of the training sample, in documents, and of each document's part in it, in
#: words; features are hashed to 2 ** TABLE_BITS rows; each language's lexicon is bounded.
SAMPLE_DOCS, SAMPLE_WORDS, TABLE_BITS, LEXICON_WORDS = 3000, 256, 18, 2000
SPAN, BATCH, STEPS, RATE = 32, 64, 900, 0.3
#: Words whose scores a task keeps, words labelled at once, and words scored at once.
CACHED_WORDS, STEP_WORDS, SCORED_WORDS = 200_000, 300_000, 10_000


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def features(tokens: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for each word: flat, and where each word's begin.

    Byte n-grams of 2 to 4 of the word between marks; those with a mark are its affixes; the
    whole word; and for words of a lexicon, which lexicons hold it (a bit for each).
    """
    raw = [w.encode("utf-8", "surrogatepass") for w in tokens]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"\x01" + b"\x01".join(raw) + b"\x01", np.uint8).astype(np.uint64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))  # of each word's first mark
    owners, rows = [np.arange(len(raw))], [np.fromiter((crc32(b"=" + w) for w in raw), np.uint64, len(raw)) * np.uint64(0x9E3779B97F4A7C15)]
    code = text
    for n in (2, 3, 4):
        code = code[:-1] * np.uint64(257) + text[n - 1 :]
        counts = np.maximum(sizes + 3 - n, 0)
        owner = np.repeat(np.arange(len(raw)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        owners.append(owner)
        rows.append((code[begins[owner] + inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15))
    held = [(i, b) for i, w in enumerate(tokens) if (b := lexicon.get(w))]
    if held:
        owners.append(np.array([i for i, _ in held]))
        rows.append((np.array([b for _, b in held], np.uint64) + np.uint64(1 << 40)) * np.uint64(0x9E3779B97F4A7C15))
    owner, row = np.concatenate(owners), np.concatenate(rows) >> np.uint64(64 - TABLE_BITS)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(raw)))
    return row[order].astype(np.int64), starts


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Marginal label probabilities of each word of several sequences laid end to end."""
    ahead, _, back = _messages(scores, lengths, move)
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True)


def _messages(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: what comes from before it (with its own evidence), its evidence, and
    what comes from after it. One step serves all sequences that reach so far."""
    if not len(scores):
        return scores, scores, scores
    order = np.argsort(-lengths, kind="stable")
    size, start = lengths[order], (np.cumsum(lengths) - lengths)[order]
    shown = np.exp(scores - scores.max(axis=1, keepdims=True))
    ahead, back = np.empty_like(shown), np.empty_like(shown)
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    go = np.exp(move)
    now = None
    for t in range(longest):
        at = start[: active[t]] + t
        now = shown[at] if now is None else (now[: active[t]] @ go) * shown[at]
        now = now / now.sum(axis=1, keepdims=True)
        ahead[at] = now
    now = np.ones((0, scores.shape[1]))
    for t in range(longest - 1, -1, -1):
        at = start[: active[t]] + t
        if len(now) < len(at):
            now = np.concatenate((now, np.ones((len(at) - len(now), scores.shape[1]))))
        back[at] = now
        now = (now * shown[at]) @ go.T
        now = now / now.sum(axis=1, keepdims=True)
    return ahead, shown, back


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    move: np.ndarray
    lexicon: dict[str, int]

    def scores(self, tokens: list[str]) -> np.ndarray:
        rows, starts = features(tokens, self.lexicon)
        return np.add.reduceat(self.weights[rows], starts, axis=0).astype(np.float64)

    def label(self, tokens: list[str]) -> list[str]:
        """The likeliest label of each word of a text, which may switch languages."""
        if not tokens:
            return []
        found = forward_backward(self.scores(tokens), np.array([len(tokens)]), self.move)
        return [self.labels[i] for i in found.argmax(axis=1)]


class Predictor:
    """Scores each distinct word once, within a bound, and labels whole texts."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((1024, self.model.weights.shape[1]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and share of each text; some texts at a time, so that memory is bounded."""
        labels, shares, some, held = [], [], [], 0
        for text in texts:
            some.append(words(text))
            held += len(some[-1])
            if held >= STEP_WORDS:
                for out, new in zip((labels, shares), self._predict(some), strict=True):
                    out += new
                some, held = [], 0
        for out, new in zip((labels, shares), self._predict(some), strict=True):
            out += new
        return labels, shares

    def _predict(self, split: list[list[str]]) -> tuple[list[str], list[float]]:
        if len(self.known) > CACHED_WORDS:
            self._clear()
        known = self.known
        new = list({w for tokens in split for w in tokens if w not in known})
        if new:
            first = len(known)
            if first + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.empty((first + 2 * len(new), self.table.shape[1]))))
            for s in range(0, len(new), SCORED_WORDS):
                part = new[s : s + SCORED_WORDS]
                self.table[first + s : first + s + len(part)] = self.model.scores(part)
            known.update(zip(new, range(first, first + len(new)), strict=True))
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        out, score = [UNKNOWN] * len(split), [0.0] * len(split)
        some = np.flatnonzero(lengths)
        if len(some) and self.model.labels:
            ids = np.fromiter((known[w] for tokens in split for w in tokens), np.int64, int(lengths.sum()))
            shares = forward_backward(self.table[ids], lengths[some], self.model.move)
            sums = np.add.reduceat(shares, np.cumsum(lengths[some]) - lengths[some], axis=0)
            best = sums.argmax(axis=1)
            for i, k, s in zip(some.tolist(), best.tolist(), (sums.max(axis=1) / lengths[some]).tolist(), strict=True):
                out[i], score[i] = self.model.labels[k], min(1.0, s)
        return out, score


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Learns word features and transitions from (text, language) rows.

    Half the sequences join the words of two texts, so that transitions between languages
    are learned too.
    """
    random = np.random.default_rng(seed)
    rows = sorted(set(rows))
    labels = sorted({lang for _, lang in rows})
    split = [(tokens, labels.index(lang)) for text, lang in rows if (tokens := words(text))]
    if not split:
        return Model([], np.zeros((1 << TABLE_BITS, 1)), np.zeros((1, 1)), {})
    for i, (tokens, k) in enumerate(split):
        if len(tokens) > SAMPLE_WORDS:
            at = int(random.integers(0, len(tokens) - SAMPLE_WORDS + 1))
            split[i] = (tokens[at : at + SAMPLE_WORDS], k)
    lexicon: dict[str, int] = {}
    for k in range(len(labels)):
        seen: dict[str, int] = {}
        for tokens, own in split:
            if own == k:
                for w in set(tokens):
                    seen[w] = seen.get(w, 0) + 1
        for w in sorted((w for w in seen if seen[w] > 1), key=lambda w: (-seen[w], w))[:LEXICON_WORDS]:
            lexicon[w] = lexicon.get(w, 0) | 1 << (k % 40)
    vocabulary = sorted({w for tokens, _ in split for w in tokens})
    rows_of, starts = features(vocabulary, lexicon)
    ends = np.append(starts[1:], len(rows_of))
    place = {w: i for i, w in enumerate(vocabulary)}
    coded = [(np.array([place[w] for w in tokens]), k) for tokens, k in split]
    by_label = [[c for c in coded if c[1] == k] for k in range(len(labels))]
    weights = np.zeros((1 << TABLE_BITS, len(labels)))
    move = np.zeros((len(labels), len(labels)))
    seen_w, seen_m = np.full(weights.shape, 1e-6), np.full(move.shape, 1e-6)

    def span(k: int, size: int) -> np.ndarray:
        own = by_label[k][int(random.integers(len(by_label[k])))][0]
        at = int(random.integers(0, max(1, len(own) - size + 1)))
        return own[at : at + size]

    present = [k for k in range(len(labels)) if by_label[k]]
    for step in range(STEPS):
        parts, truth, lengths = [], [], []
        for i in range(BATCH):
            a = present[int(random.integers(len(present)))]
            pieces = [(a, span(a, SPAN))]
            if i % 2:
                b = present[int(random.integers(len(present)))]
                pieces = [(a, span(a, SPAN // 2)), (b, span(b, SPAN // 2))]
            for k, piece in pieces:
                parts.append(piece)
                truth.append(np.full(len(piece), k))
            lengths.append(sum(len(p) for _, p in pieces))
        ids, gold, lengths = np.concatenate(parts), np.concatenate(truth), np.array(lengths)
        counts = ends[ids] - starts[ids]
        flat = np.repeat(starts[ids], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        used = rows_of[flat]
        scores = np.add.reduceat(weights[used], np.cumsum(counts) - counts, axis=0)
        ahead, shown, back = _messages(scores, lengths, move)
        share = ahead * back
        wrong = -share / share.sum(axis=1, keepdims=True)
        wrong[np.arange(len(gold)), gold] += 1
        owner = np.repeat(np.arange(len(ids)), counts)
        distinct, slot = np.unique(used, return_inverse=True)
        slope = np.stack([np.bincount(slot, wrong[owner, k], len(distinct)) for k in range(len(labels))], axis=1) / BATCH
        seen_w[distinct] += slope**2
        weights[distinct] += RATE * 0.3 * slope / np.sqrt(seen_w[distinct])
        joined = np.ones(len(ids), bool)
        joined[np.cumsum(lengths) - 1] = False
        pair = np.zeros(move.shape)
        at = np.flatnonzero(joined)
        np.add.at(pair, (gold[at], gold[at + 1]), 1)
        pair -= _pair_shares(ahead[at], (shown * back)[at + 1], move)
        pair /= BATCH
        seen_m += pair**2
        move += RATE * 0.3 * pair / np.sqrt(seen_m)
    return Model(labels, weights.astype(np.float32), move, lexicon)


def _pair_shares(before: np.ndarray, after: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected transitions between neighbouring words, from the messages on both sides."""
    joint = before[:, :, None] * after[:, None, :] * np.exp(move)[None]
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the documents that aren't held out and have a language.

    It learns from about sample_docs of them, dealt by a hash of doc_id (the documented bound
    of the sample), never from held-out ones.
    """
    own = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = own.select("lang").count()
    share = min(1.0, sample_docs / max(n, 1))
    rows = own.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000 + 1))
    order = F.xxhash64("doc_id", "text", "lang", F.lit("sample"))
    return fit([(r.text, r.lang) for r in rows.orderBy(order).select("text", "lang").limit(2 * sample_docs).toLocalIterator()])


def _with_language(source: DataFrame, model: Model, schema: str, text: str, finish) -> DataFrame:
    """What `finish` makes of batches of source, the language of their texts and its score."""
    shared = source.sparkSession.sparkContext.broadcast(model)

    def make():
        own = Predictor(shared.value)

        def step(batch: pa.RecordBatch) -> dict | None:
            return finish(batch, *own.predict(column(batch, text)))

        return step

    return map_batches(source, schema, make)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Language and its share of the words of every whole text: `und` and 0 without letters.

    Columns: doc_id, held_out, lang_pred, score. Null doc_ids aren't held out.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def finish(batch: pa.RecordBatch, label: list, score: list) -> dict:
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": label, "score": score}

    return _with_language(source, model, "doc_id long, held_out boolean, lang_pred string, score double", "text", finish)


def keep(docs: DataFrame, model: Model, languages: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """The documents, with all their columns, whose language is known (and, if given, listed)
    and holds at least the share `least` of their words. A model that could learn no language
    rejects only texts without a letter."""
    if not model.labels:
        return docs.where(F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"\p{L}"))
    allowed = None if languages is None else set(languages)

    def finish(batch: pa.RecordBatch, label: list, score: list) -> dict | None:
        good = [i for i, (x, s) in enumerate(zip(label, score, strict=True)) if x != UNKNOWN and s >= least and (allowed is None or x in allowed)]
        rows = batch.take(pa.array(good, pa.int32()))
        return {f.name: rows.column(i) for i, f in enumerate(rows.schema)} if good else None

    return _with_language(docs, model, StructType(docs.schema.fields).toDDL(), "text", finish)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
