"""Operators with one right answer, against brute force, over awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, jaccard, suffixes, token_counts
from tests.llm import brute

DOCS = "doc_id long, text string, extra string, `h` int, `n_chars` int"


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def awkward(seed, n=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé \n") for _ in range(500)) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (None, "no id"), (5, "x" * 199), (6, "x" * 450), (7, "ab" * 300), (8, "\0" * 260), (8, "\0" * 260)]
    for i in range(10, 10 + n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            t[r.randrange(len(t))] = r.choice("xyzßЖ")
        a = r.randrange(0, 200)
        rows.append((r.choice([i, i, 50]), "".join(t)[a : a + r.randrange(50, 500)]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN_SUFFIXES", 40)
    rows = awkward(seed)
    found = got(suffixes.digest(frame(spark, rows).repartition(4)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(brute.repeats(rows), key=repr)


def periodic(seed):
    """Texts with periodic stretches of many lengths, whole, cut and between other bytes."""
    r = random.Random(seed)
    units = ["a", "ab", "aab", "".join(r.choice("ab") for _ in range(7)), "".join(r.choice("xyz") for _ in range(59)), "".join(r.choice("xyz") for _ in range(61))]
    noise = ["".join(r.choice("cdefgh") for _ in range(400)) for _ in range(3)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(r.randrange(1, 4)):
            unit, at = r.choice(units), r.randrange(60)
            parts.append((unit * 900)[at : at + r.choice([150, 199, 200, 201, 260, 339, 340, 341, 400, 800])])
            parts.append(r.choice(noise)[: r.choice([0, 1, 50, 150])])
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffixes_of_periodic_texts(spark, seed):
    rows = periodic(seed)
    found = got(suffixes.digest(frame(spark, rows).repartition(3)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(brute.repeats(rows), key=repr)
    alone = rows[:1]
    assert got(suffixes.digest(frame(spark, alone)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(alone)


def test_anchors_of_slices_and_of_periodic_texts(monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice("abcd") for _ in range(5000)).encode()
    (_, whole, hashes, _), = suffixes.anchors([text])
    for t, few in ((b"a" * 3_000_000, 2_000), (b"ab" * 1_500_000, 1_000)):
        (_, places, _, pieces), = suffixes.anchors([t])
        assert len(places) < few  # not one a byte
        reached = np.zeros(len(t), bool)
        for p in pieces.tolist():
            reached[p : p + suffixes.PIECE] = True
        assert reached[: -suffixes.REACH].all()  # what is left is found by the anchors kept
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 700)
    (_, places, again, pieces), = suffixes.anchors([text])
    assert (places == whole).all() and (again == hashes).all() and not len(pieces)


def test_suffixes_of_a_long_periodic_text(spark):
    rows = [(1, "a" * 3_000_000), (2, "xyz" + "a" * 200 + "w"), (3, "q" * 100 + "ab" * 1_000_000), (4, "a" * 199 + "b")]
    found = got(suffixes.digest(frame(spark, rows).repartition(4)), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert found == [(1, 3_000_000, 3_000_000, 1), (2, 204, 200, 1), (3, 2_000_100, 2_000_000, 1), (4, 200, 0, 0)]


def test_suffix_parts():
    r = random.Random(5)
    lists = [sorted("".join(r.choice("ab\0") for _ in range(r.randrange(0, 12))).encode() for _ in range(r.randrange(0, 30))) for _ in range(5)]
    runs = [suffixes.encode_run([(t, t[:3], 7, k, 0) for k, t in enumerate(own)]) for own in lists]
    merged = list(suffixes.merge([suffixes.decode_run(x) for x in runs]))
    assert [m[1] for m in merged] == sorted(t for own in lists for t in own)
    for a, b in zip(merged, merged[1:], strict=False):
        assert b[0] == suffixes.common_prefix(a[1], b[1], 0)
    assert list(suffixes.merge([])) == []


def test_suffix_cut_keeps_columns(spark):
    passage = "".join(random.Random(3).choice("abcdefgh ") for _ in range(300))
    rows = [(1, "start one " + passage + "é end"), (2, passage), (3, "clean text"), (4, None), (5, passage)]
    out = {r.doc_id: r for r in suffixes.cut(frame(spark, rows)).collect()}
    assert out[1].text == "start one é end" and out[1].n_chars == len(out[1].text)
    assert 2 not in out and 5 not in out and out[3].text == "clean text" and out[4].text is None
    assert suffixes.cut(frame(spark, rows)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_decontamination_counts_ids_of_any_characters(spark):
    rows, items = [(1, "one two three solo")], [("\0a", "one two"), ("?b", "solo"), ("=c", "three"), (None, "two three")]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert got(decontaminate.digest(frame(spark, rows), bench), *columns) == brute.windows(rows, items)


def test_decontamination(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, long), (2, "short item here"), (3, ""), (4, None), (5, "ONE two"), (6, "solo"), (7, long), (None, "lost words")]
    rows = [
        (1, "x " + long.upper() + " y"), (2, "a, short-item; here b one two"), (3, None), (4, "three four five six seven eight nine ten eleven"), (5, "solo é solo"), (5, "solo é solo"),
        (6, "two three four five six seven eight nine ten eleven twelve and short item"), (None, "lost words"), (7, "éone two"), (8, "one two three four five six seven eight nine ten nine ten eleven twelve"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(brute.windows(rows, items), key=repr)
    assert got(decontaminate.digest(frame(spark, rows), bench), *columns) == want
    for size in (1, 11, 16):  # long items are cut to pieces, and there are blocks in plenty
        assert got(decontaminate.digest(frame(spark, rows), bench, block_words=size), *columns) == want
    empty = bench.where("false")
    assert {r.n_hit for r in decontaminate.digest(frame(spark, rows), empty).collect()} == {0}
    assert decontaminate.digest(frame(spark, rows).where("false"), bench).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    from lectern.llm import jaccard, language

    text = "the cat and the dog are in the house of the man with a hat"
    rows = [(i, f"{text} number {i} {w}") for i, w in enumerate(["", "x " * 30, "y " * 30])] + [(None, None), (7, ""), (7, "")]
    docs = frame(spark, rows).select(
        "*", F.struct(F.lit(1).alias("a-b"), F.lit("x").alias("c d")).alias("spans"), F.lit(2).alias("_spans"), F.lit(3).alias("h"), F.lit(4).alias("cls"), F.lit(5).alias("_kept"), F.lit("z").alias("odd name"), F.lit(None).cast("timestamp").alias("c0"),
    )
    model = language.fit([(text, "en"), ("le chat et le chien sont dans la maison", "fr")] * 5)
    bench = spark.createDataFrame([(1, "nothing of this stands there")], "item_id long, text string")
    for out, ids in (
        (language.keep(docs, model), {0, 1, 2}), (jaccard.keep_one(docs), {0, 1, 2, 7, None}), (suffixes.cut(docs), {0, 1, 2, 7, None}), (decontaminate.cut(docs, bench), {0, 1, 2, 7, None}),
    ):
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        found = out.collect()
        assert {r.doc_id for r in found} == ids and {(r["spans"]["a-b"], r["_spans"], r["h"], r["cls"], r["_kept"], r["odd name"]) for r in found} == {(1, 2, 3, 4, 5, "z")}


def test_random_decontamination(spark):
    r = random.Random(4)
    word = [chr(97 + i) for i in range(4)]
    items = [(i, " ".join(r.choice(word) for _ in range(r.randrange(1, 16)))) for i in range(8)]
    rows = [(i, " ".join(r.choice([*word, "zz"]) for _ in range(r.randrange(0, 60)))) for i in range(40)]
    found = got(decontaminate.digest(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == sorted(brute.windows(rows, items), key=repr)


def test_decontamination_cut(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    clean = " ".join(f"c{i}" for i in range(40))
    rows = [(1, clean + " " + passage + "! tail"), (2, passage), (3, clean), (4, None)]
    out = {r.doc_id: r for r in decontaminate.cut(frame(spark, rows), spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert out[1].text == clean + " ! tail" and out[1].n_chars == len(out[1].text) and 2 not in out and out[3].text == clean and out[4].text is None


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB_FROM", 3)
    monkeypatch.setattr(jaccard, "FANOUT", 4)
    monkeypatch.setattr(jaccard, "TILE", 8 if seed == 1 else 4096)
    monkeypatch.setattr(jaccard, "COMMON", 6)
    r = random.Random(seed)
    word = [f"w{i}" for i in range(200)]
    base = [[r.choice(word) for _ in range(r.choice([30, 60, 120]))] for _ in range(5)]
    rows = [(1, None), (2, ""), (3, "  "), (4, "One two"), (5, "one TWO"), (6, "one two three four five"), (7, "one two three four six"), (None, "one two")]
    for i in range(10, 90):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice(word)
        rows.append((r.choice([i, i, i, 12]), r.choice([" ", "\n"]).join(t)))
    found = got(jaccard.components(frame(spark, rows).repartition(3)), "doc_id", "n_shingles", "component_id")
    assert found == sorted(brute.linked(rows), key=repr)
    assert jaccard.components(frame(spark, rows).where("false")).count() == 0


def test_jaccard_keeps_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long), (2, long), (9, long + " more"), (4, "other text that is clean"), (5, None), (2, long)]
    kept = jaccard.keep_one(frame(spark, rows))
    assert got(kept, "doc_id") == [(2,), (4,), (5,)] and kept.columns[-1] == "n_chars"


def test_count_bound_and_tree():
    import numpy as np

    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 63, r.integers(1, 900)).astype(np.uint64)) for _ in range(60)]
    for k in range(20):
        own = sets[k].copy()
        own[:3] = r.integers(0, 1 << 63, min(3, len(own)))[: len(own[:3])]
        sets.append(np.unique(own))
    at, n = jaccard.counts_of([jaccard.point(s) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard.CountTree(at, n, np.arange(len(sets)))
    near = [(i, j) for x, y in tree.pairs() for i, j in zip(x.tolist(), y.tolist())]
    assert len(near) == len({frozenset(p) for p in near})
    near = {p for i, j in near for p in ((i, j), (j, i))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert np.minimum(at[i], at[j]).sum() >= both
            if i != j and 100 * both >= 80 * (len(a) + len(b) - both):
                assert (i, j) in near


def test_jaccard_of_a_large_group(spark):
    """300 near copies around the threshold, some of them copies of copies."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    made = [base]
    for _ in range(300):
        t = list(made[0] if r.random() < 0.7 else r.choice(made))
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            t[r.randrange(len(t))] = f"v{r.randrange(40)}"
        made.append(t[: r.randrange(110, 151)] if r.random() < 0.3 else t)
    rows = [(i, " ".join(t)) for i, t in enumerate(made)]
    assert got(jaccard.components(frame(spark, rows).repartition(4)), "doc_id", "n_shingles", "component_id") == sorted(brute.linked(rows), key=repr)


TEXTS = ["", None, " ", "\n\n a", "it's <|endoftext|> here", "<|endoftext|><|endoftext|>", "漢字 かな 😀", "a b　c", "x" * 3000, "The quick  brown\tfox\r\n" * 40, "<|startoftext|>Ab <|endoft", "ΣΑΣ İ ǅ", "é é", "1234 ½ ²", "\0\x1c\x85"]


def alphabet(seed, n):
    r = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "'s", "é", "1", "!", "<|endoftext|>", "漢", "😀", "The", "ing", "\x1c", "Σ", "<|", "|>", "Z", "½", " \n", " "]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 400))) for _ in range(n)]


def test_bpe(spark):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    texts = [*TEXTS, *alphabet(1, 80)]
    rows = list(enumerate(texts))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got(bpe.digest(frame(spark, rows)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(spark, rows))).collect()}
    assert all(back[i] == (t or "") for i, t in rows)


def test_chunks_are_shared():
    r = random.Random(9)
    passage = "".join(r.choice("abcdefg ") for _ in range(6000)).encode()
    one, two = list(bpe.chunks(b"head " + passage)), list(bpe.chunks(b"another longer head " + passage))
    assert b"".join(one) == b"head " + passage and len(set(one) & set(two)) >= len(one) - 3


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_path())
    texts = [*TEXTS, *alphabet(2, 80), "word " * 2100]
    rows = list(enumerate(texts))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert got(token_counts.count_tokens(frame(spark, rows)), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    own = token_counts.PrefixCounter(token_counts.default_path())
    for w in ("international", "ciónmente", "x"):
        raw = w.encode()
        for i in range(len(raw) + 1):
            if i == len(raw) or raw[i] & 0xC0 != 0x80:
                assert own.prefix_counts(raw)[i] == len(library.encode(raw[:i].decode(), add_special_tokens=False).ids)
    fit = token_counts.fit_budget(frame(spark, [(1, "internationalization of words"), (2, None)]), 2)
    for r in fit.collect():
        if r.doc_id == 1:
            assert r.n_tokens <= 2
            raw = b"internationalization"[: r.n_more_bytes] if not r.n_pieces else b"internationalization"
            assert len(library.encode(raw.decode(), add_special_tokens=False).ids) <= 2
