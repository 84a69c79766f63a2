"""Spelling variants, SentencePiece and the Merkle manifest, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle, pieces, variants

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, word string, `grp` int"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def plain_variants(rows):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            seen[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (cut := w[:i] + w[i + 1 :]) in words:
                near[w].add(cut)
                near[cut].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def test_variants(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdeéÿ") for _ in range(r.randrange(6, 12))) for _ in range(40)] + ["aaaaaaaa", "ababababab"]
    pool = list(base)
    for w in base * 6:
        k = r.randrange(len(w) + 1)
        pool.append(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abzéÀß") + w[k:], w[:k] + r.choice("abzé") + w[k + 1 :], "".join(r.sample(w, len(w)))]))
    texts = [" ".join(r.choice(pool) for _ in range(60)).replace("b", "B", 5) for _ in range(60)]
    # A chain of forms: each ten times as common as the one before.
    texts += ["chainword " * 400, "chainworde " * 40, "chainwordes " * 4, "x" * 50_000 + " " + "x" * 50_000, None, "", "123 _ Ж"]
    rows = list(enumerate(texts)) + [(None, base[0] + " " + base[1]), (3, texts[3])]
    docs = frame(spark, [(i, "s", "en", None, t) for i, t in rows])
    got = sorted((x.word, x.form or "", x.root, x.n, x.n_near, x.form_n or 0) for x in variants.group(variants.vocabulary(variants.runs(docs))).collect())
    want = plain_variants(rows)
    assert got == want
    assert any(g[2] not in (g[0], g[1]) for g in got) and sum(g[4] for g in got) > 100
    assert variants.group(variants.vocabulary(variants.runs(docs.where("false")))).count() == 0


def test_variants_keys_know_no_order(spark):
    rows = spark.createDataFrame([("listens",), ("silents",), ("ÿéalist",)], "w string").select(variants.anagram_key(F.split("w", "(?!^)(?!$)")).alias("k")).collect()
    assert rows[0].k == rows[1].k != rows[2].k
    # All exchange values of the alphabet differ, so a key difference names both letters.
    values = [v.v for v in spark.range(1, 91).select(F.when(F.col("id") <= 26, F.char(F.col("id") + 96)).otherwise(F.decode(F.unhex(F.concat(F.lit("C3"), F.hex(F.col("id") - 27 + 0x80))), "UTF-8")).alias("c")).select(variants.letter_value(F.col("c")).alias("v")).collect()]
    assert values == [i**5 for i in range(1, 91)] and len({a - b for a in values for b in values if a != b}) == 90 * 89


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(pieces.default_path())


def strange(seed, n=300):
    r = random.Random(seed)
    alphabets = ["abcdefghijklmnop", "theandiong ", " \t\n▁aé", "ab", "日本語梦벨ゼ 中国 \U0001f600Жйи", "\0\x01<s></s><unk><0x41>", " ", " -=_*#/.\n0123"]
    return ["", " ", "  ", "▁", "\0", "</s>a", "<0x41>", *("".join(r.choice(r.choice(alphabets)) for _ in range(r.randrange(120))) for _ in range(n))]


def test_pieces_equal_the_library(library, encoder):
    texts = [*strange(1), "a" * 20_000, "".join(random.Random(2).choice("abcdefghij") for _ in range(20_000)), "word " * 20_000]
    found = encoder.encode(texts, end=True)
    assert found == [library.encode(t, add_eos=True) for t in texts]
    assert [encoder.decode(x) for x in found] == [library.decode(x) for x in found]
    r = random.Random(3)
    for _ in range(500):
        ids = [r.choice([r.randrange(32_000), r.randrange(3, 259), r.randrange(3), 259]) for _ in range(r.randrange(12))]
        assert encoder.decode(ids) == library.decode(ids)


def test_rounds_equal_one_pair_at_a_time(encoder):
    words = sorted({w for t in strange(5, 800) for w in encoder.word.findall("▁" + t.replace(" ", "▁"))} | {"▁" + "th" * 30, "▁theththe" * 3, "aaaaaaa", "abababab"})
    symbols, sizes = encoder.merge_rounds(words)
    ends = sizes.cumsum()
    assert [symbols[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [encoder.agenda(w) for w in words]


def test_pieces_of_documents(spark, library, monkeypatch):
    texts = [None, *strange(6, 60)]
    docs = frame(spark, [(i // 2 or None, "s", "en", 1, t) for i, t in enumerate(texts)])
    plain = [t or "" for t in texts]
    ids = [library.encode(t, add_eos=True) for t in plain]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i // 2 or None, len(x), sha(" ".join(map(str, x))), sha(library.decode(x))) for i, x in enumerate(ids)]
    assert sorted(map(tuple, pieces.digest(docs).collect()), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    monkeypatch.setattr(pieces, "ROUND_CHARS", 10)
    small = docs.where("doc_id is not null")
    back = pieces.decode(pieces.encode(small)).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i // 2, library.decode(library.encode(t))) for i, t in enumerate(plain) if i // 2)
    assert pieces.digest(docs.where("false")).count() == 0


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([joined(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_proof(levels, i):
    steps = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 :][:16]
        steps.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        i //= 16
    return steps


def plain_merkle(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, joined(*map(field, r)), r))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    order = {k: sorted(groups[k], key=lambda x: x[:3]) for k in keys}
    trees = {k: plain_tree([x[2] for x in order[k]]) for k in keys}
    top = plain_tree([trees[k][-1][0] for k in keys])
    out = []
    for j, k in enumerate(keys):
        for i, (_, _, leaf, r) in enumerate(order[k]):
            steps = plain_proof(trees[k], i) + plain_proof(top, j)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = joined(*map(field, [*r[:4], None if r[4] is None else r[4].translate(LOWER)]))
            for at, others in steps:
                node = joined(*others[:at], node, *others[at:])
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], joined(*(x for _, o in steps for x in o)), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("local", [3, 1])
def test_merkle(spark, monkeypatch, local):
    monkeypatch.setattr(merkle, "LOCAL", local)
    r = random.Random(local)
    rows = [
        (r.choice([None, r.randrange(300), i]), r.choice([None, "", "a", "Ж", "hot", "hot", "hot", f"s{r.randrange(60)}"]), r.choice([None, "en"]), r.choice([None, 5]), r.choice([None, "", "AbC", "xyz Ж"]))
        for i in range(1500)
    ] + [(7, "repeated", "en", 1, "SAME")] * 300 + [(-1, "long", None, None, "Long " * 50_000)]
    docs = frame(spark, rows)
    got = sorted(map(tuple, merkle.digest(docs.repartition(3)).collect()), key=repr)
    assert got == plain_merkle(rows)
    assert {x[-1] for x in got} == {True, False}


def test_merkle_edges(spark):
    docs = frame(spark, [(1, "s", "en", 1, "One")])
    assert merkle.digest(docs.where("false")).count() == 0
    row = merkle.digest(docs).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == joined()
    assert [(b, list(merkle._blocks(a, e))) for a, e, b in ((5, 5, 0), (15, 33, 1))] == [(0, []), (1, [(0, 15, 16), (1, 16, 32), (0, 32, 33)])]


def test_merkle_proofs_verify(spark):
    docs = frame(spark, [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(100)])
    proven = merkle.proofs(merkle.build(merkle.leaves_of(docs)))
    own = proven.select("doc_id", "leaf")
    assert merkle.verify(own, proven).where("verified").count() == 100
    changed = own.withColumn("leaf", F.when(F.col("doc_id") == 7, F.reverse("leaf")).otherwise(F.col("leaf"))).union(spark.createDataFrame([(1000, "00")], "doc_id long, leaf string"))
    assert {x.doc_id for x in merkle.verify(changed, proven).where("not verified").collect()} == {7, 1000}
    assert {len(x.proof) for x in proven.collect()} == {3}
