"""HTML, licences, WARC, language, fingerprints and the pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprint, html, language, licenses, warc
from tests.llm import brute
from tests.llm.test_exact import frame, got


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(spark, rows):
    return {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}


def test_html_blocks(spark):
    article = "<article><h1>T &amp; t</h1><p>one\n two<br>three<p>&eacute;&nbsp;x &lt;b&gt;<div class='post-comments'><p>reader</div><form>f</form></article>"
    page = f"<html><head><title>no</title><style>p{{}}</style></head><body><nav><li>menu</nav><div class=\"ad\">ad</div><!-- c -->{article}<aside>side</aside><footer>&copy;</footer><script>var t='</p>';</script></body></html>"
    found = texts(spark, [(1, "http://a.com/1", page), (2, None, None), (3, "http://a.com/3", ""), (4, None, "<p>bare &amp text"), (5, "u", "<"), (1, "http://a.com/1", page)])
    assert found == {1: "T & t\none two\nthree\né x <b>", 2: "", 3: "", 4: "bare & text", 5: "<"}
    assert {r.n_chars for r in html.extract(pages(spark, [(1, "x", page)])).collect()} == {len(found[1])}
    assert html.extract(pages(spark, []).where("false")).count() == 0


def test_html_differencing(spark):
    def page(body):
        return f"<body><div>Site name</div><div>{body}</div><div>Terms of use</div></body>"

    rows = [(i, f"https://h.org/a/{i:03d}", page(f"text {i}")) for i in range(30)] + [(90, "https://alone.org/x", page("solo"))]
    found = texts(spark, rows)
    assert all(found[i] == f"text {i}" for i in range(30))
    assert found[90] == "Site name\nsolo\nTerms of use"


def test_html_names_of_elements(spark):
    p = {
        1: "<article><header><h1 class='page-header'>Title</h1></header><div class='share-price'>Share price: 4</div><p>body</p><article class='comment'><p>reader</p></article></article><article class='user-comments'>reader</article>",
        2: "<div class='page-header'>Site</div><div class='search-engine-guide'>guide</div><div id='adSlot1'>buy</div><h2 class='sidebar'>Heading</h2>",
        3: "<main><p>one <a href=\"x>two</a></p><p class=\"y\">three > 2</p><div class='social-links'>x</div><div title='a > b'>four</div></main>",
        4: "<article><p>card a</p></article><article><p>card b</p></article><div>" + "the long main text of a page of cards " * 3 + "</div>",
    }
    found = texts(spark, [(i, f"http://h{i}.com/", h) for i, h in p.items()])
    assert found[1] == "Title\nShare price: 4\nbody" and found[2] == "guide\nHeading" and found[3] == "one two\nthree > 2\nfour"
    assert found[4].startswith("card a\ncard b\nthe long main text")


INSERTED = [
    "div class='comment-count'", "div class='fb-comments'", "h2 class='comments-title'", "div class='cookie-banner'", "div class='ad-300x250'", "div class='related-posts-widget'",
    "div class='newsletter-cta'", "div class='notice'", "div class='post-meta-share-tools'", "p style='visibility:hidden'", "p hidden", "div role='navigation'",
]
OWN = ["section id='form'", "section id='discussion'", "div class='share-price'", "h2 class='article-title'", "p class='text'", "div class='post-body'", "div class='comment-on-the-budget'", "p class='x'"]


@pytest.mark.parametrize("frame_", ["<article>{}</article>", "<main>{}</main>", "<div role='main'>{}</div>"])
def test_html_inserts_and_own_elements_of_an_article(frame_):
    found = html.lines(frame_.format("".join(f"<{tag}>gone {i}</{tag.split()[0]}>" for i, tag in enumerate(INSERTED)) + "".join(f"<{tag}>own {i}</{tag.split()[0]}>" for i, tag in enumerate(OWN))))
    assert [t for t, _ in found] == [f"own {i}" for i in range(len(OWN))] and all(f & html.INSIDE for _, f in found)


def test_html_discussion_beside_an_article():
    assert [t for t, _ in html.lines("<div class='discussion'>said</div><article><p>own</p></article>")] == ["own"]


def test_html_differencing_decides_inside_and_outside_articles(spark):
    def page(i):
        return f"<div>Site name</div><article><h1>Head {i}</h1><div>Print this page</div><p>Same first words</p><ul><li><a href='/x'>Next</a></li></ul><p>text {i}</p></article><div>All rights reserved by the owner of this site</div>"

    rows = [(i, f"https://h.org/a/{i}", page(i)) for i in range(4)] + [(9, "https://h.org/a/0", page(0)), (8, "https://alone.org/", page(8))]
    found = texts(spark, rows)
    assert all(found[i] == f"Head {i}\nSame first words\ntext {i}" for i in range(4)) and found[9] == found[0]
    assert found[8] == "Head 8\nPrint this page\nSame first words\nNext\ntext 8"
    assert {r.n_shared for r in html.extract(pages(spark, rows)).where("page_id = 2").collect()} == {5}


def test_html_against_plain_pairing_and_alignment(spark):
    import os.path

    r = random.Random(11)
    rows = []
    for i in range(60):
        body = "".join(f"<div>{r.choice(['menu', 'terms', 'about', 'x'])} {r.randrange(3)}</div>" for _ in range(r.randrange(0, 7)))
        rows.append((i, f"http://{r.choice(['a.com', 'b.com', 'c.org'])}/{r.choice('pq')}/{r.randrange(100)}/{i}", f"{body}<div>own {i}</div>"))
    found = texts(spark, rows)
    for host in ("a.com", "b.com", "c.org"):
        own = sorted((u.split(host)[1], i) for i, u, _ in rows if f"//{host}/" in u)
        for k, (path, i) in enumerate(own):
            near = [own[x] for x in (k - 1, k + 1) if 0 <= x < len(own)]
            other = max(near, key=lambda o: len(os.path.commonprefix([o[0], path])))[1]
            a, b = ([t for t, _ in html.lines(rows[x][2])] for x in (i, other))
            shared = size_of_lcs(a, b)
            left = found[i].split("\n")
            assert len(left) == len(a) - shared and f"own {i}" in left
            rest = iter(a)
            assert all(x in rest for x in left)


def test_html_of_long_pages_and_many_quotes(spark):
    long = "".join(f"<div>line {i % 5000}</div>" for i in range(6000))
    rows = [(1, "http://a.com/1", long), (2, "http://a.com/2", long + "<div>end</div>"), (3, "http://b.com/", "<p " + "'x \"" * 3000), (4, "http://c.com/", "<b>" * 3000 + "</i>" * 3000 + "z")]
    found = texts(spark, rows)
    assert found[1] == "" and found[2] == "end" and found[4] == "z"


def size_of_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_is_a_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(0, 9))] for _ in range(2))
        same = html.shared_lines(a, b)
        kept = [x for x, s in zip(a, same) if s]
        rest = iter(b)
        assert all(x in rest for x in kept) and len(kept) == size_of_lcs(a, b)


def test_license_places_of_a_long_text():
    tokens = ["mit", "license", "x"] * 100_000
    assert licenses._base([w.encode() for w in tokens]) == (100_000, 0, 299_997, "mit")


def test_licenses(spark):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3."), (2, "x mit license y MIT-License mitlicense"), (3, None), (4, ""), (5, "CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (5, "cc by"),
        (6, "apache  license? the apache license"), (7, "Permission is hereby granted, free of charge, to any person that obtains a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
        (None, "the of and to"), (8, "gnu général public license"),
    ]
    found = licenses.scan(frame(spark, rows))
    want = []
    for i, t in rows:
        w, places, labels = brute.words(t), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.encode().split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert got(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    by = {(r.doc_id, r.n_words): r for r in found.collect()}
    more = {r.doc_id: r.labels for r in by.values() if r.n_words > 3 or r.doc_id is None}
    assert more[7] == "mit" and "cc-by-nc" in more[5] and more[None] == "" and more[8] == ""
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in by.values())
    assert licenses.scan(frame(spark, rows).where("false")).count() == 0


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id string, warc_type string, uri string, at long, headers map<string,string>, payload_digest string")


def test_revisits(spark):
    day = 86400
    rows = [
        ("f1", "response", "http://www.a.com/x/?utm_source=q#top", 5, {"etag": '"1"', "content-type": "t", "x": "old"}, "d1"), ("f2", "response", "https://a.com/x", 2 * day, {"etag": '"2"', "last-modified": "m"}, "d2"),
        ("r1", "revisit", "http://a.com/x.html", 9, {"etag": 'W/"1"', "content-length": "0", "x": "new"}, None), ("r2", "revisit", "http://a.com/x", 40 * day, {"etag": '"1"'}, None),
        ("r3", "revisit", "http://a.com/x", 40 * day, {"last-modified": "m"}, None), ("r4", "revisit", "http://a.com/x", 5, {"etag": '"1"'}, None), ("r5", "revisit", "http://a.com/x?p=1", 99, {}, None),
        ("r6", "revisit", "http://a.com/x", 3 * day, None, None), ("r7", "revisit", None, None, {}, None), ("r8", "revisit", "http://a.com/x", None, {"etag": '"2"'}, None), ("z", "request", "http://a.com/x", 1, {}, None),
    ]
    found = {r.record_id: r for r in warc.resolve(records(spark, rows)).collect()}
    assert {k: (r.status, r.refers_to) for k, r in found.items()} == {
        "r1": ("resolved", "f1"), "r2": ("mismatch", None), "r3": ("resolved", "f2"), "r4": ("orphan", None), "r5": ("orphan", None), "r6": ("unchecked", None), "r7": ("orphan", None), "r8": ("orphan", None),
    }
    assert found["r1"].headers == {"etag": 'W/"1"', "content-type": "t", "x": "new"} and found["r1"].payload_digest == "d1"
    assert warc.resolve(records(spark, rows).where("false")).count() == 0
    many = [("f", "response", "u", 1, {"etag": "e"}, "d")] + [(f"r{i}", "revisit", "u", 1 + i * day, {"etag": "e"}, None) for i in range(1, 20)]
    assert {r.refers_to for r in warc.resolve(records(spark, many), bucket_s=3600).collect()} == {"f"}


def test_warc_files(spark, tmp_path):
    import gzip

    def record(kind, uri, head, body):
        block = (b"HTTP/1.1 " + head + b"\r\n\r\n" + body) if head else body
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{uri}{kind}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    one, two = record("response", "http://a/", b"200 OK\r\nETag: \"x\"", b"body WARC/1.0"), record("revisit", "http://a/", b"304 Not Modified\r\nETag: \"x\"", b"")
    (tmp_path / "a.warc").write_bytes(one + two + b"WARC/1.0\r\nbroken")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and sorted(r.status for r in rows) == [200, 200, 304, 304]
    assert {bytes(r.payload) for r in rows if r.status == 200} == {b"body WARC/1.0"} and {r["at"] for r in rows} == {1704067200}


def test_language(spark):
    r = random.Random(1)
    own = {"en": "the and of with that this was for are not", "de": "der die und das nicht ein mit auf ist sich", "fr": "le la les des une est que pour dans pas"}
    rows = [(i, None if i % 50 == 0 else " ".join(r.choice(own[k].split()) for _ in range(r.randrange(3, 40))), None if i % 31 == 0 else k) for i in range(400) for k in [r.choice(sorted(own))]]
    rows += [(1001, "12 34 !!", "en"), (1002, "", "de"), (1003, None, None)]
    docs = spark.createDataFrame([(i, t, k, "s") for i, t, k in rows], "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    assert model.labels == ["de", "en", "fr"]
    found = {x.doc_id: x for x in language.predict(docs, model).collect()}
    from zlib import crc32

    held = [(i, k) for i, t, k in rows if t and k and i < 1000 and found[i].held_out]
    assert all(found[i].held_out == (crc32(str(i).encode()) % 3 == 1) for i in found)
    assert held and sum(found[i].lang_pred == k for i, k in held) / len(held) > 0.97
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1001, 1002, 1003, 50))
    assert all(0 <= x.score <= 1 for x in found.values())
    mixed = (own["en"] + " " + own["de"]).split()
    labels = model.label(mixed)
    assert sum(a == b for a, b in zip(labels, ["en"] * 10 + ["de"] * 10)) >= 17
    kept = language.keep(docs, model)
    assert kept.columns == docs.columns and {1001, 1002, 1003}.isdisjoint(x.doc_id for x in kept.collect())
    none = language.train(docs.where("false"))
    assert {x.lang_pred for x in language.predict(docs, none).collect()} == {"und"}


def test_forward_backward_by_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(3)
    lengths = np.array([3, 1, 4])
    scores, move = r.normal(size=(8, 3)), r.normal(size=(3, 3))
    found, at = language.forward_backward(scores, lengths, move), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[at + t, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            for t, k in enumerate(path):
                want[t, k] += w
        assert np.allclose(found[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_fingerprints(spark):
    r = random.Random(2)
    line = [" ".join(r.choice("abcdefghij") * r.randrange(1, 6) for _ in range(30)) for _ in range(40)]
    rows = [(i, "\n".join(r.sample(line, r.randrange(1, 20)))) for i in range(30)] + [(100, None), (101, ""), (102, "one line"), (103, "one line"), (103, "x"), (None, "no id")]
    found = fingerprint.digest(frame(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (-(x[0] if x[0] is not None else -1), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        nxt = order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    assert sorted(((x.doc_id, x.n_chars, x.edited_sha256) for x in found), key=repr) == sorted(want, key=repr)
    text = {i: t or "" for i, t in rows if i != 103}
    prints = {x.doc_id: x.fingerprint for x in found if x.doc_id != 103}
    assert prints[100] == prints[101] and len({prints[i].partition(":")[0] for i in prints}) == len(set(text.values()))
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in found)
    long = [x for x in found if x.n_chars > 900]
    assert long and all(x.near_edited > 0.4 for x in long) and all((x.near_edited == 1) == (x.fingerprint == x.edited_fingerprint) for x in found)
    assert fingerprint.digest(frame(spark, rows).where("false")).count() == 0
    alone = fingerprint.digest(frame(spark, [(5, "abcdef")])).collect()
    assert [(x.doc_id, x.edited_sha256) for x in alone] == [(5, hashlib.sha256(b"abcdab").hexdigest())]


def test_fingerprint_locates_edits():
    r = random.Random(4)
    a = "\n".join(" ".join(r.choice("abcdefghij") * 4 for _ in range(40)) for _ in range(20))
    b = a[:1500] + "INSERTED" + a[1500:]
    x, y = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
    spans = fingerprint.edits(x, y)
    assert sum(e - s for s, e in spans) < 400 and any(s <= 1500 <= e for s, e in spans) and fingerprint.likeness(x, y) > 0.9
    assert fingerprint.likeness(x, x) == 1 and fingerprint.likeness(x, fingerprint.fingerprint("zzz")) == 0


def test_license_notices_by_diagonal_votes(spark):
    notice = "Licensed under CC BY-NC-SA 3.0."
    rows = [
        (1, f"some words before. {notice} and after"), (2, "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
        (3, "this work is hereby licensed under a Creative Commons Attribution 2.0 Generic License"), (4, "licensed to nobody, under a creative license of mine"),
        (5, "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. " + "x " * 5000 + notice), (6, "Licensed under CC BY 4.0."), (7, None), (7, None),
    ]
    found = licenses.scan(frame(spark, rows)).collect()
    assert {(r.doc_id, r.labels) for r in found} == {
        (1, "cc-by,cc-by-nc-sa"), (2, "cc-by-sa"), (3, "cc-by"), (4, ""), (5, "cc-by,cc-by-nc-sa,gpl"), (6, "cc-by"), (7, ""),
    } and len(found) == len(rows)
    # A template against itself, by plain votes: every k-gram of it on the diagonal of its place.
    for label, wording in licenses.TEMPLATES:
        own = licenses.words(wording.encode())
        text = "zz " * 3 + wording + " zz"
        spans = licenses.spans(frame(spark, [(1, text)]).select("doc_id", F.lit(1).alias("h"), F.col("text").cast("binary").alias("text"))).collect() if len(own) > 30 else None
        if spans is not None:
            assert (label, 1.0, 3, 3 + len(own) - 1) in {(r.label, r.share, r["first"], r["last"]) for r in spans}


def test_fingerprint_likeness_against_plain_trees(spark):
    r = random.Random(8)
    texts = ["\n".join(" ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(r.randrange(1, 30))) for _ in range(12)) for _ in range(6)] + ["", "", "a" * 3000, None]
    found = {x.doc_id: x for x in fingerprint.digest(frame(spark, list(enumerate(texts)))).collect()}
    assert found[6].fingerprint == found[7].fingerprint == found[9].fingerprint
    for i, t in enumerate(texts):
        x, own = found[i], t or ""
        after = texts[i - 1] or "" if i else texts[-1] or ""
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        assert x.n_chars == len(own) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (x.fingerprint == x.edited_fingerprint) == (own == edited) and 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        assert x.near_edited == 1 if own == edited else x.near_edited < 1


def test_language_without_labels_keeps_texts(spark):
    rows = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 !!", None, "s", 5), (3, None, None, "s", None), (4, "слова", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in language.keep(rows, language.train(rows)).collect()} == {1, 4}


def test_language_decoding_against_all_paths(spark):
    """Forward-backward on a few words, against sums over every labelling."""
    import itertools

    import numpy as np

    g = np.random.default_rng(3)
    for n in (1, 2, 4):
        scores, move = g.normal(size=(n, 3)), g.normal(size=(3, 3))
        want, total = np.zeros((n, 3)), 0.0
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(scores[i, k] for i, k in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for i, k in enumerate(path):
                want[i, k] += p
        assert np.allclose(language.forward_backward(scores, np.array([n]), move), want / total)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    word = "the and of with that this was for are not from but they have had one can all were when".split()
    body = {i: " ".join(r.choice(word) + str(r.randrange(9000)) for _ in range(60)) + " the and of" for i in range(20)}
    passage = " ".join(r.choice(word) + f"p{i}" for i in range(60))
    rows = [(i, t) for i, t in body.items()] + [(30, body[3]), (31, body[4] + " extra"), (32, "12 !!"), (33, None)]
    rows += [(40, body[0][::-1] + "\n" + passage), (41, body[1][::-1] + "\n" + passage), (50, body[5][::-1] + " " + "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen.append({x.doc_id: x for x in docs.collect()})
    assert {32, 33}.isdisjoint(seen[0]) and len(seen[0]) == 25
    assert {30, 31}.isdisjoint(seen[1]) and len(seen[1]) == 23
    assert passage[50:150] not in seen[2][40].text and passage[50:150] not in seen[2][41].text and seen[2][7].text == body[7]
    assert "w5" not in seen[3][50].text and "w11" in seen[3][50].text
    assert set(seen[4]) == set(seen[3]) and all(x.n_tokens > 0 for x in seen[4].values())
    whole = {x.doc_id: x.ids_sha256 for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: x.ids_sha256 for i, x in seen[4].items()}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_null_columns_everywhere(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long").withColumn("h", F.lit(None).cast("int"))
    assert licenses.scan(docs).count() == 2 and fingerprint.digest(docs).count() == 2
