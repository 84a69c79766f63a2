"""Main text of web pages by differencing each against the page of the nearest URL."""

from __future__ import annotations

import html as references
import os.path
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, checkpointed, column, map_batches, read, released

#: Elements whose content is no text of the page, or stands apart from its article.
DROPPED = {
    "script", "style", "noscript", "template", "head", "title", "svg", "canvas", "iframe", "object", "nav", "header",
    "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog", "math", "audio", "video", "map",
}
#: Elements that hold an article's own text; and all that end a block before and after them.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "blockquote", "pre", "td", "th", "caption", "figcaption", "article", "main"}
BLOCKS = TEXT | {
    "address", "body", "br", "center", "details", "dir", "div", "dl", "fieldset", "figure", "hgroup", "hr", "html", "ol",
    "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words that name reader comments; what is no article text even inside one; what stands beside it.
COMMENTS = {"comment", "comments", "commentlist", "commenter", "reply", "replies", "respond", "disqus"}
INSERTS = COMMENTS | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "promoted",
    "share", "sharing", "social", "newsletter", "signup", "subscribe", "related", "cookie", "cookies", "consent", "popup", "modal", "sidebar",
    "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pager", "pagination", "notice", "notices", "alert", "toolbar",
}
BESIDE = INSERTS | {"banner", "complementary", "contentinfo", "dialog", "discussion", "discussions", "footer", "form", "header", "masthead", "menu", "search", "topbar", "widget"}
#: What a heading may name that goes with it; others keep their headings.
HEADED = COMMENTS | {"advert", "advertisement", "cookie", "cookies", "newsletter", "promoted", "related", "sharing", "sponsored", "subscribe"}
#: Words that may stand with those in a name and change nothing.
NEUTRAL = {
    "area", "article", "articles", "banner", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "count", "cta", "desktop", "facebook", "fb", "footer", "form",
    "global", "header", "heading", "icons", "inline", "inner", "item", "items", "leaderboard", "left", "links", "list", "main", "media", "message", "meta", "mobile", "outer", "page", "panel",
    "policy", "post", "posts", "primary", "reader", "rectangle", "right", "secondary", "section", "site", "skyscraper", "slot", "sticky", "text", "thread", "title", "tools", "top", "unit",
    "user", "widget", "wrap", "wrapper", "x",
}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A quote that no later quote closes at the end of a value is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)
SPACE = re.compile(r"\s+")
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe")}
#: Flags of a block: inside an article or main element; in an element of TEXT, and not all links.
INSIDE, BODY = 1, 2
#: A page with more than this many times its articles' text beside them is a page of cards.
CARDS = 4
#: Numbers of shared blocks that a broadcast may hold; more are joined.
BROADCAST_BYTES = 32 << 20


def names(value: str, kinds: set[str]) -> bool:
    """Whether a name in a class, id or role value is made of words of kinds, with or without
    neutral ones: `site-header`, `adSlot1` and `ad-300x250` are, `share-price` is not."""
    for token in value.split():
        found = {w.lower() for w in WORDS.findall(token) if not w.isdigit()}
        if found & kinds and found <= kinds | NEUTRAL:
            return True
    return False


def lines(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, with their flags.

    Dropped: markup, comments, scripts, styles, and elements that by name, class, id or role
    are menus, headers, footers, sidebars, notices, adverts, forms or reader comments, or are
    hidden. Inside an article or main element (also by role), `header` and what only its place
    could tell stay; headings go by class where they head comments or inserts (HEADED). An
    article named as a comment is one. Character references are
    decoded, white space in a block becomes one space.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, of an article
    opened: Counter[str] = Counter()
    around: list[str] = []  # the open elements of BLOCKS
    gone = article = 0
    plain = False

    def flush() -> None:
        nonlocal plain
        if parts:
            text = SPACE.sub(" ", references.unescape("".join(parts))).strip()
            if text:
                out.append((text, INSIDE * (article > 0) | BODY * (plain and bool(around) and around[-1] in TEXT)))
            parts.clear()
            plain = False

    def close(k: int) -> None:
        nonlocal gone, article
        for name, dropped, inside in stack[k:]:
            gone -= dropped
            article -= inside
            opened[name] -= 1
            if name in BLOCKS:
                around.pop()
        del stack[k:]

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not gone and (text := page[at : m.start() if m else len(page)]):
            parts.append(text)
            plain = plain or not opened["a"] and not text.isspace()
        if not m:
            break
        at = m.end()
        if not m[1]:
            continue
        name, closing = m[1].lower(), m[0][1] == "/"
        if name in BLOCKS or name in DROPPED:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1) if opened[name] > 0 else ():
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("article", "main") and name in ("p", "b", "i", "span", "a", "em", "strong"):
                    break  # a stray end tag ends nothing outside the article
            continue
        if name in RAW and not m[0].endswith("/>"):
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or m[0].endswith("/>"):
            continue
        if name in ("p", "li", "dd", "dt", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        inside = name in ("article", "main")
        dropped = name in DROPPED and not (name == "header" and article)
        if not dropped and m[2] and name not in ("html", "body"):
            kinds = HEADED if re.fullmatch("h[1-6]", name) else COMMENTS if inside else INSERTS if article else BESIDE
            for key, value in ATTRIBUTE.findall(m[2]):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role"):
                    dropped |= names(value, kinds)
                    inside |= key == "role" and value.lower() in ("main", "article")
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    dropped = True
        inside = inside and not dropped
        stack.append((name, dropped, inside))
        opened[name] += 1
        if name in BLOCKS:
            around.append(name)
        gone += dropped
        article += inside
    flush()
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _scores(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The lengths of longest common subsequences of own with every beginning of other."""
    row = np.zeros(len(other) + 1, np.int32)
    for h in own.tolist():
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(other == h, row[:-1] + 1, 0)))
    return row


def shared_lines(own: list[int], other: list[int]) -> np.ndarray:
    """Which of own's lines are in a longest common subsequence with other's.

    Lines that the other side lacks fall out and equal ends are matched first. The rest is
    halved where the scores from both ends add up to the most, so memory is linear.
    """
    same = np.zeros(len(own), bool)
    a, b = np.asarray(own, np.int64), np.asarray(other, np.int64)
    at, b = np.flatnonzero(np.isin(a, b)), b[np.isin(b, a)]
    a = a[at]
    held = [(0, len(a), 0, len(b))]
    while held:
        i, j, x, y = held.pop()
        while i < j and x < y and a[i] == b[x]:
            same[at[i]] = True
            i, x = i + 1, x + 1
        while i < j and x < y and a[j - 1] == b[y - 1]:
            same[at[j - 1]] = True
            j, y = j - 1, y - 1
        if i == j or x == y:
            continue
        if j - i == 1:
            same[at[i]] |= bool((b[x:y] == a[i]).any())
            continue
        mid = (i + j) // 2
        cut = x + int((_scores(a[i:mid], b[x:y]) + _scores(a[mid:j][::-1], b[x:y][::-1])[::-1]).argmax())
        held += [(i, mid, x, cut), (mid, j, cut, y)]
    return same


def main_text(found: list[str], flags: list[int], shared: np.ndarray) -> str:
    """The blocks of a page that are its text, given those it shares with its neighbour.

    Shared blocks go, but for the body text of an article. What is left inside article and main
    elements alone is the text, unless CARDS times as much is left outside: such elements are
    but cards of the page, and all that is left is its text.
    """
    left = [(t, f & INSIDE) for t, f, gone in zip(found, flags, shared, strict=True) if not gone or f & INSIDE and f & BODY]
    inner = sum(len(t) for t, inside in left if inside)
    article = inner and inner * CARDS >= sum(len(t) for t, inside in left if not inside)
    return "\n".join(t for t, inside in left if inside or not article)


def nearest(pages: DataFrame) -> DataFrame:
    """row and other: for each page the page of the nearest URL within its host.

    pages: row (distinct), host, path. URLs are sorted over the cluster by ranges of (host,
    path, row), so a host of any size is split; the sorted keys are written to the shared
    folder, and the first and last of each range (two rows a range) meet its neighbours'.
    Nearest is the neighbour with the longer common path prefix, the one before at a tie.
    """
    ranged = pages.select("row", "host", "path").repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    kept = checkpointed(ranged.withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()))
    key = F.struct("row", "host", "path")
    ends = sorted(kept.groupBy("part").agg(F.min_by(key, "n").alias("first"), F.max_by(key, "n").alias("last")).collect(), key=lambda r: r.part)
    around = {
        r.part: (tuple(ends[i - 1].last) if i else None, tuple(ends[i + 1].first) if i + 1 < len(ends) else None)
        for i, r in enumerate(ends)
    }
    shared = kept.sparkSession.sparkContext.broadcast(around)
    fields = pa.schema([("row", pa.int64()), ("other", pa.int64())])

    def run(batches):
        before = own = behind = None
        for batch in batches:
            out = []
            for part, *now in zip(*(column(batch, c) for c in ("part", "row", "host", "path")), strict=True):
                if own is None:
                    before, behind = shared.value[part]
                else:
                    out.append((own[0], _choose(before, own, now)))
                    before = own
                own = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=fields)
        if own is not None:
            last = [pa.array([own[0]], pa.int64()), pa.array([_choose(before, own, behind)], pa.int64())]
            yield pa.RecordBatch.from_arrays(last, schema=fields)

    return kept.select("part", "row", "host", "path").mapInArrow(released(run), "row long, other long")


def _choose(before, own, after) -> int | None:
    """The nearer of two neighbours (row, host, path) of the same host."""
    near = [o for o in (before, after) if o and o[1] == own[1]]
    return max(near, key=lambda o: len(os.path.commonprefix([o[2], own[2]])))[0] if near else None


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, row, texts, flags, hashes: every page, read once.

    row is the same for pages of a host that have the same blocks.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = [lines(h) for h in column(batch, "html")]
            hashes = [[_hash(t) for t, _ in x] for x in found]
            rows = [
                xxhash.xxh3_64_intdigest(np.array(x, np.int64).tobytes() + (host or "").encode("utf-8", "surrogatepass")) - (1 << 63)
                for x, host in zip(hashes, column(batch, "host"), strict=True)
            ]
            return {n: batch.column(i) for i, n in enumerate(("page_id", "url", "host", "path"))} | {
                "row": rows, "texts": [[t for t, _ in x] for x in found], "flags": [[f for _, f in x] for x in found], "hashes": hashes,
            }

        return step

    plain = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.lower(F.substring_index(plain, "/", 1)).alias("host"),
        F.regexp_replace(F.regexp_replace(plain, "^[^/]*", ""), r"(/|\.html?)$", "").alias("path"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return map_batches(source, "page_id long, url string, host string, path string, row long, texts array<string>, flags array<tinyint>, hashes array<long>", make)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared: the main text of every page, and how many of its
    blocks its neighbour has too.

    Every page is paired with the page of the nearest URL in its host that has other blocks,
    and aligned with it by a longest common subsequence; `main_text` says what goes. Pages of
    a host with equal blocks are one there, under the least of their paths. Elements that are
    by name beside the article are dropped before. A page is parsed once; its blocks are kept
    in a table, and only pages that share some meet the numbers of those. Null html or url count as empty: no text; no host, paired among themselves. A
    page alone in its host shares nothing. Repeated rows give repeated results; extra columns
    of pages are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    own = scratch.save(parsed(pages))
    keys = own.where(F.size("hashes") > 0).groupBy("row").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.first("hashes").alias("hashes"))
    keys = scratch.save(keys)
    other = keys.select(F.col("row").alias("other"), F.col("hashes").alias("against"))
    both = nearest(keys.select("row", "host", "path")).join(keys.select("row", "hashes"), "row").join(other, "other").select("row", "hashes", "against")

    def align():
        def step(batch: pa.RecordBatch) -> dict | None:
            found = [np.flatnonzero(shared_lines(h, o)) for h, o in zip(column(batch, "hashes"), column(batch, "against"), strict=True)]
            keep = [i for i, x in enumerate(found) if len(x)]
            return {"row": batch.column(0).take(pa.array(keep, pa.int32())), "shared": [found[i] for i in keep]} if keep else None

        return step

    shared = scratch.save(map_batches(both, "row long, shared array<int>", align))
    size = shared.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("shared")), F.lit(0)).alias("lines")).first()
    few = size.rows * 16 + size.lines * 4 <= BROADCAST_BYTES

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts, counts = [], []
            for found, flags, gone in zip(*(column(batch, c) for c in ("texts", "flags", "shared")), strict=True):
                out = np.zeros(len(found), bool)
                out[gone or []] = True
                texts.append(main_text(found, flags, out))
                counts.append(len(gone or []))
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts], "n_shared": counts}

        return step

    rows = own.join(F.broadcast(shared) if few else shared, "row", "left").select("page_id", "url", "texts", "flags", "shared")
    return map_batches(rows, "page_id long, url string, text string, n_chars long, n_shared long", make)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
