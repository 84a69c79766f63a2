"""The keyword baseline: surface terms, and where they first appear and are defined."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import cleaned_term, quoted, spaced_names_match, strip
from lectern.session import saved

#: Shapes of terms: bold spans, headings and capitalised phrases; and of definitions, where
#: {t} is the term (fixed values).
BOLD = r"\*\*([^*\n]{3,60})\*\*"
HEADING = r"(?m)^#{2,6}\s*(.+)$"
PHRASE = r"(?<![\p{L}\p{N}_])([A-Z][A-Za-z0-9.+-]*(?:\s+[A-Z][A-Za-z0-9.+-]*){0,3})(?![\p{L}\p{N}_])"
DEFINITIONS = [
    r"\*\*{t}\*\*", r"^#{2,6}\s*{t}(?![\p{L}\p{N}_])", r"{t}\s*[—–-]\s*це(?![\p{L}\p{N}_])", r"{t}\s*[—–-]\s", r"{t}\s+is\s+", r"{t}\s+means(?![\p{L}\p{N}_])", r"{t}\s*:\s",
]
#: In folded texts: what stands after a term that is defined, but for white space before it, and
#: the marks that stand around one or head a line; white space as DuckDB's patterns have it.
BLANKS = "\t\n\f\r "
DEFINED = re.compile(rf"[—–-](?=[{BLANKS}]|це(?!\w))|:(?=[{BLANKS}])|(?<=[{BLANKS}])is(?=[{BLANKS}])|(?<=[{BLANKS}])means(?!\w)")
STARS, HASHES = re.compile(r"\*(?=\*)"), re.compile(r"(?m)^##+")
#: Where two words meet at more than a space, or a text ends so: the first one's end with what
#: stands after it, and the second one's start; and how many characters of each are a key.
SEAM = r"([\p{L}\p{N}]{1,8}(?! [\p{L}\p{N}])[^\p{L}\p{N}]+)(?=([\p{L}\p{N}]{1,8})|\z)"
SEAM_KEY = 3
#: Terms that may be sent along to sift what is joined with them; more are only joined.
SIFTED_TERMS = 2_000_000
#: Terms of one automaton, a few hundred bytes each in a Python worker.
TERMS_AT_ONCE = 200_000


def terms(text: Column) -> Column:
    """The candidate terms of a text, each once."""
    bold = F.transform(F.regexp_extract_all(text, F.lit(BOLD), F.lit(1)), strip)
    heads = F.transform(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), lambda h: strip(F.regexp_replace(h, r"^[\p{Nd}.\s]+", "")))
    heads = F.filter(heads, lambda h: (F.length(h) >= 3) & (F.length(h) <= 60))
    phrases = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(1)), strip), lambda p: (F.length(p) >= 3) & (F.length(p) <= 40))
    every = F.transform(F.concat(bold, heads, phrases), cleaned_term)
    return F.array_distinct(F.filter(every, lambda t: t.isNotNull()))


def vocabulary(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """term, n_docs: every candidate term and the documents that hold it."""
    found = texts.select(doc, F.explode(terms(F.col(text))).alias("term"))
    return found.groupBy("term").agg(F.count_distinct(doc).alias("n_docs"))


def is_defined(text: Column, term: Column) -> Column:
    """Whether a text has the term in one of the shapes of a definition."""
    shape = "|".join(f"(?:{d})" for d in DEFINITIONS)
    pieces = shape.split("{t}")
    pattern = F.concat(F.lit("(?imu)" + pieces[0]), *[x for p in pieces[1:] for x in (quoted(term), F.lit(p))])
    return F.regexp(text, pattern)


def _blocks(vocab: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Terms and their lower case, TERMS_AT_ONCE at a time; one empty block if there are none."""
    block, n = [], 0
    for row in vocab.select(F.lower("term").alias("low"), "term").where("low <> ''").toLocalIterator():
        block.append((row.low, row.term))
        if len(block) == TERMS_AT_ONCE:
            yield block
            block, n = [], n + 1
    if block or not n:
        yield block


def holding(texts: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """texts with `held`: the terms whose lower case is inside the (lower-case) text; texts that
    hold none are left out.

    One pass over the texts for every TERMS_AT_ONCE terms, each by an automaton of them, so no
    text meets a term that it doesn't hold. Terms are broadcast a block at a time; each task
    builds the automaton of its block.
    """
    from pyspark.sql.types import StructType

    spark, kinds = texts.sparkSession, texts.schema.fields
    schema = f"{StructType(kinds).toDDL()}, held array<string>" if kinds else "held array<string>"
    place = texts.columns.index(text)

    def scan(block: list[tuple[str, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            import ahocorasick
            import pyarrow as pa

            by: dict[str, list[str]] = {}
            for low, term in shared.value:
                by.setdefault(low, []).append(term)
            automaton = ahocorasick.Automaton()
            for low, terms in by.items():
                automaton.add_word(low, tuple(terms))
            automaton.make_automaton()
            for batch in batches:
                found = [sorted({t for _, terms in automaton.iter(x or "") for t in terms}) if len(automaton) else [] for x in batch.column(place).to_pylist()]
                keep = pa.array([i for i, x in enumerate(found) if x], pa.int32())
                if len(keep):
                    rows = batch.take(keep)
                    held = pa.array([x for x in found if x], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, held], names=[*rows.schema.names, "held"])

        return texts.mapInArrow(run, schema)

    out = None
    for block in _blocks(vocab):
        out = scan(block) if out is None else out.unionByName(scan(block))
    return out


def _folded(text: str) -> str:
    """text in folded case, a character for each."""
    low = text.casefold()
    if len(low) == len(text):
        return low
    return "".join(f if len(f := c.casefold()) == 1 else f if len(f := c.lower()) == 1 else c for c in text)


def _definition_places(text: str) -> tuple[set[int], set[int], set[int]]:
    """Of a folded text: where a term that is defined may end, where it ends if `**` stands before
    it too, and where one starts as a heading."""
    ends, heads = set(), set()
    for m in DEFINED.finditer(text):
        at = m.start()
        if text[at] not in "im":
            ends.add(at)
        while at and text[at - 1] in BLANKS:
            at -= 1
            ends.add(at)
    for m in HASHES.finditer(text):
        at, n = m.start(), len(m[0])
        heads |= set(range(at + 2, at + min(n, 6) + 1))
        at += n
        while n <= 6 and at < len(text) and text[at] in BLANKS:
            at += 1
            heads.add(at)
    return ends, {m.start() for m in STARS.finditer(text)}, heads


def _first_in_tasks(rows: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
    """term, appear, defo by task, for a block of terms; rows: order, text, lower.

    One pass over each text: an automaton finds the terms in it, and where one ends the shapes of a
    definition are looked up by their places, so a text is never searched for one term.
    """
    kind = rows.schema["order"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        terms = [t for _, t in shared.value]
        plain, cased = ahocorasick.Automaton(), ahocorasick.Automaton()
        for automaton, keys in ((plain, [low for low, _ in shared.value]), (cased, [_folded(t) for t in terms])):
            by: dict[str, list[int]] = {}
            for i, key in enumerate(keys):
                by.setdefault(key, []).append(i)
            for key, own in by.items():
                automaton.add_word(key, (len(key), tuple(own)))
            automaton.make_automaton()
        appear: dict = {}
        defo: dict = {}
        order_kind = None
        for batch in batches:
            order_kind = batch.schema.field(0).type
            for order, text, lower in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if order is None or not text or not len(plain):
                    continue
                held = set()
                for _, (_, own) in plain.iter(lower):
                    held.update(own)
                for i in held:
                    if i not in appear or order < appear[i]:
                        appear[i] = order
                wanted = {i for i in held if i not in defo or order < defo[i]}
                if not wanted:
                    continue
                low = _folded(text)
                ends, stars, heads = _definition_places(low)
                if not (ends or stars or heads):
                    continue
                for last, (n, own) in cased.iter(low):
                    e = last + 1
                    b = e - n
                    if e in ends or e in stars and b >= 2 and low.startswith("**", b - 2) or b in heads and not (e < len(low) and (low[e].isalnum() or low[e] == "_")):
                        for i in wanted.intersection(own):
                            defo[i] = order
        if order_kind is not None:
            found = sorted(appear)
            yield pa.RecordBatch.from_arrays([pa.array([terms[i] for i in found], pa.string()), pa.array([appear[i] for i in found], order_kind), pa.array([defo.get(i) for i in found], order_kind)], names=["term", "appear", "defo"])

    return rows.mapInArrow(run, f"term string, appear {kind}, defo {kind}")


def first_places(parts: DataFrame, vocab: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, term, appear, defo: the first order where a term appears, and is defined.

    parts: keys, order (a plain value), text; vocab: keys, term. Without keys texts are searched
    for all terms at once, a pass for every TERMS_AT_ONCE of them, and tasks hand on a row a
    term; with keys, the terms of a course meet its own texts. A text is searched by pattern
    only for the terms it holds. Terms that appear nowhere are left out.
    """
    lower = parts.select(*keys, "order", "text", F.lower("text").alias("lower"))
    if not keys:
        found = None
        for block in _blocks(vocab.distinct()):
            more = _first_in_tasks(lower, block)
            found = more if found is None else found.unionByName(more)
        return found.groupBy("term").agg(F.min("appear").alias("appear"), F.min("defo").alias("defo"))
    met = lower.join(vocab, list(keys)).where(F.contains("lower", F.lower("term")))
    defined = is_defined(F.col("text"), F.col("term"))
    return met.groupBy(*keys, "term").agg(F.min("order").alias("appear"), F.min(F.when(defined, F.col("order"))).alias("defo"))


def detect_terms(parts: DataFrame, keys: tuple[str, ...] = (), vocab: DataFrame | None = None) -> DataFrame:
    """keys, term, kind, appear, defo: terms used before they are defined, or never defined."""
    if vocab is None:
        vocab = parts.select(*keys, F.explode(terms(F.col("text"))).alias("term")).distinct()
    found = first_places(parts, vocab, keys)
    kind = F.when(F.col("defo").isNull(), "orphan_concept").when(F.col("appear") < F.col("defo"), "used_before_introduction")
    return found.withColumn("kind", kind).where("kind is not null")


def defined_strings(vocab: DataFrame):
    """A function from batches of order and text to order and folded: what a text defines, in
    folded case and up to the longest term. Terms sent along, if few enough, sift it before it
    is joined with them."""
    longest = vocab.agg(F.coalesce(F.max(F.length("term")), F.lit(0))).first()[0]
    known = None
    if vocab.count() <= SIFTED_TERMS:
        known = vocab.sparkSession.sparkContext.broadcast(frozenset(r.term.casefold() for r in vocab.select("term").toLocalIterator()))
    end = re.compile(r"(?=(?P<any>\s*[—–-]\s|\s+is\s|\s+means\b|\s*:\s)|\*\*)", re.I)
    head = re.compile(r"^#{2,6}", re.M)

    def find(batches):
        import pyarrow as pa

        held = known.value if known is not None else None
        for batch in batches:
            orders, strings = [], []
            for order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, out = text or "", set()
                for m in end.finditer(text):
                    e = m.start()
                    for b in range(max(0, e - longest), e):
                        if m["any"] or text[max(0, b - 2) : b] == "**":
                            out.add(text[b:e].casefold())
                for m in head.finditer(text):
                    # Fewer hashes and less white space leave the rest to the term.
                    b, spaces = m.start() + 2, re.compile(r"\s*").match(text, m.end()).end()
                    for b in range(b, spaces + 1):
                        if b > m.end() and not text[m.end() : b].isspace():
                            break
                        for e in range(b + 1, min(len(text), b + longest) + 1):
                            if e == len(text) or not (text[e].isalnum() or text[e] == "_"):
                                out.add(text[b:e].casefold())
                out = out if held is None else out & held
                orders += [order] * len(out)
                strings += out
            yield pa.RecordBatch.from_arrays([pa.array(orders, pa.int64()), pa.array(strings, pa.string())], ["order", "folded"])

    return find


def _seams(low: Column) -> Column:
    """The seams of a lower-case text: left, right, and how many letters left begins with."""
    sides = [F.regexp_extract_all(low, F.lit(SEAM), F.lit(i)) for i in (1, 2)]
    return F.zip_with(*sides, lambda a, b: F.struct(a.alias("left"), b.alias("right"), F.length(F.regexp_extract(a, r"^[\p{L}\p{N}]+", 0)).alias("n")))


def seamed(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """order, term: terms with a seam and the texts before their source that have one of their
    seams, as far as SEAM looks.

    A term inside a text has its seams there: its left side ends what stands there, its right
    side starts it. So words that many texts hold bring no pairs about, if what stands beside
    them differs. terms: term, low, source; texts: order, lower.
    """
    longest = F.array_max(F.transform(_seams(F.col("low")), lambda x: F.struct((F.length(x["left"]) + F.length(x["right"])).alias("size"), x.alias("x"))))["x"]
    own = terms.withColumn("s", longest).where("s is not null").select("term", "source", "s.*")
    p = F.least(F.col("n"), F.lit(SEAM_KEY))
    # What a term ends with may go on in the text, but for its first character.
    key = F.when(F.col("right") == "", F.substring("left", F.col("n") - p + 1, p + 1)).otherwise(F.concat(F.substring("left", F.col("n") - p + 1, F.length("left")), F.substring("right", 1, SEAM_KEY)))
    own = saved(own.select("term", "source", F.col("left").alias("tail"), F.col("right").alias("head"), F.col("n").alias("m"), key.alias("key")))
    seams = texts.select("order", F.explode(F.array_distinct(_seams(F.col("lower")))).alias("s")).select("order", "s.*")
    seams = seams.select("*", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(SEAM_KEY)))).alias("p")).withColumn("end", F.substring("left", F.col("n") - F.col("p") + 1, F.length("left")))
    seams = seams.select("order", "left", "right", "n", "p", "end", F.explode(F.sequence(F.lit(0), F.least(F.length("right"), F.lit(SEAM_KEY)))).alias("q"))
    key = F.when(F.col("q") == 0, F.substring("end", F.lit(1), F.col("p") + 1)).otherwise(F.concat("end", F.substring("right", F.lit(1), F.col("q"))))
    met = seams.select("order", "left", "right", "n", key.alias("key")).join(F.broadcast(own) if own.count() <= SIFTED_TERMS else own, "key").where("order < source and n >= m")
    ends = F.startswith(F.substring("left", F.col("n") - F.col("m") + 1, F.length("left")), "tail")
    return met.where(F.when(F.col("head") == "", ends).otherwise(F.endswith("left", "tail") & F.startswith("right", "head"))).select("order", "term")


def detect_all(parts: DataFrame) -> DataFrame:
    """detect_terms over the texts' own vocabulary, without a meeting of each term and each text.

    parts: order (a whole number, one text each), text. A term is inside a text where its
    longest run of letters and digits is inside a word; words are taken apart once each, and
    texts are searched only up to the first one that gave the term. Terms of words that meet at
    more than a space are looked for where such seams are (`seamed`). What stands before the end
    of a definition's shape is joined with the terms.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def folded(values):
        return values.str.casefold()

    run = r"[\p{L}\p{N}]+"
    parts = parts.select(F.col("order").cast("long").alias("order"), "text")
    vocab = parts.select("order", F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.min("order").alias("source"))
    runs = F.regexp_extract_all(F.lower("term"), F.lit(run), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    vocab = saved(vocab.select("term", "source", F.lower("term").alias("low"), longest.alias("piece")))
    # Lower case of these depends on what stands beside them; terms without a run have no piece.
    odd = F.col("piece").isNull() | F.col("term").rlike("[Σİ]")
    plain = vocab.where(~odd)
    texts = parts.select("order", F.lower("text").alias("lower"))
    words = saved(texts.select("order", F.explode(F.array_distinct(F.regexp_extract_all("lower", F.lit(run), F.lit(0)))).alias("word")))
    pieces = saved(plain.select("piece").distinct())
    least, most, n = pieces.agg(F.coalesce(F.min(F.length("piece")), F.lit(1)), F.coalesce(F.max(F.length("piece")), F.lit(0)), F.count("*")).first()
    each = words.select("word").distinct().repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = each.where(F.length("word") >= least).withColumn("b", F.explode(F.sequence(F.lit(1), F.length("word") - least + 1)))
    ends = F.least(F.lit(most), F.length("word") - F.col("b") + 1)
    each = each.select("word", F.explode(F.transform(F.sequence(F.lit(least), ends), lambda k: F.substring("word", F.col("b"), k))).alias("piece"))
    # Few pieces go to the words, so what words hold needn't be dealt out.
    inside = each.join(F.broadcast(pieces) if n <= SIFTED_TERMS else pieces, "piece").distinct()
    inside = saved(inside)
    first = words.groupBy("word").agg(F.min("order").alias("at")).join(inside, "word").groupBy("piece").agg(F.min("at").alias("at"))
    single = plain.where("low = piece").join(first, "piece").select("term", F.least("at", "source").alias("at"))
    several = plain.where("low <> piece")
    loose = several.where(~F.col("low").rlike(SEAM))
    held = inside.join(loose.select("piece").distinct(), "piece", "left_semi").join(words, "word").select("piece", "order").distinct()
    loose = loose.join(held, "piece").where("order < source").select("order", "term")
    near = seamed(several, texts).union(loose).groupBy("order").agg(F.collect_set("term").alias("near"))
    met = near.join(texts, "order").select("order", F.explode(F.filter("near", lambda t: F.contains("lower", F.lower(t)))).alias("term"))
    longer = met.select("term", F.col("order").alias("at"))
    rest = texts.join(F.broadcast(vocab.where(odd))).where(F.contains("lower", F.col("low"))).select("term", F.col("order").alias("at"))
    appear = single.union(longer).union(rest).union(plain.select("term", F.col("source").alias("at"))).groupBy("term").agg(F.min("at").alias("appear"))
    said = parts.mapInArrow(defined_strings(vocab), "order long, folded string").groupBy("folded").agg(F.min("order").alias("defo"))
    found = appear.withColumn("folded", folded("term")).join(said, "folded", "left").drop("folded")
    kind = F.when(F.col("defo").isNull(), "orphan_concept").when(F.col("appear") < F.col("defo"), "used_before_introduction")
    return found.select("term", kind.alias("kind"), "appear", "defo").where("kind is not null")


def first_units(detected: DataFrame, units: DataFrame) -> DataFrame:
    """detected with the first unit whose text holds the term (null for terms of headings).

    units: lecture_order, lecture, i, unit, text.
    """
    held = units.select("lecture_order", "lecture", "i", "unit", F.lower("text").alias("lower"))
    met = holding(held, "lower", detected.select("term").distinct()).withColumn("term", F.explode("held"))
    first = met.groupBy("term").agg(F.min_by(F.struct("lecture", "unit"), F.struct("lecture_order", "i")).alias("f"))
    return detected.join(first, "term", "left").select(*detected.columns, F.col("f.lecture").alias("first_lecture"), F.col("f.unit").alias("first_unit"))


def keyword_hits(specs: DataFrame, detected: DataFrame) -> DataFrame:
    """specs with kw_detected: whether a term found in the injected course matches the target;
    null for placebos. specs: spec, type, target; detected: spec, term, kind."""
    hit = detected.join(specs.select("spec", F.col("type").alias("kind"), "target"), ["spec", "kind"]).where(spaced_names_match(F.col("target"), F.col("term")))
    found = specs.join(hit.select("spec").distinct().withColumn("hit", F.lit(True)), "spec", "left")
    return found.withColumn("kw_detected", F.when(F.col("type") != "placebo", F.coalesce("hit", F.lit(False)))).drop("hit")
