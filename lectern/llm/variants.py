"""Spelling variants: anagram hashing finds words one letter apart."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, read

#: Runs that count as words, once A-Z is lower-cased: ASCII letters and the letters of Latin-1.
RUN = "[a-zÀ-ÿ]+"
#: Letters of a word and occurrences overall, at least; how much commoner a form must be.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: Of the runs of documents, those whose checksum this number divides lose a letter.
DROPPED = 31
#: A letter counts as its place to this power: no two pairs of letters have equal sums.
POWER = 5


def runs(docs: DataFrame) -> DataFrame:
    """word: the letter runs of whole texts, A-Z lower-cased; null texts have none.

    Where DROPPED divides the checksum of "<doc_id>:<run>", the run loses one code point. A
    null doc_id counts as an empty string. Runs too short to count are left out at once.
    """
    lower = F.translate(F.col("text").cast("string"), ascii_uppercase, ascii_lowercase)
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    own = own.where(F.length("run") >= LEAST_LETTERS)
    sum_ = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = F.pmod(sum_, F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return own.select(F.when(sum_ % DROPPED == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and common enough. words: a row an occurrence."""
    long = words.where(F.length("word") >= least_letters)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_value(letter: Column) -> Column:
    """A letter's place among a-z and the letters of Latin-1, from 1, to the power POWER."""
    code = F.ascii(letter).cast("long")
    place = F.when(code < 128, code - (ord("a") - 1)).otherwise(code - 0xC0 + 27)
    value = place
    for _ in range(POWER - 1):
        value = value * place
    return value


def anagram_key(letters: Column) -> Column:
    """The sum of the values of an array of letters; the same for all their orders."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + letter_value(c))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each two words that one inserted, deleted or replaced letter parts, once.

    words: word, n; distinct. A word stands under its own key and under its key less the value
    of each of its letters. Where the key of one is another's less a letter, they differ by an
    addition or removal; where both are less a letter, by an exchange. Keys know no order, so
    words must also agree in the half of the letters that the edit leaves alone, the first or
    the last; then the order of all letters is verified. Anagrams alone thus don't meet.
    """
    letters = F.split("word", "(?!^)(?!$)")
    rows = words.select("word", "n", F.length("word").alias("m"), letters.alias("letters")).withColumn("key", anagram_key(F.col("letters")))

    def half(size: Column, last: bool) -> Column:
        """The letters left alone, of a word whose shorter partner has `size` letters."""
        first = F.floor(size / 2).cast("int")
        return F.expr("substring(word, m - rest + 1, rest)") if last else F.substring("word", F.lit(1), first)

    def sides(rows: DataFrame, size: Column) -> DataFrame:
        own = rows.withColumn("rest", (size - F.floor(size / 2)).cast("int"))
        return own.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("half", F.when(F.col("side") == 0, half(size, False)).otherwise(half(size, True)))

    whole = sides(rows, F.col("m")).select("key", "side", F.xxhash64("half").alias("half"), "word", "n")
    less = rows.withColumn("c", F.explode(F.array_distinct("letters"))).withColumn("key", F.col("key") - letter_value(F.col("c")))
    less = sides(less, F.col("m") - 1)
    # The letter that goes must stand outside the half that stays.
    edited = F.when(F.col("side") == 0, F.expr("substring(word, m - rest, m)")).otherwise(F.expr("substring(word, 1, m - rest)"))
    less = less.where(F.contains(edited, F.col("c"))).select("key", "side", F.xxhash64("half").alias("half"), "word", "n", "c")
    by = ["key", "side", "half"]
    a = less.select(*by, F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"))
    # A word under its own key has lost no letter; both kinds meet in one join.
    b = whole.withColumn("c", F.lit("")).unionByName(less).select(*by, F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"))
    met = a.join(b, by).where("c_a <> c_b and (c_b = '' or a < b)")
    # Pairs that agree in the first half were met under it already.
    first = F.floor(F.when(F.col("c_b") == "", F.length("b")).otherwise(F.length("b") - 1) / 2).cast("int")
    new = (F.col("side") == 0) | (F.substring("a", F.lit(1), first) != F.substring("b", F.lit(1), first))
    return met.where(new & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def group(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n; distinct words).

    A word's form is its commonest near word (ties: the first in code-point order) where that is
    at least `times` as common; its root is where the forms lead. Forms grow `times`-fold at
    each step, so there are few steps and no cycles. Words without near words have themselves
    as root and n_near 0; an empty vocabulary gives no rows.
    """
    scratch = Scratch(words.sparkSession)
    kept = scratch.save(words.select("word", "n"))
    pairs = near_pairs(kept)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n"))))
    near = pairs.select(sides.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    best = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    is_form = F.col("near_n") >= times * F.col("n")
    found = kept.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    found = scratch.save(found)
    jumps = scratch.save(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = jumps.join(jumps.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = scratch.save(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jumps = step.select("word", "root")
        scratch.drop(found, step)
        if step.where("moved").isEmpty():
            break
    return found.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(vocabulary(runs(read(spark, sf_dir, "documents"))))
