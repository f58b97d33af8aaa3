"""A sentence model learned from a corpus: which words with a period are abbreviations, which follow
them without a break, and which words start sentences.

Words are counted once over all texts, and log-likelihood ratios of the counts decide, after Kiss and
Strunk's unsupervised method: an abbreviation nearly always has its period, is short, and may have
periods inside; a collocation goes on over the period of a number or an initial; a starter follows
the ends of sentences more often than chance.  All that reaches its score is learned: few words are told
to all tasks, many meet the words of texts by joins.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least log-likelihood scores (fixed values of the published method).
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Learned words and pairs that are told to all tasks, at most; more are joined.
TOLD = 50_000
NUMBER = "##number##"
OPENERS, CLOSERS = "[\"'(\\[{«“‘]", "[\"')\\]}»”’]"


def core(word: Column) -> Column:
    """A word without quotes and brackets around it, or a comma after it."""
    return F.regexp_replace(word, f"^{OPENERS}+|{CLOSERS[:-1]},;:]+$", "")


def word_type(core_: Column) -> Column:
    """What is counted: lower case, without its last period or marks; numbers are one type."""
    bare = F.lower(F.regexp_replace(core_, r"[.!?]+$", ""))
    return F.when(bare.rlike(r"^-?[0-9][0-9.,]*$"), NUMBER).otherwise(bare)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


#: A word with a mark, after which alone a sentence can end, and the next word.  Each position is tried once.
MARKED = r"(?<!\S)([^\s.!?]*+[.!?]\S*+)(?=\s++(\S++))"


def marked_pairs(text: Column) -> Column:
    """array<struct<a, b>>: the words of a text with a mark in them, but for its last word, each with the next word."""
    return F.zip_with(F.regexp_extract_all(text, F.lit(MARKED), F.lit(1)), F.regexp_extract_all(text, F.lit(MARKED), F.lit(2)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(core, type, n): words are counted as they are written, so that each is looked into once."""
    n = df.where(F.col(text).isNotNull()).select(F.explode(words_of(F.col(text))).alias("_a")).groupBy("_a").agg(F.count("*").alias("n"))
    return n.select(core(F.col("_a")).alias("core"), "n").select("core", word_type(F.col("core")).alias("type"), "n")


def word_pairs(df: DataFrame, text: str = "text", marked: bool = False) -> DataFrame:
    """(core, type, next, n) of pairs of words: how the first is written, its type, that of the next one (null after
    the last), and how often they come; if ``marked``, of words with a mark that another one follows."""
    words = words_of(F.col(text))
    every = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = df.where(F.col(text).isNotNull()).select(F.explode(marked_pairs(F.col(text)) if marked else every).alias("_p"))
    n = pairs.groupBy(F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b")).agg(F.count("*").alias("n"))
    cores = n.select(core(F.col("_a")).alias("core"), core(F.col("_b")).alias("_b"), "n")
    return cores.select("core", word_type(F.col("core")).alias("type"), word_type(F.col("_b")).alias("next"), "n")


def has_period(core_: Column) -> Column:
    return core_.rlike(r"[^.]\.$")


def type_counts(words: DataFrame) -> DataFrame:
    """(type, with_period, n) of words or pairs with their counts."""
    period = F.when(has_period(F.col("core")), F.col("n")).otherwise(0)
    return words.where("type <> ''").groupBy("type").agg(F.sum(period).alias("with_period"), F.sum("n").alias("n"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """(type, with_period, n, score) of each type with letters that has been seen with a period: the
    log-likelihood that its periods are not those of sentences, less for long words and for each
    time that it came without one."""
    totals = counts.agg(F.sum("with_period").alias("_p"), F.sum("n").alias("_t"))
    x = counts.crossJoin(F.broadcast(totals)).where((F.col("with_period") > 0) & F.col("type").rlike(r"\p{L}"))  # one row
    a, n = F.col("with_period").cast("double"), F.col("n").cast("double")
    p = F.col("_p") / F.col("_t")
    null = a * F.log(p) + F.when(a < n, (n - a) * F.log(1 - p)).otherwise(0.0)
    other = a * F.log(F.lit(0.99)) + (n - a) * F.log(F.lit(1.0) - 0.99)
    periods = F.regexp_count("type", F.lit(r"\.")) + 1
    letters = F.length("type") - periods + 1
    score = -2 * (null - other) * F.exp(-letters.cast("double")) * periods * F.pow(letters.cast("double"), a - n)
    return x.select("type", "with_period", "n", score.alias("score"))


def likelihood(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio that b comes with a; 0 where it comes less often than by chance."""
    a, b, ab, n = (x.cast("double") for x in (a, b, ab, n))
    xlog = lambda k, p: F.when(k > 0, k * F.log(p)).otherwise(0.0)
    rest = n - a - b + ab
    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / (n - a)).otherwise(1.0)
    together = xlog(ab, p) + xlog(a - ab, 1 - p) + xlog(b - ab, p) + xlog(rest, 1 - p)
    apart = xlog(ab, p1) + xlog(a - ab, 1 - p1) + xlog(b - ab, p2) + xlog(rest, 1 - p2)
    return F.when(ab * n > a * b, -2 * (together - apart)).otherwise(0.0)


def is_initial(core_: Column) -> Column:
    return core_.rlike(r"^\p{Lu}\.$")


def train(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, word, next, score) of what was learned: ``abbreviation``, ``collocation`` (word and next)
    and ``starter``.  Null and empty texts teach nothing; without periods nothing is learned.

    Texts are read twice: what is counted is kept by the executors, and has a row for each type, or pair."""
    counts = type_counts(word_counts(df, text)).cache()
    short = abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION).select("type", "score")
    n = counts.agg(F.sum("n").alias("_t"))
    ends = word_pairs(df, text, marked=True).where(F.col("core").rlike(r"[.!?]$") & (F.col("next") != "")).cache()
    loose = (F.col("type") == NUMBER) | is_initial(F.col("core"))
    joined = ends.where(loose & has_period(F.col("core"))).groupBy("type", "next").agg(F.sum("n").alias("ab")).where("ab > 1")
    first, second = (counts.select(F.col("type").alias(k), F.col("n").alias(v)) for k, v in (("type", "a"), ("_b", "b")))
    joined = joined.join(first, "type").join(second, F.col("next") == F.col("_b")).crossJoin(F.broadcast(n))
    joined = joined.withColumn("score", likelihood(F.col("a"), F.col("b"), F.col("ab"), F.col("_t"))).where(F.col("score") >= COLLOCATION)
    breaks = ends.where(~loose).join(short.select(F.col("type").alias("_s")), F.col("type") == F.col("_s"), "left_anti")
    whole = breaks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_breaks"))
    starts = breaks.where(F.col("next").rlike(r"^\p{L}+$")).groupBy("next").agg(F.sum("n").alias("ab")).join(second, F.col("next") == F.col("_b"))
    starts = starts.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(n))
    starts = starts.withColumn("score", likelihood(F.col("_breaks"), F.col("b"), F.col("ab"), F.col("_t"))).where(F.col("score") >= STARTER)
    none = F.lit(None).cast("string")
    return (
        short.select(F.lit("abbreviation").alias("kind"), F.col("type").alias("word"), none.alias("next"), "score")
        .unionByName(joined.select(F.lit("collocation").alias("kind"), F.col("type").alias("word"), "next", "score"))
        .unionByName(starts.select(F.lit("starter").alias("kind"), F.col("next").alias("word"), none.alias("next"), "score"))
    )


@dataclass(frozen=True)
class SentenceModel:
    """What was learned, as sets."""

    abbreviations: frozenset = field(default_factory=frozenset)
    collocations: frozenset = field(default_factory=frozenset)
    starters: frozenset = field(default_factory=frozenset)

    @staticmethod
    def of(learned: DataFrame) -> SentenceModel:
        rows = learned.collect()  # for few members: ``counting`` takes any number
        return SentenceModel(
            frozenset(r["word"] for r in rows if r["kind"] == "abbreviation"), frozenset((r["word"], r["next"]) for r in rows if r["kind"] == "collocation"),
            frozenset(r["word"] for r in rows if r["kind"] == "starter"),
        )

    def flags(self, words: Column) -> Column:
        """For each word of an array, whether a sentence ends after it.

        Marks end one; so does a period, but for one of an initial or a collocation, of an abbreviation
        before anything but a capital that starts sentences, of a number or dots before a small letter.
        The last word ends one always."""
        told = self  # sent with the function

        @F.pandas_udf("array<boolean>")
        def run(cores: pd.Series, types: pd.Series) -> pd.Series:
            return pd.Series([None if c is None else told.ends(list(c), list(t)) for c, t in zip(cores, types)])

        cores = F.transform(words, core)
        return run(cores, F.transform(cores, word_type))

    def ends(self, cores: list[str], types: list[str]) -> list[bool]:
        return [self.breaks(*x) for x in zip(cores, types, cores[1:], types[1:])] + [True] * bool(cores)

    def breaks(self, word: str, kind: str, next_word: str, after: str) -> bool:
        capital = unicodedata.category(next_word[:1] or " ") == "Lu"
        if word[-1:] in ("!", "?"):
            return True
        if word[-1:] != ".":
            return False
        if word.endswith(".."):
            return capital
        if (kind, after) in self.collocations or len(word) == 2 and unicodedata.category(word[0]) == "Lu":
            return False
        if kind in self.abbreviations:
            return capital and after in self.starters
        return capital or kind != NUMBER

    def split(self, text: Column) -> Column:
        """Sentences of a text, their words set apart by single spaces; null for null."""
        words = words_of(text)
        closed = F.transform(F.arrays_zip(words.alias("w"), self.flags(words).alias("e")), lambda x: F.concat(x["w"], F.when(x["e"], "\0").otherwise(" ")))
        return F.filter(F.split(F.array_join(closed, ""), "\0"), lambda s: s != "")

    def count(self, text: Column) -> Column:
        """How many sentences ``split`` makes: only words with a mark are looked into."""
        told = self

        @F.pandas_udf("int")
        def run(pairs: pd.Series) -> pd.Series:
            return pd.Series([0 if p is None else sum(told.breaks(*p[i : i + 4]) for i in range(0, len(p), 4)) for p in pairs], dtype="int32")

        cores = F.transform(marked_pairs(text), lambda x: F.struct(core(x["a"]).alias("a"), core(x["b"]).alias("b")))
        pairs = F.flatten(F.transform(cores, lambda x: F.array(x["a"], word_type(x["a"]), x["b"], word_type(x["b"]))))
        return F.when(text.isNotNull(), run(pairs) + F.when(text.rlike(r"\S"), 1).otherwise(0))


@dataclass(frozen=True)
class Counted:
    """A model whose sentences have been counted: it stands in ``column``."""

    column: str

    def count(self, text: Column) -> Column:
        return F.col(self.column)


def counting(df: DataFrame, learned: DataFrame, text: str = "text") -> tuple[DataFrame, SentenceModel | Counted]:
    """The table, and a model that counts the sentences of ``text`` in it: of few members a model told to
    all tasks, of more one whose counts have been joined to the rows."""
    learned = learned.cache()  # for the executors
    if learned.count() <= TOLD:
        return df, SentenceModel.of(learned)
    return with_counts(df, learned, text, "_sentences"), Counted("_sentences")


def with_counts(df: DataFrame, learned: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, what ``SentenceModel.count`` gives, by joins of pairs of words with what was learned.

    Equal texts have equal counts, so their pairs are summed together, and shared by the number of copies."""
    known = df.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("_h"), text)
    pairs = known.select("_h", F.explode(marked_pairs(F.col(text))).alias("_p")).groupBy("_h", F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b")).agg(F.count("*").alias("_n"))
    x = pairs.select("_h", "_n", core(F.col("_a")).alias("_a"), core(F.col("_b")).alias("_b"))
    x = x.select("*", word_type(F.col("_a")).alias("_type"), word_type(F.col("_b")).alias("_next")).where(F.col("_a").rlike(r"[.!?]$"))
    of = lambda kind, *names: learned.where(F.col("kind") == kind).select(*[F.col(c).alias(f"{kind}_{c}") for c in names])
    x = x.join(of("abbreviation", "word"), F.col("_type") == F.col("abbreviation_word"), "left").join(of("starter", "word"), F.col("_next") == F.col("starter_word"), "left")
    x = x.join(of("collocation", "word", "next"), (F.col("_type") == F.col("collocation_word")) & (F.col("_next") == F.col("collocation_next")), "left")
    capital = F.col("_b").rlike(r"^\p{Lu}")
    ends = (
        F.when(F.col("_a").rlike(r"[!?]$"), True).when(F.endswith("_a", F.lit("..")), capital)
        .when(F.col("collocation_word").isNotNull() | F.col("_a").rlike(r"^\p{Lu}.$"), False)
        .when(F.col("abbreviation_word").isNotNull(), capital & F.col("starter_word").isNotNull()).otherwise(capital | (F.col("_type") != NUMBER))
    )
    inner = x.where(ends).groupBy("_h").agg(F.sum("_n").alias("_ends"))
    inner = inner.join(known.groupBy("_h").agg(F.count("*").alias("_copies")), "_h").select(F.col("_h").alias("_of"), F.expr("_ends div _copies").alias("_ends"))
    last = F.when(F.col(text).rlike(r"\S"), 1).otherwise(0)
    counts = F.when(F.col(text).isNotNull(), (F.coalesce("_ends", F.lit(0)) + last).cast("int"))
    return df.join(inner, F.sha2(text, 256) == F.col("_of"), "left").withColumn(out, counts).drop("_of", "_ends")
