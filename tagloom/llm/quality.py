"""Quality rules whose cutoffs are chosen with a bound on false rejection.

Every rule is a number that grows with badness.  Documents labelled as good are the holdout: in each
stratum, for each rule and each cutoff of a fixed grid, the exact binomial tail tells how likely so few
rejections of good documents would be if the rule rejected a share ``risk`` of them or more.  The lowest
cutoff that passes, corrected for the number of tests, is used; a rule without one is off in that stratum.
Everything is DataFrame expressions.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.text import let
from tagloom.llm.stored import stored
from tagloom.session import cut

WINDOW = 5
MOST_SENT = 10_000  # strata whose cutoffs go to all tasks
#: The cutoffs tried for each rule, from the strictest on.
GRID = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0],
    "dup_line_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeat_share": [0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18],
    "capital_share": [0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "exclamations_per_word": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0],
}


def one_line(text: Column) -> Column:
    """The words of a text (runs of anything but ASCII white space) with one space between; '' for null."""
    for space in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), " {2,}", " "))


def repeated_words(line: Column) -> Column:
    """How many words lie in windows of five words that the text has twice or more.

    One look-ahead pattern cuts all windows out.  A text without a repeated window, as most are, costs one
    look at the distinct windows; else the windows are sorted, equal neighbours kept, and the words they
    cover are counted in order of place.
    """
    windows = F.regexp_extract_all(line, F.lit("(?=([^ ]++" + " [^ ]++" * (WINDOW - 1) + "))[^ ]++ ?+"), F.lit(1))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                                                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")))["n"]

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``id, stratum``, the counts of a text and one column per rule.  Null texts have no words, null strata
    are the stratum ``''``; repeated rows and ids stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda of, letter: F.length(of) - F.length(F.replace(of, F.lit(letter), F.lit("")))
    found = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        let(one_line(text), lambda line: F.struct(
            F.when(line == "", 0).otherwise(without(line, " ") + 1).cast("long").alias("n_words"),
            F.length(F.replace(line, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
            repeated_words(line).cast("long").alias("n_repeat_words"))).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), duplicate_lines(text).cast("long").alias("n_dup_lines"),
        without(text, "!").alias("n_exclamations"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_capitals"), (without(text, "\n") + 1).alias("n_lines"))
    found = found.select("id", "stratum", "w.*", "n_symbols", "n_dup_lines", "n_exclamations", "n_capitals", "n_lines")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return found.select(
        "id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "n_words").alias("symbols_per_word"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_capitals", "word_chars").alias("capital_share"),
        share("n_exclamations", "n_words").alias("exclamations_per_word"))


def log_gamma(x: Column) -> Column:
    """Stirling's series, moved up by 8 so that it is exact to about 1e-12 for x >= 1."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - reduce(lambda a, b: a + b, [F.log(x + k) for k in range(8)])


def binomial_tail(k: Column, n: Column, p: float, terms: int = 2000) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n p, else 1.

    Terms fall from ``k`` down by a ratio under 1 that keeps falling; they are summed until ``terms``, and the
    rest is bounded by its geometric series, so the value is never too low.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    summed = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(terms)).cast("int")), start,
        lambda acc, j: F.struct((acc["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")))
    rest = let(summed, lambda s: s["sum"] + s["term"] / F.greatest(F.lit(1e-12), 1 - k / (n - k + 1) * ((1 - p) / p)))
    return F.when((n <= 0) | (k >= n * p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * rest))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, confidence: float = 0.95, id_col: str = "doc_id",
            good: Column | None = None) -> DataFrame:
    """``stratum``, and for each rule its cutoff or null.

    The holdout is every labelled good document that passes the base rule.  Each rule may reject a share of
    ``risk / rules`` of the good documents of a stratum at most, so all rules together ``risk``; that holds
    for all strata and rules at once with ``confidence``.  A rule's cutoffs are tested in a fixed order, the
    laxest first, until one fails, so they need no correction among themselves; strata and rules get
    Bonferroni's.  Repeated labels of a document count once.
    """
    good = F.col("quality") == 1 if good is None else good
    holdout = labels.filter(good).select(F.col(id_col).alias("label_id")).distinct()
    held = measured.filter(~F.col("base_failed")).join(holdout, F.col("id") == F.col("label_id"), "left_semi")
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *[
        F.count_if(F.col(rule) > c).alias(f"{rule}_{i}") for rule, grid in GRID.items() for i, c in enumerate(grid)])
    tests = counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("strata")))).select("stratum", "n", "strata", F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.col(f"{rule}_{i}").alias("k")) for rule, grid in GRID.items() for i in range(len(grid))])))
    level = (1 - confidence) / (F.col("strata") * len(GRID))
    failed = tests.filter(binomial_tail(F.col("k"), F.col("n"), risk / len(GRID)) > level).groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("i"))).alias(rule) for rule in GRID])
    # the cutoff after the last that failed; none is left where the laxest failed
    return counts.select(F.col("stratum").alias("of")).join(failed, F.col("of") == F.col("stratum"), "left").select(F.col("of").alias("stratum"), *[
        F.get(F.array(*map(F.lit, grid)), F.coalesce(F.col(rule), F.lit(-1)) + 1).alias(f"cut_{rule}") for rule, grid in GRID.items()])


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, confidence: float = 0.95, id_col: str = "doc_id",
          text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The counts of every document, ``base_failed`` and ``kept``; the measured texts are written once."""
    measured = cut(features(docs, id_col, text_col, stratum_col))
    chosen = stored(cutoffs(measured, labels, risk, confidence, id_col).withColumnRenamed("stratum", "of"))
    if chosen.count() <= MOST_SENT:  # else strata are many, and none can be very hot
        chosen = F.broadcast(chosen)
    over = reduce(lambda a, b: a | b, [F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False)) for rule in GRID])
    return (measured.join(chosen, F.col("stratum") == F.col("of"), "left")
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ~over).alias("kept"), *GRID))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, confidence: float = 0.95, id_col: str = "doc_id",
              text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep; columns as they are.  Rows are told apart by id, text and
    stratum together, so null and repeated ids are judged each by its own text."""
    key = [F.col(id_col), F.xxhash64(F.col(text_col), F.col(stratum_col))]
    keyed = docs.select(F.struct(key[0].alias("id"), key[1].alias("h")).alias("row_key"), F.col(id_col).alias("label_id"), F.col(text_col).alias("text"),
                        F.col(stratum_col).alias("stratum"))
    good = labels.filter("quality = 1").select(F.col(id_col).alias("of")).distinct()
    good = keyed.join(good, F.col("label_id") == F.col("of"), "left_semi").select("row_key", F.lit(1).alias("quality"))
    verdicts = judge(keyed, good, risk, confidence, "row_key", "text", "stratum")
    bad = verdicts.filter(~F.col("kept")).select(F.col("row_key").alias("bad_key")).distinct()
    # the caller's columns may have any names, so they stay in a struct of their own
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(key[0].alias("id"), key[1].alias("h")).alias("own_key"))
    return held.join(bad, F.col("own_key.id").eqNullSafe(F.col("bad_key.id")) & (F.col("own_key.h") == F.col("bad_key.h")), "left_anti").select("row.*")
