"""String columns: normalisation, tag lists, whole-word keyword hits."""
from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.rules.vocabulary import word_forms

WORD = r"[\p{L}\p{N}_]"


def blank(col: Column) -> Column:
    """NULL, NaN text and ``'nan'`` all become the empty string."""
    return F.when(col.isNull() | (col == "nan"), "").otherwise(col)


def contains_any(col: Column, terms: list[str]) -> Column:
    """Is any term a substring?  Long lists are looped over as a constant array:
    one condition per term would make generated methods too long to be compiled."""
    if len(terms) <= 3:
        return reduce(lambda a, b: a | b, [col.contains(t) for t in terms])
    return let(col, lambda text: F.exists(words_literal(terms), lambda w: text.contains(w)))


def substring_tags(col: Column, tag_words: dict[str, list[str]]) -> Column:
    """Tags with a word that is a substring of the text, in table order."""
    table = F.from_json(F.lit(json.dumps([{"tag": t, "words": ws} for t, ws in tag_words.items()])),
                        "array<struct<tag:string,words:array<string>>>")
    return let(col, lambda text: F.transform(
        F.filter(table, lambda r: F.exists(r["words"], lambda w: text.contains(w))), lambda r: r["tag"]))


def keyword_regex(words: list[str]) -> str:
    """One alternation per tag, bounded by anything that is not a word character."""
    forms = dict.fromkeys(form for word in words for form in word_forms(word))
    body = "|".join(re.escape(form) for form in forms)
    return f"(?<!{WORD})(?:{body})(?!{WORD})"


def keyword_match(text: Column, words: list[str]) -> Column:
    """Does any keyword (or its plural) occur as a whole word?  For a few tags;
    for a whole taxonomy use :func:`keyword_hits`."""
    return F.coalesce(F.lower(text).rlike(keyword_regex(words)), F.lit(False))


def keyword_hits(text: Column, words: list[str]) -> Column:
    """All keywords present in ``text``, found in one pass.

    The text is cut once into runs of word and non-word characters.  A whole-word
    keyword of *k* words can only be *k* consecutive word runs with the runs
    between them, so looking those phrases up equals running every keyword's
    regex, at a cost that depends on the text and not on the taxonomy.  Phrases
    are joined only where a run begins some keyword of several words.
    """
    forms: dict[str, str] = {}
    for word in words:
        for form in word_forms(word):
            forms[form] = word
    longest = max(len(re.findall(r"\w+", f)) for f in forms)
    cut = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))),
                               F.lit(f"{WORD}+|[^\\p{{L}}\\p{{N}}_]+"), 0)
    heads = sorted({runs[0] for runs in (re.findall(r"\w+|\W+", f) for f in forms) if len(runs) > 1})
    phrases = let(cut, lambda runs: let(_starts(runs, heads), lambda starts: F.concat(
        runs, *[_phrases(runs, starts, 2 * k - 1) for k in range(2, longest + 1)]))) if heads else cut
    # a constant IN list is one hash set for the whole task
    return F.array_sort(F.array_distinct(F.filter(phrases, lambda p: p.isin(sorted(forms)))))


def _starts(runs: Column, heads: list[str]) -> Column:
    """Positions of the runs that are among ``heads``."""
    positions = F.when(F.size(runs) > 0, F.sequence(F.lit(1), F.size(runs))).otherwise(F.array().cast("array<int>"))
    return F.filter(positions, lambda i: F.get(runs, i - 1).isin(heads))


def _phrases(runs: Column, starts: Column, span: int) -> Column:
    """The stretches of ``span`` consecutive runs from these positions, joined."""
    whole = F.filter(starts, lambda i: i <= F.size(runs) - (span - 1))
    return F.transform(whole, lambda i: F.array_join(F.slice(runs, i, span), ""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def words_literal(words: list[str]) -> Column:
    """A constant array of texts, folded by the optimiser."""
    if any("\n" in w for w in words):
        raise ValueError("words must not contain line breaks")
    if not words:
        return F.array().cast("array<string>")
    return F.split(F.lit("\n".join(words)), "\n")


def lookup(pairs: dict[str, list[str]]) -> Column:
    """A literal map<string, array<string>> of the rules, which are configuration and not data."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,array<string>>")


def tags_for_hits(hits: Column, tag_words: dict[str, list[str]]) -> Column:
    """Tags whose keywords are among the hits, sorted."""
    by_form: dict[str, list[str]] = {}
    for tag, words in tag_words.items():
        for word in words:
            for form in word_forms(word):
                if tag not in by_form.setdefault(form, []):
                    by_form[form].append(tag)
    table = lookup(by_form)
    found = F.filter(F.transform(hits, lambda h: F.try_element_at(table, h)),
                     lambda tags: tags.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(found)))


GRAM = 4


def containing(rows: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """``rows`` joined to the ``words`` (distinct, not empty) that their ``text`` contains.

    A word is looked up by one gram of it, the one that fewest words have; a text is cut into grams of
    that length only, so it gives at most ``GRAM`` rows per character however long words are.  What
    meets is verified by ``contains``.
    """
    size = F.least(F.length(word), F.lit(GRAM))
    grams = words.select(word, F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(word) - size + 1), lambda i: F.substring(F.col(word), i, size)))).alias("_gram"))
    common = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    chosen = grams.join(common, "_gram").groupBy(word).agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    sizes = chosen.agg(F.collect_set(F.length("_gram")).alias("_n")).scalar()  # 1 to GRAM at most
    cut = rows.select("*", F.explode(sizes).alias("_k")).filter(F.length(text) >= F.col("_k"))
    starts = F.sequence(F.lit(1), F.length(text) - F.col("_k") + 1)
    pieces = cut.select(*rows.columns, F.explode(F.array_distinct(F.transform(
        starts, lambda i: F.substring(F.col(text), i, F.col("_k"))))).alias("_gram"))
    return pieces.join(chosen, "_gram").filter(F.contains(F.col(text), F.col(word))).drop("_gram")


def split_tags(col: Column, lower: bool = False) -> Column:
    """Comma-separated tags to a trimmed list without blanks."""
    source = F.lower(col) if lower else col
    parts = F.transform(F.split(F.coalesce(source, F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, ", ")


def normalise_tag(col: Column) -> Column:
    """Lower case, number joined to its unit, blanks to underscores."""
    low = F.trim(F.lower(F.coalesce(col, F.lit(""))))
    joined = F.regexp_replace(low, r"(\d+(?:\.\d+)?)\s*(mg|ml|ohm)", "$1$2")
    return F.regexp_replace(joined, r"\s+", "_")


def squeeze(col: Column) -> Column:
    """Blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def similar_handle_audit(handle: Column) -> Column:
    """Handle without size and pack endings: the auditor's form."""
    base = F.regexp_replace(F.lower(handle), r"[-_]", " ")
    base = F.regexp_replace(base, r"\d+(ml|mg|pcs?|pack).*", "")
    return squeeze(base)


def similar_handle_strict(handle: Column) -> Column:
    """Handle without size and pack endings: the validator's form."""
    base = F.regexp_replace(F.lower(handle), r"-\d+(ml|mg|pcs?|pack).*", "")
    base = F.regexp_replace(base, r"\d+(ml|mg|pcs?|pack).*", "")
    return F.trim(F.regexp_replace(base, r"[-_\s]+", " "))


def slug(title: Column) -> Column:
    """Catalog handle from a title."""
    base = F.regexp_replace(F.lower(title), r"[^a-z0-9\s-]", "")
    base = F.regexp_replace(base, r"\s+", "-")
    base = F.regexp_replace(base, r"-+", "-")
    return F.regexp_replace(base, r"^-+|-+$", "")


def file_slug(name: Column) -> Column:
    """Name usable as a file name, at most 100 characters."""
    base = F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("-")), r"-+", "-")
    return F.substring(F.regexp_replace(base, r"[^\p{L}\p{N}_-]", ""), 1, 100)


def html_paragraphs(text: Column) -> Column:
    """Blank-line separated text to ``<p>`` lines."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"),
                        lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    wrapped = F.transform(F.filter(parts, lambda p: p != ""),
                          lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>")))
    return F.array_join(wrapped, "\n")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def first_words(text: Column, n: int = 50) -> Column:
    """Summary of the first ``n`` words."""
    return F.array_join(F.slice(words_of(text), 1, n), " ")


# Words that count as basic tags when found in a description.
BASIC_TAG_WORDS = ["new", "premium", "quality", "professional", "modern", "classic"]


def basic_tags(name: Column, description: Column) -> Column:
    """Up to ten plain tags; ours are sorted because the source order is a set's."""
    longer = F.filter(words_of(F.lower(name)), lambda w: F.length(w) > 3)
    low = F.lower(F.coalesce(description, F.lit("")))
    common = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in BASIC_TAG_WORDS]))
    return F.slice(F.array_sort(F.array_distinct(F.concat(longer, common))), 1, 10)


def number_text(value: Column) -> Column:
    """Number as text without a trailing ``.0``."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")) \
        .otherwise(value.cast("string"))


def float_text(value: Column) -> Column:
    """Number as text with at least one decimal and no exponent."""
    return F.when(value == F.floor(value), F.concat(value.cast("bigint").cast("string"), F.lit(".0"))) \
        .otherwise(value.cast("string"))


def fixed(value: Column, digits: int) -> Column:
    """Number with fixed decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))
