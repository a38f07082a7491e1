"""The word-boundary tag profile: category gate, dimensions, flavours.

Everything here is per-row column logic, dealt evenly over the tasks first; nothing is grouped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import extract as X
from tagloom.functions.text import blank, contains_any, keyword_hits, substring_tags, tags_for_hits, words_literal
from tagloom.rules.vocabulary import (ACCESSORY_OVERRIDES, CATEGORY_ORDER, GATE_REASON,
                                      KeywordRules, Vocabulary, flavour_words, items)
from tagloom.session import spread

# Words that prove a CBD product is a device.
DEVICE_EVIDENCE = ["vape", "vaping", "device", "kit", "pen device", "pod device"]


def _none() -> Column:
    return F.array().cast("array<string>")


def product_text(*cols: str) -> Column:
    """Title, description, … joined by blanks, lower case; NULL counts as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def detected_categories(df: DataFrame, rules: KeywordRules) -> Column:
    """All categories of a product in detection order."""
    google = F.lower(blank(F.coalesce(F.col("product_category"), F.lit("")))) \
        if "product_category" in df.columns else F.lit("")
    kind = F.lower(blank(F.coalesce(F.col("type"), F.lit("")))) if "type" in df.columns else F.lit("")
    text = F.col("_tdh")
    by_word = tags_for_hits(F.col("category_hits"), rules.words["category"])
    in_order = F.array_intersect(words_literal(list(rules.words["category"])), by_word)
    head = F.array_compact(F.array(
        F.when(contains_any(text, items(ACCESSORY_OVERRIDES)), F.lit("accessory")),
        F.when(google.contains("e-liquid"), F.lit("e-liquid")),
        F.when(google.contains("cbd supplement") | (kind == "cbd products"), F.lit("CBD"))))
    return F.array_distinct(F.concat(head, in_order))


def primary_category(detected: Column) -> Column:
    """The category that rules the product: CBD, else the most specific one, else ''."""
    order = words_literal(["CBD"] + items(CATEGORY_ORDER))
    ranked = F.array_intersect(order, detected)
    return F.coalesce(F.get(ranked, F.lit(0)), F.get(detected, F.lit(0)), F.lit(""))


def device_evidence(text: Column) -> Column:
    return contains_any(text, DEVICE_EVIDENCE)


def with_keyword_hits(df: DataFrame, rules: KeywordRules | None = None) -> DataFrame:
    """Adds the keywords found in the text (``hits``) and, with the handle, for
    the category (``category_hits``)."""
    rules = rules or KeywordRules.default()
    other = sorted({w for dim, tags in rules.words.items() if dim != "category"
                    for ws in tags.values() for w in ws})
    kinds = sorted({w for ws in rules.words["category"].values() for w in ws})
    return spread(df).select(
        "*",
        keyword_hits(product_text("title", "description"), other).alias("hits"),
        keyword_hits(product_text("title", "description", "handle"), kinds).alias("category_hits"))


def classify(df: DataFrame, rules: KeywordRules | None = None) -> DataFrame:
    """Adds ``detected_categories`` and ``category`` ('' when there is none)."""
    rules = rules or KeywordRules.default()
    if "category_hits" not in df.columns:
        df = with_keyword_hits(df, rules)
    texts = df.select("*", product_text("title", "description", "handle").alias("_tdh"))
    found = texts.select(*df.columns, detected_categories(df, rules).alias("detected_categories"))
    return found.select("*", primary_category(F.col("detected_categories")).alias("category"))


def dimension_tags(df: DataFrame, dim: str, rules: KeywordRules | None = None,
                   vocabulary: Vocabulary | None = None, gate: bool = True) -> Column:
    """Tags of one keyword dimension, empty where the category rules it out.
    An unset category leaves the gate open."""
    rules = rules or KeywordRules.default()
    scope = list((vocabulary or Vocabulary()).applies(dim))
    if dim == "bottle_size":
        scope = ["e-liquid"]
    tags = tags_for_hits(F.col("hits"), rules.words[dim])
    if not gate:
        return tags
    category = F.coalesce(F.col("category"), F.lit(""))
    return F.when((category == "") | category.isin(scope), tags).otherwise(_none())


def rule_tags(df: DataFrame, rules: KeywordRules | None = None,
              vocabulary: Vocabulary | None = None) -> DataFrame:
    """Adds ``rule_tags`` (sorted, distinct) and ``secondary_flavours``."""
    rules, vocabulary = rules or KeywordRules.default(), vocabulary or Vocabulary()
    given, df = df, df.select("*", product_text("title", "description").alias("_td"))
    cat, hits, text = F.col("category"), F.col("hits"), F.col("_td")
    words = rules.words

    def dim(name: str) -> Column:
        return tags_for_hits(hits, words[name])

    def one(tag: Column) -> Column:
        return F.array_compact(F.array(tag))

    def only(condition: Column, *parts: Column) -> Column:
        return F.when(condition, F.concat(*parts)).otherwise(_none())

    device = cat.isin("device", "pod_system")
    blocked = contains_any(text, ["cbd", "cbg"]) & ~device_evidence(text)
    nicotine = cat.isin(*vocabulary.applies("nicotine_strength"))
    flavoured = cat.isin(*vocabulary.applies("flavour_type"))
    specific = {w: [w] for _, more in flavour_words().values() for w in more}
    everything = F.concat(
        only(device, F.when(blocked, _none()).otherwise(dim("device_style")),
             dim("power_supply"), dim("vaping_style")),
        only(cat.isin("tank", "pod"), X.capacity_tags(text, vocabulary)),
        only(cat == "pod", dim("pod_type")),
        only(cat.isin("coil", "device", "pod_system"), dim("coil_ohm")),
        only(cat == "e-liquid", dim("bottle_size"), one(X.vg_ratio(text)), dim("vaping_style")),
        only(flavoured, dim("flavour_type")),
        only(nicotine, one(X.nicotine_tag(X.nicotine_mg(text, cat))), dim("nicotine_type")),
        only(cat == "CBD", one(X.cbd_tag(X.cbd_mg(text))), dim("cbd_form"), dim("cbd_type")))
    return df.select(
        *given.columns, F.array_sort(F.array_distinct(everything)).alias("rule_tags"),
        F.when(flavoured, tags_for_hits(hits, specific)).otherwise(_none()).alias("secondary_flavours"))


def tag_by_rules(products: DataFrame, rules: KeywordRules | None = None,
                 vocabulary: Vocabulary | None = None) -> DataFrame:
    """Products with category, rule tags and the gate's verdict.

    Needs ``title``, ``description`` and ``handle``; uses ``type`` and
    ``product_category`` where present.  A product without a category keeps no
    tags and carries the fixed failure reason.
    """
    rules = rules or KeywordRules.default()
    tagged = rule_tags(classify(with_keyword_hits(products, rules), rules), rules, vocabulary)
    gated = F.col("category") == ""
    return tagged.select(
        *products.columns, "detected_categories", "category", "rule_tags", "secondary_flavours",
        gated.alias("needs_manual_review"),
        F.when(gated, F.array(F.lit(GATE_REASON))).otherwise(_none()).alias("failure_reasons"))


def variant_flavours(option: Column) -> Column:
    """Flavours of a variant option by plain substring, so ``rice`` is also ice."""
    return substring_tags(F.lower(option), {f: own + more for f, (own, more) in flavour_words().items()})
