"""Audit reports over tagged products.

Audit rows hold ``handle``, ``title``, ``description``, ``effective_type``,
``rule_tags``, ``ai_tags``, ``final_tags`` (distinct arrays) and the review
columns.  Intersections over groups are counts of exploded tags, never folds
over collected sets, so a category with a third of all products stays a
partially aggregated group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.text import (words_literal, contains_any, similar_handle_audit, similar_handle_strict)
from tagloom.operators.validate import is_approved, tag_dimension
from tagloom.rules.vocabulary import Vocabulary

# Fixed values.
CBD_FORMS_CHECKED = ["oil", "capsule", "topical", "tincture", "gummy", "shot", "patch", "paste",
                     "isolate", "edible", "beverage", "crumble", "shatter", "wax"]
# Fixed values of the short form of the checks: the forms it knows, and words of devices whose ratio it does not ask for.
CBD_FORMS_SHORT = ["oil", "capsule", "topical", "tincture", "gummy"]
DEVICE_WORDS = ["pod kit", "pod vape", "refill pod", "device"]


def kind(df: DataFrame | None = None) -> Column:
    """Effective category, ``unknown`` where missing."""
    col = F.col("effective_type")
    return F.when(col.isNull() | (col == ""), "unknown").otherwise(col)


def _count(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def tag_frequency(products: DataFrame, tags: str = "final_tags", ts: str = "processed_at") -> DataFrame:
    """Uses per tag with first and last use."""
    return products.select(F.explode(tags).alias("tag"), F.col(ts).alias("ts")).groupBy("tag").agg(
        F.count("*").alias("frequency"), F.min("ts").alias("first_used"), F.max("ts").alias("last_used"))


def popular_tags(products: DataFrame, limit: int = 50) -> DataFrame:
    """Most used tags; the limit is the report's length."""
    return tag_frequency(products).orderBy(F.desc("frequency"), F.desc("last_used"), "tag").limit(limit)


def coverage(products: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Totals of tag use as (metric, value) rows."""
    used = products.select(F.explode("final_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    dims = used.select(tag_dimension(F.col("tag"), F.lit(""), vocabulary).alias("dim"), "n")
    tags = used.agg(F.sum("n").alias("total_tags_used"), F.count("*").alias("unique_tags_used"))
    rows = products.agg(F.count("*").alias("total_products"),
                        _count(F.size("final_tags") <= 0, "untagged_products"))
    groups = dims.agg(F.count_distinct("dim").alias("categories_represented"))

    def long(df: DataFrame) -> DataFrame:
        cols = df.columns
        pairs = ", ".join(f"'{c}', CAST({c} AS BIGINT)" for c in cols)
        return df.selectExpr(f"stack({len(cols)}, {pairs}) AS (metric, value)")

    return long(tags).unionByName(long(rows)).unionByName(long(groups))


def coverage_by_dimension(products: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    used = products.select(F.explode("final_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return used.groupBy(tag_dimension(F.col("tag"), F.lit(""), vocabulary).alias("dimension")) \
        .agg(F.sum("n").alias("uses"))


def consistency(products: DataFrame) -> DataFrame:
    """Per category with at least two products: size and average number of tags."""
    return products.groupBy(kind().alias("category")).agg(
        F.count("*").alias("product_count"), F.avg(F.size("final_tags")).alias("avg_tags")) \
        .filter("product_count >= 2")


def common_tags(products: DataFrame) -> DataFrame:
    """Tags carried by every product of a category (of at least two products)."""
    sizes = consistency(products).select("category", "product_count")
    uses = products.select(kind().alias("category"), F.explode("final_tags").alias("tag")) \
        .groupBy("category", "tag").agg(F.count("*").alias("n"))
    return uses.join(sizes, "category").filter("n = product_count").select("category", "tag")


def dimension_coverage(products: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Products per category that carry each dimension."""
    sizes = consistency(products).select("category")
    dims = F.array_distinct(F.transform("final_tags", lambda t: tag_dimension(t, F.col("effective_type"), vocabulary)))
    return products.select(kind().alias("category"), F.explode(dims).alias("dimension")) \
        .groupBy("category", "dimension").agg(F.count("*").alias("products")).join(sizes, "category")


def outliers(products: DataFrame, distance: float = 2) -> DataFrame:
    """Products whose number of tags is far from their category's average.
    The averages are a small aggregate joined back, not a window over the category."""
    sized = products.select("handle", kind().alias("category"), F.size("final_tags").alias("tag_count"))
    return sized.join(consistency(products), "category") \
        .filter(F.abs(F.col("tag_count") - F.col("avg_tags")) > distance).select("category", "handle", "tag_count")


def _sources() -> tuple[Column, Column]:
    return (F.coalesce(F.arrays_overlap("ai_tags", "final_tags"), F.lit(False)),
            F.coalesce(F.arrays_overlap("rule_tags", "final_tags"), F.lit(False)))


def contribution(products: DataFrame) -> DataFrame:
    """Where final tags come from, per category and overall (category ``ALL``)."""
    ai, rule = _sources()
    flags = products.select(
        kind().alias("category"), ai.alias("ai"), rule.alias("rule"), F.size("final_tags").alias("n"),
        (F.size("ai_tags") > 0).alias("has_ai"), (F.size("rule_tags") > 0).alias("has_rule"))

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    a, r = F.col("ai"), F.col("rule")
    return flags.rollup("category").agg(
        F.grouping("category").alias("_all"),
        F.count("*").alias("total"), _count(F.col("has_ai"), "with_ai"), _count(F.col("has_rule"), "with_rule"),
        _count(F.col("has_ai") & F.col("has_rule"), "with_both"),
        _count(~F.col("has_ai") & ~F.col("has_rule"), "with_neither"),
        _count(a & r, "both"), _count(a & ~r, "ai_only"), _count(~a & r, "rule_only"),
        total(a & r).alias("tags_both"), total(a & ~r).alias("tags_ai_only"),
        total(~a & r).alias("tags_rule_only"), total(~a & ~r).alias("tags_neither")) \
        .select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category")).alias("category"),
                "total", "with_ai", "with_rule", "with_both", "with_neither", "both", "ai_only",
                "rule_only", "tags_both", "tags_ai_only", "tags_rule_only", "tags_neither")


def agreement(products: DataFrame) -> DataFrame:
    """Products per agreement class of model and rules."""
    ai, rule = _sources()
    label = F.when(ai & rule, "agree").when(ai, "ai_only").when(rule, "rule_only").otherwise("disagree")
    return products.groupBy(label.alias("agreement")).agg(F.count("*").alias("products"))


def model_accuracy(products: DataFrame) -> DataFrame:
    """Share of model tags that made it to the final tags, per category; 0 without any."""
    return products.groupBy(kind().alias("category")).agg(
        F.sum(F.size(F.array_intersect("ai_tags", "final_tags"))).alias("correct"),
        F.sum(F.size("ai_tags")).alias("total")) \
        .withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))


def adherence(products: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Final tags outside the vocabulary, one row per product and tag."""
    return products.select("handle", "effective_type", F.explode("final_tags").alias("tag")) \
        .filter(~is_approved(F.col("tag"), F.coalesce("effective_type", F.lit("")), vocabulary)) \
        .select("handle", F.col("tag").alias("invalid_tag"),
                F.lit("Tag not in approved vocabulary").alias("issue"))


def expected_tag_issues(products: DataFrame, short: bool = False) -> DataFrame:
    """Tags a product should have by its category and handle, one row per gap.

    The ``short`` form knows five CBD forms and asks no ratio of what its handle or title calls a device.
    """
    forms = CBD_FORMS_SHORT if short else CBD_FORMS_CHECKED
    handle = F.lower("handle")
    title = F.lower(F.coalesce("title", F.lit("")))

    def any_tag(test) -> Column:
        return F.exists("final_tags", test)

    def issue(cond: Column, what: str, expected: str) -> Column:
        return F.when(cond, F.struct(F.lit(what).alias("issue"),
                                     F.lit(f"{expected} category tag").alias("expected")))

    is_kind = F.coalesce(F.col("effective_type"), F.lit(""))
    no_mg = ~any_tag(lambda t: t.contains("mg") & ~t.endswith("ml"))
    no_ratio = ~any_tag(lambda t: t.contains("/") & t.rlike("^[0-9]"))
    various = handle.contains("various") | title.contains("various")
    if short:
        various = various | contains_any(handle, DEVICE_WORDS) | contains_any(title, DEVICE_WORDS)
    issues = F.array_compact(F.array(
        issue((is_kind == "e-liquid") & no_mg & contains_any(handle, ["nic", "salt", "mg"]),
              "Missing nicotine strength tag", "nicotine_strength"),
        issue((is_kind == "e-liquid") & no_ratio & ~various & handle.rlike(r"\d+vg|\d+pg"),
              "Missing VG/PG ratio tag", "vg_ratio"),
        issue((is_kind == "CBD") & ~any_tag(lambda t: t.endswith("mg"))
              & contains_any(handle, ["mg", "cbd", "cbg"]), "Missing CBD strength tag", "cbd_strength"),
        issue((is_kind == "CBD") & ~any_tag(lambda t: t.isin(*forms)),
              "Missing CBD form tag", "cbd_form"),
        issue((is_kind == "pod") & ~any_tag(lambda t: t.endswith("ml"))
              & contains_any(handle, ["ml", "pod"]), "Missing capacity tag", "capacity")))
    return products.select("handle", is_kind.alias("category"), F.inline(issues))


def similar_groups(products: DataFrame) -> DataFrame:
    """Handles equal up to size and pack: how far categories and tags agree.

    ``overlap`` is shared tags over all tags of the group.  Shared tags are tags
    counted once per product of the group.
    """
    grouped = products.select(similar_handle_audit(F.col("handle")).alias("grp"), "effective_type", "final_tags")
    sizes = grouped.groupBy("grp").agg(
        F.count("*").alias("products"), F.count_distinct(F.coalesce("effective_type", F.lit(""))).alias("categories"),
        F.count_distinct(F.array_sort("final_tags")).alias("tag_sets")).filter("products >= 2")
    uses = grouped.select("grp", F.explode("final_tags").alias("tag")).groupBy("grp", "tag") \
        .agg(F.count("*").alias("n"))
    shared = uses.join(sizes.select("grp", "products"), "grp").groupBy("grp").agg(
        _count(F.col("n") == F.col("products"), "shared_tags"), F.count("*").alias("all_tags"))
    return sizes.join(shared, "grp", "left").select(
        "grp", "products", "categories", "tag_sets",
        F.coalesce("shared_tags", F.lit(0)).alias("shared_tags"),
        F.coalesce("all_tags", F.lit(0)).alias("all_tags"))


def similar_group_issues(products: DataFrame, least: float = 0.5) -> DataFrame:
    """Groups whose categories differ or whose tags overlap by less than half."""
    g = similar_groups(products)
    low = (F.col("tag_sets") > 1) & (F.col("shared_tags") / F.col("all_tags") < least)
    issues = F.array_compact(F.array(
        F.when(F.col("categories") > 1, F.lit("Different categories for similar products")),
        F.when(low, F.lit("Inconsistent tagging for similar products"))))
    return g.select("grp", "products", F.explode(issues).alias("issue"))


def similar_group_strict(products: DataFrame) -> DataFrame:
    """The validator's form: more than one category, more than one set of tags."""
    sizes = products.groupBy(similar_handle_strict(F.col("handle")).alias("grp")).agg(
        F.count("*").alias("products"), F.count_distinct(F.coalesce("effective_type", F.lit(""))).alias("categories"),
        F.count_distinct(F.array_sort("final_tags")).alias("tag_sets")).filter("products >= 2")
    issues = F.array_compact(F.array(
        F.when(F.col("categories") > 1, F.lit("Inconsistent categories")),
        F.when(F.col("tag_sets") > 1, F.lit("Inconsistent tagging"))))
    return sizes.select("grp", "products", F.explode(issues).alias("issue"))


def issues_on_products(products: DataFrame) -> DataFrame:
    """Audit rows with their issues joined by ``; ``.

    A group issue is keyed by the group's text, so it reaches a product only if
    that text is a handle, as in the source.
    """
    gaps = expected_tag_issues(products).select("handle", "issue", "expected")
    groups = similar_group_issues(products).select(
        F.col("grp").alias("handle"), "issue", F.col("products").cast("string").alias("expected"))
    # a handle has at most five issue kinds per product row, so lists stay short
    listed = gaps.unionByName(groups).distinct().groupBy("handle").agg(
        F.array_sort(F.collect_set(F.struct("issue", "expected"))).alias("i"))
    joined = products.join(listed, "handle", "left")
    return joined.select(
        "handle", kind().alias("category"), F.array_join("final_tags", ",").alias("final_tags"),
        F.coalesce(F.array_join(F.transform("i", lambda x: x["issue"]), "; "), F.lit("")).alias("error_type"),
        F.coalesce(F.array_join(F.transform("i", lambda x: x["expected"]), "; "), F.lit("")).alias("error_details"))


def recommendations(products: DataFrame) -> DataFrame:
    """Advice from a report's own numbers, one row per line."""
    ai, rule = _sources()
    metrics = products.agg(
        F.count("*").alias("total"), _count(F.size("ai_tags") > 0, "with_ai"), _count(ai & rule, "agree"))
    pct = F.col("with_ai") / F.col("total") * 100
    agree = F.col("agree") / F.col("total") * 100
    advice = F.array_compact(F.array(
        F.when(F.col("with_ai") == 0, F.lit("AI tags never made it into the audit; verify model configuration and rerun tagging"))
        .when(pct < 30, F.format_string("Increase AI tagging coverage (currently %.1f%% of products contain AI tags)", pct))
        .when(pct > 85, F.lit("AI tagging coverage is strong—focus on accuracy next")),
        F.when(F.col("total") == 0, F.lit("No AI vs rule comparisons available; ensure both taggers run for the same batch"))
        .when(agree < 60, F.format_string("Review AI-rule disagreement patterns (agreement only %.1f%%)", agree))
        .otherwise("AI and rule-based tagging generally agree")))
    return metrics.select(F.explode(advice).alias("recommendation"))


def validator_recommendations(products: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The validator's advice, one row per line; a single line when all is well."""
    def count(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    metrics = products.agg(_count(F.size("final_tags") <= 0, "untagged")).select(
        "untagged", count(adherence(products, vocabulary)).alias("foreign"),
        count(coverage_by_dimension(products, vocabulary)).alias("dimensions"),
        count(outliers(products).select("category").distinct()).alias("uneven"),
        count(similar_group_strict(products)).alias("similar"))

    def line(cond: Column, *parts) -> Column:
        return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))

    c = F.col
    advice = F.array_compact(F.array(
        line(c("foreign") > 0, "Review and fix non-approved tags"),
        line(c("untagged") > 0, "Investigate ", c("untagged"), " untagged products"),
        line(c("dimensions") < 5, "Consider expanding tag category coverage"),
        line(c("uneven") > 0, "Review ", c("uneven"), " categories with tagging outliers"),
        line(c("similar") > 0, "Address ", c("similar"), " similar product consistency issues")))
    fine = F.array(F.lit("No major issues found - tagging looks good!"))
    return metrics.select(advice.alias("a")).select(
        F.explode(F.when(F.size("a") > 0, F.col("a")).otherwise(fine)).alias("recommendation"))


def run_accuracy(products: DataFrame) -> DataFrame:
    """Clean, review and untagged counts and rates, per category and overall.

    ``products`` carries ``category``, ``tier`` and ``ai_confidence``."""
    rolled = products.select(F.coalesce("category", F.lit("unknown")).alias("category"), "tier", "ai_confidence") \
        .rollup("category").agg(
            F.grouping("category").alias("_all"), F.count("*").alias("total"),
            _count(F.col("tier") == "clean", "clean"), _count(F.col("tier") == "review", "review"),
            _count(F.col("tier") == "untagged", "untagged"),
            F.avg(F.when(F.col("ai_confidence") > 0, F.col("ai_confidence"))).alias("conf"))
    return rolled.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category")).alias("category"),
        "total", "clean", "review", "untagged",
        F.coalesce(F.try_divide("clean", "total"), F.lit(0.0)).alias("clean_rate"),
        F.coalesce(F.try_divide(F.col("clean") + F.col("review"), F.col("total")), F.lit(0.0)).alias("tagging_rate"),
        F.coalesce("conf", F.lit(0.0)).alias("avg_confidence"))


def tier_matrix(products: DataFrame) -> DataFrame:
    """Tier counts as columns per category."""
    return products.groupBy("category").pivot("tier", ["clean", "review", "untagged"]).count() \
        .na.fill(0, ["clean", "review", "untagged"])


def store_stats(products: DataFrame) -> DataFrame:
    """Totals of the audit store in one pass."""
    return products.agg(
        F.count("*").alias("total"), _count(F.col("human_verified"), "verified"),
        _count(~F.col("human_verified"), "unverified"),
        _count(F.col("human_corrected_tags").isNotNull(), "corrected_tags"),
        _count(F.col("human_corrected_category").isNotNull(), "corrected_categories"),
        F.coalesce(F.round(F.avg("ai_confidence"), 3), F.lit(0.0)).alias("avg_confidence"),
        _count(F.col("ai_review_decision") == "approve", "ai_approved"),
        _count(F.col("ai_review_decision") == "flag", "ai_flagged"),
        _count(F.col("ai_review_decision").isNull() & ~F.col("human_verified"), "pending_ai_review"))


def value_counts(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Counts of one key, largest first, ties by key."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def tag_rate(products: DataFrame, categories: list[str]) -> DataFrame:
    """Tagged and partially tagged shares of a controlled-profile run.

    A product is tagged if it has a forced category or a category tag; tagged
    products with at most two tags are partial.
    """
    cats = words_literal(list(categories))
    chosen = F.coalesce(F.col("forced_category"), F.get(F.filter(
        "rule_tags", lambda t: F.array_contains(cats, t)), F.lit(0)))
    base = products.filter("handle <> '' and title <> ''").select(chosen.alias("category"), F.size("rule_tags").alias("n"))
    tagged = F.col("category").isNotNull()
    return base.agg(
        F.count("*").alias("total"), _count(tagged, "tagged"), _count(~tagged, "untagged"),
        _count(tagged & (F.col("n") <= 2), "partial")).select(
        "*", (F.col("tagged") / F.col("total") * 100).alias("tag_rate"))


def collections(tagged: DataFrame, prefix: str = "") -> DataFrame:
    """Collection definitions: fixed ones plus one per flavour in use.

    The source reads a key its tagger never writes, so its flavour collections
    never appear; ours take the flavour dimension's tags.
    """
    v = Vocabulary()
    flavours = F.array(*[F.lit(t) for t in v.dims["flavour_type"].tags])
    used = tagged.select(F.explode(F.array_intersect("rule_tags", flavours)).alias("family")).distinct()
    per_family = used.select(
        F.trim(F.concat(F.lit(prefix), "family", F.lit(" Flavors"))).alias("title"),
        F.concat(F.lit("Explore our "), F.lower("family"), F.lit(" flavored vaping products")).alias("description"),
        F.array("family").alias("filter_tags"))
    spark = tagged.sparkSession
    # The standing collections.
    fixed = spark.createDataFrame([
        ("Zero Nicotine Devices", "Nicotine-free vaping options", ["Zero Nicotine", "0mg"]),
        ("High Strength Nicotine", "High strength nicotine vaping products", ["High Strength", "Strong"]),
        ("Disposable Vapes", "Convenient disposable vaping devices", ["Disposable"]),
        ("Beginner Vape Kits", "Perfect starter kits for beginners", ["Pod System", "AIO", "Compact"]),
    ], "title string, description string, filter_tags array<string>")
    return per_family.unionByName(fixed.withColumn("title", F.trim(F.concat(F.lit(prefix), "title"))))


def review_session(decisions: DataFrame) -> DataFrame:
    """Outcome counts of a review session; a NULL decision is an error."""
    return decisions.agg(
        F.count("*").alias("reviewed"), _count(F.col("decision") == "approve", "approved"),
        _count(F.col("decision") == "flag", "flagged"), _count(F.col("decision").isNull(), "errors"))
