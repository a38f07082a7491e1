"""Differences between two catalogue exports.

Left and right rows hold ``handle``, ``title``, ``variant_sku``, ``tags`` (text),
``vendor``, ``type`` and ``ord``, the row order inside the file.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.text import split_tags, words_literal
from tagloom.rules.vocabulary import Vocabulary


def first_per_handle(rows: DataFrame) -> DataFrame:
    """First row of each handle, by a map-side combined ``min_by``."""
    others = [c for c in rows.columns if c != "handle"]
    return rows.filter("handle <> ''").groupBy("handle").agg(F.min_by(F.struct(*others), "ord").alias("_r")) \
        .select("handle", "_r.*")


def last_per_handle(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c != "handle"]
    return rows.filter("handle <> ''").groupBy("handle").agg(F.max_by(F.struct(*others), "ord").alias("_r")) \
        .select("handle", "_r.*")


def catalog_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Handles of both sides: presence, title change, SKUs on one side only.

    SKUs are matched as rows and counted, so a handle with very many variants
    is never held as one set.
    """
    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        titled = first_per_handle(df).select("handle", F.trim("title").alias(f"title_{name}"))
        skus = df.filter("handle <> '' and trim(variant_sku) <> ''") \
            .select("handle", F.trim("variant_sku").alias("sku")).distinct().withColumn(f"in_{name}", F.lit(True))
        return titled, skus

    lt, ls = side(left, "left")
    rt, rs = side(right, "right")
    sku = ls.join(rs, ["handle", "sku"], "full_outer").groupBy("handle").agg(
        F.count_if(F.col("in_right").isNull()).alias("skus_only_left"),
        F.count_if(F.col("in_left").isNull()).alias("skus_only_right"))
    both = lt.join(rt, "handle", "full_outer").join(sku, "handle", "left")
    status = F.when(F.col("title_right").isNull(), "only_left").when(F.col("title_left").isNull(), "only_right") \
        .otherwise("both")
    return both.select(
        "handle", status.alias("status"), "title_left", "title_right",
        F.coalesce(F.col("title_left") != F.col("title_right"), F.lit(False)).alias("title_changed"),
        F.coalesce("skus_only_left", F.lit(0)).alias("skus_only_left"),
        F.coalesce("skus_only_right", F.lit(0)).alias("skus_only_right"))


def tag_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lower-case tag sets per handle: last row on the left, first on the right."""
    def tags(df: DataFrame, name: str) -> DataFrame:
        return df.select("handle", F.array_sort(F.array_distinct(split_tags(F.col("tags"), lower=True))).alias(name))

    both = tags(last_per_handle(left), "l").join(tags(first_per_handle(right), "r"), "handle", "full_outer")
    status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right") \
        .when(F.col("l") == F.col("r"), "match").otherwise("mismatch")
    return both.select("handle", status.alias("status"), F.array_except("r", "l").alias("added"),
                       F.array_except("l", "r").alias("removed"))


def diff_patterns(diff: DataFrame) -> DataFrame:
    """Mismatches that only added, only removed, or did both."""
    added, removed = F.size("added") > 0, F.size("removed") > 0
    label = F.when(added & ~removed, "added_only").when(removed & ~added, "removed_only").otherwise("both")
    return diff.filter("status = 'mismatch'").groupBy(label.alias("pattern")).agg(F.count("*").alias("products"))


def common_changes(diff: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """Most often added or removed tags; the limit is the report's length."""
    return diff.filter("status = 'mismatch'").select(F.explode(column).alias("tag")) \
        .groupBy("tag").agg(F.count("*").alias("products")).orderBy(F.desc("products"), "tag").limit(limit)


def enrich_vendor(rows: DataFrame, export: DataFrame) -> DataFrame:
    """Vendor from the export's first row per handle, where it is not empty."""
    vendors = first_per_handle(export).select("handle", F.trim("vendor").alias("_v")).filter("_v <> ''")
    return rows.join(vendors, "handle", "left") \
        .select(*[c for c in rows.columns if c != "vendor"], F.coalesce("_v", F.lit("")).alias("vendor"))


def lost_tags(left: DataFrame, right: DataFrame) -> DataFrame:
    """Handles tagged in the left's first row but not in the right's."""
    l = first_per_handle(left).select("handle", F.trim("tags").alias("tags_left")).filter("tags_left <> ''")
    r = first_per_handle(right).filter("trim(coalesce(tags, '')) = ''").select("handle")
    return l.join(r, "handle")


def merged_tags(rows: DataFrame) -> DataFrame:
    """All tags of all variants of a handle as one sorted text.

    Tags are made distinct per handle before they are put together; the set of
    distinct tags is bounded by the vocabulary in use, not by the variants.
    """
    tags = rows.filter("handle <> ''").select("handle", F.explode(split_tags(F.col("tags"))).alias("tag")).distinct() \
        .groupBy("handle").agg(F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags"))
    titles = rows.filter("handle <> ''").groupBy("handle").agg(
        F.coalesce(F.min_by("title", F.when(F.trim("title") != "", F.col("ord"))), F.lit("")).alias("title"))
    return titles.join(tags, "handle", "left").select("handle", "title", F.coalesce("tags", F.lit("")).alias("tags"))


def restore_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """Merged tags of handles whose right side has none."""
    r = first_per_handle(right).filter("trim(coalesce(tags, '')) = ''").select("handle")
    return enrich_vendor(merged_tags(left), right).filter("tags <> ''").join(r, "handle", "left_semi")


def uneven_variants(rows: DataFrame) -> DataFrame:
    """Handles with several variants and how many different tag texts they carry."""
    return rows.groupBy("handle").agg(
        F.count("*").alias("variants"), F.count_distinct(F.coalesce("tags", F.lit(""))).alias("tag_texts")) \
        .filter("variants > 1")


def tagged_by(rows: DataFrame) -> DataFrame:
    """Tagged and untagged products by type and by vendor, both grains in one pass."""
    tagged = F.trim(F.coalesce("tags", F.lit(""))) != ""
    products = first_per_handle(rows).select(
        F.coalesce("type", F.lit("Unknown")).alias("type"), F.coalesce("vendor", F.lit("Unknown")).alias("vendor"),
        tagged.alias("tagged"))
    return products.groupingSets([["type"], ["vendor"]], "type", "vendor").agg(
        F.grouping("vendor").alias("_by_type"), F.count_if("tagged").alias("tagged"),
        F.count_if(~F.col("tagged")).alias("untagged")).select(
        F.when(F.col("_by_type") == 1, "type").otherwise("vendor").alias("grain"),
        F.when(F.col("_by_type") == 1, F.col("type")).otherwise(F.col("vendor")).alias("key"), "tagged", "untagged")


def approved_usage(rows: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Uses per tag and whether it counts as approved.  Tags are lower-cased
    first, so ``CBD`` counts as unapproved, as in the source."""
    flat = words_literal(list((vocabulary or Vocabulary()).flat()))
    used = first_per_handle(rows).select(F.explode(split_tags(F.col("tags"), lower=True)).alias("tag")) \
        .groupBy("tag").agg(F.count("*").alias("uses"))
    digits = F.replace("tag", F.lit("mg"), F.lit("")).rlike(r"^\d+$")
    return used.select("tag", "uses", (F.array_contains(flat, F.col("tag")) | digits).alias("approved"))


def handle_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Handle counts of intersection and of both differences."""
    l, r = left.select("handle").filter("handle <> ''"), right.select("handle").filter("handle <> ''")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("handles")).select(F.lit(name).alias("part"), "handles")

    return counted(l.intersect(r), "both").unionByName(counted(l.subtract(r), "only_left")) \
        .unionByName(counted(r.subtract(l), "only_right"))


def set_change(before: Column, after: Column) -> Column:
    """``struct(union, added, removed)`` of two tag lists."""
    return F.struct(F.array_sort(F.array_union(before, after)).alias("all"),
                    F.array_sort(F.array_except(after, before)).alias("added"),
                    F.array_sort(F.array_except(before, after)).alias("removed"))
