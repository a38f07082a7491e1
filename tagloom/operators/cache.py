"""Tag cache by content hash: lookup, merge, retention, similar products."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.text import containing
from tagloom.operators.ordering import top_rows


def content_hash(title: Column, description: Column) -> Column:
    """First 16 digits of the sha256 of title and description."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(description, F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 16)


def lookup(products: DataFrame, cache: DataFrame) -> DataFrame:
    """Products with cached tags where known; ``hit`` says which."""
    keyed = products.select("*", content_hash(F.col("title"), F.col("description")).alias("content_hash"))
    return keyed.join(cache.select("content_hash", "ai_tags", "rule_tags"), "content_hash", "left") \
        .select("*", F.col("ai_tags").isNotNull().alias("hit"))


def misses(products: DataFrame, cache: DataFrame) -> DataFrame:
    """Products the annotator still has to see."""
    keyed = products.select("*", content_hash(F.col("title"), F.col("description")).alias("content_hash"))
    return keyed.join(cache.select("content_hash"), "content_hash", "left_anti")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest row per content hash of both."""
    others = [c for c in old.columns if c != "content_hash"]
    return old.unionByName(new).groupBy("content_hash").agg(
        F.max_by(F.struct(*others), "cached_at").alias("r")).select("content_hash", "r.*")


def retain(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """Entries not older than ``days``."""
    return cache.filter(F.col("cached_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def used_tags(tags: DataFrame, cache: DataFrame) -> DataFrame:
    """Tag rows still used by a cached product."""
    return tags.join(cache.select(F.explode("tags").alias("tag")), "tag", "left_semi")


def stats(cache: DataFrame) -> DataFrame:
    """Products, distinct tags, tag uses and last entry."""
    tags = cache.select(F.explode("tags").alias("tag")).agg(
        F.count_distinct("tag").alias("unique_tags"), F.count("*").alias("total_tag_uses"))
    rows = cache.agg(F.count("*").alias("cached_products"), F.max("cached_at").alias("last_cached"))
    return rows.select(F.col("cached_products"), F.col("last_cached"),
                       tags.select("unique_tags").scalar().alias("unique_tags"),
                       tags.select("total_tag_uses").scalar().alias("total_tag_uses"))


def similar_products(queries: DataFrame, cache: DataFrame, limit: int = 5) -> DataFrame:
    """Newest cached products sharing the first word of title or description.

    The source looks for the word as a substring of title, description or tags.
    Which products contain a word does not depend on who asks, so every word in
    use keeps its ``limit + 1`` newest products per field (trimmed before the
    shuffle) and queries pick among those; no product meets another product.
    Containment is an equi-join on one short gram of each word, then a test.
    """
    first = F.get(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != ""), F.lit(0))
    about = F.get(F.filter(F.split(F.lower("description"), r"\s+"), lambda w: w != ""), F.lit(0))
    asked = queries.select("content_hash", F.inline(F.array(
        F.struct(F.lit("title").alias("field"), first.alias("word")),
        F.struct(F.lit("description").alias("field"), about.alias("word")),
        F.struct(F.lit("tags").alias("field"), first.alias("word"))))).filter("word is not null")
    words = asked.select("field", "word").distinct()
    distinct = words.select("word").distinct()

    def pieces(field: str, text: Column) -> DataFrame:
        rows = cache.select(F.col("content_hash").alias("other"), "cached_at", F.lower(text).alias("_low"))
        return containing(rows, "_low", distinct, "word").select("other", "cached_at", F.lit(field).alias("field"), "word")

    holding = pieces("title", F.col("title")).unionByName(pieces("description", F.col("description"))) \
        .unionByName(pieces("tags", F.array_join("tags", ",")))
    newest = top_rows(holding.join(words, ["field", "word"]), ["field", "word"], limit + 1,
                      F.desc("cached_at"), F.col("other")).drop("rank")
    found = asked.join(newest, ["field", "word"]).filter(F.col("other") != F.col("content_hash")) \
        .select("content_hash", "other", "cached_at").distinct()
    return top_rows(found, ["content_hash"], limit, F.desc("cached_at"), F.col("other"))
