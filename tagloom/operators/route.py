"""From tagged products back to catalogue rows: tiers, variants, images, SKUs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import extract as X
from tagloom.functions.text import blank, fixed, html_paragraphs, join_tags, slug
from tagloom.operators.module_tagger import variant_flavours
from tagloom.operators.ordering import bounded_lists, first_rows
from tagloom.rules.vocabulary import Vocabulary

# The categories whose variants may override flavours in a cleanup run.
CLEANUP_FLAVOUR_CATEGORIES = ["e-liquid", "disposable", "pod", "nicotine_pouches"]


def tier(tags: Column, needs_review: Column) -> Column:
    """``untagged`` without tags, else ``review`` if flagged, else ``clean``."""
    return F.when(tags.isNull() | (F.size(tags) <= 0), "untagged") \
        .when(F.coalesce(needs_review, F.lit(False)), "review").otherwise("clean")


def consolidate(rows: DataFrame, image: str = "image", ord_: str = "ord",
                limit: int = 10_000) -> DataFrame:
    """One row per handle: the first row's values plus its images in order.

    The first row is a ``min_by`` (map-side combined); images are bounded lists,
    so a handle with very many images continues in further ``part`` rows.
    """
    named = rows.filter(F.col("handle").isNotNull())
    others = [c for c in rows.columns if c not in ("handle", image, ord_)]
    first = named.groupBy("handle").agg(F.min_by(F.struct(*others), F.col(ord_)).alias("_r"))
    images = bounded_lists(named.filter(blank(F.col(image)) != ""), ["handle"], [F.col(ord_)],
                           F.floor(F.col(ord_) / limit), F.col(image), "images", limit)
    return (first.join(images, "handle", "left")
            .select("handle", *[F.col(f"_r.{c}").alias(c) for c in others],
                    F.coalesce("part", F.lit(0)).alias("part"),
                    F.coalesce("images", F.array().cast("array<string>")).alias("images")))


def drop_image_rows(rows: DataFrame) -> DataFrame:
    """Only purchasable rows: an option value or a price is present."""
    return rows.filter(~((blank(F.col("option1_value")) == "") & (blank(F.col("variant_price")) == "")))


def sku_lookups(inventory: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three SKU dimensions, each one row per key.

    handle + option name + value and handle alone keep the last inventory row,
    handle + value keeps the first.
    """
    inv = inventory.select(
        F.lower(F.trim(blank(F.col("handle")))).alias("handle"),
        F.lower(F.trim(blank(F.col("option1_name")))).alias("option_name"),
        F.lower(F.trim(blank(F.col("option1_value")))).alias("option_value"),
        F.trim(blank(F.col("sku"))).alias("sku"), "ord").filter("handle <> '' and sku <> ''")
    full = inv.groupBy("handle", "option_name", "option_value").agg(F.max_by("sku", "ord").alias("sku_full"))
    value = inv.groupBy("handle", "option_value").agg(F.min_by("sku", "ord").alias("sku_value"))
    alone = inv.filter(F.col("option_value").isin("", "default title")) \
        .groupBy("handle").agg(F.max_by("sku", "ord").alias("sku_handle"))
    return full, value, alone


def with_sku(variants: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds ``inventory_sku``: exact key, else handle + value, else handle, else ''."""
    full, value, alone = sku_lookups(inventory)
    keyed = variants.select(
        "*", F.lower(F.trim(F.col("handle"))).alias("_h"),
        F.lower(F.trim(blank(F.col("option1_name")))).alias("_n"),
        F.lower(F.trim(blank(F.col("option1_value")))).alias("_v"))
    full = full.select(F.col("handle").alias("_h"), F.col("option_name").alias("_n"),
                       F.col("option_value").alias("_v"), "sku_full")
    value = value.select(F.col("handle").alias("_h"), F.col("option_value").alias("_v"), "sku_value")
    alone = alone.select(F.col("handle").alias("_h"), "sku_handle")
    found = keyed.join(full, ["_h", "_n", "_v"], "left").join(value, ["_h", "_v"], "left") \
        .join(alone, "_h", "left")
    return found.select(*variants.columns, F.coalesce(
        "sku_full", "sku_value", "sku_handle", F.lit("")).alias("inventory_sku"))


def variant_tags(tags: Column, flavours: Column, ratio: Column, vocabulary: Vocabulary | None = None) -> Column:
    """Product tags with flavours, ratio and style replaced by what a variant's option names."""
    v = vocabulary or Vocabulary()

    def swap(base: Column, dim: str, new: Column, given: Column) -> Column:
        kept = F.filter(base, lambda t: ~t.isin(*v.dims[dim].tags))
        return F.when(given, F.concat(kept, new)).otherwise(base)

    style = X.export_vaping_style(ratio)
    step = swap(tags, "flavour_type", flavours, F.size(flavours) > 0)
    step = swap(step, "vg_ratio", F.array(ratio), ratio.isNotNull())
    return swap(step, "vaping_style", F.array(style), style.isNotNull())


def export_variants(variants: DataFrame, products: DataFrame,
                    inventory: DataFrame | None = None) -> DataFrame:
    """Every variant row with its product's tags, its own overrides and a tier.

    ``products`` holds one row per handle: ``tags``, ``category``,
    ``needs_manual_review``, ``ai_confidence``, ``model_used``,
    ``failure_reasons``.  A variant without a product is untagged.
    """
    rows = drop_image_rows(variants)
    if inventory is not None:
        rows = with_sku(rows, inventory)
    joined = rows.join(products.select("handle", *[
        F.col(c).alias(f"_{c}") for c in ("tags", "category", "needs_manual_review", "ai_confidence",
                                          "model_used", "failure_reasons")]), "handle", "left")
    option = F.coalesce("option1_value", F.lit(""))
    joined = joined.select("*", variant_flavours(option).alias("_flavours"), X.variant_vg_ratio(option).alias("_ratio"))
    known = F.col("_tags").isNotNull()
    tags = F.when(known, variant_tags(F.col("_tags"), F.col("_flavours"), F.col("_ratio")))
    sku = F.col("variant_sku") if inventory is None else F.when(
        known & (F.col("inventory_sku") != ""), F.col("inventory_sku")).otherwise(F.col("variant_sku"))
    out = joined.select(
        *[F.col(c) for c in variants.columns if c not in ("variant_sku", "tags")],
        sku.alias("variant_sku"), tags.alias("_final"), *[F.col(f"_{c}") for c in (
            "category", "needs_manual_review", "ai_confidence", "model_used", "failure_reasons")])
    review = F.col("_needs_manual_review")
    tagged = F.col("_final").isNotNull()
    return out.select(
        *[c for c in variants.columns if c not in ("variant_sku", "tags")], "variant_sku",
        F.coalesce(join_tags(F.col("_final")), F.lit("")).alias("tags"),
        F.when(~tagged | F.coalesce(review, F.lit(False)), "YES").otherwise("NO").alias("needs_manual_review"),
        F.when(tagged, F.col("_category")).otherwise("unknown").alias("category"),
        F.when(tagged, fixed(F.coalesce("_ai_confidence", F.lit(0.0)), 2)).otherwise("")
        .alias("ai_confidence"),
        F.coalesce("_model_used", F.lit("")).alias("model_used"),
        F.coalesce(F.array_join("_failure_reasons", "; "), F.lit("")).alias("failure_reasons"),
        tier(F.col("_final"), review).alias("tier"))


def image_rows(products: DataFrame, limit: int = 10_000) -> DataFrame:
    """Catalogue rows: the first carries the product, each further image its own row.

    Positions run from 1 when there are images, on through the further parts of
    long lists (as :func:`consolidate` makes them); a product without images keeps
    one row without a position.
    """
    before = F.col("part") * limit if "part" in products.columns else F.lit(0)
    spread = products.select("*", F.posexplode_outer("images").alias("_at", "image_src")).withColumn("_pos", F.col("_at") + before)
    lead = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    own = [c for c in products.columns if c not in ("handle", "images", "part")]
    return spread.select("handle", *[F.when(lead, F.col(c)).alias(c) for c in own], "image_src",
                         (F.col("_pos") + 1).alias("image_position"))


def shopify_rows(products: DataFrame) -> DataFrame:
    """Import rows for scraped products: handle from title, HTML body, fixed columns."""
    base = products.select(
        slug(F.coalesce("title", F.lit("product"))).alias("handle"), F.col("title"),
        html_paragraphs(F.col("description")).alias("body_html"), F.col("vendor"), F.col("type"),
        join_tags(F.col("tags")).alias("tags"), F.lit("TRUE").alias("published"), F.col("sku"),
        F.lit("shopify").alias("inventory_tracker"), F.col("price"), F.col("title").alias("seo_title"),
        F.lit("active").alias("status"), "images")
    return image_rows(base)


def update_rows(rows: DataFrame) -> DataFrame:
    """Update-mode columns only, missing values blank."""
    return rows.select("handle", *[blank(F.col(c)).alias(c) for c in ("title", "tags", "variant_sku")])


def cleanup_rows(untagged: DataFrame, products: DataFrame) -> DataFrame:
    """Cleanup results on the untagged rows.

    The variant's flavour replaces the product's only in four categories and
    only for real options; rows without a result stay untagged.
    """
    v = Vocabulary()
    old = F.array(*[F.lit(t) for t in v.dims["flavour_type"].tags])
    joined = untagged.join(products.select("handle", F.col("tags").alias("_tags"),
                                           F.col("category").alias("_category"),
                                           F.col("needs_manual_review").alias("_review")), "handle", "left")
    option = F.trim(F.coalesce("option1_value", F.lit("")))
    joined = joined.select("*", variant_flavours(option).alias("_own"))
    own = F.col("_own")
    usable = F.col("_category").isin(CLEANUP_FLAVOUR_CATEGORIES) & \
        ~F.lower(option).isin("default title", "nan", "") & (F.size(own) > 0)
    tags = F.when(F.coalesce(usable, F.lit(False)), F.array_distinct(F.concat(
        F.filter("_tags", lambda t: ~F.array_contains(old, t)), own))).otherwise(F.col("_tags"))
    return joined.select(
        *[c for c in untagged.columns if c != "tags"], join_tags(tags).alias("tags"),
        F.coalesce("_category", F.lit("")).alias("category"), tier(tags, F.col("_review")).alias("tier"))


def reprocessed_rows(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Reprocessing results on variant rows; rows without a result stay in review."""
    joined = rows.join(results.select("handle", F.col("tags").alias("_tags"),
                                      F.col("needs_review").alias("_review")), "handle", "left")
    done = F.col("_tags").isNotNull()
    return joined.select(
        *[c for c in rows.columns if c != "tags"],
        F.when(done, join_tags(F.col("_tags"))).otherwise(F.col("tags")).alias("tags"),
        F.when(done & ~F.col("_review"), "clean").otherwise("review").alias("tier"))


def merge_tiers(clean: DataFrame, review: DataFrame, untagged: DataFrame) -> DataFrame:
    """Union by precedence, one row per (handle, variant_sku).

    ``ord`` is the row order inside each source.  The window group limit keeps
    one row per key and map task, so repeated keys cost nothing in the shuffle.
    """
    every = None
    for rank, (name, df) in enumerate((("clean", clean), ("review", review), ("untagged", untagged))):
        part = df.select("handle", "title", "variant_sku", "tags", "ord",
                         F.lit(rank).alias("source_rank"), F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    return first_rows(every, ["handle", "variant_sku"], F.col("source_rank"), F.col("ord")).select(
        "handle", F.coalesce("title", F.lit("")).alias("title"), "variant_sku",
        F.coalesce("tags", F.lit("")).alias("tags"), "source")


def not_yet_processed(products: DataFrame, processed: DataFrame) -> DataFrame:
    """Products whose handle was never processed in any run."""
    return products.join(processed.select("handle"), "handle", "left_anti")


def still_untagged(untagged: DataFrame, clean: DataFrame, review: DataFrame) -> DataFrame:
    """Untagged rows whose handle is neither clean nor in review by now."""
    return untagged.join(clean.select("handle").union(review.select("handle")), "handle", "left_anti")


def apply_fix(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """One product's fix on all of its rows; rows of unfixed products are kept as they are."""
    joined = rows.join(fixes.select("handle", F.col("tags").alias("_tags"), F.col("category").alias("_category"),
                                    F.col("note").alias("_note")), "handle", "left")
    return joined.select(
        *[c for c in rows.columns if c not in ("tags", "category", "failure_reasons")],
        F.coalesce("_tags", "tags").alias("tags"), F.coalesce("_category", "category").alias("category"),
        F.coalesce("_note", "failure_reasons").alias("failure_reasons"),
        F.col("_note").isNotNull().alias("fixed"))
