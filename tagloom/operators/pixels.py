"""Image statistics over a pixel table (image, brand, x, y, r, g, b)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.media import COUNTERFEIT_WORDS, background_score, hex_color, sharpness_score
from tagloom.operators.ordering import top_rows


def grey() -> Column:
    """Luma of a pixel, whole numbers as image libraries round it."""
    return F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000)


def sharpness(pixels: DataFrame) -> DataFrame:
    """Variance of grey values per image and its score.  The source declares an
    edge kernel but scores the plain variance, so that is what counts."""
    return pixels.groupBy("image").agg(F.var_pop(grey()).alias("variance")) \
        .select("image", "variance", sharpness_score(F.col("variance")).alias("score"), (F.col("variance") < 100).alias("is_blur"))


def background(pixels: DataFrame) -> DataFrame:
    """Most frequent edge colour per image, its share and the background score.
    A corner lies on two edges and counts twice."""
    size = pixels.groupBy("image").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    edge = pixels.join(size, "image").select("image", "r", "g", "b", (
        (F.col("x") == 0).cast("int") + (F.col("x") == F.col("mx")).cast("int")
        + (F.col("y") == 0).cast("int") + (F.col("y") == F.col("my")).cast("int")).alias("w")).filter("w > 0")
    colors = edge.groupBy("image", "r", "g", "b").agg(F.sum("w").alias("n"))
    best = colors.groupBy("image").agg(
        F.sum("n").alias("total"), F.max(F.struct("n", "r", "g", "b")).alias("m"))
    share, light = F.col("m.n") / F.col("total"), (F.col("m.r") + F.col("m.g") + F.col("m.b")) / 3
    return best.select("image", share.alias("share"), light.alias("brightness"), background_score(share, light).alias("score"))


def palette(pixels: DataFrame, colors: int = 5) -> DataFrame:
    """Most frequent colours per image, most frequent first."""
    counted = pixels.groupBy("image", "r", "g", "b").agg(F.count("*").alias("n"))
    return top_rows(counted, ["image"], colors, F.desc("n"), F.col("r"), F.col("g"), F.col("b")).select(
        "image", "rank", hex_color(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "n")


def brand_consistency(files: DataFrame, colors: DataFrame, first_images: int = 10) -> DataFrame:
    """Consistency report per brand.

    ``files``: brand, image, name, ord.  ``colors``: image, hex (a palette).  Colours of
    the first ``first_images`` images count, as in the source; the number is a parameter.
    """
    low = F.lower("name")
    flags = files.groupBy("brand").agg(
        F.count("*").alias("total_assets"), F.count_if(low.contains("logo")).alias("logo_files"),
        F.sum(sum((low.contains(w).cast("int") for w in COUNTERFEIT_WORDS), F.lit(0))).alias("counterfeit_marks"))
    sampled = top_rows(files.select("brand", "image", "ord"), ["brand"], first_images, F.col("ord")).select("brand", "image")
    used = sampled.join(colors.select("image", "hex"), "image").groupBy("brand").agg(
        F.count_distinct("image").alias("palettes"), F.count("*").alias("n"), F.count_distinct("hex").alias("u"))
    joined = flags.join(used, "brand", "left")
    color = F.when(F.coalesce("palettes", F.lit(0)) < 2, 8.0).otherwise(5 + 5 * (1 - F.col("u") / (F.col("n") + 1)))
    scored = joined.select("*", color.alias("color_score"))
    overall = F.col("color_score") * 0.6 + F.lit(7.0) * 0.4
    issues = (F.col("logo_files") > 3).cast("int") + (F.col("color_score") < 6).cast("int")
    return scored.select(
        "brand", "total_assets", "logo_files", F.round("color_score", 2).alias("color_score"),
        F.round(overall, 2).alias("overall_score"), issues.alias("inconsistencies"), "counterfeit_marks",
        ((overall >= 7) & (F.col("counterfeit_marks") == 0) & (issues <= 2)).alias("passed"))
