"""Training records from audited products: selection, balance, split, scoring."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.text import join_tags, split_tags
from tagloom.operators.ordering import bounded_lists, first_rows, hash_bucket, hash_rank, positions


def select_by_confidence(products: DataFrame, least: float, include_human: bool = True) -> DataFrame:
    """Rows sure enough for training.  With ``least`` above 0 the plain bound
    applies as well, so verified rows below it drop too; unknown confidence
    never passes it."""
    sure = F.col("ai_confidence") >= least
    keep = (F.col("human_verified") | sure) if include_human else sure
    if least > 0:
        keep = keep & sure
    return products.filter(keep)


def expected_tags(products: DataFrame) -> Column:
    """Human tags where given, else the final ones."""
    return F.when(F.size("human_corrected_tags") > 0, F.col("human_corrected_tags")).otherwise(F.col("final_tags"))


def training_rows(products: DataFrame) -> DataFrame:
    """Input text, expected tags, category and confidence per usable product."""
    expected = expected_tags(products)
    return products.filter(F.size(expected) > 0).select(
        "handle", "ord",
        F.concat(F.lit("Title: "), "title", F.lit("\nDescription: "), F.substring("description", 1, 500)).alias("input_text"),
        join_tags(expected).alias("expected_tags"),
        F.coalesce("effective_type", F.lit("unknown")).alias("category"),
        F.coalesce("ai_confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.size("human_corrected_tags") > 0, 1).otherwise(0).alias("human_corrected"),
        join_tags(F.col("rule_tags")).alias("rule_tags"), join_tags(F.col("ai_tags")).alias("ai_tags"))


def prompt_records(products: DataFrame, verified_only: bool = True) -> DataFrame:
    """Prompt, completion and metadata; rows without prompt or tags are left out."""
    rows = products.filter("human_verified") if verified_only else products
    tags = expected_tags(rows)
    return rows.filter((F.size(tags) > 0) & (F.coalesce("ai_prompt", F.lit("")) != "")).select(
        F.col("ai_prompt").alias("prompt"), join_tags(tags).alias("completion"),
        F.struct("handle", F.coalesce("human_corrected_category", "effective_type").alias("category")).alias("metadata"))


def completion(correction: Column, final_tags: Column) -> Column:
    """Expected answer as JSON: 0.95 sure for a correction, else 0.85."""
    given = F.trim(F.coalesce(correction, F.lit(""))) != ""
    tags = F.when(given, split_tags(correction)).otherwise(split_tags(final_tags))
    return F.to_json(F.struct(tags.alias("tags"), F.when(given, 0.95).otherwise(0.85).alias("confidence"),
                              F.lit("Tags assigned based on product analysis").alias("reasoning")))


def chat_records(turns: DataFrame, limit: int = 10_000) -> DataFrame:
    """One row per conversation with its messages in turn order.

    A conversation longer than ``limit`` turns continues in further ``part``
    rows: turns are numbered without gaps, so a part is a range of turns.
    """
    return bounded_lists(turns, ["conv_id"], [F.col("turn")], F.floor(F.col("turn") / limit),
                         F.struct("role", F.col("text").alias("content")), "messages", limit)


def chat_text(messages: Column) -> Column:
    """Messages as one marked-up text; other roles are left out."""
    known = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    return F.array_join(F.transform(known, lambda m: F.concat(
        F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")


def dedup_by_handle(rows: DataFrame) -> DataFrame:
    """First row per handle, in row order."""
    return first_rows(rows, ["handle"], F.col("ord"))


def balanced_sample(rows: DataFrame, key: str = "handle", group: str = "category",
                    salt: str = "42", least_rows: int = 100) -> DataFrame:
    """At most twice the smallest group's size from every group.

    Applies only above ``least_rows`` rows and when the largest group is more
    than twice the smallest.  Rows are taken in hash order, so the choice does
    not depend on partitions; positions come from hash buckets, so a group with
    a third of all rows is never sorted in one task.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    quota = sizes.agg(
        F.when((F.sum("_n") > least_rows) & (F.max("_n") > 2 * F.min("_n")),
               F.least(2 * F.min("_n"), F.max("_n"))).otherwise(F.max("_n")).alias("_quota"))
    placed = positions(rows.withColumn("_rank", hash_rank(F.col(key), salt)), [group],
                       [F.col("_rank"), F.col(key)], hash_bucket(F.col(key), salt), "_pos")
    return placed.filter(F.col("_pos") <= quota.scalar()).select(*rows.columns)


def stratified_split(rows: DataFrame, key: str = "handle", group: str = "category",
                     share: float = 0.2, salt: str = "42") -> DataFrame:
    """Adds ``split`` (train / val): a fixed share of every group in hash order.

    Without a usable grouping (one group, fewer than ten rows, or a group of
    one) the share is taken over all rows.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    usable = sizes.agg(((F.count("*") > 1) & (F.sum("_n") >= 10) & (F.min("_n") >= 2)).alias("u")).scalar()
    strata = rows.withColumn("_stratum", F.when(usable, F.col(group)).otherwise(F.lit("")))
    totals = strata.groupBy("_stratum").agg(F.count("*").alias("_total"))
    placed = positions(strata.withColumn("_rank", hash_rank(F.col(key), salt)), ["_stratum"],
                       [F.col("_rank"), F.col(key)], hash_bucket(F.col(key), salt), "_pos")
    return placed.join(totals, "_stratum").select(
        *rows.columns, F.when(F.col("_pos") <= F.round(F.col("_total") * share), "val").otherwise("train").alias("split"))


def score_columns(predicted: Column, expected: Column) -> list[Column]:
    """Precision, recall and F1 of two tag sets, 0 where undefined."""
    hit = F.size(F.array_intersect(predicted, expected))
    p = F.coalesce(F.try_divide(hit, F.size(predicted)), F.lit(0.0))
    r = F.coalesce(F.try_divide(hit, F.size(expected)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def score_predictions(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores per handle.  Repeated handles: the last row counts on both sides.
    A prediction that is not JSON has no tags; a correction replaces the final tags."""
    said = predictions.groupBy("handle").agg(F.max_by("prediction", "ord").alias("prediction")) \
        .select("handle", F.array_distinct(F.coalesce(
            F.from_json("prediction", "tags array<string>")["tags"],
            F.array().cast("array<string>"))).alias("pred"))
    known = truth.groupBy("handle").agg(F.max_by(F.struct("correction", "final_tags"), "ord").alias("t")) \
        .select("handle", F.array_distinct(split_tags(F.when(
            F.trim(F.coalesce("t.correction", F.lit(""))) != "", F.col("t.correction"))
            .otherwise(F.col("t.final_tags")))).alias("truth"))
    both = known.join(said, "handle")
    return both.select("handle", *score_columns(F.col("pred"), F.col("truth")),
                       (F.array_sort("pred") == F.array_sort("truth")).alias("exact"),
                       F.arrays_overlap("pred", "truth").alias("partial"))


def evaluate(scores: DataFrame) -> DataFrame:
    """Exact and partial match rates and macro averages; 0 without rows."""
    def rate(col: str) -> Column:
        return F.coalesce(F.avg(F.coalesce(F.col(col), F.lit(False)).cast("int")), F.lit(0.0))

    return scores.agg(
        F.count("*").alias("total"), F.count_if("exact").alias("exact_count"),
        rate("exact").alias("exact_rate"), F.count_if("partial").alias("partial_count"),
        rate("partial").alias("partial_rate"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in ("precision", "recall", "f1")])


def worst(scores: DataFrame, n: int = 5) -> DataFrame:
    """Lowest F1 first; the limit is the report's length."""
    return scores.orderBy("f1", "handle").limit(n)


def training_summary(rows: DataFrame) -> DataFrame:
    """Rows, corrections and average confidence per category."""
    return rows.groupBy("category").agg(
        F.count("*").alias("examples"), F.sum("human_corrected").alias("human_corrected"),
        F.avg("confidence").alias("avg_confidence"))
