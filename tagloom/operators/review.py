"""Decisions over model answers: cascade, recovery, review, corrections."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.responses import parse_answer
from tagloom.functions.text import split_tags, words_literal
from tagloom.operators.validate import (clean_suggestion, closest_option, dimensions_to_fix,
                                        reprocess_tags, validate_all, validate_tag)

ACCEPT = 0.7          # fixed value: cascade threshold
APPROVE = 0.85        # fixed value: review approval threshold
REPROCESS = 0.6       # fixed value: reprocess threshold


def cascade(responses: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Per handle the first of the two leading models that is sure enough, else
    the third (flagged when unsure), else nothing and a flag.

    Aggregates only, so a handle's answers are combined before the shuffle.
    """
    read = responses.select("handle", "model_rank", "model", parse_answer(F.col("response_text")).alias("a"))
    answer = F.struct("a.tags", "a.confidence", "a.reasoning", "model")
    sure = F.when((F.col("a.confidence") >= accept) & (F.col("model_rank") <= 2), F.col("model_rank"))
    third = F.when((F.col("model_rank") == 3) & F.col("a").isNotNull(), F.col("model_rank"))
    picked = read.groupBy("handle").agg(
        F.min_by(F.when(sure.isNotNull(), answer), sure).alias("s"),
        F.min_by(F.when(third.isNotNull(), answer), third).alias("t"))
    best = F.coalesce("s", "t")
    return picked.select(
        "handle", F.coalesce(best["tags"], F.array().cast("array<string>")).alias("tags"),
        F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(best["model"], F.lit("none")).alias("model_used"),
        F.coalesce(F.col("s").isNull() & (F.coalesce(F.col("t.confidence"), F.lit(0.0)) < accept),
                   F.lit(True)).alias("needs_manual_review"),
        F.coalesce(best["reasoning"], F.lit("All AI models failed to generate tags")).alias("reasoning"))


def combine(ruled: DataFrame, answers: DataFrame | None, recovery: DataFrame | None = None,
            force_recovery: bool = False) -> DataFrame:
    """Rule tags plus valid model tags, validated, with recovery where they fail.

    ``ruled`` comes from ``tag_by_rules``, ``answers`` from :func:`cascade`,
    ``recovery`` holds one answer per handle (``handle``, ``tags``,
    ``confidence``).  A handle without category passes through untouched.
    """
    none = F.array().cast("array<string>")
    df = ruled
    if answers is not None:
        df = df.join(answers.select("handle", F.col("tags").alias("_ai"), F.col("confidence").alias("_conf"),
                                    F.col("model_used").alias("_model"),
                                    F.col("needs_manual_review").alias("_flag")), "handle", "left")
    else:
        df = df.select("*", none.alias("_ai"), F.lit(0.0).alias("_conf"), F.lit("none").alias("_model"),
                       F.lit(False).alias("_flag"))
    if recovery is not None:
        df = df.join(recovery.select("handle", F.col("tags").alias("_rec"),
                                     F.col("confidence").alias("_rconf")), "handle", "left")
    else:
        df = df.select("*", F.lit(None).cast("array<string>").alias("_rec"),
                       F.lit(None).cast("double").alias("_rconf"))
    cat = F.col("category")
    valid_ai = F.filter(F.coalesce("_ai", none), lambda t: validate_tag(t, cat)["valid"])
    df = df.select("*", valid_ai.alias("ai_tags"))
    df = df.select("*", F.array_sort(F.array_distinct(F.concat("rule_tags", "ai_tags"))).alias("_all"))
    df = df.select("*", validate_all(F.col("_all"), cat).alias("_fail"))
    gated = cat == ""
    failed = (F.size("_fail") > 0) | F.lit(force_recovery)
    recovered = failed & F.col("_rec").isNotNull() & (F.size(validate_all(F.coalesce("_rec", none), cat)) == 0)
    df = df.select("*", F.coalesce(recovered, F.lit(False)).alias("_ok"), failed.alias("_failed"))
    ok = F.col("_ok")
    conf, model = F.coalesce("_conf", F.lit(0.0)), F.coalesce("_model", F.lit("none"))
    return df.select(
        *[c for c in ruled.columns if c not in ("needs_manual_review", "failure_reasons")],
        F.when(gated, none).otherwise(F.col("ai_tags")).alias("ai_tags"),
        F.when(gated, none).when(ok, F.array_distinct("_rec")).otherwise(F.col("_all")).alias("tags"),
        F.when(gated, True).when(ok, F.col("_rconf") < ACCEPT).when(F.col("_failed"), True)
        .otherwise(F.coalesce("_flag", F.lit(False))).alias("needs_manual_review"),
        F.when(gated, 0.0).when(ok, F.col("_rconf")).otherwise(conf).alias("ai_confidence"),
        F.when(gated, "none").when(ok, F.concat(model, F.lit("+recovery"))).otherwise(model).alias("model_used"),
        F.when(gated, F.col("failure_reasons")).when(ok, none).otherwise(F.col("_fail")).alias("failure_reasons"))


def review_decision(decision: Column, confidence: Column, threshold: float = APPROVE) -> Column:
    """``approve`` only for a sure approval, else ``flag``; NULL without an answer."""
    return F.when(decision.isNull(), F.lit(None).cast("string")) \
        .when((decision == "approve") & (confidence >= threshold), "approve").otherwise("flag")


def auto_verify(decision: Column, verified: Column) -> Column:
    return verified | F.coalesce(decision == "approve", F.lit(False))


def with_corrections(products: DataFrame, corrections: DataFrame) -> DataFrame:
    """The corrections overlay: human tags and category win, and mark the row verified."""
    joined = products.join(corrections.select(
        "handle", F.col("tags").alias("_tags"), F.col("category").alias("_category")), "handle", "left")
    human = F.col("_tags").isNotNull() | F.col("_category").isNotNull()
    return joined.select(
        *[c for c in products.columns if c not in ("final_tags", "category", "human_verified")],
        F.when(F.size("_tags") > 0, F.col("_tags")).otherwise(F.col("final_tags")).alias("final_tags"),
        F.coalesce("_category", "category").alias("category"),
        (F.col("human_verified") | human).alias("human_verified"))


def reprocess(responses: DataFrame, threshold: float = REPROCESS) -> DataFrame:
    """Primary answer if it has tags, else the secondary's; still in review when
    unsure or without a valid tag; ``failed`` when neither has tags."""
    read = responses.filter("model_rank <= 2").select(
        "handle", "model_rank", "model",
        parse_answer(F.col("response_text"), greedy=True, need_confidence=False).alias("a"))
    rank = F.when(F.size("a.tags") > 0, F.col("model_rank"))
    best = read.groupBy("handle").agg(F.min_by(F.struct("a", "model"), rank).alias("b"),
                                      F.min(rank).alias("rank"))
    got = F.col("rank").isNotNull()
    tags = F.when(got, reprocess_tags(F.col("b.a.tags"))["kept"])
    conf = F.when(got, F.coalesce(F.col("b.a.confidence"), F.lit(0.5)))
    return best.select(
        "handle", tags.alias("tags"), F.when(got, F.col("b.a.category")).alias("category"), conf.alias("confidence"),
        F.when(got, F.col("b.model")).alias("model_used"),
        F.when(got, (conf < threshold) | (F.size(tags) < 1)).alias("needs_review"),
        F.when(got, F.when((conf < threshold) | (F.size(tags) < 1), "review").otherwise("fixed"))
        .otherwise("failed").alias("status"))


def targeted_fix(products: DataFrame, suggestions: DataFrame,
                 options: dict[str, list[str]] | None = None) -> DataFrame:
    """Missing dimensions filled from suggestions.

    ``products``: handle, tags (text), category, failure_reasons (text).
    ``suggestions``: handle, dimension, value; at most one row per handle and
    dimension counts.  Values are cleaned, then mapped to the closest option
    where the dimension has a list.
    """
    wanted = products.select("handle", F.posexplode(dimensions_to_fix(F.col("failure_reasons"))).alias("pos", "dimension"))
    given = suggestions.groupBy("handle", "dimension").agg(F.min("value").alias("value"))
    value = clean_suggestion(F.col("dimension"), F.col("value"))
    for dim, allowed in (options or {}).items():
        choices = words_literal(list(allowed))
        value = F.when(F.col("dimension") == dim,
                       F.when(F.array_contains(choices, value), value).otherwise(closest_option(value, choices))) \
            .otherwise(value)
    found = wanted.join(given, ["handle", "dimension"]).select("handle", "pos", "dimension", value.alias("value")) \
        .filter("value is not null and value <> ''")
    # at most one row per known failure pattern, so these lists hold eight items
    fixes = found.groupBy("handle").agg(
        F.array_sort(F.collect_list(F.struct("pos", "dimension", "value"))).alias("f"))
    joined = products.join(fixes, "handle", "left")
    fixed = F.col("f").isNotNull()
    values = F.transform("f", lambda x: x["value"])
    new_category = F.get(F.transform(F.filter("f", lambda x: x["dimension"] == "category"),
                                     lambda x: x["value"]), F.lit(0))
    return joined.select(
        "handle",
        F.when(fixed, F.array_join(F.concat(split_tags(F.col("tags")), values), ", "))
        .otherwise(F.col("tags")).alias("tags"),
        F.when(fixed, F.coalesce(new_category, F.col("category"))).otherwise(F.col("category")).alias("category"),
        F.when(fixed, F.concat(F.lit("Auto-fixed: "), F.array_join(F.transform("f", lambda x: x["dimension"]), ", ")))
        .otherwise(F.col("failure_reasons")).alias("failure_reasons"),
        fixed.alias("fixed"))


def review_queue(products: DataFrame, state: str, limit: int | None = None) -> DataFrame:
    """A queue in its order: ``unverified``, ``pending`` or ``flagged``.
    With ``limit`` its first page, as reviewers take it."""
    page = lambda df: df if limit is None else df.limit(limit)
    open_ = products.filter(~F.col("human_verified"))
    decision = F.col("ai_review_decision")
    if state == "unverified":
        return page(open_.orderBy("processed_at", "handle"))
    if state == "pending":
        return page(open_.filter(decision.isNull()).orderBy("processed_at", "handle"))
    if state == "flagged":
        return page(open_.filter(decision == "flag").orderBy("ai_review_confidence", "handle"))
    raise ValueError(f"unknown queue {state!r}")


def all_true(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, cols)
