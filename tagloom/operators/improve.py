"""Repeated improvement of flagged products from fresh answers."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagloom.operators.route import tier
from tagloom.session import cut


def improve(products: DataFrame, answers: DataFrame, target: float = 0.9, max_rounds: int = 5) -> DataFrame:
    """Flagged rows take a round's answer if it is surer, until enough rows are clean.

    ``products``: handle, tags, needs_manual_review, ai_confidence.  ``answers``:
    handle, round, tags, confidence, needs_manual_review.  The source compares a
    field its tagger never sets, so nothing there improves; ours compares the
    confidence itself.  Each round is checkpointed.
    """
    state = products
    for number in range(1, max_rounds + 1):
        rate = state.agg(F.avg((tier(F.col("tags"), F.col("needs_manual_review")) == "clean").cast("int"))).first()[0]
        if rate is None or rate >= target:
            break
        offered = answers.filter(F.col("round") == number).select(
            "handle", F.col("tags").alias("_t"), F.col("confidence").alias("_c"), F.col("needs_manual_review").alias("_r"))
        joined = state.join(offered, "handle", "left")
        better = F.col("needs_manual_review") & F.coalesce(F.col("_c") > F.col("ai_confidence"), F.lit(False))
        state = cut(joined.select(
            "handle", F.when(better, F.col("_t")).otherwise(F.col("tags")).alias("tags"),
            F.when(better, F.col("_r")).otherwise(F.col("needs_manual_review")).alias("needs_manual_review"),
            F.when(better, F.col("_c")).otherwise(F.col("ai_confidence")).alias("ai_confidence")))
    return state
