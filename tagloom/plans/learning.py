"""Queries of training data and its evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions.text import basic_tags, first_words
from tagloom.operators import training as L
from tagloom.plans.registry import query
from tagloom.plans.views import cte, table, view

BASE = cte("audit")
ROWS = BASE + """, e AS (SELECT *, CASE WHEN len(human_corrected_tags) > 0 THEN human_corrected_tags ELSE final_tags END AS x FROM audit),
t AS (SELECT handle, ord, 'Title: ' || title || chr(10) || 'Description: ' || substr(description, 1, 500) AS input_text, array_to_string(x, ', ') AS expected_tags, coalesce(effective_type, 'unknown') AS category, coalesce(ai_confidence, 0) AS confidence,
 CASE WHEN len(human_corrected_tags) > 0 THEN 1 ELSE 0 END AS human_corrected FROM e WHERE len(x) > 0)"""
RANK = "CAST('0x' || substr(md5(CAST({0} AS STRING) || '42'), 1, 15) AS BIGINT)"


def rows(spark, sf):
    return L.training_rows(view(spark, sf, "audit"))


@query("confident_rows", BASE + " SELECT handle FROM audit WHERE (human_verified OR ai_confidence >= 0.7) AND ai_confidence >= 0.7")
def q_confident(spark, sf):
    """The bound applies twice, so verified rows below it drop too."""
    return L.select_by_confidence(view(spark, sf, "audit"), 0.7).select("handle")


@query("training_rows", ROWS + " SELECT * EXCLUDE (ord) FROM t")
def q_rows(spark, sf):
    """F55 and F59."""
    return rows(spark, sf).select("handle", "input_text", "expected_tags", "category", "confidence", "human_corrected")


@query("prompt_records", BASE + """, e AS (SELECT *, CASE WHEN len(human_corrected_tags) > 0 THEN human_corrected_tags ELSE final_tags END AS x FROM audit WHERE human_verified)
SELECT ai_prompt AS prompt, array_to_string(x, ', ') AS completion, handle, coalesce(human_corrected_category, effective_type) AS category FROM e WHERE len(x) > 0 AND ai_prompt <> ''""")
def q_prompts(spark, sf):
    """S16."""
    return L.prompt_records(view(spark, sf, "audit")).select("prompt", "completion", "metadata.handle", "metadata.category")


@query("completions", cte("predictions") + """ SELECT ord, CASE WHEN correction <> '' THEN '{"tags":["ice","tobacco"],"confidence":0.95,"reasoning":"Tags assigned based on product analysis"}' ELSE '{"tags":[' ||
 CASE final_tags WHEN 'ice' THEN '"ice"' WHEN 'fruity, ice' THEN '"fruity","ice"' WHEN '' THEN '' ELSE '"cola"' END || '],"confidence":0.85,"reasoning":"Tags assigned based on product analysis"}' END AS completion FROM predictions""")
def q_completions(spark, sf):
    """expected answers as JSON."""
    return view(spark, sf, "predictions").select("ord", L.completion(F.col("correction"), F.col("final_tags")).alias("completion"))


@query("chat_records", "SELECT conv_id, count(*) AS turns, string_agg(role || ':' || CAST(length(text) AS STRING), '|' ORDER BY turn) AS shape FROM conversations GROUP BY 1")
def q_chat(spark, sf):
    """Messages in turn order."""
    chats = L.chat_records(table(spark, sf, "conversations"))
    return chats.select("conv_id", F.size("messages").cast("long").alias("turns"), F.array_join(F.transform(
        "messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), "|").alias("shape"))


@query("chat_text", "SELECT conv_id, md5(coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) FILTER (role IN ('user', 'assistant')), '')) AS digest FROM conversations GROUP BY 1")
def q_chat_text(spark, sf):
    """F56c."""
    chats = L.chat_records(table(spark, sf, "conversations"))
    return chats.select("conv_id", F.md5(L.chat_text(F.col("messages"))).alias("digest"))


@query("deduplicated_rows", cte("predictions") + " SELECT handle, min(ord) AS ord FROM predictions GROUP BY handle")
def q_dedup(spark, sf):
    """U6."""
    return L.dedup_by_handle(view(spark, sf, "predictions")).select("handle", "ord")


@query("balanced_sample", ROWS + f""", n AS (SELECT category, count(*) AS n FROM t GROUP BY 1), q AS (SELECT CASE WHEN sum(n) > 100 AND max(n) > 2 * min(n) THEN least(2 * min(n), max(n)) ELSE max(n) END AS quota FROM n),
r AS (SELECT handle, category, row_number() OVER (PARTITION BY category ORDER BY {RANK.format('handle')}, handle) AS rn FROM t) SELECT handle, category FROM r WHERE rn <= (SELECT quota FROM q)""")
def q_balanced(spark, sf):
    """W10."""
    return L.balanced_sample(rows(spark, sf)).select("handle", "category")


@query("balanced_events", f"""WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 5 > 0 THEN 'rare' WHEN event_type IN ('view', 'click') THEN 'common' ELSE event_type END AS category FROM events),
n AS (SELECT category, count(*) AS n FROM t GROUP BY 1), q AS (SELECT CASE WHEN sum(n) > 100 AND max(n) > 2 * min(n) THEN 2 * min(n) ELSE max(n) END AS quota FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {RANK.format('event_id')}, event_id) AS rn FROM t)
SELECT event_id, category FROM r WHERE rn <= (SELECT quota FROM q)""")
def q_balanced_events(spark, sf):
    """W10 on groups uneven enough to be cut."""
    kind = F.col("event_type")
    t = table(spark, sf, "events").select("event_id", F.when(
        (kind == "error") & (F.col("event_id") % 5 > 0), "rare").when(kind.isin("view", "click"), "common").otherwise(kind).alias("category"))
    return L.balanced_sample(t, "event_id").select("event_id", "category")


@query("stratified_split", ROWS + f""", r AS (SELECT handle, category, row_number() OVER (PARTITION BY category ORDER BY {RANK.format('handle')}, handle) AS rn, count(*) OVER (PARTITION BY category) AS n FROM t)
SELECT handle, CASE WHEN rn <= round(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM r""")
def q_split(spark, sf):
    """W11."""
    return L.stratified_split(rows(spark, sf)).select("handle", "split")


SCORES = cte("predictions") + """, p AS (SELECT handle, arg_max(prediction, ord) AS prediction FROM predictions GROUP BY 1), g AS (SELECT handle, arg_max(CASE WHEN correction <> '' THEN correction ELSE final_tags END, ord) AS t FROM predictions GROUP BY 1),
s AS (SELECT p.handle, CASE WHEN json_valid(prediction) THEN CAST(json_extract(prediction, '$.tags') AS VARCHAR[]) ELSE [] END AS pred, list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') AS truth FROM p JOIN g USING (handle)),
m AS (SELECT *, len(list_intersect(pred, truth)) AS hit FROM s), pr AS (SELECT *, CASE WHEN len(pred) > 0 THEN hit / len(pred) ELSE 0 END AS precision_, CASE WHEN len(truth) > 0 THEN hit / len(truth) ELSE 0 END AS recall_ FROM m),
f AS (SELECT *, CASE WHEN precision_ + recall_ > 0 THEN 2 * precision_ * recall_ / (precision_ + recall_) ELSE 0 END AS f1 FROM pr)"""


def scores(spark, sf):
    rows_ = view(spark, sf, "predictions")
    return L.score_predictions(rows_.select("handle", "prediction", "ord"), rows_.select("handle", "correction", "final_tags", "ord"))


@query("prediction_scores", SCORES + " SELECT handle, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f1, 6) AS f1 FROM f")
def q_scores(spark, sf):
    """F60 and J9."""
    return scores(spark, sf).select("handle", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("prediction_evaluation", SCORES + """ SELECT count(*) AS total, count(*) FILTER (list_sort(pred) = list_sort(truth)) AS exact_count, count(*) FILTER (hit > 0) AS partial_count, round(avg(precision_), 6) AS avg_precision, round(avg(recall_), 6) AS avg_recall, round(avg(f1), 6) AS avg_f1 FROM f""")
def q_evaluate(spark, sf):
    """A24."""
    return L.evaluate(scores(spark, sf)).select("total", "exact_count", "partial_count", *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in ("precision", "recall", "f1")])


@query("worst_predictions", SCORES + " SELECT handle, round(f1, 6) AS f1 FROM f ORDER BY f.f1, handle LIMIT 5")
def q_worst(spark, sf):
    """O5."""
    return L.worst(scores(spark, sf)).select("handle", F.round("f1", 6).alias("f1"))


@query("training_summary", ROWS + " SELECT category, count(*) AS examples, sum(human_corrected)::BIGINT AS human_corrected, round(avg(confidence), 6) AS avg_confidence FROM t GROUP BY 1")
def q_summary(spark, sf):
    """A35."""
    return L.training_summary(rows(spark, sf)).select("category", "examples", "human_corrected", F.round("avg_confidence", 6).alias("avg_confidence"))


@query("basic_tags", cte("products") + r""" SELECT handle, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 3), list_filter(['new', 'premium', 'quality', 'professional', 'modern', 'classic'], lambda w: contains(lower(description), w)))))[1:10], '|') AS tags,
 array_to_string(list_filter(regexp_split_to_array(description, '\s+'), lambda w: w <> '')[1:5], ' ') AS summary FROM products""")
def q_basic(spark, sf):
    """basic tags and first words."""
    return view(spark, sf, "products").select("handle", F.array_join(basic_tags(F.col("title"), F.col("description")), "|").alias("tags"),
                                              first_words(F.col("description"), 5).alias("summary"))
