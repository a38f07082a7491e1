"""Queries of tag validation and review decisions."""
from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import review as R, validate as V
from tagloom.plans.registry import query
from tagloom.plans.sqltext import in_list, quote, vocabulary_cte
from tagloom.plans.tagging import flat
from tagloom.plans.views import cte, view
from tagloom.rules.vocabulary import Vocabulary

VOCAB = Vocabulary()
MG = r"'^\d+(\.\d+)?mg$'"
_LAST = ", ".join(f"({quote(t)}, {quote(d)})" for t, d in VOCAB.last_dim().items())
_DIMS = [d.name for d in VOCAB.dims.values()]


def _audit(spark, sf):
    return view(spark, sf, "audit")


CAT = "coalesce(effective_type, '')"
BASE = cte("audit") + ", " + vocabulary_cte() + f""", tags AS (SELECT handle, {CAT} AS category, unnest(list_concat(final_tags, ai_tags)) AS tag FROM audit),
ranges AS (SELECT * FROM (VALUES ('nicotine_strength', 0, 20), ('cbd_strength', 0, 50000)) t(dimension, lo, hi)),
verdicts AS (SELECT handle, category, tag, tag IN (SELECT tag FROM dim_category) OR EXISTS (SELECT 1 FROM dim_tag t JOIN dim_applies a USING (dimension) WHERE t.tag = g.tag AND a.category = g.category)
  OR (regexp_matches(tag, {MG}) AND EXISTS (SELECT 1 FROM ranges r JOIN dim_applies a USING (dimension) WHERE a.category = g.category AND CAST(CASE WHEN regexp_matches(tag, {MG}) THEN replace(tag, 'mg', '') END AS DOUBLE) BETWEEN r.lo AND r.hi)) AS valid,
  (SELECT arg_max(dimension, ord) FROM dim_tag t WHERE t.tag = g.tag) AS last_dimension FROM tags g)"""


@query("validate_tags", BASE + f""" SELECT handle, tag, valid, CASE WHEN valid THEN NULL
 WHEN regexp_matches(tag, {MG}) THEN CASE WHEN category = 'CBD' THEN 'Tag ''' || tag || ''' value ' || CAST(CAST(replace(tag, 'mg', '') AS DOUBLE) AS VARCHAR) || ' outside range [0, 50000] for dimension ''cbd_strength''' ELSE 'Tag ''' || tag || ''' does not apply to category ''' || category || ''' (dimension: cbd_strength)' END
 WHEN last_dimension IS NULL THEN 'Tag ''' || tag || ''' not found in approved schema'
 ELSE 'Tag ''' || tag || ''' does not apply to category ''' || category || ''' (dimension: ' || last_dimension || ')' END AS reason FROM verdicts""")
def q_validate(spark, sf):
    """Every tag of every product, without a join."""
    rows = _audit(spark, sf).select("handle", F.coalesce("effective_type", F.lit("")).alias("category"),
                                    F.explode(F.concat("final_tags", "ai_tags")).alias("tag"))
    return rows.select("handle", "tag", V.validate_tag(F.col("tag"), F.col("category")).alias("v")).select("handle", "tag", "v.valid", "v.reason")


@query("applies_to", BASE + f""", firsts AS (SELECT tag, arg_min(dimension, ord) AS dimension FROM dim_tag GROUP BY tag),
named AS (SELECT g.*, CASE WHEN regexp_matches(g.tag, {MG}) THEN 'nicotine_strength' ELSE f.dimension END AS dimension FROM tags g LEFT JOIN firsts f ON f.tag = g.tag)
SELECT n.handle, n.tag, n.dimension IS NOT NULL AND EXISTS (SELECT 1 FROM dim_applies a WHERE a.dimension = n.dimension AND a.category = n.category) AS applies FROM named n""")
def q_applies(spark, sf):
    """F21."""
    rows = _audit(spark, sf).select("handle", F.coalesce("effective_type", F.lit("")).alias("category"),
                                    F.explode(F.concat("final_tags", "ai_tags")).alias("tag"))
    return rows.select("handle", "tag", V.applies_to(F.col("tag"), F.col("category"))["applies"].alias("applies"))


def _options(dim):
    return "[" + ", ".join(f"''{t}''" for t in VOCAB.dims[dim].tags) + "]"


@query("cbd_completeness", cte("audit") + f""" SELECT handle, CASE WHEN effective_type = 'CBD' THEN concat_ws('|',
 CASE WHEN len(list_filter(final_tags, lambda t: coalesce(CASE WHEN regexp_matches(t, {MG}) THEN CAST(regexp_replace(t, 'mg$', '') AS DOUBLE) <= 50000 END, false))) = 0 THEN 'CBD product missing cbd_strength tag (0-50000mg)' END,
 CASE WHEN NOT list_has_any(final_tags, [{', '.join(quote(t) for t in VOCAB.dims['cbd_form'].tags)}]) THEN 'CBD product missing cbd_form tag. Valid options: {_options('cbd_form')}' END,
 CASE WHEN NOT list_has_any(final_tags, [{', '.join(quote(t) for t in VOCAB.dims['cbd_type'].tags)}]) THEN 'CBD product missing cbd_type tag. Valid options: {_options('cbd_type')}' END) ELSE '' END AS failures FROM audit""")
def q_cbd(spark, sf):
    """what CBD products lack."""
    return _audit(spark, sf).select("handle", F.array_join(V.cbd_failures(
        F.col("final_tags"), F.coalesce("effective_type", F.lit(""))), "|").alias("failures"))


@query("validate_products", BASE + f""", bad AS (SELECT handle, count(*) FILTER (NOT valid) AS n, count(*) FILTER (category IN ({', '.join(quote(c) for c in VOCAB.applies('nicotine_strength'))}) AND CAST(CASE WHEN regexp_matches(tag, {MG}) THEN replace(tag, 'mg', '') END AS DOUBLE) > 20) AS illegal FROM verdicts GROUP BY handle)
SELECT a.handle, len(list_concat(final_tags, ai_tags)) = 0 AS empty, coalesce(b.n, 0) AS invalid, coalesce(b.illegal, 0) AS illegal FROM audit a LEFT JOIN bad b USING (handle)""")
def q_validate_all(spark, sf):
    """counts of the reasons per product."""
    rows = _audit(spark, sf).select("handle", V.validate_all(F.concat("final_tags", "ai_tags"), F.coalesce("effective_type", F.lit(""))).alias("r"))
    return rows.select(
        "handle", F.array_contains("r", "No tags provided").alias("empty"),
        F.size(F.filter("r", lambda x: x.startswith("Tag '"))).cast("long").alias("invalid"),
        F.size(F.filter("r", lambda x: x.startswith("Illegal"))).cast("long").alias("illegal"))


@query("applicable_dimensions", cte("audit") + ", " + vocabulary_cte() + """ SELECT c.category, a.dimension FROM (SELECT DISTINCT coalesce(effective_type, '') AS category FROM audit) c JOIN dim_applies a ON a.category = c.category""")
def q_applicable(spark, sf):
    """F22b."""
    rows = _audit(spark, sf).select(F.coalesce("effective_type", F.lit("")).alias("category")).distinct()
    return rows.select("category", F.explode(F.map_keys(V.applicable_dimensions(F.col("category")))).alias("dimension"))


@query("tag_dimension", cte("audit") + f""", last_dim AS (SELECT * FROM (VALUES {_LAST}) t(tag, dim)), tags AS (SELECT effective_type, unnest(final_tags) AS tag FROM audit)
SELECT coalesce(l.dim, CASE WHEN regexp_matches(t.tag, '^\\d+mg$') AND effective_type = 'CBD' THEN 'cbd_strength' END, 'unknown') AS dimension, count(*) AS uses FROM tags t LEFT JOIN last_dim l USING (tag) GROUP BY 1""")
def q_dimension(spark, sf):
    """F19."""
    rows = _audit(spark, sf).select("effective_type", F.explode("final_tags").alias("tag"))
    return rows.groupBy(V.tag_dimension(F.col("tag"), F.col("effective_type")).alias("dimension")).agg(F.count("*").alias("uses"))


@query("mapped_model_tags", cte("audit") + ", " + vocabulary_cte() + f""", t AS (SELECT handle, {CAT} AS category, contains(title, 'various') AS evidence, unnest(list_concat(final_tags, ['Pen Style', '20 mg'])) AS raw FROM audit),
n AS (SELECT *, regexp_replace(regexp_replace(trim(lower(raw)), '(\\d+(?:\\.\\d+)?)\\s*(mg|ml|ohm)', '\\1\\2', 'g'), '\\s+', '_', 'g') AS tag FROM t)
SELECT handle, count(*) AS kept FROM n WHERE (tag IN (SELECT tag FROM dim_tag UNION SELECT tag FROM dim_category) OR CAST(CASE WHEN regexp_matches(tag, {MG}) THEN replace(tag, 'mg', '') END AS DOUBLE) <= 50000)
 AND NOT (category = 'CBD' AND NOT evidence AND {in_list('tag', V.DEVICE_TAGS)}) GROUP BY handle""")
def q_map(spark, sf):
    """F17."""
    rows = _audit(spark, sf).select("handle", F.size(V.map_model_tags(
        F.concat("final_tags", F.array(F.lit("Pen Style"), F.lit("20 mg"))), F.coalesce("effective_type", F.lit("")),
        F.col("title").contains("various"))).cast("long").alias("kept"))
    return rows.filter("kept > 0")


@query("reprocess_tag_filter", cte("responses") + """, t AS (SELECT handle, model_rank, unnest(string_split(response_text, ' ')) AS raw FROM responses)
SELECT handle, model_rank, count(*) AS kept FROM t WHERE trim(raw) <> '' AND NOT lower(trim(raw)) IN ('the', 'but', 'for', 'with', 'product', 'item', 'unknown', 'n/a', 'none', 'null') GROUP BY ALL""")
def q_reprocess_filter(spark, sf):
    """P17.  Words that are part of a known tag (a, an, and, or) are kept, as in the source."""
    return view(spark, sf, "responses").select(
        "handle", "model_rank", F.size(V.reprocess_tags(F.split("response_text", " "))["kept"]).cast("long").alias("kept")).filter("kept > 0")


FAILURE = "CASE o_orderkey % 5 WHEN 0 THEN 'Missing cbd_type; missing strength' WHEN 1 THEN 'Category detection failed - x' WHEN 2 THEN '' WHEN 3 THEN 'other' ELSE 'missing vg_ratio' END"


@query("dimensions_to_fix", f"""WITH f AS (SELECT o_orderkey, {FAILURE} AS failure FROM orders)
SELECT o_orderkey, CASE WHEN failure LIKE 'Missing cbd%' THEN 'cbd_type|strength' WHEN failure LIKE 'Category%' THEN 'category' WHEN failure = 'missing vg_ratio' THEN 'vg_ratio' ELSE '' END AS dims,
 CASE WHEN failure LIKE 'Missing cbd%' THEN 'cbd_type|strength' WHEN failure LIKE 'Category%' THEN 'category' WHEN failure = 'missing vg_ratio' THEN 'vg_ratio' WHEN failure = '' THEN '' ELSE 'all' END AS focus FROM f""")
def q_fix_dims(spark, sf):
    """F22c."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey", f"{FAILURE} AS failure")
    return rows.select("o_orderkey", F.array_join(V.dimensions_to_fix(F.col("failure")), "|").alias("dims"),
                       F.array_join(V.focus_areas(F.col("failure")), "|").alias("focus"))


@query("closest_option", """WITH o AS (SELECT p_partkey, lower(p_type) AS value FROM part)
SELECT p_partkey, CASE WHEN contains('econ', value) OR contains(value, 'econ') THEN 'econ' WHEN contains('standard plus', value) OR contains(value, 'standard plus') THEN 'standard plus' WHEN contains('pro', value) OR contains(value, 'pro') THEN 'pro' END AS option FROM o""")
def q_closest(spark, sf):
    """F22d."""
    options = F.array(F.lit("econ"), F.lit("standard plus"), F.lit("pro"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", V.closest_option(F.lower("p_type"), options).alias("option"))


PARSED = cte("responses") + """, clean AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(response_text, '```json\\s*', '', 'g'), '```\\s*$', ''), '^\\s+|\\s+$', '', 'g') AS c FROM responses),
src AS (SELECT *, CASE WHEN starts_with(c, '{') OR regexp_extract(c, '(\\{.*?\\})', 1, 's') = '' THEN c ELSE regexp_extract(c, '(\\{.*?\\})', 1, 's') END AS body, regexp_extract(response_text, '\\[([^\\]]+)\\]', 1) AS lst FROM clean),
js AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM src),
p AS (SELECT handle, model_rank, model, CASE WHEN json_extract(j, '$.tags') IS NOT NULL AND json_extract(j, '$.confidence') IS NOT NULL THEN CAST(json_extract(j, '$.tags') AS VARCHAR[])
  WHEN lst <> '' THEN list_filter(list_transform(string_split(lst, ','), lambda t: trim(trim(trim(t), '"'), '''')), lambda t: t <> '') END AS tags,
  CASE WHEN json_extract(j, '$.tags') IS NOT NULL AND json_extract(j, '$.confidence') IS NOT NULL THEN CAST(json_extract(j, '$.confidence') AS DOUBLE) WHEN lst <> '' THEN 0.5 END AS confidence FROM js)"""


@query("parsed_answers", PARSED + " SELECT handle, model_rank, coalesce(array_to_string(tags, '|'), '') AS tags, confidence FROM p")
def q_parsed(spark, sf):
    """F53."""
    from tagloom.functions.responses import parse_answer
    rows = view(spark, sf, "responses").select("handle", "model_rank", parse_answer(F.col("response_text")).alias("a"))
    return rows.select("handle", "model_rank", F.coalesce(F.array_join("a.tags", "|"), F.lit("")).alias("tags"), "a.confidence")


@query("model_cascade", PARSED + """, s AS (SELECT handle, arg_min(struct_pack(tags, confidence, model), model_rank) AS a FROM p WHERE model_rank <= 2 AND confidence >= 0.7 GROUP BY handle),
t AS (SELECT handle, any_value(struct_pack(tags, confidence, model)) AS a FROM p WHERE model_rank = 3 AND confidence IS NOT NULL GROUP BY handle), h AS (SELECT DISTINCT handle FROM p)
SELECT h.handle, coalesce(array_to_string(coalesce(s.a, t.a).tags, '|'), '') AS tags, coalesce(coalesce(s.a, t.a).confidence, 0) AS confidence, coalesce(coalesce(s.a, t.a).model, 'none') AS model_used,
 s.a IS NULL AND coalesce(t.a.confidence, 0) < 0.7 AS needs_manual_review FROM h LEFT JOIN s USING (handle) LEFT JOIN t USING (handle)""")
def q_cascade(spark, sf):
    """W12."""
    return R.cascade(view(spark, sf, "responses")).select(
        "handle", F.array_join("tags", "|").alias("tags"), "confidence", "model_used", "needs_manual_review")


REREAD = PARSED.replace(".*?", ".*").replace(" AND json_extract(j, '$.confidence') IS NOT NULL", "")


@query("reprocess_decision", REREAD + """, r AS (SELECT *, CASE WHEN len(tags) > 0 THEN model_rank END AS rk FROM p WHERE model_rank <= 2),
best AS (SELECT handle, min(rk) AS rank, arg_min(struct_pack(tags, confidence, model), rk) AS b FROM r GROUP BY handle),
k AS (SELECT handle, rank, b.model AS model, list_filter(list_transform(b.tags, lambda t: lower(trim(t))), lambda t: t <> '' AND t NOT IN ('the', 'but', 'for', 'with', 'product', 'item', 'unknown', 'n/a', 'none', 'null')) AS kept,
 CASE WHEN rank IS NOT NULL THEN coalesce(b.confidence, 0.5) END AS confidence FROM best)
SELECT handle, coalesce(array_to_string(kept, '|'), '') AS tags, confidence, model AS model_used, CASE WHEN rank IS NOT NULL THEN confidence < 0.6 OR len(kept) < 1 END AS needs_review,
 CASE WHEN rank IS NULL THEN 'failed' WHEN confidence < 0.6 OR len(kept) < 1 THEN 'review' ELSE 'fixed' END AS status FROM k""")
def q_reprocess(spark, sf):
    """F58c."""
    return R.reprocess(view(spark, sf, "responses")).select(
        "handle", F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"), "confidence", "model_used", "needs_review", "status")


@query("review_decisions", cte("audit") + """, d AS (SELECT handle, human_verified, CASE WHEN ai_review_decision IS NULL THEN NULL WHEN ai_review_decision = 'approve' AND ai_review_confidence >= 0.85 THEN 'approve' ELSE 'flag' END AS decision FROM audit)
SELECT handle, decision, human_verified OR coalesce(decision = 'approve', false) AS verified FROM d""")
def q_decisions(spark, sf):
    """F58."""
    rows = _audit(spark, sf).select("handle", "human_verified", R.review_decision(
        F.col("ai_review_decision"), F.col("ai_review_confidence")).alias("decision"))
    return rows.select("handle", "decision", R.auto_verify(F.col("decision"), F.col("human_verified")).alias("verified"))


@query("recovery_decision", cte("audit") + """ SELECT handle, CASE WHEN len(list_filter(final_tags, lambda t: t = 'mystery')) > 0 THEN ai_confidence < 0.7 END AS recovered_review FROM audit WHERE effective_type = 'e-liquid' AND list_contains(final_tags, 'mystery') AND ai_confidence IS NOT NULL""")
def q_recovery(spark, sf):
    """Products whose tags fail only through an unknown tag take a valid recovered set."""
    base = _audit(spark, sf).filter("effective_type = 'e-liquid' and array_contains(final_tags, 'mystery') and ai_confidence is not null")
    none = F.array().cast("array<string>")
    ruled = base.select("handle", F.col("effective_type").alias("category"), F.col("final_tags").alias("rule_tags"),
                        F.lit(False).alias("needs_manual_review"), none.alias("failure_reasons"))
    recovery = base.select("handle", F.array(F.lit("fruity"), F.lit("ice")).alias("tags"), F.col("ai_confidence").alias("confidence"))
    return R.combine(ruled, None, recovery).select("handle", F.col("needs_manual_review").alias("recovered_review"))


@query("targeted_fixes", f"""WITH b AS (SELECT 'h' || CAST(o_orderkey AS STRING) AS handle, o_orderkey % 5 AS k, o_orderkey % 3 AS s FROM orders)
SELECT handle, CASE WHEN k = 1 AND s = 0 THEN 'ice, pod' WHEN k = 4 AND s = 0 THEN 'ice, 70/30' ELSE 'ice' END AS tags, CASE WHEN k = 1 AND s = 0 THEN 'pod' ELSE 'tank' END AS category,
 (k = 1 OR k = 4) AND s = 0 AS fixed FROM b""")
def q_targeted(spark, sf):
    """F58d."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "'h' || CAST(o_orderkey AS STRING) AS handle", "'ice' AS tags", "'tank' AS category", f"{FAILURE} AS failure_reasons", "o_orderkey % 3 AS s")
    given = rows.filter("s = 0").select("handle", F.explode(F.array(
        F.struct(F.lit("category").alias("dimension"), F.lit("The pod.").alias("value")),
        F.struct(F.lit("vg_ratio").alias("dimension"), F.lit("answer: 70").alias("value")))).alias("x")).select("handle", "x.*")
    return R.targeted_fix(rows.drop("s"), given).select("handle", "tags", "category", "fixed")


@query("corrections", cte("audit") + """ SELECT handle, array_to_string(CASE WHEN len(human_corrected_tags) > 0 THEN human_corrected_tags ELSE final_tags END, '|') AS final_tags, coalesce(human_corrected_category, effective_type) AS category,
 human_verified OR human_corrected_tags IS NOT NULL OR human_corrected_category IS NOT NULL AS human_verified FROM audit""")
def q_corrections(spark, sf):
    """the overlay wins, nothing is updated in place."""
    rows = _audit(spark, sf)
    overlay = rows.filter("human_corrected_tags is not null or human_corrected_category is not null").select(
        "handle", F.col("human_corrected_tags").alias("tags"), F.col("human_corrected_category").alias("category"))
    base = rows.select("handle", "final_tags", F.col("effective_type").alias("category"), "human_verified")
    return R.with_corrections(base, overlay).select("handle", F.array_join("final_tags", "|").alias("final_tags"), "category", "human_verified")


def _queue(state, where, order):
    @query(f"queue_{state}", cte("audit") + f" SELECT handle FROM audit WHERE NOT human_verified {where} ORDER BY {order}, handle")
    def run(spark, sf):
        return R.review_queue(_audit(spark, sf), state).select("handle")
    run.__doc__ = "P14: a review queue."


_queue("unverified", "", "processed_at")
_queue("pending", "AND ai_review_decision IS NULL", "processed_at")
_queue("flagged", "AND ai_review_decision = 'flag'", "ai_review_confidence")
