"""Queries of the audit reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import audit as A
from tagloom.plans.registry import query
from tagloom.plans.sqltext import in_list, quote, vocabulary_cte
from tagloom.plans.views import cte, view
from tagloom.rules.vocabulary import Vocabulary

VOCAB = Vocabulary()
BASE = cte("audit")
KIND = "coalesce(nullif(effective_type, ''), 'unknown')"
_LAST = ", ".join(f"({quote(t)}, {quote(d)})" for t, d in VOCAB.last_dim().items())
LAST = f"last_dim AS (SELECT * FROM (VALUES {_LAST}) t(tag, dim))"


def audit(spark, sf):
    return view(spark, sf, "audit")


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("tag_frequency", BASE + ", t AS (SELECT unnest(final_tags) AS tag, processed_at FROM audit) SELECT tag, count(*) AS frequency, min(processed_at) AS first_used, max(processed_at) AS last_used FROM t GROUP BY tag")
def q_frequency(spark, sf):
    """A2."""
    return A.tag_frequency(audit(spark, sf))


@query("popular_tags", BASE + ", t AS (SELECT unnest(final_tags) AS tag, processed_at FROM audit) SELECT tag, count(*) AS frequency FROM t GROUP BY tag ORDER BY count(*) DESC, max(processed_at) DESC, tag LIMIT 10")
def q_popular(spark, sf):
    """O3."""
    return A.popular_tags(audit(spark, sf), 10).select("tag", "frequency")


@query("tag_coverage", BASE + f""", {LAST}, t AS (SELECT unnest(final_tags) AS tag FROM audit)
SELECT 'total_tags_used' AS metric, count(*) AS value FROM t UNION ALL SELECT 'unique_tags_used', count(DISTINCT tag) FROM t UNION ALL SELECT 'total_products', count(*) FROM audit
UNION ALL SELECT 'untagged_products', count(*) FROM audit WHERE len(final_tags) = 0 UNION ALL SELECT 'categories_represented', count(DISTINCT coalesce(dim, 'unknown')) FROM t LEFT JOIN last_dim USING (tag)""")
def q_coverage(spark, sf):
    """A4."""
    return A.coverage(audit(spark, sf))


@query("coverage_by_dimension", BASE + f", {LAST}, t AS (SELECT unnest(final_tags) AS tag FROM audit) SELECT coalesce(dim, 'unknown') AS dimension, count(*) AS uses FROM t LEFT JOIN last_dim USING (tag) GROUP BY 1")
def q_coverage_dim(spark, sf):
    """A4: per dimension."""
    return A.coverage_by_dimension(audit(spark, sf))


@query("category_consistency", BASE + f" SELECT {KIND} AS category, count(*) AS product_count, round(avg(len(final_tags)), 6) AS avg_tags FROM audit GROUP BY 1 HAVING count(*) >= 2")
def q_consistency(spark, sf):
    """A5."""
    return A.consistency(audit(spark, sf)).select("category", "product_count", *r6("avg_tags"))


@query("common_tags", BASE + f""", t AS (SELECT {KIND} AS category, handle, unnest(list_concat(final_tags, ['all'])) AS tag FROM audit), n AS (SELECT {KIND} AS category, count(*) AS n FROM audit GROUP BY 1 HAVING count(*) >= 2)
SELECT t.category, tag FROM t JOIN n USING (category) GROUP BY t.category, tag, n HAVING count(DISTINCT handle) = n""")
def q_common(spark, sf):
    """A5: tags every product of a category has (one is added so there is one)."""
    return A.common_tags(audit(spark, sf).withColumn("final_tags", F.concat("final_tags", F.array(F.lit("all")))))


@query("dimension_coverage", BASE + f""", {LAST}, t AS (SELECT DISTINCT handle, {KIND} AS category, CASE WHEN l.dim IS NOT NULL THEN l.dim WHEN regexp_matches(x.tag, '^\\d+mg$') AND effective_type = 'CBD' THEN 'cbd_strength' ELSE 'unknown' END AS dimension
 FROM (SELECT handle, effective_type, unnest(final_tags) AS tag FROM audit) x LEFT JOIN last_dim l ON l.tag = x.tag) SELECT category, dimension, count(*) AS products FROM t GROUP BY ALL""")
def q_dim_coverage(spark, sf):
    """A5: products per dimension."""
    return A.dimension_coverage(audit(spark, sf))


@query("tag_count_outliers", BASE + f", s AS (SELECT handle, {KIND} AS category, len(final_tags) AS tag_count FROM audit), a AS (SELECT category, avg(tag_count) AS m FROM s GROUP BY 1 HAVING count(*) >= 2) SELECT category, handle, tag_count FROM s JOIN a USING (category) WHERE abs(tag_count - m) > 2")
def q_outliers(spark, sf):
    """A5: outliers."""
    return A.outliers(audit(spark, sf))


FLAGS = BASE + f", f AS (SELECT *, {KIND} AS category, list_has_any(ai_tags, final_tags) AS a, list_has_any(rule_tags, final_tags) AS r FROM audit)"


@query("contribution", FLAGS + """ SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS total, count(*) FILTER (len(ai_tags) > 0) AS with_ai, count(*) FILTER (len(rule_tags) > 0) AS with_rule,
 count(*) FILTER (len(ai_tags) > 0 AND len(rule_tags) > 0) AS with_both, count(*) FILTER (len(ai_tags) = 0 AND len(rule_tags) = 0) AS with_neither, count(*) FILTER (a AND r) AS both, count(*) FILTER (a AND NOT r) AS ai_only, count(*) FILTER (NOT a AND r) AS rule_only,
 coalesce(sum(len(final_tags)) FILTER (a AND r), 0)::BIGINT AS tags_both, coalesce(sum(len(final_tags)) FILTER (a AND NOT r), 0)::BIGINT AS tags_ai_only, coalesce(sum(len(final_tags)) FILTER (NOT a AND r), 0)::BIGINT AS tags_rule_only, coalesce(sum(len(final_tags)) FILTER (NOT a AND NOT r), 0)::BIGINT AS tags_neither FROM f GROUP BY ROLLUP (category)""")
def q_contribution(spark, sf):
    """A6."""
    return A.contribution(audit(spark, sf))


@query("agreement", FLAGS + " SELECT CASE WHEN a AND r THEN 'agree' WHEN a THEN 'ai_only' WHEN r THEN 'rule_only' ELSE 'disagree' END AS agreement, count(*) AS products FROM f GROUP BY 1")
def q_agreement(spark, sf):
    """A7."""
    return A.agreement(audit(spark, sf))


@query("model_accuracy", FLAGS + " SELECT category, sum(len(list_intersect(ai_tags, final_tags)))::BIGINT AS correct, sum(len(ai_tags))::BIGINT AS total, round(coalesce(sum(len(list_intersect(ai_tags, final_tags))) / nullif(sum(len(ai_tags)), 0), 0), 6) AS accuracy FROM f GROUP BY category")
def q_accuracy(spark, sf):
    """A8."""
    return A.model_accuracy(audit(spark, sf)).select("category", "correct", "total", *r6("accuracy"))


@query("recommendations", FLAGS + """, m AS (SELECT count(*) AS n, count(*) FILTER (len(ai_tags) > 0) AS w, count(*) FILTER (a AND r) AS g FROM f)
SELECT CASE WHEN w * 100.0 / n < 30 THEN printf('Increase AI tagging coverage (currently %.1f%% of products contain AI tags)', w * 100.0 / n) ELSE 'AI tagging coverage is strong—focus on accuracy next' END AS recommendation FROM m WHERE w * 100.0 / n < 30 OR w * 100.0 / n > 85
UNION ALL SELECT CASE WHEN g * 100.0 / n < 60 THEN printf('Review AI-rule disagreement patterns (agreement only %.1f%%)', g * 100.0 / n) ELSE 'AI and rule-based tagging generally agree' END FROM m""")
def q_recommend(spark, sf):
    """A9."""
    return A.recommendations(audit(spark, sf))


@query("validator_recommendations", BASE + ", " + vocabulary_cte() + f""", {LAST}, t AS (SELECT handle, effective_type, unnest(final_tags) AS tag FROM audit),
bad AS (SELECT count(*) AS n FROM t WHERE tag NOT IN (SELECT tag FROM dim_tag UNION SELECT tag FROM dim_category) AND NOT (regexp_matches(tag, '^\\d+mg$') AND coalesce(effective_type, '') = 'CBD' AND CAST(CASE WHEN regexp_matches(tag, '^\\d+mg$') THEN replace(tag, 'mg', '') END AS DOUBLE) <= 50000)),
dims AS (SELECT count(DISTINCT coalesce(dim, 'unknown')) AS n FROM t LEFT JOIN last_dim USING (tag)),
s AS (SELECT {KIND} AS category, len(final_tags) AS tag_count FROM audit), a AS (SELECT category, avg(tag_count) AS m FROM s GROUP BY 1 HAVING count(*) >= 2), o AS (SELECT count(DISTINCT category) AS n FROM s JOIN a USING (category) WHERE abs(tag_count - m) > 2),
g AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(handle), '-\\d+(ml|mg|pcs?|pack).*', ''), '\\d+(ml|mg|pcs?|pack).*', ''), '[-_\\s]+', ' ', 'g')) AS grp, effective_type, final_tags FROM audit),
h AS (SELECT (count(DISTINCT coalesce(effective_type, '')) > 1)::INT + (count(DISTINCT list_sort(final_tags)) > 1)::INT AS n FROM g GROUP BY grp HAVING count(*) >= 2), i AS (SELECT sum(n)::BIGINT AS n FROM h), u AS (SELECT count(*) AS n FROM audit WHERE len(final_tags) = 0)
SELECT 'Review and fix non-approved tags' AS recommendation FROM bad WHERE n > 0 UNION ALL SELECT 'Investigate ' || n || ' untagged products' FROM u WHERE n > 0 UNION ALL SELECT 'Consider expanding tag category coverage' FROM dims WHERE n < 5
UNION ALL SELECT 'Review ' || n || ' categories with tagging outliers' FROM o WHERE n > 0 UNION ALL SELECT 'Address ' || n || ' similar product consistency issues' FROM i WHERE n > 0""")
def q_validator(spark, sf):
    """The validator's advice."""
    return A.validator_recommendations(audit(spark, sf))


@query("audit_run_accuracy", BASE + f""", t AS (SELECT {KIND} AS category, ai_confidence, CASE WHEN len(final_tags) = 0 THEN 'untagged' WHEN needs_manual_review THEN 'review' ELSE 'clean' END AS tier FROM audit)
SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS total, count(*) FILTER (tier = 'clean') AS clean, round(coalesce(avg(ai_confidence) FILTER (ai_confidence > 0), 0), 6) AS avg_confidence FROM t GROUP BY ROLLUP (category)""")
def q_run_accuracy(spark, sf):
    """A10: average confidence over the rows that have one."""
    from tagloom.operators.route import tier
    rows = audit(spark, sf).select(A.kind().alias("category"), "ai_confidence", tier(F.col("final_tags"), F.col("needs_manual_review")).alias("tier"))
    return A.run_accuracy(rows).select("category", "total", "clean", *r6("avg_confidence"))


@query("store_stats", BASE + """ SELECT count(*) AS total, count(*) FILTER (human_verified) AS verified, count(*) FILTER (NOT human_verified) AS unverified, count(human_corrected_tags) AS corrected_tags, count(human_corrected_category) AS corrected_categories,
 round(avg(ai_confidence), 3) AS avg_confidence, count(*) FILTER (ai_review_decision = 'approve') AS ai_approved, count(*) FILTER (ai_review_decision = 'flag') AS ai_flagged, count(*) FILTER (ai_review_decision IS NULL AND NOT human_verified) AS pending_ai_review FROM audit""")
def q_stats(spark, sf):
    """A13."""
    return A.store_stats(audit(spark, sf))


SIMILAR = BASE + r""", g AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(handle), '[-_]', ' ', 'g'), '\d+(ml|mg|pcs?|pack).*', ''), '\s+', ' ', 'g')) AS grp, effective_type, final_tags FROM audit),
s AS (SELECT grp, count(*) AS products, count(DISTINCT coalesce(effective_type, '')) AS categories, count(DISTINCT list_sort(final_tags)) AS tag_sets FROM g GROUP BY grp HAVING count(*) >= 2),
u AS (SELECT grp, tag, count(*) AS n FROM (SELECT grp, unnest(final_tags) AS tag FROM g) GROUP BY ALL),
h AS (SELECT s.*, (SELECT count(*) FROM u WHERE u.grp = s.grp AND u.n = s.products) AS shared_tags, (SELECT count(*) FROM u WHERE u.grp = s.grp) AS all_tags FROM s)"""


@query("similar_groups", SIMILAR + " SELECT * FROM h")
def q_similar(spark, sf):
    """Group sizes and overlaps."""
    return A.similar_groups(audit(spark, sf))


@query("similar_group_issues", SIMILAR + " SELECT grp, products, 'Different categories for similar products' AS issue FROM h WHERE categories > 1 UNION ALL SELECT grp, products, 'Inconsistent tagging for similar products' FROM h WHERE tag_sets > 1 AND shared_tags / all_tags < 0.5")
def q_similar_issues(spark, sf):
    """A22."""
    return A.similar_group_issues(audit(spark, sf))


@query("similar_group_strict", BASE + r""", g AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(handle), '-\d+(ml|mg|pcs?|pack).*', ''), '\d+(ml|mg|pcs?|pack).*', ''), '[-_\s]+', ' ', 'g')) AS grp, effective_type, final_tags FROM audit),
s AS (SELECT grp, count(*) AS products, count(DISTINCT coalesce(effective_type, '')) AS c, count(DISTINCT list_sort(final_tags)) AS t FROM g GROUP BY grp HAVING count(*) >= 2)
SELECT grp, products, 'Inconsistent categories' AS issue FROM s WHERE c > 1 UNION ALL SELECT grp, products, 'Inconsistent tagging' FROM s WHERE t > 1""")
def q_strict(spark, sf):
    """A23."""
    return A.similar_group_strict(audit(spark, sf))


@query("model_usage", BASE + " SELECT model_used, count(*) AS n FROM audit GROUP BY 1")
def q_models(spark, sf):
    """A25."""
    return A.value_counts(audit(spark, sf), F.col("model_used"), "model_used")


@query("adherence_issues", BASE + ", " + vocabulary_cte() + r""", t AS (SELECT handle, effective_type, unnest(final_tags) AS tag FROM audit)
SELECT handle, tag AS invalid_tag FROM t WHERE tag NOT IN (SELECT tag FROM dim_tag UNION SELECT tag FROM dim_category) AND NOT (regexp_matches(tag, '^\d+mg$') AND coalesce(effective_type, '') = 'CBD' AND CAST(CASE WHEN regexp_matches(tag, '^\d+mg$') THEN replace(tag, 'mg', '') END AS DOUBLE) <= 50000)""")
def q_adherence(spark, sf):
    """A30."""
    return A.adherence(audit(spark, sf)).select("handle", "invalid_tag")


EXPECTED = BASE + f""", e AS (SELECT handle, coalesce(effective_type, '') AS category, lower(handle) AS h, lower(title) AS t, final_tags FROM audit),
gaps AS (SELECT handle, category, 'Missing nicotine strength tag' AS issue, 'nicotine_strength category tag' AS expected FROM e WHERE category = 'e-liquid' AND len(list_filter(final_tags, lambda x: contains(x, 'mg') AND NOT ends_with(x, 'ml'))) = 0 AND (contains(h, 'nic') OR contains(h, 'salt') OR contains(h, 'mg'))
UNION ALL SELECT handle, category, 'Missing VG/PG ratio tag', 'vg_ratio category tag' FROM e WHERE category = 'e-liquid' AND len(list_filter(final_tags, lambda x: contains(x, '/') AND regexp_matches(x, '^[0-9]'))) = 0 AND NOT contains(h, 'various') AND NOT contains(t, 'various') AND regexp_matches(h, '\\d+vg|\\d+pg')
UNION ALL SELECT handle, category, 'Missing CBD strength tag', 'cbd_strength category tag' FROM e WHERE category = 'CBD' AND len(list_filter(final_tags, lambda x: ends_with(x, 'mg'))) = 0 AND (contains(h, 'mg') OR contains(h, 'cbd') OR contains(h, 'cbg'))
UNION ALL SELECT handle, category, 'Missing CBD form tag', 'cbd_form category tag' FROM e WHERE category = 'CBD' AND len(list_filter(final_tags, lambda x: {in_list('x', A.CBD_FORMS_CHECKED)})) = 0
UNION ALL SELECT handle, category, 'Missing capacity tag', 'capacity category tag' FROM e WHERE category = 'pod' AND len(list_filter(final_tags, lambda x: ends_with(x, 'ml'))) = 0 AND (contains(h, 'ml') OR contains(h, 'pod')))"""


@query("expected_tag_issues", EXPECTED + " SELECT * FROM gaps")
def q_expected(spark, sf):
    """A31."""
    return A.expected_tag_issues(audit(spark, sf))


def _short(sql: str) -> str:
    """The same gaps in the short form: five forms, and no ratio asked of devices."""
    devices = "".join(f" AND NOT contains({c}, {quote(w)})" for w in A.DEVICE_WORDS for c in ("h", "t"))
    return sql.replace(in_list("x", A.CBD_FORMS_CHECKED), in_list("x", A.CBD_FORMS_SHORT)).replace(
        "AND NOT contains(h, 'various')", "AND NOT contains(h, 'various')" + devices)


@query("expected_tag_issues_short", _short(EXPECTED.replace("lower(title) AS t", "lower(title || CASE WHEN ord % 3 = 0 THEN ' Pod Kit' ELSE '' END) AS t")) + " SELECT * FROM gaps")
def q_expected_short(spark, sf):
    """The short form; every third title names a device."""
    rows = audit(spark, sf).withColumn("title", F.concat("title", F.when(F.col("ord") % 3 == 0, " Pod Kit").otherwise("")))
    return A.expected_tag_issues(rows, short=True)


@query("category_tag_rate", BASE + f""", b AS (SELECT coalesce(effective_type, list_filter(final_tags, lambda t: {in_list('t', VOCAB.categories)})[1]) AS category, len(final_tags) AS n FROM audit WHERE handle <> '' AND title <> '')
SELECT count(*) AS total, count(category) AS tagged, count(*) - count(category) AS untagged, count(*) FILTER (category IS NOT NULL AND n <= 2) AS partial, round(count(category) / count(*) * 100, 6) AS tag_rate FROM b""")
def q_category_rate(spark, sf):
    """Shares of a run whose rows are stored."""
    rows = audit(spark, sf).select("handle", "title", F.col("effective_type").alias("forced_category"), F.col("final_tags").alias("rule_tags"))
    return A.tag_rate(rows, list(VOCAB.categories)).withColumn("tag_rate", F.round("tag_rate", 6))


@query("issues_on_products", EXPECTED + """, l AS (SELECT handle, string_agg(issue, '; ' ORDER BY issue, expected) AS error_type FROM gaps GROUP BY handle)
SELECT a.handle, coalesce(error_type, '') AS error_type FROM audit a LEFT JOIN l USING (handle)""")
def q_issues(spark, sf):
    """J16 and S18 (group texts are never handles here, as handles carry sizes)."""
    return A.issues_on_products(audit(spark, sf)).select("handle", "error_type")


@query("review_session", BASE + """, d AS (SELECT CASE WHEN ai_review_decision IS NULL THEN NULL WHEN ai_review_decision = 'approve' AND ai_review_confidence >= 0.85 THEN 'approve' ELSE 'flag' END AS decision FROM audit)
SELECT count(*) AS reviewed, count(*) FILTER (decision = 'approve') AS approved, count(*) FILTER (decision = 'flag') AS flagged, count(*) FILTER (decision IS NULL) AS errors FROM d""")
def q_session(spark, sf):
    """A37."""
    from tagloom.operators.review import review_decision
    return A.review_session(audit(spark, sf).select(review_decision(F.col("ai_review_decision"), F.col("ai_review_confidence")).alias("decision")))
