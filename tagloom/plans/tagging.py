"""Queries of the word-boundary profile."""
from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import extract as X
from tagloom.functions.text import keyword_match
from tagloom.operators import audit, module_tagger as M, review, route
from tagloom.operators.validate import validate_all
from tagloom.plans.registry import query
from tagloom.plans.sqltext import extract, has_any, has_word, in_list, joined, number_text, quote, tag_list
from tagloom.plans.views import cte, view
from tagloom.rules.vocabulary import (ACCESSORY_OVERRIDES, CATEGORY_ORDER, ZERO_NICOTINE_PHRASES, KeywordRules,
                                      Vocabulary, flavour_words, items)

RULES, VOCAB = KeywordRules.default(), Vocabulary()
TD = "lower(title || ' ' || description)"
TDH = "lower(title || ' ' || description || ' ' || handle)"


def flat(*cols):
    return [F.coalesce(F.array_join(F.array_sort(F.col(c)), "|"), F.lit("")).alias(c) for c in cols]


# --- pieces of SQL ---------------------------------------------------------

def _detected() -> str:
    words = [(c, has_word("tdh", ws)) for c, ws in RULES.words["category"].items()]
    head = [("accessory", has_any("tdh", items(ACCESSORY_OVERRIDES))),
            ("e-liquid", "contains(lower(product_category), 'e-liquid')"),
            ("CBD", "contains(lower(product_category), 'cbd supplement') OR lower(type) = 'cbd products'")]
    return tag_list(head + words)


def _primary() -> str:
    whens = "".join(f" WHEN list_contains(found, {quote(c)}) THEN {quote(c)}" for c in ["CBD"] + items(CATEGORY_ORDER))
    return f"CASE{whens} ELSE '' END"


def _nicotine(text: str, category: str) -> str:
    tries = ", ".join(f"CASE WHEN {extract(text, p)} <= 20 THEN {extract(text, p)} END" for p in X.NICOTINE_PATTERNS)
    return (f"CASE WHEN {category} = 'CBD' THEN 0 WHEN {has_any(text, items(ZERO_NICOTINE_PHRASES))} THEN 0 "
            f"ELSE coalesce({tries}) END")


def _cbd(text: str) -> str:
    value = "coalesce(" + ", ".join(extract(text, p) for p in X.CBD_PATTERNS) + ")"
    return f"CASE WHEN {value} <= 50000 THEN {value} END"


def _ratio(text: str, patterns=X.RATIO_PATTERNS, single: bool = True) -> str:
    def pair(p):
        a, b = extract(text, p, 1), extract(text, p, 2)
        return (f"CASE WHEN {a} + {b} = 100 THEN CAST(CAST(greatest({a}, {b}) AS BIGINT) AS VARCHAR) || '/' || "
                f"CAST(CAST(least({a}, {b}) AS BIGINT) AS VARCHAR) END")
    vg, pg = extract(text, r"\b(\d+)\s*vg\b"), extract(text, r"\b(\d+)\s*pg\b")
    as_text = "CAST(CAST({0} AS BIGINT) AS VARCHAR)"
    parts = [f"CASE WHEN regexp_matches({text}, '\\b100\\s*vg\\b') THEN '100/0' WHEN regexp_matches({text}, '\\b100\\s*pg\\b') THEN '0/100' END"]
    parts += [pair(p) for p in patterns]
    if single:
        parts.append(f"CASE WHEN {vg} > 0 AND {vg} <= 100 THEN {as_text.format(vg)} || '/' || {as_text.format(f'(100 - {vg})')} END")
        parts.append(f"CASE WHEN {pg} > 0 AND {pg} <= 100 THEN {as_text.format(f'(100 - {pg})')} || '/' || {as_text.format(pg)} END")
    return "coalesce(" + ", ".join(parts) + ")"


def _capacity(text: str) -> str:
    return tag_list([(s, f"regexp_matches({text}, {quote('(^|[^0-9])' + s.replace('.', chr(92) + '.') + '($|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')})")
                     for s in VOCAB.dims["capacity"].tags])


def _dim(name: str, text: str = "td") -> str:
    return tag_list([(t, has_word(text, ws)) for t, ws in RULES.words[name].items()])


def _strength(value: str, top: int) -> str:
    return f"CASE WHEN {value} >= 0 AND {value} <= {top} THEN {number_text(value)} || 'mg' END"


def classified(extra: str = "") -> str:
    """CTEs up to ``classified``: texts, detected categories, category."""
    return (cte("products") + f", texts AS (SELECT *, {TD} AS td, {TDH} AS tdh FROM products), "
            f"detected AS (SELECT *, list_distinct({_detected()}) AS found FROM texts), "
            f"classified AS (SELECT *, {_primary()} AS category FROM detected){extra}")


def tagged() -> str:
    """CTEs up to ``tagged``: rule tags and secondary flavours."""
    device, nicotine = "category IN ('device', 'pod_system')", in_list("category", VOCAB.applies("nicotine_strength"))
    flavoured = in_list("category", VOCAB.applies("flavour_type"))
    blocked = f"({has_any('td', ['cbd', 'cbg'])} AND NOT {has_any('td', M.DEVICE_EVIDENCE)})"
    empty = "CAST([] AS VARCHAR[])"

    def only(cond, tags):
        return f"CASE WHEN {cond} THEN {tags} ELSE {empty} END"

    def one(tag):
        return f"list_filter([{tag}], lambda t: t IS NOT NULL)"

    parts = [
        only(f"{device} AND NOT {blocked}", _dim("device_style")), only(device, _dim("power_supply")),
        only(device + " OR category = 'e-liquid'", _dim("vaping_style")),
        only("category IN ('tank', 'pod')", _capacity("td")), only("category = 'pod'", _dim("pod_type")),
        only("category IN ('coil', 'device', 'pod_system')", _dim("coil_ohm")),
        only("category = 'e-liquid'", _dim("bottle_size")), only("category = 'e-liquid'", one(_ratio("td"))),
        only(flavoured, _dim("flavour_type")), only(nicotine, one(_strength("nic", 20))),
        only(nicotine, _dim("nicotine_type")), only("category = 'CBD'", one(_strength("cbd_v", 50000))),
        only("category = 'CBD'", _dim("cbd_form")), only("category = 'CBD'", _dim("cbd_type"))]
    specific = tag_list(list({w: has_word("td", [w]) for _, more in flavour_words().values() for w in more}.items()))
    return classified(
        f", valued AS (SELECT *, {_nicotine('td', 'category')} AS nic, {_cbd('td')} AS cbd_v FROM classified)"
        f", tagged AS (SELECT *, list_sort(list_distinct(flatten([{', '.join(parts)}]))) AS rule_tags, "
        f"{only(flavoured, specific)} AS secondary FROM valued)")


def ruled(spark, sf):
    return M.tag_by_rules(view(spark, sf, "products"))


# --- queries ---------------------------------------------------------------

@query("tagging_by_category_and_tier", tagged() + """
SELECT CASE WHEN category = '' THEN 'none' ELSE category END AS category,
       CASE WHEN len(rule_tags) = 0 THEN 'untagged' WHEN category = '' THEN 'review' ELSE 'clean' END AS tier,
       count(*) AS products FROM tagged GROUP BY ALL""")
def tagging_by_category_and_tier(spark, sf):
    """Flagship: classify, tag, route, count."""
    rows = ruled(spark, sf)
    return rows.groupBy(
        F.when(F.col("category") == "", "none").otherwise(F.col("category")).alias("category"),
        route.tier(F.col("rule_tags"), F.col("needs_manual_review")).alias("tier")).agg(F.count("*").alias("products"))


@query("keyword_match", cte("products") + f"""
SELECT handle, {has_word(TD, ['nicotine pouch', 'box', 'ice'])} AS matched FROM products""")
def q_keyword_match(spark, sf):
    """whole words and their plurals."""
    return view(spark, sf, "products").select(
        "handle", keyword_match(F.concat_ws(" ", "title", "description"), ["nicotine pouch", "box", "ice"]).alias("matched"))


@query("nicotine_strength", cte("products") + f"""
SELECT handle, {_nicotine(TD, "''")} AS mg, {_strength(_nicotine(TD, "''"), 20)} AS tag FROM products""")
def q_nicotine(spark, sf):
    """F2 and F7."""
    df = view(spark, sf, "products").select("handle", X.nicotine_mg(M.product_text("title", "description"), F.lit("")).alias("mg"))
    return df.select("handle", "mg", X.nicotine_tag(F.col("mg")).alias("tag"))


@query("cbd_strength", cte("products") + f"SELECT handle, {_cbd(TD)} AS mg, {_strength(_cbd(TD), 50000)} AS tag FROM products")
def q_cbd(spark, sf):
    """F3 and F7."""
    df = view(spark, sf, "products").select("handle", X.cbd_mg(M.product_text("title", "description")).alias("mg"))
    return df.select("handle", "mg", X.cbd_tag(F.col("mg")).alias("tag"))


@query("vg_ratio", cte("products") + f"SELECT handle, {_ratio(TD)} AS ratio FROM products")
def q_ratio(spark, sf):
    """F4."""
    return view(spark, sf, "products").select("handle", X.vg_ratio(M.product_text("title", "description")).alias("ratio"))


@query("variant_vg_ratio", cte("variants") + f"""
, r AS (SELECT ord, {_ratio('lower(option1_value)', X.VARIANT_RATIO_PATTERNS, False)} AS ratio FROM variants)
SELECT ord, ratio, CASE WHEN CAST(split_part(ratio, '/', 1) AS INT) >= 70 THEN 'direct-to-lung'
       WHEN CAST(split_part(ratio, '/', 1) AS INT) <= 50 THEN 'mouth-to-lung' END AS style FROM r""")
def q_variant_ratio(spark, sf):
    """F6 and F18 (export rule)."""
    df = view(spark, sf, "variants").select("ord", X.variant_vg_ratio(F.col("option1_value")).alias("ratio"))
    return df.select("ord", "ratio", X.export_vaping_style(F.col("ratio")).alias("style"))


@query("capacity_tags", cte("products") + f"SELECT handle, {joined(_capacity(TD))} AS tags FROM products")
def q_capacity(spark, sf):
    """F8."""
    return view(spark, sf, "products").select(
        "handle", X.capacity_tags(M.product_text("title", "description")).alias("tags")).select("handle", *flat("tags"))


def _dimension_query(dim: str, label: str):
    scope = ["e-liquid"] if dim == "bottle_size" else list(VOCAB.applies(dim))
    sql = classified() + (f" SELECT handle, CASE WHEN category = '' OR {in_list('category', scope)} THEN "
                          f"{joined(_dim(dim))} ELSE '' END AS tags FROM (SELECT handle, category, td FROM classified)")

    @query(f"dimension_{dim}", sql)
    def run(spark, sf):
        df = M.classify(view(spark, sf, "products"), RULES)
        return df.select("handle", M.dimension_tags(df, dim, RULES).alias("tags")).select("handle", *flat("tags"))
    run.__doc__ = label


for _d in ("device_style", "nicotine_type", "bottle_size", "cbd_form", "cbd_type", "power_supply", "pod_type",
           "vaping_style", "coil_ohm", "flavour_type"):
    _dimension_query(_d, f"F9–F12, P3: {_d} behind its category gate.")


@query("detected_categories", classified() + " SELECT handle, category, array_to_string(list_sort(found), '|') AS detected_categories FROM classified")
def q_categories(spark, sf):
    """F13 and W13."""
    return M.classify(view(spark, sf, "products")).select("handle", "category", *flat("detected_categories"))


@query("category_gate", classified() + f"""
 SELECT handle, category = '' AS needs_manual_review,
        CASE WHEN category = '' THEN {quote(M.GATE_REASON)} ELSE '' END AS failure_reasons FROM classified""")
def q_gate(spark, sf):
    """P2."""
    return ruled(spark, sf).select("handle", "needs_manual_review", *flat("failure_reasons"))


@query("device_evidence_gate", cte("products") + f"""
SELECT handle, {has_any(TD, M.DEVICE_EVIDENCE)} AS evidence, {has_any(TD, ['cbd', 'cbg'])} AND NOT {has_any(TD, M.DEVICE_EVIDENCE)} AS blocked FROM products""")
def q_evidence(spark, sf):
    """P13."""
    from tagloom.functions.text import contains_any
    text = M.product_text("title", "description")
    return view(spark, sf, "products").select(
        "handle", M.device_evidence(text).alias("evidence"),
        (contains_any(text, ["cbd", "cbg"]) & ~M.device_evidence(text)).alias("blocked"))


@query("rule_tags", tagged() + " SELECT handle, category, array_to_string(rule_tags, '|') AS rule_tags, array_to_string(list_sort(secondary), '|') AS secondary_flavours FROM tagged")
def q_rule_tags(spark, sf):
    """all dimensions of a product."""
    return ruled(spark, sf).select("handle", "category", *flat("rule_tags", "secondary_flavours"))


@query("variant_flavours", cte("variants") + " SELECT ord, " + joined(tag_list(
    [(f, has_any("lower(option1_value)", own + more)) for f, (own, more) in flavour_words().items()])) + " AS flavours FROM variants")
def q_variant_flavours(spark, sf):
    """F12v."""
    return view(spark, sf, "variants").select("ord", M.variant_flavours(F.col("option1_value")).alias("flavours")) \
        .select("ord", *flat("flavours"))


@query("collections", tagged() + """
, used AS (SELECT DISTINCT unnest(rule_tags) AS t FROM tagged)
SELECT t || ' Flavors' AS title, t AS filter_tags FROM used WHERE """ + in_list("t", VOCAB.dims["flavour_type"].tags) + """
UNION ALL SELECT * FROM (VALUES ('Zero Nicotine Devices', '0mg|Zero Nicotine'), ('High Strength Nicotine', 'High Strength|Strong'),
 ('Disposable Vapes', 'Disposable'), ('Beginner Vape Kits', 'AIO|Compact|Pod System')) v(title, filter_tags)""")
def q_collections(spark, sf):
    """A36."""
    return audit.collections(ruled(spark, sf)).select("title", *flat("filter_tags"))


@query("tagging_run_accuracy", tagged() + """
, tiers AS (SELECT CASE WHEN category = '' THEN 'none' ELSE category END AS category, CASE WHEN len(rule_tags) = 0 THEN 'untagged' WHEN category = '' THEN 'review' ELSE 'clean' END AS tier FROM tagged)
SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS total,
  count(*) FILTER (tier = 'clean') AS clean, count(*) FILTER (tier = 'review') AS review, count(*) FILTER (tier = 'untagged') AS untagged,
  round(count(*) FILTER (tier = 'clean') / count(*), 6) AS clean_rate, round(count(*) FILTER (tier <> 'untagged') / count(*), 6) AS tagging_rate
FROM tiers GROUP BY ROLLUP (category)""")
def q_run_accuracy(spark, sf):
    """A10: both grains in one rollup."""
    rows = ruled(spark, sf).select(
        F.when(F.col("category") == "", "none").otherwise(F.col("category")).alias("category"),
        route.tier(F.col("rule_tags"), F.col("needs_manual_review")).alias("tier"), F.lit(0.0).alias("ai_confidence"))
    return audit.run_accuracy(rows).select("category", "total", "clean", "review", "untagged",
                                           F.round("clean_rate", 6).alias("clean_rate"), F.round("tagging_rate", 6).alias("tagging_rate"))


@query("tier_matrix", tagged() + """
SELECT category, count(*) FILTER (len(rule_tags) > 0 AND category <> '') AS clean, count(*) FILTER (len(rule_tags) > 0 AND category = '') AS review,
       count(*) FILTER (len(rule_tags) = 0) AS untagged FROM tagged GROUP BY category""")
def q_tier_matrix(spark, sf):
    """A10: tiers as columns."""
    return audit.tier_matrix(ruled(spark, sf).select(
        "category", route.tier(F.col("rule_tags"), F.col("needs_manual_review")).alias("tier")))


@query("full_tagging")
def q_full(spark, sf):
    """Rules, model answers, validation and recovery in one plan."""
    rules = ruled(spark, sf)
    answers = review.cascade(view(spark, sf, "responses")).withColumn(
        "handle", F.concat(F.lit("p-"), F.regexp_extract("handle", r"c(\d+)-0", 1)))
    full = review.combine(rules, answers)
    return full.select("handle", "category", "needs_manual_review", "model_used",
                       F.round("ai_confidence", 6).alias("ai_confidence"), *flat("tags", "failure_reasons"))


def validated(tags: str, category: str):
    return validate_all(F.col(tags), F.col(category))
