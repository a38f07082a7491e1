"""Queries of the controlled profile."""
from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import extract as X
from tagloom.functions.text import normalise_tag
from tagloom.operators import audit, controlled as C
from tagloom.plans.registry import query
from tagloom.plans.sqltext import has_any, in_list, joined, quote, tag_list, vocabulary_cte
from tagloom.plans.tagging import flat
from tagloom.plans.views import cte, view
from tagloom.rules.vocabulary import Vocabulary, items

VOCAB = Vocabulary()
HEAD = "lower(handle || ' ' || title)"
FULL = "lower(handle || ' ' || title || ' ' || description)"
TEXTS = cte("products") + f", texts AS (SELECT *, {HEAD} AS head, {FULL} AS txt FROM products)"


def _texts(spark, sf):
    return view(spark, sf, "products").select(
        "handle", F.lower(F.concat_ws(" ", "handle", "title")).alias("head"),
        F.lower(F.concat_ws(" ", "handle", "title", "description")).alias("txt"))


def _word(text: str, word: str) -> str:
    return f"regexp_matches({text}, {quote(word)})" if word.startswith("\\b") else f"contains({text}, {quote(word)})"


def _table_case(text: str, table: str) -> str:
    whens = ""
    for line in table.strip().splitlines():
        words, tag = (p.strip() for p in line.split("|"))
        whens += f" WHEN {has_any(text, items(words))} THEN {quote(tag)}"
    return f"CASE{whens} END"


def _forced(part: str) -> str:
    whens = ""
    for rule in C.forced_rules():
        cond = " AND ".join(["(" + " OR ".join(_word("head", w) for w in rule.any_of) + ")"]
                            + [_word("head", w) for w in rule.all_of] + [f"NOT {_word('head', w)}" for w in rule.none_of])
        if part == "category":
            value = quote(rule.category)
        else:
            kinds = [f"CASE WHEN {_table_case('head', C.SUPPLEMENT_KIND)} IS NULL THEN '' ELSE '|' || {_table_case('head', C.SUPPLEMENT_KIND)} END"
                     for t in rule.tags if t.startswith("?")]
            value = " || ".join([quote("|".join(t for t in rule.tags if not t.startswith("?")))] + kinds)
        whens += f" WHEN {cond} THEN {value}"
    return f"CASE{whens} END"


@query("forced_category", TEXTS + f" SELECT handle, {_forced('category')} AS category, coalesce({_forced('tags')}, '') AS tags FROM texts")
def q_forced(spark, sf):
    """F14."""
    df = _texts(spark, sf).select("handle", C.forced_category(F.col("head")).alias("f"))
    return df.select("handle", F.col("f.category").alias("category"), F.coalesce(F.array_join("f.tags", "|"), F.lit("")).alias("tags"))


@query("controlled_cbd", TEXTS + f""" SELECT handle, coalesce({_table_case('head', C.CBD_FORM_IN_TITLE)}, {_table_case('txt', C.CBD_FORM_IN_TEXT)}) AS form,
 CASE WHEN {has_any('txt', ['full spectrum', 'full-spectrum', 'fullspectrum'])} THEN 'full_spectrum' WHEN {has_any('txt', ['broad spectrum', 'broad-spectrum', 'broadspectrum'])} THEN 'broad_spectrum'
 WHEN {has_any('txt', ['isolate', 'pure cbd'])} THEN 'isolate' WHEN contains(txt, 'cbg') AND NOT contains(txt, 'cbd') THEN 'cbg' WHEN contains(txt, 'cbda') THEN 'cbda' END AS spectrum FROM texts""")
def q_cbd(spark, sf):
    """form and spectrum."""
    return _texts(spark, sf).select("handle", C.cbd_form(F.col("head"), F.col("txt")).alias("form"), C.cbd_spectrum(F.col("txt")).alias("spectrum"))


def _flavours() -> str:
    pairs = []
    for line in C.FLAVOURS.strip().splitlines():
        tag, words = (p.strip() for p in line.split("|"))
        cond = has_any("txt", items(words))
        if tag == "ice":
            cond += " OR (regexp_matches(txt, '\\bice\\b') AND NOT contains(txt, 'ice cream'))"
        pairs.append((tag, cond))
    return f"CASE WHEN {has_any('txt', C.FLAVOUR_CONTEXT)} THEN {joined(tag_list(pairs))} ELSE '' END"


@query("controlled_flavours", TEXTS + f" SELECT handle, {_flavours()} AS flavours FROM texts")
def q_flavours(spark, sf):
    """flavours."""
    return _texts(spark, sf).select("handle", C.flavours(F.col("txt")).alias("flavours")).select("handle", *flat("flavours"))


ZERO = f"(({has_any('txt', C.ZERO_NICOTINE)} OR regexp_matches(txt, '\\b0\\s*mg\\b')) AND NOT {has_any('txt', ['cbd', 'cbg'])})"


@query("controlled_strengths", TEXTS + f""" SELECT handle,
 CASE WHEN {ZERO} THEN '0mg' WHEN NOT {has_any('txt', ['cbd', 'cbg'])} THEN list_filter(regexp_extract_all(txt, '(\\d+(?:\\.\\d+)?)mg', 1), lambda m: CAST(m AS DOUBLE) BETWEEN 0 AND 20)[1] || 'mg' END AS nicotine,
 list_filter(regexp_extract_all(txt, '(\\d+)mg', 1), lambda m: TRY_CAST(m AS BIGINT) BETWEEN 0 AND 50000)[1] || 'mg' AS cbd,
 CASE WHEN regexp_extract(txt, '(\\d+)\\s*ml\\b', 1) || 'ml' IN ({', '.join(quote(s) for s in X.STANDARD_SIZES)}) THEN regexp_extract(txt, '(\\d+)\\s*ml\\b', 1) || 'ml' END AS bottle FROM texts""")
def q_strengths(spark, sf):
    """F15 and F9 (controlled): strengths and bottle size."""
    t = F.col("txt")
    return _texts(spark, sf).select("handle", C.nicotine_strength(t).alias("nicotine"), C.cbd_strength(t).alias("cbd"),
                                    X.controlled_bottle_size(t).alias("bottle"))


def _ratio() -> str:
    def approved(p):
        a, b = f"regexp_extract_all(txt, {quote(p)}, 1)", f"regexp_extract_all(txt, {quote(p)}, 2)"
        pairs = f"list_zip({a}, {b})"
        swapped = ("CASE WHEN TRY_CAST(p[1] AS BIGINT) + TRY_CAST(p[2] AS BIGINT) = 100 THEN CASE WHEN TRY_CAST(p[2] AS BIGINT) > TRY_CAST(p[1] AS BIGINT) "
                   "THEN p[2] || '/' || p[1] ELSE p[1] || '/' || p[2] END END")
        return f"list_filter(list_transform({pairs}, lambda p: {swapped}), lambda r: r IN ({', '.join(quote(t) for t in VOCAB.dims['vg_ratio'].tags)}))[1]"
    whens = "".join(f" WHEN regexp_matches(txt, {quote(p)}) THEN {approved(p)}" for p in X.CONTROLLED_RATIO_PATTERNS)
    whens += f" WHEN contains(txt, 'vg') AND contains(txt, 'pg') AND regexp_matches(txt, {quote(X.LOOSE_RATIO_PATTERN)}) THEN {approved(X.LOOSE_RATIO_PATTERN)}"
    whens += f" WHEN {has_any('txt', ['100% vg', 'pure vg', 'max vg'])} THEN '100/0' WHEN contains(txt, 'vg') AND NOT contains(txt, 'pg') THEN '100/0'"
    return f"CASE{whens} END"


@query("controlled_vg_ratio", TEXTS + f""", r AS (SELECT handle, {_ratio()} AS ratio FROM texts)
SELECT handle, ratio, CASE WHEN CAST(split_part(ratio, '/', 2) AS INT) >= 50 THEN 'mouth-to-lung'
 WHEN CAST(split_part(ratio, '/', 1) AS INT) BETWEEN 60 AND 70 THEN 'restricted-direct-to-lung' WHEN CAST(split_part(ratio, '/', 1) AS INT) >= 70 THEN 'direct-to-lung' END AS style FROM r""")
def q_ratio(spark, sf):
    """F5 and F18 (controlled rule)."""
    df = _texts(spark, sf).select("handle", X.controlled_vg_ratio(F.col("txt")).alias("ratio"))
    return df.select("handle", "ratio", X.controlled_vaping_style(F.col("ratio")).alias("style"))


@query("controlled_ohm", TEXTS + f""" SELECT handle, list_filter(list_transform(list_zip(regexp_extract_all(txt, '(\\d+)[-\\.]?(\\d*)\\s*[ωo]h?m?', 1), regexp_extract_all(txt, '(\\d+)[-\\.]?(\\d*)\\s*[ωo]h?m?', 2)),
 lambda m: CASE WHEN m[2] <> '' THEN m[1] || '.' || m[2] || 'ohm' ELSE m[1] || 'ohm' END), lambda t: {in_list('t', VOCAB.dims['coil_ohm'].tags)})[1] AS ohm FROM texts""")
def q_ohm(spark, sf):
    """F10 (controlled)."""
    return _texts(spark, sf).select("handle", X.controlled_ohm(F.col("txt")).alias("ohm"))


@query("normalised_tags", cte("variants") + r""" SELECT ord, regexp_replace(regexp_replace(trim(lower(option1_value)), '(\d+(?:\.\d+)?)\s*(mg|ml|ohm)', '\1\2', 'g'), '\s+', '_', 'g') AS tag FROM variants""")
def q_normalise(spark, sf):
    """F16."""
    return view(spark, sf, "variants").select("ord", normalise_tag(F.col("option1_value")).alias("tag"))


_LAST = ", ".join(f"({quote(t)}, {quote(d)})" for t, d in VOCAB.last_dim().items())
_SCOPES = ", ".join(f"({quote(d.name)}, {quote(c)})" for d in VOCAB.dims.values() for c in d.applies_to)


@query("one_tag_per_dimension", cte("audit") + f""", last_dim AS (SELECT * FROM (VALUES {_LAST}) t(tag, dim)), scopes AS (SELECT * FROM (VALUES {_SCOPES}) t(dim, cat)),
tags AS (SELECT handle, effective_type, unnest(list_distinct(list_concat(final_tags, ai_tags))) AS tag FROM audit),
placed AS (SELECT t.*, CASE WHEN l.dim IS NOT NULL THEN l.dim WHEN regexp_matches(t.tag, '^\\d+mg$') AND effective_type = 'CBD' THEN 'cbd_strength' END AS dim FROM tags t LEFT JOIN last_dim l USING (tag)),
kept AS (SELECT p.* FROM placed p LEFT JOIN scopes s ON s.dim = p.dim AND s.cat = p.effective_type WHERE (p.dim IS NULL OR s.dim IS NOT NULL) AND coalesce(p.dim, '') <> 'category'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY handle, dim ORDER BY length(tag) DESC, tag) AS rn FROM kept)
SELECT a.handle, coalesce(string_agg(r.tag, '|' ORDER BY r.tag), '') AS tags FROM audit a LEFT JOIN ranked r ON r.handle = a.handle AND rn = 1 GROUP BY a.handle""")
def q_one_per_dimension(spark, sf):
    """W2 (the category itself, which always leads, is left out here)."""
    tags = C.one_per_dimension(F.array_distinct(F.concat("final_tags", "ai_tags")), F.col("effective_type"))
    rest = F.when(F.col("effective_type").isNull(), tags).otherwise(F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0))))
    return view(spark, sf, "audit").select("handle", F.array_join(F.array_sort(rest), "|").alias("tags"))


@query("controlled_tagging")
def q_controlled(spark, sf):
    """The whole controlled profile."""
    return C.tag_controlled(view(spark, sf, "products")).select(
        "handle", "forced_category", "category", F.array_join("rule_tags", "|").alias("rule_tags"), F.array_join("final_tags", "|").alias("final_tags"))


@query("tagging_rate")
def q_rate(spark, sf):
    """A26."""
    return audit.tag_rate(C.controlled_rule_tags(view(spark, sf, "products").drop("type")), list(VOCAB.categories))


@query("flat_vocabulary", "WITH " + vocabulary_cte() + """, used AS (SELECT DISTINCT unnest(string_split(lower(p_type || ',ice,' || p_name), ',')) AS tag FROM part)
SELECT tag, tag IN (SELECT tag FROM dim_tag UNION SELECT tag FROM dim_category) AS known FROM used""")
def q_flat(spark, sf):
    """F56d: tags in use against the flattened vocabulary."""
    from tagloom.functions.text import words_literal
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.split(F.lower(F.concat(
        "p_type", F.lit(",ice,"), "p_name")), ",")).alias("tag")).distinct()
    return rows.select("tag", F.array_contains(words_literal(VOCAB.flat()), F.col("tag")).alias("known"))
