"""The given tables seen as catalogue inputs.

Each view is a list of (column, expression) pairs written in the SQL that Spark
and DuckDB share, so a query and its check read the same rows.  Columns ending
in ``_list`` hold comma-separated text; ``view`` turns them into arrays.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.functions.text import split_tags


def pick(words: str, index: str) -> str:
    """One of ``a|b|c`` by a number expression."""
    n = words.count("|") + 1
    return f"split_part('{words}', '|', CAST({index} % {n} + 1 AS INT))"


KINDS = ("CBD oil tincture full spectrum|nic salt e-liquid|disposable puff bar|pod system kit|replacement pod|"
         "box mod|sub ohm tank|mesh coil 0.5 ohm|drip tip|mushroom nootropic|nicotine pouches|widget|"
         "hemp gummies isolate|shortfill e-liquid|usb charging cable|terpene indica|atomizer 510")
FLAVOURS = "strawberry ice|blue razz|tobacco|vanilla custard|mango|cola|menthol|hazelnut|oat cereal|plain"
RATIOS = "70vg/30pg|50/50|max vg|80vg|vg/pg 60/40|30PG 70VG|40 pg"
BOTTLES = "10ml|50ml|2ml|2.5ml|100ml shortfill|5 ml"
EXTRAS = ("usb-c charging|compact mini pen style|mouth to lung|refillable|prefilled smooth|"
          "18650 removable battery|zero nicotine|dtl sub ohm|1.2ohm coil|square box style")

VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "products": ("part", [
        ("ord", "p_partkey"),
        ("handle", "'p-' || CAST(p_partkey AS STRING)"),
        ("title", f"p_name || ' ' || {pick(KINDS, 'p_partkey')} || ' ' || {pick(FLAVOURS, 'p_size')} || ' ' || CAST(p_size % 25 AS STRING) || 'mg'"),
        ("description", f"'For ' || lower(p_type) || ' use, ' || {pick(RATIOS, '(p_partkey + p_size)')} || ' in ' || {pick(BOTTLES, 'p_size')} || '. ' || {pick(EXTRAS, '(p_partkey + 3 * p_size)')}"),
        ("vendor", "p_brand"), ("type", "CASE WHEN p_partkey % 23 = 0 THEN 'CBD products' ELSE p_type END"),
        ("product_category", "CASE p_partkey % 19 WHEN 0 THEN 'Vaping > E-Liquid' WHEN 1 THEN 'Health > CBD Supplement' ELSE '' END"),
        ("price", "p_retailprice"),
        ("image", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'http://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg' END")]),
    "variants": ("lineitem", [
        ("ord", "(l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey"),
        ("handle", "'o-' || CAST(l_orderkey AS STRING)"),
        ("title", "'Order ' || CAST(l_orderkey AS STRING) || CASE WHEN l_linenumber % 5 = 0 THEN ' b' ELSE '' END"),
        ("vendor", "CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'vendor ' || CAST(l_suppkey % 40 AS STRING) END"),
        ("type", "l_returnflag"),
        ("option1_name", "CASE WHEN l_linenumber % 3 = 0 THEN 'Size' ELSE 'Flavour' END"),
        ("option1_value", "CASE l_partkey % 6 WHEN 0 THEN 'Strawberry Ice' WHEN 1 THEN '70VG/30PG' WHEN 2 THEN 'Default Title' WHEN 3 THEN '' WHEN 4 THEN 'Licorice 50/50' ELSE 'Blue' END"),
        ("variant_sku", "'S' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"),
        ("variant_price", "CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"),
        ("image", "CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'i' || CAST(l_partkey AS STRING) END"),
        ("tags", f"CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE {pick('Fruity, ice|ice|CBD, 10mg|tobacco , Ice|mystery, 70/30|cola', 'l_partkey')} END")]),
    "export_rows": ("lineitem", [
        ("ord", "(l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey"),
        ("handle", "'o-' || CAST(l_orderkey + l_partkey % 2 AS STRING)"),
        ("title", "'Order ' || CAST(l_orderkey + l_partkey % 2 AS STRING)"),
        ("vendor", "CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'vendor ' || CAST(l_suppkey % 40 AS STRING) END"),
        ("type", "l_returnflag"),
        ("variant_sku", "'S' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"),
        ("tags", f"CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE {pick('Fruity, ice|ice|CBD, 10mg|tobacco|70/30|cola', '(l_partkey + l_linenumber)')} END")]),
    "audit": ("orders", [
        ("ord", "o_orderkey"),
        ("handle", "'item-' || CAST(o_custkey % 300 AS STRING) || '-' || CAST(10 + 10 * (o_orderkey % 4) AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN 'ml-vg-' ELSE 'mg-nic-' END || CAST(o_orderkey AS STRING)"),
        ("title", "'Item ' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 13 = 0 THEN ' various' ELSE '' END"),
        ("description", "'Made for ' || o_orderpriority || ' order ' || CAST(o_orderkey AS STRING)"),
        ("effective_type", "CASE o_orderpriority WHEN '1-URGENT' THEN 'e-liquid' WHEN '2-HIGH' THEN 'CBD' WHEN '3-MEDIUM' THEN 'pod' WHEN '4-NOT SPECIFIED' THEN 'device' ELSE NULL END"),
        ("rule_tags_list", "concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'fruity' END, CASE WHEN o_orderkey % 3 = 0 THEN 'ice' END, CASE WHEN o_orderkey % 9 = 1 THEN '10ml' END)"),
        ("ai_tags_list", "concat_ws(',', CASE WHEN o_custkey % 3 = 0 THEN 'fruity' END, CASE WHEN o_custkey % 5 = 0 THEN 'oil' END, CASE WHEN o_custkey % 7 = 0 THEN 'made-up' END)"),
        ("final_tags_list", "concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'fruity' END, CASE WHEN o_orderkey % 3 = 0 THEN 'ice' END, CASE WHEN o_custkey % 4 = 0 THEN CAST(o_orderkey % 25 AS STRING) || 'mg' END, CASE WHEN o_orderkey % 9 = 1 THEN '10ml' END, CASE WHEN o_custkey % 5 = 0 THEN 'oil' END, CASE WHEN o_custkey % 11 = 0 THEN 'full_spectrum' END, CASE WHEN o_orderkey % 17 = 0 THEN '70/30' END, CASE WHEN o_orderkey % 19 = 0 THEN 'mystery' END, CASE WHEN o_orderkey % 23 = 0 THEN '60000mg' END)"),
        ("ai_confidence", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) / 100 END"),
        ("needs_manual_review", "o_custkey % 4 = 1"),
        ("human_verified", "o_orderkey % 6 = 0"),
        ("human_corrected_tags_list", "CASE WHEN o_orderkey % 12 = 0 THEN 'ice,tobacco' END"),
        ("human_corrected_category", "CASE WHEN o_orderkey % 24 = 0 THEN 'pod' END"),
        ("ai_review_decision", "CASE o_orderkey % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'flag' ELSE NULL END"),
        ("ai_review_confidence", "CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_custkey % 50 AS DOUBLE) / 50 END"),
        ("ai_prompt", "CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'Tag item ' || CAST(o_orderkey AS STRING) END"),
        ("processed_at", "o_orderdate"),
        ("model_used", "CASE o_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'model-a' ELSE 'model-b' END"),
        ("run_id", "'run-' || CAST(year(o_orderdate) AS STRING)")]),
    "run_events": ("orders", [
        ("run_id", "'run-' || CAST(year(o_orderdate) AS STRING)"),
        ("event", "CASE WHEN o_orderkey % 2 = 0 AND year(o_orderdate) < 2001 THEN 'completed' ELSE 'started' END"),
        ("happened_at", "o_orderdate"), ("config", "CAST(NULL AS STRING)")]),
    "assets": ("documents", [
        ("ord", "doc_id"), ("asset_id", "'d' || CAST(doc_id AS STRING)"),
        ("group_id", "'g' || CAST(doc_id % 97 AS STRING)"), ("source", "source"),
        ("source_priority", "CAST(1 + (doc_id * 7 + n_chars) % 4 AS INT)"),
        ("quality_score", "CAST(n_chars % 100 AS DOUBLE) / 10"),
        ("size", "n_chars"), ("lang", "lang"), ("text", "text"),
        ("name", pick("hero-banner.jpg|brand logo.png|manual.pdf|IMG_product-kit.png|promo.svg|user-vaping.jpeg|clip.mp4|type.ttf|photo_pod.webp|specs|notes.v2.txt", "(doc_id + n_chars)")),
        ("path", "source || '/' || " + pick("hero-banner.jpg|brand logo.png|manual.pdf|IMG_product-kit.png|promo.svg|user-vaping.jpeg|clip.mp4|type.ttf|photo_pod.webp|specs|notes.v2.txt", "(doc_id + n_chars)"))]),
    "image_meta": ("documents", [
        ("ord", "doc_id"), ("page_id", "doc_id % 50"), ("image", "'d' || CAST(doc_id AS STRING)"),
        ("url", f"'http://cdn.example.com/' || {pick('a|logo|icons|p|placeholder|uk|x|b|watermark', 'doc_id')} || '/' || CAST(doc_id AS STRING) || {pick('.jpg|.png?x=1||.gif|.svg', 'n_chars')}"),
        ("width", "CAST(50 + (doc_id * 37) % 1500 AS INT)"), ("height", "CAST(50 + (n_chars * 13) % 1500 AS INT)"),
        ("size", "n_chars * 97"), ("mode", pick("RGB|RGBA|L|CMYK|P", "doc_id")),
        ("kind", pick("hero|gallery|thumbnails|alternative|other", "n_chars")),
        ("variance", "CAST((doc_id * 29) % 400 AS DOUBLE)"), ("share", "CAST((n_chars * 7) % 100 AS DOUBLE) / 100"),
        ("brightness", "CAST((doc_id * 11) % 256 AS DOUBLE)"),
        ("mime", pick("image/png|image/gif|text/html|image/webp", "doc_id"))]),
    "checks": ("events", [
        ("site", "'site-' || CAST(user_id % 20 AS STRING)"), ("ts", "ts"), ("seq", "event_id"),
        ("response_time_ms", "value * 100"),
        ("status_code", "CAST(CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 503 WHEN 1 THEN 429 ELSE NULL END WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS INT)")]),
    "transfers": ("events", [
        ("transfer", "user_id"), ("ts", "ts"), ("seq", "event_id"), ("bytes", "CAST(FLOOR(value * 1000) AS BIGINT)"),
        ("total_size", "CASE WHEN user_id % 10 = 0 THEN 0 ELSE 1000000 END")]),
    "registry": ("supplier", [
        ("name", "s_name"), ("ord", "s_suppkey"),
        ("url", pick("https://www.site.com/press/pack.zip|shop.example.org|ftp://files.example.com| https://x.co.uk/a b.pdf||https://brand.com/media/file%20one.tar.gz?dl=1|http://|https://dropbox.com/scl/fi/x", "s_suppkey")),
        ("priority", pick("high|medium|low", "(s_suppkey * 7)")),
        ("status", pick("pending|validated|failed|inactive", "s_suppkey")), ("active", "s_nationkey % 2 = 0"),
        ("request_delay", "CAST(s_suppkey % 70 AS DOUBLE)"), ("max_pages_per_session", "(s_suppkey * 131) % 12000"),
        ("concurrent_requests", "s_suppkey % 8"), ("timeout_seconds", "(s_suppkey * 17) % 400")]),
    "registry_lines": ("supplier", [
        ("line_no", "s_suppkey + 1"),
        ("line", "CASE s_suppkey % 8 WHEN 0 THEN '# note' WHEN 1 THEN '  ' WHEN 2 THEN s_name || ' | site.com|high' WHEN 3 THEN s_name || '|site.org' WHEN 4 THEN s_name WHEN 5 THEN '|x.com|low' WHEN 6 THEN s_name || '| |medium' ELSE s_name || '|y.net|urgent' END")]),
    "changes": ("orders", [
        ("name", "'brand-' || CAST(o_custkey AS STRING)"), ("ts", "o_orderdate"), ("seq", "o_orderkey"),
        ("op", "CASE o_orderkey % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'update' WHEN 2 THEN 'update' ELSE 'add' END"),
        ("value", "CAST(o_orderkey AS STRING)")]),
    "responses": ("conversations", [
        ("handle", "'c' || CAST(conv_id AS STRING) || '-' || CAST(CAST(FLOOR(turn / 3) AS BIGINT) AS STRING)"),
        ("model_rank", "CAST(turn % 3 + 1 AS INT)"), ("model", "'model-' || CAST(turn % 3 + 1 AS STRING)"),
        ("response_text", "CASE (conv_id + turn) % 6 WHEN 0 THEN '{\"tags\": [\"fruity\", \"The\"], \"confidence\": 0.' || CAST(conv_id % 10 AS STRING) || ', \"reasoning\": \"r\"}' WHEN 1 THEN '```json' || chr(10) || '{\"tags\": [\"Ice \", \"none\"], \"confidence\": 0.8, \"reasoning\": \"s\"}' || chr(10) || '```' WHEN 2 THEN 'Sure: {\"tags\": [\"oil\"], \"confidence\": 0.55, \"reasoning\": \"t\"} ok' WHEN 3 THEN 'tags: [\"mint\", ''20mg'', ] done' WHEN 4 THEN '{\"tags\": [\"x\"]}' ELSE substr(replace(replace(text, '[', ' '), '{', ' '), 1, 40) END")]),
    "source_a": ("part", [
        ("id", "'a' || CAST(p_partkey AS STRING)"), ("ord", "p_partkey"),
        ("title", "CASE WHEN p_partkey % 3 = 0 THEN 'The ' || p_name || ' kit' ELSE p_name || ' N' || CAST(p_size AS STRING) END"),
        ("brand", "p_brand"), ("url", "'http://a.example.com/' || CAST(p_partkey AS STRING)"),
        ("image_url", "CASE WHEN p_partkey % 4 = 0 THEN 'http://i/' || CAST(p_size AS STRING) ELSE '' END"),
        ("description", "CASE WHEN p_partkey % 5 = 0 THEN 'holds ' || CAST(p_size AS STRING) || 'ml' ELSE '' END"),
        ("category", "p_type"), ("price", "CAST(CAST(FLOOR(p_retailprice) AS INT) AS STRING)")]),
    "source_b": ("part", [
        ("id", "'b' || CAST(p_partkey AS STRING)"), ("ord", "p_partkey"),
        ("title", "CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_name || ' V' || CAST(p_size AS STRING) || ' device' END"),
        ("brand", "CASE WHEN p_partkey % 11 = 0 THEN p_brand || 'x' ELSE p_brand END"),
        ("url", "'http://b.example.com/' || CAST(p_partkey AS STRING)"),
        ("image_url", "CASE WHEN p_partkey % 9 = 0 THEN 'http://i/' || CAST(p_size AS STRING) ELSE '' END"),
        ("description", "CASE WHEN p_partkey % 5 = 1 THEN 'about ' || CAST(p_size AS STRING) || ' ml' ELSE '' END"),
        ("category", "p_type"), ("price", "CAST(CAST(FLOOR(p_retailprice) AS INT) AS STRING)")]),
    "cache": ("part", [
        ("title", "p_name || ' ' || CAST(p_size AS STRING)"), ("description", "lower(p_type) || ' from ' || p_brand"),
        ("tags_list", "p_name || ',' || lower(p_type)"), ("ai_tags_list", "lower(p_type)"), ("rule_tags_list", "p_name"),
        ("cached_at", "CAST(CASE p_partkey % 3 WHEN 0 THEN '2024-01-01 00:00:00' WHEN 1 THEN '2024-02-01 00:00:00' ELSE '2024-03-01 00:00:00' END AS TIMESTAMP)"),
        ("ord", "p_partkey")]),
    "predictions": ("orders", [
        ("handle", "'h' || CAST(o_orderkey % 5000 AS STRING)"), ("ord", "o_orderkey"),
        ("prediction", "CASE o_orderkey % 4 WHEN 0 THEN '{\"tags\": [\"ice\", \"fruity\"]}' WHEN 1 THEN '{\"tags\": [\"ice\"]}' WHEN 2 THEN 'not json' ELSE '{\"tags\": []}' END"),
        ("correction", "CASE WHEN o_custkey % 3 = 0 THEN 'ice, tobacco' ELSE '' END"),
        ("final_tags", "CASE o_custkey % 4 WHEN 0 THEN 'ice' WHEN 1 THEN 'fruity, ice' WHEN 2 THEN '' ELSE 'cola' END")]),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view as a DataFrame; ``x_list`` columns become arrays ``x``."""
    source, columns = VIEWS[name]
    rows = table(spark, sf, source).selectExpr(*[f"{expr} AS {col}" for col, expr in columns])
    return rows.select(*[
        F.when(F.col(c).isNotNull(), split_tags(F.col(c))).alias(c[:-5]) if c.endswith("_list") else F.col(c)
        for c in rows.columns])


def cte(*names: str) -> str:
    """The same views as SQL: ``WITH a AS (…), b AS (…)``."""
    parts = []
    for name in names:
        source, columns = VIEWS[name]
        select = ", ".join(f"{expr} AS {col}" for col, expr in columns)
        lists = [c for c, _ in columns if c.endswith("_list")]
        arrays = "".join(
            f", CASE WHEN {c} IS NULL THEN NULL ELSE list_filter(list_transform(string_split({c}, ','), lambda t: trim(t)), lambda t: t <> '') END AS {c[:-5]}"
            for c in lists)
        drop = f" EXCLUDE ({', '.join(lists)})" if lists else ""
        parts.append(f"{name} AS (SELECT *{drop}{arrays} FROM (SELECT {select} FROM {source}))")
    return "WITH " + ", ".join(parts)
