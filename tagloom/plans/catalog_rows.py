"""Queries of variants, SKUs, images, tiers and runs."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.operators import cache, import_file as I, route
from tagloom.plans.registry import query
from tagloom.plans.sqltext import has_any, in_list, quote, tag_list
from tagloom.plans.tagging import _ratio
from tagloom.plans.views import cte, table, view
from tagloom.functions import extract as X
from tagloom.rules.vocabulary import Vocabulary, flavour_words
from tagloom.session import shared_dir
from tagloom.sources import files, store

VOCAB = Vocabulary()


@query("consolidated_products", cte("variants") + """ SELECT handle, arg_min(title, ord) AS title, arg_min(vendor, ord) AS vendor,
 coalesce(string_agg(image, '|' ORDER BY ord) FILTER (image <> ''), '') AS images FROM variants GROUP BY handle""")
def q_consolidate(spark, sf):
    """First row per handle with its images in order."""
    rows = view(spark, sf, "variants").select("ord", "handle", "title", "vendor", "image")
    return route.consolidate(rows).select("handle", "title", "vendor", F.array_join("images", "|").alias("images"))


@query("purchasable_rows", cte("variants") + " SELECT ord FROM variants WHERE NOT (option1_value = '' AND variant_price = '')")
def q_purchasable(spark, sf):
    """P4."""
    return route.drop_image_rows(view(spark, sf, "variants")).select("ord")


@query("sku_lookup", cte("variants") + """, inv AS (SELECT lower(handle) AS h, lower(option1_name) AS n, lower(option1_value) AS v, variant_sku AS sku, ord FROM variants WHERE l_keep),
f AS (SELECT h, n, v, arg_max(sku, ord) AS sku FROM inv GROUP BY ALL), g AS (SELECT h, v, arg_min(sku, ord) AS sku FROM inv GROUP BY ALL),
k AS (SELECT h, arg_max(sku, ord) AS sku FROM inv WHERE v IN ('', 'default title') GROUP BY h)
SELECT x.ord, coalesce(f.sku, g.sku, k.sku, '') AS sku FROM variants x LEFT JOIN f ON f.h = x.handle AND f.n = lower(x.option1_name) AND f.v = lower(x.option1_value)
 LEFT JOIN g ON g.h = x.handle AND g.v = lower(x.option1_value) LEFT JOIN k ON k.h = x.handle""".replace("WHERE l_keep", "WHERE ord % 3 <> 0"))
def q_sku(spark, sf):
    """Three levels of keys; the inventory is two thirds of the rows so all levels are met."""
    rows = view(spark, sf, "variants")
    inv = rows.filter("ord % 3 <> 0").select("handle", "option1_name", "option1_value", F.col("variant_sku").alias("sku"), "ord")
    return route.with_sku(rows.select("ord", "handle", "option1_name", "option1_value"), inv).select("ord", F.col("inventory_sku").alias("sku"))


PRODUCTS = ("tagged AS (SELECT 'o-' || CAST(o_orderkey AS STRING) AS handle, CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['fruity', '50/50', '10mg'] WHEN 2 THEN ['tobacco', 'mouth-to-lung', '70/30'] ELSE ['CBD'] END AS tags, "
            "CASE o_orderkey % 3 WHEN 0 THEN 'e-liquid' WHEN 1 THEN 'pod' ELSE 'tank' END AS category, o_orderkey % 5 = 0 AS review, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS conf FROM orders WHERE o_orderkey % 7 <> 0)")


def _products(spark, sf):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    return table(spark, sf, "orders").filter(k % 7 != 0).select(
        F.concat(F.lit("o-"), k.cast("string")).alias("handle"),
        F.when(k % 4 == 0, none).when(k % 4 == 1, T.words_literal(["fruity", "50/50", "10mg"]))
        .when(k % 4 == 2, T.words_literal(["tobacco", "mouth-to-lung", "70/30"])).otherwise(T.words_literal(["CBD"])).alias("tags"),
        F.when(k % 3 == 0, "e-liquid").when(k % 3 == 1, "pod").otherwise("tank").alias("category"),
        (k % 5 == 0).alias("needs_manual_review"), ((k % 100).cast("double") / 100).alias("ai_confidence"),
        F.lit("m").alias("model_used"), none.alias("failure_reasons"))


def _swap(base: str, dim: str, new: str) -> str:
    old = ", ".join(quote(t) for t in VOCAB.dims[dim].tags)
    return f"CASE WHEN len({new}) > 0 THEN list_concat(list_filter({base}, lambda t: t NOT IN ({old})), {new}) ELSE {base} END"


_OWN = tag_list([(f, has_any("lower(option1_value)", o + m)) for f, (o, m) in flavour_words().items()])
EXPORT = cte("variants") + ", " + PRODUCTS + f""", j AS (SELECT v.*, p.handle AS ph, p.tags AS ptags, p.category AS pcat, p.review, p.conf, {_OWN} AS own, {_ratio('lower(option1_value)', X.VARIANT_RATIO_PATTERNS, False)} AS ratio
  FROM variants v LEFT JOIN tagged p USING (handle) WHERE NOT (option1_value = '' AND variant_price = '')),
s1 AS (SELECT *, {_swap('ptags', 'flavour_type', 'own')} AS t1, list_filter([ratio], lambda r: r IS NOT NULL) AS rl, list_filter([CASE WHEN CAST(split_part(ratio, '/', 1) AS INT) >= 70 THEN 'direct-to-lung' WHEN CAST(split_part(ratio, '/', 1) AS INT) <= 50 THEN 'mouth-to-lung' END], lambda r: r IS NOT NULL) AS sl FROM j),
s2 AS (SELECT *, {_swap('t1', 'vg_ratio', 'rl')} AS t2 FROM s1), s3 AS (SELECT *, {_swap('t2', 'vaping_style', 'sl')} AS t3 FROM s2)"""


@query("variant_export", EXPORT + """ SELECT ord, CASE WHEN ph IS NULL THEN '' ELSE array_to_string(t3, ', ') END AS tags, CASE WHEN ph IS NULL THEN 'unknown' ELSE pcat END AS category, CASE WHEN ph IS NULL OR review THEN 'YES' ELSE 'NO' END AS needs_manual_review,
 CASE WHEN ph IS NULL THEN '' ELSE printf('%.2f', conf) END AS ai_confidence, CASE WHEN ph IS NULL OR len(t3) = 0 THEN 'untagged' WHEN review THEN 'review' ELSE 'clean' END AS tier FROM s3""")
def q_export(spark, sf):
    """J1 and S13."""
    return route.export_variants(view(spark, sf, "variants"), _products(spark, sf)).select(
        "ord", "tags", "category", "needs_manual_review", "ai_confidence", "tier")


@query("tier_counts", EXPORT + """ SELECT CASE WHEN ph IS NULL OR len(t3) = 0 THEN 'untagged' WHEN review THEN 'review' ELSE 'clean' END AS tier, count(*) AS rows, count(DISTINCT handle) AS products FROM s3 GROUP BY 1""")
def q_tiers(spark, sf):
    """S10."""
    return route.export_variants(view(spark, sf, "variants"), _products(spark, sf)).groupBy("tier").agg(
        F.count("*").alias("rows"), F.count_distinct("handle").alias("products"))


@query("cleanup_rows", cte("variants") + ", " + PRODUCTS + f""", j AS (SELECT v.ord, option1_value, p.handle AS ph, p.tags AS ptags, p.category AS pcat, p.review, {_OWN} AS own FROM variants v LEFT JOIN tagged p USING (handle)),
t AS (SELECT *, CASE WHEN {in_list('pcat', route.CLEANUP_FLAVOUR_CATEGORIES)} AND lower(trim(option1_value)) NOT IN ('default title', 'nan', '') AND len(own) > 0 THEN list_concat(list_filter(ptags, lambda t: t NOT IN ({', '.join(quote(t) for t in VOCAB.dims['flavour_type'].tags)})), own) ELSE ptags END AS tt FROM j)
SELECT ord, coalesce(array_to_string(tt, ', '), '') AS tags, CASE WHEN ph IS NULL OR len(tt) = 0 THEN 'untagged' WHEN review THEN 'review' ELSE 'clean' END AS tier FROM t""")
def q_cleanup(spark, sf):
    """J18 and T7b."""
    rows = view(spark, sf, "variants").select("ord", "handle", "option1_value", "tags")
    return route.cleanup_rows(rows, _products(spark, sf)).select("ord", F.coalesce("tags", F.lit("")).alias("tags"), "tier")


@query("reprocessed_rows", cte("variants") + ", " + PRODUCTS + """ SELECT ord, CASE WHEN p.handle IS NOT NULL THEN array_to_string(p.tags, ', ') ELSE v.tags END AS tags, CASE WHEN p.handle IS NOT NULL AND NOT review THEN 'clean' ELSE 'review' END AS tier FROM variants v LEFT JOIN tagged p USING (handle)""")
def q_reprocessed(spark, sf):
    """J17."""
    results = _products(spark, sf).select("handle", "tags", F.col("needs_manual_review").alias("needs_review"))
    return route.reprocessed_rows(view(spark, sf, "variants").select("ord", "handle", "tags"), results).select("ord", "tags", "tier")


@query("fixed_rows", cte("variants") + """ SELECT ord, CASE WHEN CAST(substr(handle, 3) AS BIGINT) % 3 = 0 THEN 'ice' ELSE tags END AS tags, CAST(substr(handle, 3) AS BIGINT) % 3 = 0 AS fixed FROM variants""")
def q_fixed(spark, sf):
    """J21."""
    rows = view(spark, sf, "variants").select("ord", "handle", "tags", F.lit("").alias("category"), F.lit("x").alias("failure_reasons"))
    fixes = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").selectExpr(
        "'o-' || CAST(o_orderkey AS STRING) AS handle", "'ice' AS tags", "'pod' AS category", "'Auto-fixed: category' AS note")
    return route.apply_fix(rows, fixes).select("ord", "tags", "fixed")


@query("image_rows", cte("variants") + """, p AS (SELECT handle, arg_min(title, ord) AS title, list(image ORDER BY ord) FILTER (image <> '') AS images FROM variants GROUP BY handle),
u AS (SELECT handle, title, unnest(images) AS image_src, generate_subscripts(images, 1) AS pos FROM p WHERE len(images) > 0 UNION ALL SELECT handle, title, NULL, NULL FROM p WHERE coalesce(len(images), 0) = 0)
SELECT handle, CASE WHEN coalesce(pos, 1) = 1 THEN title END AS title, image_src, pos AS image_position FROM u""")
def q_image_rows(spark, sf):
    """S11 and W14."""
    rows = view(spark, sf, "variants").select("ord", "handle", "title", "image")
    return route.image_rows(route.consolidate(rows)).select("handle", "title", "image_src", "image_position")


@query("shopify_rows", cte("products") + r""" SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS handle, title, '<p>' || trim(description) || '</p>' AS body_html, image AS image_src, 1 AS image_position FROM products WHERE image <> ''
UNION ALL SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), title, '<p>' || trim(description) || '</p>', NULL, NULL FROM products WHERE image = ''""")
def q_shopify(spark, sf):
    """S11 (import form), F33 and F54: slug, HTML body, image rows."""
    rows = view(spark, sf, "products").select(
        "title", "description", "vendor", "type", F.array().cast("array<string>").alias("tags"), F.col("handle").alias("sku"),
        F.col("price").cast("string").alias("price"),
        F.when(F.col("image") != "", F.array("image")).otherwise(F.array().cast("array<string>")).alias("images"))
    return route.shopify_rows(rows).select("handle", "title", "body_html", "image_src", "image_position")


@query("update_rows", cte("variants") + " SELECT handle, title, tags, variant_sku FROM variants")
def q_update(spark, sf):
    """S12 and P1."""
    return route.update_rows(view(spark, sf, "variants"))


@query("resolved_sku_column", "SELECT s_suppkey, s_name AS sku, '' AS vendor FROM supplier")
def q_resolved(spark, sf):
    """Alternative spellings of a column, required columns."""
    raw = table(spark, sf, "supplier").withColumnRenamed("s_name", "SKU")
    raw = files.require_columns(raw, ["s_suppkey", "SKU"])
    return raw.select("s_suppkey", files.column_or_blank(raw, "Variant SKU", "SKU").alias("sku"), files.column_or_blank(raw, "Vendor").alias("vendor"))


MERGE = cte("variants") + """, src AS (SELECT handle, title, variant_sku, tags, ord, CASE ord % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'review' ELSE 'untagged' END AS source FROM variants),
r AS (SELECT *, row_number() OVER (PARTITION BY handle, variant_sku ORDER BY CASE source WHEN 'clean' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, ord) AS rn FROM src)"""


@query("merged_tiers", MERGE + " SELECT handle, title, variant_sku, tags, source FROM r WHERE rn = 1")
def q_merge(spark, sf):
    """U1."""
    rows = view(spark, sf, "variants")
    return route.merge_tiers(*[rows.filter(f"ord % 3 = {i}") for i in range(3)])


@query("not_yet_processed", cte("products") + " SELECT handle FROM products WHERE handle NOT IN (SELECT 'p-' || CAST(l_partkey AS STRING) FROM lineitem WHERE l_quantity >= 49)")
def q_unprocessed(spark, sf):
    """J3 and T4 (batch form)."""
    done = table(spark, sf, "lineitem").filter("l_quantity >= 49").selectExpr("'p-' || CAST(l_partkey AS STRING) AS handle")
    return route.not_yet_processed(view(spark, sf, "products"), done).select("handle")


@query("still_untagged", cte("variants") + " SELECT ord FROM variants WHERE ord % 5 > 1 AND handle NOT IN (SELECT handle FROM variants WHERE ord % 5 <= 1)")
def q_still(spark, sf):
    """J4."""
    rows = view(spark, sf, "variants")
    return route.still_untagged(rows.filter("ord % 5 > 1"), rows.filter("ord % 5 = 0"), rows.filter("ord % 5 = 1")).select("ord")


@query("first_products", cte("products") + " SELECT handle FROM products ORDER BY ord LIMIT 500")
def q_first(spark, sf):
    """The limit is the feature; it follows the row order."""
    return view(spark, sf, "products").orderBy("ord").limit(500).select("handle")


@query("run_states", cte("run_events") + """ SELECT run_id, min(happened_at) FILTER (event = 'started') AS started_at, max(happened_at) FILTER (event = 'completed') AS completed_at,
 CASE WHEN count(*) FILTER (event = 'completed') > 0 THEN 'completed' ELSE 'running' END AS status FROM run_events GROUP BY run_id""")
def q_runs(spark, sf):
    """Runs from their event log."""
    return store.run_states(view(spark, sf, "run_events")).drop("config")


@query("latest_run_products", cte("run_events", "audit") + """, r AS (SELECT run_id, max(happened_at) FILTER (event = 'completed') AS done FROM run_events GROUP BY run_id), l AS (SELECT arg_max(run_id, done) AS run_id FROM r WHERE done IS NOT NULL)
SELECT handle, run_id FROM audit WHERE run_id = (SELECT run_id FROM l)""")
def q_latest(spark, sf):
    """J19."""
    return store.latest_products(view(spark, sf, "audit"), store.run_states(view(spark, sf, "run_events"))).select("handle", "run_id")


@query("content_hashes", cte("products") + " SELECT handle, substr(sha256(title || '|' || description), 1, 16) AS content_hash, substr(md5(vendor || '_' || title), 1, 16) AS product_id, substr(md5(image), 1, 8) AS image_name FROM products")
def q_hashes(spark, sf):
    """F30."""
    return view(spark, sf, "products").select(
        "handle", cache.content_hash(F.col("title"), F.col("description")).alias("content_hash"),
        F.substring(F.md5(F.concat("vendor", F.lit("_"), "title")), 1, 16).alias("product_id"), F.substring(F.md5("image"), 1, 8).alias("image_name"))


CACHE = cte("cache") + ", keyed AS (SELECT *, substr(sha256(title || '|' || description), 1, 16) AS h FROM cache)"


def _cache(spark, sf):
    rows = view(spark, sf, "cache")
    return rows.select("*", cache.content_hash(F.col("title"), F.col("description")).alias("content_hash"))


@query("cache_lookup", CACHE + ", c AS (SELECT DISTINCT h FROM keyed WHERE ord % 4 = 0) SELECT ord, h IN (SELECT h FROM c) AS hit FROM keyed")
def q_lookup(spark, sf):
    """Hits reuse, misses go to the annotator."""
    known = cache.merge(_cache(spark, sf).filter("ord % 4 = 0").drop("ord"), _cache(spark, sf).filter("ord % 4 = 0").drop("ord"))
    return cache.lookup(view(spark, sf, "cache").select("ord", "title", "description"), known).select("ord", "hit")


@query("cache_merge", CACHE + " SELECT h AS content_hash, max(cached_at) AS cached_at FROM keyed GROUP BY h")
def q_cache_merge(spark, sf):
    """T5 (batch form): latest per content hash."""
    rows = _cache(spark, sf).drop("ord")
    return cache.merge(rows.filter("cached_at < '2024-02-01'"), rows.filter("cached_at >= '2024-02-01'")).select("content_hash", "cached_at")


@query("cache_stats", CACHE + ", t AS (SELECT unnest(tags) AS tag FROM cache) SELECT (SELECT count(*) FROM cache) AS cached_products, (SELECT max(cached_at) FROM cache) AS last_cached, (SELECT count(DISTINCT tag) FROM t) AS unique_tags, (SELECT count(*) FROM t) AS total_tag_uses")
def q_cache_stats(spark, sf):
    """A3."""
    return cache.stats(_cache(spark, sf))


@query("cache_retention", CACHE + """, kept AS (SELECT * FROM cache WHERE cached_at >= TIMESTAMP '2024-03-02 00:00:00' - INTERVAL 30 DAYS), u AS (SELECT DISTINCT unnest(tags) AS tag FROM kept)
SELECT (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM u) AS used_tags""")
def q_retention(spark, sf):
    """T6."""
    rows = _cache(spark, sf)
    kept = cache.retain(rows, F.lit("2024-03-02 00:00:00").cast("timestamp"), 30)
    tags = rows.select(F.explode("tags").alias("tag")).distinct()
    return kept.agg(F.count("*").alias("kept")).select("kept", cache.used_tags(tags, kept).agg(F.count("*").alias("n")).scalar().alias("used_tags"))


@query("similar_products", CACHE + """, d AS (SELECT h, any_value(title) AS title, any_value(description) AS description, any_value(array_to_string(tags, ',')) AS tg, max(cached_at) AS cached_at FROM keyed GROUP BY h),
w AS (SELECT h, split_part(lower(title), ' ', 1) AS tw, split_part(lower(description), ' ', 1) AS dw FROM d WHERE abs(('0x' || h[1:6])::BIGINT) >= 0),
j AS (SELECT w.h, d.h AS other, d.cached_at FROM w JOIN d ON d.h <> w.h AND (contains(lower(d.title), w.tw) OR contains(lower(d.description), w.dw) OR contains(lower(d.tg), w.tw))),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY cached_at DESC, other) AS rank FROM j) SELECT h AS content_hash, other, rank FROM r WHERE rank <= 5""")
def q_similar(spark, sf):
    """J22 in bulk: every cached product asks."""
    rows = cache.merge(_cache(spark, sf).drop("ord"), _cache(spark, sf).drop("ord").limit(0))
    return cache.similar_products(rows, rows, 5).select("content_hash", "other", "rank")


IMPORTED = {  # of the first row, over p; the other columns are constants or empty
    "Title": "title", "Body (HTML)": """'<p>' || trim(description) || '</p>' || chr(10) || '<p>Says "yes", twice</p>'""", "Vendor": "vendor", "Product Category": "product_category",
    "Type": "type", "Tags": "'a, b, ' || lower(type)", "Variant SKU": "handle", "Variant Inventory Qty": "'0'", "Variant Price": "CAST(price AS STRING)", "SEO Title": "title",
    "SEO Description": "coalesce(summary, '')",
} | {name: f"'{value}'" for name, value in I.CONSTANTS.items()}
_HANDLE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
_IMPORT = cte("products") + """, q AS (SELECT * REPLACE (CAST(CAST(FLOOR(price) AS INT) AS STRING) AS price), CASE WHEN ord % 2 = 0 THEN 'sum ' || handle END AS summary,
 ['http://img.example.com/' || ord || '-' || x || '.jpg' for x in range(1, ord % 4 + 1)] AS images FROM products),
p AS (SELECT *, unnest(CASE WHEN len(images) = 0 THEN [0] ELSE range(1, len(images) + 1) END) AS pos FROM q) SELECT """ + ", ".join(
    f'{ {"Handle": _HANDLE, "Image Src": "coalesce(images[pos], chr(0))", "Image Position": "CASE WHEN pos > 0 THEN CAST(pos AS STRING) ELSE chr(0) END", "Image Alt Text": "CASE WHEN pos > 0 THEN title ELSE chr(0) END"}.get(name) or (f"CASE WHEN pos <= 1 THEN {IMPORTED[name]} ELSE chr(0) END" if name in IMPORTED else "chr(0)")} AS "{name}"'.replace("chr(0)", "''")
    for name in I.HEADERS) + " FROM p"


@query("import_file", _IMPORT)
def q_import(spark, sf):
    """All 49 columns of the import file, written as CSV with quotes and line breaks in texts and read back."""
    p = view(spark, sf, "products")
    numbers = F.when(F.col("ord") % 4 > 0, F.sequence(F.lit(1), (F.col("ord") % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = p.select(
        "title", F.concat("description", F.lit('\n\n  Says "yes", twice ')).alias("description"), "vendor", F.col("product_category").alias("category"), "type",
        F.array(F.lit("a"), F.lit("b"), F.lower("type")).alias("tags"), F.col("handle").alias("sku"), F.floor("price").cast("int").cast("string").alias("price"),
        F.when(F.col("ord") % 2 == 0, F.concat(F.lit("sum "), "handle")).alias("summary"),
        F.transform(numbers, lambda i: F.concat(F.lit("http://img.example.com/"), F.col("ord").cast("string"), F.lit("-"), i.cast("string"), F.lit(".jpg"))).alias("images"))
    path = f"{shared_dir(spark)}/import-{uuid.uuid4().hex}"
    I.write_import_csv(I.import_file(rows), path)
    return I.read_import_csv(spark, path)
