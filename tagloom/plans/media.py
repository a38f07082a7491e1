"""Queries of media assets and image metadata."""
from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import media as M
from tagloom.operators import assets as A
from tagloom.plans.registry import query
from tagloom.plans.sqltext import has_any, in_list, quote
from tagloom.plans.views import cte, table, view
from tagloom.rules.vocabulary import items

ASSETS = cte("assets")
META = cte("image_meta")


def assets(spark, sf):
    return view(spark, sf, "assets")


def meta(spark, sf):
    return view(spark, sf, "image_meta")


RANKED = ASSETS + """, q AS (SELECT *, quality_score >= CASE source_priority WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 3 THEN 7 ELSE 8 END AS good FROM assets),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY good DESC, CASE WHEN good THEN source_priority ELSE 0 END, quality_score DESC, source_priority, ord) AS rn, count(*) OVER g AS n, min(quality_score) OVER g AS lo, max(quality_score) OVER g AS hi, min(source_priority) OVER g AS top,
 count(*) OVER (PARTITION BY group_id, source_priority) AS same FROM q WINDOW g AS (PARTITION BY group_id)),
lv AS (SELECT group_id, count(DISTINCT source_priority) AS levels FROM assets GROUP BY 1),
s AS (SELECT r.*, levels, CASE source_priority WHEN 1 THEN 'official brand media' WHEN 2 THEN 'authorized distributor' WHEN 3 THEN 'major competitor' ELSE 'other source' END AS nm, printf('%.1f/10', quality_score) AS shown FROM r JOIN lv USING (group_id) WHERE rn = 1)"""


@query("selected_assets", RANKED + """ SELECT group_id, asset_id, source_priority, quality_score, n AS total_versions, n - 1 AS duplicates_removed, levels AS priority_levels, lo AS min_quality, hi AS max_quality,
 CASE WHEN n = 1 THEN 'Only one version available' WHEN top >= source_priority AND good THEN 'Selected from ' || nm || ' (highest priority, quality ' || shown || ')' WHEN top >= source_priority THEN 'Selected from ' || nm || ' (best available quality ' || shown || ')'
 WHEN same > 1 THEN 'Selected from ' || nm || ' (highest quality ' || shown || ' in priority level)' ELSE 'Selected from ' || nm || ' (quality ' || shown || ')' END AS selection_reason FROM s""")
def q_selected(spark, sf):
    """W3 and W4."""
    return A.select_assets(assets(spark, sf)).drop("source")


@query("duplicate_assets", RANKED + " SELECT r.asset_id, r.rn = 1 AS selected FROM r")
def q_marked(spark, sf):
    """Every asset with its verdict."""
    return A.mark_selected(assets(spark, sf)).select("asset_id", "selected")


@query("dedup_report", RANKED + """ SELECT count(*) AS total_products, sum(n)::BIGINT AS total_versions, sum(n - 1)::BIGINT AS duplicates_removed, round(sum(n - 1) / sum(n) * 100, 1) AS dedup_rate, count(*) FILTER (source_priority = 1) AS official_brand, count(*) FILTER (source_priority = 2) AS authorized_distributor,
 count(*) FILTER (source_priority = 3) AS major_competitor, count(*) FILTER (source_priority = 4) AS other FROM s""")
def q_report(spark, sf):
    """A14."""
    return A.dedup_report(A.select_assets(assets(spark, sf)))


@query("source_priority", "SELECT s_suppkey, CASE WHEN contains(lower(n), 'official') THEN 1 WHEN contains(lower(n), 'wholesale') THEN 2 WHEN contains(lower(n), 'vape uk') THEN 3 ELSE 4 END AS priority FROM (SELECT s_suppkey, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Official' WHEN 1 THEN ' wholesale' WHEN 2 THEN ' Vape UK' ELSE '' END AS n FROM supplier)")
def q_priority(spark, sf):
    """F34."""
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 4 == 0, " Official").when(F.col("s_suppkey") % 4 == 1, " wholesale").when(F.col("s_suppkey") % 4 == 2, " Vape UK").otherwise(""))
    return table(spark, sf, "supplier").select("s_suppkey", A.source_priority(name).alias("priority"))


@query("exact_duplicates", ASSETS + ", h AS (SELECT *, sha256(text) AS digest FROM assets), r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY size DESC, ord) AS rn, count(*) OVER (PARTITION BY digest) AS copies FROM h) SELECT asset_id, copies FROM r WHERE rn = 1")
def q_exact(spark, sf):
    """Whole texts hashed before the shuffle, only hashes travel."""
    rows = assets(spark, sf).select("asset_id", "ord", "size", F.sha2("text", 256).alias("sha"))
    return A.exact_duplicates(rows, F.col("sha")).select("asset_id", "copies")


@query("asset_stats", ASSETS + """, a AS (SELECT lang AS category, CASE WHEN contains(path, '.') THEN lower(regexp_extract(path, '([^.]*)$', 1)) ELSE 'unknown' END AS file_type, source, CASE WHEN quality_score >= 8 THEN 'high' WHEN quality_score >= 6 THEN 'medium' ELSE 'low' END AS band FROM assets)
SELECT 'category' AS grain, category AS key, count(*) AS assets FROM a GROUP BY 2 UNION ALL SELECT 'file_type', file_type, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'band', band, count(*) FROM a GROUP BY 2""")
def q_stats(spark, sf):
    """A21 with bands that suit a 0–10 score."""
    return A.asset_stats(assets(spark, sf).withColumn("category", F.col("lang")), 8.0, 6.0)


@query("asset_summary", ASSETS + " SELECT source, lang, count(*) AS assets FROM assets GROUP BY ALL")
def q_summary(spark, sf):
    """A40."""
    return assets(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("assets"))


@query("unique_names", ASSETS.replace("WITH ", "WITH RECURSIVE ", 1) + r""", n AS (SELECT asset_id, source, ord, regexp_extract(name, '^.+(\.[^.]+)$', 1) AS suffix, name,
 CASE ord % 7 WHEN 1 THEN '_1' WHEN 2 THEN '_1_2' WHEN 3 THEN '_1_1' ELSE '' END AS more FROM assets),
f AS (SELECT asset_id, source, left(name, length(name) - length(suffix)) || more AS stem, suffix, row_number() OVER (PARTITION BY source ORDER BY ord) AS i FROM n),
c AS (SELECT asset_id, source, i, [stem || x || suffix for x in (SELECT list(CASE WHEN k > 0 THEN '_' || array_to_string(range(1, k + 1), '_') ELSE '' END ORDER BY k) FROM range(0, 100) r(k))] AS tries FROM f),
g AS (SELECT c.source, 0::BIGINT AS i, NULL::VARCHAR AS asset_id, NULL::VARCHAR AS target, []::VARCHAR[] AS taken FROM c GROUP BY 1
 UNION ALL SELECT source, i, asset_id, CASE WHEN strlen(target) <= 255 THEN target END, CASE WHEN strlen(target) <= 255 THEN list_append(taken, target) ELSE taken END FROM (
 SELECT c.source, c.i, c.asset_id, g.taken, [x for x in c.tries if NOT list_contains(g.taken, x)][1] AS target FROM g JOIN c ON c.source = g.source AND c.i = g.i + 1))
SELECT asset_id, target FROM g WHERE i > 0""")
def q_unique(spark, sf):
    """Every name beside names that look like its tries."""
    more = F.expr("CASE ord % 7 WHEN 1 THEN '_1' WHEN 2 THEN '_1_2' WHEN 3 THEN '_1_1' ELSE '' END")
    suffix = F.regexp_extract("name", r"^.+(\.[^.]+)$", 1)
    stem = F.substring("name", F.lit(1), F.length("name") - F.length(suffix))
    rows = assets(spark, sf).select("asset_id", F.col("source").alias("category"), F.concat(stem, more, suffix).alias("name"), "ord")
    return A.unique_names(rows).select("asset_id", "target")


@query("pack_metadata", ASSETS + """, r AS (SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY ord) AS n FROM assets) SELECT source AS category, count(*) AS count, string_agg(name, '|' ORDER BY n) FILTER (n <= 10) AS files FROM r GROUP BY 1""")
def q_pack(spark, sf):
    """A38."""
    return A.pack_metadata(assets(spark, sf).select(F.col("source").alias("category"), "name", "ord"))


@query("pack_inventory", ASSETS + """, f AS (SELECT group_id AS pack, name, size, path, md5(text) AS digest, ord FROM assets),
c AS (SELECT pack, sum(n) AS total_files, count(*) FILTER (n > 1) AS duplicates_removed FROM (SELECT pack, digest, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY ord, path) AS rn FROM f)
SELECT pack, total_files::BIGINT AS total_files, duplicates_removed, string_agg(name || ' ' || size || ' ' || path, '|' ORDER BY rn) FILTER (rn <= 100) AS inventory FROM c JOIN r USING (pack) GROUP BY 1, 2, 3""")
def q_pack_inventory(spark, sf):
    """A pack's files, copies and inventory."""
    rows = assets(spark, sf).select(F.col("group_id").alias("pack"), "name", "size", "path", F.md5("text").alias("digest"), "ord")
    listed = F.transform("file_inventory", lambda f: F.concat_ws(" ", f["name"], f["size"].cast("string"), f["path"]))
    return A.pack_inventory(rows).select("pack", "total_files", "duplicates_removed", F.array_join(listed, "|").alias("inventory"))


@query("download_summary", ASSETS + """ SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS brand, CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS site, count(*) AS images, round(sum(size) / 1048576, 2) AS size_mb FROM assets GROUP BY ROLLUP (lang, source)""")
def q_downloads(spark, sf):
    """A20."""
    return A.download_summary(assets(spark, sf).select(F.col("lang").alias("brand"), F.col("source").alias("site"), "size"))


@query("download_outcomes", ASSETS + """ SELECT group_id AS product, count(*) AS total, count(*) FILTER (size % 3 = 0) AS downloaded, count(*) FILTER (size % 3 = 1) AS skipped, count(*) FILTER (size % 3 = 2) AS failed FROM assets GROUP BY 1""")
def q_outcomes(spark, sf):
    """A39."""
    k = F.col("size") % 3
    return A.download_outcomes(assets(spark, sf).select(F.col("group_id").alias("product"), F.when(k == 0, "downloaded").when(k == 1, "skipped").otherwise("failed").alias("outcome")))


def _suffix(col):
    return f"lower(regexp_extract({col}, '[^/.](\\.[^./]*)$', 1))"


def _pack_sql():
    whens = "".join(f" WHEN {has_any('lower(name)', items(w))} THEN {quote(c)}" for c, w in M.rows_of(M.FILE_CATEGORY_WORDS))
    whens += "".join(f" WHEN {in_list(_suffix('name'), items(s))} THEN {quote(c)}" for c, s in M.rows_of(M.FILE_CATEGORY_SUFFIXES))
    return f"CASE{whens} ELSE 'other' END"


@query("pack_files", ASSETS + f""", c AS (SELECT *, {_pack_sql()} AS category FROM assets)
SELECT asset_id, category, lower(source) || CASE category WHEN 'logos' THEN '-logo-' WHEN 'product-images' THEN '-product-' ELSE '-' END || regexp_replace(lower(regexp_replace(name, '([^/.])\\.[^./]*$', '\\1')), '^(img_|image_|photo_|pic_)', '') || regexp_extract(name, '[^/.](\\.[^./]*)$', 1) AS target FROM c""")
def q_pack_files(spark, sf):
    """category and standard name."""
    df = assets(spark, sf).select("asset_id", "source", "name", M.pack_category(F.col("name")).alias("category"))
    return df.select("asset_id", "category", M.standard_name(F.col("name"), F.col("source"), F.col("category")).alias("target"))


def _content_sql():
    scored = ", ".join("{'n': " + " + ".join(f"contains(lower(name), {quote(w)})::INT" for w in items(ws)) + f", 'r': {-i}, 'c': {quote(c)}}}" for i, (c, ws) in enumerate(M.rows_of(M.CONTENT_CATEGORIES)))
    return f"list_max([{scored}])"


@query("content_categories", ASSETS + f""", b AS (SELECT *, {_content_sql()} AS b FROM assets) SELECT asset_id, CASE WHEN b.n > 0 THEN b.c ELSE 'product' END AS category, round(CASE WHEN b.n > 0 THEN least(b.n / 3, 1) ELSE 0.5 END, 6) AS confidence,
 array_to_string(list_filter([{', '.join(f"CASE WHEN {has_any('lower(name)', items(w))} THEN {quote(t)} END" for t, w in M.rows_of(M.CONTENT_TAGS))}, CASE WHEN ends_with(name, '.png') THEN 'png-format' WHEN ends_with(name, '.jpg') OR ends_with(name, '.jpeg') THEN 'jpg-format' WHEN ends_with(name, '.svg') THEN 'vector-format' END], lambda t: t IS NOT NULL), '|') AS tags,
 CASE {_suffix('name')} {' '.join(f'WHEN {quote(s)} THEN {quote(t)}' for s, t in M.rows_of(M.CONTENT_TYPES))} ELSE 'application/octet-stream' END AS content_type FROM b""")
def q_content(spark, sf):
    """F37, F38 and F56b."""
    df = assets(spark, sf).select("asset_id", "name", M.content_category(F.col("name")).alias("c"))
    return df.select("asset_id", "c.category", F.round("c.confidence", 6).alias("confidence"), F.array_join(M.content_tags(F.col("name")), "|").alias("tags"), M.content_type(F.col("name")).alias("content_type"))


@query("content_catalog", ASSETS + f""", t AS (SELECT unnest(list_filter([{', '.join(f"CASE WHEN {has_any('lower(name)', items(w))} THEN {quote(t)} END" for t, w in M.rows_of(M.CONTENT_TAGS))}], lambda t: t IS NOT NULL)) AS tag FROM assets) SELECT tag, count(*) AS files FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def q_catalog(spark, sf):
    """Top tags (formats left out)."""
    tags = assets(spark, sf).select(F.explode(M.content_tags(F.col("name"))).alias("tag")).filter("tag not like '%-format'")
    return tags.groupBy("tag").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "tag").limit(20)


POINTS = META + """, p AS (SELECT *, CASE WHEN kind IN ('hero', 'gallery') THEN 'high' WHEN kind IN ('thumbnails', 'alternative') THEN 'medium' ELSE 'low' END AS pr, least(width, height) AS side, abs(1 - width / height) AS off FROM image_meta),
pts AS (SELECT *, least(100, CASE WHEN side >= 800 THEN 40 WHEN side >= 400 THEN 20 + floor((side - 400) / 400 * 20) ELSE floor(side / 400 * 20) END + CASE WHEN size >= 100000 THEN 20 WHEN size >= 10240 THEN 10 + floor((size - 10240) / 89760 * 10) ELSE floor(size / 10240 * 10) END
 + CASE WHEN off <= 0.1 THEN 20 WHEN off <= 0.3 THEN 15 WHEN off <= 0.5 THEN 10 ELSE 5 END + CASE pr WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END)::INT AS score, width >= 800 AND height >= 800 AS hr FROM p)"""


def points(spark, sf):
    c = F.col
    return meta(spark, sf).select("*", M.image_points(c("width"), c("height"), c("size"), M.image_priority(c("kind"))).alias("score"), M.is_high_res(c("width"), c("height")).alias("is_high_res"))


@query("image_points", POINTS + " SELECT image, score, hr AS is_high_res FROM pts")
def q_points(spark, sf):
    """F39."""
    return points(spark, sf).select("image", "score", "is_high_res")


@query("best_images", POINTS + ", r AS (SELECT page_id, image, row_number() OVER (PARTITION BY page_id ORDER BY hr DESC, score DESC, ord) AS rank FROM pts) SELECT * FROM r WHERE rank <= 5")
def q_best(spark, sf):
    """W5."""
    return A.best_images(points(spark, sf), 5).select("page_id", "image", "rank")


@query("page_image_chain", POINTS + f""", r AS (SELECT page_id, image, row_number() OVER (PARTITION BY page_id ORDER BY hr DESC, score DESC, ord) AS rank FROM pts WHERE score >= 50 AND NOT {has_any('lower(url)', items(M.PLACEHOLDERS) + items(M.LOGO_MARKS))}) SELECT page_id, image FROM r WHERE rank <= 3""")
def q_chain(spark, sf):
    """Score, drop placeholders, keep the good, best three."""
    good = points(spark, sf).filter((F.col("score") >= 50) & ~M.is_placeholder(F.col("url")))
    return A.best_images(good, 3).select("page_id", "image")


@query("image_filters", META + f""" SELECT image, {has_any('lower(url)', items(M.PLACEHOLDERS) + items(M.LOGO_MARKS))} AS placeholder, NOT (width < 100 OR height < 100) AND NOT {has_any('lower(url)', items(M.NOT_PRODUCT))} AS product_image, {has_any("lower(url) || chr(10) || lower(mode)", items(M.UK_TERMS))} AS uk FROM image_meta""")
def q_filters(spark, sf):
    """P9, P10 and P11."""
    u = F.col("url")
    return meta(spark, sf).select("image", M.is_placeholder(u).alias("placeholder"), M.is_product_image(u, F.col("width"), F.col("height")).alias("product_image"), M.is_uk(u, F.col("mode")).alias("uk"))


QUALITY = META + """, q AS (SELECT *, CASE WHEN least(width, height) < 400 THEN 1 WHEN least(width, height) < 800 THEN 5 + (least(width, height) - 400) / 400 * 2 WHEN least(width, height) < 1200 THEN 7 + (least(width, height) - 800) / 400 * 2 ELSE 10 END AS rs,
 CASE mode WHEN 'RGB' THEN 10 WHEN 'RGBA' THEN 9 WHEN 'L' THEN 5 WHEN 'CMYK' THEN 6 ELSE 4 END AS cs, CASE WHEN size / (width * height) < 0.5 THEN 4 WHEN size / (width * height) < 1 THEN 7 WHEN size / (width * height) < 2 THEN 9 ELSE 10 END AS ps,
 CASE WHEN variance < 100 THEN 3 WHEN variance < 200 THEN 6 WHEN variance < 300 THEN 8 ELSE 10 END AS ss, CASE WHEN share <= 0.7 THEN 5 WHEN brightness > 240 THEN 10 WHEN brightness > 200 THEN 8 ELSE 7 END AS bs FROM image_meta),
o AS (SELECT *, rs * 0.3::DOUBLE + ss * 0.25::DOUBLE + cs * 0.2::DOUBLE + ps * 0.15::DOUBLE + bs * 0.1::DOUBLE AS overall FROM q)"""


def quality(spark, sf):
    c = F.col
    q = meta(spark, sf).select("*", M.overall_quality(
        M.resolution_score(c("width"), c("height")), M.sharpness_score(c("variance")), M.color_score(c("mode")),
        M.compression_score(c("size"), c("width"), c("height")), M.background_score(c("share"), c("brightness"))).alias("overall"))
    return q.select("*", M.quality_passes(c("overall"), c("width"), c("height"), c("variance") < 100).alias("passed"))


@query("image_quality", QUALITY + """ SELECT image, round(overall, 6) AS overall, overall >= 6 AND least(width, height) >= 400 AND NOT variance < 100 AS passed, concat_ws('; ', CASE WHEN least(width, height) < 400 THEN 'Low resolution: ' || width || 'x' || height END, CASE WHEN variance < 100 THEN 'Image appears blurry' END,
 CASE mode WHEN 'L' THEN 'Grayscale image (no color)' WHEN 'CMYK' THEN 'CMYK color mode (should be RGB)' WHEN 'P' THEN 'Unusual color mode: P' END, CASE WHEN ps = 4 THEN 'Heavy compression detected (possible artifacts)' END, CASE WHEN NOT share > 0.7 THEN 'Non-uniform background' END) AS issues FROM o""")
def q_quality(spark, sf):
    """F40 and F41."""
    c = F.col
    return quality(spark, sf).select("image", F.round("overall", 6).alias("overall"), "passed", F.array_join(M.quality_issues(
        c("width"), c("height"), c("mode"), c("size"), c("variance") < 100, c("share") > 0.7), "; ").alias("issues"))


@query("quality_report", QUALITY + " SELECT count(*) AS total, count(*) FILTER (overall >= 6 AND least(width, height) >= 400 AND NOT variance < 100) AS passed, round(avg(overall), 6) AS average FROM o")
def q_quality_report(spark, sf):
    """A17."""
    return quality(spark, sf).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.round(F.avg("overall"), 6).alias("average"))


@query("low_scores", QUALITY + " SELECT image FROM o WHERE overall < 6")
def q_low(spark, sf):
    """P12."""
    return quality(spark, sf).filter("overall < 6").select("image")


@query("sizes_and_times", META + """ SELECT image, CASE WHEN size < 1024 THEN printf('%.1f', size::DOUBLE) || ' B' WHEN size < 1048576 THEN printf('%.1f', size / 1024) || ' KB' ELSE printf('%.1f', size / 1048576) || ' MB' END AS size_text, round(size / 1048576, 6) AS seconds,
 CASE WHEN size % 7 = 0 THEN 'Authentication required' WHEN size % 7 = 1 THEN 'Access forbidden' END AS restriction FROM image_meta""")
def q_sizes(spark, sf):
    """F42."""
    status = F.when(F.col("size") % 7 == 0, 401).when(F.col("size") % 7 == 1, 403).otherwise(200)
    return meta(spark, sf).select("image", M.format_size(F.col("size")).alias("size_text"), F.round(M.download_seconds(F.col("size")), 6).alias("seconds"),
                                  M.restriction(status, F.lit(False)).alias("restriction"))


@query("fitted_sizes", META + """, a AS (SELECT *, width / height AS ar FROM image_meta), b AS (SELECT *, CASE WHEN width > height THEN 800 ELSE floor(600 * ar)::INT END AS w1, CASE WHEN width > height THEN floor(800 / ar)::INT ELSE 600 END AS h1 FROM a),
c AS (SELECT *, CASE WHEN w1 > 800 THEN 800 ELSE w1 END AS w2, CASE WHEN w1 > 800 THEN floor(800 / ar)::INT ELSE h1 END AS h2 FROM b)
SELECT image, CASE WHEN NOT (width > 800 OR height > 600) THEN width WHEN h2 > 600 THEN floor(600 * ar)::INT ELSE w2 END AS w, CASE WHEN NOT (width > 800 OR height > 600) THEN height WHEN h2 > 600 THEN 600 ELSE h2 END AS h FROM c""")
def q_fit(spark, sf):
    """F43."""
    df = meta(spark, sf).select("image", M.fit_within(F.col("width"), F.col("height"), 800, 600).alias("f"))
    return df.select("image", F.col("f.width").alias("w"), F.col("f.height").alias("h"))


@query("colors_and_extensions", META + r""" SELECT image, printf('#%02x%02x%02x', width % 256, height % 256, size % 256) AS hex, CASE WHEN regexp_matches(split_part(url, '?', 1), '\.(jpg|png|gif|svg)$') THEN regexp_extract(split_part(url, '?', 1), '(\.[a-z]+)$', 1) ELSE CASE mime WHEN 'image/png' THEN '.png' WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' ELSE '.jpg' END END AS ext FROM image_meta""")
def q_colors(spark, sf):
    """F44 and F45."""
    c = F.col
    return meta(spark, sf).select("image", M.hex_color(c("width") % 256, c("height") % 256, c("size") % 256).alias("hex"), M.image_extension(c("url"), c("mime")).alias("ext"))


@query("composite_scores", META + " SELECT image, round(share * 0.4 + brightness * 0.3 + variance * 0.2 + width * 0.1, 4) AS score FROM image_meta")
def q_composite(spark, sf):
    """G1."""
    return meta(spark, sf).select("image", F.round(A.composite_score(F.col("share"), F.col("brightness"), F.col("variance"), F.col("width")), 4).alias("score"))


@query("content_gaps", META + ", p AS (SELECT DISTINCT page_id FROM image_meta), n AS (SELECT * FROM (VALUES ('hero', 'high'), ('manual', 'low')) v(media_type, impact)) SELECT page_id AS product_id, media_type, impact FROM p, n WHERE NOT EXISTS (SELECT 1 FROM image_meta m WHERE m.page_id = p.page_id AND m.kind = n.media_type)")
def q_gaps(spark, sf):
    """G2."""
    m = meta(spark, sf).select(F.col("page_id").alias("product_id"), F.col("kind").alias("media_type"))
    return A.content_gaps(m.select("product_id").distinct(), m, {"hero": "high", "manual": "low"})


@query("latest_versions", ASSETS + ", r AS (SELECT source AS asset_id, ord AS version, row_number() OVER (PARTITION BY source ORDER BY ord DESC) AS rank FROM assets) SELECT asset_id, version FROM r WHERE rank <= 3")
def q_versions(spark, sf):
    """G5."""
    return A.latest_versions(assets(spark, sf).select(F.col("source").alias("asset_id"), F.col("ord").alias("version"))).select("asset_id", "version")


@query("export_readiness", ASSETS + " SELECT group_id AS product_id, count(*) FILTER (size % 9 = 0) AS primary_n, count(*) FILTER (size % 9 = 0) = 1 AND count(*) FILTER (size % 9 IN (1, 2, 3)) >= 1 AS ready FROM assets GROUP BY 1")
def q_ready(spark, sf):
    """G6."""
    k = F.col("size") % 9
    rows = assets(spark, sf).select(F.col("group_id").alias("product_id"), F.when(k == 0, "primary").when(k.isin(1, 2, 3), "gallery").otherwise("document").alias("role"))
    return A.export_readiness(rows).select("product_id", F.col("primary").alias("primary_n"), "ready")
