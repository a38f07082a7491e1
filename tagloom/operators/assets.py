"""Media assets: choice by source priority, exact-content dedup, catalogue."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.text import fixed
from tagloom.operators.ordering import bounded_lists, first_rows, positions, top_rows
from tagloom.session import cut

# Priority -> lowest quality accepted at that level, and its name.
LEVELS = {1: (5.0, "official brand media"), 2: (6.0, "authorized distributor"),
          3: (7.0, "major competitor"), 4: (8.0, "other source")}
ALTERNATE_QUALITY = 7.0

# Words in a source's name -> priority, first line wins, else 4.
SOURCE_WORDS = """
official, brand, manufacturer | 1
authorized, distributor, wholesale | 2
vape uk, vape superstore, vapourism, ecigarette direct, competitor | 3
"""


def source_priority(name: Column) -> Column:
    low, chain = F.lower(name), F
    for line in SOURCE_WORDS.strip().splitlines():
        words, level = (p.strip() for p in line.split("|"))
        cond = None
        for word in words.split(", "):
            cond = low.contains(word) if cond is None else cond | low.contains(word)
        chain = chain.when(cond, F.lit(int(level)))
    return chain.otherwise(4)


def _level(priority: Column, part: int) -> Column:
    chain = F
    for level, values in LEVELS.items():
        chain = chain.when(priority == level, F.lit(values[part]))
    return chain.otherwise(F.lit("unknown source") if part else F.lit(None).cast("double"))


def _choice() -> Column:
    """Sort key of the choice; the smallest is the selected asset."""
    good = F.coalesce(F.col("quality_score") >= _level(F.col("source_priority"), 0), F.lit(False))
    return F.struct((~good).alias("poor"), F.when(good, F.col("source_priority")).otherwise(0).alias("level"),
                    (-F.col("quality_score")).alias("q"), F.col("source_priority").alias("p"),
                    F.col("ord").alias("o"))


def select_assets(assets: DataFrame) -> DataFrame:
    """One row per group: the selected asset, why, and the group's numbers.

    First the highest priority with an asset good enough for it, the best
    quality there; if no level qualifies, the best quality overall.  Two
    aggregations, by group and level and then by group, both combined before
    the shuffle, so a group of a third of all assets is no hot spot.
    Asset ids are unique inside a group.
    """
    per_level = assets.groupBy("group_id", "source_priority").agg(
        F.count("*").alias("n"), F.min("quality_score").alias("lo"), F.max("quality_score").alias("hi"),
        F.min(_choice()).alias("key"),
        F.min_by(F.struct("asset_id", "source", "quality_score", "source_priority"), _choice()).alias("best"))
    groups = per_level.groupBy("group_id").agg(
        F.sum("n").alias("total_versions"), F.count("*").alias("priority_levels"),
        F.min("source_priority").alias("_top"), F.min("lo").alias("min_quality"), F.max("hi").alias("max_quality"),
        F.min_by(F.struct("best.*", "n"), "key").alias("s"))
    quality, level = F.col("s.quality_score"), F.col("s.source_priority")
    name, shown = _level(level, 1), F.concat(fixed(F.col("s.quality_score"), 1), F.lit("/10"))

    def text(form: str) -> Column:
        return F.format_string(form, name, shown)

    reason = (F.when(F.col("total_versions") == 1, F.lit("Only one version available"))
              .when((F.col("_top") >= level) & (quality >= _level(level, 0)),
                    text("Selected from %s (highest priority, quality %s)"))
              .when(F.col("_top") >= level, text("Selected from %s (best available quality %s)"))
              .when(F.col("s.n") > 1, text("Selected from %s (highest quality %s in priority level)"))
              .otherwise(text("Selected from %s (quality %s)")))
    return groups.select(
        "group_id", "s.asset_id", "s.source", "s.source_priority", "s.quality_score",
        "total_versions", (F.col("total_versions") - 1).alias("duplicates_removed"), "priority_levels",
        "min_quality", "max_quality", reason.alias("selection_reason"))


def mark_selected(assets: DataFrame) -> DataFrame:
    """All assets with ``selected``; the others are the group's duplicates."""
    chosen = select_assets(assets).select("group_id", F.col("asset_id").alias("_chosen"))
    return assets.join(chosen, "group_id").select(*assets.columns, (F.col("asset_id") == F.col("_chosen")).alias("selected"))


def dedup_report(selected: DataFrame) -> DataFrame:
    """Totals over the chosen assets."""
    def level(n: Column, name: str) -> Column:
        return F.count_if(n).alias(name)

    p = F.col("source_priority")
    return selected.agg(
        F.count("*").alias("total_products"), F.sum("total_versions").alias("total_versions"),
        F.sum("duplicates_removed").alias("duplicates_removed"),
        F.round(F.sum("duplicates_removed") / F.sum("total_versions") * 100, 1).alias("dedup_rate"),
        level(p == 1, "official_brand"), level(p == 2, "authorized_distributor"),
        level(p == 3, "major_competitor"), level(~p.isin(1, 2, 3), "other"))


def exact_duplicates(files: DataFrame, digest: Column) -> DataFrame:
    """One file per content: the largest, then the first.  ``copies`` counts them all."""
    hashed = files.select("*", digest.alias("digest"))
    others = [c for c in files.columns]
    return hashed.groupBy("digest").agg(
        F.count("*").alias("copies"),
        F.min_by(F.struct(*others), F.struct((-F.col("size")).alias("s"), "ord")).alias("_f")) \
        .select("digest", "copies", "_f.*")


def build_catalog(unified: DataFrame, assets: DataFrame, quality: DataFrame | None = None,
                  limit: int = 10_000) -> DataFrame:
    """Catalogue rows: product, its media (chosen asset and good alternates), quality.

    ``unified``: product_id, name, brand, model_number, categories (array),
    primary_source, source_count, match_score.  Media lists are bounded; a
    product with more media than ``limit`` continues in further ``part`` rows.
    """
    marked = mark_selected(assets).filter(F.col("selected") | (F.col("quality_score") >= ALTERNATE_QUALITY))
    order = F.struct((~F.col("selected")).alias("alt"), F.col("source_priority").alias("p"),
                     (-F.col("quality_score")).alias("q"), F.col("ord").alias("o"))
    media = bounded_lists(
        marked, ["group_id"], [order],
        F.struct((~F.col("selected")).alias("alt"), F.col("source_priority").alias("p")),
        F.struct("asset_id", "source", "quality_score", F.col("selected").alias("is_primary")), "media_assets", limit)
    joined = unified.join(media.withColumnRenamed("group_id", "product_id"), "product_id", "left")
    primary = F.get(F.filter("media_assets", lambda a: a["is_primary"]), F.lit(0))
    scores = F.map_from_entries(F.array_compact(F.array(F.when(primary.isNotNull(), F.struct(
        F.lit("primary"), primary["quality_score"])))))
    if quality is not None:
        joined = joined.join(quality, "product_id", "left")
        scores = F.map_concat(scores, F.coalesce("scores", F.create_map().cast("map<string,double>")))
    empty = F.array().cast("array<struct<asset_id:string,source:string,quality_score:double,is_primary:boolean>>")
    return joined.select(
        "product_id", "name", "brand", "model_number",
        F.coalesce(F.get("categories", F.lit(0)), F.lit("unknown")).alias("category"),
        "primary_source", "source_count", F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("media_assets", empty).alias("media_assets"), scores.alias("quality_scores"))


def filter_catalog(catalog: DataFrame, brand: str | None = None, category: str | None = None,
                   source: str | None = None, min_quality: float | None = None) -> DataFrame:
    """Catalogue rows by name, ignoring case, and by any asset good enough."""
    for col, wanted in (("brand", brand), ("category", category), ("primary_source", source)):
        if wanted:
            catalog = catalog.filter(F.lower(col) == wanted.lower())
    if min_quality is not None:
        good = catalog.filter(F.exists("media_assets", lambda a: a["quality_score"] >= min_quality)).select("product_id").distinct()
        catalog = catalog.join(good, "product_id", "left_semi")  # with all parts of a long list
    return catalog


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """Totals and quality bands of the primary assets."""
    first = F.coalesce(F.get(F.filter("media_assets", lambda a: a["is_primary"]), F.lit(0)),
                       F.get("media_assets", F.lit(0)))["quality_score"]
    rows = catalog.select("part", F.size("media_assets").alias("n"), F.when(F.col("part") == 0, first).alias("q"))
    q = F.col("q")
    return rows.agg(
        F.count_if(F.col("part") == 0).alias("total_products"), F.sum("n").alias("total_assets"),
        F.coalesce(F.avg("q"), F.lit(0.0)).alias("average_quality"),
        F.coalesce(F.min("q"), F.lit(0.0)).alias("min_quality"), F.coalesce(F.max("q"), F.lit(0.0)).alias("max_quality"),
        F.count_if(q >= 8).alias("high_quality"), F.count_if((q >= 6) & (q < 8)).alias("medium_quality"),
        F.count_if(q < 6).alias("low_quality"))


def catalog_breakdown(catalog: DataFrame) -> DataFrame:
    """Products by primary source and by category, both grains in one pass."""
    return catalog.filter("part = 0").groupingSets([["primary_source"], ["category"]], "primary_source", "category").agg(
        F.grouping("category").alias("_s"), F.count("*").alias("products")).select(
        F.when(F.col("_s") == 1, "source").otherwise("category").alias("grain"),
        F.when(F.col("_s") == 1, F.col("primary_source")).otherwise(F.col("category")).alias("key"), "products")


def asset_stats(assets: DataFrame, high: float = 0.8, low: float = 0.6) -> DataFrame:
    """Assets by category, file type, source and quality band.

    The default bands are the source's; it compares them with 0–10 scores, so
    nearly all assets are ``high``.  Both are parameters.
    """
    band = F.when(F.col("quality_score") >= high, "high").when(F.col("quality_score") >= low, "medium").otherwise("low")
    ext = F.when(F.col("path").contains("."), F.lower(F.element_at(F.split("path", r"\."), -1))).otherwise("unknown")
    rows = assets.select("category", ext.alias("file_type"), "source", band.alias("band"))
    dims = ["category", "file_type", "source", "band"]
    out = rows.groupingSets([[d] for d in dims], *dims).agg(
        F.count("*").alias("assets"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    grain, key = F, F
    for d in dims:
        grain, key = grain.when(F.col(f"_{d}") == 0, F.lit(d)), key.when(F.col(f"_{d}") == 0, F.col(d))
    return out.select(grain.alias("grain"), key.alias("key"), "assets")


def best_images(images: DataFrame, n: int = 10, prefer_high_res: bool = True) -> DataFrame:
    """Best ``n`` images per page: high resolution first, then score, then order."""
    high = F.col("is_high_res").cast("int") if prefer_high_res else F.lit(0)
    return top_rows(images, ["page_id"], n, F.desc(high), F.desc("score"), F.col("ord"))


LONGEST_NAME = 255  # bytes, as file systems have it


def _tail(slot: Column) -> Column:
    """What the n-th try puts behind the stem: the counter goes onto the already suffixed stem, so ``_1``, ``_1_2``, .."""
    return F.when(slot > 0, F.concat(F.lit("_"), F.array_join(F.sequence(F.lit(1), slot), "_"))).otherwise("")


def unique_names(files: DataFrame, longest: int = LONGEST_NAME) -> DataFrame:
    """``target`` for each file of a ``category``: in the order of ``ord`` (which must be total there) each takes its
    ``name``, or the first of ``stem_1``, ``stem_1_2``, .. that no earlier file of the category has, be it as its own name or as a try.

    A target over ``longest`` bytes is null, as no such file can be made, and keeps no name from others; so of
    any number of equal names only the first hundred or so need to be looked at.  A null name has a null target.

    A name ``t`` is a try of one other name at most: that which is left without ``_1_2_.._k`` at its end.  So names
    form trees.  Inside a name its files take the tries in turn, leaving out those that a file of such a name took before;
    whether a name itself is lost to the name above it hangs on whether that lost its own.  Both cases are worked
    out for each name, and carried up the trees by doubling.
    """
    tries = next(k for k in range(1, longest + 2) if sum(len(f"_{i}") for i in range(1, k + 1)) >= longest)
    suffix = F.regexp_extract("name", r"(?s)^.+(\.[^.]+)$", 1)
    named = files.select(*files.columns, F.struct("category").alias("_of"), suffix.alias("_suffix"),
                         F.expr("substring(name, 1, length(name) - length(regexp_extract(name, '(?s)^.+(\\\\.[^.]+)$', 1)))").alias("_stem"))
    firsts = top_rows(named.filter(F.col("name").isNotNull()).select("_of", "name", "_stem", "_suffix", "ord"), ["_of", "name"], tries, F.col("ord"))
    names = firsts.groupBy("_of", "name", "_stem", "_suffix").agg(F.array_sort(F.collect_list("ord")).alias("at"))
    count = F.coalesce(F.regexp_extract("_stem", r"_([1-9][0-9]{0,2})$", 1).try_cast("int"), F.lit(0))
    below = cut(names.withColumn("k", F.when(count <= tries, count).otherwise(0)).withColumn("_end", _tail(F.col("k")))
                .withColumn("up", F.when((F.col("k") > 0) & F.col("_stem").endswith(F.col("_end")) & (F.length("_stem") > F.length("_end")),
                                         F.concat(F.expr("substring(_stem, 1, length(_stem) - length(_end))"), "_suffix"))).drop("_end"))
    claims = below.filter("up is not null").groupBy("_of", F.col("up").alias("name")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("k"), F.get("at", F.lit(0)).alias("first")))).alias("claims"))
    trees = below.join(claims, ["_of", "name"], "left")

    def taken(shut: bool) -> Column:
        """Which try each file gets, if the name itself is lost or not."""
        def step(acc: Column, k: Column) -> Column:
            now = F.get("at", acc["i"])
            lost = F.coalesce(F.try_element_at("claims", k) < now, F.lit(False)) | ((k == 0) & F.lit(shut))
            return F.when(now.isNull() | lost, acc).otherwise(F.struct((acc["i"] + 1).alias("i"), F.array_append(acc["out"], k).alias("out")))

        last = F.size("at") + F.coalesce(F.size("claims"), F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), last), F.struct(F.lit(0).alias("i"), F.expr("cast(array() as array<int>)").alias("out")), step)["out"]

    trees = cut(trees.withColumns({"open": taken(False), "shut": taken(True)}))
    above = trees.select("_of", F.col("name").alias("up"), F.col("at").alias("up_at"), "open", "shut")
    lost = {case: F.coalesce(F.get("up_at", F.array_position(case, F.col("k")).cast("int") - 1) < F.get("at", F.lit(0)), F.lit(False)) for case in ("open", "shut")}
    links = cut(trees.filter("up is not null").drop("open", "shut").join(above, ["_of", "up"])
                .select("_of", "name", "up", lost["open"].alias("if_open"), lost["shut"].alias("if_shut")))
    while True:
        higher = links.select("_of", F.col("name").alias("up"), F.col("up").alias("top"), F.col("if_open").alias("up_open"), F.col("if_shut").alias("up_shut"))
        joined = links.join(higher, ["_of", "up"])
        if joined.isEmpty():
            break
        joined = links.join(higher, ["_of", "up"], "left")
        follow = lambda case: F.when(F.coalesce(F.col(case), F.lit(case == "up_shut")), F.col("if_shut")).otherwise(F.col("if_open"))
        links = cut(joined.select("_of", "name", F.coalesce("top", "up").alias("up"), follow("up_open").alias("if_open"), follow("up_shut").alias("if_shut")))
    placed = (trees.join(links.filter("if_open").select("_of", "name", F.lit(True).alias("lost")), ["_of", "name"], "left")
              .select("_of", "name", F.inline(F.arrays_zip(F.col("at").alias("ord"), F.when(F.col("lost"), F.col("shut")).otherwise(F.col("open")).alias("_try")))))
    target = F.concat("_stem", _tail(F.col("_try")), "_suffix")
    return named.join(placed, ["_of", "name", "ord"], "left").select(*files.columns, F.when(F.col("_try").isNotNull() & (F.octet_length(target) <= longest), target).alias("target"))


def pack_metadata(files: DataFrame, sample: int = 10) -> DataFrame:
    """Per category the number of files and its first names; the sample is the report's length."""
    firsts = top_rows(files.select("category", "name", "ord").distinct(), ["category"], sample, F.col("ord"), F.col("name")).groupBy("category").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), "|").alias("files"))
    return files.groupBy("category").agg(F.count("*").alias("count")).join(firsts, "category", "left")


def pack_inventory(files: DataFrame, inventory: int = 100) -> DataFrame:
    """Per media pack (``pack``) its number of files, how many contents had copies removed, and its first files
    with size and path; the inventory's length is the report's.  ``files``: pack, name, size, path, digest, ord."""
    per_content = files.groupBy("pack", "digest").agg(F.count("*").alias("copies"))
    counts = per_content.groupBy("pack").agg(F.sum("copies").alias("total_files"), F.count_if(F.col("copies") > 1).alias("duplicates_removed"))
    firsts = top_rows(files.select("pack", "name", "size", "path", "ord"), ["pack"], inventory, F.col("ord"), F.col("path")).groupBy("pack").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "size", "path"))), lambda x: F.struct(x["name"].alias("name"), x["size"].alias("size"), x["path"].alias("path"))).alias("file_inventory"))
    return counts.join(firsts, "pack")


def download_summary(files: DataFrame) -> DataFrame:
    """Images and size by brand and site, with totals."""
    rolled = files.rollup("brand", "site").agg(
        F.grouping_id("brand", "site").alias("_g"), F.count("*").alias("images"),
        F.round(F.sum("size") / (1024 * 1024), 2).alias("size_mb"))
    return rolled.select(F.when(F.col("_g") == 3, "ALL").otherwise(F.col("brand")).alias("brand"),
                         F.when(F.col("_g") >= 1, "ALL").otherwise(F.col("site")).alias("site"), "images", "size_mb")


def download_outcomes(outcomes: DataFrame) -> DataFrame:
    """Downloaded, skipped and failed images per product."""
    o = F.col("outcome")
    return outcomes.groupBy("product").agg(
        F.count("*").alias("total"), F.count_if(o == "downloaded").alias("downloaded"),
        F.count_if(o == "skipped").alias("skipped"), F.count_if(o == "failed").alias("failed"))


def inventory(products: DataFrame, site: str | None = None) -> DataFrame:
    """Products per site by brand (``Unknown`` where missing) and by category."""
    rows = products if site is None else products.filter(F.col("site") == site)
    rows = rows.select("site", F.coalesce("brand", F.lit("Unknown")).alias("brand"), "category")
    return rows.groupingSets([["site", "brand"], ["site", "category"]], "site", "brand", "category").agg(
        F.grouping("category").alias("_b"), F.count("*").alias("products")).select(
        "site", F.when(F.col("_b") == 1, "brand").otherwise("category").alias("grain"),
        F.when(F.col("_b") == 1, F.col("brand")).otherwise(F.col("category")).alias("key"), "products")


def composite_score(quality: Column, relevance: Column, freshness: Column, completeness: Column) -> Column:
    """Weighted asset score 40/30/20/10."""
    return quality * 0.4 + relevance * 0.3 + freshness * 0.2 + completeness * 0.1


def content_gaps(products: DataFrame, assets: DataFrame, required: dict[str, str]) -> DataFrame:
    """Required media types a product lacks, with the impact of each."""
    needs = F.array(*[F.struct(F.lit(t).alias("media_type"), F.lit(i).alias("impact")) for t, i in required.items()])
    wanted = products.select("product_id", F.inline(needs))
    return wanted.join(assets.select("product_id", "media_type"), ["product_id", "media_type"], "left_anti")


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """New, removed and changed rows between two snapshots, with the changed columns."""
    l = before.select(key, F.struct(*watched).alias("_l"))
    r = after.select(key, F.struct(*watched).alias("_r"))
    both = l.join(r, key, "full_outer")
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), F.lit(c)) for c in watched]))
    status = F.when(F.col("_l").isNull(), "new").when(F.col("_r").isNull(), "removed").otherwise("changed")
    return both.filter(F.col("_l").isNull() | F.col("_r").isNull() | (F.size(changed) > 0)).select(
        key, status.alias("change"), F.when(status == "changed", F.array_join(changed, ",")).otherwise("").alias("columns"))


def kpi_status(checks: DataFrame, success: float = 0.95, error: float = 0.05) -> DataFrame:
    """Success and error rate per site against their targets."""
    return checks.groupBy("site").agg(F.avg(F.col("ok").cast("int")).alias("success_rate")).select(
        "site", "success_rate", (1 - F.col("success_rate")).alias("error_rate"),
        F.when((F.col("success_rate") > success) & (1 - F.col("success_rate") < error), "met").otherwise("missed").alias("status"))


def latest_versions(versions: DataFrame, keep: int = 3) -> DataFrame:
    """The last ``keep`` versions per asset; keeping few is the feature."""
    return top_rows(versions, ["asset_id"], keep, F.desc("version"))


def export_readiness(assets: DataFrame) -> DataFrame:
    """Per product what media it has by role and whether it can be exported."""
    role = F.col("role")
    return assets.groupBy("product_id").agg(
        F.count_if(role == "primary").alias("primary"), F.count_if(role == "gallery").alias("gallery"),
        F.count_if(role == "document").alias("documents")).withColumn(
        "ready", (F.col("primary") == 1) & (F.col("gallery") >= 1))
