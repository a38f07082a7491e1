"""Queries of catalogue differences."""
from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import diff as D
from tagloom.plans.registry import query
from tagloom.plans.sqltext import in_list
from tagloom.plans.views import cte, view
from tagloom.rules.vocabulary import Vocabulary

BOTH = cte("variants", "export_rows")
TAGS = "list_sort(list_distinct(list_filter(list_transform(string_split(lower({0}), ','), lambda t: trim(t)), lambda t: t <> '')))"


def sides(spark, sf):
    keep = ["handle", "title", "variant_sku", "tags", "vendor", "type", "ord"]
    return view(spark, sf, "variants").select(*keep), view(spark, sf, "export_rows").select(*keep)


@query("catalog_diff", BOTH + """, lt AS (SELECT handle, arg_min(title, ord) AS t FROM variants GROUP BY 1), rt AS (SELECT handle, arg_min(title, ord) AS t FROM export_rows GROUP BY 1),
ls AS (SELECT DISTINCT handle, variant_sku AS s FROM variants), rs AS (SELECT DISTINCT handle, variant_sku AS s FROM export_rows),
k AS (SELECT handle, count(*) FILTER (NOT r) AS ol, count(*) FILTER (NOT l) AS orr FROM (SELECT coalesce(ls.handle, rs.handle) AS handle, ls.s IS NOT NULL AS l, rs.s IS NOT NULL AS r FROM ls FULL JOIN rs ON ls.handle = rs.handle AND ls.s = rs.s) GROUP BY handle)
SELECT coalesce(lt.handle, rt.handle) AS handle, CASE WHEN rt.t IS NULL THEN 'only_left' WHEN lt.t IS NULL THEN 'only_right' ELSE 'both' END AS status, coalesce(lt.t <> rt.t, false) AS title_changed, ol AS skus_only_left, orr AS skus_only_right
FROM lt FULL JOIN rt ON lt.handle = rt.handle JOIN k ON k.handle = coalesce(lt.handle, rt.handle)""")
def q_catalog(spark, sf):
    """J5."""
    return D.catalog_diff(*sides(spark, sf)).select("handle", "status", "title_changed", "skus_only_left", "skus_only_right")


TAGDIFF = BOTH + f""", l AS (SELECT handle, {TAGS.format('arg_max(tags, ord)')} AS l FROM variants GROUP BY handle), r AS (SELECT handle, {TAGS.format('arg_min(tags, ord)')} AS r FROM export_rows GROUP BY handle),
d AS (SELECT coalesce(l.handle, r.handle) AS handle, CASE WHEN r IS NULL THEN 'only_left' WHEN l IS NULL THEN 'only_right' WHEN l = r THEN 'match' ELSE 'mismatch' END AS status,
 list_filter(r, lambda t: NOT list_contains(l, t)) AS added, list_filter(l, lambda t: NOT list_contains(r, t)) AS removed FROM l FULL JOIN r ON l.handle = r.handle)"""


@query("tag_diff", TAGDIFF + " SELECT handle, status, CASE WHEN status = 'mismatch' THEN array_to_string(list_sort(added), '|') END AS added, CASE WHEN status = 'mismatch' THEN array_to_string(list_sort(removed), '|') END AS removed FROM d")
def q_tags(spark, sf):
    """J6."""
    d = D.tag_diff(*sides(spark, sf))
    m = F.col("status") == "mismatch"
    return d.select("handle", "status", *[F.when(m, F.array_join(F.array_sort(c), "|")).alias(c) for c in ("added", "removed")])


@query("diff_patterns", TAGDIFF + " SELECT CASE WHEN len(added) > 0 AND len(removed) = 0 THEN 'added_only' WHEN len(removed) > 0 AND len(added) = 0 THEN 'removed_only' ELSE 'both' END AS pattern, count(*) AS products FROM d WHERE status = 'mismatch' GROUP BY 1")
def q_patterns(spark, sf):
    """A27."""
    return D.diff_patterns(D.tag_diff(*sides(spark, sf)))


@query("common_removals", TAGDIFF + " SELECT t AS tag, count(*) AS products FROM (SELECT unnest(removed) AS t FROM d WHERE status = 'mismatch') GROUP BY t ORDER BY 2 DESC, 1 LIMIT 20")
def q_removals(spark, sf):
    """Most often removed tags."""
    return D.common_changes(D.tag_diff(*sides(spark, sf)), "removed")


@query("vendor_enrichment", BOTH + """, v AS (SELECT handle, arg_min(vendor, ord) AS vendor FROM export_rows GROUP BY 1) SELECT ord, coalesce(v.vendor, '') AS vendor FROM variants x LEFT JOIN v ON v.handle = x.handle AND v.vendor <> ''""")
def q_vendor(spark, sf):
    """J7."""
    left, right = sides(spark, sf)
    return D.enrich_vendor(left, right).select("ord", "vendor")


@query("lost_tags", BOTH + """, l AS (SELECT handle, arg_min(tags, ord) AS t FROM variants GROUP BY 1), r AS (SELECT handle, arg_min(tags, ord) AS t FROM export_rows GROUP BY 1)
SELECT l.handle, trim(l.t) AS tags_left FROM l JOIN r USING (handle) WHERE trim(l.t) <> '' AND trim(r.t) = ''""")
def q_lost(spark, sf):
    """First rows on both sides."""
    return D.lost_tags(*sides(spark, sf))


MERGED = """, m AS (SELECT handle, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS tags FROM (SELECT handle, unnest(list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> '')) AS tag FROM variants) GROUP BY handle)"""


@query("merged_tags", BOTH + MERGED + " SELECT h.handle, h.title, coalesce(m.tags, '') AS tags FROM (SELECT handle, arg_min(title, ord) AS title FROM variants GROUP BY 1) h LEFT JOIN m USING (handle)")
def q_merged(spark, sf):
    """A28."""
    return D.merged_tags(sides(spark, sf)[0])


@query("restore_set", BOTH + MERGED + ", r AS (SELECT handle, arg_min(tags, ord) AS t FROM export_rows GROUP BY 1) SELECT m.handle, m.tags FROM m JOIN r USING (handle) WHERE trim(r.t) = ''")
def q_restore(spark, sf):
    """Merged tags."""
    return D.restore_set(*sides(spark, sf)).select("handle", "tags")


@query("uneven_variants", BOTH + " SELECT handle, count(*) AS variants, count(DISTINCT tags) AS tag_texts FROM variants GROUP BY 1 HAVING count(*) > 1")
def q_uneven(spark, sf):
    """A29."""
    return D.uneven_variants(sides(spark, sf)[0])


@query("tagged_by_type_and_vendor", BOTH + """, f AS (SELECT handle, arg_min(struct_pack(type, vendor, tags), ord) AS s FROM variants GROUP BY 1), p AS (SELECT s.type AS type, s.vendor AS vendor, s.tags <> '' AS tagged FROM f)
SELECT 'type' AS grain, type AS key, count(*) FILTER (tagged) AS tagged, count(*) FILTER (NOT tagged) AS untagged FROM p GROUP BY type UNION ALL SELECT 'vendor', vendor, count(*) FILTER (tagged), count(*) FILTER (NOT tagged) FROM p GROUP BY vendor""")
def q_tagged_by(spark, sf):
    """A11."""
    return D.tagged_by(sides(spark, sf)[0])


@query("approved_usage", BOTH + f""", f AS (SELECT handle, arg_min(tags, ord) AS t FROM variants GROUP BY 1), u AS (SELECT unnest(list_filter(list_transform(string_split(lower(t), ','), lambda x: trim(x)), lambda x: x <> '')) AS tag FROM f)
SELECT tag, count(*) AS uses, {in_list('tag', Vocabulary().flat())} OR regexp_matches(replace(tag, 'mg', ''), '^\\d+$') AS approved FROM u GROUP BY tag""")
def q_approved(spark, sf):
    """A12."""
    return D.approved_usage(sides(spark, sf)[0])


@query("handle_sets", BOTH + """ SELECT 'both' AS part, count(*) AS handles FROM (SELECT handle FROM variants INTERSECT SELECT handle FROM export_rows) UNION ALL SELECT 'only_left', count(*) FROM (SELECT handle FROM variants EXCEPT SELECT handle FROM export_rows)
UNION ALL SELECT 'only_right', count(*) FROM (SELECT handle FROM export_rows EXCEPT SELECT handle FROM variants)""")
def q_sets(spark, sf):
    """U2."""
    return D.handle_sets(*sides(spark, sf))


@query("tag_set_change", cte("audit") + """ SELECT handle, array_to_string(list_sort(list_distinct(list_concat(rule_tags, final_tags))), '|') AS every, array_to_string(list_sort(list_filter(final_tags, lambda t: NOT list_contains(rule_tags, t))), '|') AS added,
 array_to_string(list_sort(list_filter(rule_tags, lambda t: NOT list_contains(final_tags, t))), '|') AS removed FROM audit""")
def q_change(spark, sf):
    """U3 and U4."""
    rows = view(spark, sf, "audit").select("handle", D.set_change(F.array_distinct("rule_tags"), F.col("final_tags")).alias("c"))
    return rows.select("handle", F.array_join("c.all", "|").alias("every"), F.array_join("c.added", "|").alias("added"), F.array_join("c.removed", "|").alias("removed"))
