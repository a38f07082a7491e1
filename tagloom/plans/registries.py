"""Queries of registries, change logs and robots rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import registry as R
from tagloom.plans.registry import query
from tagloom.plans.views import cte, view, table

REG, LINES, LOG = cte("registry"), cte("registry_lines"), cte("changes")
PARTS = LINES + ", p AS (SELECT line_no, trim(line) AS line, list_transform(string_split(trim(line), '|'), lambda x: trim(x)) AS p FROM registry_lines), r AS (SELECT * FROM p WHERE line <> '' AND NOT starts_with(line, '#'))"


@query("brand_lines", PARTS + """, e AS (SELECT *, CASE WHEN len(p) < 2 THEN 'Line ' || line_no || ': Invalid format - ' || line WHEN p[1] = '' THEN 'Line ' || line_no || ': Missing brand name' WHEN p[2] = '' THEN 'Line ' || line_no || ': Missing website for ' || p[1] END AS error FROM r)
SELECT line_no, CASE WHEN error IS NULL THEN p[1] END AS name, CASE WHEN error IS NULL THEN CASE WHEN p[3] IN ('high', 'medium', 'low') THEN p[3] ELSE 'medium' END END AS priority, error FROM e""")
def q_brand_lines(spark, sf):
    """Brand form."""
    return R.parse_lines(view(spark, sf, "registry_lines"), "brand").drop("url")


@query("site_lines", PARTS + """, e AS (SELECT *, CASE WHEN len(p) < 2 THEN 'Line ' || line_no || ': Invalid format (need at least Name|URL)' WHEN coalesce(p[3], 'medium') NOT IN ('high', 'medium', 'low') THEN 'Line ' || line_no || ': Invalid priority ''' || p[3] || '''' END AS error FROM r)
SELECT line_no, CASE WHEN error IS NULL THEN p[1] END AS name, CASE WHEN error IS NULL THEN coalesce(p[3], 'medium') END AS priority, error FROM e""")
def q_site_lines(spark, sf):
    """Site form."""
    return R.parse_lines(view(spark, sf, "registry_lines"), "site").drop("url")


@query("url_lines", LINES + " SELECT line_no, trim(line) AS url FROM registry_lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')")
def q_url_lines(spark, sf):
    """S6."""
    return R.parse_urls(view(spark, sf, "registry_lines"))


@query("parameter_errors", REG + """ SELECT name, concat_ws('|', CASE WHEN request_delay < 0.5 THEN 'request_delay must be at least 0.5 seconds' END, CASE WHEN request_delay > 60 THEN 'request_delay cannot exceed 60 seconds' END, CASE WHEN max_pages_per_session < 1 THEN 'max_pages_per_session must be at least 1' END,
 CASE WHEN max_pages_per_session > 10000 THEN 'max_pages_per_session cannot exceed 10000' END, CASE WHEN concurrent_requests < 1 THEN 'concurrent_requests must be at least 1' END, CASE WHEN concurrent_requests > 5 THEN 'concurrent_requests cannot exceed 5 (avoid overwhelming servers)' END,
 CASE WHEN timeout_seconds < 5 THEN 'timeout_seconds must be at least 5' END, CASE WHEN timeout_seconds > 300 THEN 'timeout_seconds cannot exceed 300' END) AS errors FROM registry""")
def q_parameters(spark, sf):
    """P16."""
    return view(spark, sf, "registry").select("name", F.array_join(R.parameter_errors(), "|").alias("errors"))


@query("picked_brands", REG + " SELECT name FROM registry WHERE priority = 'high' AND status = 'pending' AND active")
def q_pick(spark, sf):
    """P6."""
    return R.pick(view(spark, sf, "registry"), "high", "pending", True).select("name")


@query("processing_queue", REG + " SELECT name, priority FROM registry ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, name")
def q_queue(spark, sf):
    """O1."""
    return R.processing_queue(view(spark, sf, "registry")).select("name", "priority")


@query("registry_state", LOG + ", l AS (SELECT name, arg_max(struct_pack(op, value), (ts, seq)) AS e FROM changes GROUP BY 1) SELECT name, e.value AS value FROM l WHERE e.op <> 'remove'")
def q_state(spark, sf):
    """Brands, where adding again is an update."""
    return R.current_state(view(spark, sf, "changes"))


@query("registry_state_strict", LOG + """, g AS (SELECT name, max((ts, seq)) AS gone FROM changes WHERE op = 'remove' GROUP BY 1), a AS (SELECT c.* FROM changes c LEFT JOIN g USING (name) WHERE gone IS NULL OR (ts, seq) > gone), b AS (SELECT name, min((ts, seq)) AS born FROM a WHERE op = 'add' GROUP BY 1)
SELECT name, arg_max(value, (ts, seq)) AS value FROM a JOIN b USING (name) WHERE (ts, seq) = born OR (op = 'update' AND (ts, seq) > born) GROUP BY 1""")
def q_strict(spark, sf):
    """Sites, where adding again is rejected."""
    return R.current_state_strict(view(spark, sf, "changes"))


@query("history_tail", LOG + " SELECT name, seq FROM changes ORDER BY ts DESC, seq DESC LIMIT 50")
def q_tail(spark, sf):
    """O7."""
    return R.history_tail(view(spark, sf, "changes")).select("name", "seq")


@query("checked_registry", """WITH c AS (SELECT 'Supplier#' || lpad(CAST(user_id AS STRING), 9, '0') AS name, ts, event_id AS seq, event_type <> 'error' AS accessible, CASE WHEN event_id % 5 > 0 THEN value END AS rt, event_type AS err FROM events), l AS (SELECT name, arg_max(struct_pack(accessible, rt, err), (ts, seq)) AS c FROM c GROUP BY 1)
SELECT s_name AS name, CASE WHEN c IS NULL THEN 'pending' WHEN c.accessible AND c.rt IS NOT NULL THEN 'validated' ELSE 'failed' END AS status, c.rt AS response_time, CASE WHEN c IS NOT NULL AND NOT (c.accessible AND c.rt IS NOT NULL) THEN c.err END AS error_message FROM supplier LEFT JOIN l ON l.name = s_name""")
def q_checked(spark, sf):
    """J24."""
    checks = table(spark, sf, "events").selectExpr("'Supplier#' || lpad(CAST(user_id AS STRING), 9, '0') AS name", "ts", "event_id AS seq", "event_type <> 'error' AS accessible",
                                                  "CASE WHEN event_id % 5 > 0 THEN value END AS response_time", "event_type AS error")
    base = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("pending").alias("status"))
    return R.apply_checks(base, checks).drop("last_validated")


@query("attached_packs", "SELECT s_name AS name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS media_pack_count, (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey) AS last_media_scan FROM supplier")
def q_packs(spark, sf):
    """Media packs per name."""
    names = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    packs = table(spark, sf, "lineitem").join(names, F.col("l_suppkey") == F.col("s_suppkey")).select("name", F.col("l_shipdate").alias("found_at"))
    return R.attach_packs(names.select("name"), packs)


ROBOTS = "SELECT s_suppkey, s_name AS domain, unnest(range(1, 8)) AS line_no FROM supplier"
LINE = "CASE line_no WHEN 1 THEN 'User-Agent: *' WHEN 2 THEN 'Disallow: /Admin' || CAST(s_suppkey % 3 AS STRING) WHEN 3 THEN 'Allow: /' || CAST(s_suppkey % 5 AS STRING) WHEN 4 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'Crawl-delay: ' || CAST(s_suppkey % 7 AS STRING) ELSE 'Disallow:' END WHEN 5 THEN 'User-agent: Other' WHEN 6 THEN 'Disallow: /p' ELSE '' END"
RULES = f"""WITH l AS ({ROBOTS}), t AS (SELECT *, lower({LINE}) AS line FROM l), r AS (SELECT s_suppkey, domain, line_no, trim(split_part(line, ':', 1)) AS field, trim(regexp_replace(line, '^[^:]*:', '')) AS value FROM t WHERE line_no BETWEEN 2 AND 4)"""


def robots(spark, sf):
    lines = table(spark, sf, "supplier").selectExpr("s_suppkey", "s_name AS domain", "explode(sequence(1, 7)) AS line_no").selectExpr("domain", "line_no", f"{LINE} AS line")
    return R.robots_rules(lines)


@query("robots_rules", RULES + " SELECT domain, line_no, field, value FROM r WHERE value <> '' AND field IN ('allow', 'disallow', 'crawl-delay')")
def q_robots(spark, sf):
    """rules of an agent."""
    return robots(spark, sf)


@query("robots_compliance", RULES + """, p AS (SELECT s_suppkey, s_name AS domain, unnest(['/admin1/x', '/1', '/q']) AS path FROM supplier), v AS (SELECT p.domain, p.path, NOT coalesce(bool_or(r.field = 'disallow' AND starts_with(p.path, r.value)), false) AS allowed FROM p LEFT JOIN r ON r.domain = p.domain AND r.value <> '' GROUP BY ALL)
SELECT domain, count(*) AS total_paths, count(*) FILTER (allowed) AS allowed_count, count(*) FILTER (NOT allowed) AS blocked_count, (SELECT CAST(value AS DOUBLE) FROM r WHERE r.domain = v.domain AND field = 'crawl-delay') AS crawl_delay, count(*) FILTER (NOT allowed) = 0 AS compliant FROM v GROUP BY domain""")
def q_compliance(spark, sf):
    """verdicts and summary (no path here meets an allow and a disallow rule)."""
    rules = robots(spark, sf)
    paths = table(spark, sf, "supplier").select(F.col("s_name").alias("domain"), F.explode(F.array(F.lit("/admin1/x"), F.lit("/1"), F.lit("/q"))).alias("path"))
    return R.compliance(R.path_verdicts(paths, rules), R.crawl_delay(rules))
