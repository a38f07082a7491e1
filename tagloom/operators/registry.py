"""Brand and site registries: reading lines, folding change logs, applying checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.urls import url_problem

PRIORITIES = ["high", "medium", "low"]

# Bounds of the scraping parameters and their messages.
PARAMETER_BOUNDS = [
    ("request_delay", 0.5, 60, "at least 0.5 seconds", "exceed 60 seconds"),
    ("max_pages_per_session", 1, 10000, "at least 1", "exceed 10000"),
    ("concurrent_requests", 1, 5, "at least 1", "exceed 5 (avoid overwhelming servers)"),
    ("timeout_seconds", 5, 300, "at least 5", "exceed 300"),
]


def parse_lines(lines: DataFrame, form: str) -> DataFrame:
    """``Name|URL|Priority`` lines with a verdict per line.

    ``lines``: ``line_no``, ``line``.  Comments and blanks are skipped.  The
    ``brand`` form turns a bad priority into medium and wants a name and a
    website; the ``site`` form rejects a bad priority.
    """
    text = F.trim("line")
    parts = F.transform(F.split(text, r"\|"), lambda p: F.trim(p))
    rows = lines.select("line_no", text.alias("line"), parts.alias("p")).filter("line <> '' and not startswith(line, '#')")
    name, url = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    given = F.coalesce(F.get("p", F.lit(2)), F.lit("medium"))
    where = F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": "))
    short = F.size("p") < 2
    if form == "brand":
        error = F.when(short, F.concat(where, F.lit("Invalid format - "), "line")) \
            .when(name == "", F.concat(where, F.lit("Missing brand name"))) \
            .when(url == "", F.concat(where, F.lit("Missing website for "), name))
        priority = F.when(given.isin(PRIORITIES), given).otherwise("medium")
    elif form == "site":
        error = F.when(short, F.concat(where, F.lit("Invalid format (need at least Name|URL)"))) \
            .when(~given.isin(PRIORITIES), F.concat(where, F.lit("Invalid priority '"), given, F.lit("'")))
        priority = given
    else:
        raise ValueError(f"unknown form {form!r}")
    ok = error.isNull()
    return rows.select("line_no", F.when(ok, name).alias("name"), F.when(ok, url).alias("url"),
                       F.when(ok, priority).alias("priority"), error.alias("error"))


def parse_urls(lines: DataFrame) -> DataFrame:
    """URL lines without blanks and comments."""
    return lines.select("line_no", F.trim("line").alias("url")).filter("url <> '' and not startswith(url, '#')")


def parameter_errors() -> Column:
    """All range violations of a row's scraping parameters."""
    found = []
    for col, low, high, low_text, high_text in PARAMETER_BOUNDS:
        found.append(F.when(F.col(col) < low, F.lit(f"{col} must be {low_text}")))
        found.append(F.when(F.col(col) > high, F.lit(f"{col} cannot {high_text}")))
    return F.array_compact(F.array(*found))


def url_verdict(url: Column) -> Column:
    problem = url_problem(url)
    return F.struct((problem == "").alias("valid"), problem.alias("reason"))


def pick(registry: DataFrame, priority: str | None = None, status: str | None = None,
         active: bool | None = None) -> DataFrame:
    """Registry rows by priority, status or activity."""
    for col, wanted in (("priority", priority), ("status", status), ("active", active)):
        if wanted is not None:
            registry = registry.filter(F.col(col) == wanted)
    return registry


def processing_queue(registry: DataFrame) -> DataFrame:
    """High, medium, low, then by name."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return registry.orderBy(rank, "name")


def pack_queue(packs: DataFrame) -> DataFrame:
    """Media packs by type: archives first, unknown types last, given order inside."""
    from tagloom.functions.media import file_type_info
    return packs.select("*", file_type_info(F.col("file_type"), "priority").alias("type_priority")) \
        .orderBy("type_priority", "ord")


def current_state(changes: DataFrame) -> DataFrame:
    """Registry from its change log: the last event per name counts, removals drop out."""
    last = changes.groupBy("name").agg(F.max_by(F.struct("op", "value"), F.struct("ts", "seq")).alias("e"))
    return last.filter("e.op <> 'remove'").select("name", "e.value")


def current_state_strict(changes: DataFrame) -> DataFrame:
    """As :func:`current_state` where adding a present name is rejected.

    After the last removal the first add counts, then the last update following it.
    """
    at = F.struct("ts", "seq")
    removed = changes.filter("op = 'remove'").groupBy("name").agg(F.max(at).alias("gone"))
    alive = changes.join(removed, "name", "left").filter(F.col("gone").isNull() | (at > F.col("gone")))
    added = alive.filter("op = 'add'").groupBy("name").agg(F.min(at).alias("born"))
    valid = alive.join(added, "name").filter((at == F.col("born")) | ((F.col("op") == "update") & (at > F.col("born"))))
    return valid.groupBy("name").agg(F.max_by("value", at).alias("value"))


def history_tail(changes: DataFrame, keep: int = 50) -> DataFrame:
    """Latest changes first; the tail length is the feature."""
    return changes.orderBy(F.desc("ts"), F.desc("seq")).limit(keep)


def apply_checks(registry: DataFrame, checks: DataFrame) -> DataFrame:
    """Latest check per name written onto the registry.

    A name counts as validated if it was accessible and timed; otherwise it
    failed with the check's error.  Unchecked names stay as they are.
    """
    latest = checks.groupBy("name").agg(F.max_by(
        F.struct("accessible", "response_time", "error", "ts"), F.struct("ts", "seq")).alias("c"))
    good = F.coalesce(F.col("c.accessible"), F.lit(False)) & F.col("c.response_time").isNotNull()
    return registry.join(latest, "name", "left").select(
        "name", F.when(F.col("c").isNull(), F.col("status")).when(good, "validated").otherwise("failed").alias("status"),
        F.col("c.response_time").alias("response_time"), F.col("c.ts").alias("last_validated"),
        F.when(F.col("c").isNotNull() & ~good, F.coalesce("c.error", F.lit(""))).alias("error_message"))


def attach_packs(registry: DataFrame, packs: DataFrame) -> DataFrame:
    """Number of media packs and last scan per name."""
    counted = packs.groupBy("name").agg(F.count("*").alias("n"), F.max("found_at").alias("t"))
    return registry.join(counted, "name", "left").select(
        *registry.columns, F.coalesce("n", F.lit(0)).alias("media_pack_count"), F.col("t").alias("last_media_scan"))


def robots_rules(lines: DataFrame, agent: str = "*") -> DataFrame:
    """Allow, disallow and crawl-delay rules that hold for an agent.

    ``lines``: domain, line_no, line.  Lines are read in lower case; a rule
    belongs to the last ``user-agent`` line before it.  A robots file is one
    small document, so the window runs inside one domain's file.
    """
    from pyspark.sql import Window
    low = F.trim(F.lower("line"))
    field = F.trim(F.substring_index(low, ":", 1))
    value = F.trim(F.regexp_replace(low, "^[^:]*:", ""))
    w = Window.partitionBy("domain").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("domain", "line_no", field.alias("field"), value.alias("value"), low.contains(":").alias("rule")) \
        .filter("rule").select("*", F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(w).alias("agent"))
    return rows.filter(F.col("agent").isin("*", agent.lower()) & F.col("field").isin("allow", "disallow", "crawl-delay")
                       & (F.col("value") != "")).select("domain", "line_no", "field", "value")


def crawl_delay(rules: DataFrame) -> DataFrame:
    """First readable crawl delay per domain."""
    delay = F.col("value").try_cast("double")
    return rules.filter((F.col("field") == "crawl-delay") & delay.isNotNull()).groupBy("domain") \
        .agg(F.min_by(delay, F.col("line_no")).alias("crawl_delay"))


def agent_rules(lines: DataFrame, agent: str = "*") -> DataFrame:
    """The rules one agent has to obey: those of the first group that names it, else of the first ``*`` group.

    Consecutive ``user-agent`` lines share a group, a name holds for agents that contain it up to their ``/``,
    comments go, and paths keep their case.  An empty ``disallow`` forbids nothing.
    """
    from pyspark.sql import Window
    line = F.trim(F.regexp_replace("line", "#.*", ""))
    rows = lines.select("domain", "line_no", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"),
                        F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value"), line.contains(":").alias("rule"))
    rows = rows.filter(F.col("rule") & F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay")).drop("rule")
    order = Window.partitionBy("domain").orderBy("line_no")
    names = F.col("field") == "user-agent"
    begins = names & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mine, name = F.lit(agent.lower().split("/")[0]), F.lower("value")
    fits = F.when(name == "*", 2).when(F.contains(mine, name), 1)
    group = rows.filter(names & fits.isNotNull()).groupBy("domain").agg(F.min(F.struct(fits.alias("f"), "group"))["group"].alias("group"))
    return rows.filter(~names & (F.col("value") != "")).join(group, ["domain", "group"], "left_semi").select("domain", "line_no", "field", "value")


def path_verdicts(paths: DataFrame, rules: DataFrame, fold_case: bool = True) -> DataFrame:
    """Whether each path may be fetched: the first rule whose path it starts with.

    A domain's rules are one small document, so they meet its paths as one array.
    """
    rule = F.struct("line_no", (F.col("field") == "allow").alias("allowed"), "value")
    known = rules.filter("field <> 'crawl-delay'").groupBy("domain").agg(F.array_sort(F.collect_list(rule)).alias("_rules"))
    path = F.lower("path") if fold_case else F.col("path")
    first = F.get(F.filter("_rules", lambda r: F.startswith(path, r["value"])), F.lit(0))["allowed"]
    return paths.join(known, "domain", "left").select("domain", "path", F.coalesce(first, F.lit(True)).alias("allowed"))


def compliance(verdicts: DataFrame, delays: DataFrame) -> DataFrame:
    """Allowed and blocked paths per domain."""
    counted = verdicts.groupBy("domain").agg(
        F.count("*").alias("total_paths"), F.count_if("allowed").alias("allowed_count"),
        F.count_if(~F.col("allowed")).alias("blocked_count"))
    return counted.join(delays, "domain", "left").select("*", (F.col("blocked_count") == 0).alias("compliant"))
