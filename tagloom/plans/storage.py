"""Queries that write tables in the source's file formats and read them back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagloom.plans.registry import query
from tagloom.plans.views import cte, table, view
from tagloom.session import shared_dir
from tagloom.sources import files
from tagloom.sources.store import AuditStore


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


BODY = "'<p>It is \"' || lower(type) || '\", they say,' || chr(10) || description || '</p>'"


@query("csv_products", cte("products") + f""" SELECT handle, title, {BODY} AS description, vendor, lpad(CAST(ord AS VARCHAR), 9, '0') AS variant_sku,
 row_number() OVER (ORDER BY ord) - 1 AS ord FROM products""")
def q_csv(spark, sf):
    """Quoted bodies over several lines, SKUs as text, row numbers over several files."""
    path = _folder(spark)
    rows = view(spark, sf, "products").select("ord", F.col("handle").alias("Handle"), F.col("title").alias("Title"), F.expr(BODY).alias("Body (HTML)"),
                                              F.col("vendor").alias("Vendor"), F.lpad(F.col("ord").cast("string"), 9, "0").alias("SKU"))
    (rows.repartitionByRange(5, "ord").sortWithinPartitions("ord").drop("ord")
     .write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    return files.read_products(spark, path).select("handle", "title", "description", "vendor", "variant_sku", "ord")


@query("csv_rejects", "SELECT p_partkey % 7 = 0 AS rejected, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM part GROUP BY 1")
def q_rejects(spark, sf):
    """Every seventh record has two fields too many; the reader leaves it out, and it is kept apart as text."""
    path = _folder(spark)
    line = F.expr("CAST(p_partkey AS STRING) || ',' || p_brand || CASE WHEN p_partkey % 7 = 0 THEN ',more,fields' ELSE '' END")
    table(spark, sf, "part").select(line.alias("Handle,Title")).write.option("header", True).option("sep", "\t").csv(path)
    kept = files.read_csv(spark, path, tolerant=True).select(F.lit(False).alias("rejected"), F.col("Handle").cast("long").alias("key"))
    out = files.read_rejects(spark, path, ["Handle", "Title"]).select(F.lit(True).alias("rejected"), F.substring_index("_corrupt", ",", 1).cast("long").alias("key"))
    return kept.unionByName(out).groupBy("rejected").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("text_lines", "SELECT p_partkey AS key, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS line_no FROM part")
def q_lines(spark, sf):
    """Line numbers of three files, each longer than a split when splits are small."""
    path = _folder(spark)
    rows = table(spark, sf, "part").select((F.col("p_partkey") % 3).alias("part"), F.col("p_partkey").alias("key"))
    (rows.repartition("part").sortWithinPartitions("part", "key").select(F.col("key").cast("string").alias("value"), "part")
     .write.partitionBy("part").text(path))
    return files.read_lines(spark, f"{path}/*/*.txt").select(F.col("line").cast("long").alias("key"), "line_no")


@query("json_registry", cte("registry") + " SELECT name, url, priority, status, active, request_delay FROM registry")
def q_json(spark, sf):
    """A registry as JSON, read with its schema."""
    path = _folder(spark)
    rows = view(spark, sf, "registry").select("name", "url", "priority", "status", "active", "request_delay")
    files.write_json(rows, path)
    return files.read_json(spark, path, rows.schema, lines=True)


@query("cleared_store", cte("audit") + " SELECT run_id, count(*) AS before, 0 AS after FROM audit GROUP BY run_id")
def q_clear(spark, sf):
    """A store of products by run, counted before and after it is cleared."""
    root = _folder(spark)
    store = AuditStore(spark, f"{root}/store")
    rows = view(spark, sf, "audit").select("handle", "final_tags", "run_id")
    store.start_run("all")
    store.append_runs(rows)

    def counted(name):
        return store.products(all_runs=True).groupBy("run_id").agg(F.count("*").alias(name))

    counted("before").write.parquet(f"{root}/before")
    store.clear()
    before = spark.read.parquet(f"{root}/before")
    return before.join(counted("after"), "run_id", "left").select("run_id", "before", F.coalesce("after", F.lit(0)).cast("int").alias("after"))


@query("json_products", cte("products") + """ SELECT handle, title, array_to_string(list_sort([vendor, type]), '|') AS tags, price AS amount FROM products""")
def q_json_sink(spark, sf):
    """Products with nested values as JSON lines."""
    path = _folder(spark)
    rows = view(spark, sf, "products").select("handle", "title", F.array_sort(F.array("vendor", "type")).alias("tags"), F.struct(F.col("price").alias("amount")).alias("price"))
    files.write_jsonl(rows, path)
    return files.read_json(spark, path, rows.schema, lines=True).select("handle", "title", F.array_join("tags", "|").alias("tags"), F.col("price.amount").alias("amount"))


@query("appended_rows", """SELECT 'p-' || p_partkey AS handle, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS tags, CASE WHEN p_partkey % 2 = 1 THEN p_name ELSE '' END AS title FROM part""")
def q_append(spark, sf):
    """Rows of two shapes appended to one output."""
    path = _folder(spark)
    parts = table(spark, sf, "part").select(F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("handle"), "p_partkey", "p_brand", "p_name")
    files.append_aligned(parts.filter("p_partkey % 2 = 0").select("handle", F.col("p_brand").alias("tags")), path)
    files.append_aligned(parts.filter("p_partkey % 2 = 1").select("handle", F.col("p_name").alias("title")), path)
    rows = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    return rows.select("handle", *[F.coalesce(c, F.lit("")).alias(c) for c in ("tags", "title")])


@query("files_by_folder", "SELECT 'region=' || c_nationkey % 5 AS brand, 'nation=' || c_nationkey AS site, sum(length(c_name) + 1)::BIGINT AS size FROM customer GROUP BY 1, 2")
def q_inventory(spark, sf):
    """Files under two levels of folders with their sizes; contents are not read."""
    path = _folder(spark)
    (table(spark, sf, "customer").select(F.col("c_name").alias("value"), (F.col("c_nationkey") % 5).alias("region"), F.col("c_nationkey").alias("nation"))
     .write.partitionBy("region", "nation").text(path))
    return files.file_inventory(spark, path, ["txt"]).groupBy("brand", "site").agg(F.sum("size").alias("size"))
