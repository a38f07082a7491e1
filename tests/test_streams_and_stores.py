import csv
import datetime as dt

from pyspark.sql import functions as F

from tagloom.operators import assets, cache, health as H, registry, route
from tagloom.operators.improve import improve
from tagloom.sources import files
from tagloom.sources.store import AuditStore
from tagloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def check_rows():
    codes = [200, 503, 429, None, 404, 503, 200, 403, 503, 503, None, 503, 503, 503, 503, 200, 404]
    return [("a" if i % 3 else "hot", T0 + dt.timedelta(minutes=7 * i), i, float(10 * i), codes[i % len(codes)]) for i in range(400)]


CHECKS = "site string, ts timestamp, seq long, response_time_ms double, status_code int"


def simulate(rows):
    state, out = {}, {}
    for site, ts, seq, ms, code in rows:
        s = state.setdefault(site, jobs._start())
        jobs._apply(s, "check", ts.timestamp(), ms, code)
        out[seq] = (s["failures"], s["backoff"], round(sum(s["times"]) / len(s["times"]), 6), sum(c in H.BLOCKING for c in s["codes"]))
    return out


def seen(df):
    return {r.seq: (r.failures, r.backoff_s, round(r.avg_ms, 6), r.recent_blocks) for r in df.collect()}


def test_health_batch_and_stream_agree(spark, tmp_path):
    rows = check_rows()
    df = spark.createDataFrame(rows, CHECKS)
    want = simulate(rows)
    assert seen(H.health_history(df, chunk=110)) == want
    assert seen(H.health_history(df.repartition(9))) == want
    for n in range(4):  # four micro-batches
        part = spark.createDataFrame(rows[n * 100:(n + 1) * 100], CHECKS).withColumn("kind", F.lit("check"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert seen(jobs.run_once(jobs.health_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))) == want


def test_access_clears_an_expired_backoff():
    s = jobs._start()
    jobs._apply(s, "check", 0, 1.0, 503)
    jobs._apply(s, "check", 10, 1.0, 503)
    assert s["backoff"] == 120
    jobs._apply(s, "access", 50, None, None)
    assert s["backoff"] == 120
    jobs._apply(s, "access", 130, None, None)
    assert s["backoff"] is None
    jobs._apply(s, "check", 140, 1.0, None)
    assert s["backoff"] == 60


def test_store_runs_and_latest(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "audit"))
    for run in ("r1", "r2", "r3"):
        store.start_run(run, {"limit": "5"})
        store.append(run, spark.createDataFrame([(f"{run}-{i}", ["ice"]) for i in range(2)], "handle string, final_tags array<string>"))
        if run != "r3":
            store.complete_run(run)
    assert {r.run_id for r in store.products().collect()} == {"r2"}
    assert store.products("r3").count() == 2 and store.products(all_runs=True).count() == 6
    assert {r.run_id: r.status for r in store.runs().collect()} == {"r1": "completed", "r2": "completed", "r3": "running"}
    store.clear()
    assert store.products(all_runs=True).count() == 0


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Handle", "Title", "Body (HTML)", "SKU", "Option1 Linked To"])
        w.writerow(["a", "One", "<p>x\n\"quoted\", y</p>", "007", "z"])
        w.writerow(["b", "nan", "", "", ""])
    rows = {r.handle: r for r in files.read_products(spark, str(path)).collect()}
    assert rows["a"].variant_sku == "007" and rows["a"].description == "<p>x\n\"quoted\", y</p>"
    assert rows["b"].title == "" and rows["b"].vendor == ""
    out = str(tmp_path / "out")
    tiers = spark.createDataFrame([("a", "ice", "clean"), ("b", "", "untagged")], "handle string, tags string, tier string")
    files.write_tiers(tiers, out)
    assert {(r.handle, r.tier) for r in spark.read.option("header", True).csv(out).collect()} == {("a", "clean"), ("b", "untagged")}
    appended = str(tmp_path / "app")
    files.append_aligned(tiers.select("handle", "tags"), appended)
    files.append_aligned(spark.createDataFrame([("c", "x")], "handle string, other string"), appended)
    got = spark.read.option("header", True).csv(appended)
    assert {tuple(r[c] or "" for c in ("handle", "tags", "other")) for r in got.collect()} == {("a", "ice", ""), ("b", "", ""), ("c", "", "x")}
    files.append_aligned(spark.createDataFrame([("d",)], "handle string"), appended)
    assert spark.read.option("header", True).csv(appended).count() == 4
    assert rows["a"]["Option1 Linked To"] == "z"


def test_rejects_and_required_columns(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\n1,2,3,4\n")
    assert files.read_csv(spark, str(path), tolerant=True).count() in (1, 2)
    try:
        files.require_columns(spark.range(1), ["Handle"])
    except ValueError as error:
        assert "Handle" in str(error)
    else:
        raise AssertionError("missing column accepted")


def test_lines_and_inventory(spark, tmp_path):
    (tmp_path / "brands.txt").write_text("# c\nSmok | smok.com | high\n\nBad\n")
    from tagloom.operators.registry import parse_lines, parse_urls
    lines = files.read_lines(spark, str(tmp_path / "brands.txt"))
    got = {r.line_no: r for r in parse_lines(lines, "brand").collect()}
    assert got[2].name == "Smok" and got[4].error == "Line 4: Invalid format - Bad"
    assert parse_urls(lines).count() == 2
    folder = tmp_path / "img" / "smok" / "shop"
    folder.mkdir(parents=True)
    (folder / "a.png").write_bytes(b"123")
    (folder / "b.txt").write_bytes(b"1")
    row = files.file_inventory(spark, str(tmp_path / "img")).collect()
    assert [(r.brand, r.site, r.name, r.size) for r in row] == [("smok", "shop", "a.png", 3)]


def test_json_and_inventories(spark, tmp_path):
    df = spark.createDataFrame([("s1", "b", "c", [("x", 1.0)])], "site string, brand string, category string, media array<struct<id:string,q:double>>")
    files.write_json(df, str(tmp_path / "j"))
    assert files.read_inventories(spark, str(tmp_path / "j"), df.schema, site="s1").collect() == df.collect()
    assert files.read_inventories(spark, str(tmp_path / "j"), df.schema, brand="none").count() == 0
    files.write_jsonl(df, str(tmp_path / "l"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "l")).count() == 1


def test_cache_and_incremental_batches(spark, tmp_path):
    path = str(tmp_path / "cache")
    merge = jobs.append_cache_batch(path)

    def batch(day, tag):
        return spark.createDataFrame([("k", [tag], dt.datetime(2024, 1, day))], "content_hash string, tags array<string>, cached_at timestamp")

    merge(batch(1, "old"), 0)
    merge(batch(3, "late"), 1)
    merge(batch(2, "new"), 1)  # a repeated epoch takes its own place
    assert [r.tags for r in jobs.read_cache(spark, path).collect()] == [["new"]]
    jobs.compact_cache(spark, path, str(tmp_path / "compact"))
    assert [r.tags for r in jobs.read_cache(spark, str(tmp_path / "compact")).collect()] == [["new"]]


def test_only_new_handles_are_tagged(spark, tmp_path):
    source, done = str(tmp_path / "in"), str(tmp_path / "done")
    batches = [[("a", 2, None), ("b", 1, 1.5), ("a", 1, None)], [("a", 0, 9.0), ("c", None, None)], [("b", 7, 1.0)]]
    schema = "handle string, n long, x double"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for rows in batches:  # a run for each batch: what was seen is kept in the checkpoint alone
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            jobs.tag_new(stream, lambda df: df.withColumn("tags", F.lit("t")), done, str(tmp_path / "cp"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.handle, r.n, r.x, r.tags) for r in spark.read.parquet(done).collect()}
    assert got == {("a", 1, None, "t"), ("b", 1, 1.5, "t"), ("c", None, None, "t")}


def test_tag_use_follows_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "final_tags array<string>, processed_at date"
    for day, tags in [(1, ["ice", "cola"]), (3, ["ice"]), (2, ["mint", "ice"])]:
        spark.createDataFrame([(tags, dt.date(2024, 1, day))], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.upsert(jobs.tag_use_stream(spark.readStream.schema(schema).parquet(source)), out, str(tmp_path / "cp"))
    got = {r.tag: (r.frequency, r.first_used.day, r.last_used.day) for r in jobs.read_upserts(spark, out, ["tag"]).collect()}
    assert got == {"ice": (3, 1, 3), "cola": (1, 1, 1), "mint": (1, 2, 2)}


def test_rows_are_numbered_over_files_and_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for name, n in (("b.txt", 4000), ("a.txt", 10), ("c.txt", 1)):
        (folder / name).write_text("".join(f"{name}-{i}\r\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        lines = files.read_lines(spark, str(folder)).collect()
        rows = files.numbered(spark.read.text(str(folder)), "place")
        assert rows.rdd.getNumPartitions() > 4 or rows.count() == 4011
        places = [r.value for r in sorted(rows.collect(), key=lambda r: r.place)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(lines) == 4011 and all(r.line == f"{r.file[-5:]}-{r.line_no - 1}" for r in lines)
    assert places == [f"{name}-{i}" for name, n in (("a.txt", 10), ("b.txt", 4000), ("c.txt", 1)) for i in range(n)]


def test_malformed_records_go_whatever_is_read(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text('a,b\n1,2\n1,2,3,4\n"x\ny",5\n')
    kept = files.read_csv(spark, str(path), tolerant=True)
    assert kept.count() == 2 and {r.a for r in kept.select("a").collect()} == {"1", "x\ny"}
    assert [r._corrupt.strip() for r in files.read_rejects(spark, str(path), ["a", "b"]).collect()] == ["1,2,3,4"]


def test_long_lists_keep_positions_and_products(spark):
    rows = spark.range(12_000).selectExpr("'h' AS handle", "'T' AS title", "concat('i', id) AS image", "id AS ord")
    got = route.image_rows(route.consolidate(rows)).agg(F.count("*"), F.min("image_position"), F.max("image_position"), F.count_distinct("image_position"), F.count("title")).first()
    assert tuple(got) == (12_000, 1, 12_000, 12_000, 1)
    media = spark.range(12_000).selectExpr("'p' AS group_id", "concat('a', id) AS asset_id", "'s' AS source", "1 AS source_priority", "CASE WHEN id = 0 THEN 9.5 ELSE 7.5 END AS quality_score", "id AS ord")
    product = spark.createDataFrame([("p", "n", "b", "m", ["c"], "s", 1)], "product_id string, name string, brand string, model_number string, categories array<string>, primary_source string, source_count int")
    found = assets.filter_catalog(assets.build_catalog(product, media), min_quality=9.0)
    assert found.agg(F.sum(F.size("media_assets")), F.count_distinct("product_id")).first()[:] == (12_000, 1)


def test_improvement_stops_at_the_target(spark):
    base = spark.createDataFrame([("a", ["x"], True, 0.2), ("b", ["x"], True, 0.9), ("c", ["x"], False, 0.9)],
                                 "handle string, tags array<string>, needs_manual_review boolean, ai_confidence double")
    answers = spark.createDataFrame([("a", 1, ["y"], 0.8, False), ("b", 1, ["y"], 0.5, False), ("b", 2, ["z"], 0.95, False)],
                                    "handle string, round int, tags array<string>, confidence double, needs_manual_review boolean")
    got = {r.handle: r.tags for r in improve(base, answers, 1.0, 5).collect()}
    assert got == {"a": ["y"], "b": ["z"], "c": ["x"]}


def test_cache_misses_and_images(spark):
    p = spark.createDataFrame([("t", "d"), ("u", "e")], "title string, description string")
    known = p.limit(1).select(cache.content_hash(F.col("title"), F.col("description")).alias("content_hash"))
    assert cache.misses(p, known).count() == 1
    rows = spark.createDataFrame([("h", ["i1", "i2"], "T"), ("g", [], "U")], "handle string, images array<string>, title string")
    got = [(r.handle, r.title, r.image_src, r.image_position) for r in route.image_rows(rows).filter("image_src is not null").orderBy("image_position").collect()]
    assert got == [("h", "T", "i1", 1), ("h", None, "i2", 2)]


def test_an_agent_obeys_its_own_group(spark):
    text = ["User-agent: *", "Disallow: /Private # all", "Crawl-delay: 2", "", "User-agent: Good", "User-agent: Fine", "Allow: /Private/open", "Disallow: /Private", "", "User-agent: free", "Disallow:"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "domain string, line_no int, line string")
    paths = spark.createDataFrame([("d", "/Private/open/x"), ("d", "/Private/x"), ("d", "/private/x"), ("e", "/x")], "domain string, path string")

    def allowed(agent):
        return [r.allowed for r in registry.path_verdicts(paths, registry.agent_rules(lines, agent), fold_case=False).orderBy("domain", "path").collect()]

    assert allowed("GoodBot/1.0") == [True, False, True, True]
    assert allowed("fine") == [True, False, True, True]
    assert allowed("other") == [False, False, True, True]
    assert allowed("free") == [True, True, True, True]
