import time

import pytest
from pyspark.sql import functions as F

from tagloom.functions import extract as X
from tagloom.functions.responses import parse_answer
from tagloom.functions.text import keyword_hits, keyword_match, similar_handle_audit, slug, tags_for_hits
from tagloom.operators import controlled as C, module_tagger as M
from tagloom.operators.validate import validate_all, validate_tag


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first()[0]


@pytest.mark.parametrize("text,mg", [
    ("Elf Bar 600 20mg", 20.0), ("Crystal Bar 10mg Strawberry", 10.0), ("Elf Bar 600 0mg", 0.0),
    ("Zero nicotine e-liquid", 0.0), ("20mg-5000", 20.0), ("1000mg gummies", None), ("", None), (None, None),
    ("50mg salt, nicotine: 12mg", 12.0), ("3.5mg", 3.5)])
def test_nicotine(spark, text, mg):
    assert one(spark, text, lambda c: X.nicotine_mg(c, F.lit("e-liquid"))) == mg


def test_cbd_products_have_no_nicotine(spark):
    assert one(spark, "CBD oil 20mg", lambda c: X.nicotine_mg(c, F.lit("CBD"))) == 0.0


@pytest.mark.parametrize("text,mg", [("CBD Gummies 1000mg", 1000.0), ("500 mg cbd", 500.0), ("60000mg cbd 10mg", None)])
def test_cbd(spark, text, mg):
    assert one(spark, text, X.cbd_mg) == mg


@pytest.mark.parametrize("text,ratio", [
    ("70VG/30PG", "70/30"), ("70/30", "70/30"), ("50/50", "50/50"), ("80VG 20PG", "80/20"), ("100VG", "100/0"),
    ("100 pg", "0/100"), ("70vg", "70/30"), ("60PG", "40/60"), ("30/70", "70/30"), ("12/34", None)])
def test_ratio(spark, text, ratio):
    assert one(spark, text, X.vg_ratio) == ratio


@pytest.mark.parametrize("text,tags", [
    ("Vaporesso GTX 12ml Pod", []), ("Tank 2ml or 5ml options", ["2ml", "5ml"]), ("2.5ml", ["2.5ml", "5ml"])])
def test_capacity(spark, text, tags):
    assert one(spark, text, X.capacity_tags) == tags


@pytest.mark.parametrize("text,words,hit", [
    ("Nicotine Pouches", ["nicotine pouch"], True), ("device", ["ice"], False), ("éice", ["ice"], False),
    ("box!", ["box"], True), ("boxes", ["box"], True), ("airpod case", ["pod"], False), ("a  b", ["a b"], False)])
def test_keywords_agree(spark, text, words, hit):
    assert one(spark, text, lambda c: keyword_match(c, words)) is hit
    assert bool(one(spark, text, lambda c: tags_for_hits(keyword_hits(c, words), {"t": words}))) is hit


def test_hits_equal_each_keywords_regex(spark):
    words = ["pod kit", "kit", "pod", "0.5 ohm", "nic salt e-liquid", "e-liquid", "salt", "salt e", "a a", "liquid"]
    texts = ["pod kit pod", "Pod Kits", "pod  kit", "kit pod", "0.5 ohm 0.5 ohms", "10.5 ohm", "nic salt e-liquid", "nic salt e-", "salt",
             "a a a", "e-liquids e", "-e-liquid-", "salt e", "", "  ", "pod-kit", "nic nic salt e-liquid"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", keyword_hits(F.col("t"), words).alias("hits"),
        *[keyword_match(F.col("t"), [w]).alias(f"w{i}") for i, w in enumerate(words)]).collect()
    for row in got:
        met = [bool(one_word) for one_word in row[2:]]
        forms = {w for h in row.hits for w in words if h in (w, w + "s")}
        assert [w in forms for w in words] == met, row.t


def test_a_long_keyword_costs_only_where_it_may_begin(spark):
    texts = spark.range(0, 80, 1, 4).select(F.repeat(F.concat(F.lit("w"), "id", F.lit(" ")), 4000).alias("t"))

    def seconds(words):
        began = time.monotonic()
        texts.select(F.size(keyword_hits(F.col("t"), words)).alias("n")).agg(F.sum("n")).collect()
        return time.monotonic() - began

    seconds(["w3"])
    assert seconds(["w3", " ".join(["word"] * 60)]) < 5 * seconds(["w3"]) + 5


def test_controlled_profile(spark):
    df = spark.createDataFrame([
        ("cbd-oil", "CBD Oil Tincture 500mg Broad Spectrum", ""), ("airpod", "Airpod case", ""),
        ("juice", "Strawberry Ice 50ml Shortfill 70/30 vg/pg e-liquid 0mg", ""), ("pod-kit", "Compact pod kit", "")],
        "handle string, title string, description string")
    got = {r.handle: r for r in C.tag_controlled(df).collect()}
    assert got["cbd-oil"].final_tags[0] == "CBD" and {"500mg", "oil", "broad_spectrum"} <= set(got["cbd-oil"].final_tags)
    assert got["airpod"].category == "accessory" and "case" in got["airpod"].final_tags
    assert got["juice"].category == "e-liquid" and {"shortfill", "70/30", "restricted-direct-to-lung"} <= set(got["juice"].final_tags)
    assert got["pod-kit"].category == "pod_system"


def test_module_profile(spark):
    df = spark.createDataFrame([
        ("a", "CBD Gummies 1000mg Full Spectrum", "", "CBD products", ""), ("b", "Blue Razz 600 Puff Disposable 20mg", "", "x", ""),
        ("c", "Compact Pod System Kit", "", "x", ""), ("d", "Nothing here", "", "x", ""), ("e", "Bottle", "", "x", "Vape > E-Liquid")],
        "handle string, title string, description string, type string, product_category string")
    got = {r.handle: r for r in M.tag_by_rules(df).collect()}
    assert got["a"].category == "CBD" and got["a"].rule_tags == ["1000mg", "full_spectrum", "gummy"]
    assert got["b"].category == "disposable" and set(got["b"].rule_tags) == {"20mg", "candy/sweets"}
    assert got["c"].category == "pod_system" and "compact" in got["c"].rule_tags
    assert got["d"].needs_manual_review and got["d"].rule_tags == [] and got["d"].failure_reasons
    assert got["e"].category == "e-liquid"


def test_validation(spark):
    df = spark.createDataFrame([(["20mg", "60000mg", "ice", "nope"],)], "tags array<string>")
    row = df.select(F.transform("tags", lambda t: validate_tag(t, F.lit("e-liquid"))["valid"]).alias("v"),
                    validate_all(F.col("tags"), F.lit("e-liquid")).alias("r"),
                    validate_all(F.col("tags"), F.lit("CBD")).alias("c")).first()
    assert row.v == [True, False, True, False]
    assert row.r[-1] == "Illegal nicotine strength 60000.0mg detected (max 20mg)"
    assert row.c[1] == "Tag '60000mg' value 60000.0 outside range [0, 50000] for dimension 'cbd_strength'" or \
        "Tag '60000mg' value 60000.0 outside range [0, 50000] for dimension 'cbd_strength'" in row.c


@pytest.mark.parametrize("text,tags,confidence", [
    ('{"tags": ["a"], "confidence": 0.9}', ["a"], 0.9), ('```json\n{"tags": ["a"], "confidence": 0.9}\n```', ["a"], 0.9),
    ('Sure {"tags": ["b"], "confidence": 0.6} ok', ["b"], 0.6), ('tags: ["x", \'y\']', ["x", "y"], 0.5)])
def test_answers(spark, text, tags, confidence):
    answer = one(spark, text, parse_answer)
    assert answer.tags == tags and answer.confidence == confidence


def test_garbage_answer(spark):
    assert one(spark, "no idea", parse_answer) is None


def test_names(spark):
    assert one(spark, " Blue  Razz (20mg)! ", slug) == "blue-razz-20mg"
    assert one(spark, "Pod_Kit-10ml-blue", similar_handle_audit) == "pod kit"


def test_rows_of_one_split_are_tagged_by_all_cores(spark):
    from pyspark.sql import functions as F
    from tagloom.operators import controlled as C, module_tagger as M
    rows = spark.range(400).coalesce(1).selectExpr("concat('h', id) AS handle", "'pod kit 10ml' AS title", "'nic salt' AS description")
    for made in (M.tag_by_rules(rows), C.tag_controlled(rows)):
        shares = made.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(shares) >= 4 and sum(r["count"] for r in shares) == 400 and max(r["count"] for r in shares) <= 200
