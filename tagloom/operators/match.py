"""The same product in two sources: best match per left product.

A pair's score is the best of four weighted methods, and each method looks at
one key of a product only (name, brand and model, image, specifications).  The
best pair over all methods is therefore the best of each method's best, so every
method works on distinct keys, remembers the first product per key, and
products are joined back at the end.  Neither products nor equal names are ever
paired with each other one by one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.similarity import ratio_join
from tagloom.functions.text import WORD, squeeze

# Fixed values.
NOISE = ["the", "kit", "vape", "e-cigarette", "device"]
MODEL_PATTERNS = [r"(?i)\b([A-Z]+[\s-]?\d+[A-Z]?)\b", r"(?i)\b(V\d+)\b", r"(?i)\b(\d+(?:mg|ml|w))\b"]
LEAST = 0.70
WEIGHTS = {"exact_name": 1.0, "brand_model": 0.9, "image_hash": 0.8, "specifications": 0.7}


def normalise_name(name: Column) -> Column:
    """Lower case, noise words out, blanks squeezed."""
    low = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    return squeeze(F.regexp_replace(low, f"(?<!{WORD})(?:{'|'.join(NOISE)})(?!{WORD})", ""))


def model_number(title: Column) -> Column:
    """First model-like token in upper case, NULL if none."""
    found = [F.regexp_extract(F.coalesce(title, F.lit("")), p, 1) for p in MODEL_PATTERNS]
    return F.upper(F.coalesce(*[F.when(f != "", f) for f in found]))


def spec_map(specifications: Column, description: Column) -> Column:
    """Given specifications plus capacity and power read from the description.
    ``5 with`` reads as 5w, as in the source."""
    ml = F.regexp_extract(F.coalesce(description, F.lit("")), r"(?i)(\d+(?:\.\d+)?)\s*ml", 1)
    watt = F.regexp_extract(F.coalesce(description, F.lit("")), r"(?i)(\d+)\s*w", 1)
    read = F.map_from_entries(F.array_compact(F.array(
        F.when(ml != "", F.struct(F.lit("capacity").alias("k"), F.concat(ml, F.lit("ml")).alias("v"))),
        F.when(watt != "", F.struct(F.lit("power").alias("k"), F.concat(watt, F.lit("w")).alias("v"))))))
    given = F.map_filter(F.coalesce(specifications, F.create_map().cast("map<string,string>")),
                         lambda k, v: ~F.map_contains_key(read, k))
    return F.map_concat(given, read)


def spec_score(a: Column, b: Column) -> Column:
    """Share of common keys with equal values, 0 without a common key."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    equal = F.filter(common, lambda k: F.element_at(a, k) == F.element_at(b, k))
    return F.coalesce(F.try_divide(F.size(equal), F.size(common)), F.lit(0.0))


def image_score(a: Column, b: Column) -> Column:
    """Share of equal md5 digits of two image URLs; 0 if one is missing."""
    digits = F.zip_with(F.split(F.md5(a), ""), F.split(F.md5(b), ""), lambda x, y: (x == y) & (x != ""))
    share = F.size(F.filter(digits, lambda d: d)) / F.lit(32.0)
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(missing, 0.0).when(a == b, 1.0).otherwise(share)


def brand_model_score(brand: Column, model: Column) -> Column:
    """Mean of brand and model similarity; without both models 0.7 of the brand's."""
    return F.when(model.isNotNull(), (brand + model) / 2).otherwise(brand * 0.7)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.90, "high").when(score >= 0.75, "medium").otherwise("low")


def _prepared(products: DataFrame) -> DataFrame:
    return products.select(
        "id", "ord", normalise_name(F.col("title")).alias("name"), normalise_name(F.col("brand")).alias("brand"),
        model_number(F.col("title")).alias("model"), F.coalesce("image_url", F.lit("")).alias("image"),
        # sorted entries compare and group, maps do not
        F.array_sort(F.map_entries(spec_map(F.col("specifications"), F.col("description")))).alias("specs"))


def _first(right: DataFrame, *keys: str) -> DataFrame:
    return right.groupBy(*keys).agg(F.min("ord").alias("first"))


def _best(df: DataFrame, keys: list[str]) -> DataFrame:
    """Highest score per key, then the first right product."""
    return df.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("first")).alias("neg"))).alias("b")) \
        .select(*keys, F.col("b.score").alias("score"), (-F.col("b.neg")).alias("first"))


def _name_best(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Equal names score 1, which nothing beats; the others are searched for near names."""
    names = left.filter("name <> ''").select("name").distinct()
    known = _first(right.filter("name <> ''"), "name")
    same = names.join(known, "name").select("name", F.lit(1.0).alias("score"), "first")
    if least >= 1:
        return same
    rest = names.join(known, "name", "left_anti").select(F.col("name").alias("text"))
    near = ratio_join(rest, known.select(F.col("name").alias("text")), least)
    scored = near.join(known.withColumnRenamed("name", "b"), "b").select(F.col("a").alias("name"), F.col("ratio").alias("score"), "first")
    return same.unionByName(_best(scored, ["name"]))


def _brand_best(left: DataFrame, right: DataFrame, least_score: float) -> DataFrame:
    """Best right product per brand and model.

    The score reaches the threshold of 0.70 only if brand and model each reach 0.556;
    the brand alone never does.  Equal brand and model score the most, so only
    keys without an equal go through near brands and near models.
    """
    weight = WEIGHTS["brand_model"]
    least = 2 * least_score / weight - 1
    keys = left.filter("brand <> '' and model is not null").select("brand", "model").distinct()
    known = _first(right.filter("brand <> '' and model is not null"), "brand", "model")
    same = keys.join(known, ["brand", "model"]).select("brand", "model", F.lit(weight).alias("score"), "first")
    rest = keys.join(known, ["brand", "model"], "left_anti")

    def near(col: str) -> DataFrame:
        return ratio_join(rest.select(F.col(col).alias("text")).distinct(),
                          known.select(F.col(col).alias("text")).distinct(), least) \
            .select(F.col("a").alias(col), F.col("b").alias(f"{col}_r"), F.col("ratio").alias(f"{col}_s"))

    pairs = rest.join(near("brand"), "brand").join(near("model"), "model").filter(
        F.col("brand_s") + F.col("model_s") >= 2 * least_score / weight - 1e-9)
    scored = pairs.join(known.select(F.col("brand").alias("brand_r"), F.col("model").alias("model_r"), "first"),
                        ["brand_r", "model_r"]).select(
        "brand", "model", (brand_model_score(F.col("brand_s"), F.col("model_s")) * weight).alias("score"), "first")
    return same.unionByName(_best(scored.filter(F.col("score") >= least_score), ["brand", "model"]))


def _image_best(right: DataFrame) -> DataFrame:
    """Equal image URLs.  Different URLs would need 28 of 32 equal md5 digits."""
    return _first(right.filter("image <> ''"), "image").select("image", F.lit(WEIGHTS["image_hash"]).alias("score"), "first")


def _spec_best(left: DataFrame, right: DataFrame) -> DataFrame:
    """Specifications agreeing in every common key; weight 0.7 accepts nothing less.

    Candidates share a (key, value); the first right product per distinct set of
    specifications is enough.
    """
    def exploded(df: DataFrame) -> DataFrame:
        return df.select("*", F.explode("specs").alias("entry"))

    l = exploded(left.filter(F.size("specs") > 0).select("specs").distinct())
    r = exploded(_first(right.filter(F.size("specs") > 0), "specs")).select(
        F.col("specs").alias("specs_r"), "first", "entry")
    score = spec_score(F.map_from_entries("specs"), F.map_from_entries("specs_r"))
    return l.join(r, "entry").filter(score == 1.0).groupBy("specs").agg(F.min("first").alias("first")) \
        .select("specs", F.lit(WEIGHTS["specifications"]).alias("score"), "first")


def match_products(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """Best match per left product at ``least`` (0.70 as in the source, or more).  Methods that cannot score so
    much are not run: at 1.0 equal names are all there is.

    Both sides: ``id``, ``ord``, ``title``, ``brand``, ``image_url``,
    ``description``, ``specifications`` (map).  Ties go to the first right
    product, then to the method order.
    """
    l, r = _prepared(left), _prepared(right)
    makers = {"exact_name": lambda: _name_best(l, r, least), "brand_model": lambda: _brand_best(l, r, least),
              "image_hash": lambda: _image_best(r), "specifications": lambda: _spec_best(l, r)}
    keys = {"exact_name": ["name"], "brand_model": ["brand", "model"], "image_hash": ["image"], "specifications": ["specs"]}
    able = [m for m, weight in WEIGHTS.items() if weight >= least]

    def renamed(df: DataFrame, n: int) -> DataFrame:
        return df.withColumnsRenamed({"score": f"s{n}", "first": f"o{n}"})

    joined = l
    for n, method in enumerate(able, 1):
        joined = joined.join(renamed(makers[method](), n), keys[method], "left")
    options = F.array(*[F.when(F.col(f"s{n}") >= least, F.struct(
        (-F.col(f"s{n}")).alias("neg"), F.col(f"o{n}").alias("o"), F.lit(n).alias("n"), F.lit(m).alias("method")))
        for n, m in enumerate(able, 1)])
    best = F.array_min(F.array_compact(options))
    picked = joined.select("id", "ord", best.alias("b")).filter(F.col("b").isNotNull())
    return picked.join(right.select(F.col("id").alias("right_id"), F.col("ord").alias("_o")),
                       F.col("b.o") == F.col("_o")).select(
        F.col("id").alias("left_id"), "right_id", (-F.col("b.neg")).alias("match_score"),
        F.col("b.method").alias("match_method"), confidence(-F.col("b.neg")).alias("confidence"))


def unify(matches: DataFrame, left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """One product per matched pair, the left side leading, with both sources."""
    pairs = matches.groupBy("left_id", "right_id").agg(F.max("match_score").alias("match_score"))

    def side(df: DataFrame, name: str, p: str) -> DataFrame:
        return df.select(
            F.col("id").alias(f"{p}_id"), F.col("title").alias(f"{p}_title"), F.col("brand").alias(f"{p}_brand"),
            F.coalesce("category", F.lit("")).alias(f"{p}_category"),
            F.struct(F.lit(name).alias("source"), F.col("id").alias("product_id"), F.col("url"), F.col("title"),
                     F.col("price"), F.col("image_url").alias("image")).alias(f"{p}_source"))

    both = pairs.join(side(left, left_name, "left"), "left_id").join(side(right, right_name, "right"), "right_id")
    brand = F.coalesce("left_brand", "right_brand")
    return both.select(
        F.substring(F.md5(F.concat(brand, F.lit("_"), "left_title")), 1, 16).alias("product_id"),
        F.col("left_title").alias("name"), brand.alias("brand"), model_number(F.col("left_title")).alias("model_number"),
        F.array("left_source", "right_source").alias("sources"), F.lit(left_name).alias("primary_source"),
        "match_score", F.lit(2).alias("source_count"),
        F.array_sort(F.array_distinct(F.array("left_category", "right_category"))).alias("categories"),
        "left_id", "right_id")
