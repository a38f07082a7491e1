"""Values read from product text: strengths, ratios, sizes, resistances."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tagloom.functions.text import contains_any, let, number_text
from tagloom.rules.vocabulary import ZERO_NICOTINE_PHRASES, Vocabulary, items

# The accepted spellings, tried in this order.
NICOTINE_PATTERNS = [
    r"\b(\d+\.?\d*)\s*mg\b",
    r"nicotine[:\s]+(\d+\.?\d*)\s*mg",
    r"(\d+\.?\d*)\s*mg\s*(?:nic|nicotine)",
]
CBD_PATTERNS = [
    r"(\d+\.?\d*)\s*mg\s*cbd",
    r"cbd\s*(\d+\.?\d*)\s*mg",
    r"(\d+\.?\d*)mg",
]
RATIO_PATTERNS = [
    r"(\d+)\s*vg\s*/\s*(\d+)\s*pg",
    r"(\d+)\s*/\s*(\d+)",
    r"(\d+)\s*vg\s*(\d+)\s*pg",
]
VARIANT_RATIO_PATTERNS = [
    r"(\d+)\s*vg\s*/?\s*(\d+)\s*pg",
    r"(\d+)\s*/\s*(\d+)",
    r"(\d+)\s*vg\s+(\d+)\s*pg",
]
# The controlled profile tries these in turn; the first that occurs at all is used.
CONTROLLED_RATIO_PATTERNS = [
    r"(\d+)\s*vg\s*[/-]\s*(\d+)\s*pg",
    r"(\d+)[/-](\d+)\s*vg[/-]pg",
    r"vg[/-]pg\s*(\d+)[/-](\d+)",
    r"(\d+)%?\s*vg\s*[/-]\s*(\d+)%?\s*pg",
    r"vg\s*:\s*pg\s*(\d+)\s*:\s*(\d+)",
    r"(\d+)\s*vg\s+(\d+)\s*pg",
    r"(\d+)%\s*vg.*?(\d+)%\s*pg",
    r"(\d+)vg(\d+)pg",
    r"vg\s+(\d+)[/-]\s*pg\s+(\d+)",
    r"(\d+)[/-](\d+)\s*vg\s*pg",
    r"(\d+)vg[/-](\d+)pg",
    r"vg(\d+)pg(\d+)",
]
LOOSE_RATIO_PATTERN = r"(\d+)[/-](\d+)"
STANDARD_SIZES = ["2ml", "5ml", "10ml", "20ml", "30ml", "50ml", "100ml", "120ml"]


def _number(found: Column, kind: str) -> Column:
    """Matched digits as a number, NULL for no match.  Nothing is cast on no match:
    a failed cast costs far more than the comparison."""
    return let(found, lambda t: F.when(t != "", t.try_cast(kind)))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """First match as a number, NULL where the pattern does not occur."""
    return _number(F.regexp_extract(text, pattern, group), "double")


def nicotine_mg(text: Column, category: Column) -> Column:
    """Nicotine strength.  Each pattern is judged by its first match alone;
    a match above 20 moves on to the next pattern."""
    def found(low: Column) -> Column:
        hits = [let(_first(low, p), lambda v: F.when(v <= 20, v)) for p in NICOTINE_PATTERNS]
        return F.when(contains_any(low, items(ZERO_NICOTINE_PHRASES)), 0.0).otherwise(F.coalesce(*hits))

    return (F.when(text.isNull() | (text == ""), F.lit(None).cast("double"))
            .when(category == "CBD", 0.0).otherwise(let(F.lower(text), found)))


def cbd_mg(text: Column) -> Column:
    """CBD strength: the first pattern that occurs decides; over 50000 there is none."""
    value = let(F.lower(text), lambda low: F.coalesce(*[_first(low, p) for p in CBD_PATTERNS]))
    return let(value, lambda v: F.when(v <= 50000, v))


def strength_tag(value: Column, top: int) -> Column:
    """``20mg`` style tag, NULL outside ``0..top``."""
    return F.when((value >= 0) & (value <= top), F.concat(number_text(value), F.lit("mg")))


def nicotine_tag(value: Column) -> Column:
    return strength_tag(value, 20)


def cbd_tag(value: Column) -> Column:
    return strength_tag(value, 50000)


def _pair(text: Column, pattern: str) -> Column:
    """``vg/pg`` from the first match, larger side first, NULL unless it sums to 100."""
    sides = F.struct(F.regexp_extract(text, pattern, 1).alias("a"), F.regexp_extract(text, pattern, 2).alias("b"))

    def ratio(n: Column) -> Column:
        return F.when(n["a"] + n["b"] == 100, F.concat(
            F.greatest(n["a"], n["b"]).cast("string"), F.lit("/"), F.least(n["a"], n["b"]).cast("string")))

    return let(sides, lambda s: F.when(s["a"] != "", let(F.struct(
        s["a"].try_cast("bigint").alias("a"), s["b"].try_cast("bigint").alias("b")), ratio)))


def _pure(low: Column) -> Column:
    return F.when(low.rlike(r"\b100\s*vg\b"), "100/0").when(low.rlike(r"\b100\s*pg\b"), "0/100")


def vg_ratio(text: Column) -> Column:
    """VG/PG ratio of a product text, NULL if none."""
    def of(share: Column, vg_side: Column) -> Column:
        return F.when((share > 0) & (share <= 100), F.concat(
            vg_side.cast("string"), F.lit("/"), (100 - vg_side).cast("string")))

    def found(low: Column) -> Column:
        vg = _number(F.regexp_extract(low, r"\b(\d+)\s*vg\b", 1), "bigint")
        pg = _number(F.regexp_extract(low, r"\b(\d+)\s*pg\b", 1), "bigint")
        return F.coalesce(_pure(low), *[_pair(low, p) for p in RATIO_PATTERNS],
                          let(vg, lambda v: of(v, v)), let(pg, lambda p: of(p, 100 - p)))

    return let(F.lower(text), found)


def variant_vg_ratio(text: Column) -> Column:
    """VG/PG ratio named by a variant option: no single-sided forms."""
    return let(F.lower(text), lambda low: F.coalesce(_pure(low), *[_pair(low, p) for p in VARIANT_RATIO_PATTERNS]))


def controlled_vg_ratio(text: Column) -> Column:
    """VG/PG ratio of the controlled profile: all matches of the first pattern
    that occurs, the first approved pair among them."""
    return let(F.lower(text), _controlled_ratio)


def _controlled_ratio(low: Column) -> Column:
    def pairs(pattern: str) -> Column:
        left = F.regexp_extract_all(low, F.lit(pattern), 1)
        right = F.regexp_extract_all(low, F.lit(pattern), 2)
        return F.arrays_zip(left.alias("a"), right.alias("b"))

    def approved(found: Column) -> Column:
        ratios = F.transform(found, lambda p: F.when(
            p["a"].try_cast("bigint") + p["b"].try_cast("bigint") == 100,
            F.when(p["b"].try_cast("bigint") > p["a"].try_cast("bigint"), F.concat(p["b"], F.lit("/"), p["a"]))
            .otherwise(F.concat(p["a"], F.lit("/"), p["b"]))))
        # leading zeros are not approved spellings
        return F.get(F.filter(ratios, lambda r: r.isNotNull() & r.rlike(r"^(0|[1-9]\d*)/(0|[1-9]\d*)$")), F.lit(0))

    result = F
    for pattern in CONTROLLED_RATIO_PATTERNS:
        result = result.when(low.rlike(pattern), approved(pairs(pattern)))
    result = result.when(low.contains("vg") & low.contains("pg") & low.rlike(LOOSE_RATIO_PATTERN),
                         approved(pairs(LOOSE_RATIO_PATTERN)))
    result = result.when(contains_any(low, ["100% vg", "pure vg", "max vg"]), "100/0")
    return result.when(low.contains("vg") & ~low.contains("pg"), "100/0")


def capacity_tags(text: Column, vocabulary: Vocabulary | None = None) -> Column:
    """Capacity tags.  Only a digit directly before blocks a match, so the text
    ``2.5ml`` also yields ``5ml``."""
    sizes = (vocabulary or Vocabulary()).dims["capacity"].tags
    return F.array_sort(let(F.lower(text), lambda low: F.array_compact(F.array(*[
        F.when(low.rlike(r"(?<![0-9])" + s.replace(".", r"\.") + r"(?![\p{L}\p{N}_])"), F.lit(s))
        for s in sizes]))))


def controlled_bottle_size(text: Column) -> Column:
    """First ``<n> ml`` if it is one of the standard sizes."""
    size = F.concat(F.regexp_extract(F.lower(text), r"(\d+)\s*ml\b", 1), F.lit("ml"))
    return F.when(size.isin(STANDARD_SIZES), size)


def controlled_ohm(text: Column, vocabulary: Vocabulary | None = None) -> Column:
    """First approved resistance among everything that looks like one."""
    pattern = r"(\d+)[-\.]?(\d*)\s*[ωo]h?m?"
    low = F.lower(text)
    zipped = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), 1).alias("whole"),
                          F.regexp_extract_all(low, F.lit(pattern), 2).alias("part"))
    spelt = F.transform(zipped, lambda m: F.when(
        m["part"] != "", F.concat(m["whole"], F.lit("."), m["part"], F.lit("ohm")))
        .otherwise(F.concat(m["whole"], F.lit("ohm"))))
    approved = F.array(*[F.lit(t) for t in (vocabulary or Vocabulary()).dims["coil_ohm"].tags])
    return F.get(F.filter(spelt, lambda t: F.array_contains(approved, t)), F.lit(0))


def export_vaping_style(ratio: Column) -> Column:
    """Style implied by a variant's ratio; between the bands there is none."""
    vg = F.split_part(ratio, F.lit("/"), F.lit(1)).try_cast("int")
    return F.when(vg >= 70, "direct-to-lung").when(vg <= 50, "mouth-to-lung")


def controlled_vaping_style(ratio: Column) -> Column:
    """Style implied by a ratio in the controlled profile."""
    vg = F.split_part(ratio, F.lit("/"), F.lit(1)).try_cast("int")
    pg = F.split_part(ratio, F.lit("/"), F.lit(2)).try_cast("int")
    return (F.when(pg >= 50, "mouth-to-lung")
            .when((vg >= 60) & (vg <= 70), "restricted-direct-to-lung")
            .when(vg >= 70, "direct-to-lung"))


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
