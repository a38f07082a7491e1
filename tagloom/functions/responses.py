"""Model answers as text: parsed to tags and confidence without leaving the JVM."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

ANSWER = "struct<tags:array<string>,confidence:double,reasoning:string,category:string>"


def _unfenced(text: Column) -> Column:
    open_gone = F.regexp_replace(text, r"```json\s*", "")
    return F.regexp_replace(F.regexp_replace(open_gone, r"```\s*$", ""), r"^\s+|\s+$", "")


def parse_answer(text: Column, greedy: bool = False, need_confidence: bool = True) -> Column:
    """``struct(tags, confidence, reasoning, category)`` or NULL.

    Fences are removed, then the whole text or its first ``{…}`` is read as
    JSON; failing that, the first ``[…]`` is split by commas with confidence 0.5.
    ``greedy`` takes the outermost braces.
    """
    clean = _unfenced(text)
    body = r"(?s)(\{.*\})" if greedy else r"(?s)(\{.*?\})"
    inner = F.regexp_extract(clean, body, 1)
    source = F.when(clean.startswith("{") | (inner == ""), clean).otherwise(inner)
    parsed = F.from_json(source, ANSWER)
    usable = parsed["tags"].isNotNull()
    if need_confidence:
        usable = usable & parsed["confidence"].isNotNull()
    listed = F.regexp_extract(text, r"\[([^\]]+)\]", 1)
    loose = F.filter(
        F.transform(F.split(listed, ","),
                    lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), '^"+|"+$', ""), "^'+|'+$", "")),
        lambda t: t != "")
    fallback = F.struct(loose.alias("tags"), F.lit(0.5).alias("confidence"),
                        F.lit("Fallback parsing - could not extract confidence").alias("reasoning"),
                        F.lit(None).cast("string").alias("category"))
    return F.when(usable, parsed).when(listed != "", fallback)


# The families of a cached flat answer, by substrings of the lower-case tag.
ANSWER_FAMILIES = {
    "category_tags": ["disposable", "rechargeable", "pod", "cartridge"],
    "flavor_tags": ["fruit", "dessert", "menthol", "tobacco", "beverage", "ice", "cream", "vanilla", "chocolate"],
    "device_tags": ["pen", "stick", "pod", "mod", "tank"],
    "compatibility_tags": ["510", "threading", "magnetic"],
    "cross_compatibility_tags": ["universal", "compatible", "interchangeable"],
}


def answer_families(tags: Column) -> Column:
    """A flat list of tags split into the families; a tag may be in several or none."""
    def family(words: list[str]) -> Column:
        return F.filter(tags, lambda t: F.lower(t).rlike("|".join(words)))

    return F.struct(*[family(words).alias(name) for name, words in ANSWER_FAMILIES.items()])
