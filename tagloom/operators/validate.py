"""Tag validation against the vocabulary, as column logic.

The vocabulary is a few hundred fixed entries, so it is inlined as literal maps
(``lookup`` refuses larger ones) and validation needs neither explode nor join.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagloom.functions.text import contains_any, float_text, lookup, words_literal
from tagloom.rules.vocabulary import Vocabulary

MG = r"^\d+(\.\d+)?mg$"


def mg_value(tag: Column) -> Column:
    """Number of an ``mg`` tag, NULL for other tags."""
    return F.when(tag.rlike(MG), F.regexp_replace(tag, "mg$", "").cast("double"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def validate_tag(tag: Column, category: Column, vocabulary: Vocabulary | None = None) -> Column:
    """``struct(valid, reason)``: any accepting dimension wins, else the last
    failing dimension explains."""
    v = vocabulary or Vocabulary()
    allowed: dict[str, list[str]] = {}
    last: dict[str, list[str]] = {}
    for dim in v.dims.values():
        for t in dim.tags:
            allowed[t] = allowed.get(t, []) + list(dim.applies_to)
            last[t] = [dim.name]
    scope = F.try_element_at(lookup(allowed), tag)
    ranged = [d for d in v.dims.values() if d.bounds]
    value = mg_value(tag)
    in_range = F.lit(False)
    for dim in ranged:
        low, high = dim.bounds
        in_range = in_range | (category.isin(*dim.applies_to) & value.between(low, high))
    tail = ranged[-1]
    low, high = (int(b) for b in tail.bounds)
    wrong_category = _text("Tag '", tag, "' does not apply to category '", category, "' (dimension: ")
    reason = (F.when(tag.isin(*v.categories), F.lit(None).cast("string"))
              .when(value.isNotNull(),
                    F.when(in_range, F.lit(None).cast("string"))
                    .when(category.isin(*tail.applies_to),
                          _text("Tag '", tag, "' value ", float_text(value),
                                f" outside range [{low}, {high}] for dimension '{tail.name}'"))
                    .otherwise(_text(wrong_category, tail.name + ")")))
              .when(scope.isNull(), _text("Tag '", tag, "' not found in approved schema"))
              .when(F.array_contains(scope, category), F.lit(None).cast("string"))
              .otherwise(_text(wrong_category, F.try_element_at(lookup(last), tag)[0], ")")))
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def applies_to(tag: Column, category: Column, vocabulary: Vocabulary | None = None) -> Column:
    """``struct(applies, reason)`` by the first dimension holding the tag."""
    v = vocabulary or Vocabulary()
    first: dict[str, list[str]] = {}
    for dim in v.dims.values():
        for t in dim.tags:
            first.setdefault(t, [dim.name])
    mg_dim = next(d.name for d in v.dims.values() if d.bounds)
    dim = F.coalesce(F.when(tag.rlike(MG), F.lit(mg_dim)), F.try_element_at(lookup(first), tag)[0])
    scopes = lookup({d.name: list(d.applies_to) for d in v.dims.values()})
    scope = F.try_element_at(scopes, dim)
    listed = _text("['", F.array_join(scope, "', '"), "']")
    reason = (F.when(dim.isNull(), _text("Tag '", tag, "' not found in schema"))
              .when(~F.array_contains(scope, category),
                    _text("Tag '", tag, "' (dimension: ", dim, ") does not apply to category '",
                          category, "'. Applies to: ", listed)))
    return F.struct(reason.isNull().alias("applies"), reason.alias("reason"))


def cbd_failures(tags: Column, category: Column, vocabulary: Vocabulary | None = None) -> Column:
    """What a CBD product still lacks of strength, form and type."""
    v = vocabulary or Vocabulary()
    top = int(v.dims["cbd_strength"].bounds[1])

    def lacks(dim: str) -> Column:
        options = ", ".join(f"'{t}'" for t in v.dims[dim].tags)
        return F.when(~F.arrays_overlap(tags, F.array(*[F.lit(t) for t in v.dims[dim].tags])),
                      F.lit(f"CBD product missing {dim} tag. Valid options: [{options}]"))

    strong = F.exists(tags, lambda t: F.coalesce(mg_value(t).between(0, top), F.lit(False)))
    found = F.array_compact(F.array(
        F.when(~strong, F.lit(f"CBD product missing cbd_strength tag (0-{top}mg)")),
        lacks("cbd_form"), lacks("cbd_type")))
    return F.when(category == "CBD", found).otherwise(F.array().cast("array<string>"))


def validate_all(tags: Column, category: Column, vocabulary: Vocabulary | None = None) -> Column:
    """All failure reasons of a product's tags; an empty array means valid."""
    v = vocabulary or Vocabulary()
    per_tag = F.array_compact(F.transform(tags, lambda t: validate_tag(t, category, v)["reason"]))
    illegal = F.when(
        category.isin(*v.applies("nicotine_strength")),
        F.array_compact(F.transform(tags, lambda t: F.when(
            mg_value(t) > 20, _text("Illegal nicotine strength ", float_text(mg_value(t)),
                                    "mg detected (max 20mg)"))))) \
        .otherwise(F.array().cast("array<string>"))
    return F.when(F.size(tags) <= 0, F.array(F.lit("No tags provided"))) \
        .otherwise(F.concat(per_tag, cbd_failures(tags, category, v), illegal))


def applicable_dimensions(category: Column, vocabulary: Vocabulary | None = None) -> Column:
    """Map of the dimensions a category may carry to their tags; a range comes
    as ``min``, ``max``, ``unit``."""
    v = vocabulary or Vocabulary()
    entries = []
    for d in v.dims.values():
        content = list(d.tags) or [str(int(d.bounds[0])), str(int(d.bounds[1])), d.unit]
        entries.append(F.when(category.isin(*d.applies_to), F.struct(
            F.lit(d.name).alias("key"), words_literal(list(content)).alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def tag_dimension(tag: Column, category: Column, vocabulary: Vocabulary | None = None) -> Column:
    """Dimension of a tag; listed twice means its last dimension; ``unknown`` if none."""
    v = vocabulary or Vocabulary()
    known = F.try_element_at(lookup({t: [d] for t, d in v.last_dim().items()}), tag)[0]
    return F.coalesce(known, F.when(tag.rlike(r"^\d+mg$") & (category == "CBD"), "cbd_strength"),
                      F.lit("unknown"))


def is_approved(tag: Column, category: Column, vocabulary: Vocabulary | None = None) -> Column:
    """In the vocabulary, or a whole mg number within range on a CBD product."""
    v = vocabulary or Vocabulary()
    top = v.dims["cbd_strength"].bounds[1]
    in_range = F.coalesce(tag.rlike(r"^\d+mg$") & (category == "CBD") & (mg_value(tag) <= top), F.lit(False))
    return F.array_contains(words_literal(list(v.flat())), tag) | in_range


# Tags a CBD product without a device must not carry.
DEVICE_TAGS = ["pen_style", "pod_style", "box_style", "stick_style", "device", "disposable",
               "pod_system", "box_mod"]


def map_model_tags(tags: Column, category: Column, evidence: Column,
                   vocabulary: Vocabulary | None = None) -> Column:
    """Model tags normalised and kept only if approved or a strength in range."""
    from tagloom.functions.text import normalise_tag
    v = vocabulary or Vocabulary()
    flat = words_literal(list(v.flat()))
    top = max(d.bounds[1] for d in v.dims.values() if d.bounds)
    return F.filter(
        F.transform(tags, normalise_tag),
        lambda t: (F.array_contains(flat, t) | F.coalesce(mg_value(t) <= top, F.lit(False)))
        & ~((category == "CBD") & ~evidence & t.isin(*DEVICE_TAGS)))


# Tags that say nothing, and shapes that are always kept.
MEANINGLESS = ["the", "a", "an", "and", "or", "but", "for", "with", "product", "item",
               "unknown", "n/a", "none", "null"]
KEPT_SHAPES = [r"^\d+m[gl]$", r"^\d+g$", r"^\d+ml$", r"^\d+/\d+$", r"^\d+ohm[s]?$",
               r"^\d+\.\d+ohm[s]?$"]


def reprocess_tags(tags: Column, vocabulary: Vocabulary | None = None) -> Column:
    """``struct(kept, dropped)``: everything but meaningless words is kept, lower case.

    A meaningless word that is part of a known tag (``a`` in ``tank``) is kept,
    as the source does."""
    v = vocabulary or Vocabulary()
    known = {t for d in v.dims.values() for t in d.tags} | (set(v.categories) - {"box_mod"})
    inside = [w for w in MEANINGLESS if any(w in t.lower() for t in known)]
    rejected = [w for w in MEANINGLESS if w not in inside]
    clean = F.transform(tags, lambda t: F.lower(F.trim(t)))
    return F.struct(
        F.filter(clean, lambda t: (t != "") & ~t.isin(*rejected)).alias("kept"),
        F.filter(tags, lambda t: F.lower(F.trim(t)).isin(*rejected)).alias("dropped"))


# Failure text -> dimension to fix, and focus area -> its hint.
FIX_PATTERNS = """
missing cbd_type: cbd_type
missing strength: strength
missing nicotine_type: nicotine_type
missing flavor_profile: flavor_profile
missing device_type: device_type
missing vaping_style: vaping_style
missing vg_ratio: vg_ratio
category detection failed: category
"""
FOCUS_AREAS = "cbd_type, nicotine_type, vg_ratio, flavor, category, strength, device_type"


def dimensions_to_fix(failure: Column) -> Column:
    low = F.lower(F.coalesce(failure, F.lit("")))
    rows = [line.split(": ") for line in FIX_PATTERNS.strip().splitlines()]
    return F.array_compact(F.array(*[F.when(low.contains(p), F.lit(d)) for p, d in rows]))


def focus_areas(failure: Column) -> Column:
    """Areas named in a failure text; ``all`` when a text names none; empty for no text."""
    low = F.lower(F.coalesce(failure, F.lit("")))
    named = F.array_compact(F.array(*[F.when(low.contains(a), F.lit(a)) for a in FOCUS_AREAS.split(", ")]))
    return F.when(low == "", F.array().cast("array<string>")) \
        .when(F.size(named) == 0, F.array(F.lit("all"))).otherwise(named)


def closest_option(value: Column, options: Column) -> Column:
    """First option that contains the value or is contained in it."""
    return F.get(F.filter(options, lambda o: value.contains(o) | o.contains(value)), F.lit(0))


def normalise_value(dim: Column, value: Column) -> Column:
    """A suggested value in its dimension's spelling."""
    pattern = r"(\d+)\s*[/:]?\s*(\d+)?"
    vg, pg = F.regexp_extract(value, pattern, 1), F.regexp_extract(value, pattern, 2)
    number = F.regexp_extract(value, r"(\d+(?:\.\d+)?)", 1)
    rest = F.when(pg != "", pg).otherwise((100 - vg.try_cast("bigint")).cast("string"))
    return F.when((dim == "vg_ratio") & (vg != ""), F.concat(vg, F.lit("/"), rest)) \
        .when((dim == "strength") & (number != ""), number).otherwise(value)


def clean_suggestion(dim: Column, value: Column) -> Column:
    """A model's free answer without its opening words and closing mark."""
    low = F.regexp_replace(F.trim(F.lower(value)), r"^(the |a |answer: |result: )", "")
    return normalise_value(dim, F.trim(F.regexp_replace(low, r"[.,;:]$", "")))


def has_device_evidence(text: Column) -> Column:
    return contains_any(F.lower(text), ["vape", "vaping", "device", "kit", "pen device", "pod device"])
