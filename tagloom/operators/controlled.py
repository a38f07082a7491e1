"""The controlled tag profile: ordered substring rules, one tag per dimension."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import extract as X
from tagloom.functions.text import contains_any, let, substring_tags, words_literal
from tagloom.operators.validate import MG, mg_value
from tagloom.rules.vocabulary import Vocabulary, items
from tagloom.session import spread

# ---------------------------------------------------------------------------
# Fixed values.  First matching line wins.
#   any word , any word & all of these words ! none of these | category | tags
# Words are plain substrings of handle and title; ``\bpod\b`` is a regex.
# ---------------------------------------------------------------------------
FORCED_CATEGORY = r"""
usb cable, charging cable, data cable, usb-c cable, micro usb, type-c cable | accessory | charging_cable
usb, charge, charging, data, phone, iphone, android, type-c, micro & cable | accessory | charging_cable
charger | accessory | charger
battery | accessory | battery
atomizer, atomiser & 510 | accessory | 510_atomizer
atomizer, atomiser | accessory | atomizer
terpene & indica | terpene | terpene, indica
terpene & sativa | terpene | terpene, sativa
balanced, hybrid & terpene | terpene | terpene, balanced
terpene | terpene | terpene, strain_specific
rosin press, rosin-press, pollen press, extractor, concentrate extractor, hex press, hex-press & rosin | extraction_equipment | extraction_equipment, rosin_press
rosin press, rosin-press, pollen press, extractor, concentrate extractor, hex press, hex-press & pollen | extraction_equipment | extraction_equipment, rosin_press
extractor | extraction_equipment | extraction_equipment, extractor
hex press, hex-press | extraction_equipment | extraction_equipment
vitamin, mineral, nootropic, mushroom, probiotic, ashwagandha, ashwaghanda, morchella, black fungus, shroom, intestinal, cleanse, inner purity, adaptogen ! cbd, cbg, cbc | supplement | supplement, ?supplement
cleaning swab, cleaning wipe, cleaning kit, vape clean, pipe cleaner | accessory | accessory, tool_kit
empty & bottle | accessory | accessory
butter maker, dry herb vaporizer, helix pipe | accessory | accessory
spritz & pet | accessory | accessory
brush, mitt & bamboo | accessory | accessory
exfoliator & mitt | accessory | accessory
pen, battery, thread, vape & 510 | device | device, pen_style
coil | coil | coil
tank | tank | tank
cbd, cbg, cbc, kloris, purocuro | CBD | CBD
oil, seed, extract & hemp | CBD | CBD
oil, gel, balm, cream & cannabis | CBD | CBD
sleep & patch | CBD | CBD
gel, protector & intimate | CBD | CBD
e-liquid, liquid, salt | e-liquid | e-liquid
case | accessory | case
\bpod\b & kit | pod_system | pod_system
\bpod\b & system | pod_system | pod_system
\bpod\b | pod | pod
disposable, puff | disposable | disposable
elf bar, elfbar, crystal bar, lost mary, ske crystal, geek bar, geekbar, hayati, elux, ivg bar, oxbar, waka | disposable | disposable
pouch | accessory | pouch
mouthpiece | accessory | mouthpiece
"""

SUPPLEMENT_KIND = """
vitamin | vitamin
nootropic, neuro | nootropic
mushroom, shroom, morchella, black fungus, lions mane, reishi, agaricus | mushroom
probiotic | probiotic
"""

CBD_FORM_IN_TITLE = """
capsule, cap, softgel, soft gel, soft-gel, gel cap, gelcap | capsule
gummy, gummies, bear, candy, chew, jelly, sweets | gummy
topical, cream, balm, salve, lotion, roll-on, roller, gel, joint balm | topical
oil | oil
drop, drops, sublingual | tincture
tincture | tincture
crumble | crumble
shatter | shatter
wax, dab | wax
paste, concentrate, raw paste | paste
shot, beverage, drink, sparkling, energy drink, soda, tea, coffee, infusion | beverage
edible, cookie, brownie, chocolate, bar, snack | edible
patch, patches, transdermal, skin patch | patch
vape, cartridge, cart, disposable, e-liquid, eliquid | vape
flower, bud, hemp flower, pre-roll, preroll | flower
"""

CBD_FORM_IN_TEXT = """
topical, cream, balm, salve, lotion, roll-on, roller | topical
tincture, drops, sublingual | tincture
capsule, softgel, gelcap | capsule
beverage, drink, sparkling, soda, tea, coffee | beverage
oil | tincture
"""

FLAVOURS = """
fruity | fruit, fruity, berry, citrus, strawberry, raspberry, blueberry, blackberry, cranberry, apple, pear, orange, lemon, lime, grapefruit, tangerine, mango, pineapple, coconut, papaya, guava, passion fruit, lychee, peach, plum, apricot, nectarine, cherry, grape, watermelon, melon, kiwi, banana
ice | iced, icy, cool, cooling, menthol, mint, freeze, frozen, arctic, peppermint, spearmint, wintergreen
tobacco | tobacco
desserts/bakery | dessert, bakery, cake, cookie, custard, cream, donut, waffle, pastry, pudding, ice cream
beverages | beverage, drink, cola, coffee, tea, soda, lemonade, energy drink, cocktail, mojito
candy/sweets | candy, sweets, gummy, gummies, sour, bubblegum, bubble gum, cotton candy, lollipop, blue razz, razz, skittles, starburst, sherbet, rainbow, toffee, caramel
nuts | nut, nuts, nutty, almond, hazelnut, peanut, walnut, pistachio
spices_&_herbs | spice, spices, herb, herbs, cinnamon, vanilla, anise, licorice, ginger, clove
cereal | cereal
unflavoured | unflavoured, unflavored, plain
"""

FLAVOUR_CONTEXT = ["e-liquid", "liquid", "juice", "pod", "disposable", "pouch", "mg"]
ZERO_NICOTINE = ["zero nicotine", "zero nic", "nicotine free", "nicotine-free", "nic free", "nic-free"]

# Most specific last; the highest number wins.
CATEGORY_PRIORITY = """
CBD: 15, e-liquid: 14, coil: 13, pod: 12, tank: 11, disposable: 10, pod_system: 9, box_mod: 8,
device: 7, nicotine_pouches: 6, accessory: 5, supplement: 4, terpene: 3, extraction_equipment: 2
"""
# end of fixed values -------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    any_of: list[str]
    all_of: list[str]
    none_of: list[str]
    category: str
    tags: list[str]


def forced_rules() -> list[Rule]:
    out = []
    for line in FORCED_CATEGORY.strip().splitlines():
        condition, category, tags = (p.strip() for p in line.split("|"))
        condition, _, none_of = condition.partition("!")
        any_of, _, all_of = condition.partition("&")
        out.append(Rule(items(any_of), items(all_of), items(none_of), category, items(tags)))
    return out


def _holds(text: Column, word: str) -> Column:
    return text.rlike(word) if word.startswith("\\b") else text.contains(word)


def _rule_condition(text: Column, rule: Rule) -> Column:
    cond = X.any_of([_holds(text, w) for w in rule.any_of])
    for word in rule.all_of:
        cond = cond & _holds(text, word)
    for word in rule.none_of:
        cond = cond & ~_holds(text, word)
    return cond


def _pick(text: Column, table: str) -> Column:
    """Tag of the first line with a word in the text, else NULL."""
    chain = F
    for line in table.strip().splitlines():
        words, tag = (p.strip() for p in line.split("|"))
        chain = chain.when(contains_any(text, items(words)), F.lit(tag))
    return chain


def _tags(*cols: Column) -> Column:
    return F.array_compact(F.array(*cols))


def _has(col: Column, *words: str) -> Column:
    return contains_any(col, list(words))


def forced_category(handle_title: Column) -> Column:
    """``struct(category, tags)`` of the first rule that fits handle and title."""
    chain = F
    for rule in forced_rules():
        tags = [_pick(handle_title, SUPPLEMENT_KIND) if t.startswith("?") else F.lit(t)
                for t in rule.tags]
        chain = chain.when(_rule_condition(handle_title, rule),
                           F.struct(F.lit(rule.category).alias("category"), _tags(*tags).alias("tags")))
    return chain


def cbd_form(handle_title: Column, text: Column) -> Column:
    return F.coalesce(_pick(handle_title, CBD_FORM_IN_TITLE), _pick(text, CBD_FORM_IN_TEXT))


def cbd_spectrum(text: Column) -> Column:
    return (F.when(_has(text, "full spectrum", "full-spectrum", "fullspectrum"), "full_spectrum")
            .when(_has(text, "broad spectrum", "broad-spectrum", "broadspectrum"), "broad_spectrum")
            .when(_has(text, "isolate", "pure cbd"), "isolate")
            .when(_has(text, "cbg") & ~_has(text, "cbd"), "cbg")
            .when(_has(text, "cbda"), "cbda"))


def flavours(text: Column) -> Column:
    """Every flavour with a word in the text; ``ice`` as a word unless it is ice cream."""
    table = {}
    for line in FLAVOURS.strip().splitlines():
        flavour, words = (p.strip() for p in line.split("|"))
        table[flavour] = items(words)
    iced = F.when(text.rlike(r"\bice\b") & ~text.contains("ice cream"), F.array(F.lit("ice"))) \
        .otherwise(F.array().cast("array<string>"))
    found = F.array_union(substring_tags(text, table), iced)
    return F.when(contains_any(text, FLAVOUR_CONTEXT), F.array_intersect(words_literal(list(table)), found)) \
        .otherwise(F.array().cast("array<string>"))


def zero_nicotine(text: Column) -> Column:
    return (contains_any(text, ZERO_NICOTINE) | text.rlike(r"\b0\s*mg\b")) & ~_has(text, "cbd", "cbg")


def nicotine_strength(text: Column) -> Column:
    """``0mg`` when the text says so, else the first strength within 0–20."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)mg"), 1),
                     lambda m: m.cast("double").between(0, 20))
    return F.when(zero_nicotine(text), "0mg").when(
        ~_has(text, "cbd", "cbg"), F.concat(F.get(found, F.lit(0)), F.lit("mg")))


def cbd_strength(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(r"(\d+)mg"), 1),
                     lambda m: m.try_cast("bigint").between(0, 50000))
    return F.concat(F.get(found, F.lit(0)), F.lit("mg"))


def is_shortfill(text: Column, handle_title: Column) -> Column:
    sizes = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)\s*ml"), 1), lambda s: s.try_cast("bigint"))
    large = F.coalesce(F.array_max(sizes) >= 50, F.lit(False))
    named = text.contains("shortfill") & (large | (F.size(sizes) == 0))
    shot = handle_title.rlike(r"\bnic\s*shot\b|\bnicshot\b|\bnic-shot\b")
    return ~shot & (named | (large & zero_nicotine(text)))


def device_style(text: Column, kind: Column, category: Column, tags: Column) -> Column:
    vaping = F.coalesce(kind.contains("vaping"), F.lit(False)) | \
        F.coalesce(category.isin("device", "disposable", "pod_system", "box_mod", "pod"), F.lit(False))
    cbd = F.coalesce(kind.contains("cbd"), F.lit(False)) | F.array_contains(tags, "CBD")
    styled = text.contains("style") | vaping
    chosen = (F.when(text.contains("pen") & styled, "pen_style")
              .when(text.contains("pod") & styled, "pod_style")
              .when(text.contains("box") & styled, "box_style")
              .when(text.contains("stick"), "stick_style")
              .when(text.contains("compact"), "compact")
              .when(text.contains("mini"), "mini"))
    return F.when(~cbd | vaping, chosen)


def _capacity(text: Column, vocabulary: Vocabulary) -> Column:
    approved = F.array(*[F.lit(t) for t in vocabulary.dims["capacity"].tags])
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*ml"), 1),
                                 lambda c: F.concat(c, F.lit("ml"))),
                     lambda t: F.array_contains(approved, t))
    return F.get(found, F.lit(0))


def controlled_rule_tags(df: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Adds ``forced_category`` (NULL if none) and ``rule_tags`` in detection order.

    Needs ``handle``, ``title``, ``description``; ``type`` is a hint where present.
    Three projections: texts, forced category, tags, so no text is built twice.
    """
    v = vocabulary or Vocabulary()
    blank = [F.coalesce(F.col(c), F.lit("")) for c in ("handle", "title", "description")]
    kind = F.lower(F.col("type")) if "type" in df.columns else F.lit(None).cast("string")
    step = spread(df).select(
        "*", F.lower(F.concat_ws(" ", *blank)).alias("_text"),
        F.lower(F.concat_ws(" ", *blank[:2])).alias("_head"), kind.alias("_kind"))
    step = step.select("*", forced_category(F.col("_head")).alias("_forced"))
    text, head = F.col("_text"), F.col("_head")
    forced = F.col("_forced.category")
    categories = words_literal(list(v.categories))

    opening = F.concat(
        _tags(F.when(F.col("_kind").contains("cbd"), F.lit("CBD"))),
        F.coalesce(F.col("_forced.tags"), F.array().cast("array<string>")))
    step = step.select("*", opening.alias("_open"))
    opened = F.col("_open")
    no_category = ~F.arrays_overlap(opened, categories)
    fallback = F.when(no_category, F.when(
        text.contains("charger") & ~F.array_contains(opened, "charger"), "charger").when(
        text.contains("battery") & ~F.array_contains(opened, "battery"), "battery").when(
        text.contains("glass") & text.contains("replacement"), "replacement_glass"))
    cbd_product = _has(text, "cbd", "cbg") | (text.contains("hemp") & _has(text, "oil", "seed", "extract"))
    general = F.when(forced.isNull(), F.when(_has(text, "disposable", "puff"), "disposable").when(
        _has(text, "e-liquid", "liquid", "juice") | (text.contains("nic") & text.contains("salt")), "e-liquid").when(
        _has(text, "kit", "device", "mod"), "device"))
    first = F.concat(opened, _tags(
        fallback, nicotine_strength(text),
        F.when(text.contains("nic") & text.contains("salt"), "nic_salt"),
        F.when(cbd_product, cbd_form(head, text)),
        F.when(cbd_product, cbd_spectrum(text)),
        F.when(cbd_product, cbd_strength(text)),
        X.controlled_bottle_size(text), X.controlled_vg_ratio(text),
        F.when(is_shortfill(text, head), "shortfill"), general))
    step = step.select("*", first.alias("_first"))
    early = F.col("_first")
    has_category = forced.isNotNull() | F.arrays_overlap(early, categories)
    coil = F.when(text.contains("coil") & ~has_category, "coil")
    tank = F.when((text.contains("tank") | (text.contains("replacement") & text.contains("glass")))
                  & ~F.coalesce(forced.isin("coil", "tank"), F.lit(False))
                  & ~F.array_contains(early, "tank"), "tank")
    pod = text.rlike(r"\bpod\b") & ~F.coalesce(forced == "accessory", F.lit(False))
    second = F.concat(early, _tags(
        coil, tank,
        F.when(pod, F.when(_has(text, "prefilled", "pre-filled", "pre_filled"), "prefilled_pod")
               .when(_has(text, "refillable", "replacement"), "replacement_pod")),
        F.when(pod & ~F.arrays_overlap(early, F.array(F.lit("pod"), F.lit("pod_system"))), "pod"),
        F.when(pod, _capacity(text, v)),
        F.when(text.contains("box") & text.contains("mod"), "box_mod"),
        F.when(_has(text, "battery", "batteries"), "accessory"),
        F.when(_has(text, "battery", "batteries"), "battery"),
        F.when(text.contains("charger"), "accessory"),
        F.when(text.contains("charger"), "charger")))
    step = step.select("*", second.alias("_second"))
    late = F.concat(F.col("_second"), _tags(
        device_style(text, F.col("_kind"), forced, F.col("_second")), X.controlled_ohm(text, v)),
        flavours(text))
    flat = words_literal(list(v.flat()))
    kept = F.filter(F.array_distinct(late), lambda t: F.array_contains(flat, t) | F.coalesce(
        t.rlike(MG) & F.when(F.coalesce(forced, F.lit("")) != "CBD", mg_value(t) <= 20).otherwise(True),
        F.lit(False)))
    return step.select(*df.columns, forced.alias("forced_category"), kept.alias("rule_tags"))


def best_category(tags: Column, forced: Column) -> Column:
    """Forced category, else the category tag of the highest priority."""
    ranks = {k.strip(): int(n) for k, n in (e.split(":") for e in items(CATEGORY_PRIORITY))}
    order = sorted(ranks, key=lambda c: -ranks[c])
    return F.coalesce(forced, F.get(F.filter(
        words_literal(list(order)), lambda c: F.array_contains(tags, c)), F.lit(0)))


def one_per_dimension(tags: Column, category: Column, vocabulary: Vocabulary | None = None) -> Column:
    """The category first, then one tag per dimension it may carry.

    Within a dimension the longest tag wins (accessories: charger, then battery,
    then the longest); equal lengths go to the alphabetically first, a rule of
    ours because the source order there is a set's.  Tags of no dimension share
    one bucket, so at most one of them survives.  Kept dimensions come in
    vocabulary order, the unknown bucket last.
    """
    v = vocabulary or Vocabulary()
    own = {}
    for tag, dim in v.last_dim().items():
        own.setdefault(dim, []).append(tag)
    by_size = F.array_sort(F.transform(F.array_distinct(tags), lambda t: F.struct(
        (-F.length(t)).alias("n"), t.alias("t"))))
    known = words_literal(v.flat())
    is_cbd = F.coalesce(category == "CBD", F.lit(False))

    def picks(ordered: Column) -> Column:
        chosen = []
        for dim in v.dims.values():
            if dim.name == "cbd_strength":
                found = F.filter(ordered, lambda t: t.rlike(r"^\d+mg$"))
            elif dim.tags:
                found = F.array_intersect(ordered, words_literal(own[dim.name]))
            else:
                continue
            if dim.name == "accessory_type":
                found = F.concat(F.array_intersect(words_literal(["charger", "battery"]), found), found)
            chosen.append(F.when(category.isin(*dim.applies_to), F.get(found, F.lit(0))))
        loose = F.filter(F.array_except(ordered, known), lambda t: ~(t.rlike(r"^\d+mg$") & is_cbd))
        return F.array_compact(F.array(category, *chosen, F.get(loose, F.lit(0))))

    return let(F.transform(by_size, lambda s: s["t"]), picks)


def tag_controlled(df: DataFrame, vocabulary: Vocabulary | None = None,
                   model_tags: str | None = None) -> DataFrame:
    """The whole controlled profile: rule tags, category, style from ratio, final tags."""
    v = vocabulary or Vocabulary()
    # the type column is no hint in the full run, so it is set aside
    hidden = df.withColumnRenamed("type", "_type") if "type" in df.columns else df
    ruled = controlled_rule_tags(hidden, v)
    if "type" in df.columns:
        ruled = ruled.withColumnRenamed("_type", "type")
    extra = F.col(model_tags) if model_tags else F.array().cast("array<string>")
    every = ruled.select("*", F.array_distinct(F.concat(extra, F.col("rule_tags"))).alias("_all"))
    every = every.select("*", best_category(F.col("_all"), F.col("forced_category")).alias("category"))
    ratios = F.array(*[F.lit(t) for t in v.dims["vg_ratio"].tags])
    implied = F.array_compact(F.transform(
        F.filter(F.col("_all"), lambda t: F.array_contains(ratios, t)), X.controlled_vaping_style))
    widened = F.when(F.col("category") == "e-liquid", F.array_distinct(F.concat(F.col("_all"), implied))) \
        .otherwise(F.col("_all"))
    return every.select("*", one_per_dimension(widened, F.col("category"), v).alias("final_tags")).drop("_all")
