"""The controlled vocabulary and the keyword tables, as plain data.

Each block below is one small table, one line per tag.  ``Vocabulary`` turns
the dimension lines into lookups; operators receive it as an argument, so a
caller with another catalogue passes another vocabulary.
"""
from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the published vocabulary for right results.
# ---------------------------------------------------------------------------

CATEGORIES = """
e-liquid, nicotine_pouches, disposable, device, pod_system, box_mod, tank, coil,
accessory, pod, CBD, terpene, supplement, extraction_equipment
"""

# dimension | categories it applies to | tags
DIMENSIONS = """
capacity | tank, pod | 2ml, 2.5ml, 3ml, 4ml, 5ml, 6ml, 7ml, 8ml, 9ml, 10ml
bottle_size | e-liquid, CBD | 5ml, 10ml, 20ml, 30ml, 50ml, 100ml, shortfill
device_style | device, pod_system | pen_style, pod_style, box_style, stick_style, compact, mini
nicotine_strength | e-liquid, disposable, device, pod_system, nicotine_pouches | range 0 20 mg
cbd_strength | CBD | range 0 50000 mg
cbd_form | CBD | tincture, oil, gummy, capsule, topical, patch, paste, shot, isolate, edible, beverage, crumble, shatter, wax, e-liquid, bath_salts
cbd_type | CBD | full_spectrum, broad_spectrum, isolate, cbg, cbda
terpene_type | terpene | indica, sativa, hybrid, balanced, strain_specific
supplement_type | supplement | vitamin, mineral, nootropic, mushroom, probiotic
extraction_type | extraction_equipment | rosin_press, extractor, press
flavour_type | e-liquid, disposable, nicotine_pouches, pod | fruity, ice, tobacco, desserts/bakery, beverages, nuts, spices_&_herbs, cereal, unflavoured, candy/sweets
nicotine_type | e-liquid, disposable, device, pod_system, nicotine_pouches | nic_salt, freebase_nicotine, traditional_nicotine, pouch
power_supply | device, pod_system | rechargeable, removable_battery
vg_ratio | e-liquid | every vg/pg pair
vaping_style | device, pod_system, e-liquid | mouth-to-lung, direct-to-lung, restricted-direct-to-lung
pod_type | pod | prefilled_pod, replacement_pod
accessory_type | accessory | battery, charger, charging_cable, pouch, case, drip_tip, mouthpiece, tool_kit, cotton, wire, screwdriver, battery_wraps, atomizer, 510_atomizer
tank_parts | tank | glass_tube, o-rings, coil_head, base_plate, top_cap, replacement_glass
coil_ohm | coil, device, pod_system | 0.1ohm, 0.15ohm, 0.2ohm, 0.3ohm, 0.4ohm, 0.5ohm, 0.6ohm, 0.7ohm, 0.8ohm, 1.0ohm, 1.2ohm, 1.5ohm, 1.8ohm, 2.0ohm
"""

CATEGORY_WORDS = """
CBD: cbd, cannabidiol, hemp, cbg, cbn
supplement: caffeine pouch, caffeine pouches, energy pouch, energy pouches, mushroom, ashwagandha, nootropic, vitamin, probiotic, lions mane, lion's mane, shroom, adaptogen
nicotine_pouches: nicotine pouch, nic pouch, snus, nicotine candy, nicotine lozenge, spearmint pouches, mint pouches, zero pouches
disposable: disposable, single use, throw away, one time, disposable vape, disposable pod, puff, puffs, 600 puff, 800 puff, elf bar, elfbar, crystal bar, lost mary, ske crystal, geek bar, geekbar, hayati, elux, r and m, randm, ivg bar, vaporesso xros nano, oxbar, oxva, waka, prefilled device, all in one disposable
e-liquid: e-liquid, eliquid, e liquid, vape juice, vape liquid, ejuice, nic salt, nicotine salt, shortfill, longfill, freebase, 50vg, 70vg, 80vg, vg/pg, pg/vg, 10ml, 30ml, 50ml, 100ml, salt, salts
pod_system: pod system, pod mod, pod device, pod kit, starter kit
box_mod: box mod, square mod
device: device, vape device, vaping device, mod, vape mod, kit
tank: tank, vape tank, clearomizer, atomizer tank, sub ohm tank, sub-ohm tank
coil: coil, replacement coil, coil head, atomizer head, mesh coil
pod: pod, replacement pod, prefilled pod, cartridge, refillable pod
accessory: accessory, accessories, vape accessory, drip tip, battery, charger, replacement glass, glass tube, bubble glass, filter, mouthpiece, o-ring, o ring, silicone sleeve, vape band, tool kit
"""

ACCESSORY_OVERRIDES = """
replacement glass, bubble glass, glass tube, replacement tube, o-ring, o ring,
silicone band, vape band, drip tip, filter, mouthpiece filter, chamber filter
"""

# After CBD, which always wins.
CATEGORY_ORDER = """
accessory, coil, tank, pod_system, pod, box_mod, device, e-liquid, disposable,
nicotine_pouches, supplement, terpene, extraction_equipment
"""

DEVICE_STYLE_WORDS = """
pen_style: pen, pen style, vape pen
pod_style: pod style, pod-style
box_style: box, box style, boxy, square
stick_style: stick, stick style, tube, cylindrical
compact: compact, small, mini, portable, pocket
mini: mini, micro, tiny
"""

# flavour | words of the flavour itself | more specific words
FLAVOUR_WORDS = """
fruity | fruit, fruity | lemon, lime, orange, grapefruit, citrus, tangerine, mandarin, strawberry, raspberry, blueberry, blackberry, berry, cranberry, mango, pineapple, coconut, papaya, guava, passion fruit, tropical, lychee, peach, plum, apricot, nectarine, cherry, apple, pear, grape, watermelon, melon, kiwi, banana
ice | ice, iced, icy, cool, cooling, menthol, mint, freeze, frozen, arctic | peppermint, spearmint, wintergreen, eucalyptus, cold
tobacco | tobacco | virginia, havana, cuban, burley, cigar, cigarette, classic tobacco, sweet tobacco, honey tobacco, caramel tobacco, dark tobacco, bold tobacco
desserts/bakery | dessert, bakery, pastry | custard, cookie, cake, donut, waffle, cream, creamy, pudding, flan, ice cream
candy/sweets | candy, sweets, gummy, gummies, sour | gummy bear, gummy worm, jelly, jelly bean, haribo, chewy, sour rainbow, sour apple, sour cherry, sour patch, tangy, fizzy, blue razz, razz, bubblegum, bubble gum, cotton candy, lollipop, skittles, starburst, jawbreaker, sherbet, rainbow, sugar, sugary, toffee, caramel, butterscotch, fudge, chocolate
beverages | beverage, drink | soda, cola, lemonade, energy drink, fizz, coffee, espresso, cappuccino, latte, mocha, tea, green tea, chai, cocktail, mojito, margarita, pina colada, daiquiri, sangria, rum
nuts | nut, nuts, nutty | almond, hazelnut, peanut, walnut, pecan, pistachio
spices_&_herbs | spice, spices, herb, herbs, spicy | cinnamon, vanilla, anise, licorice, ginger, clove, cardamom
cereal | cereal, grain | oat, wheat, corn, rice, granola, muesli
unflavoured | unflavoured, unflavored, plain, natural, no flavor, no flavour |
"""

NICOTINE_TYPE_WORDS = """
nic_salt: nic salt, nicotine salt, salt nicotine, salt nic, smooth
freebase_nicotine: freebase, free base, freebase nicotine
traditional_nicotine: traditional, traditional nicotine, standard nicotine
pouch: pouch, nicotine pouch
"""

BOTTLE_SIZE_WORDS = """
5ml: 5ml, 5 ml
10ml: 10ml, 10 ml
20ml: 20ml, 20 ml
30ml: 30ml, 30 ml
50ml: 50ml, 50 ml
100ml: 100ml, 100 ml
shortfill: shortfill, short fill
"""

CBD_FORM_WORDS = """
tincture: tincture, drops, liquid drops
oil: oil, cbd oil
gummy: gummy, gummies, gummie
capsule: capsule, capsules, pill, pills
topical: topical, cream, lotion, balm, salve
patch: patch, patches, transdermal
paste: paste
shot: shot, shots
isolate: isolate, crystal, shatter, wax, crumble, dab
edible: edible, edibles, food
beverage: beverage, drink, tea, coffee
"""

CBD_TYPE_WORDS = """
full_spectrum: full spectrum, full-spectrum
broad_spectrum: broad spectrum, broad-spectrum
isolate: isolate, pure cbd, cbd isolate, shatter, wax, crumble, dab
cbg: cbg, cannabigerol
cbda: cbda, cannabidiolic acid
"""

POWER_SUPPLY_WORDS = """
rechargeable: rechargeable, usb, usb-c, charging, charge
removable_battery: removable battery, 18650, 21700, replaceable battery
"""

POD_TYPE_WORDS = """
prefilled_pod: prefilled, pre-filled, pre filled
replacement_pod: replacement, refillable, empty pod
"""

VAPING_STYLE_WORDS = """
mouth-to-lung: mtl, mouth to lung, mouth-to-lung
direct-to-lung: dtl, direct to lung, direct-to-lung, sub ohm, subohm
restricted-direct-to-lung: rdtl, restricted dtl, restricted direct to lung, restricted-direct-to-lung
"""

ZERO_NICOTINE_PHRASES = "zero nicotine, no nicotine, nicotine free, nicotine-free"

GATE_REASON = ("Category detection failed - product does not match any known "
               "category keywords")

# end of fixed values -------------------------------------------------------


def items(text: str) -> list[str]:
    """Comma-separated text to a list, blanks dropped."""
    return [part.strip() for part in text.replace("\n", " ").split(",") if part.strip()]


def table(text: str) -> dict[str, list[str]]:
    """``tag: word, word`` lines to an ordered mapping."""
    rows = (line.split(":", 1) for line in text.strip().splitlines())
    return {tag.strip(): items(words) for tag, words in rows}


def _ohm_words() -> dict[str, list[str]]:
    """Every resistance is spelt ``0.5ohm``, ``0.5 ohm`` or ``0.5Ω``; whole
    ohms also come without the ``.0``."""
    out = {}
    for tag in Vocabulary().dims["coil_ohm"].tags:
        value = tag[:-3]
        spellings = [value] + ([value[:-2]] if value.endswith(".0") else [])
        out[tag] = [s + unit for s in spellings for unit in ("ohm", " ohm", "Ω")]
    return out


@dataclass(frozen=True)
class Dimension:
    name: str
    applies_to: tuple[str, ...]
    tags: tuple[str, ...] = ()
    bounds: tuple[float, float] | None = None
    unit: str = ""


def _parse_dimensions(text: str) -> dict[str, Dimension]:
    dims = {}
    for line in text.strip().splitlines():
        name, applies, body = (part.strip() for part in line.split("|"))
        scope = tuple(items(applies))
        if body.startswith("range "):
            _, low, high, unit = body.split()
            dims[name] = Dimension(name, scope, bounds=(float(low), float(high)), unit=unit)
        elif body == "every vg/pg pair":
            dims[name] = Dimension(name, scope, tuple(f"{vg}/{100 - vg}" for vg in range(101)))
        else:
            dims[name] = Dimension(name, scope, tuple(items(body)))
    return dims


@dataclass(frozen=True)
class Vocabulary:
    """Approved tags per dimension, in vocabulary order."""

    categories: tuple[str, ...] = tuple(items(CATEGORIES))
    dims: dict[str, Dimension] = field(default_factory=lambda: _parse_dimensions(DIMENSIONS))

    def flat(self) -> list[str]:
        """All approved tags, categories first, repeats kept out."""
        every = list(self.categories)
        for dim in self.dims.values():
            every.extend(dim.tags)
        return list(dict.fromkeys(every))

    def dims_of(self, tag: str) -> list[str]:
        return [d.name for d in self.dims.values() if tag in d.tags]

    def last_dim(self) -> dict[str, str]:
        """tag -> dimension; a tag listed twice belongs to its last dimension."""
        found = {tag: "category" for tag in self.categories}
        for dim in self.dims.values():
            found.update({tag: dim.name for tag in dim.tags})
        return found

    def applies(self, dim: str) -> tuple[str, ...]:
        return self.dims[dim].applies_to


@dataclass(frozen=True)
class KeywordRules:
    """Whole-word rules: per dimension, tag -> words."""

    words: dict[str, dict[str, list[str]]]

    @staticmethod
    def default() -> "KeywordRules":
        flavours = flavour_words()
        return KeywordRules({
            "category": table(CATEGORY_WORDS),
            "device_style": table(DEVICE_STYLE_WORDS),
            "nicotine_type": table(NICOTINE_TYPE_WORDS),
            "bottle_size": table(BOTTLE_SIZE_WORDS),
            "cbd_form": table(CBD_FORM_WORDS),
            "cbd_type": table(CBD_TYPE_WORDS),
            "power_supply": table(POWER_SUPPLY_WORDS),
            "pod_type": table(POD_TYPE_WORDS),
            "vaping_style": table(VAPING_STYLE_WORDS),
            "coil_ohm": _ohm_words(),
            "flavour_type": {f: first + more for f, (first, more) in flavours.items()},
        })

    def every_word(self) -> list[str]:
        seen = {w for tags in self.words.values() for ws in tags.values() for w in ws}
        return sorted(seen)


def flavour_words() -> dict[str, tuple[list[str], list[str]]]:
    """flavour -> (own words, specific words)."""
    out = {}
    for line in FLAVOUR_WORDS.strip().splitlines():
        name, own, more = (part.strip() for part in line.split("|"))
        out[name] = (items(own), items(more))
    return out


def word_forms(word: str) -> list[str]:
    """A keyword and the plurals that count as the same keyword."""
    word = word.lower().strip()
    forms = [word]
    if not word.endswith("s"):
        forms.append(word + "s")
        if word.endswith(("ch", "sh", "x", "z")):
            forms.append(word + "es")
    return forms
