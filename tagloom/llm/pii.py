"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

Entities are found by one alternation of patterns, so a text falls into gaps and entities in turn.  The
distinct entities get replacements from a keyed digest; whoever's replacement another entity has, or equals
a real entity, tries the next one until none is shared.  The same entity has the same replacement
everywhere.  Everything is DataFrame expressions; only texts with an entity move.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.text import let
from tagloom.llm.stored import stored

#: What counts as an entity, in order of precedence.
PATTERNS = {
    "secret_pair": r"(?i:password|passwd|pwd|secret|api[_\-]?key|token)[\"']?\s?[=:]\s?(?=[\"']?[^\s\"']*[\p{L}\p{N}])(?:\"[^\s\"]{8,}\"?|'[^\s']{8,}'?|[^\s\"']{8,}[\"']?)",
    "key_id": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,256}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    # 16 digits; 13 to 19 from a card network's first digit, in groups of four or as printed on 13, 14, 15 and 19 digit cards
    "card": (r"(?<![\w.])(?:[2-6]\d{3}(?:[ \-]?\d{4}){3}(?:[ \-]\d{3}|\d{1,3})|\d{4}(?:[ \-]?\d{4}){3}|[2-6]\d{3}(?:[ \-]?\d{4}){2}[ \-]?\d{1,3}"
             r"|[2-6]\d{3}(?:[ \-]?\d{3}){3}|[2-6]\d{3}[ \-]?\d{6}[ \-]?\d{4,5}|[2-6]\d{5}[ \-]?\d{13}|1\d{3}[ \-]?\d{5}[ \-]?\d{6})(?!\w)"),
    # with a bracketed area code; three groups joined by one mark; from + and the country code; from a trunk 0
    "phone": (r"(?:(?:(?<![\w+])\+?\d{1,3}[ \-.]?)?\(\d{2,5}\)[ \-.]?\d{3,4}[ \-.]?\d{4}"
              r"|(?<![\w+.\-])(?:1[ \-.])?[2-9]\d\d(?:-\d{3}-|\.\d{3}\.| \d{3} |[ \-.]?\d{3}-)\d{4}(?!-\d)"
              r"|(?<![\w+])\+[1-9](?:(?:[ \-./]| ?\(|\)[ \-]?)?\d){6,14}"
              r"|(?<![\w+.\-])(?:\(0\d{1,5}\)[ \-]?\d{3,4}[ \-]?\d{2,5}|0[1-9](?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4}|\d{8,9})|0[1-9]\d{0,4}[ /\-]\d{3,4}[ \-]?\d{3,5}))(?!\d)"),
    "national_id": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    # the last group has one to four characters; a short one that stands alone ends on a digit, or on a currency where the country puts it there
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?=(?: ?[A-Z0-9]){11})(?: ?[A-Z0-9]{4}){2,7}(?:[A-Z0-9]{1,3}| [A-Z0-9]{0,2}\d| (?:UR|USD|SCR))?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?",
}
ANY = "|".join(PATTERNS.values())
#: What stands before a secret's value.
SECRET_PREFIX = r"^[A-Za-z_\-]+[\"']?\s?[=:]\s?[\"']?"
#: What every entity has; it costs little to look for, and most texts have none of it.
NEEDED = "[0-9@=:]|AKIA|M[rs]|Herr|Frau|Monsieur|Madame|Señor"
#: Given names by what a title says of gender.
NAMES = {
    "female": ["Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Teresa", "Vera"],
    "male": ["Adam", "Bruno", "David", "Felix", "Hugo", "Jonas", "Lucas", "Martin", "Oscar", "Pablo", "Simon", "Viktor"],
    "any": ["Alex", "Andrea", "Charlie", "Dominique", "Jamie", "Kim", "Maxime", "Noa", "Robin", "Sascha"],
}
#: Titles by gender; the rest say nothing.
TITLES = {"female": r"^(?:Mrs|Ms|Frau|Madame|Señora)\b", "male": r"^(?:Mr|Herr|Monsieur|Señor)\b"}
SURNAMES = ["Arden", "Bellin", "Corvo", "Dalmas", "Ebner", "Ferro", "Galen", "Holt", "Irving", "Jansen", "Keller", "Lorenz",
            "Marin", "Navas", "Orlov", "Perrin", "Quint", "Rossi", "Sander", "Tilden", "Ulrich", "Varga", "Winter", "Zeller"]
#: What made-up names consist of.
ONSETS, NUCLEI, LISTED, MOST_SYLLABLES = ["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z"], ["a", "e", "i", "o", "u"], 2, 14
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def kind_of(entity: Column) -> Column:
    """The first pattern that takes the whole entity."""
    return reduce(lambda rest, kind: F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(rest),
                  reversed(PATTERNS), F.lit("other"))


def canonical(entity: Column, kind: Column) -> Column:
    """What different spellings of one entity share: letters of an address lowered, separators left out, of a secret its value."""
    return (F.when(kind == "email", F.lower(entity)).when(kind.isin("phone", "card", "iban"), F.regexp_replace(entity, r"[ \-.()+/]", ""))
            .when(kind == "secret_pair", F.regexp_replace(F.regexp_replace(entity, SECRET_PREFIX, ""), "[\"']$", ""))
            .otherwise(entity))


def stream(seed: Column, n: int) -> Column:
    """Numbers 0..255 from keyed digests, ``32 * n`` of them, as an array."""
    hexes = F.concat(*[F.sha2(F.concat(seed, F.lit(f"/{i}")), 256) for i in range(n)])
    return F.transform(F.sequence(F.lit(1), F.lit(64 * n), F.lit(2)), lambda i: F.conv(F.substring(hexes, i, F.lit(2)), 16, 10).cast("int"))


def _mapped(text: Column, seed: Column) -> Column:
    """Every ASCII digit and letter replaced by one of its class, any other letter or digit by a small letter; other
    characters, and so the format, stay.
    The n-th digit or letter gets the same replacement however an entity is spaced."""
    def letter(c: Column, i: Column, x: Column) -> Column:
        before = F.substring(x["t"], F.lit(1), i)
        nth = F.when(x["spaced"], F.length(F.regexp_replace(before, "[^0-9A-Za-z]", ""))).otherwise(i)
        r = F.get(x["n"], F.pmod(nth, F.lit(64)))
        pick = lambda letters: F.substring(F.lit(letters), F.pmod(r, F.lit(len(letters))) + 1, F.lit(1))
        return (F.when(c.between("0", "9"), pick(_DIGITS)).when(c.between("a", "z"), pick(_LOWER)).when(c.between("A", "Z"), pick(_UPPER))
                .when(c.rlike(r"[\p{L}\p{N}]"), pick(_LOWER)).otherwise(c))

    return let(F.struct(text.alias("t"), stream(seed, 2).alias("n"), text.rlike("[^0-9A-Za-z]").alias("spaced")),
               lambda x: F.array_join(F.transform(F.split(x["t"], ""), lambda c, i: letter(c, i, x)), ""))


def made_up(seed: Column, attempt: Column) -> Column:
    """A name of syllables; each attempt has one more, so names never run out."""
    n = F.least(attempt + (3 - LISTED), F.lit(MOST_SYLLABLES)).cast("int")
    pick = lambda parts, r: F.get(F.array(*map(F.lit, parts)), F.pmod(r, F.lit(len(parts))))
    return let(stream(seed, 1), lambda r: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(
        pick(ONSETS, F.get(r, i * 2)), pick(NUCLEI, F.get(r, i * 2 + 1)))), "")))


def surrogate(entity: Column, kind: Column, key: str, attempt: Column) -> Column:
    """A replacement of the same type and format, from the key, the entity and the number of the attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canonical(entity, kind), attempt.cast("string")), 256)
    number = lambda i, n: F.pmod(F.conv(F.substring(seed, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("long"), F.lit(n))
    part = lambda text, salt: _mapped(text, F.concat(seed, F.lit(salt)))
    # a domain keeps its public end; the rest of the address changes
    local, host = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    end = F.substring_index(host, ".", -1)
    more = F.when(attempt < 6, F.lit("")).otherwise(F.substring(seed, F.lit(33), attempt - 5))  # short ones have few of their length
    email = F.concat(part(local, "l"), more, F.lit("@"), part(F.substring(host, F.lit(1), F.length(host) - F.length(end) - 1), "h"), F.lit("."), end)
    prefix, quote = F.regexp_extract(entity, SECRET_PREFIX, 0), F.regexp_extract(entity, "[\"']?$", 0)
    secret = F.concat(prefix, part(canonical(entity, F.lit("secret_pair")), "s"), more, quote)
    # the first digits say what form a number has
    lead = F.regexp_extract(entity, r"^\D*(?:0\d|\d)", 0)
    numbered = F.concat(lead, part(F.substring(entity, F.length(lead) + 1, F.length(entity)), "o"))
    key_id = F.concat(F.lit("AKIA"), part(F.substring(entity, F.lit(5), F.length(entity)), "k"))
    iban = F.concat(F.substring(entity, F.lit(1), F.lit(2)), part(F.substring(entity, F.lit(3), F.length(entity)), "b"))
    octet = lambda i: F.pmod(number(i, 1 << 31), F.lit(254)).cast("string") if i else (F.lit(1) + number(0, 223)).cast("string")
    ip = F.concat_ws(".", *[octet(i) for i in range(4)])
    words = F.split(entity, " ")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), number(i, len(names)).cast("int"))
    given = F.when(entity.rlike(TITLES["female"]), pick(NAMES["female"], 1)).when(entity.rlike(TITLES["male"]), pick(NAMES["male"], 1)).otherwise(pick(NAMES["any"], 1))
    surname = F.when(attempt < LISTED, pick(SURNAMES, 2)).otherwise(made_up(F.concat(seed, F.lit("n")), attempt))
    name = F.concat_ws(" ", F.get(words, F.lit(0)), F.when(F.size(words) > 2, given), surname)
    return (F.when(kind == "email", email).when(kind == "secret_pair", secret).when(kind == "key_id", key_id).when(kind == "iban", iban)
            .when(kind.isin("phone", "card"), numbered)
            .when(kind == "ip", ip).when(kind == "name", name).otherwise(part(entity, "o")))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``entity, kind, surrogate`` of distinct entities: no two share a surrogate and none is a real entity.

    Each round keeps those alone with their surrogate (of several, the first) and sends the rest on.
    """
    spelled = stored(entities.select("entity", kind_of(F.col("entity")).alias("kind")).distinct())
    real = spelled.select(canonical(F.col("entity"), F.col("kind")).alias("taken")).distinct()
    kept, waiting, attempt = None, spelled, 0
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # made once, by all cores however few bytes the entities are
        made = waiting.repartition(tasks, "entity").withColumn("surrogate", surrogate(F.col("entity"), F.col("kind"), key, F.lit(attempt)))
        tried = stored(made).withColumns({"who": canonical(F.col("entity"), F.col("kind")), "as": canonical(F.col("surrogate"), F.col("kind"))})
        used = real if kept is None else real.union(kept.select(canonical(F.col("surrogate"), F.col("kind"))).distinct()).distinct()
        first = tried.groupBy("as").agg(F.min("who").alias("owner")).join(used, F.col("as") == F.col("taken"), "left_anti")
        settled = stored(tried.join(first.withColumnRenamed("as", "of"), (F.col("as") == F.col("of")) & (F.col("who") == F.col("owner")), "left"))
        good = settled.filter("owner is not null").select("entity", "kind", "surrogate")
        kept = good if kept is None else kept.unionByName(good)
        waiting, attempt = settled.filter("owner is null").select("entity", "kind"), attempt + 1
        if waiting.isEmpty():
            return kept


def with_surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced, and ``pii``: an array of (kind, surrogate, start, length)
    in the new text, in order; empty where there is none.

    A null text stays null.  Other columns stay, whatever their names; where ``pii`` is one of them, the added column
    gets as many underscores behind its name as make it new.
    Repeated rows get equal texts.  What is no entity stays byte for byte.
    """
    added = "pii"
    while added.lower() in [c.lower() for c in docs.columns]:
        added += "_"
    none = F.expr("cast(array() as array<struct<kind:string,surrogate:string,start:int,length:int>>)")
    found = F.col(text_col).rlike(NEEDED) & F.col(text_col).rlike(ANY)
    plain = docs.filter(~F.coalesce(found, F.lit(False))).withColumn(added, none)
    hit = stored(docs.filter(found).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                           F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0)).alias("entities"))
                 .withColumn("key", F.monotonically_increasing_id()))
    map_of = assign(hit.select(F.explode("entities").alias("entity")).distinct(), key)
    places = hit.select("key", F.posexplode("entities").alias("i", "entity"))
    known = (places.join(map_of, "entity").groupBy("key")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "kind", "surrogate"))), lambda x: F.struct(x["kind"].alias("kind"), x["surrogate"].alias("surrogate"))).alias("new")))
    gaps = F.split(F.col("row")[text_col], ANY, -1)
    joined = hit.join(known, "key").withColumn("gaps", gaps)
    text = F.array_join(F.zip_with("gaps", "new", lambda g, n: F.concat(g, F.coalesce(n["surrogate"], F.lit("")))), "")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    spans = F.aggregate(F.arrays_zip("gaps", "new"), start, lambda acc, x: F.when(x["new"].isNull(), acc).otherwise(F.struct(
        (acc["at"] + F.length(x["gaps"]) + F.length(x["new"]["surrogate"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(x["new"]["kind"].alias("kind"), x["new"]["surrogate"].alias("surrogate"), (acc["at"] + F.length(x["gaps"])).alias("start"),
                                              F.length(x["new"]["surrogate"]).alias("length")))).alias("out"))))["out"]
    changed = joined.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns], spans.alias(added))
    return plain.unionByName(changed)
