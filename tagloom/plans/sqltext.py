"""Small builders for the SQL checks."""
from __future__ import annotations

import re

from tagloom.rules.vocabulary import Vocabulary, word_forms

EDGE = r"[^\p{L}\p{N}_]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has_word(text: str, words: list[str]) -> str:
    """Whole-word test by a consuming-boundary regex (the dialect has no lookaround)."""
    forms = dict.fromkeys(f for w in words for f in word_forms(w))
    body = "|".join(re.sub(r"([.+*?()\[\]{}|^$\\])", r"\\\1", f) for f in forms)
    return f"regexp_matches({text}, {quote(f'(^|{EDGE})({body})($|{EDGE})')})"


def has_any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(t)})" for t in terms) + ")"


def tag_list(pairs: list[tuple[str, str]]) -> str:
    """List of tags whose condition holds, in the given order."""
    inner = ", ".join(f"CASE WHEN {cond} THEN {quote(tag)} END" for tag, cond in pairs)
    return f"list_filter([{inner}], lambda t: t IS NOT NULL)"


def joined(tags: str) -> str:
    return f"coalesce(array_to_string(list_sort({tags}), '|'), '')"


def extract(text: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(regexp_extract({text}, {quote(pattern)}, {group}) AS DOUBLE)"


def in_list(col: str, values) -> str:
    return f"{col} IN ({', '.join(quote(v) for v in values)})"


def vocabulary_cte() -> str:
    """``dim_tag(dimension, tag, ord)`` and ``dim_applies(dimension, category)`` as values."""
    v = Vocabulary()
    tags = ", ".join(f"({quote(d.name)}, {quote(t)}, {i})" for i, d in enumerate(v.dims.values()) for t in d.tags)
    scopes = ", ".join(f"({quote(d.name)}, {quote(c)})" for d in v.dims.values() for c in d.applies_to)
    cats = ", ".join(f"({quote(c)})" for c in v.categories)
    return (f"dim_tag AS (SELECT * FROM (VALUES {tags}) t(dimension, tag, ord)), "
            f"dim_applies AS (SELECT * FROM (VALUES {scopes}) t(dimension, category)), "
            f"dim_category AS (SELECT * FROM (VALUES {cats}) t(tag))")


def number_text(value: str) -> str:
    return f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) ELSE CAST({value} AS VARCHAR) END"
