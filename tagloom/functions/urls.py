"""URL columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Shop-like names built around a domain's first label.
ALTERNATIVE_FORMS = ["%sstore", "%sshop", "%s-store", "%s-shop", "shop%s", "store%s"]

# Link texts and paths.
CATEGORY_PATHS = """
/vape-kits, /vape-kits/, /kits, /disposable-vapes, /disposables, /disposable, /vape-mods, /mods,
/e-liquids, /e-liquid, /liquids, /tanks, /vape-tanks, /coils, /replacement-coils, /batteries,
/vape-batteries, /accessories, /vape-accessories
"""
PRODUCT_PATHS = [r"/products?/[a-z0-9\-]+", r"/[a-z\-]+/[a-z0-9\-]+\.html", r"/p/[a-z0-9\-]+", r"/product/[a-z0-9\-]+"]
MEDIA_WORDS = ["media", "press", "download", "resources", "brand assets", "marketing", "kit"]


def normalise_url(url: Column) -> Column:
    """Trimmed, with https where no web scheme is given."""
    t = F.trim(url)
    return F.when(t.startswith("http://") | t.startswith("https://"), t).otherwise(F.concat(F.lit("https://"), t))


def url_problem(url: Column) -> Column:
    """Why a URL is unusable, '' if it is fine."""
    t = F.trim(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(normalise_url(t), r"^https?://", "")
    return F.when(F.coalesce(url, F.lit("")) == "", "URL is empty").when(t.contains(" "), "URL contains spaces") \
        .when(rest == "", "Missing domain").otherwise("")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def file_name(url: Column, default: str = "media-pack.zip") -> Column:
    """Decoded last path segment, or the default if it is no file name."""
    last = F.regexp_extract(path(url), r"([^/]*)$", 1)
    # '+' stays: only percent escapes are decoded in paths
    decoded = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    return F.when((last == "") | ~last.contains("."), F.lit(default)).otherwise(decoded)


def alternative_domains(url: Column) -> Column:
    """Candidate shop domains of a site; empty for hosts without a dot."""
    labels = F.split(host(url), r"\.")
    base = F.get(labels, F.lit(0))
    rest = F.array_join(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), ".")
    made = F.array(*[F.concat(F.lit("https://"), F.lit(form.split("%s")[0]), base, F.lit(form.split("%s")[1]),
                              F.lit("."), rest) for form in ALTERNATIVE_FORMS])
    return F.when(F.size(labels) < 2, F.array().cast("array<string>")).otherwise(made)


def page_url(url: Column, page: Column) -> Column:
    """URL of a result page; page 1 is the URL itself."""
    mark = F.when(url.contains("?"), "&page=").otherwise("?page=")
    return F.when(page <= 1, url).otherwise(F.concat(url, mark, page.cast("string")))


def is_category_link(href: Column) -> Column:
    from tagloom.functions.text import contains_any
    from tagloom.rules.vocabulary import items
    return contains_any(F.lower(href), items(CATEGORY_PATHS))


def is_product_link(href: Column) -> Column:
    return href.rlike("(?i)" + "|".join(PRODUCT_PATHS))
