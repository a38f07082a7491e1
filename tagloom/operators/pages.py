"""Links, metadata and images of parsed pages.

Inputs are the rows of ``html_elements``.  A page's elements are one document's,
so per-page aggregates are bounded by the document.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import media as M
from tagloom.functions.text import containing
from tagloom.functions.urls import MEDIA_WORDS, is_category_link, is_product_link
from tagloom.operators.ordering import first_rows

# Image type | CSS selector, in order of preference.
IMAGE_SELECTORS = """
hero | .hero-banner img
hero | .hero-image img
hero | .hero-section img
hero | .main-banner img
hero | .featured-banner img
hero | .homepage-hero img
hero | .hero-slider img
hero | [data-hero] img
hero | .hero-container img
marketing | .promo-banner img
marketing | .promotion img
marketing | .marketing-banner img
marketing | .campaign img
marketing | .advertisement img
marketing | .promo-section img
marketing | .marketing-content img
marketing | .featured-promo img
branding | .brand-banner img
branding | .brand-hero img
branding | .brand-promotion img
branding | .brand-campaign img
branding | .brand-marketing img
gallery | .product-gallery img
gallery | .product-image-gallery img
gallery | .product-photos img
gallery | .gallery-image img
gallery | [data-gallery] img
gallery | .main-image img
gallery | .product-main-image img
thumbnails | .product-thumbnails img
thumbnails | .product-thumb img
thumbnails | .thumbnail-list img
thumbnails | .thumbs img
thumbnails | [data-thumbnail] img
zoom | [data-zoom-image]
zoom | [data-large-image]
zoom | [data-full-image]
zoom | .zoom-image
zoom | [data-zoom]
carousel | .carousel img
carousel | .slider img
carousel | .swiper-slide img
carousel | .product-carousel img
carousel | [data-carousel] img
alternative | .product-image img
alternative | .product-media img
alternative | .media-gallery img
alternative | picture img
alternative | [data-role="gallery"] img
"""


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _classes() -> Column:
    return F.coalesce(_attr("class"), F.lit(""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def links(elements: DataFrame) -> DataFrame:
    """Links with their raw and resolved address, text and kind, first occurrence each."""
    raw = _attr("href")
    rows = elements.filter((F.col("tag") == "a") & raw.isNotNull()).select(
        "page_id", "ord", raw.alias("raw"), F.col("href").alias("link"), _strip(F.col("text")).alias("text"),
        is_category_link(raw).alias("is_category"), is_product_link(raw).alias("is_product"))
    return first_rows(rows, ["page_id", "link"], F.col("ord"))


def media_links(elements: DataFrame) -> DataFrame:
    """Links to media files and, apart from them, links that speak of media."""
    text = F.lower(F.coalesce("text", F.lit("")))
    spoken = F.lit(False)
    for word in MEDIA_WORDS:
        spoken = spoken | text.contains(word) | F.lower("raw").contains(F.lit(word.replace(" ", "-")))
    rows = links(elements).select("page_id", "link", "text", M.media_file_type(F.col("link")).alias("file_type"),
                                  spoken.alias("by_keyword"), M.is_uk(F.col("link"), F.col("text")).alias("uk"))
    return rows.filter(F.col("file_type").isNotNull() | F.col("by_keyword"))


def _first_value(cond: Column, value: Column, name: str) -> Column:
    return F.min_by(F.when(cond, value), F.when(cond, F.col("ord"))).alias(name)


def page_metadata(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Title, meta and Open Graph values, JSON-LD product, with the fallbacks.

    All values come from one aggregation per page of first matching elements.
    """
    tag, content = F.col("tag"), F.when(_attr("content") != "", _attr("content"))
    name, prop = F.lower(F.coalesce(_attr("name"), F.lit(""))), F.coalesce(_attr("property"), F.lit(""))
    itemprop = F.coalesce(_attr("itemprop"), F.lit(""))
    classes = F.split(_classes(), r"\s+")

    def has(c: str) -> Column:
        return F.array_contains(classes, c)

    product = F.from_json(F.when((tag == "script") & (_attr("type") == "application/ld+json"), F.col("text")),
                          "`@type` string, name string, description string, offers struct<price:string>")
    is_product = product["@type"] == "Product"
    body = _strip(F.col("text"))

    def choice(*rules: Column) -> Column:
        """Element order by the first rule it meets, so earlier rules win."""
        chain = F
        for i, rule in enumerate(rules):
            chain = chain.when(rule, F.struct(F.lit(i).alias("r"), F.col("ord").alias("o")))
        return chain

    about = choice((tag == "div") & has("product-description"), (tag == "div") & has("description"),
                   (tag == "div") & (itemprop == "description"), (tag == "div") & has("product-details"))
    price = choice((tag == "span") & has("price"), (tag == "div") & has("price"), itemprop == "price", has("product-price"))
    stock = tag.isin("span", "div") & F.lower(_classes()).rlike("stock|availability")
    gone = F.lower(F.col("text")).rlike("out of stock|sold out|unavailable")
    rows = elements.groupBy("page_id").agg(
        _first_value(tag == "title", body, "title"),
        _first_value((tag == "meta") & (name == "description") & content.isNotNull(), content, "meta_description"),
        _first_value((tag == "meta") & (name == "keywords") & content.isNotNull(), content, "keywords"),
        _first_value((tag == "meta") & (prop == "og:title") & content.isNotNull(), content, "og_title"),
        _first_value((tag == "meta") & (prop == "og:description") & content.isNotNull(), content, "og_description"),
        _first_value((tag == "meta") & (prop == "og:image") & content.isNotNull(), content, "og_image"),
        F.max_by(F.when(is_product, product), F.when(is_product, F.col("ord"))).alias("ld"),
        _first_value(tag == "h1", body, "h1"),
        F.min_by(body, about).alias("about"), F.min_by(body, price).alias("price_text"),
        _first_value(stock, gone, "gone"))
    empty = F.lit("")

    def first_of(*cols) -> Column:
        return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cols], empty)

    return pages.select("page_id", "url").join(rows, "page_id", "left").select(
        "page_id", "url", F.coalesce("title", empty).alias("title"),
        first_of("ld.description", "meta_description", "about").alias("description"),
        F.coalesce("keywords", empty).alias("keywords"), F.coalesce("og_title", empty).alias("og_title"),
        F.coalesce("og_description", empty).alias("og_description"), F.coalesce("og_image", empty).alias("og_image"),
        first_of("ld.name", "h1").alias("product_name"), first_of("ld.offers.price", "price_text").alias("price"),
        (~F.coalesce("gone", F.lit(False))).alias("in_stock"))


def breadcrumbs(elements: DataFrame) -> DataFrame:
    """Breadcrumb texts in order: a nav's, else an ol's, else a ul's.

    Items nest, so a text may repeat, as in the source."""
    def inside(tag: str) -> Column:
        return F.exists("within", lambda m: F.lower(m).rlike(rf"^{tag}\..*breadcrumb"))

    kind = F.when(inside("nav"), 0).when(inside("ol"), 1).when(inside("ul"), 2)
    text = _strip(F.col("text"))
    rows = elements.filter(F.col("tag").isin("li", "a", "span")).select("page_id", "ord", text.alias("text"), kind.alias("kind")) \
        .filter(F.col("kind").isNotNull())
    best = rows.groupBy("page_id").agg(F.min("kind").alias("kind"))
    return rows.join(best, ["page_id", "kind"]).filter(~F.col("text").isin("", ">", "/", "»")).select("page_id", "ord", "text")


def page_images(elements: DataFrame) -> DataFrame:
    """Images by selector preference; the first selector that finds a URL names its type.

    Placeholders and logos are left out.
    """
    conditions = []
    for rank, (kind, selector) in enumerate(M.rows_of(IMAGE_SELECTORS)):
        outer, _, inner = selector.rpartition(" ")
        mark = (outer or inner).replace('"', "")
        if outer:
            cond = (F.col("tag") == inner) & F.array_contains("within", mark)
        elif mark.startswith("."):
            cond = F.array_contains(F.split(_classes(), r"\s+"), mark[1:])
        else:
            cond = F.map_contains_key("attrs", mark.strip("[]"))
        conditions.append(F.when(cond, F.struct(F.lit(rank).alias("selector"), F.lit(kind).alias("kind"))))
    hit = F.get(F.array_compact(F.array(*conditions)), F.lit(0))
    rows = elements.filter(F.size("image_urls") > 0).select("page_id", "ord", "image_urls", hit.alias("hit")) \
        .filter("hit is not null") \
        .select("page_id", "ord", "hit.selector", "hit.kind", F.posexplode("image_urls").alias("pos", "image_url"))
    best = first_rows(rows, ["page_id", "image_url"], F.col("selector"), F.col("ord"), F.col("pos"))
    return best.filter(~M.is_placeholder(F.col("image_url"))).select(
        "page_id", "image_url", "kind", M.image_priority(F.col("kind")).alias("priority"),
        (F.col("selector") * 1_000_000 + F.col("ord")).alias("ord"))


def plain_images(elements: DataFrame) -> DataFrame:
    """All ``img`` URLs that look like product images, first occurrence each."""
    size = [F.coalesce(_attr(a), F.lit("")).try_cast("int") for a in ("width", "height")]
    rows = elements.filter((F.col("tag") == "img") & (F.size("image_urls") > 0)).select(
        "page_id", "ord", F.get("image_urls", F.lit(0)).alias("image_url"), size[0].alias("w"), size[1].alias("h"))
    kept = rows.filter(M.is_product_image(F.col("image_url"), F.col("w"), F.col("h")))
    return first_rows(kept.select("page_id", "image_url", "ord"), ["page_id", "image_url"], F.col("ord"))


def match_brands(rows: DataFrame, brands: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """First brand, in list order, named in the URL, else in the text.

    Containment is an equi-join on one short gram of each brand, then a test.
    Neither side is broadcast by force.
    """
    names = brands.select("brand", F.col("ord").alias("b_ord"), F.lower("brand").alias("plain"),
                          F.replace(F.lower("brand"), F.lit(" "), F.lit("-")).alias("slug"))
    forms = names.select("brand", "b_ord", F.explode(F.array_distinct(F.array(
        F.struct(F.lit(0).alias("place"), F.col("plain").alias("form")),
        F.struct(F.lit(0).alias("place"), F.col("slug").alias("form")),
        F.struct(F.lit(1).alias("place"), F.col("plain").alias("form"))))).alias("f")).select("brand", "b_ord", "f.*") \
        .filter("form <> ''")
    words = forms.select("form").distinct()

    def pieces(col: str, place: int) -> DataFrame:
        low = rows.select("row_id", F.lower(F.coalesce(col, F.lit(""))).alias("_low"))
        return containing(low, "_low", words, "form").select("row_id", F.lit(place).alias("place"), "form")

    found = pieces(url, 0).unionByName(pieces(text, 1)).join(forms, ["place", "form"]).groupBy("row_id").agg(
        F.min_by("brand", F.struct("place", "b_ord")).alias("brand"))
    return rows.join(found, "row_id")
