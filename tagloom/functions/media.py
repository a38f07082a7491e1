"""Media file and image metadata: types, categories, scores, sizes."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagloom.functions.text import contains_any, fixed
from tagloom.rules.vocabulary import items

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
# suffix | category | priority | content
FILE_TYPES = """
.zip | archive | 1 | Compressed archive
.rar | archive | 1 | Compressed archive
.7z | archive | 1 | Compressed archive
.tar.gz | archive | 1 | Compressed archive
.tgz | archive | 1 | Compressed archive
dropbox_shared | archive | 1 | Dropbox shared folder
.pdf | document | 2 | Documentation
.jpg | image | 3 | High-res images
.jpeg | image | 3 | High-res images
.png | image | 3 | High-res images
.svg | vector | 3 | Vector graphics
.ai | vector | 3 | Vector graphics
.eps | vector | 3 | Vector graphics
"""

FILE_CATEGORY_WORDS = """
logos | logo, brand, symbol, mark
marketing-materials | banner, poster, flyer, ad, promo, campaign
"""
FILE_CATEGORY_SUFFIXES = """
product-images | .jpg, .jpeg, .png, .webp, .gif, .bmp, .tiff
documentation | .pdf, .doc, .docx, .txt, .md, .rtf
vectors | .svg, .ai, .eps, .cdr
videos | .mp4, .mov, .avi, .wmv, .flv, .webm
fonts | .ttf, .otf, .woff, .woff2
"""

CONTENT_CATEGORIES = """
product | product, item, device, kit, mod
lifestyle | lifestyle, user, person, vaping, using
technical | specs, specification, diagram, schematic, manual
marketing | banner, promo, promotion, marketing, campaign
branding | logo, brand, trademark, identity
"""

CONTENT_TAGS = """
product-shot | product, white-background, isolated
unboxing | box, packaging, unbox
comparison | vs, compare, comparison
infographic | info, graphic, chart, diagram
lifestyle-photo | lifestyle, person, user
close-up | closeup, close-up, detail, macro
hero-image | hero, main, featured
thumbnail | thumb, thumbnail, small
banner | banner, header, cover
social-media | social, instagram, facebook, twitter
e-liquid | liquid, juice, flavor, flavour
coil | coil, atomizer, head
battery | battery, power, cell
pod | pod, cartridge
tank | tank, reservoir
drip-tip | drip, tip, mouthpiece
accessories | accessory, accessories, cable, charger
color-variant | color, colour, variant, variation
kit-contents | contents, includes, package
size-comparison | size, dimension, measurement
compact-size | small, mini, compact
large-size | large, big, xl
high-resolution | hd, high-res, highres, 4k
"""

CONTENT_TYPES = """
.jpg | image/jpeg
.jpeg | image/jpeg
.png | image/png
.gif | image/gif
.svg | image/svg+xml
.webp | image/webp
.bmp | image/bmp
.pdf | application/pdf
.ai | application/postscript
.eps | application/postscript
.psd | image/vnd.adobe.photoshop
"""

UK_TERMS = """
uk, united kingdom, british, england, scotland, wales, northern ireland, london, manchester,
birmingham, leeds, glasgow, edinburgh, cardiff, belfast, gbp, £, /uk/, /gb/, -uk, _uk, uk-, uk_
"""

PLACEHOLDERS = "placeholder, no-image, default, loading, spinner, 1x1, blank, dummy"
LOGO_MARKS = "logo, brand-icon, watermark"
NOT_PRODUCT = "logo, icon, sprite, badge"

QUALITY_WEIGHTS = {"resolution": 0.30, "sharpness": 0.25, "color": 0.20, "compression": 0.15, "background": 0.10}
NAME_PREFIXES = ["img_", "image_", "photo_", "pic_"]
COUNTERFEIT_WORDS = ["fake", "replica", "copy", "clone", "knockoff"]
# end of fixed values -------------------------------------------------------


def rows_of(text: str) -> list[list[str]]:
    return [[p.strip() for p in line.split("|")] for line in text.strip().splitlines()]


def _chain(rows, test) -> Column:
    chain = F
    for name, value in rows:
        chain = chain.when(test(name), F.lit(value))
    return chain


def media_file_type(url: Column) -> Column:
    """Recognised file type of a URL, NULL if none."""
    low = F.lower(url)
    chain = F.when(low.contains("dropbox.com/scl/"), "dropbox_shared").when(low.contains(".tar.gz"), ".tar.gz")
    for suffix, *_ in rows_of(FILE_TYPES):
        if suffix not in (".tar.gz", "dropbox_shared"):
            chain = chain.when(low.endswith(suffix), F.lit(suffix))
    return chain


def file_type_info(file_type: Column, part: str) -> Column:
    """``category``, ``priority`` or ``content`` of a file type; unknown types rank 99."""
    at = {"category": 1, "priority": 2, "content": 3}[part]
    rows = [(r[0], int(r[at]) if part == "priority" else r[at]) for r in rows_of(FILE_TYPES)]
    chain = _chain(rows, lambda s: file_type == s)
    return chain.otherwise(99) if part == "priority" else chain


def suffix_of(name: Column) -> Column:
    """Last suffix with its dot, lower case, '' if none."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1))


def pack_category(name: Column) -> Column:
    """Category of a file in a media pack: logo words, marketing words, then suffix."""
    low = F.lower(name)
    chain = _chain([(words, c) for c, words in rows_of(FILE_CATEGORY_WORDS)],
                   lambda words: contains_any(low, items(words)))
    for category, suffixes in rows_of(FILE_CATEGORY_SUFFIXES):
        chain = chain.when(suffix_of(name).isin(*items(suffixes)), F.lit(category))
    return chain.otherwise("other")


def standard_name(name: Column, brand: Column, category: Column) -> Column:
    """File name with brand prefix; a camera prefix is dropped."""
    owner = F.replace(F.lower(brand), F.lit(" "), F.lit("-"))
    suffix = F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1)
    stem = F.lower(F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", ""))
    stem = F.regexp_replace(stem, "^(" + "|".join(NAME_PREFIXES) + ")", "")
    middle = F.when(category == "logos", "-logo-").when(category == "product-images", "-product-").otherwise("-")
    return F.concat(owner, middle, stem, suffix)


def content_category(name: Column) -> Column:
    """``struct(category, confidence)``: most words present, the earlier category on
    ties; without any word product at 0.5."""
    low = F.lower(name)
    scored = []
    for rank, (category, words) in enumerate(rows_of(CONTENT_CATEGORIES)):
        hits = sum((low.contains(w).cast("int") for w in items(words)), F.lit(0))
        scored.append(F.struct(hits.alias("n"), F.lit(-rank).alias("r"), F.lit(category).alias("c")))
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, F.struct(
        best["c"].alias("category"), F.least(best["n"] / F.lit(3.0), F.lit(1.0)).alias("confidence"))).otherwise(
        F.struct(F.lit("product").alias("category"), F.lit(0.5).alias("confidence")))


def content_tags(name: Column) -> Column:
    """Tags of a file name, in rule order, then its format."""
    low = F.lower(name)
    tags = [F.when(contains_any(low, items(words)), F.lit(tag)) for tag, words in rows_of(CONTENT_TAGS)]
    fmt = F.when(low.endswith(".png"), "png-format").when(low.endswith(".jpg") | low.endswith(".jpeg"), "jpg-format") \
        .when(low.endswith(".svg"), "vector-format")
    return F.array_compact(F.array(*tags, fmt))


def content_type(name: Column) -> Column:
    return _chain(rows_of(CONTENT_TYPES), lambda s: suffix_of(name) == s).otherwise("application/octet-stream")


def is_uk(url: Column, link_text: Column) -> Column:
    """Any UK term in URL or link text; ``uk`` also counts inside words."""
    return contains_any(F.concat_ws("\n", F.lower(url), F.lower(link_text)), items(UK_TERMS))


def is_placeholder(url: Column) -> Column:
    return contains_any(F.lower(url), items(PLACEHOLDERS) + items(LOGO_MARKS))


def is_product_image(url: Column, width: Column, height: Column) -> Column:
    """Not declared smaller than 100 and no logo, icon, sprite or badge."""
    small = F.coalesce((width < 100) | (height < 100), F.lit(False)) & width.isNotNull() & height.isNotNull()
    return ~small & ~contains_any(F.lower(url), items(NOT_PRODUCT))


def image_priority(kind: Column) -> Column:
    return F.when(kind.isin("hero", "marketing", "branding", "gallery", "zoom", "carousel"), "high") \
        .when(kind.isin("thumbnails", "alternative"), "medium").otherwise("low")


def image_points(width: Column, height: Column, size: Column, priority: Column) -> Column:
    """Image score 0–100: resolution 40, size 20, shape 20, priority 20; parts
    are cut to whole points."""
    side = F.least(width, height)
    known = (width > 0) & (height > 0)

    def whole(x: Column) -> Column:
        return F.floor(x).cast("int")

    resolution = F.when(~F.coalesce(known, F.lit(False)), 0).when(side >= 800, 40) \
        .when(side >= 400, 20 + whole((side - 400) / F.lit(400) * 20)).otherwise(whole(side / F.lit(400) * 20))
    weight = F.when(~F.coalesce(size > 0, F.lit(False)), 0).when(size >= 100000, 20) \
        .when(size >= 10240, 10 + whole((size - 10240) / F.lit(100000 - 10240) * 10)) \
        .otherwise(whole(size / F.lit(10240) * 10))
    off = F.abs(1 - width / height)
    shape = F.when(~F.coalesce(known, F.lit(False)), 0).when(off <= 0.1, 20).when(off <= 0.3, 15) \
        .when(off <= 0.5, 10).otherwise(5)
    bonus = F.when(priority == "high", 20).when(priority == "medium", 10).otherwise(5)
    return F.least(resolution + weight + shape + bonus, F.lit(100))


def is_high_res(width: Column, height: Column) -> Column:
    return F.coalesce((width >= 800) & (height >= 800), F.lit(False))


def resolution_score(width: Column, height: Column) -> Column:
    side = F.least(width, height)
    return F.when(side < 400, 1.0).when(side < 800, 5 + (side - 400) / F.lit(400) * 2) \
        .when(side < 1200, 7 + (side - 800) / F.lit(400) * 2).otherwise(10.0)


def color_score(mode: Column) -> Column:
    return F.when(mode == "RGB", 10.0).when(mode == "RGBA", 9.0).when(mode == "L", 5.0) \
        .when(mode == "CMYK", 6.0).otherwise(4.0)


def compression_score(size: Column, width: Column, height: Column) -> Column:
    per_pixel = F.coalesce(F.try_divide(size, width * height), F.lit(0.0))
    return F.when(per_pixel < 0.5, 4.0).when(per_pixel < 1, 7.0).when(per_pixel < 2, 9.0).otherwise(10.0)


def sharpness_score(variance: Column) -> Column:
    """From the variance of grey values; below 100 the image is blurred."""
    return F.when(variance < 100, 3.0).when(variance < 200, 6.0).when(variance < 300, 8.0).otherwise(10.0)


def background_score(share: Column, brightness: Column) -> Column:
    """From the most frequent edge colour's share and brightness."""
    return F.when(share.isNull(), 6.0).when(share <= 0.7, 5.0).when(brightness > 240, 10.0) \
        .when(brightness > 200, 8.0).otherwise(7.0)


def overall_quality(resolution: Column, sharpness: Column, color: Column, compression: Column,
                    background: Column) -> Column:
    w = QUALITY_WEIGHTS
    return (resolution * w["resolution"] + sharpness * w["sharpness"] + color * w["color"]
            + compression * w["compression"] + background * w["background"])


def quality_passes(overall: Column, width: Column, height: Column, blurred: Column) -> Column:
    return (overall >= 6) & (F.least(width, height) >= 400) & ~blurred


def quality_issues(width: Column, height: Column, mode: Column, size: Column, blurred: Column,
                   uniform: Column) -> Column:
    """Texts of everything that lowered an image's scores."""
    unusual = F.concat(F.lit("Unusual color mode: "), mode)
    return F.array_compact(F.array(
        F.when(F.least(width, height) < 400, F.concat(
            F.lit("Low resolution: "), width.cast("string"), F.lit("x"), height.cast("string"))),
        F.when(blurred, F.lit("Image appears blurry")),
        F.when(mode == "L", F.lit("Grayscale image (no color)"))
        .when(mode == "CMYK", F.lit("CMYK color mode (should be RGB)"))
        .when(~mode.isin("RGB", "RGBA"), unusual),
        F.when(compression_score(size, width, height) == 4.0, F.lit("Heavy compression detected (possible artifacts)")),
        F.when(~uniform, F.lit("Non-uniform background"))))


def format_size(size: Column) -> Column:
    chain = F.when(size.isNull(), F.lit("Unknown"))
    for power, unit in enumerate(["B", "KB", "MB", "GB"]):
        chain = chain.when(size < 1024.0 ** (power + 1), F.concat(
            fixed(size / F.lit(1024.0 ** power), 1), F.lit(f" {unit}")))
    return chain.otherwise(F.concat(fixed(size / F.lit(1024.0 ** 4), 1), F.lit(" TB")))


def format_duration(seconds: Column) -> Column:
    """``42s``, ``3m 20s`` or ``1h 10m``; parts are rounded half to even."""
    def whole(x: Column) -> Column:
        return F.bround(x, 0).cast("bigint").cast("string")

    return F.when(seconds < 60, F.concat(whole(seconds), F.lit("s"))).when(
        seconds < 3600, F.concat(whole(seconds / F.lit(60)), F.lit("m "), whole(seconds % 60), F.lit("s"))).otherwise(
        F.concat(whole(seconds / F.lit(3600)), F.lit("h "), whole((seconds % 3600) / F.lit(60)), F.lit("m")))


def download_seconds(size: Column) -> Column:
    """Estimate at one megabyte per second; NULL without a size."""
    return F.when(size > 0, size / F.lit(1024 * 1024))


def restriction(status: Column, asks_login: Column) -> Column:
    """Why a file cannot be fetched freely, NULL if it can."""
    return F.when(status == 401, "Authentication required").when(status == 403, "Access forbidden") \
        .when(asks_login, "Authentication required")


def fit_within(width: Column, height: Column, max_width: int, max_height: int) -> Column:
    """``struct(width, height)`` scaled down to fit, aspect kept, fractions cut."""
    aspect = width / height
    wide = width > height

    def cut(x: Column) -> Column:
        return F.floor(x).cast("int")

    w1 = F.when(wide, F.lit(max_width)).otherwise(cut(max_height * aspect))
    h1 = F.when(wide, cut(max_width / aspect)).otherwise(F.lit(max_height))
    w2 = F.when(w1 > max_width, F.lit(max_width)).otherwise(w1)
    h2 = F.when(w1 > max_width, cut(max_width / aspect)).otherwise(h1)
    w3 = F.when(h2 > max_height, cut(max_height * aspect)).otherwise(w2)
    h3 = F.when(h2 > max_height, F.lit(max_height)).otherwise(h2)
    big = (width > max_width) | (height > max_height)
    return F.struct(F.when(big, w3).otherwise(width).alias("width"), F.when(big, h3).otherwise(height).alias("height"))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def image_extension(url: Column, mime: Column) -> Column:
    """Suffix from the URL's path, else from the content type, else .jpg."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    by_type = F.when(F.lower(mime) == "image/png", ".png").when(F.lower(mime) == "image/gif", ".gif") \
        .when(F.lower(mime) == "image/webp", ".webp").when(F.lower(mime) == "image/svg+xml", ".svg").otherwise(".jpg")
    return F.when(ext.isin("jpg", "jpeg", "png", "gif", "webp", "svg"), F.concat(F.lit("."), ext)).otherwise(by_type)
