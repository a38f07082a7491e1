"""The shop's product import file: 49 columns, one row per product and one for each further image."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.text import html_paragraphs, join_tags, slug

# Fixed values.
HEADERS = [
    "Handle", "Title", "Body (HTML)", "Vendor", "Product Category", "Type", "Tags", "Published",
    "Option1 Name", "Option1 Value", "Option2 Name", "Option2 Value", "Option3 Name", "Option3 Value",
    "Variant SKU", "Variant Grams", "Variant Inventory Tracker", "Variant Inventory Qty", "Variant Inventory Policy",
    "Variant Fulfillment Service", "Variant Price", "Variant Compare At Price", "Variant Requires Shipping",
    "Variant Taxable", "Variant Barcode", "Image Src", "Image Position", "Image Alt Text", "Gift Card",
    "SEO Title", "SEO Description", "Google Shopping / Google Product Category", "Google Shopping / Gender",
    "Google Shopping / Age Group", "Google Shopping / MPN", "Google Shopping / AdWords Grouping",
    "Google Shopping / AdWords Labels", "Google Shopping / Condition", "Google Shopping / Custom Product",
    "Google Shopping / Custom Label 0", "Google Shopping / Custom Label 1", "Google Shopping / Custom Label 2",
    "Google Shopping / Custom Label 3", "Google Shopping / Custom Label 4", "Variant Image", "Variant Weight Unit",
    "Variant Tax Code", "Cost per item", "Status",
]
CONSTANTS = {
    "Published": "TRUE", "Variant Inventory Tracker": "shopify", "Variant Inventory Policy": "deny",
    "Variant Fulfillment Service": "manual", "Variant Requires Shipping": "TRUE", "Variant Taxable": "TRUE", "Status": "active",
}


def import_file(products: DataFrame) -> DataFrame:
    """All columns of the import file, as text, for products of these columns, any of which may be missing: ``title``,
    ``description``, ``vendor``, ``category``, ``type``, ``tags``, ``sku``, ``inventory_qty``, ``price``, ``seo_title``,
    ``seo_description``, ``summary``, ``images``.

    The first row of a product holds its fields and its first image; every further image has a row with handle, image,
    position and the title as its text.  A missing value is empty; a product without title has the handle ``product``.
    The search title falls back on the title, the search description on the summary, the quantity on 0.
    """
    def given(name: str, default: Column | None = None) -> Column:
        default = F.lit("") if default is None else default
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in products.columns else default

    title = given("title")
    handle = slug(F.col("title") if "title" in products.columns else F.lit("product"))
    fields = {
        "Title": title, "Body (HTML)": html_paragraphs(given("description")), "Vendor": given("vendor"), "Product Category": given("category"),
        "Type": given("type"), "Tags": join_tags(F.col("tags")) if "tags" in products.columns else F.lit(""), "Variant SKU": given("sku"),
        "Variant Inventory Qty": given("inventory_qty", F.lit("0")), "Variant Price": given("price"), "SEO Title": given("seo_title", title),
        "SEO Description": given("seo_description", given("summary")),
    } | {name: F.lit(value) for name, value in CONSTANTS.items()}
    images = F.coalesce("images", F.array().cast("array<string>")) if "images" in products.columns else F.array().cast("array<string>")
    own = products.select(F.coalesce(handle, F.lit("product")).alias("handle"), title.alias("alt"), images.alias("images"),
                          F.struct(*[v.alias(k) for k, v in fields.items()]).alias("fields"))
    spread = own.select("*", F.posexplode_outer("images").alias("at", "image"))
    first, shown = F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("at").isNotNull()
    made = {"Handle": F.col("handle"), "Image Src": F.coalesce("image", F.lit("")),
            "Image Position": F.when(shown, (F.col("at") + 1).cast("string")).otherwise(""), "Image Alt Text": F.when(shown, F.col("alt")).otherwise("")}
    made |= {name: F.when(first, F.col("fields")[name]).otherwise("") for name in fields}
    return spread.select(*[F.coalesce(made.get(name, F.lit("")), F.lit("")).alias(name) for name in HEADERS])


FILE_ROWS = 50_000  # a file with line breaks in texts is read whole by one task, so files are kept short


def write_import_csv(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """CSV with a header; quotes are doubled, as spreadsheets do, and texts keep their lines.  A task begins a new file
    after ``file_rows`` rows."""
    rows.write.mode("errorifexists").option("maxRecordsPerFile", file_rows).csv(path, header=True, escape='"', quoteAll=True, encoding="UTF-8")


def read_import_csv(spark, path: str) -> DataFrame:
    schema = ", ".join(f"`{name}` string" for name in HEADERS)
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=True, enforceSchema=False).fillna("")
