"""Readers and writers for catalogue files.

All columns are read as text and typed on demand; nothing is inferred, so a
reader never scans twice.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tagloom.session import cut

# The columns of a catalogue export that the operators read.
PRODUCT_COLUMNS = {
    "Handle": "handle", "Title": "title", "Body (HTML)": "description", "Vendor": "vendor",
    "Product Category": "product_category", "Type": "type", "Tags": "tags",
    "Option1 Name": "option1_name", "Option1 Value": "option1_value", "Variant SKU": "variant_sku",
    "Variant Price": "variant_price", "Image Src": "image", "Image Position": "image_position",
    "Status": "status",
}
SKU_NAMES = ["Variant SKU", "SKU", "sku"]
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "gif", "webp"]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Fails before any job if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def column_or_blank(df: DataFrame, *names: str) -> Column:
    """The first of several spellings a file may use, else blank."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`")
    return F.lit("")


def read_csv(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """CSV with quoted multi-line bodies, every column text.

    The header names the columns; ``tolerant`` leaves malformed records out, whatever columns are read later.
    """
    plain = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
             .option("mode", "PERMISSIVE").option("inferSchema", False))
    if not tolerant:
        return plain.csv(path)
    columns = plain.csv(path).columns
    return _marked(spark, path, columns).filter(F.col(_CORRUPT).isNull() & _touched(columns)).drop(_CORRUPT)


_CORRUPT = "corrupt_record_text"


def _marked(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The records with the text of malformed ones in a further column, which makes the parser look at whole records."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _CORRUPT]])
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("escape", '"').option("columnNameOfCorruptRecord", _CORRUPT).csv(path))


def _touched(columns: list[str]) -> Column:
    """Always true.  A scan of nothing but the text of malformed records is refused, so another column is read too."""
    return F.length(F.coalesce(F.col(f"`{columns[0]}`"), F.lit(""))) >= 0


def read_rejects(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The malformed records of a CSV as text."""
    return _marked(spark, path, columns).filter(F.col(_CORRUPT).isNotNull() & _touched(columns)).select(F.col(_CORRUPT).alias("_corrupt"))


#: So many splits of files are described to every task by broadcast (a path and three numbers each); more are joined by a shuffle.
SPLITS_SENT = 50_000


def numbered(read: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """Adds the place of each row, from 0: along all files by path, or, if ``file`` names a column for the
    path, along its own file.

    ``read`` is a scan of files as it comes from a reader.  Rows of one split of a file stay together in a
    task, so a row's place in its split is told from ids that grow along the task.  One pass counts the rows of
    each split (a narrow row for each is stored), their sums place the splits, and nothing is sorted.  Both
    passes must see the same rows, so a reader that drops malformed rows should not be numbered.
    """
    at = read.select("*", F.col("_metadata.file_path").alias("split_file"), F.col("_metadata.file_block_start").alias("split_start"),
                     F.monotonically_increasing_id().alias("split_id"))
    splits = cut(at.groupBy("split_file", "split_start").agg(F.min("split_id").alias("first_id"), F.count("*").alias("rows_there")))
    along = Window.partitionBy("split_file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("split_file", "split_start", "first_id", F.coalesce(F.sum("rows_there").over(along), F.lit(0)).alias("rows_before"))
    if file is None:
        files = splits.groupBy("split_file").agg(F.sum("rows_there").alias("rows_there"))
        ahead = files.select("split_file", F.coalesce(F.sum("rows_there").over(
            Window.orderBy("split_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("files_before"))  # a row a file
        placed = placed.join(ahead, "split_file").select("split_file", "split_start", "first_id", (F.col("rows_before") + F.col("files_before")).alias("rows_before"))
    if splits.count() <= SPLITS_SENT:
        placed = F.broadcast(placed)
    place = (F.col("rows_before") + F.col("split_id") - F.col("first_id")).alias(name)
    return at.join(placed, ["split_file", "split_start"]).select(
        *[F.col(f"`{c}`") for c in read.columns], *([F.col("split_file").alias(file)] if file else []), place)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue rows under plain names, missing values blank; all other columns follow
    under their own names, so an export can be written back with all of them.

    ``ord`` is the row's place over all files by path, from 0.
    """
    raw = numbered(require_columns(read_csv(spark, path), ["Handle", "Title"]), "place_in_files")
    named = [column_or_blank(raw, *(SKU_NAMES if new == "variant_sku" else [old])).alias(new)
             for old, new in PRODUCT_COLUMNS.items()]
    used = {*PRODUCT_COLUMNS, *SKU_NAMES}
    more = [F.col(f"`{c}`") for c in raw.columns if c not in used and c not in PRODUCT_COLUMNS.values() and c not in ("ord", "place_in_files")]
    rows = raw.select(*named, *more, "place_in_files")
    clean = [F.when(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`") == "nan"), "").otherwise(F.col(f"`{c}`")).alias(c) for c in rows.columns[:-1]]
    return rows.select(*clean, F.col("place_in_files").alias("ord"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their number in the file, from 1.  A large file is read by many tasks."""
    lines = numbered(spark.read.option("lineSep", "\n").text(path), "place", file="file")
    return lines.select("file", (F.col("place") + 1).alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("line"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """JSON documents (an object or an array of objects a file), or one object per line, with a given schema."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; missing values are left out."""
    df.write.mode("overwrite").json(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    """One JSON object per line; structs and arrays keep their nesting."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_tiers(rows: DataFrame, path: str) -> None:
    """CSV files by tier, each with a header, in one pass over the rows."""
    rows.write.mode("overwrite").partitionBy("tier").option("header", True).option("escape", '"').csv(path)


def append_aligned(rows: DataFrame, path: str) -> None:
    """Append to existing CSV output by name.  Columns that either side lacks are blank there.

    Rows without a new column are appended as files.  A new column changes the header of every file,
    so then all rows are written anew beside the output, which takes its place when it is complete.
    """
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    options = {"header": True, "escape": '"'}
    if not store.exists(folder):
        rows.write.mode("append").options(**options).csv(path)
        return
    there = spark.read.options(**options, multiLine=True).csv(path)
    columns = there.columns + [c for c in rows.columns if c not in there.columns]

    def filled(df: DataFrame) -> DataFrame:
        return df.select(*[(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])

    if columns == there.columns:
        filled(rows).write.mode("append").options(**options).csv(path)
        return
    beside, before = (spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in (".next", ".before"))
    filled(there).unionByName(filled(rows)).write.mode("overwrite").options(**options).csv(beside.toString())
    store.delete(before, True)
    if not (store.rename(folder, before) and store.rename(beside, folder)):
        raise OSError(f"could not replace {path}; its rows are in {before.toString()}")
    store.delete(before, True)


def file_inventory(spark: SparkSession, path: str, suffixes: list[str] | None = None) -> DataFrame:
    """Files by suffix with size and time; contents are never read."""
    wanted = "*.{" + ",".join(suffixes or IMAGE_SUFFIXES) + "}"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", wanted).load(path).select("path", "length", "modificationTime"))
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -3).alias("brand"), F.element_at(parts, -2).alias("site"),
                        F.element_at(parts, -1).alias("name"), F.col("length").alias("size"), "modificationTime")


def read_inventories(spark: SparkSession, pattern: str, schema: T.StructType | str, site: str | None = None,
                     brand: str | None = None, category: str | None = None, lines: bool = False) -> DataFrame:
    """Products of many inventory files, filtered by site, brand or category."""
    rows = read_json(spark, pattern, schema, lines)
    for col, wanted in (("site", site), ("brand", brand), ("category", category)):
        if wanted is not None:
            rows = rows.filter(F.col(col) == wanted)
    return rows
