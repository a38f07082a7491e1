"""Token counts through a digest cache.

The cache is a table keyed by (digest of the normalised content, digest of the tokenizer file).  A run
joins digests to it, encodes each distinct content that is missing once, appends the new counts and joins
again.  Texts move only for the misses; hits move digests.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.llm.stored import join_counted, stored
from tagloom.llm.tokens import TEXTS, encoder
from tagloom.session import cut, shared_dir

CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def new_cache(spark: SparkSession) -> str:
    """The path of an empty cache in the shared folder."""
    path = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    spark.createDataFrame([], CACHE).write.parquet(path)
    return path


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Counts of one tokenizer version; a digest that two runs appended counts once."""
    stored = spark.read.schema(CACHE).parquet(path).filter(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def normalised(text):
    """Content as it is encoded: a null text is empty.  Nothing that could change a count is folded."""
    return F.coalesce(text, F.lit(""))


def encode_misses(misses: DataFrame, vocabulary: str, keep_space: bool) -> DataFrame:
    """``digest, n_tokens`` of rows ``digest, text``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, True, keep_space)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    counts = encode.texts(part.column(1).cast(pa.binary()).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
        finally:
            encode.forget()

    return misses.select("digest", "text").mapInArrow(count, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, id_col: str = "doc_id", text_col: str = "text",
                 keep_space: bool = True) -> DataFrame:
    """``id, n_bytes, n_tokens`` for every row; the cache at ``cache`` gains the distinct misses.

    Repeated rows and ids, null ids and null texts keep their rows; other columns are not read.  Special
    strings inside texts count as the library's default has them.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(vocabulary)
    text = normalised(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"),
                        F.octet_length(text).cast("long").alias("n_bytes"))
    known = read_cache(spark, cache, version)
    # one row stands for each missing content; it is the row, not its key, that is hot, so ids break it up
    missing = cut(keyed.join(known, "digest", "left_anti").groupBy("digest").agg(F.min("id").alias("chosen")))
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    chosen = texts.join(missing.withColumnRenamed("digest", "of"),
                        (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("chosen")), "left_semi")
    counts = encode_misses(chosen, vocabulary, keep_space)
    (counts.dropDuplicates(["digest"]).select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
     .write.mode("append").parquet(cache))
    keyed = stored(keyed)
    rows_of = keyed.groupBy("digest").agg(F.count("*").alias("rows"))
    counted = stored(rows_of.join(read_cache(spark, cache, version), "digest"))
    return join_counted(keyed, counted, "digest", "rows").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
