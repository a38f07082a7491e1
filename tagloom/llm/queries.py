"""Registered queries of the subpackage: thin layers over its operators."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.llm import alignment, chat, decontaminate, filter_audit, jaccard_join, lm_score, packing, pii, quality, simhash, substring_dedup, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 ids, packed into sequences of 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, through a cache that starts empty."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                        token_counts.new_cache(spark))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of 35 words that also start elsewhere."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents beside the benchmark items that occur in them verbatim."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, cutoffs chosen on the labelled ones."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop(*quality.GRID)


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class of five-word Jaccard similarity 0.8 and their number of links."""
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control marks in its texts, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], rows.schema)
    done = chat.render(chat.fold_events(chat.turn_events(rows.unionByName(own))))
    back = done.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data and secrets replaced by surrogates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, key="documents").withColumn("n_entities", F.size("pii"))


@query
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and plain-text records of all pages."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those that are not held out."""
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the byte-level and the piece tokens of all documents."""
    return alignment.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and their component at 4 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


# The same rows in SQL, where SQL can state them; ids tell rows apart in the given tables.

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHECKS["op3_chat_formatting"] = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length('<|im_start|>') + length(role) + 1 + length(replace(text, '<|', '<||')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

CHECKS["op4_benchmark_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[pos:pos + m - 1], ' ') AS k FROM i), ms AS (SELECT DISTINCT m FROM iw),
p AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS pos FROM d, ms WHERE len(w) >= m),
h AS (SELECT doc_id, m, pos, item_id FROM (SELECT doc_id, m, pos, array_to_string(w[pos:pos + m - 1], ' ') AS k FROM p) JOIN iw USING (m, k)),
n AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS word FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

CHECKS["op10_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS pos FROM d WHERE len(w) >= 35), k AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 34], ' ')) AS k FROM p),
twice AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1), gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS word FROM k JOIN twice USING (k)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word) AS s FROM words ANTI JOIN gone USING (doc_id, word) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

CHECKS["op11_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, part, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, length(text) AS n, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS caps,
 regexp_matches(text, '[#$%&*|]') AS marked, doc_id > min(doc_id) OVER (PARTITION BY text) AS again FROM t),
d AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * caps > 5 * n, marked, again] AS fails,
 doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM m),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, e.i, f.i] AS o FROM l a, l b, l c, l e, l f WHERE len(list_distinct([a.i, b.i, c.i, e.i, f.i])) = 5),
s AS (SELECT o, l.i AS step FROM o, l),
r AS (SELECT part, array_to_string([chr((64 + x)::INT) for x in o], '') AS filter_order, step, o[step] AS f,
 list_bool_or([fails[x] for x in o[1:step]]) AS out, list_bool_or([false] || [fails[x] for x in o[1:step - 1]]) AS earlier,
 fails[o[step]] AS failing, len([x for x in fails if x]) = 1 AS alone, n, good, toxic FROM g, s),
k AS (SELECT part, filter_order, step, any_value(f) AS f, sum(n) FILTER (NOT out) AS kept, sum(n) FILTER (failing AND NOT earlier) AS removed,
 sum(n) FILTER (failing AND earlier) AS redundant, sum(n) FILTER (failing AND alone) AS unique_fails, sum(good) FILTER (failing AND NOT earlier) AS good_lost,
 sum(toxic) FILTER (failing AND NOT earlier) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
 coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
 coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM k"""
