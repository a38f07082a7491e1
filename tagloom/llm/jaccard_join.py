"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles, embedded as ``SIZE`` min-hashes.  Every run is a random
tree: a node samples coordinates, each with probability 1 / (threshold * SIZE), and sends a set to the
child named by its value there, so similar sets go the same way.  Small buckets are compared by brute
force; large ones are dealt in chunks, each chunk keeps one set for every cluster it finds, and what is
kept is split again at the next level.  Runs repeat until the recall asked for; where buckets were split more
than twice, their sets get further runs, until there are enough for the depth reached.

Sets that met and look alike are candidates.  Their connected clusters are then compared exactly, all
pairs of a cluster in blocks that give counts and spanning links, never lists of pairs.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.stored import join_counted, likely_in, stored
from tagloom.llm.words import LOWER, NOT_SPACE, Words, mixed, span_hashes, window_hashes, word_chunks

SIZE, WORDS = 64, 5
BUCKET, BLOCK = 1024, 1024
_FACTORS = (np.random.default_rng(5).integers(0, 1 << 63, SIZE, np.uint64) << np.uint64(1)) | np.uint64(1)


def runs_for(recall: float, levels: int = 2) -> int:
    """How many runs find a pair at the threshold with this probability, if it must share ``levels`` nodes."""
    one = (1 - math.exp(-1)) ** levels
    return math.ceil(math.log(1 - recall) / math.log(1 - one))


def runs_at(recall: float, levels: int, threshold: float) -> int:
    """The least number of runs that find a pair at the threshold with this probability, if a run must lead it
    through ``levels`` nodes: the mean over how many coordinates it has equal, each of which a node samples and
    follows on its own."""
    weight = [math.comb(SIZE, a) * threshold**a * (1 - threshold)**(SIZE - a) for a in range(SIZE + 1)]
    passed = [1.0] * (SIZE + 1)
    for _ in range(levels):
        passed = [1 - (1 - x / max(1.0, threshold * SIZE))**a for a, x in enumerate(passed)]
    runs = 1
    while sum(w * (1 - x)**runs for w, x in zip(weight, passed)) > 1 - recall:
        runs += 1
    return runs


def sampled(threshold: float, *node: np.ndarray | int) -> np.ndarray:
    """Which coordinates a node samples: a row of ``SIZE`` booleans for each node."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in node:
            h = mixed(np.asarray(part, np.uint64) + h * np.uint64(0xD1342543DE82EF95))
        every = mixed(h[..., None] + np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return every < np.uint64(min(2**64 - 1, int(2**64 / (threshold * SIZE))))


def children(path, coordinate, value) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mixed(np.asarray(path, np.uint64) + np.asarray(coordinate, np.uint64) * np.uint64(0xD1342543DE82EF95))
        return mixed(h + np.asarray(value, np.uint64))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle, by text; a text of fewer than five words is one shingle."""
    n = np.diff(words.first)
    at = np.arange(len(words.hash))
    full = at[at + WORDS <= words.first[words.doc + 1]] if len(at) else at
    doc, found = words.doc[full], window_hashes(words.hash, WORDS)[full] if len(full) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        doc, found = doc[order], np.concatenate([found, span_hashes(words.hash, words.first[short], words.first[short + 1])])[order]
    return doc, found


def embedded(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """``id, rep, sketch, paths`` of every text with a word: the hash of its words, one byte of each min-hash,
    and the nodes below the roots of all runs."""
    chosen = [(r, np.flatnonzero(sampled(threshold, r, 0))) for r in range(runs)]
    kind = docs.schema["id"].dataType.simpleString()

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in word_chunks(batches, "text", NOT_SPACE, LOWER):
            doc, found = shingles(words)
            if not len(doc):
                continue
            begin = np.flatnonzero(np.diff(doc, prepend=-1))
            doc = doc[begin]
            least = np.empty((len(begin), SIZE), np.uint64)
            for k in range(SIZE):
                least[:, k] = np.minimum.reduceat(found * _FACTORS[k], begin)
            rep = span_hashes(words.hash, words.first[doc], words.first[doc + 1])
            paths = np.stack([children(r, i, least[:, i]) for r, at in chosen for i in at], 1)
            sketch = mixed(least).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                part.column("id").take(pa.array(doc)), pa.array(rep.view(np.int64)), pa.array([row.tobytes() for row in sketch], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, paths.size + 1, paths.shape[1], dtype=np.int32)), pa.array(paths.ravel().view(np.int64)))],
                ["id", "rep", "sketch", "paths"])

    return docs.mapInArrow(embed, f"id {kind}, rep long, sketch binary, paths array<long>")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in order of ``keys``, regrouped so that no group is cut by the end of a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if held and any(held[-1].column(k)[-1].as_py() != v[0] for k, v in zip(keys, values)):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) if batch.num_rows > 1 else []
        if len(change):
            at = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks().to_batches()[0]
            held, batch = [], batch.slice(at)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, end, low)
            np.minimum.at(label, before[end], low)
        label = label[label]
        if (label[a] == label[b]).all() and (label == before).all():
            break
    return label


def clustered(rows: DataFrame, alike: int, threshold: float) -> DataFrame:
    """Compares the sets of each (path, chunk), sorted so; gives each set's root in it and, for the roots of a
    large bucket, the paths to go on with and the sketch, so that no later level has to look it up."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["path", "chunk"]):
            path, chunk = (batch.column(k).to_numpy() for k in ("path", "chunk"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SIZE)
            bucket = np.cumsum(np.concatenate([[0], (path[1:] != path[:-1]) | (chunk[1:] != chunk[:-1])]))
            left, right, on, ahead = [], [], np.arange(len(path)), 1
            while True:  # neighbours at growing distance, as long as any bucket reaches so far
                on = on[on + ahead < len(path)]
                on = on[bucket[on] == bucket[on + ahead]]
                if not len(on):
                    break
                near = on[(sketch[on] == sketch[on + ahead]).sum(1, dtype=np.int16) >= alike]
                left.append(near)
                right.append(near + ahead)
                ahead += 1
            root = roots(len(path), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)))
            rep = batch.column("rep")
            on = np.flatnonzero((root == np.arange(len(root))) & batch.column("large").to_numpy(zero_copy_only=False))
            who, coordinate = np.nonzero(sampled(threshold, path[on].view(np.uint64))) if len(on) else (on, on)
            nodes = children(path[on].view(np.uint64)[who], coordinate, sketch[on][who, coordinate]).view(np.int64)
            on = on[who]
            linked = np.flatnonzero(root != np.arange(len(root)))
            both = pa.array(np.concatenate([linked, on]))
            yield pa.RecordBatch.from_arrays([
                rep.take(both), pa.concat_arrays([rep.take(pa.array(root[linked])), pa.nulls(len(on), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(nodes)]),
                pa.concat_arrays([pa.nulls(len(linked), pa.binary()), pa.array([row.tobytes() for row in sketch[on]], pa.binary())])], ["rep", "root", "path", "sketch"])

    return rows.mapInArrow(compare, "rep long, root long, path long, sketch binary")


def started(sets: DataFrame, threshold: float, runs: range) -> DataFrame:
    """``rep, path``: the nodes below the roots of further runs, named by sketch bytes."""
    chosen = [(r, np.flatnonzero(sampled(threshold, r, 0))) for r in runs]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SIZE)
            for r, at in chosen:
                if len(at):
                    paths = np.stack([children(r, i, sketch[:, i]) for i in at], 1)
                    yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(np.repeat(np.arange(len(sketch)), len(at)))), pa.array(paths.ravel().view(np.int64))],
                                                     ["rep", "path"])

    return sets.select("rep", "sketch").mapInArrow(start, "rep long, path long")


def descended(active: DataFrame, sketches: DataFrame, threshold: float, alike: int, further: bool = False) -> tuple[DataFrame, int, DataFrame | None]:
    """Links found on and below the nodes of ``active``, how many levels they took, and, if over two and these are
    not ``further`` runs, the sets in buckets that were split at the second."""
    links, level, deep = None, 0, None
    while True:
        sizes = active.groupBy("path").agg(F.count("*").alias("c")).filter("c > 1")
        met = active.join(sizes, "path")
        met = met if level else met.join(sketches, "rep")  # most nodes below the roots hold one set, whose sketch need not move
        rows = (met.select("rep", "sketch", "path", (F.col("c") > BUCKET).alias("large"),
                        F.when(F.col("c") <= BUCKET, 0).otherwise(F.pmod(F.xxhash64("rep", "path"), F.ceil(F.col("c") / (BUCKET / 2)))).cast("long").alias("chunk")))
        dealt = rows.repartition("path", "chunk").sortWithinPartitions("path", "chunk", "rep")
        found = stored(clustered(dealt, alike, threshold))
        here = found.filter("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b"))  # components() folds repeats of all levels at once
        links = here if links is None else links.unionByName(here)
        onward = found.filter("path is not null").select("rep", "path", "sketch")  # a child has one parent, so none repeats
        level += 1
        if onward.isEmpty():
            return links, level, deep
        if level == 2 and not further:
            deep = stored(active.join(sizes.filter(F.col("c") > BUCKET), "path").select("rep").distinct())
        active = onward


def candidates(sets: DataFrame, threshold: float, alike: int, recall: float, runs: int) -> DataFrame:
    """``a, b``: links between sets that met in a bucket and have ``alike`` equal sketch bytes or more.

    ``runs`` are enough for two levels.  Sets in buckets that took more get as many runs as these levels need.
    """
    sketches = sets.select("rep", "sketch")
    links, levels, deep = descended(sets.select("rep", F.explode("paths").alias("path")), sketches, threshold, alike)
    while deep is not None and runs_at(recall, levels, threshold) > runs:
        more = range(runs, runs_at(recall, levels, threshold))
        again, reached, _ = descended(stored(started(sketches.join(deep, "rep"), threshold, more)), sketches, threshold, alike, True)
        links, levels, runs = links.unionByName(again), max(levels, reached), more.stop
    return links


def components(links: DataFrame) -> DataFrame:
    """``v, label``: the least vertex of each one's component.  Labels spread along links and jump to their
    label's label, so the rounds grow with the logarithm of a component's width; each round is stored."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))
    both = stored(links.select(F.inline(ends)).distinct())
    labels = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label"))
    labels = stored(labels)
    while True:
        seen = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = nearer.select(F.col("v").alias("label"), F.col("label").alias("over"))
        after = stored(nearer.join(jump, "label", "left").select("v", "old", F.coalesce("over", "label").alias("label")))
        labels = after.select("v", "label")
        if after.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Adds ``shingles``: the distinct hashes as sorted 64-bit integers in a binary; ``text`` goes, and so do
    rows whose text is not the one that ``rep`` stands for."""
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names) + ", shingles binary"

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in word_chunks(batches, "text", NOT_SPACE, LOWER):
            doc, found = shingles(words)
            edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
            rep = span_hashes(words.hash, words.first[:-1], words.first[1:]).view(np.int64)
            on = np.flatnonzero(rep == part.column("rep").to_numpy())
            sets = [np.unique(found[edges[k]:edges[k + 1]]).tobytes() for k in on]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(on)) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])

    return docs.mapInArrow(collect, schema)


def similar_in(sets: list[np.ndarray], threshold: float, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with Jaccard similarity of ``threshold`` or more: among all sets, or, where ``first`` is over 0,
    between the first ``first`` and the rest.  Common shingles are counted by a matrix product over the
    shingles that more than one set has."""
    size = np.array([len(s) for s in sets])
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), size), count[which] > 1
    column = np.cumsum(count > 1) - 1
    owner, column = owner[shared], column[which[shared]]
    left, right = (np.arange(first), np.arange(first, len(sets))) if first else (np.arange(len(sets)),) * 2
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        common += block[left] @ block[right].T
    union = size[left][:, None] + size[right][None, :] - common
    i, j = np.nonzero(common >= threshold * union - 1e-6 * union)
    exact = common[i, j].astype(np.int64) * 1_000_000 >= np.round(threshold * 1_000_000) * union[i, j].astype(np.int64)
    i, j = left[i[exact]], right[j[exact]]
    return (i, j) if first else (i[i < j], j[i < j])


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """``rep, links, root`` for each member of each block pair of a cluster: how many documents it is linked to
    there, and the least member it is connected with."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["cluster", "one", "other"]):
            keys = np.stack([batch.column(k).to_numpy() for k in ("cluster", "one", "other", "rep")])
            once = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])  # repeated rows give a set twice
            batch, keys = batch.filter(pa.array(once)), keys[:3, once]
            begin = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            rep, copies, block = (batch.column(k).to_numpy() for k in ("rep", "copies", "block"))
            texts = batch.column("shingles")
            links, root = np.zeros(len(rep), np.int64), rep.copy()
            for low, high in zip(begin, [*begin[1:], len(rep)]):
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in texts[int(low):int(high)]]
                first = int((block[low:high] == keys[1, low]).sum()) if keys[1, low] != keys[2, low] else 0
                i, j = similar_in(sets, threshold, first)
                links[low:high] = np.bincount(i, copies[low:high][j], high - low) + np.bincount(j, copies[low:high][i], high - low)
                root[low:high] = rep[low:high][roots(high - low, i, j)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(links), pa.array(root)], ["rep", "links", "root"])

    return members.mapInArrow(compare, "rep long, links long, root long")


def similarity_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id, n_links`` for every row.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; texts of one to four words are alike
    only if equal.  ``n_links`` is the number of other rows with a Jaccard similarity of ``threshold`` or more
    to this one, among its class; ``class_id`` is the least id of all rows connected by such links.  A row
    without words has no link and its own id as class.  Repeated rows are copies of each other.  A null id
    stays null; its class is the least id of the others, or null.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    runs = runs_for(recall)
    rows = stored(embedded(texts, threshold, runs))
    sets = stored(rows.groupBy("rep").agg(F.min("id").alias("chosen"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")))
    links = candidates(sets, threshold, math.floor(SIZE * (threshold - 0.2)), recall, runs)
    clusters = components(links)
    sizes = clusters.groupBy("label").agg(F.count("*").alias("m"))
    members = stored(clusters.join(sizes, "label").join(sets.select("rep", "chosen", "copies"), F.col("v") == F.col("rep"))
                     .select("rep", "copies", "chosen", F.col("label").alias("cluster"), F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")))
    near = likely_in(texts, members, F.col("id"), F.col("chosen"))  # few texts are in clusters; the others need not move
    found = shingle_sets(near.join(members, F.col("id").eqNullSafe(F.col("chosen"))).select("rep", "copies", "cluster", "blocks", "text"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    dealt = (found.withColumn("block", own).withColumn("peer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("one", F.least("block", "peer")).withColumn("other", F.greatest("block", "peer"))
             .repartition("cluster", "one", "other").sortWithinPartitions("cluster", "one", "other", "block", "rep"))
    results = stored(compared(dealt, threshold))
    counts = results.groupBy("rep").agg(F.sum("links").alias("links"))
    exact = components(results.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (sets.select("rep", "copies").join(counts, "rep", "left").join(exact.select(F.col("v").alias("rep"), "label"), "rep", "left")
             .select("rep", F.coalesce("label", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    known = stored(known)
    least = sets.join(known, "rep").groupBy("label").agg(F.min("chosen").alias("class_id"))
    by_rep = stored(known.join(sets.select("rep", "copies"), "rep").join(least, "label").select("rep", "copies", "class_id", "n_links"))
    worded = join_counted(rows.select("id", "rep"), by_rep, "rep", "copies", "inner").select("id", "class_id", "n_links")
    wordless = texts.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(wordless).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each class: the one with the least id stays; columns as they are.

    A row with a null id stays, as nothing names it.  Rows are named by id and a hash of the text together, so
    rows that share an id are judged each by its own text: of equal or similar ones, one stays.
    """
    key = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h")))
    keyed = docs.select(key.alias("row_key"), F.col(text_col).alias("text"))
    classes = similarity_classes(keyed, threshold, recall, "row_key", "text").filter("row_key is not null")
    odd = (classes.groupBy("row_key").agg(F.max(F.col("row_key") != F.col("class_id")).alias("gone"), (F.count("*") > 1).alias("again"))
           .filter("gone or again").select(F.struct("row_key", "gone", "again").alias("odd")))
    # the caller's columns may have any names, so they stay in a struct of their own
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("own_key"))
    joined = held.join(odd, F.col("own_key") == F.col("odd.row_key"), "left").filter(~F.coalesce("odd.gone", F.lit(False)))
    again = F.coalesce("odd.again", F.lit(False))
    once = joined.filter(again).dropDuplicates(["own_key"])
    return joined.filter(~again).unionByName(once).select("row.*")
