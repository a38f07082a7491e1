"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history).  The ``HEAD`` most frequent words stand in
small classes, and both factors are softmaxes over hashed features of the history: the bigram, the trigram and
the word two back (a skip).  All other words stand in classes by their last letters; there the first factor
is the softmax and the second the word's share of its class, with one unseen word in each class.

Training passes over all training texts: tasks take gradient steps (AdaGrad, small batches) from the common
weights, and Spark sums what they changed, weighted by how often each row was used.  Every array that is
sent to tasks has a fixed size.  Words themselves are counted and joined in Spark.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.stored import stored
from tagloom.llm.words import LOWER, NOT_SPACE, Words, mixed, word_chunks

HEAD, IN_CLASS, TAILS = 512, 32, 48
HEAD_CLASSES = HEAD // IN_CLASS
CLASSES, START = HEAD_CLASSES + TAILS, HEAD + TAILS
FREQUENT = 262_144  # words whose counts the tasks get; the rest are joined
ROWS, ROWS_IN, BLOCK_ROWS = 1 << 14, 1 << 14, 256
BATCH, RATE, LIMIT = 4096, 0.15, 20.0  # three rows and a bias stay far below the largest exponent
TOKENS_A_TASK = 4_000_000
END = np.uint64(0x5EED0FE17D0C0E4D)


class Tokens:
    """Words and one end for each text: ``hash``, tail class ``tail``, and ``first`` by text."""

    def __init__(self, words: Words) -> None:
        at = words.first[1:]
        last = [LOWER[words.data[np.maximum(words.end - k, words.start)]].astype(np.uint64) for k in (1, 2, 3)]
        tail = mixed(last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)) % np.uint64(TAILS)
        self.hash, self.tail = np.insert(words.hash, at, END), np.insert(tail.astype(np.int64), at, 0)
        self.first = words.first + np.arange(len(words.first))
        self.doc = np.repeat(np.arange(len(at)), np.diff(self.first))


def find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), max(0, len(sorted_hashes) - 1))
    return at, (sorted_hashes[at] == wanted if len(sorted_hashes) else np.zeros(len(wanted), bool))


class Shape:
    """What the model knows of words: the head's order and the fixed log shares that training starts from."""

    def __init__(self, head: np.ndarray, head_counts: np.ndarray, tail_mass: np.ndarray) -> None:
        order = np.argsort(head)
        self.sorted, self.rank = head[order], order
        mass = np.concatenate([[head_counts[k:k + IN_CLASS].sum() for k in range(0, HEAD, IN_CLASS)], tail_mass]).astype(np.float64)
        self.bias = np.log(np.maximum(mass, 1e-3) / mass.sum()).astype(np.float32)
        share = np.full((HEAD_CLASSES, IN_CLASS), -30.0, np.float32)  # places without a word
        share.ravel()[:len(head)] = np.log(head_counts / mass[np.arange(len(head)) // IN_CLASS])
        self.share, self.tail_mass = share, tail_mass

    def events(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, class and place in the class (-1 in the tail) of every token."""
        at, known = find(self.sorted, tokens.hash)
        rank = self.rank[at] if len(self.rank) else at
        symbol = np.where(known, rank, HEAD + tokens.tail)
        return symbol, np.where(known, rank // IN_CLASS, HEAD_CLASSES + tokens.tail), np.where(known, rank % IN_CLASS, -1)


def features(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row number for each of the three features of each token, before it is cut to a table's size."""
    n = len(symbol)
    back = np.full((2, n), START)
    back[0, 1:], back[1, 2:] = symbol[:-1], symbol[:-2]
    begin = first[:-1][np.diff(first) > 0]
    back[0, begin] = back[1, begin] = START
    second = begin + 1
    second = second[second < n]
    back[1, second] = START
    one, two = back.astype(np.uint64)
    return np.stack([mixed(one + np.uint64(1 << 40)), mixed(one | two << np.uint64(16) | np.uint64(2 << 40)), mixed(two + np.uint64(3 << 40))])


class Softmax:
    """Weights of one factor: ``rows`` hashed rows of ``width`` outputs."""

    def __init__(self, weights: np.ndarray, train: bool = False) -> None:
        self.w, self.mask = weights.copy() if train else weights, np.uint64(len(weights) - 1)
        if train:
            self.squares, self.used = np.full_like(weights, 1e-2), np.zeros(len(weights), np.float32)

    def scores(self, keys: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (keys & self.mask).astype(np.int64)
        z = self.w.take(at[0], 0)
        for row in at[1:]:
            z += self.w.take(row, 0)
        z += bias
        return at, z

    def log_probability(self, keys: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, z = self.scores(keys, bias)
        own = z[np.arange(len(target)), target].astype(np.float64)
        return own - np.log(np.exp(z, out=z).sum(1, dtype=np.float64))

    def step(self, keys: np.ndarray, bias: np.ndarray, target: np.ndarray) -> None:
        at, z = self.scores(keys, bias)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(target)), target] -= 1
        for row in at:
            order = np.argsort(row.astype(np.uint16), kind="stable")  # of 16 bits: a radix sort
            begin = np.flatnonzero(np.diff(row[order], prepend=-1))
            hit = row[order[begin]]
            gradient = np.add.reduceat(z.take(order, 0), begin)
            squares = self.squares.take(hit, 0) + gradient * gradient
            self.squares[hit] = squares
            gradient *= RATE
            gradient /= np.sqrt(squares, out=squares)
            self.w[hit] = np.clip(self.w.take(hit, 0) - gradient, -LIMIT, LIMIT)
            self.used[hit] += np.diff(begin, append=len(row))


def batches_of(tokens: Tokens, shape: Shape) -> Iterator[tuple]:
    """Keys, class, place and extent of consecutive batches of tokens."""
    symbol, group, place = shape.events(tokens)
    keys = features(symbol, tokens.first)
    for low in range(0, len(symbol), BATCH):
        yield low, keys[:, low:low + BATCH], group[low:low + BATCH], place[low:low + BATCH]


def inner_keys(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    return mixed(keys + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def train_round(docs: DataFrame, shape: Shape, weights: list[np.ndarray], tasks: int) -> list[np.ndarray]:
    """The common weights after every task has passed over its share of ``docs``."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((shape, weights))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, start = sent.value
        outer, inner = (Softmax(w, train=True) for w in start)
        for _, words in word_chunks(batches, "text", NOT_SPACE, LOWER):
            tokens = Tokens(words)
            for _, keys, group, place in batches_of(tokens, shape):
                outer.step(keys, shape.bias, group)
                head = np.flatnonzero(place >= 0)
                if len(head):
                    inner.step(inner_keys(keys[:, head], group[head]), shape.share[group[head]], place[head])
        for number, (model, w) in enumerate(zip((outer, inner), start)):
            for low in range(0, len(w), BLOCK_ROWS):
                used = model.used[low:low + BLOCK_ROWS]
                change = (model.w[low:low + BLOCK_ROWS] - w[low:low + BLOCK_ROWS]) * used[:, None]
                if used.any():
                    yield pa.RecordBatch.from_arrays([pa.array([number * 1_000_000 + low], pa.int32()), pa.array([used.tobytes()], pa.binary()),
                                                      pa.array([change.tobytes()], pa.binary())], ["block", "used", "change"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, used, change in zip(*(c.to_pylist() for c in batch.columns)):
                have = sums.setdefault(block, [np.zeros(len(used) // 4), np.zeros(len(change) // 4)])
                have[0] += np.frombuffer(used, np.float32)
                have[1] += np.frombuffer(change, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([s[i].tobytes() for s in sums.values()], pa.binary()) for i in (0, 1))],
                                         ["block", "used", "change"])

    kinds = "block int, used binary, change binary"
    changed = docs.select("text").coalesce(tasks).mapInArrow(learn, kinds).repartition("block").mapInArrow(total, kinds)
    after = [w.copy() for w in weights]
    for row in changed.toLocalIterator():  # the size of the model, whatever the input
        w, low = after[row.block // 1_000_000], row.block % 1_000_000
        used = np.frombuffer(row.used, np.float64)
        w[low:low + BLOCK_ROWS] += (np.frombuffer(row.change, np.float64).reshape(len(used), -1) / np.maximum(used, 1)[:, None]).astype(np.float32)
    sent.unpersist()
    return after


def vocabulary(training: DataFrame) -> DataFrame:
    """``h, tail, c``: every distinct token of the texts by its hash, with its tail class and count."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tails, held = [], [], 0
        for _, words in word_chunks(batches, "text", NOT_SPACE, LOWER):
            tokens = Tokens(words)
            hashes.append(tokens.hash)
            tails.append(tokens.tail.astype(np.int8))
            held += len(tokens.hash)
            if held >= 2_000_000:
                yield counted(hashes, tails)
                hashes, tails, held = [], [], 0
        if held:
            yield counted(hashes, tails)

    def counted(hashes: list, tails: list) -> pa.RecordBatch:
        found, at, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.concatenate(tails)[at].astype(np.int32)), pa.array(n)], ["h", "tail", "c"])

    rows = training.select("text").mapInArrow(count, "h long, tail int, c long")
    return rows.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def score_texts(docs: DataFrame, shape: Shape, weights: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per text: tokens, known ones among the frequent, the sum of their ln(c + 1), the model's part that needs
    no other count, and the hashes of all other tokens."""
    sent = docs.sparkSession.sparkContext.broadcast((shape, weights, frequent))
    kind = docs.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, weights, (hashes, logs) = sent.value
        outer, inner = (Softmax(w) for w in weights)
        tail_log = np.log(shape.tail_mass)
        for part, words in word_chunks(batches, "text", NOT_SPACE, LOWER):
            tokens = Tokens(words)
            n = len(tokens.hash)
            model = np.zeros(n)
            tail = np.empty(n, bool)
            for low, keys, group, place in batches_of(tokens, shape):
                out = outer.log_probability(keys, shape.bias, group)
                head = place >= 0
                on = np.flatnonzero(head)
                if len(on):
                    out[on] += inner.log_probability(inner_keys(keys[:, on], group[on]), shape.share[group[on]], place[on])
                out[~head] -= tail_log[group[~head] - HEAD_CLASSES]
                model[low:low + len(out)], tail[low:low + len(out)] = out, ~head
            at, known = find(hashes, tokens.hash)
            count = np.where(known, logs[at] if len(logs) else 0.0, 0.0)
            model += np.where(tail, count, 0.0)
            by_doc = lambda x: np.bincount(tokens.doc, x, part.num_rows)
            rest = np.flatnonzero(~known)
            edges = np.searchsorted(tokens.doc[rest], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("held_out"), pa.array(np.diff(tokens.first)), pa.array(by_doc(known).astype(np.int64)), pa.array(by_doc(count)),
                pa.array(by_doc(model)), pa.ListArray.from_arrays(pa.array(edges), pa.array(tokens.hash[rest].view(np.int64)))],
                ["id", "held_out", "n_tokens", "known", "counts", "model", "rest"])

    return docs.select("id", "held_out", "text").mapInArrow(
        score, f"id {kind}, held_out boolean, n_tokens long, known long, counts double, model double, rest array<long>")


def held_out(id_col: Column) -> Column:
    """One seventh of the documents by the CRC of their id; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Tokens are lower-cased (A-Z) runs of anything but ASCII white space and one end per text; a null text has
    the end alone.  Words are told apart by 64-bit hashes.  Training sees each training text once, in
    ``rounds`` parts; without any training text all words are unknown and the model is uniform over its classes.
    Repeated rows each get a row.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    training = texts.filter(~F.col("held_out"))
    words = stored(vocabulary(training))
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    end = int(END.astype(np.int64))
    # the most frequent words, FREQUENT at most, by a floor under their counts: no task sends more than its share of them
    size = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    floor, sent = 1 << 30, 1
    for row in words.groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect():  # 4096 rows at most
        sent += row.words
        if sent > FREQUENT:
            break
        floor = row["size"]
    top = words.filter((size >= floor) | (F.col("h") == end)).toPandas()
    top = top.assign(other=top["h"] != end).sort_values(["other", "c", "h"], ascending=[True, False, True])
    hashes, counts = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(hashes)
    frequent = (hashes[order], np.log(counts[order] + 1.0))
    head, head_counts, head_tails = hashes[:HEAD], counts[:HEAD], top["tail"].to_numpy(np.int64)[:HEAD]
    # each tail class: its words' counts plus one, without the head's, and one for any unseen word
    mass = np.ones(TAILS)
    for row in words.groupBy("tail").agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[row.tail] += row.m
    np.subtract.at(mass, head_tails, head_counts + 1.0)
    shape = Shape(head, np.maximum(head_counts, 1), mass)
    weights = [np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS_IN, IN_CLASS), np.float32)]
    for part in range(rounds):
        share = training.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == part)
        weights = train_round(share, shape, weights, max(1, round(n / rounds / TOKENS_A_TASK)))
    scored = stored(score_texts(texts, shape, weights, frequent).withColumn("row", F.monotonically_increasing_id()))
    rare = (scored.select("row", F.explode("rest").alias("h")).join(words.select("h", "c"), "h")
            .groupBy("row").agg(F.count("*").alias("known_rare"), F.sum(F.log(F.col("c") + 1)).alias("counts_rare")))
    both = scored.drop("rest").join(rare, "row", "left").withColumns({"known_rare": F.coalesce("known_rare", F.lit(0)), "counts_rare": F.coalesce("counts_rare", F.lit(0.0))})
    ten = float(np.log(10))
    return both.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.col("known_rare")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        ((F.col("counts") + F.col("counts_rare")) / ten - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        ((F.col("model") + F.col("counts_rare")) / ten).alias("score"))
