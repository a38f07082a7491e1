"""Alignment of two tokenizers' tokens by pointer jumping.

Both token sequences of a text spell the same bytes, so tokens are byte ranges.  Every token points to the
farthest-right token of the other side that overlaps it, if that ends later; of two that end together the second
side's is the terminal.  Squaring the pointers until they stand still leads every token to the terminal of
its group, the smallest run of bytes that both sides cut at both ends; a chain of n tokens takes log2(n) steps,
and all units of a lot jump at once.

A text is cut where no token of either side can cross: before white space, and before marks behind a word.  Groups
and links end there too, so each distinct unit is encoded and aligned once while it stays in a memory bounded in bytes,
and a text adds up its units.  Where the vocabularies do not allow a cut, a text is one unit.

How often two ids are linked in the whole corpus is counted over scopes: a scope is up to ``SCOPE_BYTES`` of
text of one task and numbers its distinct id pairs.  Only these pairs are dealt, never single links; a
document keeps the numbers of its pairs, and its scope's counts come back to it.
"""
from __future__ import annotations

import functools
import gc
import os
import re
from collections import defaultdict, deque
from collections.abc import Collection, Iterator
from hashlib import sha256
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tagloom.llm.stored import stored
from tagloom.llm.tokens import LONG_PIECE, ODD_SPACE, PIECES
from tagloom.llm.words import chunks

CHUNK_BYTES, SCOPE_BYTES, DICTIONARY_ROW = 1 << 21, 32 << 20, 1 << 15
LOT = 1000  # units encoded and aligned together
KNOWN_BYTES = 80 << 20
RECENT = 2  # batches whose units stay when the memory is full
ENTRY_BYTES = 260  # of a unit in memory beside its characters and links: a key, two values and their tuple, a place in the dictionary
_MARKS = bytes(c for c in range(0x21, 0x7f) if not chr(c).isalnum())
_TOKENS = "scope long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, slots binary, times binary, first_slot int, pairs array<long>, pair_links array<long>"


def byte_level(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, in which printable Latin-1 characters stand for themselves
    and the other bytes, in order, for the characters from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in own]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        table[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return table


def letter(end: bytes) -> bool:
    """Does this end with an ASCII letter or digit, or with any other letter?"""
    return end[-1:].isalnum() or end[-1:] >= b"\x80" and end[-4:].decode("utf-8", "ignore")[-1:].isalpha()


class Side:
    """One tokenizer: ids of units and the bytes of each id."""

    def __init__(self, table: list[bytes]) -> None:
        self.table = table
        self.length = np.array([len(t) for t in table], np.int64)

    def ids(self, text: bytes) -> np.ndarray:
        """Ids of a text, or of units in a row."""
        raise NotImplementedError

    def spelled(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


class ByteBpe(Side):
    """A byte-level vocabulary of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        super().__init__(byte_level(self.tokenizer.get_vocab(with_added_tokens=True)))

    def ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.int64)


class Pieces(Side):
    """A vocabulary of the sentencepiece library, which puts the space before each text itself.

    ``cuts``: do its merges, and nothing else, decide where tokens end, and does none cross a line feed or the place
    before a space?  ``joining``: other white space that some piece holds behind other characters.  ``marks``: those
    that no piece holds behind a letter or digit.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.cuts, self.joining, self.marks = False, set(), b""
        try:
            from sentencepiece import sentencepiece_model_pb2 as layout
        except ImportError:  # it needs protobuf; without it the rules are unknown
            return
        known = layout.ModelProto()
        known.ParseFromString(self.model.serialized_model_proto())
        kind, rules, training = layout.ModelProto.SentencePiece, known.normalizer_spec, known.trainer_spec
        said = [t for t, p in zip(self.table, known.pieces) if p.type == kind.NORMAL]
        self.cuts = (training.model_type == layout.TrainerSpec.BPE and training.byte_fallback and not training.treat_whitespace_as_suffix
                     and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
                     and all(p.type in (kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE) for p in known.pieces)
                     and not any(re.search(rb"\n|[^ ] ", t) for t in said))
        self.joining = {w for t in said for w in re.findall(rb"[^\t-\r ]([\t-\r])", t)}
        crossed = {t[i] for t in said for i in range(1, len(t)) if t[i] in _MARKS and letter(t[:i])}
        self.marks = bytes(m for m in _MARKS if m not in crossed)

    def ids(self, text: bytes) -> np.ndarray:
        if not self.cuts:
            return np.array(self.model.encode(text[1:].decode("utf-8", "replace")), np.int64)
        # a space of its own and a line feed go before it
        return np.array(self.model.encode((b"\n" + text).decode("utf-8", "replace"))[2:], np.int64)


@functools.lru_cache(maxsize=1)
def opened(path_a: str, path_b: str) -> tuple[ByteBpe, Pieces, np.ndarray]:
    """Both sides and the names of their tokens, which stay for a worker's next task."""
    first, second = ByteBpe(path_a), Pieces(path_b)
    return first, second, token_names(len(first.table), len(second.table))


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of both sides, given their ends over the same bytes: the second side's token that ends its group."""
    n = len(end_a)
    follow = np.empty(n + len(end_b), np.int64)
    follow[:n] = n + np.searchsorted(end_b, end_a)
    over = np.searchsorted(end_a, end_b)
    follow[n:] = np.where(end_a[over] > end_b, over, np.arange(n, len(follow)))
    while True:
        farther = follow[follow]
        if (farther == follow).all():
            return follow[:n] - n, follow[n:] - n
        follow = farther


def token_names(n_a: int, n_b: int) -> np.ndarray:
    """How a token is written: A's ids after a comma, A's after a semicolon (first of a group), B's after a comma, B's after a bar."""
    return np.array([mark + str(i).encode() for mark, n in ((b",", n_a), (b";", n_a), (b",", n_b), (b"|", n_b)) for i in range(n)], object)


def written(id_a: np.ndarray, group_a: np.ndarray, id_b: np.ndarray, group_b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """For tokens with ascending group numbers, the places in :func:`token_names` that spell ``a1,a2|b1;a3|b2,b3`` (after one mark)."""
    out = np.empty(len(id_a) + len(id_b), np.int64)
    out[np.arange(len(id_a)) + np.searchsorted(group_b, group_a, "left")] = id_a + n_a * (np.diff(group_a, prepend=-1) > 0)
    out[np.arange(len(id_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * n_a + id_b + n_b * (np.diff(group_b, prepend=-1) > 0)
    return out


class Scope:
    """Numbers for distinct pairs, in the order in which chunks bring them, and how many links each has."""

    def __init__(self) -> None:
        self.codes, self.numbers, self.links = (np.zeros(0, np.int64) for _ in range(3))

    def number(self, codes: np.ndarray, links: np.ndarray) -> np.ndarray:
        """The number of each of some distinct, sorted codes."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        out = np.empty(len(codes), np.int64)
        out[known] = self.numbers[at[known]]
        self.links[out[known]] += links[known]
        out[~known] = len(self.links) + np.arange((~known).sum())
        self.links = np.concatenate([self.links, links[~known]])
        self.codes, self.numbers = np.insert(self.codes, at[~known], codes[~known]), np.insert(self.numbers, at[~known], out[~known])
        return out

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First number, codes and links of runs of numbers."""
        codes = self.codes[np.argsort(self.numbers)]
        for low in range(0, len(codes), DICTIONARY_ROW):
            yield low, codes[low:low + DICTIONARY_ROW], self.links[low:low + DICTIONARY_ROW]


def narrow(values: np.ndarray) -> np.ndarray:
    """As the least unsigned type that holds all."""
    most = int(values.max(initial=0))
    return values.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def widened(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, f"<u{len(body) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def starts(many: np.ndarray) -> np.ndarray:
    """Where runs of these lengths begin, with the end of the last."""
    return np.concatenate([[0], np.cumsum(many)])


class Units:
    """Alignment of distinct units: ``n_a, n_b, n_groups``, the groups as written after a semicolon, and the codes of all
    links, as 64-bit bytes.  The groups are None where a side does not spell the unit."""

    def __init__(self, path_a: str, path_b: str) -> None:
        *self.sides, self.names = opened(path_a, path_b)
        self.known: dict[bytes, tuple] = {}
        self.known_bytes = 0
        self.recent: deque[set[bytes]] = deque(maxlen=RECENT)
        self.apart: set[bytes] = set()  # texts of which it is unknown where no token crosses

    def cut(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        text, second = b" " + text, self.sides[1]
        if not second.cuts or any(w in text for w in second.joining) or ODD_SPACE.search(text):
            self.apart.add(text)
            return [text]
        return PIECES.findall(text)

    def rows(self, units: Collection[bytes]) -> list[tuple]:
        """The alignment of each of some distinct units."""
        wanted = set(units)
        if self.known_bytes > KNOWN_BYTES:  # frequent units are in recent batches too
            self.known = {u: self.known[u] for u in wanted.union(*self.recent).intersection(self.known)}
            self.known_bytes = self._size(self.known)
        new = wanted.difference(self.known)
        self._learn(new)
        out = list(map(self.known.__getitem__, units))
        gone = {u for u in new if len(u) > LONG_PIECE or u in self.apart}  # these do not stay
        self.known_bytes -= self._size({u: self.known.pop(u) for u in gone})
        self.recent.append(wanted - gone)
        self.apart.clear()
        return out

    @staticmethod
    def _size(rows: dict[bytes, tuple]) -> int:
        """About: groups are about as long as links."""
        return ENTRY_BYTES * len(rows) + sum(map(len, rows)) + 2 * sum([len(r[4]) for r in rows.values()])

    def _add(self, rows: dict[bytes, tuple]) -> None:
        self.known.update(rows)
        self.known_bytes += self._size(rows)

    def _learn(self, new: set[bytes]) -> None:
        ends, need, marks = [], set(), self.sides[1].marks
        for unit in new - self.apart:
            word = unit.rstrip(marks)
            if len(word) < len(unit) <= LONG_PIECE and letter(word):
                ends.append((unit, word, unit[len(word):]))
            else:
                need.add(unit)
        need.update([word for _, word, _ in ends], [behind for _, _, behind in ends])
        need = need.difference(self.known)
        # no token crosses from the end of a word to the white space of the next
        row = [u for u in need if u[:1].isspace() and not u[-1:].isspace()]
        for lot, joined in (row, True), (list(need.difference(row) | new & self.apart), False):
            for at in range(0, len(lot), LOT):
                some = lot[at:at + LOT]
                self._add(dict(zip(some, self.aligned(some, joined))))
        get = self.known.__getitem__
        self._add({unit: (x[0] + y[0], x[1] + y[1], x[2] + y[2], None if x[3] is None or y[3] is None else x[3] + y[3], x[4] + y[4])
                   for unit, x, y in ((unit, get(word), get(behind)) for unit, word, behind in ends)})

    def aligned(self, units: list[bytes], joined: bool) -> list[tuple]:
        """The row of each of some units.  ``joined``: no token crosses from one to the next, so they are encoded in a row."""
        whole = b"".join(units)
        if joined:
            id_a, id_b = (side.ids(whole) for side in self.sides)
            if any(side.spelled(ids) != whole for side, ids in zip(self.sides, (id_a, id_b))):
                return self.aligned(units, False)
        else:
            found = [[side.ids(u) for u in units] for side in self.sides]
            same = [k for k, u in enumerate(units) if all(side.spelled(ids[k]) == u for side, ids in zip(self.sides, found))]
            rows: list[tuple] = [(0, 0, 0, None, b"")] * len(units)
            if not same:
                return rows
            id_a, id_b = (np.concatenate([ids[k] for k in same]) for ids in found)
            units = [units[k] for k in same]
        length_a, length_b = (side.length[ids] for side, ids in zip(self.sides, (id_a, id_b)))
        end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
        group_a, group_b = terminals(end_a, end_b)
        # every overlapping pair: from the token that holds the first byte to the one that holds the last
        low = np.searchsorted(end_b, end_a - length_a, "right")
        many = np.searchsorted(end_b, end_a) - low + 1
        links = starts(many)
        right = np.arange(links[-1]) - np.repeat(links[:-1] - low, many)
        codes = (np.repeat(id_a << 32, many) | id_b[right]).astype("<i8").tobytes()
        tokens = self.names[written(id_a, group_a, id_b, group_b, *(len(side.table) for side in self.sides))].tolist()
        ends = starts([len(u) for u in units])
        first_a, first_b = (np.searchsorted(end, ends, "right") for end in (end_a, end_b))
        n_groups = np.diff(starts(group_b == np.arange(len(group_b)))[first_b]).tolist()
        token_first, code_first = (first_a + first_b).tolist(), (8 * links[first_a]).tolist()
        out = [(x, y, g, b"".join(tokens[t:t_end]), codes[c:c_end]) for x, y, g, t, t_end, c, c_end in
               zip(np.diff(first_a).tolist(), np.diff(first_b).tolist(), n_groups, token_first, token_first[1:], code_first, code_first[1:])]
        if joined:
            return out
        for k, row in zip(same, out):
            rows[k] = row
        return rows


def text_rows(units: Units, texts: list[bytes], scope: Scope) -> Iterator[tuple]:
    """Per text ``n_a, n_b, n_groups, n_links, groups_sha256, n_pairs, slots, times``."""
    cut = [units.cut(t) for t in texts]
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    which = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    *counts, groups, codes = zip(*units.rows(number)) if number else ((),) * 5
    unspelled = np.array([g is None for g in groups], bool)
    none = np.bincount(doc[unspelled[which]], minlength=len(texts)) > 0
    which, doc = which[~none[doc]], doc[~none[doc]]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    n_a, n_b, n_groups = (np.diff(starts(np.array(c, np.int64)[which])[first]).tolist() for c in counts)
    # pairs of the distinct units, and of every unit of a text
    many = np.array([len(c) // 8 for c in codes], np.int64)
    distinct, of = np.unique(np.frombuffer(b"".join(codes), "<i8"), return_inverse=True)
    often = np.bincount(of, np.repeat(np.bincount(which, minlength=len(many)), many), len(distinct)).astype(np.int64)
    slot = np.zeros(len(distinct), np.int64)
    slot[often > 0] = scope.number(distinct[often > 0], often[often > 0])
    links = starts(many[which])
    at = np.arange(links[-1]) + np.repeat(starts(many)[which] - links[:-1], many[which])
    base = len(scope.links) + 1
    pairs, times = np.unique(np.repeat(doc * base, many[which]) + slot[of][at], return_counts=True)
    pair_first = np.searchsorted(pairs, np.arange(len(texts) + 1) * base).tolist()
    n_links = np.diff(links[first]).tolist()
    spelled = np.array([*groups, None], object)[which].tolist()
    first = first.tolist()
    for i in range(len(texts)):
        p = slice(pair_first[i], pair_first[i + 1])
        text = b"".join(spelled[first[i]:first[i + 1]])
        yield (n_a[i], n_b[i], n_groups[i], n_links[i], sha256(text[1:]).hexdigest() if text else "", p.stop - p.start,
               narrow(pairs[p] - i * base).tobytes(), narrow(times[p]).tobytes())


def token_rows(docs: DataFrame, path_a: str, path_b: str, scope_bytes: int = SCOPE_BYTES) -> DataFrame:
    """One row per document of ``docs`` (``id, text``), and rows with the pairs of each scope."""
    kind = docs.schema["id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(path_a, path_b)
        scope, read, number = Scope(), 0, TaskContext.get().partitionId() << 32
        schema: pa.Schema | None = None

        def dictionary() -> Iterator[pa.RecordBatch]:
            for low, codes, links in scope.rows():
                columns = {"scope": pa.array([number]), "first_slot": pa.array([low], pa.int32()),
                           "pairs": pa.array([codes], pa.list_(pa.int64())), "pair_links": pa.array([links], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("id", batch.schema.field("id").type), ("scope", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                                    ("groups_sha256", pa.string()), ("n_pairs", pa.int32()), ("slots", pa.binary()), ("times", pa.binary()),
                                    ("first_slot", pa.int32()), ("pairs", pa.list_(pa.int64())), ("pair_links", pa.list_(pa.int64()))])
            for part, data, offsets in chunks(batch, "text", CHUNK_BYTES):
                if read and read + len(data) > scope_bytes:
                    yield from dictionary()
                    scope, read, number = Scope(), 0, number + 1
                read += len(data)
                whole, at = data.tobytes(), offsets.tolist()
                gc.disable()  # many small objects, no cycles
                try:
                    rows = list(zip(*text_rows(units, [whole[a:b] for a, b in zip(at, at[1:])], scope)))
                finally:
                    gc.enable()
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.full(n, number)), *[pa.array(column, f.type) for column, f in zip(rows, list(schema)[2:10])],
                     *[pa.nulls(n, f.type) for f in list(schema)[10:]]], schema=schema)
        if schema is not None:
            yield from dictionary()

    return docs.mapInArrow(align, f"id {kind}, {_TOKENS}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``of, slot, links, best``: for each scope's pair, how many links it has in all, and whether no other pair of its
    second id has more.  A pair has one row per scope, so the commonest has one for ``SCOPE_BYTES`` of text."""
    each = (rows.filter("pairs is not null").select("scope", "first_slot", F.posexplode(F.arrays_zip("pairs", "pair_links")))
            .select("scope", (F.col("first_slot") + F.col("pos")).alias("slot"), F.col("col.pairs").alias("pair"), F.col("col.pair_links").alias("n")).repartition("pair"))
    counted = each.select("scope", "slot", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), F.sum("n").over(Window.partitionBy("pair")).alias("links"))
    most = counted.groupBy("b").agg(F.max("links").alias("most"))  # as many rows as the second vocabulary has ids
    return counted.join(F.broadcast(most), "b").select(F.col("scope").alias("of"), "slot", "links", (F.col("links") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", scope_bytes: int = SCOPE_BYTES) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    A is the byte-level vocabulary at ``path_a``, B the pieces at ``path_b``.  A link is a pair of an A and a B
    token whose bytes overlap; its count is the number of links with the same two ids in all of ``docs``.
    ``n_best`` counts links whose count no other A id has with their B id, ties included; ``count_sum`` adds the counts of all links.
    Null and empty texts, and those that a tokenizer does not spell byte for byte (such as texts with U+2581),
    have no tokens: zeros and an empty string.  Null and repeated ids and rows keep their rows and count as
    often as they stand there; other columns are not read.  One text must fit a task's memory.
    """
    kind = docs.schema[id_col].dataType
    rows = stored(token_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path_a, path_b, scope_bytes))
    counts = pair_counts(rows)
    own = rows.filter("pairs is null").select("id", "scope", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "slots", "times")
    result = f"id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def add_up(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        slot = pairs.column("slot").to_numpy()
        links, best = np.zeros(len(slot), np.int64), np.zeros(len(slot), bool)  # a scope's numbers have no gaps
        links[slot], best[slot] = pairs.column("links").to_numpy(), pairs.column("best").to_numpy()
        n_best, count_sum = [], []
        for n, slots, times in zip(*(texts.column(c).to_pylist() for c in ("n_pairs", "slots", "times"))):
            at, often = widened(slots, n), widened(times, n)
            n_best.append(int((often * best[at]).sum()))
            count_sum.append(int((often * links[at]).sum()))
        kept = [texts.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), texts.column("groups_sha256")],
                        ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return own.groupBy("scope").cogroup(counts.groupBy("of")).applyInArrow(add_up, result).withColumnRenamed("id", id_col)
