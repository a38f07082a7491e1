"""Exact token ids and counts of whole texts, encoding frequent pieces once per task.

A text is cut at ASCII white space, where neither vocabulary lets a token cross; pieces seen before are
looked up, the rest are encoded by the tokenizers library in one batch.  Texts with other white space or
control separators are encoded whole, so no assumption is made about them.  The memory of pieces is bounded in
bytes and ends with the task: Python workers live on, and what they kept would lie beside the next stage's.
"""
from __future__ import annotations

import gc
import os
import re
from collections import deque
from collections.abc import Collection, Iterable

import numpy as np

PIECES = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: Bytes of characters that some definition of white space contains, beside ASCII's six.
ODD_SPACE = re.compile(rb"[\x1c-\x1f\xc2\xe1-\xe3\xef](?:(?<=[\x1c-\x1f])|(?<=\xc2)[\x85\xa0]|(?<=\xe1)(?:\x9a\x80|\xa0\x8e)"
                        rb"|(?<=\xe2)(?:\x80[\x80-\xaf]|\x81[\x9f-\xa4])|(?<=\xe3)\x80\x80|(?<=\xef)\xbb\xbf)")
TEXTS = 1024  # encoded together: the more, the fewer looks at the pieces known
_STOPS = b".,;:!?"
_MARKS = bytes(c for c in range(0x21, 0x7f) if not chr(c).isalnum())
KNOWN_BYTES, LONG_PIECE = 80 << 20, 4096
ENTRY_BYTES = 170  # of an entry beside its key's and its value's characters: two objects and a place in the dictionary
RECENT = 4  # batches whose pieces stay when the memory is full
#: A stop between an ASCII letter and white space; blanks before it change no id where white space is dropped.
_STOP_APART = re.compile(rb"[.,;:!?](?<=[a-z].)(?=[\t-\r ]|\Z)")
_open: dict[tuple, Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes (``counts=False``) or their number, with a bounded memory of pieces."""

    def __init__(self, path: str, counts: bool, keep_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.counts, self.keep_space = Tokenizer.from_file(path), counts, keep_space
        self.normalizer = self.tokenizer.normalizer
        self.lowers = self.normalizer is not None and self.normalizer.normalize_str("A") == "a"
        self.between_id, self.between = max((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items())
        self.closing = self._closing()
        # where words are closed by tokens of their own, no mark at a piece's end merges with its letters
        self.stops = _STOPS if self.closing is None else _MARKS
        self.known: dict[bytes, bytes | int] = {}  # pieces, words without stops, and stops
        self.known_bytes = 0
        self.recent: deque[set[bytes]] = deque(maxlen=RECENT)

    def forget(self) -> None:
        self.known, self.known_bytes = {}, 0
        self.recent.clear()

    def _closing(self) -> np.ndarray | None:
        """For each id, is it a token that closes a word?  None where the vocabulary marks no ends of words."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix or self.keep_space:
            return None
        vocabulary = self.tokenizer.get_vocab()
        closing = np.zeros(max(vocabulary.values()) + 1, bool)
        closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return closing

    def _size(self, keys: Collection[bytes], values: Iterable[bytes | int]) -> int:
        return ENTRY_BYTES * len(keys) + sum(map(len, keys)) + (0 if self.counts else sum(map(len, values)))

    def _add(self, keys: list[bytes], values: list) -> None:
        self.known.update(zip(keys, values))
        self.known_bytes += self._size(keys, values)

    def _cut(self, ids: np.ndarray, low: list[int], high: list[int]) -> list:
        if self.counts:
            return [b - a for a, b in zip(low, high)]
        body = ids.tobytes()
        return [body[4 * a:4 * b] for a, b in zip(low, high)]

    def _encoded(self, texts: list[bytes]) -> list:
        """Each text by itself: a special token, which never merges with its neighbours, stands between them."""
        out = []
        for at in range(0, len(texts), 2000):
            joined = self.between.join(t.decode("utf-8", "replace") for t in texts[at:at + 2000])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.between_id)
            out += self._cut(ids, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])
        return out

    def _words(self, texts: list[bytes]) -> list:
        """As :meth:`_encoded` for words of letters alone, which need but a blank between them: each gives one closing
        token at least, so with as many as words every word ends at its own."""
        out = []
        for at in range(0, len(texts), 2000):
            some = texts[at:at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.closing[ids]) + 1).tolist()
            out += self._cut(ids, [0, *cuts], cuts) if len(cuts) == len(some) else self._encoded(some)
        return out

    def _whole(self, text: bytes):
        ids = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids
        return len(ids) if self.counts else np.array(ids, "<u4").tobytes()

    def _letter(self, word: bytes) -> bool:
        """Does the word end with a letter, also once it is normalised?  Some letters become one with a mark behind it."""
        last = word[-4:].decode("utf-8", "ignore")[-1:]
        return last.isalpha() and (self.normalizer is None or self.normalizer.normalize_str(last)[-1:].isalpha())

    def _learn(self, new: list[bytes]) -> None:
        """Encodes pieces.  Stops at a piece's end are tokens of their own in both vocabularies, so a word is
        encoded once with whatever stops, and, where the tokenizer lowers letters, in whatever case."""
        ends, apart, need = [], [], set()
        for piece in new:
            if b"<|" in piece:  # a piece with marks of special tokens goes alone
                apart.append(piece)
                continue
            word = piece.rstrip(self.stops)
            if len(word) < len(piece) and (word[-1:].isalnum() or word[-1:] >= b"\x80" and self._letter(word)):
                word, stops = word.lower() if self.lowers else word, piece[len(word):]
                ends.append((piece, word, stops))
                need.add(word)
                need.add(stops)
            else:
                need.add(piece)
        need.difference_update(self.known)
        words = [] if self.closing is None else [w for w in need if w.isalpha() or w.decode("utf-8", "replace").isalpha()]
        others = list(need.difference(words))
        self._add(words, self._words(words))
        self._add(others, self._encoded(others))
        get = self.known.__getitem__
        self._add([piece for piece, _, _ in ends], [get(word) + get(stops) for _, word, stops in ends])
        self._add(apart, [self._whole(piece) for piece in apart])

    def _pieces(self, text: bytes) -> list[bytes]:
        if self.keep_space:
            return PIECES.findall(text)
        if self.lowers and b"<|" not in text:
            text = _STOP_APART.sub(rb" \g<0>", text.lower())
        return text.split()

    def texts(self, texts: list[bytes]) -> list:
        """Ids or counts of each text."""
        gc.disable()  # many small objects, no cycles
        try:
            whole = {t for t in texts if ODD_SPACE.search(t)}
            cut = [[t] if t in whole else self._pieces(t) for t in texts]
            pieces = set().union(*cut)
            whole.update(p for p in pieces if len(p) > LONG_PIECE)
            self.recent.append(pieces.difference(whole))
            if self.known_bytes > KNOWN_BYTES:  # frequent pieces are in recent batches too
                self.known = {p: self.known[p] for p in set().union(*self.recent).intersection(self.known)}
                self.known_bytes = self._size(self.known, self.known.values())
            new = pieces.difference(self.known)
            self._learn(list(new.difference(whole)))
            self.known.update((p, self._whole(p)) for p in whole)
            get = self.known.__getitem__
            out = [sum(map(get, c)) for c in cut] if self.counts else [b"".join(map(get, c)) for c in cut]
            for p in whole:  # whole texts do not stay
                del self.known[p]
            return out
        finally:
            gc.enable()


def encoder(path: str, counts: bool, keep_space: bool) -> Encoder:
    """The worker's encoder.  Its tables stay for the next task; the pieces it learns go by :meth:`Encoder.forget`,
    which every user calls in the end."""
    key = (path, counts, keep_space)
    if key not in _open:
        _open.clear()
        _open[key] = Encoder(path, counts, keep_space)
    return _open[key]
