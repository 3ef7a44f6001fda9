"""Token ids of whole texts by the tokenizers library, fast enough for large corpora.

A byte-level BPE tokenizer with the usual word pattern never joins what stands before and after a white-space character
between two other characters.  So the bytes of many texts are cut there into pieces at once, equal pieces of a step become
one by Arrow's dictionary encoding, a distinct piece is cut into its words by the pattern, and each distinct word is encoded once
by the tokenizer's model; ids are gathered from a table of pieces.  The ids are those of the whole text (tests compare them).  A
tokenizer of another kind encodes whole texts.

Strings of special tokens in a text are ordinary text, as the notes beside the tokenizer files set it (``encode_special_tokens``).
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex

from .common import remembered, steps, utf8

#: Pieces and words that a worker remembers; beyond that those that only one step had are forgotten, which changes no id.
REMEMBERED = 600_000
#: Text bytes that are cut and looked up at once; a single longer text is one step.
STEP = 4 << 20
#: The word pattern of byte-level BPE tokenizers, and the same for texts without the characters of _ODD, which is faster.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = re.compile("[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\x00-\u024f]")

_encoders: dict[str, "Encoder"] = {}
remembered.append(_encoders)


def encoder(path: str) -> "Encoder":
    """The process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _byte_alphabet() -> dict[int, str]:
    """Byte to character as byte-level BPE writes it: printable Latin-1 as it is, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b if b in shown else 0x100 + others.index(b)) for b in range(256)}


class Table:
    """Strings with their ids: places in one pool."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.first, self.count, self.pool, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def trim(self) -> None:
        """Where there are too many, forgets the strings that were looked up once, or all if that leaves most."""
        if len(self.place) <= REMEMBERED:
            return
        often = np.flatnonzero(self.hits[: len(self.place)] > 1)
        if len(often) > REMEMBERED // 2:
            often = often[:0]
        strings, (total, ids) = list(self.place), self.ids(often)
        self.__init__()
        if len(often):
            self.add([strings[i] for i in often], np.diff(total), ids)

    def add(self, strings: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.place)
        if n + len(strings) > len(self.hits):
            self.hits = np.concatenate([self.hits, np.zeros(n + len(strings), np.int32)])
        self.place.update(zip(strings, range(n, n + len(strings)), strict=True))
        self.count = np.concatenate([self.count, counts])
        self.first = np.cumsum(self.count) - self.count
        self.pool = np.concatenate([self.pool, ids])

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the strings at these places."""
        if not len(at):
            return np.zeros(1, np.int64), np.zeros(0, np.int32)
        n = self.count[at]
        total = np.concatenate([[0], np.cumsum(n)])
        return total, self.pool[np.repeat(self.first[at] - total[:-1], n) + np.arange(total[-1])]


def _places(strings: list[str], table: Table, learn) -> np.ndarray:
    """Places of distinct strings in a table that learns those it lacks."""
    at = list(map(table.place.get, strings))
    if None in at:
        lacking = [i for i, x in enumerate(at) if x is None]
        first = len(table.place)
        learn([strings[i] for i in lacking])
        for k, i in enumerate(lacking, first):
            at[i] = k
    found = np.array(at, np.int64)
    table.hits[found] += 1
    return found


#: ASCII white space of Python's and of Unicode's kind.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def _maybe_space(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a character of these first two bytes may be white space beyond ASCII."""
    return ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of data (rows at offsets) where pieces begin: rows, and blanks or line ends between two characters that are no white space."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~(_BLANK[data[at - 1]] | _BLANK[data[at + 1]])]
    wide = np.flatnonzero((data[at - 1] >= 0x80) | (data[at + 1] >= 0xC2))
    if len(wide):
        w = at[wide]
        low = lambda k: data[np.maximum(w - k, 0)]
        odd = _maybe_space(data[w + 1], data[np.minimum(w + 2, len(data) - 1)]) | _maybe_space(low(2), low(1)) | _maybe_space(low(3), low(2))
        at = np.delete(at, wide[odd])
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = begins[offsets[:-1]] = True  # an empty row begins where the next one does
    return np.flatnonzero(begins[:-1])


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path) as f:
            kind = json.load(f)
        before = kind["pre_tokenizer"] or {}
        self.by_words = kind["normalizer"] is None and kind["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        del kind
        if self.by_words:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.bytes_of[i] = len(token)  # a character for each byte
            self.alphabet = {b: c for b, c in _byte_alphabet().items()}
            self.model = Tokenizer(self.tokenizer.model)  # words come parted by spaces, in the byte alphabet
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces, self.words = Table(), Table()

    def _encode_words(self, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            shown = "\0".join(part).encode().decode("latin-1")
            inside = [x.translate(self.alphabet) for x in shown.split("\0")] if not any("\0" in x for x in part) else [x.encode().decode("latin-1").translate(self.alphabet) for x in part]
            ids = np.array(self.model.encode_batch_fast([" ".join(inside)], add_special_tokens=False)[0].ids, np.int32)
            ends, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum([len(x) for x in inside])
            self.words.add(part, np.diff(np.searchsorted(ends, wanted) + 1, prepend=0), ids)

    def _learn(self, pieces: list[str]) -> None:
        if not self.by_words:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            self.pieces.add(pieces, np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int32))
            return
        self.words.trim()
        words, sizes = [], []
        for p in pieces:  # a blank and letters is a word, and so is a stop or comma after it
            if p[0] == " " and p[1:].isalpha():
                words.append(p)
                sizes.append(1)
            elif p[0] == " " and p[-1] in ".," and p[1:-1].isalpha():
                words += p[:-1], p[-1]
                sizes.append(2)
            else:
                found = (_WORDS if _ODD.search(p) else _PLAIN_WORDS).findall(p)
                words += found
                sizes.append(len(found))
        distinct = pa.array(words, pa.large_string()).dictionary_encode()
        places = _places(distinct.dictionary.to_pylist(), self.words, self._encode_words)
        total, ids = self.words.ids(places[distinct.indices.to_numpy()])
        self.pieces.add(pieces, np.diff(total[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]), ids)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of the texts (UTF-8 bytes, rows at offsets) after each other, each followed by end if given."""
        starts = cuts(data, offsets) if self.by_words else offsets[:-1][np.diff(offsets) > 0]
        first = np.searchsorted(starts, offsets)  # the first piece of each row
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        distinct = pieces.dictionary_encode()
        self.pieces.trim()
        places = _places(distinct.dictionary.to_pylist(), self.pieces, self._learn)
        total, ids = self.pieces.ids(places[distinct.indices.to_numpy()] if len(starts) else places)
        ends = total[first]
        if end is not None:
            ids = np.insert(ids, ends[1:], end)
            ends = ends + np.arange(len(ends))
        return ends, ids

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = utf8(pa.array(texts, pa.large_string()))
        return self.encode_rows(data, offsets, end)


def encoded_steps(batch, path: str, end: int, size: int = STEP):
    """(first row, end row, offsets, ids) of steps of the texts of an Arrow batch; nulls are empty."""
    offsets, data = utf8(batch.column("text"))
    for i, j in steps(offsets, size):
        yield i, j, *encoder(path).encode_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)


def encoded(batch, path: str, end: int, size: int = STEP):
    """(row, ids) of each text of an Arrow batch; nulls are empty."""
    for i, j, ends, ids in encoded_steps(batch, path, end, size):
        for k in range(j - i):
            yield i + k, ids[ends[k] : ends[k + 1]]
