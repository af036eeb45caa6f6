"""Token ids of public tokenizers, one distinct pre-token at a time.

A byte-pair encoder works inside each pre-token, so the ids of a text are the ids
of its pre-tokens joined.  A batch of texts is cut into pre-tokens with array
operations on its UTF-8 bytes; every distinct pre-token is encoded once by the
tokenizers library and kept in a cache of bounded size, which those met again do not leave.  Texts with characters or
sequences for which these cuts are not exact go through the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens kept by a worker in each of two generations; when the recent one is full, the older one goes.
CACHE_WORDS = 160_000
#: Bytes of text cut up at once.
CHUNK_BYTES = 4 << 20

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: Classes of U+0080-U+00BF (all others there are OTHER), second byte after 0xC2.
C2_CLASS = {0x85: SPACE, 0xA0: SPACE, 0xAA: LETTER, 0xB5: LETTER, 0xBA: LETTER, 0xB2: DIGIT, 0xB3: DIGIT, 0xB9: DIGIT, 0xBC: DIGIT, 0xBD: DIGIT, 0xBE: DIGIT}
CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for b in range(256):
        c = chr(b)
        if c in "\t\n\x0b\x0c\r ":
            kinds[b] = SPACE
        elif b < 128 and c.isalpha():
            kinds[b] = LETTER
        elif b < 128 and c.isdigit():
            kinds[b] = DIGIT
        elif 0xC3 <= b <= 0xC9:  # U+00C0-U+024F: letters but for two signs
            kinds[b] = LETTER
    return kinds


KINDS = _classes()
C2_KINDS = np.full(256, OTHER, np.uint8)
for _b, _k in C2_CLASS.items():
    C2_KINDS[_b] = _k


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.alphabet = _byte_alphabet()
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cache_words = cache_words

    # -- whole texts through the library ------------------------------------------------
    def library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    # -- pre-tokens ---------------------------------------------------------------------
    def _word(self, word: bytes) -> bytes:
        if self.lower and not word.replace(b"\xc2\x85", b"").replace(b"\xc2\xa0", b"").strip(b"\t\n\x0b\x0c\r "):
            return b""
        text = word.decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Byte offsets where pre-tokens begin; ``starts``: where texts begin."""
        kind = KINDS[data]
        two = np.flatnonzero(data == 0xC2)
        kind[two] = C2_KINDS[data[two + 1]]
        sign = np.flatnonzero(data == 0xC3)
        sign = sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]
        kind[sign] = OTHER
        tail = (data & 0xC0) == 0x80
        at = np.flatnonzero(tail)
        kind[at] = kind[at - 1]  # only two-byte characters are left here
        new = np.empty(len(data), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        if self.lower:
            new |= (kind == DIGIT) & ~tail
            new[starts] = True
            return np.flatnonzero(new)
        new[starts] = True
        # runs of white space: all but the last character go together, and a last
        # character that is a blank belongs to what follows it
        space = kind == SPACE
        ends = np.flatnonzero(new[1:] & space[:-1] & ~space[1:]) + 1
        is_start = np.zeros(len(data) + 1, bool)
        is_start[starts] = True
        ends = ends[~is_start[ends]]
        new[ends - 1] = True
        new[ends[data[ends - 1] == 0x20]] = False
        return np.flatnonzero(new)

    def _chunk(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin at ``starts`` in ``data`` (none is empty), and how many each has."""
        cuts = self._cuts(data, starts)
        offsets = np.append(cuts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.cache) > self.cache_words:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        ids = []
        for w in distinct:
            found = cache.get(w)
            if found is None:
                found = older.get(w)
                cache[w] = found = self._word(w) if found is None else found
            ids.append(found)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        per_word = size[index]
        after = np.cumsum(per_word)
        total = int(after[-1])
        where = np.repeat(begin[index] - (after - per_word), per_word) + np.arange(total)
        first = np.searchsorted(cuts, starts)
        counts = np.add.reduceat(per_word, first)
        return flat[where], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order (uint32), and the number of ids of each (int64).

        Null counts as empty; texts are never cut."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        counts = np.zeros(n, np.int64)
        if self.lower:
            lowered = pc.utf8_lower(texts)
        else:
            lowered = texts
        offsets = np.frombuffer(lowered.buffers()[1], np.int64, n + 1, lowered.offset * 8)
        buffer = lowered.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]  # a slice shares the buffer of the whole
        size = np.diff(offsets)
        odd = self._odd(texts, data, offsets)
        parts: list[np.ndarray] = []
        i = 0
        while i < n:
            if odd[i]:
                ids = self.library([texts[i].as_py()])[0]
                counts[i] = len(ids)
                parts.append(ids)
                i += 1
                continue
            j = i
            while j < n and not odd[j] and (j == i or offsets[j + 1] - offsets[i] <= CHUNK_BYTES):
                j += 1
            rows = np.flatnonzero(size[i:j]) + i
            if len(rows):
                ids, got = self._chunk(data[offsets[i] : offsets[j]], offsets[rows] - offsets[i])
                counts[rows] = got
                parts.append(ids)
            i = j
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts

    def _odd(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that must go through the library whole."""
        n = len(texts)
        odd = np.zeros(n, bool)
        at = [np.flatnonzero(data >= 0xCA)]
        p = np.flatnonzero(data == 0xC9)
        at.append(p[data[p + 1] >= 0x90])
        if not self.lower:
            p = np.flatnonzero(data == 0xC2)
            at.append(p[(data[p + 1] == 0x85) | (data[p + 1] == 0xA0)])
        where = np.concatenate(at)
        if len(where):
            odd[np.unique(np.searchsorted(offsets, where, "right") - 1)] = True
        quote = pc.match_substring(texts, "'").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(quote):
            odd[i] |= bool(CONTRACTION.search(texts[int(i)].as_py().lower()))
        for content in self.added:
            odd |= pc.match_substring(texts, content, ignore_case=self.lower).to_numpy(zero_copy_only=False)
        if self.lower:
            odd |= pc.match_substring(texts, "İ").to_numpy(zero_copy_only=False)
        return odd


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
