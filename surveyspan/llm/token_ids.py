"""Token ids of whole texts with the tokenizers library, each distinct piece of text encoded once.

The byte-level pre-tokenizer never joins text across the start of a blank-led word, nor an ASCII letter with the ASCII
punctuation after it. A group of texts is cut at those places with a few numpy operations on its bytes, Arrow numbers the
distinct pieces, the tokenizer sees each of them once, and the ids are gathered back by number. A worker keeps the ids of the
pieces met first, up to a fixed number; what does not fit is encoded once in each group that holds it. A tokenizer
of another kind gets its texts whole.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Pieces whose ids a worker remembers, and the longest piece (in bytes) it remembers.
CACHE = 400_000
LONGEST = 40
#: Characters that are worked on in one go.
SECTION = 1 << 20
# A blank belongs to the word after it; of other white space before a word the last character stands alone.
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s")
_CUT = re.compile(r"\S(?= \S)")
# White space to Python but not to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
# White space beyond ASCII.
_RARE = re.compile(r"[^\S\x00-\x7f]")
_SPACE, _LETTER, _MARK = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t\n\v\f\r")] = _SPACE
_CLASS[list(range(ord("A"), ord("Z") + 1)) + list(range(ord("a"), ord("z") + 1))] = _LETTER
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = _MARK


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _starts(texts: list[str], data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in the bytes of all texts where a piece begins."""
    kind = _CLASS[data]
    space = kind == _SPACE
    start = np.zeros(len(data), bool)
    before = space[:-1]
    # a word after white space other than a blank, and the first of a run of white space
    start[1:] = (space[1:] != before) & (space[1:] | (data[:-1] != 32))
    # the last of a run that a word follows
    last = np.zeros(len(data), bool)
    last[:-1] = space[:-1] & ~space[1:]
    last[end[end > begin] - 1] = False
    start[1:] |= last[1:] & before
    start[1:] |= (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
    for i, text in enumerate(texts):
        if not text.isascii() and _RARE.search(text):
            a, b = begin[i], end[i]
            start[a:b] = False
            if not _ODD.search(text):
                sizes = np.array([len(p.encode()) for p in _PIECES.findall(text)])
                start[a + np.cumsum(sizes) - sizes] = True
    start[begin[end > begin]] = True
    return np.flatnonzero(start)


class Encoder:
    """Texts to little-endian ids. The tokenizer and the cache live as long as the worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        first = parts["pre_tokenizer"] or {}
        self.cuttable = (
            parts["normalizer"] is None
            and (first.get("type"), first.get("use_regex", True), first.get("add_prefix_space")) == ("ByteLevel", True, False)
        )
        # byte-level vocabularies spell each byte as one character
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces; words led by a blank are encoded in one string and cut apart by byte counts."""
        led, bare, done = [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "], {}
        text = b"".join(led).decode()
        words = text.split()
        # a blank before each word and no other white space
        if len(words) != len(led) or sum(map(len, words)) + len(led) != len(text):
            odd = {p for p in led if p[1:].decode().split() != [p[1:].decode()]}
            bare += odd
            led = [p for p in led if p not in odd]
            text = b"".join(led).decode()
        if led:
            flat = self._ids(text)
            ends = np.cumsum(self.bytes_of[flat])
            want = np.cumsum([len(p) for p in led])
            cuts = np.searchsorted(ends, want) + 1
            if cuts[-1] == len(flat) and np.array_equal(ends[cuts - 1], want):
                raw, width = flat.tobytes(), self.kind.itemsize
                stops = (cuts * width).tolist()
                done = {p: raw[a:b] for p, a, b in zip(led, [0, *stops[:-1]], stops, strict=True)}
            else:
                bare += led
        found = self.tokenizer.encode_batch_fast([p.decode() for p in bare], add_special_tokens=False) if bare else []
        done.update((p, np.array(e.ids, self.kind).tobytes()) for p, e in zip(bare, found, strict=True))
        return done

    def _known(self, pieces: list[bytes], remember: int) -> list[bytes]:
        """Ids of distinct pieces in turn."""
        found = list(map(self.cache.get, pieces))
        lacking = [i for i, f in enumerate(found) if f is None]
        if lacking:
            own = self._pieces([pieces[i] for i in lacking])
            for i in lacking:
                found[i] = own[pieces[i]]
            room = remember - len(self.cache)
            if room > 0:
                self.cache.update((pieces[i], found[i]) for i in lacking[:room] if len(pieces[i]) <= LONGEST)
        return found

    def encode(self, texts: list[str], remember: int = 0) -> list[np.ndarray]:
        """Ids of each text; the texts together should be a few megabytes at most."""
        if not self.cuttable:
            return [self._ids(t) for t in texts]
        raw = [t.encode() for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        end = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return [np.zeros(0, self.kind) for _ in texts]
        starts = _starts(texts, data, end - sizes, end)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        numbered = pieces.dictionary_encode()
        found = self._known(numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), remember or CACHE)
        spelled = pa.array(found, pa.binary()).take(numbered.indices)
        _, places, values = spelled.buffers()
        ids = np.frombuffer(values, self.kind)
        stops = (np.frombuffer(places, np.int32)[np.append(0, np.searchsorted(starts, end))] // self.kind.itemsize).tolist()
        return [ids[a:b] for a, b in zip(stops, stops[1:], strict=False)]


def sections(text: str) -> list[str]:
    """A long text cut where a word begins, which no token crosses."""
    out, at = [], 0
    while len(text) - at > SECTION:
        cut = _CUT.search(text, at + SECTION)
        if cut is None:
            break
        out.append(text[at : cut.start() + 1])
        at = cut.start() + 1
    return [*out, text[at:]]


def encoded(texts: Iterable[str], path: str, roomy: int = 1) -> Iterator[np.ndarray]:
    """Ids of each text in turn, worked on in groups of about ``SECTION`` characters; both limits may be ``roomy`` times as large."""
    worker, group, size = encoder(path), [], 0
    for text in texts:
        if len(text) > SECTION and worker.cuttable:
            yield from worker.encode(group, roomy * CACHE)
            group, size = [], 0
            yield np.concatenate([worker.encode([part], roomy * CACHE)[0] for part in sections(text)])
            continue
        group.append(text)
        size += len(text)
        if size > roomy * SECTION:
            yield from worker.encode(group, roomy * CACHE)
            group, size = [], 0
    yield from worker.encode(group, roomy * CACHE)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file, shared by all functions of the worker."""
    return sys.modules[__name__]._encoder(path)
