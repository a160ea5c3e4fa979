"""Vectorised words and word-shingle hashes of an Arrow text column.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; hashes are 64 bits wide. A batch is worked on in
runs of whole documents of about ``CHUNK`` bytes, so memory follows the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
SHINGLE = 5

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_punctuation = np.zeros(256, bool)
_punctuation[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: White space and ASCII punctuation.
SYMBOLS = _space | _punctuation
#: Of the bytes that can end a character, those of ASCII letters and digits.
_alnum = np.zeros(256, bool)
_alnum[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_byte = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 2 * CHUNK:
            _powers[str(base)] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``len + 1`` offsets of a text column; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, ends


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) for runs of whole documents."""
    data, ends = text_buffer(texts)
    row = 0
    while row < len(ends) - 1:
        last = int(np.searchsorted(ends, ends[row] + size, "right")) - 1
        last = min(max(last, row + 1), len(ends) - 1)
        yield row, last, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


def word_spans(data: np.ndarray, ends: np.ndarray, apart: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the offsets of each document's first word; ``apart``: bytes between words."""
    word = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    stops = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, stops, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, ends: np.ndarray, apart: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every lower-cased word, and the offsets of each document's first word."""
    starts, stops, first = word_spans(data, ends, apart)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte[_lower[data]] * _power(_P, len(data)), dtype=np.uint64, out=sums[1:])
    return mix((sums[stops] - sums[starts]) * _power(_P_INV, len(data) + 1)[starts]), first


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each position; the last ``n - 1`` positions are left out."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = out * _Q + words[i : i + len(out)]
    return mix(out)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct ``n``-word shingle hashes; with fewer words, one for the whole sequence."""
    for row, last, data, ends in chunks(texts):
        words, first = word_hashes(data, ends)
        grams = ngram_hashes(words, n)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield ngram_hashes(words[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def lower_pieces(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words, A-Z lower-cased, as strings, each cut before its ASCII punctuation at the end where a letter or
    digit comes before that; and the offsets of each document's first piece. ``<|name|>`` is not cut at ``|``."""
    starts, stops, first = word_spans(data, ends)
    at = np.arange(len(data), dtype=np.int32)
    solid = np.maximum.accumulate(np.where(_punctuation[data], np.int32(-1), at))[stops - 1].astype(np.int64) if len(stops) else stops
    cut = (solid >= starts) & (solid < stops - 1)
    where = np.clip(solid, 0, max(len(data) - 2, 0))
    after = np.minimum(where + 1, len(data) - 1)
    latin = (data[where] >= 0x80) & (data[where] != 0x97) & (data[where] != 0xB7) & (data[where - 1] == 0xC3) & (where > starts)
    cut &= (_alnum[data[where]] | latin) & (data[after] != 0x7C)
    sizes = np.zeros(len(starts) + int(cut.sum()), np.int64)
    place = np.arange(len(starts)) + np.cumsum(cut) - cut
    sizes[place] = np.where(cut, solid + 1, stops) - starts
    sizes[place[cut] + 1] = stops[cut] - solid[cut] - 1
    kept = np.ascontiguousarray(_lower[data][~_space[data]])
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    pieces = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return pieces, np.append(place, len(sizes))[first]
