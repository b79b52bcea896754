"""Words of texts as numbers, in numpy: what the near-duplicate and benchmark operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumigraph.llm.tokens import parts

_U = np.uint64
_MULTIPLY, _MULTIPLY_2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
# Bytes that are hashed at once.
STRETCH = 1 << 18

_RANDOM = np.random.RandomState(5)
# A number for each byte, A-Z as a-z; 0 for the white space that parts words.
_BYTE = _RANDOM.randint(0, 1 << 62, 256, dtype=np.uint64) * _U(4) + _RANDOM.randint(0, 4, 256).astype(np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 2 * STRETCH), _powers(_UNBASE, 2 * STRETCH)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MULTIPLY
    return x ^ (x >> _U(29))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends) of the words in data: the sum of its bytes' numbers, each times a power for its place, mixed with its length.

    All words come from one running sum: a word's is the difference at its ends, moved down to place 0.
    """
    global _UP, _DOWN
    raw = np.frombuffer(data, np.uint8)
    if len(raw) > len(_UP):  # one very long word
        up, down = _powers(_BASE, len(raw)), _powers(_UNBASE, len(raw))
    else:
        up, down = _UP, _DOWN
    edges = np.flatnonzero(np.diff(_IS_WORD[raw], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix64(mix64((total[ends] - total[starts]) * down[starts]) + (ends - starts).astype(np.uint64)), ends


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of a text, in order."""
    found = [_hashed(part)[0] for part in parts(text, STRETCH)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def all_word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """word_hashes() of each text; short ones are hashed together."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < STRETCH):
            size += len(texts[hi]) + 1
            hi += 1
        if hi == lo + 1:
            yield word_hashes(texts[lo])
        else:
            hashes, ends = _hashed(b"\n".join(texts[lo:hi]))
            bounds = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
            yield from np.split(hashes, np.searchsorted(ends, bounds[:-1] - 1, "right"))
        lo = hi


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size words; with fewer words, one for all of them; none without words."""
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    out = words[:n]
    for k in range(1, size):
        out = mix64(out) * _MULTIPLY_2 + words[k : k + n]
    return mix64(out + _U(size))


def distinct_shingles(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The set of shingles of each text, ascending."""
    for words in all_word_hashes(texts):
        out = np.sort(shingles(words, size))
        yield out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def coded_words(texts: list[bytes], ascii_space: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, bounds, distinct): the words of texts as places among the distinct ones; text k has codes[bounds[k]:bounds[k + 1]].

    Words are parted by ASCII white space, or by any that Unicode knows."""
    raw = pa.array(texts, pa.large_binary())
    text = pa.Array.from_buffers(pa.large_string(), len(raw), raw.buffers())
    found = pc.ascii_split_whitespace(text) if ascii_space else pc.utf8_split_whitespace(text)
    flat, bounds = found.values, np.asarray(found.offsets).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():  # white space at a text's ends leaves an empty word there
        flat = flat.filter(pa.array(full))
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices), bounds, coded.dictionary.to_numpy(zero_copy_only=False).tolist()
