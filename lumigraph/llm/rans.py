"""Static range asymmetric numeral system over token ids, many interleaved lanes at once.

A model is shared by all blocks: for each id its frequency, scaled to 2**SCALE_BITS. A block is encoded
in stretches of at most STRETCH ids; each stretch starts lanes of its own, so its header is a checkpoint
from which decoding can begin: ids before it, CRC-32 of its ids, lane states, words.

Block: magic "LGR1", ids u64, stretches u32; then for each stretch: ids u32, lanes u32, words u32,
CRC-32 u32, the lanes' states u64 each, the words u32 each. All little-endian. Id number k of a stretch
belongs to lane k mod lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
STRETCH = 1 << 19
MOST_LANES = 2048
MAGIC = b"LGR1"
DAMAGED = "checksum differs: the block is damaged"
_U = np.uint64


class Model:
    """Frequencies for encoding; slots for decoding are laid out when first asked for."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids, self.freqs = np.asarray(ids, dtype=np.uint32), np.asarray(freqs, dtype=np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.freqs, dtype=np.uint64)[:-1]]).astype(np.uint64) if len(self.ids) else np.zeros(0, np.uint64)
        self._slots = self._places = None

    @classmethod
    def fit(cls, ids: np.ndarray, counts: np.ndarray) -> Model:
        """Every id that occurs gets a slot at least; the most frequent ones make up the difference."""
        order = np.argsort(ids)
        ids, counts = np.asarray(ids)[order], np.asarray(counts, dtype=np.float64)[order]
        if not len(ids):
            return cls(ids, counts)
        total = 1 << SCALE_BITS
        if len(ids) > total:
            raise ValueError(f"{len(ids)} different ids; {total} fit")
        freqs = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
        excess = int(freqs.sum()) - total
        for i in np.argsort(-freqs, kind="stable"):
            if excess == 0:
                break
            step = min(excess, int(freqs[i]) - 1) if excess > 0 else excess
            freqs[i] -= step
            excess -= step
        return cls(ids, freqs)

    def to_bytes(self) -> bytes:
        return zlib.compress(struct.pack("<I", len(self.ids)) + self.ids.astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        data = zlib.decompress(data)
        n = struct.unpack_from("<I", data)[0]
        return cls(np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, "<u4", n, 4 + 4 * n))

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freqs)
        return self._slots

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where in the model each of ids is; -1 for those that it has not seen."""
        if self._places is None:
            self._places = np.full(int(self.ids.max(initial=0)) + 2, -1, np.int32)
            self._places[self.ids] = np.arange(len(self.ids), dtype=np.int32)
        return self._places[np.minimum(ids, len(self._places) - 1)]


def _encode_stretch(ids: np.ndarray, model: Model) -> bytes:
    n = len(ids)
    lanes = max(1, min(MOST_LANES, n // 128))
    at = model.places(ids)
    if n and at.min() < 0:
        raise ValueError("an id that the model has not seen")
    freqs, starts = model.freqs[at].astype(np.uint64), model.starts[at]
    most = freqs << _U(63 - SCALE_BITS)
    x, words = np.full(lanes, LOW, dtype=np.uint64), []
    for lo in range((n - 1) // lanes * lanes, -1, -lanes):
        f, m = freqs[lo : lo + lanes], most[lo : lo + lanes]
        y = x[: len(f)]
        full = y >= m
        words.append((y[full] & _U(0xFFFFFFFF)).astype("<u4"))
        y = np.where(full, y >> _U(32), y)
        q = y // f
        x[: len(f)] = (q << _U(SCALE_BITS)) + (y - q * f) + starts[lo : lo + lanes]
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return struct.pack("<IIII", n, lanes, len(stream), crc) + x.astype("<u8").tobytes() + stream.tobytes()


def encode(ids: np.ndarray, model: Model) -> bytes:
    cuts = range(0, len(ids), STRETCH)
    return MAGIC + struct.pack("<QI", len(ids), len(cuts)) + b"".join([_encode_stretch(ids[i : i + STRETCH], model) for i in cuts])


def checkpoints(data: bytes) -> list[tuple[int, int, int]]:
    """(ids before it, ids, byte offset) of each stretch of a block."""
    if data[:4] != MAGIC:
        raise ValueError("not a block")
    _, n = struct.unpack_from("<QI", data, 4)
    out, at, before = [], 16, 0
    for _ in range(n):
        ids, lanes, words, _ = struct.unpack_from("<IIII", data, at)
        out.append((before, ids, at))
        before, at = before + ids, at + 16 + 8 * lanes + 4 * words
    return out


def decode_from(data: bytes, at: int, model: Model) -> np.ndarray:
    """The ids of the stretch whose checkpoint is at this offset."""
    n, lanes, n_words, crc = struct.unpack_from("<IIII", data, at)
    x = np.frombuffer(data, "<u8", lanes, at + 16).astype(np.uint64)
    words = np.frombuffer(data, "<u4", n_words, at + 16 + 8 * lanes)
    out, slots, read = np.empty(n, dtype=np.uint32), model.slots, 0
    for lo in range(0, n, lanes):
        y = x[: min(lanes, n - lo)]
        slot = y & _U((1 << SCALE_BITS) - 1)
        s = slots[slot]
        out[lo : lo + len(y)] = s
        y = model.freqs[s].astype(np.uint64) * (y >> _U(SCALE_BITS)) + slot - model.starts[s]
        low = np.flatnonzero(y < LOW)
        if read + len(low) > n_words:
            raise ValueError(DAMAGED)
        y[low] = (y[low] << _U(32)) | words[read : read + len(low)]
        read += len(low)
        x[: len(y)] = y
    ids = model.ids[out] if n else out
    # encoding started from LOW in every lane, so decoding must end there; this covers words that no id depends on
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc or read != n_words or (x != LOW).any():
        raise ValueError(DAMAGED)
    return ids


def decode(data: bytes, model: Model) -> np.ndarray:
    found = [decode_from(data, at, model) for _, _, at in checkpoints(data)]
    return np.concatenate(found) if found else np.zeros(0, np.uint32)
