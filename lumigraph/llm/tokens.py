"""Token ids of texts under a public vocabulary, by way of distinct pieces of text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from lumigraph.llm.common import held

# Texts are cut at white space into parts of about this many bytes, so a very long text needs no long list.
PART_BYTES = 1 << 22
# Bytes of texts whose distinct pre-tokens are looked up at once.
STRETCH = 1 << 21
# A worker's table of pre-tokens starts anew with the stretch after the one that brings it to so many, or to so many letters.
MOST_KNOWN, MOST_LETTERS = 150_000, 4_000_000

# What pre_tokens() cuts is of these characters alone; their NFC form is their own.
_PLAIN = re.compile("[!-~ß-įı-ſ×]+")


def parts(data: bytes, size: int = PART_BYTES) -> Iterator[bytes]:
    """Cuts data between white-space separated words."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(c, at + 1, at + size) for c in (b" ", b"\n"))
        if cut < 0:
            found = re.compile(rb"[ \t-\r]").search(data, at + size)
            cut = found.start() if found else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def stretches(texts: list[bytes], size: int = STRETCH) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(rows, pieces): texts in order, about size bytes at once; a longer text comes as several pieces of one row."""
    rows, held, n = [], [], 0
    for i, text in enumerate(texts):
        for p in parts(text, size):
            rows.append(i)
            held.append(p)
            n += len(p)
            if n >= size:
                yield np.array(rows), held
                rows, held, n = [], [], 0
    if held:
        yield np.array(rows), held


# Kinds of bytes: white space, parts of letters, digits, other plain ones, and those that the rules below don't cover.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
# The same for the two bytes of U+00C0 to U+017F; the lower case of U+0130 is longer, so that one is odd.
_PAIRS = [chr(c) for c in range(0xC0, 0x180)]
_PAIR_KIND = np.array([_ODD if c == "\u0130" else _LETTER if c.isalpha() else _MARK for c in _PAIRS], np.uint8)
_PAIR_LOW = np.array([list((c if c == "\u0130" else c.lower()).encode()) for c in _PAIRS], np.uint8)


def pre_tokens(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, bounds, distinct): pre-tokens in lower case, as places among the distinct ones; piece k has codes[bounds[k]:bounds[k + 1]].

    A pre-token is, after white space is dropped, 's 't 're 've 'm 'll 'd, a run of letters, a digit, or a
    run of anything else, whichever comes first. Chunks between white space that hold a special token's
    opening, or other letters than ASCII's and those of _PAIRS, are left whole and as they are.
    """
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    raw = np.frombuffer(b"\n".join([*pieces, b"\n\n"]), np.uint8)  # two more bytes, so what follows a byte can always be asked for
    kind, low = _KIND[raw], _LOW[raw]
    at = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))
    if len(at):
        at = at[raw[at + 1] >> 6 == 2]
        pair = (raw[at].astype(np.int64) - 0xC3) * 64 + (raw[at + 1] & 63)
        kind[at] = kind[at + 1] = _PAIR_KIND[pair]
        low[at], low[at + 1] = _PAIR_LOW[pair].T
    blank = kind == _SPACE
    start = np.empty(len(raw), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _DIGIT
    start &= ~blank
    quotes = np.flatnonzero((raw == ord("'")) & start)
    if len(quotes):
        a, b = low[quotes + 1], low[quotes + 2]
        short = np.isin(a, list(b"stmd"))
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        quotes, after = quotes[short | long], np.where(short, 2, 3)[short | long]
        start[quotes + 1] = False
        start[quotes + after] = ~blank[quotes + after]
    odd = np.flatnonzero((kind == _ODD) | (raw == ord("<")) & np.append(raw[1:] == ord("|"), False))
    if len(odd):
        edges = np.flatnonzero(np.diff(~blank, prepend=False))
        chunk = np.unique(np.searchsorted(edges, odd, "right") - 1)
        inside = np.zeros(len(raw), np.int8)
        inside[edges[chunk]] = 1
        inside[edges[chunk + 1]] = -1
        whole = np.cumsum(inside, dtype=np.int8) > 0
        start[whole] = False
        start[edges[chunk]] = True
        low = np.where(whole, raw, low)
    bounds = np.flatnonzero(start | blank & ~np.concatenate([[False], blank[:-1]]))
    full = start[bounds]
    offsets = np.concatenate([[0], np.cumsum(np.diff(bounds, append=len(raw))[full])]).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low[~blank])])
    coded = found.dictionary_encode()
    return np.asarray(coded.indices), np.searchsorted(bounds[full], np.concatenate([[0], np.cumsum(sizes)])), coded.dictionary


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones as themselves, the rest from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The entries of flat that belong to codes, in order: code c has sizes[c] of them, from starts[c] on."""
    starts = np.cumsum(sizes) - sizes if starts is None else starts
    per = sizes[codes]
    ends = np.cumsum(per)
    return flat[np.repeat(starts[codes] - (ends - per), per) + np.arange(ends[-1] if len(ends) else 0)]


class _Known:
    """Ids of pre-tokens, each encoded once as long as it is known. A full table starts anew with those of the last stretch."""

    def __init__(self, encode, kind: str):
        self.encode, self.kind, self.last = encode, kind, np.zeros(0, np.int64)
        self.code, self.flat, self.used, self.letters = {}, np.zeros(1 << 16, kind), 0, 0
        self.sizes = self.starts = np.zeros(0, np.int64)

    def _shrink(self):
        names, sizes = list(self.code), self.sizes[self.last]
        kept = gather(self.flat, self.sizes, self.last, self.starts) if self.used else self.flat[:0]
        self.code, self.used = {names[k]: i for i, k in enumerate(self.last.tolist())}, len(kept)
        self.flat, self.sizes, self.starts = np.concatenate([kept, np.zeros(1 << 16, self.kind)]), sizes, np.cumsum(sizes) - sizes
        self.letters = sum(map(len, self.code))

    def codes(self, distinct: pa.Array) -> np.ndarray:
        """A code for each of distinct pre-tokens."""
        if len(self.code) > MOST_KNOWN or self.letters > MOST_LETTERS:
            self._shrink()
        names = distinct.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter(map(self.code.get, names, repeat(-1)), np.int64, len(names))
        lacking = np.flatnonzero(out < 0)
        if len(lacking):
            new = [names[i] for i in lacking.tolist()]
            sizes, ids = self.encode(new)
            out[lacking] = np.arange(len(self.code), len(self.code) + len(new))
            self.code.update(zip(new, out[lacking].tolist(), strict=True))
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(len(ids) + self.used // 2, self.kind)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.sizes, self.starts = np.concatenate([self.sizes, sizes]), np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
            self.used += len(ids)
            self.letters += sum(map(len, new))
        self.last = out
        return out


class Vocabulary:
    """Ids as the vocabulary's own library gives them, without added special tokens.

    Where white space always ends a pre-token and is dropped (separates), texts are cut into pre-tokens, a
    stretch at a time, and the distinct ones are looked up. Other vocabularies encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.separates = False
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size, self.encode = piece.vocab_size(), lambda text: piece.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.size, self.encode = tokenizer.get_vocab_size(), lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            with open(path, encoding="utf-8") as f:
                self.separates = _drops_space(json.load(f))
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        if self.separates:
            self.pieces_of, self.letters = tokenizer.model.tokenize, byte_letters()
            self.ends = np.zeros(self.size, bool)  # ids that a pre-token ends with, and no other
            self.ends[[i for s, i in tokenizer.get_vocab(with_added_tokens=False).items() if s.endswith(tokenizer.model.end_of_word_suffix)]] = True
            self.known, self.sized = _Known(self._encoded, self.kind), _Known(self._sizes, self.kind)

    def _spelled(self, names: list[str]) -> tuple[list[str], dict[int, list[int]]]:
        """(pre-tokens in the letters of the vocabulary, ids of chunks that pre_tokens() has left whole)."""
        whole, spelled = {}, list(names)
        for i, s in enumerate(names):
            if not (s.isascii() and s.isprintable()) or "<|" in s:
                if "<|" in s or not _PLAIN.fullmatch(s):
                    whole[i], spelled[i] = self.encode(s), "x"
                else:
                    spelled[i] = "".join([self.letters[b] for b in s.encode()])
        return spelled, whole

    def _sizes(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spelled, whole = self._spelled(names)
        sizes = np.fromiter(map(len, map(self.pieces_of, spelled)), np.int64, len(spelled))
        for i, x in whole.items():
            sizes[i] = len(x)
        return sizes, np.zeros(0, self.kind)

    def sizes(self, names: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token, as pre_tokens() cuts them."""
        return self._sizes(names)[0]

    def _encoded(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of pre-tokens."""
        spelled, whole = self._spelled(names)
        pieces_of = self.pieces_of
        ids = np.array([x.id for s in spelled for x in pieces_of(s)], self.kind)
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if not whole:
            return sizes, ids
        cuts = np.split(ids, np.cumsum(sizes)[:-1])
        for i, x in whole.items():
            sizes[i], cuts[i] = len(x), np.array(x, self.kind)
        return sizes, np.concatenate(cuts)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """The number of each text's ids; where white space separates, no ids are made.

        Distinct pre-tokens are counted once as long as they are known; their counts meet the places where
        each text has them, and are summed.
        """
        if not self.separates:
            return self.ids(texts)[1]
        out = np.zeros(len(texts), np.int64)
        for rows, pieces in stretches(texts):
            codes, bounds, distinct = pre_tokens(pieces)
            known = self.sized.codes(distinct)
            n = self.sized.sizes[known]
            np.add.at(out, rows, np.diff(np.concatenate([[0], np.cumsum(n[codes])])[bounds]))
        return out

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, the number of each text's)."""
        flat, sizes = [np.zeros(0, self.kind)], np.zeros(len(texts), np.int64)
        if not self.separates:
            for i, text in enumerate(texts):
                flat.append(np.array(self.encode(text.decode()), self.kind))
                sizes[i] = len(flat[-1])
            return np.concatenate(flat), sizes
        for rows, pieces in stretches(texts):
            codes, bounds, distinct = pre_tokens(pieces)
            known, own = self.known.codes(distinct), self.known
            flat.append(gather(own.flat, own.sizes, known[codes], own.starts))
            np.add.at(sizes, rows, np.diff(np.concatenate([[0], np.cumsum(own.sizes[known][codes])])[bounds]))
        return np.concatenate(flat), sizes

    def packer(self, width: int):
        """A function from a text's bytes to its ids as little-endian integers of width bytes."""
        return lambda data: self.ids([data])[0].astype(f"<u{width}").tobytes()

    def counter(self):
        """A function from a text's bytes to its number of tokens."""
        return lambda data: int(self.counts([data])[0])


def _drops_space(config: dict) -> bool:
    """Whether the vocabulary's own rules are those that _chunk() knows: NFC, lower case, white space dropped."""
    kinds = [x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])]
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in steps] != ["Split", "ByteLevel"]:
        return False
    plain = all(not (x["lstrip"] or x["rstrip"] or x["normalized"] or re.search(r"\s", x["content"])) and x["content"].startswith("<|") for x in config.get("added_tokens", []))
    rule = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return plain and bool((config.get("model") or {}).get("end_of_word_suffix")) and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert")) and steps[0].get("pattern") == {"Regex": rule} and config.get("post_processor") is None


def vocabulary(path: str) -> Vocabulary:
    """One for each worker process, as long as it serves one operator after another of the same vocabulary."""
    return held(("vocabulary", path), lambda: Vocabulary(path))
