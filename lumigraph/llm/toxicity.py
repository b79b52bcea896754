"""Toxicity: a subsequence string-kernel support vector machine on Nystrom landmarks."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigraph.llm.common import discard, materialize, slices
from lumigraph.llm.tokens import parts, stretches
from lumigraph.llm.words import coded_words

ORDER = 3  # letters of a subsequence
DECAY = 0.85  # for each letter that a subsequence spans
POWER = 5  # of the normalised kernel; powers of a kernel are kernels
FLOOR = 0.55  # normalised values below it count as 0
SHARED = 0.6  # so do those of words that have a smaller share of a landmark's letters in its order
WINDOW, STEP = 24, 12  # longer words count as their best window
VARIANTS = 8  # misspelt forms of each word that are learnt from
SPELLED = 4  # so many single letters in a row are read as a word as well
MOST_LANDMARKS, MOST_CLEAN = 128, 64
STRETCH = 1 << 21  # bytes that are read at once, and
OVERLAP = 256  # of them that the next stretch of a text reads again
LONG_WORD = 1 << 14  # letters of a word that are compared at once
LONGEST = 64  # letters of a word that is kept
AT_ONCE = 1 << 15  # words whose letters are looked at at once
MOST_KINDS = 16  # letters of a landmark each choice of which is judged; of more only their number is
LEAST_GAIN = 20  # of a landmark's log-likelihood ratio: five toxic texts of ten in a hundred, and no clean one;
GAIN_TEXTS = 4_000  # among more texts as much more: with enough of them any slight difference is significant
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_GAP = re.compile(rb"[ \t-\r]")


def _forms(word: str) -> set[str]:
    """What a word is compared as: without marks at its ends, by its letters alone, and by each piece between inner marks; long ones by windows."""
    bare = word.lower()
    if not bare.isalpha():
        bare = _EDGES.sub("", bare)
    elif len(bare) <= WINDOW:
        return {bare}
    forms = {bare} if bare.isalpha() else {bare, _NOT_LETTERS.sub("", bare), *(p for p in _NOT_LETTERS.split(bare) if len(p) >= ORDER)}
    return {f[i : i + WINDOW] for f in forms for i in range(0, max(1, len(f) - WINDOW + STEP), STEP)}


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    """Code points of words, a row for each."""
    out = np.full((len(words), width), pad, np.int32)
    n = np.array([len(w) for w in words])
    column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(words)), n), column] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray, paired: bool = False) -> np.ndarray:
    """Common subsequences of ORDER letters, each weighed by DECAY to the letters that it spans on both sides.

    a and b hold code points, padded with different negative numbers; the result has a row for each word of
    a and a column for each of b, or with paired one column, for the word in the same row of b.
    """
    width, decay = b.shape[1], np.float32(DECAY)
    shape = (width, len(a), 1 if paired else len(b))
    # Sums for each place in b are held without the decay up to that place, so a sum over the places before is a running one.
    place = decay ** np.arange(width, dtype=np.float32)[:, None, None]
    places = b.T[:, :, None] if paired else b.T[:, None, :]
    inner = [np.zeros(shape, np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(shape, np.float32)
    for i in range(a.shape[1]):
        same = (a[None, :, i, None] == places).astype(np.float32)
        total += same * inner[-1]
        for k in range(ORDER - 2, -1, -1):
            fresh = same * inner[k - 1] if k else same / place
            for j in range(1, width):
                fresh[j] += fresh[j - 1]
            inner[k] *= decay
            inner[k][1:] += fresh[:-1]
    return (total * place).sum(axis=0) * decay ** np.float32(ORDER + 1)


_ALONE = np.zeros(0x110000, np.uint8)  # of a code point: 0 not yet asked, 1 a mark, 2 part of a word, 3 a letter


def _word_parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether code points are letters or digits, whether they are letters."""
    kind = _ALONE[codes]
    if not kind.all():
        for c in np.unique(codes[kind == 0]).tolist():
            _ALONE[c] = 3 if chr(c).isalpha() else 2 if chr(c).isalnum() else 1
        kind = _ALONE[codes]
    return kind > 1, kind > 2


_BITS = np.uint64(1) << np.arange(61, dtype=np.uint64)


def _letters(codes: np.ndarray) -> np.ndarray:
    """A bit for each letter; some letters share one."""
    return _BITS[codes % 61]


class Landmarks:
    """Kernel values of words against fixed words, as sparse rows: normalised values under FLOOR count as 0.

    A word can only reach FLOOR if it has enough of a landmark's letters: what is left of the landmark's own
    kernel with these alone bounds the value (Cauchy-Schwarz), and is known beforehand for each choice of them.
    A word's own kernel is no less than that of as many different letters, so few words that pass need it.
    """

    def __init__(self, words: list[str]):
        self.words = [w[:WINDOW] for w in words]
        self.codes = _codes(self.words, max(map(len, self.words)), -2)
        self.sizes, self.own = np.array([len(w) for w in self.words]), self._own(self.words)
        self.masks = np.array([np.bitwise_or.reduce(_letters(np.array([ord(c) for c in w]))) for w in self.words], np.uint64)
        self.kinds = [sorted({ord(c) % 61 for c in w}) for w in self.words]
        self.need, self.enough = zip(*map(self._need, self.words), strict=True)
        self.least = self._own(["".join(map(chr, range(n))) for n in range(1, WINDOW + 1)])
        self.match = np.zeros((len(self.words), 62), np.uint64)
        for i, w in enumerate(self.words):
            for j, c in enumerate(w):
                self.match[i, ord(c) % 61] |= np.uint64(1 << j)

    @staticmethod
    def _own(words: list[str]) -> np.ndarray:
        width = max(map(len, words))
        return np.sqrt(subsequence_kernel(_codes(words, width, -1), _codes(words, width, -2), paired=True)[:, 0])

    @staticmethod
    def _need(word: str) -> tuple[int, np.ndarray | None]:
        """(how many of its letters a word must have at least, whether these letters are enough, by a bit for each in order, or None)."""
        kinds = sorted({ord(c) % 61 for c in word})
        least, enough = FLOOR * Landmarks._own([word])[0], np.zeros(1 << len(kinds), bool) if len(kinds) <= MOST_KINDS else None
        for gone in range(len(kinds)):
            kept = list(combinations(range(len(kinds)), len(kinds) - gone))
            left = [[c if ord(c) % 61 in own else "" for c in word] for own in ({kinds[j] for j in k} for k in kept)]
            a, b = (np.array([[ord(c) if c else pad for c in w] for w in left], np.int32) for pad in (-1, -2))
            reach = np.sqrt(subsequence_kernel(a, b, paired=True)[:, 0]) >= least * (1 - 1e-5)
            if enough is not None:
                enough[[sum(1 << j for j in k) for k in kept]] = reach
            if not reach.any():
                return len(kinds) - gone + 1, enough
        return 1, enough

    def near(self, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, to): which words, by the letters that they hold, have enough of which landmarks' letters."""
        at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (mask, need) in enumerate(zip(self.masks, self.need, strict=True)):
            found = np.flatnonzero(np.bitwise_count(masks & mask) >= need)
            if len(found) and self.enough[k] is not None:
                own, place = masks[found], np.zeros(len(found), np.uint64)
                for j, kind in enumerate(self.kinds[k]):
                    place |= (own >> np.uint64(kind) & np.uint64(1)) << np.uint64(j)
                found = found[self.enough[k][place.astype(np.int64)]]
            at.append(found)
            to.append(np.full(len(found), k))
        return np.concatenate(at), np.concatenate(to)

    def _in_order(self, kinds: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The length of the longest common subsequence of words (rows of letters' kinds) and landmarks, by bits."""
        left = np.full(len(to), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(kinds.shape[1]):
            both = left & self.match[to, kinds[:, i]]
            left = (left + both) | (left - both)
        return np.bitwise_count(~left)

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each word: its best form's kernel with each landmark, 0 to 1."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        own = list(map(_forms, words))
        forms, rows = [f for x in own for f in x], np.repeat(np.arange(len(words)), list(map(len, own)))
        rows = rows[np.fromiter(map(len, forms), np.int64, len(forms)) >= ORDER].tolist()
        forms = [f for f in forms if len(f) >= ORDER]
        if not forms:
            return out
        size = np.fromiter(map(len, forms), np.int64, len(forms))
        ends = np.cumsum(size)
        letter_kinds = np.frombuffer("".join(forms).encode("utf-32-le"), np.int32) % 61
        masks = np.bitwise_or.reduceat(np.uint64(1) << letter_kinds.astype(np.uint64), ends - size)
        at, to = self.near(masks)
        order = np.argsort(size[at], kind="stable")
        at, to, enough = at[order], to[order], []
        for lo in range(0, len(at), 1 << 16):
            a, b = at[lo : lo + (1 << 16)], to[lo : lo + (1 << 16)]
            kinds = np.full((len(a), size[a[-1]]), 61, np.int64)
            column = np.arange(size[a].sum()) - np.repeat(np.cumsum(size[a]) - size[a], size[a])
            kinds[np.repeat(np.arange(len(a)), size[a]), column] = letter_kinds[np.repeat(ends[a] - size[a], size[a]) + column]
            enough.append(lo + np.flatnonzero(self._in_order(kinds, b) >= SHARED * self.sizes[b]))
        if not enough or not sum(map(len, enough)):
            return out
        keep = np.concatenate(enough)
        at, to = at[keep], to[keep]
        value = np.empty(len(at), np.float32)
        order = np.lexsort((size[at], self.sizes[to] // 3))
        for lo in range(0, len(at), 4096):
            part = order[lo : lo + 4096]
            a, b = at[part], to[part]
            codes = _codes([forms[i] for i in a], size[a].max(), -1)
            value[part] = subsequence_kernel(codes, self.codes[b, : self.sizes[b].max()], paired=True)[:, 0]
        able = np.flatnonzero(value >= FLOOR * (1 - 1e-5) * self.own[to] * self.least[size[at] - 1])
        at, to, value = at[able], to[able], value[able]
        used, again = np.unique(at, return_inverse=True)
        for lo in range(0, len(used), 4096):
            own = self._own([forms[i] for i in used[lo : lo + 4096]])
            mine = (again >= lo) & (again < lo + 4096)
            value[mine] /= own[again[mine] - lo] * self.own[to[mine]]
        near = np.flatnonzero(value >= FLOOR)
        for i, k, v in zip(at[near].tolist(), to[near].tolist(), value[near].tolist(), strict=True):
            out[rows[i], k] = max(out[rows[i], k], min(v, 1.0) ** POWER)
        return out


class Model:
    """A machine over words: a sentence is as toxic as its worst word, a text as its worst sentence.

    weights and bias make a word's margin from its landmark features, slope and offset a score from a
    text's margin. Margins of words that it has met are kept, in a table of bounded size.
    """

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0, most: int = 100_000):
        self.landmarks, self.weights, self.bias, self.slope, self.offset, self.most = landmarks, weights, bias, slope, offset, most
        self.__setstate__(self.__dict__)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "marks")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.known, self.marks = {}, None

    def _marks(self) -> Landmarks:
        if self.marks is None:
            self.marks = Landmarks(self.landmarks)
        return self.marks

    def _learnt(self, words: list[str]) -> np.ndarray:
        """Margins of words. A very long one is read by overlapping parts, its margin is the worst of theirs."""
        parts, owner = words, np.arange(len(words))
        if max(map(len, words), default=0) > LONG_WORD:
            cut = [(i, w[lo : lo + LONG_WORD + WINDOW]) for i, w in enumerate(words) for lo in range(0, max(1, len(w) - WINDOW), LONG_WORD)]
            parts, owner = [p for _, p in cut], [i for i, _ in cut]
        found, out, lo = np.empty(len(parts)), np.full(len(words), -np.inf), 0
        while lo < len(parts):
            hi, size = lo, 0
            while hi < len(parts) and hi - lo < 8192 and (hi == lo or size + len(parts[hi]) <= 8 * LONG_WORD):
                size += len(parts[hi])
                hi += 1
            found[lo:hi] = self._marks().of(parts[lo:hi]) @ self.weights + self.bias
            lo = hi
        np.maximum.at(out, owner, found)
        return out

    def _margins_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(margin, whether it is a single letter) of each of these distinct words."""
        if len(self.known) > self.most:
            self.known = {}
        found = [self._screened(words[lo : lo + AT_ONCE]) for lo in range(0, len(words), AT_ONCE)]
        return np.concatenate([m for m, _ in found]), np.concatenate([s for _, s in found])

    def _screened(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_margins_of() some of the words. Those without enough letters of any landmark have the bias for their margin and
        are no further looked at; others, and very long ones, are learnt, and kept by what they are compared as."""
        text = "\n".join(w if len(w) <= LONG_WORD else "" for w in words).lower()  # no word holds a line's end
        codes = np.frombuffer((text + "\n").encode("utf-32-le"), np.int32)
        ends = np.flatnonzero(codes == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        part, letter = (np.add.reduceat(x, starts, dtype=np.int64) for x in _word_parts(codes))
        singles = (part == 1) & (letter == 1) & (ends - starts <= LONGEST)
        bits = _BITS[codes % 61]
        bits[ends] = 0
        near = {*self._marks().near(np.bitwise_or.reduceat(bits, starts))[0].tolist(), *(i for i, w in enumerate(words) if len(w) > LONG_WORD)}
        near, out, low = sorted(near), np.full(len(words), self.bias, np.float64), text.split("\n")
        bare = [words[i] if len(words[i]) > LONGEST else low[i] if low[i].isalpha() else _EDGES.sub("", low[i]) for i in near]
        new = [w for w in dict.fromkeys(bare) if w not in self.known]
        found = dict(zip(new, self._learnt(new).tolist(), strict=True))
        self.known.update((w, m) for w, m in found.items() if len(w) <= LONGEST)
        out[near] = [found[w] if w in found else self.known[w] for w in bare]
        return out, singles

    def margins(self, texts: list[str]) -> list[float]:
        """For each text the worst of all its words, and of single letters in a row read as words.

        Whole texts are read, by stretches of whole words; each reads the last words before it again, so that
        no row of single letters is broken.
        """
        out, rows, held, size = np.full(len(texts), self.bias, np.float64), [], [], 0
        for i, text in enumerate(texts):
            last = b""
            for piece in parts(text.encode(), STRETCH):
                rows.append(i)
                held.append(last + piece)
                size += len(held[-1])
                last = piece[-OVERLAP:]
                if len(last) < len(piece):
                    gap = _GAP.search(last)
                    last = last[gap.start() :] if gap else b""
                if size >= STRETCH:
                    self._read(rows, held, out)
                    rows, held, size = [], [], 0
        self._read(rows, held, out)
        return out.tolist()

    def _read(self, rows: list[int], held: list[bytes], out: np.ndarray):
        codes, bounds, words = coded_words(held, ascii_space=False) if held else (np.zeros(0, np.int64), [0], [])
        if not len(codes):
            return
        margins, singles = self._margins_of(words)
        full = np.flatnonzero(np.diff(bounds))
        np.maximum.at(out, np.array(rows)[full], np.maximum.reduceat(margins[codes], bounds[full]))
        single = singles[codes]
        if single.sum() < SPELLED:
            return
        edges = np.zeros(len(codes) + 1, bool)
        edges[bounds] = True
        starts = np.flatnonzero(single & (edges[:-1] | ~np.concatenate([[False], single[:-1]])))
        stops = np.flatnonzero(single & (edges[1:] | ~np.concatenate([single[1:], [False]]))) + 1
        long = stops - starts >= SPELLED
        runs = [_NOT_LETTERS.sub("", "".join([words[c] for c in codes[a:b].tolist()])) for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True)]
        if runs:
            np.maximum.at(out, np.array(rows)[np.searchsorted(bounds, starts[long], "right") - 1], self._learnt(runs))

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.array(self.margins(texts), np.float64) + self.offset, -50, 50)))


def _gain(k1: int, k2: int, n1: int, n2: int) -> float:
    """The log-likelihood ratio of a word's rates in toxic and clean texts; the greater k1, the greater."""
    if k1 / n1 <= k2 / n2:
        return 0.0
    p = (k1 + k2) / (n1 + n2)
    return 2 * sum(k * np.log(k / n / q) for k, n, q in ((k1, n1, p), (n1 - k1, n1, 1 - p), (k2, n2, p), (n2 - k2, n2, 1 - p)) if k)


def _best(held: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, most: int | None) -> dict[str, int]:
    """The words that tell toxic texts apart, best first."""
    found = sorted(((_gain(k, clean.get(w, 0), n_toxic, max(1, n_clean)), w) for w, k in held.items() if k >= max(3, 0.01 * n_toxic)), key=lambda x: (-x[0], x[1]))
    least = LEAST_GAIN * max(1, (n_toxic + n_clean) / GAIN_TEXTS)
    return {w: held[w] for g, w in found[:most] if g >= least}


def _beside(text: str) -> dict[str, set]:
    """The pairs of words that each word of a text stands between."""
    words = [_EDGES.sub("", w) for w in text.lower().split()]
    own: dict[str, set] = {}
    for u, w, v in zip(["", *words], words, [*words[1:], ""], strict=False):
        if ORDER <= len(w) <= WINDOW:
            own.setdefault(w, set()).add((u, v))
    return own


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int = MOST_LANDMARKS) -> tuple[dict[str, int], Counter]:
    """Words that tell toxic texts apart, with the number of toxic texts that show it; and how many clean texts hold each word.

    Of toxic texts a word counts those that have it between a pair of words that no earlier one has it
    between: copies of a toxic text repeat its words with what stands beside them, and tell nothing new.
    """
    beside: dict[str, set] = {}
    held, clean, n_toxic = Counter(), Counter(), int(toxic.sum())
    for text, y in zip(texts, toxic, strict=True):
        own = _beside(text)
        if not y:
            clean.update(own.keys())
            continue
        for w, pairs in own.items():
            seen = beside.setdefault(w, set())
            held[w] += pairs.isdisjoint(seen)
            seen |= pairs
    return _best(held, clean, n_toxic, len(texts) - n_toxic, most), clean


def _fit_svm(x: np.ndarray, y: np.ndarray, count: np.ndarray, cost: float = 3000.0, steps: int = 50) -> np.ndarray:
    """Primal weights (the last is the bias) of a squared-hinge machine whose two classes weigh alike, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    c = cost * count / np.where(y > 0, count[y > 0].sum(), count[y < 0].sum())
    ridge, w = np.diag([1.0] * (x.shape[1] - 1) + [1e-6]), np.zeros(x.shape[1])
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        on = gap > 0
        gradient = ridge @ w - 2 * x[on].T @ (c[on] * y[on] * gap[on])
        step = np.linalg.solve(ridge + 2 * (x[on] * c[on, None]).T @ x[on], gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit_scale(margins: np.ndarray, y: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Platt's scaling: slope and offset of a logistic curve, with his softened targets, for count texts of each margin and class."""
    up, down = count[y > 0].sum(), count[y < 0].sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.stack([margins, np.ones_like(margins)], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (count * (p * (1 - p) + 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (count * (p - target)) + 1e-6 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _variants(word: str, rng: np.random.RandomState) -> list[str]:
    """The word with one inserted letter, inside."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [word[:i] + letters[rng.randint(26)] + word[i:] for i in rng.randint(1, max(2, len(word)), VARIANTS)]


def _misspelt(chosen: dict[str, int]) -> list[tuple[str, str]]:
    """(misspelt form, word) of the chosen words."""
    rng = np.random.RandomState(0)
    return [(v, w) for w in chosen for v in _variants(w, rng)]


def train(texts: list[str], toxic: np.ndarray) -> Model | None:
    """A model from labelled texts in memory; None where the labels tell of one class alone or no word tells them apart. fit() does the same for tables."""
    toxic = np.asarray(toxic, bool)
    chosen, clean = choose_landmarks(texts, toxic) if toxic.any() and not toxic.all() else ({}, Counter())
    if not chosen:
        return None
    known = sorted(w for w in clean if w not in chosen)
    near = Landmarks(list(chosen)).of(known).any(axis=1)
    model = _learn(chosen, [w for w, n in zip(known, near, strict=True) if n], clean, int((~toxic).sum()))
    model.slope, model.offset = _fit_scale(np.array(model.margins(texts)), np.where(toxic, 1.0, -1.0), np.ones(len(texts)))
    return model


def _learn(chosen: dict[str, int], near: list[str], clean: dict[str, int], n_clean: int) -> Model:
    """A model from the chosen words, the clean words near them, and how many of n_clean clean texts hold each.

    Sentences of toxic texts are toxic for the chosen words in them, which are learnt with misspelt forms;
    every word of a clean sentence is clean. The landmarks are the chosen words and, from a first machine
    on these alone, the clean words that it finds hardest to tell from them.
    """
    words = list(chosen)
    bad = [*chosen.items(), *((v, 0.3 * chosen[w] / VARIANTS) for v, w in _misspelt(chosen) if v not in clean)]
    good = [(w, clean[w]) for w in near] + [(w, clean[w]) for w in words if clean.get(w)] + [("", n_clean)]
    names, count = [w for w, _ in bad + good], np.array([n for _, n in bad + good], np.float64)
    y = np.where(np.arange(len(names)) < len(bad), 1.0, -1.0)

    def machine(landmarks: list[str]) -> tuple[np.ndarray, float, np.ndarray]:
        # Nystrom: words are compared within the landmarks' span, so features are whitened by the landmarks' own kernel matrix
        of = Landmarks(landmarks).of
        values, vectors = np.linalg.eigh(of(landmarks).astype(np.float64))
        white = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        x = of(names).astype(np.float64)
        w = _fit_svm(x @ white, y, count)
        weights, bias = white @ w[:-1], float(w[-1])
        return weights, bias, x @ weights + bias

    margins = machine(words)[2]
    hard = sorted(((m, w) for m, w, k in zip(margins, names, y, strict=True) if k < 0 and m > -0.5 and w and w not in chosen), reverse=True)[:MOST_CLEAN]
    landmarks = words + [w for _, w in hard]
    weights, bias, _ = machine(landmarks)
    return Model(landmarks, weights.astype(np.float32), bias)


def held_out(id_col: str):
    """One row in five is never learnt from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def _held_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(rows, places, words): the words of a landmark's length that each text holds, once each, as places among the distinct ones."""
    number: dict[str, int] = {}
    found = [np.zeros(0, np.int64)]
    for rows, pieces in stretches(texts, STRETCH):
        codes, bounds, distinct = coded_words(pieces, ascii_space=False)
        bare = [w if w.isalpha() else _EDGES.sub("", w) for w in "\n".join(distinct).lower().split("\n")] if distinct else []
        place = np.array([number.setdefault(w, len(number)) if ORDER <= len(w) <= WINDOW else -1 for w in bare], np.int64)[codes]
        row = np.repeat(rows, np.diff(bounds))
        found.append(np.unique((row << 32 | place)[place >= 0]))
    key = np.unique(np.concatenate(found))
    return key >> 32, key & 0xFFFFFFFF, list(number)


def _word_counts(texts: DataFrame) -> DataFrame:
    """(w, toxic, clean): how many of these texts (t, y) of either class hold each word."""

    def run(batches):
        for part, (found,) in slices(batches, 4 * STRETCH, 0):
            rows, places, words = _held_words([t.encode() for t in found])
            bad = np.array(part.column(1).to_pylist(), bool)[rows]
            counts = [np.bincount(places[k], minlength=len(words)) for k in (bad, ~bad)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *map(pa.array, counts)], ["w", "toxic", "clean"])

    return texts.select("t", "y").mapInArrow(run, "w string, toxic bigint, clean bigint").groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _shown(texts: DataFrame, words: set[str]) -> dict[str, int]:
    """For each word the number of these toxic texts (i, t) that have it only between pairs of words that no earlier one has it between.

    A text is counted for a word where it is the first for as many pairs as it has the word between."""

    def run(batches):
        for part, (found,) in slices(batches, STRETCH, 1):
            rows = [(i, w, blake2b(f"{u} {v}".encode(), digest_size=16).digest()) for i, t in zip(part.column(0).to_pylist(), found, strict=True) for w, pairs in _beside(t).items() if w in words for u, v in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.binary()))], ["i", "w", "pair"])

    pairs = texts.select(F.col("i").cast("string").alias("i"), "t").mapInArrow(run, "i string, w string, pair binary")
    has = pairs.groupBy("w", "i").agg((-F.count("*")).alias("n"))
    first = pairs.groupBy("w", "pair").agg(F.min("i").alias("i")).groupBy("w", "i").agg(F.count("*").alias("n"))
    alone = has.unionByName(first).groupBy("w", "i").agg(F.sum("n").alias("n")).where("n = 0")
    return {r.w: r.n for r in alone.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _near_words(counts: DataFrame, chosen: dict[str, int]) -> tuple[list[str], dict[str, int]]:
    """(clean words with a kernel value with a chosen one, how many clean texts hold these, the chosen ones and their misspelt forms)."""
    asked = {*chosen, *(v for v, _ in _misspelt(chosen))}
    marks = counts.sparkSession.sparkContext.broadcast(Landmarks(list(chosen)))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                words = part.column(0).to_pylist()
                near = marks.value.of(words).any(axis=1)
                part = part.append_column("near", pa.array(near))
                yield part.filter(pa.array(near | np.fromiter((w in asked for w in words), bool, len(words))))

    found = counts.where("clean > 0").select("w", "clean").mapInArrow(run, "w string, clean bigint, near boolean").collect()
    marks.unpersist()
    return sorted(r.w for r in found if r.near and r.w not in chosen), {r.w: r.clean for r in found}


def _scale(texts: DataFrame, model: Model) -> tuple[float, float]:
    """Slope and offset from the margins of all these texts (t, y)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, (found,) in slices(batches, STRETCH, 0):
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.margins(found), pa.float64()), part.column(1)], ["m", "y"])

    rows = texts.select("t", "y").mapInArrow(run, "m double, y boolean").groupBy("m", "y").agg(F.count("*").alias("n")).collect()
    shared.unpersist()
    rows.sort()
    return _fit_scale(np.array([r.m for r in rows]), np.where([r.y for r in rows], 1.0, -1.0), np.array([r.n for r in rows], np.float64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Trains on every labelled document that is not held out, whatever its length; none is left out and no
    text comes to the driver. Nulls are left out; of several labels of one id the greatest counts, of several
    texts the greatest. None as in train().

    Labelled texts are met by id and written once. Over them are counted the texts that hold each word, the
    toxic ones that show a word which may be chosen, and the margins. The driver gets the words of a hundredth
    of the toxic texts, the clean words that resemble a chosen one, and the distinct margins."""
    rows = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y is not null").where(~held_out("i")).groupBy("i").agg((F.max("y") == 1).alias("y"))
    most = rows.count()
    if not most:
        return None
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").where(~held_out("i"))
    texts = materialize(texts.join(rows, "i").groupBy("i").agg(F.max("t").alias("t"), F.max("y").alias("y")), "labelled", most, 2_000)
    n = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = _fit(texts, n[True], n[False], most) if len(n) == 2 else None
    discard(texts)
    return model


def _fit(texts: DataFrame, n_toxic: int, n_clean: int, most: int) -> Model | None:
    """A model from these texts (i, t, y), of which there are most at most."""
    counts = materialize(_word_counts(texts), "words", most, 2_000)
    often = counts.where(F.col("toxic") >= max(3, 0.01 * n_toxic)).collect()
    clean = {r.w: r.clean for r in often}
    able = _best({r.w: r.toxic for r in often}, clean, n_toxic, n_clean, None)  # a word shows in no more texts than hold it
    chosen = _best(_shown(texts.where("y"), set(able)), clean, n_toxic, n_clean, MOST_LANDMARKS) if able else {}
    model = _learn(chosen, *_near_words(counts, chosen), n_clean) if chosen else None
    discard(counts)
    if model is not None:
        model.slope, model.offset = _scale(texts, model)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), a row for each row of docs.

    Learns from labels (id, toxic) and the texts of docs alone; see fit. A text's score is that of its worst
    sentence, over the whole text. A null text is the empty one, which has no toxic sentence. Where the
    labels are missing, of one class, or no word tells them apart, every score is 0. A null id is never held
    out. Repeated rows give repeated rows; other columns are ignored; the empty table gives no rows.

    Scored in one scan without a shuffle: the model has a few dozen landmarks and goes to each task.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))
    docs = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = model.value
        for part, (texts,) in slices(batches, STRETCH, 1):
            scores = np.zeros(len(texts)) if own is None else own.scores(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    out = docs.mapInArrow(run, f"`{id_col}` {id_type}, score double")
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores less than min_score. Otherwise as score_toxicity."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        own = model.value
        for part, (texts,) in slices(batches, STRETCH, at):
            yield part if own is None else part.filter(pa.array(own.scores([t or "" for t in texts]) < min_score))

    return docs.mapInArrow(run, docs.schema)
