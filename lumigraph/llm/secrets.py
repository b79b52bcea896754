"""Secret scans: broad patterns find candidates, a random forest takes false positives away."""

from __future__ import annotations

import json
import random
import re
import string
from bisect import bisect_left
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Openings of keys that services hand out, and how they go on.
SERVICE_KEYS = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "web_token": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}",
}
# Parts of names that secrets are assigned to.
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "auth", "credential", "private_key")
# Words of placeholders, and words beside or in the paths of what only looks like a secret.
PLAIN_WORDS = ("example", "sample", "test", "dummy", "changeme", "change", "placeholder", "your", "here", "none", "null", "true", "false", "password", "secret", "token", "default", "user", "admin", "value", "string", "get", "env", "config", "settings", "xxxx", "todo", "insert", "redacted", "hidden", "with", "and", "the", "for", "name", "key", "file", "data", "index", "main", "src", "static", "assets", "image", "version")
BESIDE_NO = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "guid", "version", "revision", "etag", "integrity", "id", "example")
PATH_NO = ("test", "example", "sample", "fixture", "mock", "doc", "lock")

# The lines that private keys stand between.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----\s*([A-Za-z0-9+/=\s:,.-]*?)\s*(?:-----END \1-----|(?=-----)|\Z|(?![A-Za-z0-9+/=\s:,.-]))")
_SERVICE = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SERVICE_KEYS.items()))
_SERVICE_START = re.compile("AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|[rs]k_(?:live|test)_|eyJ")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_NAME = re.compile(r"([A-Za-z_][\w.-]*)[\"']?\s{0,4}$")
_VALUE = re.compile(r"\s{0,4}[\"']?([^\s\"'<>,;]{6,})")
_WORD = re.compile(r"[^\W\d_]{3,}")
_AROUND = 64
LEAST_WORD, MOST_WORD = 4, 14
# So many characters into an assigned value, a service key or another assignment is a place of its own and ends the value.
_OWN_PLACE = 512


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what may be a secret, in order; of overlapping ones the first kind in the order private key, service key, assigned value, long string.

    A private key reaches from its opening line to its closing one, or where that is missing to the end of what can be part of it."""
    found, assigned, places = [], [], []
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), m.end(), "private_key") for m in _PEM.finditer(text)]
    for m in _SERVICE_START.finditer(text):
        if k := _SERVICE.match(text, m.start()):
            if not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
                found.append((k.start(), k.end(), k.lastgroup))
                places.append((k.start(), k.start()))
    for mark in "=:":
        at, end = text.find(mark), 0
        while at >= 0:
            name = _NAME.search(text, max(0, at - 80), at)
            if name and any(x in name[1].lower() for x in SECRET_NAMES):
                if at + 1 < end:  # within the value before, which ends where this one does
                    a = at + 1 if end - at > 6 else None
                else:
                    v = _VALUE.match(text, at + 1)
                    a, end = v.span(1) if v else (None, end)
                if a is not None:
                    assigned.append((a, end))
                    places.append((a, name.start(1)))
            at = text.find(mark, at + 1)
    places.sort()
    for a, b in assigned:
        i = bisect_left(places, (a + _OWN_PLACE,))
        found.append((a, max(a + _OWN_PLACE, places[i][1]) if i < len(places) and places[i][0] < b else b, "assigned"))
    for m in _LONG.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            found.append((m.start(), m.end(), "long_string"))
    out: list[tuple[int, int, str]] = []  # in order and apart, so only the neighbours of a place can overlap it
    rank = {"private_key": -1, "assigned": 1, "long_string": 2}
    for f in sorted(found, key=lambda x: (rank.get(x[2], 0), x)):
        i = bisect_left(out, f)
        if (not i or out[i - 1][1] <= f[0]) and (i == len(out) or f[1] <= out[i][0]):
            out.insert(i, f)
    return out


@cache
def dictionary(path: str | None = None) -> frozenset[str]:
    """Words of LEAST_WORD to MOST_WORD letters: the whole words of a public vocabulary file (by default word_bpe_49k.json)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    words = (w.removesuffix(suffix).lower() for w in model["vocab"] if w.endswith(suffix))
    return frozenset(w for w in words if LEAST_WORD <= len(w) <= MOST_WORD and w.isalpha() and w.isascii())


def word_share(low: str) -> float:
    """The share of a lower-case string that words of the dictionary cover, the longest first from each place on."""
    words, at, covered = dictionary(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(MOST_WORD, len(low) - at), LEAST_WORD - 1, -1) if low[at : at + n] in words), 0)
        covered += n
        at += n or 1
    return covered / max(1, len(low))


def _kind(c: str) -> int:
    """Lower case, upper case, digit, other."""
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(value: str, before: str, after: str, path: str) -> np.ndarray:
    """Length, character kinds and transitions, entropy, dictionary coverage, shape, neighbouring words and path, as numbers."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    shares = [kinds.count(k) / n for k in range(4)]
    steps = np.zeros((4, 4))
    for a, b in pairwise(kinds):
        steps[a, b] += 1
    p = np.array([value.count(c) for c in set(value)]) / n
    low = value.lower()
    covered = np.zeros(n, bool)
    for w in PLAIN_WORDS:
        at = low.find(w)
        while at >= 0:
            covered[at : at + len(w)] = True
            at = low.find(w, at + 1)
    runs = [len(r) for r in re.findall(r"[A-Za-z]+", value)]
    vowels = sum(c in "aeiou" for c in low) / max(1, sum(c.isalpha() for c in low))
    left, right = (x.lower() for x in (before, after))
    near = set(re.findall(r"[a-z0-9_]+", left[-32:])) | set(_WORD.findall(right[:24]))
    return np.array([
        n, *shares, *(steps / max(1, n - 1)).ravel(), -(p * np.log2(p)).sum(), len(set(low)) / n, covered.mean(), word_share(low), max(runs, default=0) / n, vowels,
        all(c in string.hexdigits for c in value), value.count("/") + value.count("."), value.count("-"), any(c in value for c in "()[]{}$%<>*"),
        bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value)), any(x in left[-40:] for x in SECRET_NAMES), bool(_SERVICE.fullmatch(value)), bool(_PEM.fullmatch(value)),
        any(w in near for w in BESIDE_NO), left.rstrip(" \"'").endswith(("=", ":")), any(x in path.lower() for x in PATH_NO),
    ], np.float64)


class Forest:
    """Trees on bootstrap samples, each split the best by Gini of a random few of the features."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 12, seed: int = 0) -> Forest:
        rng, out = np.random.RandomState(seed), []
        few = max(1, int(np.sqrt(x.shape[1])) + 1)
        for _ in range(trees):
            rows = rng.randint(0, len(x), len(x))
            nodes: list[list[float]] = []  # feature, threshold, left, right, share of label 1

            def grow(rows, level, rng=rng, nodes=nodes) -> int:
                me, share = len(nodes), float(y[rows].mean())
                nodes.append([-1, 0.0, 0, 0, share])
                if level == depth or len(rows) < 4 or share in (0.0, 1.0):
                    return me
                best = (np.inf, -1, 0.0)
                for f in rng.choice(x.shape[1], few, replace=False):
                    order = np.argsort(x[rows, f], kind="stable")
                    v, ones = x[rows[order], f], np.cumsum(y[rows[order]])
                    cut = np.flatnonzero(v[1:] > v[:-1])
                    if not len(cut):
                        continue
                    n1, k1 = cut + 1.0, ones[cut]
                    n2, k2 = len(rows) - n1, ones[-1] - k1
                    gini = k1 * (1 - k1 / n1) + k2 * (1 - k2 / n2)
                    i = int(gini.argmin())
                    if gini[i] < best[0]:
                        best = (gini[i], f, (v[cut[i]] + v[cut[i] + 1]) / 2)
                if best[1] < 0:
                    return me
                below = x[rows, best[1]] <= best[2]
                a, b = grow(rows[below], level + 1), grow(rows[~below], level + 1)
                nodes[me][:4] = [best[1], best[2], a, b]
                return me

            grow(rows, 0)
            t = np.array(nodes)
            out.append((t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4]))
        return cls(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The mean of the trees' shares of label 1."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                below = x[i, feature[at[i]]] <= threshold[at[i]]
                at[i] = np.where(below, left[at[i]], right[at[i]])
            total += share[at]
        return total / len(self.trees)


def labelled_findings(n: int = 4000, seed: int = 0) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label): findings as reviewers label them, made by rule where none are at hand.

    Keys, hex and base64 strings and passwords beside names of secrets are secrets; checksums, ids,
    identifiers, paths, placeholders, references and calls are not, whatever stands beside them.
    """
    rng = random.Random(seed)
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    syllables = ["an", "er", "th", "in", "re", "on", "at", "es", "or", "ti", "ed", "le", "ung", "ein", "que", "ción", "ment"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 6)))
    case = lambda s: s.upper() if rng.random() < 0.15 else s
    common, out = sorted(dictionary()), []
    for _ in range(n):
        label = rng.random() < 0.5
        name = rng.choice(SECRET_NAMES)
        equals = rng.choice(["=", " = ", ": ", "='", ' = "', '="'])
        before, after, path = f"{prose()} {case(name)}{equals}", f"\" {prose()}", rng.choice(["", "src7", "src/app.py", "deploy.env", "web/config.yml"])
        if label:
            what = rng.randrange(7)
            if what == 6:
                kind = rng.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY"
                lines = [pick(b64, 64) for _ in range(rng.randint(2, 25))] + [pick(b64, rng.randint(8, 60)) + "="]
                value, before = f"-----BEGIN {kind}-----\n" + "\n".join(lines) + f"\n-----END {kind}-----", rng.choice(["", f"{prose()}\n", before])
            elif what == 0:
                value, before = rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16), f"{prose()} "
            elif what == 1:
                value, before = rng.choice(["ghp_" + pick(alnum, 36), "AIza" + pick(alnum, 35), "sk_live_" + pick(alnum, 24), "xoxb-" + pick(alnum, 24)]), rng.choice([before, f"{prose()} "])
            elif what == 2:
                value = case(pick(hexes, rng.choice([16, 18, 20, 24, 32, 40, 48, 64])))
            elif what == 3:
                value = pick(alnum, rng.randint(12, 40))
            elif what == 4:
                value = pick(b64, rng.randint(20, 60)) + rng.choice(["", "=", "=="])
            else:
                value = pick(alnum + "!@#^&", rng.randint(8, 16))
        else:
            what = rng.randrange(10)
            beside = f"{prose()} {rng.choice(BESIDE_NO)}{rng.choice([' ', ': ', '='])}"
            if what == 0:
                value, before = pick(hexes, rng.choice([32, 40, 64])), beside
            elif what == 1:
                value, before = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), rng.choice([beside, f"{prose()} ", before])
            elif what == 2:
                value = rng.choice(["changeme", "your_password_here", "example", "xxxxxxxx", "password123", "None", "<token>", "dummy-secret", "redacted", "test_token_1"])
            elif what == 3:
                value = rng.choice(["get_token()", "os.environ['KEY']", "${DB_PASSWORD}", "settings.secret_key", "self.token", "config.get('pwd')", "{{api_key}}", "$TOKEN"])
            elif what == 4:
                value, before = "/".join(word() for _ in range(rng.randint(3, 6))) + f"/{word()}{rng.randint(1, 99)}", f"{prose()} "
            elif what == 5:
                value, before = "_".join(word() for _ in range(rng.randint(3, 6))) + f"_v{rng.randint(1, 20)}", f"{prose()} "
            elif what == 8:
                value = rng.choice(["_", "-", "", "."]).join(rng.sample(common, rng.randint(2, 4))) + rng.choice(["", "1", "_2", "123"])
            elif what == 9:
                value, before = rng.choice(["_", "/", "-"]).join(rng.sample(common, rng.randint(3, 7))) + rng.choice(["", "2", "_v3"]), f"{prose()} "
            elif what == 6:
                value, before = "".join(word().title() for _ in range(rng.randint(4, 8))) + str(rng.randint(1, 2030)), f"{prose()} "
            else:
                value, before, path = pick(hexes, 32), rng.choice([before, beside]), rng.choice(["tests/fixtures/a.json", "docs/example.md", "package-lock.json"])
        out.append((value, before, after, path, int(label)))
    return out


@cache
def default_forest() -> Forest:
    rows = labelled_findings()
    return Forest.fit(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows]))


def fit_forest(findings: DataFrame, max_rows: int = 20_000) -> Forest:
    """Trains on labelled findings (value, before, after, path, label): the max_rows whose values hash lowest; nulls are left out."""
    rows = findings.select("value", "before", "after", "path", "label").dropna().where("value <> ''").orderBy(F.xxhash64("value", "before"), "value", "before", "after", "path", "label").limit(max_rows).collect()
    return Forest.fit(np.array([features(*r[:4]) for r in rows]), np.array([int(r[4]) for r in rows]))


def find_secrets(docs: DataFrame, forest: Forest | None = None, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, start, end, kind, finding, finding_hash, score) of the secrets in each text.

    start and end count code points. Whole texts are read; each place is found once, repeated rows repeat
    theirs. Null and empty texts have none; a null path is the empty one. finding is the secret itself;
    finding_hash (64-bit hex) tells equal ones without it. Other columns are ignored; the empty table gives
    no rows. One scan without a shuffle; the forest goes to each task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    docs = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("t"), path.alias("p")).where("t is not null")

    def run(batches):
        for batch in batches:
            rows, xs = [], []
            for i, (text, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for a, b, kind in candidates(text):
                    rows.append((i, a, b, kind, text[a:b]))
                    xs.append(features(text[a:b], text[max(0, a - _AROUND) : a], text[b : b + _AROUND], p))
            scores = shared.value.score(np.array(xs)) if xs else np.zeros(0)
            kept = [(*r, s) for r, s in zip(rows, scores.tolist(), strict=True) if s >= min_score]
            ids = batch.column(0).take(pa.array([k[0] for k in kept], pa.int64()))
            columns = [pa.array([k[j] for k in kept], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.string()))]
            yield pa.RecordBatch.from_arrays([ids, *columns, pa.array([xxhash.xxh3_64_hexdigest(k[4]) for k in kept], pa.string()), pa.array([k[5] for k in kept], pa.float64())], [id_col, "start", "end", "kind", "finding", "finding_hash", "score"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start bigint, end bigint, kind string, finding string, finding_hash string, score double")
