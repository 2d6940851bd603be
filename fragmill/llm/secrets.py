"""Secret scans: candidates by pattern, false positives removed by a random forest.

Patterns propose spans: known key formats, values assigned to telling names, and long strings that look
random. For each span the forest sees its length, how its characters follow each other, how much
of it a dictionary covers, whether it lies in a path, and the words around it. It is trained on labelled
findings: rows the caller has, or those that labelled_findings() writes from a seed, which hold keys of many
formats and what is usually mistaken for them (checksums, commit and document ids, placeholders, paths, names).

Cases: null and empty texts have no findings. Repeated rows give theirs each. A null doc_id is kept. An empty
table gives no rows. Other columns are ignored by find() and kept by redact(). Spans count characters.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Candidates: kind and pattern, the value in the last group. Formats are public and fixed.
PATTERNS = [
    ("aws-key-id", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("github-token", r"\b(gh[pousr]_[0-9A-Za-z]{30,})\b"),
    ("slack-token", r"\b(xox[abprs]-[0-9A-Za-z-]{10,})"),
    ("sk-key", r"\b(sk-[0-9A-Za-z_-]{20,})"),
    ("google-key", r"\b(AIza[0-9A-Za-z_-]{35})"),
    ("jwt", r"\b(eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})"),
    ("private-key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[0-9A-Za-z+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)"),
    ("url-password", r"\b[a-z][a-z0-9+.-]{0,30}://[^\s:/@]+:([^\s:/@]{4,})@"),
    ("assigned", r"(?i)(?:api[_-]?key|key|secret|passw(?:or)?d|pwd|token|auth|credentials?)[\"']?\s*(?:=|:|=>)\s*[\"']?([^\s\"'<>,;]{6,})"),
    ("random-string", r"(?<![0-9A-Za-z+/_-])((?=[0-9A-Za-z+/_-]*[0-9])[0-9A-Za-z+/_-]{20,}={0,2})(?![0-9A-Za-z+/_-])"),
]
#: What a text in lower case holds if a pattern can match; a random string is a long word with a digit.
HINTS = {
    "aws-key-id": ("akia", "asia"), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack-token": ("xox",), "sk-key": ("sk-",),
    "google-key": ("aiza",), "jwt": ("eyj",), "private-key": ("private key",), "url-password": ("://",),
    "assigned": ("key", "secret", "passw", "pwd", "token", "auth", "credential"),
}
_COMPILED = [(kind, re.compile(p)) for kind, p in PATTERNS]
_DIGIT = re.compile(r"[0-9]")


def hinted(text: str) -> set[str]:
    """The kinds of candidates that the text can hold; for most texts none."""
    low = text.lower()
    found = {kind for kind, hints in HINTS.items() if any(h in low for h in hints)}
    if _DIGIT.search(text) and max(map(len, text.split()), default=0) >= 20:
        found.add("random-string")
    return found


#: Words next to a secret, words next to what isn't one, and common words inside candidates (fixed values).
TELLING = frozenset("api key secret password passwd pwd token auth bearer credential credentials access private login aws github".split())
HARMLESS = frozenset("example sample test dummy placeholder your changeme sha sha1 sha256 md5 checksum hash digest commit revision uuid guid id etag version build page image file url path template default none null true false".split())
DICTIONARY = frozenset(
    """about above access account action active address after again agent alpha apple array author back base before begin beta
 block board body book build button cache call case change chapter check child class clean clear client close cloud code
 color column comment commit common config connect content context copy count create data date debug default delete
 delta demo detail device digest direct disk document domain down draft dummy edit element email enable engine enter entry
 error event example factory false field file filter final first folder format frame from front function global graph
 group hand handler hash head header hello help here home host html http image import index info input insert item
 java join json just key label large last layer layout left length level library light line link list load local log login
 long loop made mail main make manager map mask match member memory menu message method mode model module month
 mouse name network next node note null number object offset open option order other output owner pack page panel parent
 part pass password path pattern people phone picture pixel place plain player point policy port position post power
 press print private process product profile project public python query queue random range read record region release
 remote render report request reset resource response result return right role root route rule sample save scale schema
 scope score screen script search second secret section select send server service session set shape share short show
 side sign simple single size small some sort source space spec stack standard start state static status step
 stop store stream string style submit summary support switch system table target task team template term test text theme
 this thread time title token tool top total track trace tree true type under unit update upload user utils valid value
 version video view visit wait web white widget width window with word work world write your zone""".split()
)
_LONGEST = max(map(len, DICTIONARY))
_WORD = re.compile(r"[A-Za-z]{2,}")


def covered(value: str) -> float:
    """Share of the characters that the longest dictionary words from the left cover."""
    low, at, n = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(_LONGEST, len(low) - at), 2, -1):
            if low[at : at + size] in DICTIONARY:
                n, at = n + size, at + size
                break
        else:
            at += 1
    return n / max(1, len(low))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_VOWELS = frozenset("aeiouAEIOU")
FEATURES = ("length", "entropy", "classes", "class changes", "letter-vowel changes", "repeats", "digits", "hexadecimal", "dictionary", "separators", "in a path", "telling near", "harmless near", "harmless inside", "assigned", "known format", "uuid form")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")


def features(kind: str, value: str, before: str, after: str) -> list[float]:
    n = len(value)
    counts = {c: value.count(c) for c in set(value)}
    classes = [_class(c) for c in value]
    pairs = list(zip(value, value[1:], strict=False))
    near = {w.lower() for w in _WORD.findall(before[-48:])[-5:] + _WORD.findall(after[:32])[:3]}
    inside = {w.lower() for w in _WORD.findall(value)}
    return [
        n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(set(classes)),
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / max(1, n - 1),
        sum((a in _VOWELS) != (b in _VOWELS) for a, b in pairs if a.isalpha() and b.isalpha()) / max(1, n - 1),
        sum(a == b for a, b in pairs) / max(1, n - 1),
        classes.count(2) / n,
        sum(c in string.hexdigits for c in value) / n,
        covered(value),
        sum(c in "-_/.+" for c in value) / n,
        float(before[-1:] in ("/", "\\", ".") or after[:1] in ("/", "\\") or value.count("/") > 1),
        len(near & TELLING),
        len(near & HARMLESS),
        len(inside & HARMLESS),
        float(kind == "assigned" or before.rstrip(" \"'")[-1:] in ("=", ":")),
        float(kind not in ("assigned", "random-string")),
        float(bool(_UUID.fullmatch(value))),
    ]


def candidates(text: str | None) -> list[tuple[int, int, str, list[float]]]:
    """start, end, kind, features of every candidate; of spans that overlap, the one of the earlier pattern."""
    kinds = hinted(text) if text else ()
    if not kinds:
        return []
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _COMPILED:
        if kind not in kinds:
            continue
        new, k = [], 0
        for m in pattern.finditer(text):  # in ascending order, like what is taken
            start, end = m.span(1)
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if k == len(taken) or end <= taken[k][0]:
                new.append((start, end, kind))
        taken = sorted(taken + new)
    return [(s, e, kind, features(kind, text[s:e], text[max(0, s - 64) : s], text[e : e + 40])) for s, e, kind in taken]


# ---- random forest ------------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, left, right, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                low = x[np.arange(len(x)), feature[at]] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 9, leaf: int = 3, seed: int = 5) -> Forest:
    """Each tree on a bootstrap of the rows, each split the best Gini gain among a random third of the features."""
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(n_trees):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, left_depth: int, nodes: list = nodes) -> int:
            me = len(nodes)
            labels = y[rows]
            nodes.append([-1, 0.0, 0, 0, labels.mean()])
            if left_depth == 0 or len(rows) < 2 * leaf or labels.min() == labels.max():
                return me
            best = (1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], -(-x.shape[1] // 3), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows[order], f], np.cumsum(labels[order])
                k = np.arange(leaf, len(rows) - leaf + 1)
                k = k[v[k - 1] < v[k]] if len(k) and k[-1] < len(rows) else k[:-1][v[k[:-1] - 1] < v[k[:-1]]]
                if not len(k):
                    continue
                a, n, total = ones[k - 1], len(rows), ones[-1]
                gain = a**2 / k + (k - a) ** 2 / k + (total - a) ** 2 / (n - k) + (n - k - total + a) ** 2 / (n - k) - (total**2 + (n - total) ** 2) / n
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], int(f), (v[k[i] - 1] + v[k[i]]) / 2)
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[me][:2] = best[1], best[2]
                nodes[me][2] = split(rows[low], left_depth - 1)
                nodes[me][3] = split(rows[~low], left_depth - 1)
            return me

        split(rng.integers(0, len(x), len(x)), depth)
        columns = list(zip(*nodes, strict=True))
        trees.append((np.array(columns[0], int), np.array(columns[1], float), np.array(columns[2], int), np.array(columns[3], int), np.array(columns[4], float)))
    return Forest(trees)


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, int]]:
    """n texts with one finding each and whether it is a secret, written from a seed. n bounds the training."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    draw = lambda letters, size: "".join(pick(letters) for _ in range(int(size)))
    hexa, b62, b64, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
    common, syllables = sorted(DICTIONARY), ["an", "er", "th", "on", "re", "hea", "ti", "es", "or", "ción", "ung", "ent", "lich", "eux", "mente"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    words = lambda k: " ".join(word() for _ in range(k))
    name = lambda: pick(["password", "passwd", "token", "api_key", "apikey", "secret", "secret_key", "auth", "access_key", "client_secret", "db_password"])
    assign = lambda value: name() + pick(["=", " = ", ": ", "="]) + pick(["{}", '"{}"', "'{}'"]).format(value)
    secret = [
        lambda: "AKIA" + draw(upper, 16),
        lambda: "ghp_" + draw(b62, 36),
        lambda: "sk-" + draw(b62, rng.integers(24, 48)),
        lambda: "xoxb-" + draw(string.digits, 11) + "-" + draw(b62, 24),
        lambda: "AIza" + draw(b62, 35),
        lambda: "eyJ" + draw(b62, 20) + "." + draw(b62, 40) + "." + draw(b62, 43),
        lambda: assign(draw(hexa, pick([12, 16, 18, 20, 24, 32, 40, 64]))),
        lambda: assign(draw(b62, rng.integers(10, 44))),
        lambda: assign(draw(b64, 40)),
        lambda: assign(draw(b62 + "!@#$%&*", rng.integers(9, 20))),
        lambda: pick(["postgres", "mysql", "amqp"]) + "://" + pick(common) + ":" + draw(b62, rng.integers(8, 20)) + "@" + pick(common) + ".internal/db",
        lambda: pick(["key ", "secret ", "bearer ", "token "]) + draw(b62, rng.integers(28, 48)),
    ]
    harmless = [
        lambda: assign(pick(["changeme", "your_api_key_here", "<password>", "xxxxxxxxxxxx", "**********", "example", "password123example", "YOUR-TOKEN-HERE", "placeholder", "null", "undefined", "os.environ", "${TOKEN}", "{{secret}}", "my-secret-name", "REPLACE_ME", "required"])),
        lambda: assign(pick(common) + pick(["_", ".", "-", "::"]) + pick(common) + pick(["", "()", "_" + pick(common)])),
        lambda: assign(word() + word() + "."),
        lambda: pick(["sha256 ", "sha256:", "checksum ", "md5 ", "digest "]) + draw(hexa, pick([32, 40, 64])),
        lambda: pick(["commit ", "revision ", "etag ", "build "]) + draw(hexa, 40),
        lambda: pick(["uuid ", "id ", "guid=", "page id ", "token ", "key="]) + "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: "/".join(pick(common) for _ in range(4)) + "/" + draw(hexa, pick([8, 32, 40])) + "/" + pick(common) + "1",
        lambda: "-".join(pick(common) for _ in range(4)) + "-" + draw(string.digits, 4),
        lambda: "_".join(pick(common) for _ in range(4)) + draw(string.digits, 2),
        lambda: draw(string.digits, rng.integers(20, 30)),
        lambda: "https://" + pick(common) + ".example/" + "-".join(pick(common) for _ in range(4)) + "-" + draw(string.digits, 6),
        lambda: "a" * int(rng.integers(20, 40)) + "1",
        lambda: "image " + draw(hexa, 32) + ".png",
        lambda: pick(["key: ", "token: ", "auth: "]) + word() + word() + word(),
        lambda: "".join(pick(common).capitalize() for _ in range(5)) + "2",
    ]
    out = []
    for k in range(n):
        label = int(k % 2 == 0)
        # Telling and harmless words also stand near by chance.
        aside = pick(["", "", "", "", "see example.com of.", f"on page {int(rng.integers(99))}.", "a file is", "license key", "of this test"])
        text = f"{words(3)} {aside} {words(1)} {pick(secret if label else harmless)()} {words(4)}."
        out.append((text, label))
    return out


@lru_cache(maxsize=4)
def trained(n: int = 2400, seed: int = 11) -> Forest:
    """The forest of the written findings."""
    return train(labelled_findings(n, seed))


def train(findings: list[tuple[str, int]]) -> Forest:
    """findings: texts with the label that holds for their candidates. At most as many rows as the caller bounds."""
    rows = [(f, label) for text, label in findings for *_, f in candidates(text)]
    return grow(np.array([f for f, _ in rows], float), np.array([label for _, label in rows], float))


# ---- over documents -----------------------------------------------------------------------------


def secrets_in(text: str | None, forest: Forest, threshold: float = 0.5) -> list[tuple[int, int, str, float]]:
    """start, end, kind, score of what the forest takes for secrets."""
    found = candidates(text)
    if not found:
        return []
    scores = forest.score(np.array([f for *_, f in found], float))
    return [(s, e, kind, float(p)) for (s, e, kind, _), p in zip(found, scores, strict=True) if p >= threshold]


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("secret", pa.string()), ("score", pa.float64())])


def find(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per secret in (doc_id, text): doc_id, start, end, kind, secret, score."""
    forest = forest or trained()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(doc, s, e, kind, text[s:e], p) for s, e, kind, p in secrets_in(text, forest, threshold)]
            columns = list(zip(*rows, strict=True)) or [()] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.types, strict=True)], schema=_FOUND)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, end long, kind string, secret string, score double")


def redacted(text: str, forest: Forest, mark: str = "[secret]", threshold: float = 0.5) -> str:
    for s, e, _, _ in reversed(secrets_in(text, forest, threshold)):
        text = text[:s] + mark + text[e:]
    return text


def redact(docs: DataFrame, forest: Forest | None = None, mark: str = "[secret]", threshold: float = 0.5) -> DataFrame:
    """docs with their secrets replaced by mark in text, all other columns and all rows as they were; n_chars, where there is one, follows the text."""
    forest = forest or trained()
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, forest, mark, threshold) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op5_secret_scan(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))
