"""Toxicity by weak supervision.

1. Voters. From a bounded sample of labelled rows: words and word stems far more frequent in toxic texts,
   by likelihood ratio; and fixed patterns of style. Each votes for "toxic" or abstains.
2. Generative label model. From how often voters vote and vote together over all documents (two
   small sums, not rows) it estimates each voter's rates of voting on toxic and on other texts, and
   which pairs are correlated beyond that; correlated voters share their weight. The sample's rates are where it starts,
   and weigh as much as so few rows can tell.
3. Linear classifier. Logistic regression on the votes, trained on the label model's posteriors of the sample.

Labels are learned from rows that the caller passes; ids, languages and sources are never inputs. Cases: null and
empty texts get the score of a text without votes. Repeated rows are scored each. A null doc_id is kept and never learned
from. No labels at all: no lexicon, every text gets the score of a text without votes, below 0.5. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Labelled rows that voters are mined from and the classifier is trained on, at most.
SAMPLE = 8000
#: Characters of the sample's texts, at most: rows beyond are left out, in the order of a hash.
SAMPLE_CHARS = 1 << 27
#: Terms at most; bytes of stems; least log-likelihood ratio and precision of a term.
MAX_TERMS, STEMS, LEAST_LLR, LEAST_PRECISION = 40, (4, 5, 6, 7, 8), 20.0, 0.9
#: Sweeps of the label model between looks for correlated pairs; documents that a moment counts for at most, since no
#: corpus follows the model exactly; correlation beyond the model's from which a pair is set aside.
SWEEPS, MOST_DOCUMENTS, CORRELATED = 60, 1_000_000, 0.25
#: Shares of a text's words that begin with a stem, for its two voters.
SOME, MANY = 0.003, 0.005

_SEPARATORS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    """Lower case, every separator a space, a space at both ends."""
    return b" %b " % (text or "").lower().encode().translate(_SEPARATORS)


def pattern_votes(text: str | None) -> list[bool]:
    """Style voters: mostly capitals; many exclamation marks; a repeated insult-like address."""
    text = text or ""
    n = max(1, len(text))
    letters = sum(map(text.count, "EAIONT")) + 1
    small = sum(map(text.count, "eaiont")) + 1
    return [n > 40 and letters > 2 * small, text.count("!") > 0.01 * n, text.count("you") > 0.01 * n]


N_PATTERNS = 3


@dataclass
class Voters:
    """words vote where they occur. A stem has two voters, for some and for many words that begin with it."""

    words: list[bytes]
    stems: list[bytes]

    def __len__(self) -> int:
        return len(self.words) + 2 * len(self.stems) + N_PATTERNS

    def votes(self, text: str | None) -> np.ndarray:
        t = folded(text)
        n = len(t.split())
        out = [b" %b " % w in t for w in self.words]
        for s in self.stems:
            out += stem_votes(t.count(b" " + s), n)
        return np.array(out + pattern_votes(text), float)


def stem_votes(count: int, n_words: int) -> list[bool]:
    """Among some hundred words one may begin like this by chance, but not one in a hundred."""
    return [count >= max(1, SOME * n_words), count >= max(2, MANY * n_words)]


def _llr(k: int, n: int, k0: int, n0: int) -> float:
    """Twice the log-likelihood ratio that a term's rates differ, for terms more frequent in the first group."""
    if k * n0 <= k0 * n:
        return 0.0
    h = lambda a, b: a * math.log(a / b) if a else 0.0
    p = (k + k0) / (n + n0)
    return 2 * (h(k, n * p) + h(n - k, n * (1 - p)) + h(k0, n0 * p) + h(n0 - k0, n0 * (1 - p)))


def mine(sample: list[tuple[str, int]]) -> Voters:
    """The words and stems that set toxic texts apart. Of terms that begin alike the best is taken, and none whose texts are covered."""
    n = sum(t for _, t in sample)
    n0 = len(sample) - n
    toxic, clean, where = Counter(), Counter(), {}
    for k, (text, label) in enumerate(sample):
        words = folded(text).split()
        terms = {(0, w) for w in words}
        for m in STEMS:
            terms |= {(m, s) for s, c in Counter(w[:m] for w in words if len(w) > m).items() if stem_votes(c, len(words))[1]}
        (toxic if label else clean).update(terms)
        if label:
            for t in terms:
                where.setdefault(t, []).append(k)
    scored = [(_llr(k, n, clean[t], n0), t) for t, k in toxic.items() if k >= 3 and k >= LEAST_PRECISION * (k + clean[t])]
    least = max(LEAST_LLR, 3 * math.log(max(2, len(toxic))))  # the more terms, the more of them look toxic by chance
    ranked = sorted((x for x in scored if x[0] >= least), key=lambda x: (-x[0], -x[1][0], x[1][1]))
    covered, taken = Counter(), []
    for _, t in ranked:
        if len(taken) == MAX_TERMS:
            break
        of_a_family = any(t[1].startswith(w) or w.startswith(t[1]) for _, w in taken)
        if not of_a_family and sum(covered[k] < 3 for k in where[t]) >= 0.05 * len(where[t]):
            taken.append(t)
            covered.update(where[t])
    return Voters([w for m, w in taken if not m], [w for m, w in taken if m])


@dataclass
class LabelModel:
    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    weight: np.ndarray
    correlated: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """A voter that abstains says nothing: few texts have any one word."""
        yes = np.log(self.on_toxic / self.on_clean)
        logit = math.log(self.prior / (1 - self.prior)) + votes @ (yes * self.weight)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(n: int, sums: np.ndarray, together: np.ndarray, prior: float, start: np.ndarray, support: tuple[float, float]) -> LabelModel:
    """From n documents' votes: sums of each voter and of each pair.

    Rates of voting on toxic (a) and on other texts (b) fit the single and the joint frequencies,
    P(i, j) = p a_i a_j + (1 - p) b_i b_j: a voter's two rates are a least-squares solution given all others', each frequency
    weighted by its sampling error, and sweeps go over the voters until they settle. start: the rates in the labelled
    sample, on toxic and on other texts, of `support` rows each; they weigh as much as a sample of that size can tell, so
    that many documents outweigh them, and a voter that meets no other (a lone one of a language) keeps them.
    Pairs that don't fit (voters of one stem) are set aside as correlated and the rates fitted again. prior: the
    share of toxic texts, if no voter tells the classes apart.
    """
    size = len(sums)
    m, joint = sums / n, together / n
    # The sample's share of toxic texts need not be the corpus's: the voters' frequencies tell that.
    apart = (start[0] - start[1]).sum()
    if apart > 0:
        prior = float(np.clip((m - start[1]).sum() / apart, 0.005, 0.5))
    counted = min(n, MOST_DOCUMENTS)
    spread = lambda x, k: (np.maximum(x * (1 - x), 1 / (k + 1))) / max(k, 1.0)
    anchors, held = start, [spread(rate, k) for rate, k in zip(start, support, strict=True)]
    a, b = (np.clip(x, 1e-6, 0.999) for x in start)
    off = ~np.eye(size, dtype=bool)
    # Voters for one class meet more often than by chance, whatever their rates. Those that don't, as of two languages, tell
    # nothing of each other.
    off &= joint > np.outer(m, m)
    free = off.copy()
    weight, single = 1 / spread(joint, counted), 1 / spread(m, counted)
    for _ in range(3):
        for _ in range(SWEEPS):
            before = a.copy()
            for i in range(size):
                x, y, w = prior * a, (1 - prior) * b, np.where(free[i], weight[i], 0.0)
                xx = (w * x * x).sum() + single[i] * prior**2 + 1 / held[0][i]
                yy = (w * y * y).sum() + single[i] * (1 - prior) ** 2 + 1 / held[1][i]
                xy = (w * x * y).sum() + single[i] * prior * (1 - prior)
                u = (w * x * joint[i]).sum() + single[i] * prior * m[i] + anchors[0][i] / held[0][i]
                v = (w * y * joint[i]).sum() + single[i] * (1 - prior) * m[i] + anchors[1][i] / held[1][i]
                det = xx * yy - xy * xy
                a[i] = np.clip((u * yy - v * xy) / det, 1e-6, 0.999)
                b[i] = np.clip((v * xx - u * xy) / det, 1e-6, 0.999)
            if np.abs(a - before).max(initial=0.0) < 1e-6:
                break
        left = joint - prior * np.outer(a, a) - (1 - prior) * np.outer(b, b)
        deviation = np.sqrt(np.outer(m * (1 - m), m * (1 - m))) + 1e-9
        free = off & (np.abs(left / deviation) < CORRELATED)
    correlation = np.where(off, left / deviation, 0)
    shared = 1 / (1 + np.where(correlation > CORRELATED, correlation, 0).sum(axis=1))
    return LabelModel(prior, np.maximum(a, 1.0001 * b), b, shared, correlation)


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton's steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], l2), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    voters: Voters
    labels: LabelModel | None
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-float(np.clip(self.voters.votes(text) @ self.weights + self.bias, -30, 30))))


def moments(docs: DataFrame, voters: Voters) -> tuple[int, np.ndarray, np.ndarray]:
    """Over all documents: their number, and sums of votes and of pairs of votes."""
    size = len(voters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = np.zeros((size, size))
        n = 0
        for batch in batches:
            v = np.array([voters.votes(t) for t in batch.column("text").to_pylist()]).reshape(-1, size)
            pair += v.T @ v
            n += len(v)
        rows, columns = np.nonzero(pair)
        at = np.r_[-1, rows * size + columns]
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(np.r_[n, pair[rows, columns]], pa.float64())})

    # One row per pair of voters at most, whatever the corpus.
    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total, pair = 0, np.zeros(size * size)
    for row in got:
        if row.at < 0:
            total = int(row.n)
        else:
            pair[row.at] = row.n
    pair = pair.reshape(size, size)
    return total, np.diag(pair).copy(), pair


def learn(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labelled: doc_id, toxic (0/1) of the rows to learn from; of them `sample` at most, by hash."""
    marks = labelled.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, 0.95 * sample / max(1, marks.count()))
    some = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())
    chosen = texts.join(F.broadcast(some.limit(sample)), "doc_id").limit(sample)
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = [(r.text, r.toxic) for r in chosen.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_CHARS).select("text", "toxic").collect()]
    if not 0 < sum(t for _, t in rows) < len(rows):
        return Model(Voters([], []), None, np.zeros(N_PATTERNS), -2.0)
    voters = mine(rows)
    votes, y = np.array([voters.votes(t) for t, _ in rows]), np.array([t for _, t in rows], float)
    prior = float(np.clip(y.mean(), 0.01, 0.5))
    start = np.array([(votes[y == c].sum(axis=0) + 0.01) / ((y == c).sum() + 1) for c in (1, 0)])
    start = np.maximum(start, 1e-5)
    n, sums, together = moments(docs, voters)
    model = fit_label_model(max(1, n), sums, together, prior, start, (y.sum(), len(y) - y.sum()))
    weights, bias = fit_linear(votes, model.posterior(votes))
    return Model(voters, model, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id long, score double of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([model.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), got], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without those whose score reaches the threshold, all columns as they were.

    Cases: null and empty texts stay. Repeated rows stay or go together. Rows without a doc_id are judged like others. An
    empty table stays empty. Other columns, whatever their names, are carried along.
    """
    names = docs.columns
    at = names.index("text")
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(t) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
