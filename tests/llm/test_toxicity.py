"""The label model on simulated voters of known rates; the query's cases."""

import numpy as np
import pytest

from fragmill.llm import toxicity


def simulated(rng, n=100_000, voters=24, prior=0.08):
    """Votes on n documents by voters of planted rates; the last voter copies the one before it nearly always."""
    y = rng.random(n) < prior
    a, b = rng.uniform(0.1, 0.6, voters), rng.uniform(0.001, 0.03, voters)
    votes = rng.random((n, voters)) < np.where(y[:, None], a, b)
    copied = rng.random(n) < 0.9
    votes[:, -1] = np.where(copied, votes[:, -2], votes[:, -1])
    return y, votes.astype(float)


def test_rates_recover_from_wrong_starts():
    """Starting rates that are wrong by up to half, as from forty toxic rows, end near the planted ones."""
    rng = np.random.default_rng(7)
    y, votes = simulated(rng)
    true = np.array([votes[y].mean(axis=0), votes[~y].mean(axis=0)])
    wrong = np.clip(true * np.exp(rng.uniform(-0.5, 0.5, true.shape)), 1e-5, 0.95)
    model = toxicity.fit_label_model(len(y), votes.sum(axis=0), votes.T @ votes, float(y.mean()), wrong, (40.0, 460.0))
    error = lambda rates: np.abs(rates[0] / true[0] - 1)[:-2].mean()
    assert error(wrong) > 0.2 and error([model.on_toxic]) < 0.07
    pairs = np.argwhere(model.correlated > toxicity.CORRELATED)
    assert {tuple(p) for p in pairs.tolist()} == {(22, 23), (23, 22)} and model.weight[-1] < 0.7 and model.weight[0] == 1
    posterior = model.posterior(votes)
    order = np.argsort(posterior, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    auc = (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    assert auc > 0.97


def test_a_lone_voter_keeps_its_rates():
    """No other voter votes with it, so only the sample tells its rates."""
    rng = np.random.default_rng(8)
    y, votes = simulated(rng, 20_000)
    votes = np.column_stack([votes, np.zeros(len(y))])
    votes[rng.permutation(np.flatnonzero(votes.sum(axis=1) == 0))[:400], -1] = 1
    start = np.array([np.r_[votes[y].mean(axis=0)[:-1], 0.2], np.r_[votes[~y].mean(axis=0)[:-1], 0.004]])
    model = toxicity.fit_label_model(len(y), votes.sum(axis=0), votes.T @ votes, float(y.mean()), start, (200.0, 2000.0))
    assert 0.05 < model.on_toxic[-1] <= 0.3 and model.on_toxic[-1] > 3 * model.on_clean[-1]


def test_empty_tables_and_odd_rows(spark):
    docs = spark.createDataFrame([(k, "good words here " * 5 + ("vile vile vilest" if k % 4 == 0 else ""), 1, "x") for k in range(400)] + [(None, "vile vile vilest", 1, "x"), (1, "good words", 1, "x"), (1000, None, 1, "x"), (1001, "", 1, "x")], "doc_id long, text string, score int, toxic string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(400)] + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()).select("doc_id", "toxic"))
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()]
    assert len(got) == 404 and all((s >= 0.5) == (d is None or (d % 4 == 0 and d < 400)) for d, s in got)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 303
    none = docs.where("false")
    assert toxicity.learn(none, labels).score("anything") < 0.5 and toxicity.learn(docs, labels.where("false")).score("vile") < 0.5
    assert toxicity.score(none, model).count() == 0 and toxicity.accepted(none, model).count() == 0


def test_the_samples_characters_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 2000)
    docs = spark.createDataFrame([(k, ("fine " * 9 + "awful " * (k % 2) * 4)) for k in range(100)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(toxicity, "mine", lambda rows: seen.append(sum(len(t) for t, _ in rows)) or toxicity.Voters([b"awful"], []))
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert seen and 1000 < seen[0] <= 2000 and model.score("awful") == pytest.approx(model.score("awful"))
