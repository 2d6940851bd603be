"""The near-duplicate stage against exact Jaccard similarity, pair by pair."""

import itertools
import random

import pytest

from fragmill.llm import near


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def exact_groups(texts):
    sets, up = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(x) for x in range(len(texts))]


def word(rng):
    return "".join(rng.choices("abcdefghij", k=6))


def prose(rng, n):
    return [word(rng) for _ in range(n)]


def around(rng):
    """Pairs with similarities on both sides of 0.8: scattered edits, cut tails, inserted passages, short texts."""
    texts = []
    for n in (12, 60, 200, 400):
        for share in (0.70, 0.76, 0.79, 0.80, 0.81, 0.84, 0.90):
            w = prose(rng, n)
            texts += [w, w[: 4 + round(share * (n - 4))]]
            w = prose(rng, n)
            at = rng.randrange(n)
            texts += [w, w[:at] + prose(rng, round((1 / share - 1) * n)) + w[at:]]
            w = prose(rng, n)
            edited = list(w)
            for at in rng.sample(range(n), max(1, round(n * (1 - share) / (1 + share) / 5))):
                edited[at] = word(rng)
            texts += [w, edited]
    for n in range(1, 14):
        w = prose(rng, n)
        texts += [w, w + prose(rng, 1), prose(rng, 1) + w]
    return [" ".join(w) for w in texts]


def hot(rng):
    """Many texts around two passages: near copies, chains at the threshold, and texts that only share the passage."""
    base, passage = prose(rng, 100), prose(rng, 60)
    texts = []
    for k in range(70):
        w = list(base)
        for at in rng.sample(range(100), k % 4):
            w[at] = word(rng)
        texts.append(w)
    texts += [base[k:] + prose(rng, k) for k in range(0, 60, 3)]
    texts += [passage + prose(rng, k % 40) for k in range(60)]
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("spread,sample", [(2048, 10_000), (10, 10_000), (10, 20)])
def test_near_groups_are_the_exact_ones(spark, monkeypatch, spread, sample):
    monkeypatch.setattr(near, "SPREAD", spread)
    monkeypatch.setattr(near, "SAMPLE", sample)
    rng = random.Random(11)
    texts = around(rng) + hot(rng) + ["", None, " \n"]
    got = {r.doc_id: r.component_id for r in near.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=16).collect()}
    want = exact_groups(texts)
    assert got == dict(enumerate(want))
    assert sum(k != g for k, g in enumerate(want)) > 50


def test_nine_words_of_which_eight_are_anothers_link(spark):
    rng = random.Random(5)
    rows = []
    for k in range(100):
        w = prose(rng, 9)
        rows += [(2 * k, " ".join(w[:8])), (2 * k + 1, " ".join(w))]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.deduplicated(rows).collect()) == list(range(0, 200, 2))


def test_the_two_rounds_leave_no_pair_out():
    import numpy as np

    rng = np.random.default_rng(3)
    g = np.sort(rng.integers(0, 4, 200))
    node, sl = rng.permutation(200), (np.full(200, 10) << 32) + rng.integers(1, 11, 200)
    order = np.lexsort((node, g))
    g, node, sl = g[order], node[order], sl[order]
    found = [b for b in near.first_round(g, node, sl, g, np.zeros(200, np.int8), 4, 5)]
    assert sorted(found[1].column("y").to_pylist()) == sorted(node.tolist())
    label = np.where(node % 3 == 0, 0, node)
    for x in range(4):
        at = g == x
        pairs = {tuple(p) for both in near.second_round(node[at], sl[at], label[at], 4, 5) for p in both.tolist()}
        rows = list(zip(node[at].tolist(), sl[at].tolist(), label[at].tolist(), strict=True))
        want = {(min(a, b), max(a, b)) for (a, s, i), (b, t, j) in itertools.combinations(rows, 2) if i != j and min(s, t) % (1 << 32) * 9 >= 80}
        assert pairs == want


def test_rows_of_one_id_go_their_own_ways(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(prose(rng, 40)) for _ in range(4))
    rows = [(1, a), (2, b), (2, a + " x"), (3, c), (3, d), (4, d), (5, c), (5, c), (None, a), (None, "alone"), (None, "alone"), (6, "twice"), (6, "twice")]
    got = near.deduplicated(spark.createDataFrame([(x, y, 1) for x, y in rows], "doc_id long, text string, node int"))
    assert got.columns == ["doc_id", "text", "node"]
    want = [(1, a), (2, b), (3, c), (3, d), (6, "twice"), (None, "alone")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert near.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counts_never_exceed_the_difference():
    rng = random.Random(8)
    for n in (3, 300, 3000):
        a = near.shingles(" ".join(prose(rng, n)).encode())
        b = near.shingles(" ".join(prose(rng, n)).encode())
        x, y = near.counts(a).astype(int), near.counts(b).astype(int)
        assert abs(x - y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))
        assert not abs(x - near.counts(a).astype(int)).sum()


def edited(rng, base, edits):
    w = list(base)
    for at in rng.sample(range(len(base)), edits):
        w[at] = word(rng)
    return " ".join(w)


def test_no_table_holds_a_row_for_each_pair_of_a_group(spark, monkeypatch):
    """Copies of one text that are a little too far apart to link: all must be compared, none travels once for each other."""
    rng, n, sizes = random.Random(12), 200, []
    base = prose(rng, 250)
    texts = [edited(rng, base, 5) for _ in range(n)]
    plain = near.written

    def counted(df, label):
        out = plain(df, label)
        sizes.append((out.count(), label))
        return out

    monkeypatch.setattr(near, "written", counted)
    got = {r.doc_id: r.component_id for r in near.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = exact_groups(texts)
    assert got == dict(enumerate(want)) and len(set(want)) > n / 2
    held = {"near-found", "near-tokens"}  # a row a text and shingle
    assert max(x for x in sizes if x[1] not in held)[0] <= 4 * n


@pytest.mark.parametrize("rows,size", [(3, 1 << 24), (10_000, 4096)])
def test_clusters_in_blocks_give_the_same_groups(spark, monkeypatch, rows, size):
    monkeypatch.setattr(near, "PRINT_BLOCK", rows)
    monkeypatch.setattr(near, "SET_BLOCK", rows)
    monkeypatch.setattr(near, "BLOCK_BYTES", size)
    rng = random.Random(13)
    base = prose(rng, 150)
    texts = [edited(rng, base, k % 5) for k in range(60)] + [" ".join(base[k:] + prose(rng, k)) for k in range(0, 80, 4)]
    got = {r.doc_id: r.component_id for r in near.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(exact_groups(texts)))


def test_links_of_a_cluster_connect_what_its_pairs_connect():
    import numpy as np

    rng = random.Random(14)
    base = prose(rng, 150)
    texts = [edited(rng, base, k % 7) for k in range(70)] + [" ".join(prose(rng, k % 3)) for k in range(6)]
    sets = [near.shingles(t.encode()) for t in texts]
    node, prints = np.random.default_rng(1).permutation(len(texts)), np.stack([near.wide_print(h) for h in sets])
    for label in (node, np.where(node % 3 == 0, 0, node), np.zeros_like(node)):
        links = {tuple(x) for x in near.set_links(node, sets, label, prints, 4, 5).tolist()}
        close = near.print_links(node, np.array([len(h) for h in sets]), label, prints, 4, 5).tolist()
        by = dict(zip(node.tolist(), zip(sets, label.tolist(), strict=True), strict=True))
        pairs = [(a, b) for a, b in itertools.combinations(sorted(by), 2) if by[a][1] != by[b][1] and near.alike(by[a][0], by[b][0], 4, 5)]
        assert links <= set(pairs)

        def roots(edges, same):
            up = {x: x for x in by}

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in [*edges, *same]:
                up[max(root(a), root(b))] = min(root(a), root(b))
            return root

        same = [(a, b) for a, b in itertools.combinations(by, 2) if by[a][1] == by[b][1]]
        got, want = roots(links, same), roots(pairs, same)
        assert [got(x) for x in by] == [want(x) for x in by]
        near_prints = roots(close, [])
        assert all(near_prints(a) == near_prints(b) for a, b in pairs) and len(close) < len(texts)


def test_texts_stay_where_they_are_beside_few_names(spark, monkeypatch):
    """Whole documents are not moved for the names of those that go, whatever Spark thinks of the names' size."""
    rng = random.Random(15)
    rows = spark.createDataFrame([(k, " ".join(prose(rng, 30))) for k in range(8)], "doc_id long, text string")
    rows = rows.union(rows.selectExpr("doc_id + 100", "text"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near.deduplicated(rows)
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(8))
        monkeypatch.setattr(near, "SENT", 0)
        assert sorted(r.doc_id for r in near.deduplicated(rows).collect()) == list(range(8))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
