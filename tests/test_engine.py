"""The engine's operators on small cases; truth tables of library formats; round trips of sources and sinks."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmill.functions import formats, kmers, rolling
from fragmill.operators import assign, bias, collapse, estimate, lengths, mapping, resample, rollup
from fragmill.sources import readers, sinks

HIT = "frag_id long, hit_ord int, tid int, pos int, fwd boolean, read_len int, mate_status string, mate_pos int, mate_fwd boolean, mate_len int, frag_len int"


def test_format_ids_round_trip(spark):
    t = formats.format_table(spark)
    t = t.withColumn("id", formats.format_id(F.col("type"), F.col("orientation"), F.col("strandedness"))).withColumn("b", formats.from_id(F.col("id")))
    rows = t.collect()
    assert all((r.type, r.orientation, r.strandedness) == tuple(r.b) for r in rows)
    assert {r.name: r.id for r in rows}["ISF"] == 5 and formats.MAX_ID == 39
    with pytest.raises(Exception, match="unknown library format"):
        spark.createDataFrame([("XX",)], "n string").select(formats.parse(F.col("n"))).collect()


#: Formats with strands S and A for paired ones too, and whether a read alone agrees with them: forward as left mate, right
#: mate, single read, then the same reversed.
ALONE = {
    "U": "TTTTTT", "SF": "TFTFTF", "SR": "FTFTFT", "IU": "TTTTTT", "ISF": "TFTFTF", "ISR": "FTFTFT",
    "OU": "TTTTTT", "OSF": "TFTFTF", "OSR": "FTFTFT", "MU": "TTTTTT", "MSF": "TTTFFF", "MSR": "FFFTTT",
}


def test_single_compatibility_of_s_and_a_formats(spark):
    """All 72 cases, in one frame."""
    rows = []
    for name, truth in ALONE.items():
        _, orientation, strand = formats.FORMATS[name]
        strand = {formats.SA: formats.S, formats.AS: formats.A}.get(strand, strand)
        cases = [(fwd, status) for fwd in (True, False) for status in ("PAIRED_END_LEFT", "PAIRED_END_RIGHT", "SINGLE_END")]
        rows += [(name, orientation, strand, fwd, status, t == "T") for (fwd, status), t in zip(cases, truth, strict=True)]
    table = spark.createDataFrame(rows, "name string, o int, s int, fwd boolean, status string, want boolean")
    got = table.withColumn("got", formats.compatible_single(F.col("o"), F.col("s"), F.col("fwd"), F.col("status"))).collect()
    assert len(got) == 72 and [(r.name, r.fwd, r.status, r.got) for r in got] == [(r.name, r.fwd, r.status, r.want) for r in got]


def test_paired_compatibility(spark):
    """All 72 cases: a format agrees with itself, and an unstranded one with both of its strands."""
    t = formats.format_table(spark)
    seen = t.where("type = 1 AND strandedness <> 4").select(F.col("name").alias("seen"), F.col("orientation").alias("o"), F.col("strandedness").alias("s"))
    rows = t.crossJoin(seen).select("name", "seen", formats.compatible_pair(F.col("orientation"), F.col("strandedness"), F.col("o"), F.col("s")).alias("c")).collect()
    both = {("IU", "ISF"), ("IU", "ISR"), ("OU", "OSF"), ("OU", "OSR"), ("MU", "MSF"), ("MU", "MSR")}
    assert len(rows) == 72 and {(r.name, r.seen) for r in rows if r.c} == both | {(n, n) for n in ("ISF", "ISR", "OSF", "OSR", "MSF", "MSR")}


def test_orphans_of_stranded_pairs_need_the_fix(spark):
    one = lambda fix: spark.range(1).select(formats.compatible_single(F.lit(2), F.lit(0), F.lit(True), F.lit("PAIRED_END_LEFT"), fix).alias("c")).first().c
    assert not one(False) and one(True)


def test_hit_types(spark):
    cases = [(10, True, 10, False, (2, 0)), (10, False, 10, True, (2, 1)), (9, True, 8, False, (1, 0)), (1, True, 2, True, (0, 2)), (1, False, 2, False, (0, 3))]
    rows = spark.createDataFrame([(k, a, b, c, d) for k, (a, b, c, d, _) in enumerate(cases)], "k int, s1 int, f1 boolean, s2 int, f2 boolean")
    got = {r.k: tuple(r.t) for r in rows.select("k", formats.hit_type(F.col("s1"), F.col("f1"), F.lit(5), F.col("s2"), F.col("f2"), F.lit(5)).alias("t")).collect()}
    assert got == {k: c[-1] for k, c in enumerate(cases)}
    dove = rows.where("k = 2").select(formats.hit_type(F.col("s1"), F.col("f1"), F.lit(5), F.col("s2"), F.col("f2"), F.lit(5), True).alias("t")).first().t
    assert tuple(dove) == (2, 0)


def test_kmers(spark):
    every = spark.range(4096).select("id", kmers.decode(F.col("id"), 6).alias("k"))
    assert every.where(kmers.encode(F.col("k")) != F.col("id")).count() == 0
    odd = spark.createDataFrame([("acgtac",), ("ACGUAC",), ("ACGNAC",)], "k string").select(kmers.encode(F.col("k")).alias("i"), kmers.reverse_complement(F.col("k")).alias("r")).collect()
    assert odd[0].i == odd[1].i and odd[2].i is None and odd[0].r == "GTACGT"
    seq = "ATTCTCCACATAGTTGTCATCGAACCAGTACCCCGTAAGCGCCAACATAT"
    rows = spark.createDataFrame([(seq * 40,)], "s string").select(F.explode(kmers.windows(F.col("s"), 6)).alias("w")).select("w.*").collect()
    assert [(r.pos, r.kmer) for r in rows] == [(k, (seq * 40)[k : k + 6]) for k in range(len(seq) * 40 - 5)]
    strided = spark.createDataFrame([(seq * 40,)], "s string").select(F.explode(kmers.windows(F.col("s"), 6, 7)).alias("w")).select("w.pos").collect()
    assert [r.pos for r in strided] == list(range(0, len(seq) * 40 - 5, 7))
    rolled = spark.createDataFrame([(seq,)], "s string").select(kmers.next_index(kmers.encode(F.substring("s", 1, 6)), F.substring("s", 7, 1), 6).alias("n"), kmers.encode(F.substring("s", 2, 6)).alias("e")).first()
    assert rolled.n == rolled.e
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    pairs = [(back[k : k + 6], seq[len(seq) - 7 - k], back[k + 1 : k + 7]) for k in range(len(seq) - 6)]
    steps = spark.createDataFrame(pairs, "here string, base string, next string")
    wrong = steps.where(kmers.next_index(kmers.encode(F.col("here")), F.col("base"), 6, reverse=True) != kmers.encode(F.col("next")))
    assert steps.count() == 44 and wrong.count() == 0


def test_digamma(spark):
    got = spark.createDataFrame([(0.01,), (1.0,), (100.0,)], "x double").select(kmers.digamma(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([-100.560885457877, -0.577215664903, 4.600161852738], abs=1e-9)
    assert estimate.digamma(np.array([1.0]))[0] == pytest.approx(-0.577215664903, abs=1e-9)


def _hits(spark, rows):
    return spark.createDataFrame(rows, HIT)


def test_assignment(spark):
    pair, left, right = "PAIRED_END_PAIRED", "PAIRED_END_LEFT", "PAIRED_END_RIGHT"
    h = _hits(spark, [(1, 0, 7, 0, True, 5, pair, 50, False, 5, 55), (2, 0, 3, 0, True, 5, left, 0, False, 5, 0), (2, 1, 3, 0, True, 5, right, 0, False, 5, 0), (3, 0, 1, 0, True, 5, pair, 9, True, 5, 9), (3, 1, 2, 0, True, 5, pair, 9, False, 5, 9)])
    kept = assign.chosen(h)
    assert {r.frag_id: r.label for r in assign.labels(kept).collect()} == {1: [7], 2: [3, 3], 3: [2]}
    assert {r.frag_id for r in assign.chosen(h, assign.Options(discard_orphans=True)).collect()} == {1, 3}
    assert {r.frag_id for r in assign.ceiling(h, 1).collect()} == {1}
    assert [tuple(r) for r in assign.unique_pairs(h).collect()] == [(1, 55)]
    c = assign.counters(h, kept).first()
    assert (c.observed, c.mapped, c.total_hits, c.mapping_rate) == (3, 3, 5, 1.0)
    strict = assign.strict_intersection(spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "frag_id long, tid int"), spark.createDataFrame([(1, 2), (2, 6)], "frag_id long, tid int"))
    assert {tuple(r) for r in strict.collect()} == {(1, 2, pair), (2, 5, left), (2, 6, right)}


def _problem(spark, classes, lens):
    eq = spark.createDataFrame(classes, "label array<int>, count long")
    return estimate.Problem(eq, spark.createDataFrame(list(enumerate(lens)), "tid int, eff_length double"))


def test_em(spark, monkeypatch):
    p = _problem(spark, [([0, 1], 100)], [100.0, 100.0])
    assert p.fixed(5) == pytest.approx([50, 50])
    classes = [([0, 1], 100), ([0], 100), ([1, 2], 40), ([3, 3], 5)]
    p = _problem(spark, classes, [100.0, 100.0, 300.0, 50.0])
    alpha = p.fixed(7)
    assert alpha.sum() == pytest.approx(245) and p.mapped == 245
    done, steps = _problem(spark, [([0, 1], 100), ([0], 100)], [100.0, 100.0]).converged()
    assert done[0] == pytest.approx(200, abs=1e-3) and steps >= estimate.MIN_ITERATIONS
    monkeypatch.setattr(estimate, "LOCAL_MEMBERS", 0)
    q = _problem(spark, classes, [100.0, 100.0, 300.0, 50.0])
    assert q.local is None and q.fixed(7) == pytest.approx(alpha)
    assert q.fixed(4, True) == pytest.approx(p.fixed(4, True))
    eq = spark.createDataFrame(classes, "label array<int>, count long")
    lens = spark.createDataFrame([(0, 100.0), (1, 100.0), (2, 300.0), (3, 50.0)], "tid int, eff_length double")
    lazy = {r.tid: r.alpha for r in estimate.em_frame(collapse.weights(eq, lens), 7).collect()}
    assert [lazy[k] for k in range(4)] == pytest.approx(list(alpha))
    with pytest.raises(ValueError, match="abundance"):
        estimate.truncated(np.zeros(3))


@pytest.mark.parametrize("variational", [False, True])
def test_em_past_any_number_of_targets(spark, monkeypatch, variational):
    eq = spark.createDataFrame([([10, 20], 100), ([10], 100), ([20, 900], 40), ([7, 7], 5)], "label array<int>, count long")
    lens = spark.createDataFrame([(900, 300.0), (10, 100.0), (7, 50.0), (20, 100.0), (8, 10.0)], "tid int, eff_length double")
    held = {r.tid: r.num_reads for r in estimate.abundance(eq, lens, variational).collect()}
    few = {r.tid: r.num_reads for r in estimate.abundance(eq, lens, variational, steps=3).collect()}
    assert set(held) == {7, 8, 10, 20, 900} and held[8] == 0
    monkeypatch.setattr(estimate, "MAX_TARGETS", 2)
    table = {r.tid: r.num_reads for r in estimate.abundance(eq, lens, variational, steps=3).collect()}
    assert table == pytest.approx(few)
    with pytest.raises(ValueError, match="converged_frame"):
        estimate.Problem(eq, lens)
    # Any change is small enough here, so that the loop ends after the least number of steps.
    done = {r.tid: r.num_reads for r in estimate.converged_frame(eq, lens, variational, tolerance=1e9, least=2).collect()}
    two = {r.tid: r.num_reads for r in estimate.converged_frame(eq, lens, variational, steps=2).collect()}
    assert done == pytest.approx({t: 0.0 if v <= 0.01 + 1e-8 and variational else v for t, v in two.items()})


def test_a_class_of_an_unknown_target_is_an_error(spark):
    eq = spark.createDataFrame([([1, 5], 3)], "label array<int>, count long")
    with pytest.raises(Exception, match="no length"):
        estimate.Problem(eq, spark.createDataFrame([(1, 10.0)], "tid int, eff_length double"))


def test_lengths_change_where_they_are_worked_out_again(spark):
    p = _problem(spark, [([0, 1], 100)], [100.0, 100.0])
    seen = []

    def longer(tids, alpha, now):
        seen.append((tids.tolist(), alpha.tolist()))
        return now * np.array([1.0, 3.0])

    assert p.fixed(4, recompute=longer, at=(3,)) == pytest.approx([75, 25]) and seen == [([0, 1], [50.0, 50.0])]
    assert p.converged(recompute=longer, at=(10_000,))[1] == estimate.MIN_ITERATIONS


def test_lengths(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([0, 0, 5, 3, 0, 2])], "len long, n long")
    cf = {r.len: r.cf for r in lengths.conditional_means(counts).collect()}
    assert cf[1] == 0 and cf[3] == pytest.approx(19 / 8) and all(v <= k for k, v in cf.items())
    single = spark.createDataFrame([(k, 9 if k == 2 else 0) for k in range(5)], "len long, n long")
    assert lengths.distribution(single).agg(F.sum("pdf")).first()[0] == 1
    for n in ([5, 5], [5, 0, 5], [3, 4, 5], [5, 0], [1, 2, 3, 9]):
        i, j, u, v = 0, len(n) - 1, n[0], n[-1]
        while i < j:
            if u <= v:
                v, i = v - u, i + 1
                u = n[i]
            else:
                u, j = u - v, j - 1
                v = n[j]
        assert lengths.median(spark.createDataFrame(list(enumerate(n)), "len long, n long")).first().median == i
    assert lengths.median(spark.createDataFrame([(0, 0)], "len long, n long")).first().median is None


def test_gc_bias_against_loops(spark):
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGT"), 60)) for _ in range(3)]
    t = spark.createDataFrame([(k, s, 60, 40.0, 40.0, 1.0 + k) for k, s in enumerate(seqs)], "tid int, seq string, length int, unprocessed double, eff_length double, alpha double")
    cdf = [(k, min(1.0, k / 40)) for k in range(50)]
    fl, mass = bias.gc_steps(cdf, 4)
    want = np.ones(101)
    for k, s in enumerate(seqs):
        last = cdf[0][1]
        for length in range(1, 41, 4):
            m, last = cdf[length][1] - last, cdf[length][1]
            for i in range(60 - 6):
                if i + length - 1 < 60:
                    g = sum(c in "GC" for c in s[i + 1 : i + length])
                    want[int(np.rint(100.0 * g / length))] += (1 + k) / 40 * m
    got = {r.bin: r.x for r in bias.expected_gc(t, fl, mass).collect()}
    assert [got[b] for b in range(101)] == pytest.approx(list(want))
    observed = want * 3 + 1
    r, total = observed.sum(), want.sum()
    factor = observed / (total / (r - 101) + want)
    out = {r.tid: r.eff_length for r in bias.corrected_by_gc(t, fl, mass, observed, want).collect()}
    for k, s in enumerate(seqs):
        new, last = 0.0, cdf[0][1]
        for length in range(1, 41, 4):
            m, last = cdf[length][1] - last, cdf[length][1]
            for i in range(60 - 6):
                if i + length - 1 < 60:
                    g = sum(c in "GC" for c in s[i + 1 : i + length])
                    new += m * factor[int(np.rint(100.0 * g / length))]
        new *= total / r
        assert out[k] == pytest.approx(new if new > 20 else 40.0)


def test_sampled_gc_counts(spark):
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in (1, 7, 16, 17, 50)]
    rows = spark.createDataFrame([(k, p, s) for k, s in enumerate(seqs) for p in range(len(s))], "k int, p int, s string")
    for step in (1, 4):
        for r in rows.select("k", "p", kmers.gc_before_sampled(F.col("s"), F.col("p"), step).alias("g")).collect():
            s = seqs[r.k]
            gc = np.cumsum([c in "GC" for c in s])
            at = sorted({*range(0, len(s), step), len(s) - 1})
            assert r.g == pytest.approx(np.interp(r.p, at, gc[at]))


def test_genes(spark):
    q = spark.createDataFrame([(0, "a", "g", 100, 100.0, 3.0, 1.0), (1, "b", "g", 200, 200.0, 1.0, 1.0)], "tid int, name string, gene string, length int, eff_length double, tpm double, num_reads double")
    assert rollup.genes(q).first().length == 125
    assert rollup.genes_running(q).first().length == pytest.approx(500 / 7)
    t2g = spark.createDataFrame([("b", "G1"), ("d", "G2")], "transcript string, gene string")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "name string")
    assert {r.name: r.gene for r in rollup.gene_as_of(names, t2g).collect()} == {"a": "G1", "b": "G1", "c": "G2", "e": "e"}
    assert {r.name: r.gene for r in rollup.gene_of(names, t2g).collect()} == {"a": "a", "b": "G1", "c": "c", "e": "e"}


def test_next_gene_of_many_names_in_one_range(spark):
    """Work that grows with the square of a range's names would take many minutes here."""
    n, began = 150_000, time.time()
    names = spark.range(n, numPartitions=1).select(F.format_string("t%07d", "id").alias("name"))
    t2g = names.where("substr(name, 8, 1) = '7' AND name < 't0149000'").select(F.col("name").alias("transcript"), F.concat(F.lit("g"), "name").alias("gene"))
    got = {r.name: r.gene for r in rollup.gene_as_of(names, t2g).collect()}
    following = lambda k: k + (7 - k) % 10
    assert got == {f"t{k:07d}": f"gt{following(k):07d}" if following(k) < 149_000 else f"t{k:07d}" for k in range(n)}
    assert time.time() - began < 60


def test_resampling_keeps_counts_and_repeats(spark):
    eq = spark.createDataFrame([([0, 1], 100), ([0], 50), ([1, 2], 30)], "label array<int>, count long")
    one, two = (sorted(map(tuple, resample.gibbs(eq, np.ones(3), np.ones(3), 3, chains=2, seed=4).collect())) for _ in range(2))
    assert one == two and {sum(r[3] for r in one if r[:2] == (c, s)) for c in range(2) for s in range(3)} == {180}
    assert all(abs(r.t - 180) < 1e-6 for r in resample.bootstrap(eq, np.ones(3), 3).groupBy("sample_id").agg(F.sum("value").alias("t")).collect())


def _moments(table, tids):
    by = {}
    for r in table:
        by.setdefault(r.tid, []).append(r.value)
    return np.array([np.mean(by[t]) for t in tids]), np.array([np.var(by[t], ddof=1) for t in tids])


@pytest.mark.parametrize("local", [True, False])
def test_bootstrap_moments(spark, monkeypatch, local):
    """Classes of one target are multinomial counts: their means and variances are known. Few replicates where steps are distributed."""
    counts = {3: 100, 5: 300, 8: 600}
    eq = spark.createDataFrame([([t], n) for t, n in counts.items()] + [([9, 10], 0)], "label array<int>, count long")
    lens = spark.createDataFrame([(t, 100.0) for t in (3, 5, 8, 9, 10)], "tid int, eff_length double")
    if not local:
        monkeypatch.setattr(estimate, "LOCAL_MEMBERS", 0)
    n = 400 if local else 6
    rows = resample.bootstrap(eq, lens, n, seed=3).collect()
    total = {}
    for r in rows:
        total[r.sample_id] = total.get(r.sample_id, 0) + r.value
    assert len(total) == n and all(t == pytest.approx(1000) for t in total.values())
    mean, var = _moments(rows, counts)
    p = np.array(list(counts.values())) / 1000
    assert (np.abs(mean - 1000 * p) < 5 * np.sqrt(1000 * p * (1 - p) / n)).all()
    if local:
        assert (np.abs(var / (1000 * p * (1 - p)) - 1) < 0.35).all()


def test_redrawn_classes_keep_their_number(spark):
    eq = spark.range(0, 200, 1, 7).select(F.array(F.col("id").cast("int")).alias("label"), (F.col("id") % 9).alias("count"))
    want = sum(k % 9 for k in range(200))
    for sample in range(5):
        rows = resample.redrawn(eq, 1, sample).collect()
        assert sum(r["count"] for r in rows) == want and all(r["count"] == 0 for r in rows if r.label[0] % 9 == 0)


def test_gibbs_moments(spark):
    """A class of two targets beside classes of one: the means lie near what EM gives."""
    eq = spark.createDataFrame([([0], 600), ([1], 200), ([0, 1], 400)], "label array<int>, count long")
    rows = resample.gibbs(eq, np.array([100.0, 100.0]), np.array([900.0, 300.0]), 150, chains=2, thin=2, seed=5).collect()
    mean, var = _moments(rows, [0, 1])
    assert mean == pytest.approx([900, 300], rel=0.1) and (var > 0).all() and mean.sum() == pytest.approx(1200)
    eq, alpha = eq.unionByName(spark.createDataFrame([([2], 5)], "label array<int>, count long")), spark.createDataFrame([(0, 900.0), (1, 300.0), (2, 0.0)], "tid int, num_reads double")
    kept = resample.valid_classes(eq, alpha, alpha)
    assert sorted(r.label for r in kept.collect()) == [[0], [0, 1], [1]]


def test_drawn_lengths_follow_their_distribution(spark):
    dist = spark.createDataFrame([(0, 0.0), (1, 0.25), (2, 0.25), (3, 1.0)], "len int, cdf double")
    got = {r.len: r.n for r in lengths.draws(dist, 4000, seed=2).groupBy("len").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {1, 3} and got[1] == pytest.approx(1000, abs=150)


def test_mates_merge(spark):
    pair, left, right = assign.PAIRED_STATUS, assign.LEFT, assign.RIGHT
    l = spark.createDataFrame([(1, 1), (1, 2), (2, 5), (3, 7), (4, 8)], "frag_id long, tid int")
    r = spark.createDataFrame([(1, 2), (2, 6), (5, 9), (6, 9)], "frag_id long, tid int")
    seen = spark.createDataFrame([(1, True, True), (2, True, True), (3, True, False), (4, True, True), (5, None, True), (6, True, True)], "frag_id long, left boolean, right boolean")
    # 2: different targets alone; 4 and 6: the other mate matched somewhere.
    assert {tuple(x) for x in assign.fuzzy_intersection(l, r, seen).collect()} == {(1, 2, pair), (3, 7, left), (5, 9, right)}
    hit = "frag_id long, tid int, pos int, fwd boolean, read_len int"
    one = spark.createDataFrame([(1, 2, 30, True, 10), (1, 2, 20, True, 10), (3, 7, 5, False, 10)], hit)
    two = spark.createDataFrame([(1, 2, 60, False, 10), (5, 9, 8, True, 10)], hit)
    got = {x.frag_id: x for x in assign.paired_hits(one, two, assign.fuzzy_intersection(l, r, seen)).collect()}
    assert (got[1].pos, got[1].mate_pos, got[1].frag_len, got[1].mate_fwd) == (20, 60, 50, False)
    assert (got[5].pos, got[5].mate_status, got[5].mate_pos, got[5].frag_len) == (8, right, None, 0) and got[5].hit_ord > got[3].hit_ord
    assert assign.single_hits(one).where("mate_status = 'SINGLE_END'").count() == 3


def test_bias_samples_take_the_first_that_fits(spark):
    pair = assign.PAIRED_STATUS
    h = _hits(spark, [(1, 0, 1, 0, True, 5, pair, 9, False, 5, 9), (1, 1, 1, 3, True, 5, pair, 9, False, 5, 9), (1, 2, 1, 4, True, 5, pair, 9, False, 5, 9), (2, 0, 1, 8, False, 5, pair, 9, False, 5, 9), (3, 0, 1, 18, True, 5, pair, 9, True, 5, 9)])
    lens = spark.createDataFrame([(1, 20)], "tid int, length int")
    assert [tuple(r) for r in assign.bias_samples(h, lens).collect()] == [(1, 1, 3, True), (2, 1, 13, False)]
    assert assign.bias_samples(h, lens, quota=1).count() == 1


def test_sequence_bias_against_loops(spark):
    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ACGTN"), 60, p=[0.25, 0.25, 0.24, 0.24, 0.02])) for _ in range(3)] + ["ACGTAC"]
    t = spark.createDataFrame([(k, s, len(s), 0.6 * len(s), 0.5 * len(s), 1.0 + k) for k, s in enumerate(seqs)], "tid int, seq string, length int, unprocessed double, eff_length double, alpha double")
    q = [min(1.0, k / 40) for k in range(50)]
    cdf = spark.createDataFrame(list(enumerate(q)), "len int, cdf double")
    at = lambda m: q[m] if m < len(q) else 1.0
    code = lambda w: None if "N" in w else int(w.translate(str.maketrans("ACGT", "0123")), 4)
    rc = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = np.ones(4096)
    for k, s in enumerate(seqs[:3]):
        for i in range(60 - 6):
            w = s[i : i + 6]
            if code(w) is not None:
                if 60 - i - 1 < 60:
                    want[code(rc(w))] += 0.7 * (1 + k) / 30 * at(60 - i - 1)
                if i + 5 < 60:
                    want[code(w)] += 0.3 * (1 + k) / 30 * at(i + 5)
    expected = bias.expected_kmers(t, cdf, 0.7)
    assert [r.x for r in expected.orderBy("idx").collect()] == pytest.approx(list(want))
    n = rng.integers(1, 9, 4096)
    observed = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "idx long, n long")
    r, total = n.sum(), want.sum()
    out = {x.tid: x.eff_length for x in bias.corrected_by_sequence(t, cdf, observed, expected, 0.7).collect()}
    for k, s in enumerate(seqs[:3]):
        new = 0.0
        for i in range(60 - 6):
            w = s[i : i + 6]
            if code(w) is not None:
                f = lambda c: n[c] / (want[c] + total / (r - 4096))
                new += 0.7 * f(code(rc(w))) * at(60 - (i + 2) + 1) if i + 2 < 60 else 0
                new += 0.3 * f(code(w)) * at(i + 5) if i + 4 < 60 else 0
        new *= total / r
        assert out[k] == pytest.approx(new if new > 24 else 30.0)
    assert out[3] == 3.0


def test_mapping_finds_origins(spark):
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list("ACGT"), 200)) for _ in range(4)]
    rc = str.maketrans("ACGT", "TGCA")
    reads = [(k, s[50:90] if k % 2 else s[50:90].translate(rc)[::-1]) for k, s in enumerate(seqs)]
    idx = mapping.index(spark.createDataFrame(list(enumerate(seqs)), "tid int, seq string"), 15)
    got = {(r.frag_id, r.tid, r.pos, r.fwd) for r in mapping.hits(spark.createDataFrame(reads, "frag_id long, seq string"), idx, 15).collect()}
    assert got == {(k, k, 50, bool(k % 2)) for k in range(4)}
    with pytest.raises(ValueError, match="odd"):
        mapping.index(idx, 16)
    table = lambda rows, c: spark.createDataFrame(rows, f"{c} long, seq string")
    again = mapping.map_reads(table(reads, "frag_id"), table(list(enumerate(seqs)), "tid"), 15)
    assert {(r.frag_id, r.tid, r.pos, r.fwd) for r in again.collect()} == got
    assert mapping.map_reads(table([(1, None), (2, "AC")], "frag_id"), table([(1, None), (2, "")], "tid"), 15).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACG\nT\n>two\nGG\n")
    assert [(r.tid, r.name, r.length, r.seq) for r in readers.targets(spark, str(tmp_path / "a.fa")).orderBy("tid").collect()] == [(0, "one", 4, "ACGT"), (1, "two", 2, "GG")]
    (tmp_path / "a.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    (tmp_path / "b.fq").write_text("@r1\nTTTT\n+\nIIII\n")
    one, two = readers.reads(spark, str(tmp_path / "a.fq")), readers.reads(spark, str(tmp_path / "b.fq"))
    assert [(r.seq1, r.seq2) for r in readers.paired(one, two).collect()] == [("ACGT", "TTTT")]
    (tmp_path / "bad.fq").write_text("@r1\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="malformed"):
        readers.reads(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "odd.fq").write_text("ACGT\n")
    with pytest.raises(ValueError, match="unsupported"):
        readers.reads(spark, str(tmp_path / "odd.fq"))
    (tmp_path / "g.gtf").write_text('c\ts\ttranscript\t1\t2\t.\t+\t.\tgene_id "G"; transcript_id "T"; gene_name "N";\nc\ts\texon\t1\t2\t.\t+\t.\tgene_id "X"; transcript_id "T";\n')
    assert [tuple(r) for r in readers.gene_map(spark, str(tmp_path / "g.gtf")).collect()] == [("T", "G")]
    assert [tuple(r) for r in readers.gene_map(spark, str(tmp_path / "g.gtf"), "gene_name").collect()] == [("T", "N")]
    (tmp_path / "m.txt").write_text("t1 g1 t2\ng2\n")
    assert {tuple(r) for r in readers.gene_map(spark, str(tmp_path / "m.txt")).collect()} == {("t1", "g1"), ("t2", "g2")}
    with pytest.raises(ValueError, match="expected"):
        readers.check_paths(["x.txt"])


def test_sinks_round_trip(spark, tmp_path):
    eq = spark.createDataFrame([([0, 1], 7), ([3, 3], 2)], "label array<int>, count long")
    sinks.eq_classes(eq, str(tmp_path / "eq"))
    assert sorted(map(tuple, readers.eq_classes(spark, str(tmp_path / "eq")).collect())) == sorted(map(tuple, eq.collect()))
    q = spark.createDataFrame([(0, "a", 10, 9.123456789, 1e6, 2.0)], "tid int, name string, length int, eff_length double, tpm double, num_reads double")
    sinks.quant(q, str(tmp_path / "q"))
    r = readers.quant(spark, str(tmp_path / "q")).first()
    assert (r.Name, r.EffectiveLength, r.TPM) == ("a", 9.12346, 1e6)


def test_entry_lists_queries(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_steps_over_many_blocks_agree_with_those_in_the_driver(spark, monkeypatch):
    """Classes in many small blocks, sums in several chunks, some added in a shuffle; beyond the driver a step's job reads packed arrays, a row a block."""
    rng = np.random.default_rng(6)
    classes = {tuple(sorted(rng.integers(0, 300, rng.integers(1, 6)).tolist())): int(rng.integers(1, 9)) for _ in range(2000)}
    eq = spark.createDataFrame([(list(t), n) for t, n in classes.items()], "label array<int>, count long")
    lens = spark.range(300).select(F.col("id").cast("int").alias("tid"), (50.0 + F.col("id")).alias("eff_length"))
    held = estimate.Problem(eq, lens)
    for name, value in (("LOCAL_MEMBERS", 0), ("BLOCK_MEMBERS", 100), ("CHUNK", 70), ("DRIVER_SUMS", 400)):
        monkeypatch.setattr(estimate, name, value)
    far = estimate.Problem(eq, lens)
    assert far.local is None and far.blocks.count() >= 4
    assert far.mapped == held.mapped and (far.active == held.active).all() and far.single == pytest.approx(held.single)
    assert far.fixed(5) == pytest.approx(held.fixed(5)) and far.fixed(3, True) == pytest.approx(held.fixed(3, True))
    rows = resample.bootstrap(eq, lens, 3, seed=2, most=4).collect()
    assert len(rows) == 900 and all(sum(r.value for r in rows if r.sample_id == k) == pytest.approx(held.mapped) for k in range(3))


def test_places_of_many_wanted_kmers_and_of_stretches(spark, monkeypatch):
    """Past the codes that are sent whole, a map of bits keeps out nearly all places that no read asks for; stretches hold each k-mer once."""
    rng = np.random.default_rng(12)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.24, 0.25, 0.25, 0.25, 0.01])) for n in (3000, 20, 21, 22, 0, 5000)] + ["A" * 300, "AC" * 200, None]
    targets = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "tid int, seq string")
    every = sorted(map(tuple, mapping.index(targets, 21).collect()))
    plain = [(c, k, p) for k, s in enumerate(seqs) for p, c in enumerate(rolling.codes(s or "", 21).tolist()) if c >= 0]
    assert every == sorted(plain)
    parts = mapping.stretches(targets, 21)
    assert sorted(map(tuple, mapping.index(parts, 21).collect())) == every and parts.count() < len(every) / 3
    wanted = spark.createDataFrame([(c,) for c, k, p in plain if k == 0 and p < 200], "code long")
    few = sorted(map(tuple, mapping.index(targets, 21, wanted).collect()))
    monkeypatch.setattr(mapping, "FILTER_CODES", 10)
    more = set(map(tuple, mapping.index(targets, 21, wanted).collect()))
    assert set(few) <= more and len(more) < 0.2 * len(every)
    got = {r.tid: (r.n, r.n_distinct) for r in mapping.sizes(targets.unionByName(targets.where("tid = 7")), 21).collect()}
    want = {}
    for c, k, _ in plain:
        want.setdefault(k, []).append(c)
    assert got == {k: (len(x) * (2 if k == 7 else 1), len(set(x))) for k, x in want.items()}


def test_weights_stay_with_their_classes(spark, monkeypatch):
    """No member is shuffled where lengths can be sent; the join gives the same beyond that."""
    eq = spark.createDataFrame([([1, 2], 5), ([2, 2, 7], 3), ([7], 1), ([1, 99], 4), ([99], 2), ([3], 6)], "label array<int>, count long")
    lens = spark.createDataFrame([(7, 50.0), (1, 100.0), (2, 300.0), (3, None)], "tid int, eff_length double")
    plain = lambda df: sorted((tuple(r.label), *[x if isinstance(x, int) else round(x, 12) for x in r[1:]]) for r in df.select("label", *[c for c in df.columns if c != "label"]).collect())
    one, two = collapse.weights(eq, lens), collapse.weights(eq, lens, summed=True)
    assert "Exchange" not in two._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = plain(one.select("label", "count", "ord", "tid", "w")), plain(two.select("label", "tid", "w"))
    monkeypatch.setattr(collapse, "SENT", 2)
    assert got == (plain(collapse.weights(eq, lens).select("label", "count", "ord", "tid", "w")), plain(collapse.weights(eq, lens, summed=True).select("label", "tid", "w")))
    assert {r[1]: r[2] for r in got[1] if r[0] == (2, 2, 7)} == pytest.approx({2: 0.25, 7: 0.75}) and len(got[1]) == 7


def test_mates_files_are_not_read_by_one_task(spark, monkeypatch):
    """reads_paired_zip read all documents in one task to write them; the files' lines alone come together."""
    from fragmill.plans import catalog, runs  # noqa: F401

    def refused(self, n):
        raise AssertionError("one task reads all")

    monkeypatch.setattr(type(spark.range(0)), "coalesce", refused)
    assert catalog.QUERIES["reads_paired_zip"](spark, "/root/testdata/sf0.001").count()


def test_gc_masses_are_counted_once(spark):
    """The expected histogram and the corrected lengths come from one table of masses, dealt to all tasks."""
    rng = np.random.default_rng(5)
    t = spark.createDataFrame([(k, "".join(rng.choice(list("ACGT"), n)), n, n - 20.0, n - 20.0, 1.0) for k, n in enumerate((3, 40, 200, 700))], "tid int, seq string, length int, unprocessed double, eff_length double, alpha double").where("length > 20").coalesce(1)
    fl, mass = bias.gc_steps([(k, min(1.0, k / 40)) for k in range(50)])
    held = bias.gc_histograms(t, fl, mass)
    assert held.count() == 3 and "Exchange" in held._jdf.queryExecution().executedPlan().toString()
    got = {r.bin: r.x for r in bias.expected_gc(t, fl, mass, held=held).collect()}
    assert got == pytest.approx({r.bin: r.x for r in bias.expected_gc(t, fl, mass).collect()})
    per = {r.tid: np.frombuffer(r.h).sum() for r in held.collect()}
    assert per[3] == pytest.approx(sum(m * min(700 - 6, 700 - n + 1) for n, m in zip(fl.tolist(), mass.tolist(), strict=True)))
