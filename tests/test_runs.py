"""Sources, sinks, libraries, the index, whole runs, streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmill.functions import rolling, tables
from fragmill.operators import assign, simulate
from fragmill.plans import catalog, experiment
from fragmill.sources import index, libraries, readers, sinks
from fragmill.streaming import accumulate

RC = str.maketrans("ACGT", "TGCA")


def test_rolling_codes():
    rng = np.random.default_rng(2)
    seq = "".join(rng.choice(list("ACGTacgtuN"), 300, p=[0.12] * 8 + [0.02, 0.02]))
    plain = seq.upper().replace("U", "T")
    for k in (1, 2, 6, 15, 31):
        want = [-1 if "N" in w else int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in (plain[i : i + k] for i in range(len(seq) - k + 1))]
        found = rolling.codes(seq, k)
        assert found.tolist() == want
        assert rolling.reversed_codes(found, k)[::-1].tolist() == rolling.codes(plain[::-1].translate(RC), k).tolist()
    assert not len(rolling.codes("", 3)) and not len(rolling.codes("AC", 3))
    with pytest.raises(ValueError):
        rolling.codes("ACGT", 32)


def test_mutations(spark):
    seqs = spark.createDataFrame([(k, "ACGTN" * 400) for k in range(10)] + [(11, ""), (12, None)], "tid int, seq string")
    changed = simulate.mutated(seqs, 0.1, seed=3)
    assert sorted(map(tuple, changed.collect()), key=str) == sorted(map(tuple, simulate.mutated(seqs, 0.1, seed=3).collect()), key=str)
    r = simulate.mutation_rate(seqs, changed).first()
    assert r.bases == 20_000 and r.rate == pytest.approx(0.08, abs=0.01)
    assert simulate.differences(seqs, changed).where("n = 0").count() == 1
    assert all(r.seq is None or set(r.seq[4::5]) <= {"N"} for r in changed.collect())


def test_kmers_in_sql(spark):
    tables.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM kmers('ACNGT', 2) ORDER BY pos").collect()] == [(0, 1), (3, 11)]


def test_mates_of_many_files_meet_by_file_and_place(spark, tmp_path):
    """Files of unlike sizes, so that Spark reads them in another order than their names'."""
    sizes = {"a": 3, "b": 40, "c": 9}
    for side in (1, 2):
        (tmp_path / str(side)).mkdir()
        for name, n in sizes.items():
            more = n + (side - 1)  # the longer file's rest is left out
            (tmp_path / str(side) / f"{name}.fq").write_text("".join(f"@{name}{k}\n{'ACGT' * (k % 5 + 1)}\n+\n{'IIII' * (k % 5 + 1)}\n" if side == 1 else f"@{name}{k}\n{name.upper()}{'G' * k}\n+\n{'I' * (k + 1)}\n" for k in range(more)))
    one, two = (readers.reads(spark, str(tmp_path / str(side))) for side in (1, 2))
    want = [("ACGT" * (k % 5 + 1), name.upper() + "G" * k) for name, n in sizes.items() for k in range(n)]
    assert [(r.seq1, r.seq2) for r in readers.paired(one, two).orderBy("frag_id").collect()] == want
    files = [[str(tmp_path / str(side) / f"{n}.fq") for n in "cab"] for side in (1, 2)]
    rows = readers.paired_files(spark, *files).orderBy("frag_id").collect()
    assert [(r.seq1, r.seq2) for r in rows] == [("ACGT" * (k % 5 + 1), n.upper() + "G" * k) for n in "cab" for k in range(sizes[n])]
    assert [r.frag_id for r in rows] == list(range(1, 53))
    assert readers.single_files(spark, files[0]).count() == 52
    (tmp_path / "x.fa").write_text(">x\nAC\n")
    with pytest.raises(ValueError, match="types"):
        readers.paired_files(spark, [files[0][0]], [str(tmp_path / "x.fa")])
    with pytest.raises(ValueError, match="files of first mates"):
        readers.paired_files(spark, files[0], files[1][:2])


def test_fastq_of_several_lines(spark, tmp_path):
    (tmp_path / "m.fq").write_text("@r1 x\nAC\nGT\n+r1\n@I\n+I\n@r2\n\n+\n@r3\nA\n+\nI\n")
    got = [tuple(r) for r in readers.reads(spark, str(tmp_path / "m.fq"), multiline=True).select("ord", "header", "seq", "qual").orderBy("ord").collect()]
    assert got == [(0, "r1 x", "ACGT", "@I+I"), (1, "r2", "", ""), (2, "r3", "A", "I")]
    for k, (bad, why) in enumerate([("@r\nAC\n", "ends"), ("@r\nAC\n+\nI\n", "qualities"), ("@r\nAC\n+\nII\nx\n", "header")]):
        (tmp_path / f"bad{k}.fq").write_text(bad)
        with pytest.raises(Exception, match=why):
            readers.reads(spark, str(tmp_path / f"bad{k}.fq"), multiline=True).collect()


def test_small_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACG\nT\n>two\nGG\n")
    (tmp_path / "empty.fa").write_text("")
    path = str(tmp_path / "a.fa")
    assert readers.fasta_count(spark, path) == 2 and readers.reads(spark, str(tmp_path / "empty.fa")).count() == 0
    assert {tuple(r) for r in readers.fasta_genes(spark, path).collect()} == {("one", "gene"), ("two", "gene")}
    known = spark.createDataFrame([("two", 7), ("three", 8)], "name string, tid int")
    assert {r.name: r.seq for r in readers.with_sequences(known, spark, path).collect()} == {"two": "GG", "three": None}
    (tmp_path / "eq.txt").write_text("three\ttwo\t4\ntwo\t1\n")
    assert sorted((r.label, r["count"]) for r in readers.named_classes(spark, str(tmp_path / "eq.txt"), known).collect()) == [([7], 1), ([7, 8], 4)]
    (tmp_path / "odd.txt").write_text("nobody\t4\n")
    with pytest.raises(Exception, match="unknown target nobody"):
        readers.named_classes(spark, str(tmp_path / "odd.txt"), known).collect()
    (tmp_path / "map.txt").write_text("".join(f"t{k}  g{k}\n\n" if k % 3 else f"t{k}\ng{k}\t" for k in range(50)))
    assert {tuple(r) for r in readers.pair_genes(spark, str(tmp_path / "map.txt")).collect()} == {(f"t{k}", f"g{k}") for k in range(50)}


def test_libraries_follow_the_order_of_options():
    found = libraries.libraries([("mates1", "a.fq"), ("lib_type", "isf"), ("mates1", ["b.fq"]), ("mates1", ["c.fq", "d.fq"]), ("mates2", ["e.fq", "f.fq"]), ("unmated", "u.fa"), ("lib_type", "OU")])
    assert found == [libraries.Library("U", unmated=("u.fa",)), libraries.Library("ISF", mates1=("c.fq", "d.fq"), mates2=("e.fq", "f.fq"))]
    assert found[1].check().paired and not found[0].paired
    with pytest.raises(ValueError, match="files of first mates"):
        libraries.Library("IU", mates1=("a.fq",), mates2=("b.fq", "c.fq")).check()
    with pytest.raises(ValueError, match="unknown"):
        libraries.libraries([("lib_type", "XX")])
    with pytest.raises(ValueError, match="exclude"):
        libraries.consistent(experiment.Options(bootstraps=2, gibbs=2))
    with pytest.raises(ValueError, match="both"):
        libraries.consistent(experiment.Options(seq_bias=True, gc_bias=True))
    assert not libraries.consistent(experiment.Options(gc_bias=True), found).gc_bias and libraries.consistent(experiment.Options(gc_bias=True), found[1:]).gc_bias


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Random targets as FASTA, and error-free pairs of reads from them as FASTQ, with the target each comes from."""
    at, rng = tmp_path_factory.mktemp("world"), np.random.default_rng(8)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in (400, 600, 900, 500)]
    (at / "t.fa").write_text("".join(f">t{k} made up\n{s[:70]}\n{s[70:]}\n" for k, s in enumerate(seqs)))
    lines, origin = ([], []), []
    for k in range(240):
        t = int(rng.choice(4, p=[0.1, 0.2, 0.3, 0.4]))
        start = int(rng.integers(0, len(seqs[t]) - 200))
        fragment = seqs[t][start : start + 200]
        origin.append(t)
        for side, read in enumerate((fragment[:60], fragment[-60:][::-1].translate(RC))):
            lines[side].append(f"@r{k}\n{read}\n+\n{'I' * 60}\n")
    for side in range(2):
        (at / f"r{side + 1}.fq").write_text("".join(lines[side]))
    return at, seqs, origin


def test_index_is_built_once(spark, world):
    at, seqs, _ = world
    built = index.build(spark, [str(at / "t.fa")], str(at / "index"), k=15)
    assert built.k == 15 and built.places.count() == sum(len(s) - 14 for s in seqs)
    assert [(r.tid, r.name, r.length, r.seq) for r in built.targets.orderBy("tid").collect()] == [(k, f"t{k}", len(s), s) for k, s in enumerate(seqs)]
    assert index.build(spark, ["missing.fa"], str(at / "index"), k=21).k == 15
    assert index.build(spark, [str(at / "t.fa")], str(at / "index"), k=21, force=True).k == 21
    old = spark.createDataFrame([(1, 21)], "indexVersion int, kmerLength int")
    old.coalesce(1).write.mode("overwrite").json(str(at / "old" / "versionInfo.json"))
    with pytest.raises(ValueError, match="older"):
        index.load(spark, str(at / "old"))
    with pytest.raises(ValueError, match="no index"):
        index.load(spark, str(at / "nowhere"))


@pytest.mark.parametrize("strict", [False, True])
def test_reads_to_abundances(spark, world, tmp_path, strict):
    at, seqs, origin = world
    lib = libraries.libraries([("lib_type", "IU"), ("mates1", str(at / "r1.fq")), ("mates2", str(at / "r2.fq"))])[0]
    built = index.build(spark, [str(at / "t.fa")], str(tmp_path / "index"), k=21)
    options = experiment.Options(strict_intersect=strict, bootstraps=0 if strict else 3, seq_bias=strict, gc_bias=False, num_frag_samples=100)
    reads = experiment.library_reads(spark, lib)
    hits = experiment.hits_of(reads, built.targets, built.places, k=21, options=options)
    rows = hits.collect()
    assert len(rows) == 240 and all(r.tid == origin[r.frag_id - 1] and r.frag_len == 200 and r.mate_status == assign.PAIRED_STATUS for r in rows)
    run = experiment.quant(hits, built.targets, options, n_fragments=250, libraries=[lib])
    got = {r.tid: r.num_reads for r in run.quant.collect()}
    assert got == pytest.approx({t: origin.count(t) for t in range(4)})
    assert run.observed_lengths and run.counters.first().mapping_rate == 240 / 250
    assert run.quant.agg(F.sum("tpm")).first()[0] == pytest.approx(1e6)
    t2g = spark.createDataFrame([("t0", "g"), ("t1", "g")], "transcript string, gene string")
    run.write(str(tmp_path / "out"), t2g, dump_eq=True, comments=["# one"], command=[("lib_type", "IU"), ("mates1", ["a", "b"])])
    back = {r.Name: r for r in readers.quant(spark, str(tmp_path / "out" / "quant.sf")).collect()}
    assert {n: r.NumReads for n, r in back.items()} == pytest.approx({f"t{t}": float(n) for t, n in got.items()}, rel=1e-5)
    genes = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "out" / "quant.genes.sf")).collect()]
    assert genes[0] == ["# one"] and genes[1][0] == "Name" and [g[0] for g in genes[2:]] == ["g", "t2", "t3"]
    meta = json.loads(spark.read.text(str(tmp_path / "out" / "aux" / "meta_info.json")).first().value)
    assert len(meta) == 12 and meta["num_mapped"] == 240 and meta["samp_type"] == ("none" if strict else "bootstrap") and meta["percent_mapped"] == 96.0
    assert json.loads(spark.read.text(str(tmp_path / "out" / "cmd_info.json")).first().value) == {"version": experiment.VERSION, "lib_type": "IU", "mates1": ["a", "b"]}
    eq = [r.value for r in spark.read.text(str(tmp_path / "out" / "aux" / "eq_classes.txt")).collect()]
    assert eq[:6] == ["4", "4", "t0", "t1", "t2", "t3"] and eq[6:] == [f"1\t{t}\t{origin.count(t)}" for t in range(4)]
    assert spark.read.parquet(str(tmp_path / "out" / "aux" / "fld_draws")).select("len").distinct().collect()[0].len == 200
    if not strict:
        assert spark.read.text(str(tmp_path / "out" / "aux" / "bootstrap" / "names.tsv.gz")).first().value == "t0\tt1\tt2\tt3"
        sinks.sample_lines(run.samples, run.quant, str(tmp_path / "lines"))
        lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "lines")).collect()]
        assert lines[0] == ["t0", "t1", "t2", "t3"] and len(lines) == 4 and all(sum(map(float, x)) == pytest.approx(240, rel=1e-4) for x in lines[1:])
        seen = []
        accumulate.each_sample(run.samples, lambda k, rows: seen.append((k, rows.count())))
        assert seen == [(0, 4), (1, 4), (2, 4)]


def test_too_few_pairs_give_the_priors_lengths(spark, world):
    at, _, _ = world
    reads = readers.paired_files(spark, [str(at / "r1.fq")], [str(at / "r2.fq")])
    targets = readers.targets(spark, str(at / "t.fa"))
    hits = experiment.hits_of(reads, targets, k=21)
    run = experiment.quant(hits, targets, experiment.Options(gc_bias=True, gc_speed_step=20, gibbs=2, variational=True))
    assert not run.observed_lengths and run.quant.where("eff_length < 1").count() == 0
    assert run.samples.groupBy("sample_id").agg(F.sum("value").alias("n")).where("n <> 240").count() == 0
    none = experiment.quant(hits, targets, experiment.Options(no_length_correction=True))
    assert none.quant.where("eff_length <> length").count() == 0
    alone = experiment.hits_of(reads.select("frag_id", F.col("seq1").alias("seq")), targets, k=21)
    assert {r.mate_status for r in alone.collect()} == {assign.SINGLE} and alone.count() == 240


def test_lengths_stay_the_priors_where_that_is_asked_for(spark, world):
    """As the SQL of em_bias_aware_fixed has it on tables of any size: here 240 pairs are well over the quota."""
    at, _, _ = world
    reads = readers.paired_files(spark, [str(at / "r1.fq")], [str(at / "r2.fq")])
    targets = readers.targets(spark, str(at / "t.fa"))
    hits = experiment.hits_of(reads, targets, k=21)
    run = experiment.quant(hits, targets, experiment.Options(num_frag_samples=100, prior_lengths=True))
    few = experiment.quant(hits, targets, experiment.Options(num_frag_samples=1000))
    assert not run.observed_lengths and experiment.quant(hits, targets, experiment.Options(num_frag_samples=100)).observed_lengths
    eff = lambda r: {x.tid: x.eff_length for x in r.quant.collect()}
    assert eff(run) == pytest.approx(eff(few))


def test_the_bias_aware_query_takes_the_priors_lengths(spark, monkeypatch):
    """Its SQL never looks at observed lengths; the quota itself stays what it is."""
    from fragmill.plans import runs

    asked, quant = [], experiment.quant
    monkeypatch.setattr(experiment, "quant", lambda h, t, options: asked.append(options) or quant(h, t, options))
    assert runs.experiment is experiment and catalog.QUERIES["em_bias_aware_fixed"](spark, "/root/testdata/sf0.001").count()
    assert asked[0].prior_lengths and asked[0].num_frag_samples == experiment.Options().num_frag_samples


def test_a_streams_quota_holds_over_batches(spark, tmp_path):
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("frag_id"), (F.col("id") % 7).alias("frag_len")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}.parquet"))
    rows = spark.readStream.schema("frag_id long, frag_len long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*.parquet"))
    got = [r.frag_id for r in accumulate.first_pairs(rows, 23, "quota").collect()]
    assert len(got) == 23 and sum(10 * (k // 10) <= k < 10 * (k // 10) + 3 for k in got) >= 9
    assert accumulate.drain(accumulate.lengths(rows), "lengths").agg(F.sum("n")).first()[0] == 40
