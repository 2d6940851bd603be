"""SentencePiece against the library itself: runs, long words, unknown characters, random texts, odd tables."""

import random

import numpy as np
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F

from fragmill.llm import common, pieces

MODEL = common.tokenizer_path("piece_bpe_32k.model")


def texts():
    rng = random.Random(9)
    letters = "etaoinshrdlu" * 3 + "qzxjEÉéñ0129  \n\t.,-_=(\"'漢и—ł 😀"
    made = ["".join(rng.choices(letters, k=rng.randint(1, 90))) for _ in range(150)]
    made += [" " * n + "a" * (n % 7) for n in range(1, 40)] + ["-" * n for n in range(1, 60, 3)] + ["=" * 33 + " " * 50 + "x"]
    return made + ["".join(rng.choices("etaoinsrhl", k=n)) for n in (60, 61, 62, 63, 64, 200)] + ["".join(rng.choices("etaoinsrhl", k=20_000)), "\x00\x1c\x85"]


@pytest.mark.parametrize("memory", [400_000, 5])
def test_ids_are_the_librarys(spark, monkeypatch, memory):
    monkeypatch.setattr(pieces, "MEMORY", memory)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(k, t) for k, t in enumerate(texts())]
    rows += [(5000, None), (5001, ""), (5002, rows[3][1]), (5002, rows[3][1]), (None, rows[4][1])]
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, row int, ids string, key int")
    got = pieces.encode(docs, MODEL).select("doc_id", "text", "ids").collect()
    assert sorted(((str(r[0]), r[1] or "", list(r[2])) for r in got), key=str) == sorted(((str(d), t or "", sp.encode(t or "")) for d, t in rows), key=str)


def test_a_piece_of_merges_in_order():
    assert pieces.orderly(MODEL)


def test_a_sample_holds_the_same_ids(spark, monkeypatch):
    monkeypatch.setattr(pieces, "SAMPLE", 200)
    monkeypatch.setattr(pieces, "TASK_UNITS", 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(k, f"the {k} words of text{k} the end") for k in range(60)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL)
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {d: sp.encode(t) for d, t in rows}


def test_units_are_cut_where_the_cuts_are():
    known = [p for p, _, _, _ in pieces.vocabulary(MODEL) if p]
    pattern = pieces.cuts(known).replace(r"\z", r"\Z")
    split, rng = pieces.Splitter(known), random.Random(3)
    assert split.by_word
    for t in [*texts(), "one two  three", "one two three ", "a\nb c.d e", "1 2 x1 (y)"]:
        want = [x for x in regex.split(pattern, " " + t, flags=regex.V1) if x] if t else []
        assert split.units(" " + t if t else "") == want
        held = pieces.Held({u: u.encode() for u in set(want) if rng.random() < 0.5})
        assert split.lacking(t, held) == [u for u in want if u not in held.units]
        assert b"".join(split.encoded(t, held, b"?")) == b"".join(held.units.get(u, b"?") for u in want)


def test_holes_are_filled_in_order():
    ids, grown = pieces.put_in(np.array([9, 1, 9, 9, 2]), 9, np.array([2, 0, 1]), np.array([5, 6, 7]))
    assert ids.tolist() == [5, 6, 1, 7, 2] and grown.tolist() == [1, 0, -1, 0, 0]
    with pytest.raises(ValueError, match="match"):
        pieces.put_in(np.array([9, 1]), 9, np.array([1, 1]), np.array([5, 6]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    done = pieces.encode(none, MODEL)
    assert done.count() == 0 and pieces.decode(done, MODEL).count() == 0
    assert pieces.encode(none, MODEL, unigram=True).count() == 0


def test_unigram_path_over_documents(spark):
    """Every text's ids are pieces that spell it, and no cutting of a word has a higher sum of scores."""
    score = {p: s for p, _, s, b in pieces.vocabulary(MODEL) if not b}
    piece = {k: p for p, k, _, _ in pieces.vocabulary(MODEL)}
    rows = [(1, "the cat sat"), (2, "on undone ground"), (3, "a")]
    got = {r.doc_id: [piece[i] for i in r.ids] for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, unigram=True).collect()}
    for d, t in rows:
        best = [0.0]
        whole = " " + t
        for e in range(1, len(whole) + 1):
            best.append(max(best[s] + score[whole[s:e]] for s in range(max(0, e - 16), e) if whole[s:e] in score))
        assert "".join(got[d]) == whole and sum(map(score.get, got[d])) == pytest.approx(best[-1])


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1, 2]), (4, [3 + 0xFF])], "row long, ids array<int>")
    got = {r.row: r.text for r in pieces.decode(rows, MODEL).collect()}
    assert got == {1: None, 2: "", 3: "", 4: "�"}
    assert pieces.decode(rows.withColumn("text", F.lit("old")), MODEL).columns == ["row", "ids", "text"]
