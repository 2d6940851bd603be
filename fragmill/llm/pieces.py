"""SentencePiece encoding and decoding as a relational lattice.

A text, with the space it is given in front, is cut wherever a character of one class meets one of another class
and no piece of the vocabulary has such neighbours; no path and no merge goes over such a cut. The parts are its
units. Distinct units are exploded into substrings of bounded length, an equi-join with the piece table keeps those
that are pieces (the lattice's edges), edges are grouped by unit, and a higher-order aggregate folds them into the
unit's pieces. Units' ids then go back to the documents: the MEMORY most frequent ones of a sample of documents in a
dictionary that every worker holds, all others by an equi-join with their places. Which units are held changes
no result.

Two folds over a unit's edges:

* best_path(), for unigram models: Viterbi, edges in the order of their ends; the highest sum of scores wins.
* merged(), for BPE models. A BPE model's scores are the order of its merges, and its encoding is not the path of the
  best sum, so Viterbi can't give it. Edges are folded best score first, the left one of equals, and an edge is taken if
  just two parts make it up at that moment. One pass is enough where every piece is made from pieces of better
  scores alone, which orderly() makes sure of for a vocabulary; a vocabulary that isn't so is refused.

What the vocabulary lacks becomes bytes.

Cases: a null or empty text has no ids. Repeated rows are encoded each. A null doc_id is kept. An empty table gives no
rows. Other columns are ignored. Units have no longest length: up to 61 characters a fold's state is one number, and
beyond that a string of bytes, one a character, which each taken edge copies.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import small_batches, table, tokenizer_path, written

_SPACE = "▁"
#: Classes of characters as ranges, so that all libraries agree on them; what is in none is a class too.
CLASSES = ("A-Za-zÀ-ÖØ-öø-ÿ", "0-9", " ", r"\x00-\x1F!-/:-@\[-`{-\x7F")
#: Units that every worker holds, their characters at most, and the characters of the sample they are counted in.
MEMORY, HELD_LENGTH, SAMPLE = 400_000, 48, 1 << 27
#: Distinct units that one task makes lattices of, and units of a document table's task that are counted at once.
TASK_UNITS, COUNTED = 40_000, 1 << 18
#: Characters of a unit up to which the fold's state is one number: a bit a place, the end included.
SHORT = 61


# ---- vocabulary ---------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def vocabulary(model: str) -> tuple[tuple[str | None, int, float, bool], ...]:
    """piece (spaces as such; None for a byte), id, score, is_byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = []
    for k in range(sp.vocab_size()):
        if sp.is_byte(k):
            rows.append((None, k, 0.0, True))
        elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
            rows.append((sp.id_to_piece(k).replace(_SPACE, " "), k, sp.get_score(k), False))
    return tuple(rows)


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """piece (spaces as such), id, score, is_byte. As many rows as the vocabulary has."""
    return spark.createDataFrame(vocabulary(model), "piece string, id int, score double, is_byte boolean")


@lru_cache(maxsize=4)
def piece_bytes(model: str) -> list[bytes]:
    """Each id's bytes; none for control pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    silent = lambda k: sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)
    return [bytes.fromhex(sp.id_to_piece(k)[3:5]) if sp.is_byte(k) else b"" if silent(k) else sp.id_to_piece(k).replace(_SPACE, " ").encode() for k in range(sp.vocab_size())]


@lru_cache(maxsize=4)
def orderly(model: str) -> bool:
    """Whether every piece that merging makes is made by merges of better scores than its own.

    Equal scores are allowed among pieces that repeat one character: merges of a run go from left to right.
    """
    score = {p: s for p, _, s, is_byte in vocabulary(model) if not is_byte}
    tied = Counter(s for p, s in score.items() if len(p) > 1)
    for piece, own in score.items():
        parts, run = list(piece), len(set(piece)) == 1
        if len(parts) > 1 and tied[own] > 1 and not run:
            return False
        while len(parts) > 2:
            best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
            if best is None:
                break
            if best[0] < own or (best[0] == own and not run):
                return False
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return True


# ---- units --------------------------------------------------------------------------------------


def _one_of(kinds: set[int]) -> str:
    if len(CLASSES) in kinds:
        return f"[^{''.join(c for k, c in enumerate(CLASSES) if k not in kinds)}]"
    return f"[{''.join(CLASSES[k] for k in sorted(kinds))}]"


def _follows(pieces: Iterable[str]) -> dict[int, set[int]]:
    """For each class, the classes that follow it in some piece."""
    every = range(len(CLASSES) + 1)
    matches = [re.compile(_one_of({k})).match for k in every]
    kind = lru_cache(maxsize=None)(lambda c: next(k for k, m in enumerate(matches) if m(c)))
    met = {(kind(a), kind(b)) for p in pieces for a, b in zip(p, p[1:], strict=False)}
    return {a: {b for b in every if (a, b) in met} for a in every}


def cuts(pieces: Iterable[str]) -> str:
    """A pattern of the places between two classes of characters that no piece has as neighbours. It may be empty."""
    every, after = set(range(len(CLASSES) + 1)), _follows(pieces)
    # The complement of no class would be an empty set; there any character will do, but not the end.
    return "|".join(f"(?<={_one_of({a})})" + (f"(?={_one_of(every - b)})" if b else r"(?!\z)") for a, b in after.items() if every - b)


def unit_pattern(pieces: Iterable[str]) -> str:
    """A pattern of one unit: runs of a class, each but the last followed by a class that may follow it."""
    after = _follows(pieces)
    run = {a: _one_of({a}) + ("++" if a in b else "") for a, b in after.items()}
    on = "|".join(f"{run[a]}(?={_one_of(b - {a})})" for a, b in after.items() if b - {a})
    return (f"(?:{on})*+" if on else "") + f"(?:{'|'.join(run.values())})"


class Splitter:
    """Texts to units, and to the ids of those that are held.

    Where a cut lies before every space, a text without double spaces is its words, each with a space in front. Most words
    are one unit that is held; only the others are split further, all of a text at once.
    """

    def __init__(self, pieces: Iterable[str]):
        after = _follows(pieces)
        space = next(k for k, c in enumerate(CLASSES) if c == " ")
        self.units = re.compile(unit_pattern(pieces), re.DOTALL).findall
        self.by_word = not any(space in b for a, b in after.items() if a != space)

    def words(self, text: str) -> list[str] | None:
        """The words of a text, of which each with a space in front is whole units; None if it isn't so."""
        return text.split(" ") if self.by_word and text[0] != " " and "  " not in text else None

    def lacking(self, text: str | None, held: Held) -> list[str]:
        """The units of a text that aren't held, in their order."""
        if not text:
            return []
        words = self.words(text)
        if words is not None:
            alone = held.alone
            words = [w for w in words if w not in alone]
            if not words:
                return []
            text = " ".join(words)
        return [u for u in self.units(" " + text) if u not in held.units]

    def encoded(self, text: str | None, held: Held, gap: bytes) -> list[bytes]:
        """Ids of a text's units, `gap` for each that isn't held."""
        if not text:
            return []
        words, get = self.words(text), held.units.get
        if words is None:
            return [get(u, gap) for u in self.units(" " + text)]
        out = list(map(held.alone.get, words))
        units = self.units(" " + " ".join([w for w, ids in zip(words, out, strict=True) if ids is None])) if None in out else []
        at, n = 0, len(units)
        for k in [k for k, ids in enumerate(out) if ids is None] if units else ():
            ids, at = get(units[at], gap), at + 1
            while at < n and units[at][0] != " ":  # the next word's first unit begins with its space
                ids, at = ids + get(units[at], gap), at + 1
            out[k] = ids
        return out


@dataclass
class Held:
    """Units and their ids; alone: those that are a word with a space in front, by the word."""

    units: dict[str, bytes]

    def __post_init__(self):
        self.alone = {u[1:]: ids for u, ids in self.units.items() if u[0] == " " and len(u) > 1 and u[1] != " "}

    def __reduce__(self):
        return Held, (self.units,)


@lru_cache(maxsize=4)
def splitter(model: str) -> Splitter:
    """The worker process's splitter of a model."""
    return Splitter([p for p, _, _, _ in vocabulary(model) if p])


# ---- lattice and folds --------------------------------------------------------------------------


def lattice(distinct: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """unit, edges array<struct(cost, end, len, id)>: the pieces among its substrings of at most `longest` characters.

    Every single character is an edge, with a null id if it is no piece. cost is the score's negative. The piece
    table is broadcast: its size is the vocabulary's. Units that are dealt by `unit` are not moved again by the join or
    the grouping.
    """
    known = pieces.where("NOT is_byte AND piece <> ''").select("piece", "id", (-F.col("score")).alias("cost"))
    starts = distinct.where("unit <> ''").select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("s"))
    spans = starts.select("unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("unit") - F.col("s") + 1))).alias("len"))
    spans = spans.select("unit", (F.col("s") + F.col("len") - 1).alias("end"), "len", F.substring("unit", F.col("s"), F.col("len")).alias("piece"))
    edges = spans.join(F.broadcast(known), "piece", "left").where("id IS NOT NULL OR len = 1")
    return edges.groupBy("unit").agg(F.collect_list(F.struct("cost", "end", "len", "id")).alias("edges"))


def _bits(edge: Column) -> tuple[Column, Column]:
    """The places at an edge's ends, and those inside, as bits of a number."""
    span, start = F.call_function("shiftleft", F.lit(1).cast("long"), edge["len"]), edge["end"] - edge["len"]
    return F.call_function("shiftleft", span + 1, start), F.call_function("shiftleft", span - 2, start)


def _sorted_parts(edges: Column) -> Column:
    return F.sort_array(F.transform(edges, lambda e: F.struct(e["end"], e["len"], e["id"])))


def merged(unit: Column, edges: Column) -> Column:
    """array<struct(end, len, id)>: a unit's pieces by a BPE model's merges, best score first, the left one of equals.

    The state is the set of places between parts. An edge is merged if both its ends are such places and just one lies
    inside; edges whose ends are places with none inside are what is left.
    """
    ordered = F.sort_array(F.filter(edges, lambda e: e["len"] > 1))

    def step(state: Column, edge: Column) -> Column:
        ends, inner = _bits(edge)
        taken = (state.bitwiseAND(ends) == ends) & (F.bit_count(state.bitwiseAND(inner)) == 1)
        return F.when(taken, state.bitwiseAND(F.bitwise_not(inner))).otherwise(state)

    def left(state: Column, edge: Column) -> Column:
        ends, inner = _bits(edge)
        return state.bitwiseAND(ends.bitwiseOR(inner)) == ends

    every = F.call_function("shiftleft", F.lit(2).cast("long"), F.length(unit)) - 1
    short = F.aggregate(ordered, every, step, lambda state: _sorted_parts(F.filter(edges, lambda e: left(state, e))))

    # The same with a byte for each place.
    window = lambda state, e: F.substring(state, e["end"] - e["len"] + 1, e["len"] + 1).cast("string")
    gap = lambda e: F.concat(F.lit("1"), F.repeat(F.lit("0"), e["len"] - 1), F.lit("1")).cast("binary")
    put = lambda state, e: F.when(window(state, e).rlike("^10*10*1$"), F.overlay(state, gap(e), e["end"] - e["len"] + 1, e["len"] + 1)).otherwise(state)
    whole = F.repeat(F.lit("1"), F.length(unit) + 1).cast("binary")
    long = F.aggregate(ordered, whole, put, lambda state: _sorted_parts(F.filter(edges, lambda e: window(state, e).rlike("^10*1$"))))
    return F.when(F.length(unit) <= SHORT, short).otherwise(long)


def best_path(unit: Column, edges: Column, unknown: float = 1e4) -> Column:
    """array<struct(end, len, id)>: a unit's pieces on the path of the highest sum of scores; a character that is no piece costs `unknown`.

    The first fold's state is, for each place, the least cost and the edge that ends there; the second goes back.
    """
    state = "struct<cost:double,len:int,id:int>"
    ordered = F.sort_array(F.transform(edges, lambda e: F.struct(e["end"], e["len"], e["id"], F.coalesce(e["cost"], F.lit(unknown)).alias("cost"))))
    first = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("len"), F.lit(None).cast("int").alias("id")).cast(state))

    def step(best: Column, e: Column) -> Column:
        via = F.struct((F.get(best, e["end"] - e["len"])["cost"] + e["cost"]).alias("cost"), e["len"], e["id"]).cast(state)
        fresh = F.size(best) == e["end"]
        better = F.get(best, e["end"])["cost"] > via["cost"]
        return F.when(fresh, F.concat(best, F.array(via))).when(better, F.concat(F.slice(best, F.lit(1), e["end"]), F.array(via))).otherwise(best)

    def back(best: Column) -> Column:
        none = F.array().cast("array<struct<end:int,len:int,id:int>>")

        def onto(held: Column, end: Column) -> Column:
            here = F.get(best, end)
            due = F.coalesce(F.get(held, F.lit(0))["end"] - F.get(held, F.lit(0))["len"], F.length(unit))
            return F.when(due == end, F.concat(F.array(F.struct(end.alias("end"), here["len"], here["id"])), held)).otherwise(held)

        return F.aggregate(F.sequence(F.length(unit), F.lit(1), F.lit(-1)), none, onto)

    return F.when(F.length(unit) > 0, F.aggregate(ordered, first, step, back))


def viterbi(unit: Column, edges: Column, longest: int = 0, unknown: float = 1e4) -> Column:
    """array<string>: the unit's path of the highest sum of scores."""
    return F.transform(best_path(unit, edges, unknown), lambda p: F.substring(unit, p["end"] - p["len"] + 1, p["len"]))


def piece_ids(unit: Column, parts: Column, first_byte: int | None) -> Column:
    """array<int>: ids of pieces; of one that isn't in the vocabulary, the ids of its bytes, which follow one another."""
    text = lambda p: F.hex(F.encode(F.substring(unit, p["end"] - p["len"] + 1, p["len"]), "UTF-8"))
    octets = lambda h: F.transform(F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)), lambda k: F.conv(F.substring(h, k, F.lit(2)), 16, 10).cast("int") + first_byte)
    lost = (lambda p: F.array().cast("array<int>")) if first_byte is None else (lambda p: octets(text(p)))
    each = lambda ps: F.flatten(F.transform(ps, lambda p: F.when(p["id"].isNull(), lost(p)).otherwise(F.array(p["id"]))))
    # An array of the one array of parts, so that it is worked out once.
    return F.get(F.transform(F.array(parts), lambda ps: F.when(F.exists(ps, lambda p: p["id"].isNull()), each(ps)).otherwise(F.transform(ps, lambda p: p["id"]))), F.lit(0))


def encoded_units(distinct: DataFrame, pieces: DataFrame, unigram: bool = False) -> DataFrame:
    """unit, ids of every unit."""
    longest, first_byte = pieces.agg(F.max(F.length("piece")), F.min(F.when(F.col("is_byte"), F.col("id")))).first()
    rows = lattice(distinct, pieces, longest)
    fold = best_path if unigram else merged
    return rows.select("unit", piece_ids(F.col("unit"), fold(F.col("unit"), F.col("edges")), first_byte).alias("ids"))


# ---- over documents -----------------------------------------------------------------------------


def _frequent(docs: DataFrame, model: str) -> DataFrame:
    """unit: MEMORY units at most, the most frequent ones of a sample of SAMPLE characters."""
    sizes = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    share = min(1.0, SAMPLE / max(1, sizes[1] or 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, held = splitter(model).units, Counter()
        out = lambda: pa.RecordBatch.from_pydict({"unit": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    held.update(units(" " + text))
                if len(held) > COUNTED:
                    yield out()
                    held.clear()
        yield out()

    some = docs.select("text") if share == 1 else docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = some.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.length("unit") <= HELD_LENGTH), "units")
    # As many rows as there are different counts, fewer than the root of twice the sample's size.
    least, room = 1 << 62, MEMORY
    for n, k in sorted(((r.n, r.k) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True):
        room -= k
        if room < 0:
            break
        least = n
    return counts.where(F.col("n") >= least).select("unit")


def _dealt(units: DataFrame) -> DataFrame:
    """Rows of unit, dealt by it, about TASK_UNITS to a task: lattices are far larger than the units that an adaptive plan sees."""
    return units.repartition(max(1, -(-units.count() // TASK_UNITS)), "unit")


def encode(docs: DataFrame, model: str, unigram: bool = False, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """row, the columns to keep, ids array<int> of every document; row numbers the rows."""

    def lists(kept: list[pa.Array], ends: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        return [*kept, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]

    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, F.col("text").cast("string").alias("_text"))
    return _encoded(rows, model, unigram, lists, [*rows.schema.fields[:-1], StructField("ids", ArrayType(IntegerType()))])


def _encoded(rows: DataFrame, model: str, unigram: bool, make: Callable[[list[pa.Array], np.ndarray, np.ndarray], list[pa.Array]], fields: list[StructField]) -> DataFrame:
    """make(other columns, ends, ids) of batches of rows, whose last column is the text; row k's ids are ids[ends[k]:ends[k + 1]].

    Texts are read twice and split in place. The first time, units that aren't held give their places in the text,
    which meets their ids by an equi-join; a text is known by 16 bytes of its hash, so that copies ask once. The
    second time a document's ids, with a mark for each unit that isn't held, meet those ids.
    """
    spark = rows.sparkSession
    small_batches(spark)
    if not unigram and not orderly(model):
        raise ValueError("a piece of this vocabulary is made of pieces with worse scores")
    pieces = piece_table(spark, model)
    hole = max(k for _, k, _, _ in vocabulary(model)) + 1
    code = "<u2" if hole < 1 << 16 else "<u4"
    plain = rows.select(F.col(rows.columns[-1]).alias("text"))
    top = encoded_units(_dealt(_frequent(plain, model)), pieces, unigram).toArrow()
    memory = spark.sparkContext.broadcast(Held({u: np.array(i, code).tobytes() for u, i in zip(top.column("unit").to_pylist(), top.column("ids").to_pylist(), strict=True)}))

    def lacking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, seen, number = memory.value, set(), TaskContext.get().partitionId() << 32
        split = splitter(model)
        for batch in batches:
            numbers, at, units, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = split.lacking(text, held)
                if found and (key := _key(text)) not in seen:
                    seen.add(key)
                    number += 1
                    numbers += [number] * len(found)
                    at += range(len(found))
                    units += found
                    keys += [key] + [None] * (len(found) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(at, pa.int32()), pa.array(units, pa.string()), pa.array(keys, pa.binary())], names=["text", "pos", "unit", "key"])

    # A text's number is settled once it is written. Copies in several tasks have several numbers; one of them is used.
    places = written(plain.mapInArrow(lacking, "text long, pos int, unit string, key binary"), "places")
    keys = places.where("key IS NOT NULL").groupBy("key").agg(F.min("text").alias("text"))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype(code).tobytes()
            size = np.dtype(code).itemsize
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array([flat[a * size : b * size] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=["unit", "ids"])

    known = encoded_units(_dealt(written(places.select("unit").distinct(), "rare")), pieces, unigram).mapInArrow(packed, "unit string, ids binary")

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's ids in the order of their places: rows of a text follow one another."""
        last, held = None, []

        def out(done: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
            names, fills = zip(*done, strict=True) if done else ((), ())
            sizes = [np.array([len(f) for f in fill], "<u4").tobytes() for fill in fills]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.binary()), pa.array([b"".join(f) for f in fills], pa.binary())], names=["text", "sizes", "fill"])

        for batch in batches:
            done = []
            for text, ids in zip(batch.column("text").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if text != last:
                    if held:
                        done.append((last, held))
                    last, held = text, []
                held.append(ids)
            yield out(done)
        yield out([(last, held)] if held else [])

    found = places.select("text", "pos", "unit").join(known, "unit").select("text", "pos", "ids")
    answers = found.repartition("text").sortWithinPartitions("text", "pos").mapInArrow(gathered, "text long, sizes binary, fill binary")
    answers = written(answers.join(keys, "text").select("key", "sizes", "fill"), "answers")

    given = [f"c{k}" for k in range(len(rows.columns) - 1)]  # names of our own, whatever the columns' are
    kinds = [f.dataType for f in rows.schema.fields[:-1]]

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        held, n = memory.value, 0
        press, gap, task = zstandard.ZstdCompressor(level=3).compress, np.array([hole], code).tobytes(), TaskContext.get().partitionId()
        split = splitter(model)
        for batch in batches:
            keys, parts = [], []
            for text in batch.column(len(given)).to_pylist():
                whole = b"".join(split.encoded(text, held, gap))
                # A text that lacks nothing gets a key that no other has.
                lacks = bool((np.frombuffer(whole, code) == hole).any())
                keys.append(_key(text) if lacks else f"{task}/{(n := n + 1)}".encode())
                parts.append(press(whole))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(given)], pa.array(keys, pa.binary()), pa.array(parts, pa.binary())], names=[*given, "key", "parts"])

    def filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            each = [np.frombuffer(unpress(p), code) for p in batch.column("parts").to_pylist()]
            sizes = np.frombuffer(b"".join(x or b"" for x in batch.column("sizes").to_pylist()), "<u4") // np.dtype(code).itemsize
            fill = np.frombuffer(b"".join(x or b"" for x in batch.column("fill").to_pylist()), code)
            ids, grown = put_in(np.concatenate(each) if each else np.zeros(0, code), hole, sizes.astype(np.int64), fill)
            ends = np.cumsum([0, *map(len, each)])
            ends = ends + np.concatenate([[0], np.cumsum(grown)])[ends]
            yield pa.RecordBatch.from_arrays(make(list(batch.columns[: len(given)]), ends, ids.astype(np.int32)), names=out.names)

    out = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    mid = StructType([*(StructField(c, t) for c, t in zip(given, kinds, strict=True)), StructField("key", BinaryType()), StructField("parts", BinaryType())])
    whole = rows.toDF(*given, "text").mapInArrow(marked, mid).join(answers, "key", "left")
    return whole.select(*given, "parts", "sizes", "fill").mapInArrow(filled, out).toDF(*[f.name for f in fields])


def put_in(ids: np.ndarray, hole: int, sizes: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids with the k-th hole replaced by the next sizes[k] of fill, and by how much each place of ids grows."""
    holes = ids == hole
    if int(holes.sum()) != len(sizes):
        raise ValueError("a text's units and their ids don't match")
    lengths = np.ones(len(ids), np.int64)
    lengths[holes] = sizes
    out = np.empty(int(lengths.sum()), ids.dtype)
    filled = np.repeat(holes, lengths)
    out[~filled], out[filled] = ids[~holes], fill
    return out, lengths - 1


def _key(text: str) -> bytes:
    from hashlib import blake2b

    return blake2b(text.encode(), digest_size=16).digest()


def text_of(ids: Iterable[int], octets: list[bytes]) -> bytes:
    """The pieces' bytes put together, without the space in front."""
    return b"".join(map(octets.__getitem__, ids)).removeprefix(b" ")


def decode(docs: DataFrame, model: str) -> DataFrame:
    """docs with ids to docs with text. Bytes that aren't UTF-8 become replacement marks; null ids, a null text."""
    octets, docs = piece_bytes(model), docs.drop("text")
    at = docs.columns.index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else text_of(ids, octets).decode("utf-8", "replace") for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("text", StringType())]))


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


def op9_sentencepiece(spark, sf_dir):
    """doc_id, n_tokens, ids_crc32 (of ids as little-endian unsigned 32-bit integers), round_trip (decoding gives the text back)."""
    model = tokenizer_path("piece_bpe_32k.model")
    octets = piece_bytes(model)

    def digests(kept: list[pa.Array], ends: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        from hashlib import sha256

        each = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        same = [sha256(text_of(x.tolist(), octets)).digest() == d for x, d in zip(each, kept[1].to_pylist(), strict=True)]
        return [kept[0], pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()), pa.array(same, pa.bool_())]

    text = F.col("text").cast("string")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"), text.alias("text"))
    fields = [StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType()), StructField("round_trip", BooleanType())]
    return _encoded(rows, model, False, digests, fields)
