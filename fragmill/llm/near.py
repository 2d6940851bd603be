"""Documents alike in their shingles: keys that miss no pair, SimHash prints compared bit-sliced, exact Jaccard similarity at the end.

Texts become nodes, equal ones the same node. Shingles of a text stand in one order for all texts, rare ones first; two
sets of the wanted similarity share a shingle among the first of each (prefix filter). In a group of texts that share one,
128-bit SimHash prints of the whole sets stand as bit planes and are compared many at once; pairs beyond the radius, such
as texts that have only a passage in common, go no further, nor do pairs whose 1024-bit prints are too far apart. What
is left is compared by whole sets.

First each text meets one print near its own in a group, then the nearest of those it isn't linked with. What these links
don't connect and what may still link is brought together by cluster, so that a text's set travels once for a block of a
cluster and not once for a pair, and compared there pair by pair. The radius is over five standard deviations beyond what pairs of
similarity 0.8 differ by, so that about one such pair in thirty million is lost there. Shingles and texts are known by
64-bit hashes.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import leader_links, majority, mask, planes_of, probe, set_rows, short_links, within
from .common import join_names, small_batches, written
from .components import components

#: Texts looked at for the order of shingles, and how many must hold a shingle for it to count as common.
SAMPLE, COMMON = 10_000, 8
#: Texts of a shingle up to which all pairs are found at once.
SMALL = 16
#: Differing bits, of 128, up to which a text's first link is sought and a pair is compared at all. Pairs of
#: similarity 0.8 differ by 19 bits on average (24 in very short texts), unlike texts by 64.
TIGHT, RADIUS = 28, 48
#: Texts of a shingle, by the sample, above which they are dealt to several tasks.
SPREAD = 2048
#: Rows of a shingle above which the second round cuts it into pairs of blocks.
BLOCK = 16384
#: Rows and bytes of a cluster above which it is cut into pairs of blocks, where prints and where whole sets are compared.
PRINT_BLOCK, SET_BLOCK, BLOCK_BYTES = 8192, 2048, 16 << 20
#: Rows up to which a table of names goes to every task (17 bytes each and a hash table), so that whole texts stay where they are.
SENT = 2_000_000
#: Of a text's shingles that are dealt to several tasks, those that give pairs in the first round.
FIRST = 4
#: Words of a wide print; nearest texts that a text's links are sought among before all pairs are compared.
WIDE, NEAREST = 16, 2
#: Buckets that a set's shingles are counted in.
BUCKETS = 256


def words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """The set of k-word shingles as sorted hashes; a text of fewer words is one shingle, one of none has none."""
    import xxhash

    w = np.array([xxhash.xxh64_intdigest(x) for x in words(text)], np.uint64)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = _mix(h + w[j : len(w) - k + 1 + j] + np.uint64(j + 1))
    return np.unique(h)


def sketch(h: np.ndarray) -> np.ndarray:
    """128 bits of a set of hashes: two words of the SimHash over two mixes of each."""
    with np.errstate(over="ignore"):
        return majority(np.stack([_mix(h + np.uint64(0x5851F42D4C957F2D)), _mix(h ^ np.uint64(0x14057B7EF767814F))], axis=1))


def wide_print(h: np.ndarray) -> np.ndarray:
    """1024 bits of a set of hashes: the SimHash over sixteen mixes of each."""
    with np.errstate(over="ignore"):
        salts = _mix(np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return majority(_mix(h[:, None] + salts[None, :]))


def wide_radius(sizes: np.ndarray) -> np.ndarray:
    """Differing bits, of 1024, that a pair of similarity 0.8 exceeds about once in a billion times, by the smaller set's size.

    Such pairs differ by 155 bits on average, and up to 192 where sets are so small that many bits are ties; the
    standard deviation is below 12.5.
    """
    return np.where(sizes >= 64, 232, 270)


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id long, node long, text binary. A null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("node"), text.cast("binary").alias("text"))


def _common(nodes: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of shingles common in a sample, in how many of its texts, and how many texts one stands for."""
    every = max(1, nodes.count() // SAMPLE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, k).view(np.int64))], names=["token"])

    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("node", "text").dropDuplicates(["node"])
    found = sample.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).toArrow()
    tokens, n = np.asarray(found.column("token")).view(np.uint64), np.asarray(found.column("n"))
    order = np.argsort(tokens)
    return tokens[order], n[order], every


def _need(similarity: float) -> tuple[int, int]:
    t = Fraction(str(similarity))
    return t.numerator, t.denominator


def first_shingles(h: np.ndarray, common: tuple[np.ndarray, np.ndarray, int], p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a set's sorted hashes those that a set of similarity p/q shares at least one of, and in how many of the sample."""
    tokens, n, _ = common
    seen = np.zeros(len(h), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
        seen = np.where(tokens[at] == h, n[at], 0)
        if seen.any():
            order = np.lexsort((h, seen))
            h, seen = h[order], seen[order]
    keep = len(h) - -(-p * len(h) // q) + 1
    return h[:keep], seen[:keep]


_TOKENS = pa.schema([("g", pa.int64()), ("node", pa.int64()), ("sl", pa.int64()), ("token", pa.int64()), ("kind", pa.int8()), ("s0", pa.int64()), ("s1", pa.int64())])
_FOUND = pa.schema([("kind", pa.int8()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])


def _tokens(nodes: DataFrame, common: tuple[np.ndarray, np.ndarray, int], k: int, p: int, q: int) -> DataFrame:
    """A row a text and first shingle. sl: size of the set << 32 | shingles from this one on in the order. s0, s1: the print.

    kind 0: g is the shingle. Otherwise the shingle is dealt to several g; 1: gives pairs in the first round, 2: doesn't.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, every = shared.value, shared.value[2]
        done: set[int] = set()
        for batch in batches:
            parts = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if node in done:
                    continue
                done.add(node)
                h = shingles(text, k)
                first, seen = first_shingles(h, held, p, q) if len(h) else (np.zeros(1, np.uint64), np.zeros(1, np.int64))
                ways = (-(-seen * every // SPREAD)).astype(np.uint64)
                dealt = ways > 1
                with np.errstate(over="ignore"):
                    # Each shingle deals texts in a way of its own, so that the tasks' texts overlap.
                    way = _mix(first ^ np.uint64(node % (1 << 64))) % np.maximum(ways, 1)
                    g = np.where(dealt, _mix(first + way * np.uint64(0x9E3779B97F4A7C15)), first)
                kind = np.where(dealt, np.where(np.cumsum(dealt) <= FIRST, 1, 2), 0).astype(np.int8)
                sl = (len(h) << 32) + len(h) - np.arange(len(first), dtype=np.int64)
                s0, s1 = (np.full(len(first), x, np.int64) for x in sketch(h).view(np.int64))
                parts.append((g.view(np.int64), np.full(len(first), node, np.int64), sl, np.where(dealt, first, 0).astype(np.uint64).view(np.int64), kind, s0, s1))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], schema=_TOKENS)

    return nodes.select("node", "text").mapInArrow(run, "g long, node long, sl long, token long, kind byte, s0 long, s1 long")


def may_link(sl_a: np.ndarray, sl_b: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether sets can have the similarity if this is their first common shingle."""
    low = (1 << 32) - 1
    return np.minimum(sl_a & low, sl_b & low) * (p + q) >= p * ((sl_a >> 32) + (sl_b >> 32))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct rows (least, greatest)."""
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def _rows_of(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of one kind; columns that aren't given are zero."""
    n = len(columns[0])
    rest = [np.zeros(n, np.int64)] * (5 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *(pa.array(c) for c in (*columns, *rest))], schema=_FOUND)


def first_round(g, node, sl, token, kind, p: int, q: int, prints: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Whole groups sorted by g and node: a first link of a text (0, a, b), other pairs of small groups (2, a, b), rows of large groups (1, shingle, node, sl, print)."""
    prints = np.zeros((len(g), 2), np.uint64) if prints is None else prints
    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (node[1:] != node[:-1])])
    g, node, sl, token, kind, prints = g[fresh], node[fresh], sl[fresh], token[fresh], kind[fresh], prints[fresh]
    edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    run = np.repeat(np.diff(edges), np.diff(edges))
    links, others = [], []
    small = np.flatnonzero((kind == 0) & (run <= SMALL) & (run > 1))
    if len(small):
        a, b = (small[x] for x in short_links(g[small], prints[small], RADIUS, SMALL))
        at = may_link(sl[a], sl[b], p, q)
        a, b = a[at], b[at]
        near = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1) <= TIGHT
        least = np.full(len(g), len(g))
        np.minimum.at(least, b[near], a[near])  # rows of a group are in the order of their nodes
        first = near & (least[b] == a)
        links.append(_pairs(node[a[first]], node[b[first]]))
        others.append(_pairs(node[a[~first]], node[b[~first]]))
    large = (kind > 0) | (run > SMALL)
    for lo, hi in zip(edges, edges[1:], strict=False):
        if large[lo] and kind[lo] < 2:
            rows = np.arange(lo, hi)
            rows = rows[kind[rows] < 2]
            a, b = leader_links(prints[rows], TIGHT)
            a, b = rows[a], rows[b]
            at = may_link(sl[a], sl[b], p, q)
            links.append(_pairs(node[a[at]], node[b[at]]))
    links = np.unique(np.concatenate(links), axis=0) if links else np.zeros((0, 2), np.int64)
    yield _rows_of(0, links[:, 0], links[:, 1])
    if large.any():
        name = np.where(kind > 0, token, g)[large]
        yield _rows_of(1, name, node[large], sl[large], *prints[large].view(np.int64).T)
    if others:
        others = np.unique(np.concatenate(others), axis=0)
        yield _rows_of(2, others[:, 0], others[:, 1])


def second_round(node: np.ndarray, sl: np.ndarray, label: np.ndarray, p: int, q: int, prints: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """One group's pairs of different labels, of prints within the radius."""
    names, which = np.unique(label, return_inverse=True)
    most = int(np.bincount(which).argmax())
    planes = None if prints is None else planes_of(prints)
    held, n = [], 0
    for r in np.flatnonzero(which != most):
        # Of two rows outside of the largest label the one of the lesser node looks at the other.
        other = (which == most) | ((which != which[r]) & (node > node[r]))
        other &= may_link(sl, sl[r], p, q)
        rows = np.flatnonzero(other) if planes is None else set_rows(probe(planes, int(r), RADIUS, mask(other)))
        held.append(_pairs(node[rows], np.full(len(rows), node[r])))
        n += len(held[-1])
        if n > 1 << 18:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


class _Joined:
    """Rows by what they are joined with: sets of rows, numbered."""

    def __init__(self, which: np.ndarray):
        self.which = which.copy()

    def join(self, row: int, rows: np.ndarray) -> np.ndarray:
        """Joins a row with others; of those the ones that were needed, one a set."""
        sets, first = np.unique(self.which[rows], return_index=True)
        fresh = sets != self.which[row]
        if fresh.any():
            self.which[np.isin(self.which, sets[fresh])] = self.which[row]
        return rows[first[fresh]]


def second_links(node: np.ndarray, sl: np.ndarray, label: np.ndarray, p: int, q: int, prints: np.ndarray) -> np.ndarray:
    """One group's second_round() as fewer pairs than rows, which connect the same rows."""
    _, which = np.unique(label, return_inverse=True)
    most = int(np.bincount(which).argmax())
    planes, joined = planes_of(prints), _Joined(np.arange(len(node)))
    found = [np.zeros((0, 2), np.int64)]
    for r in np.flatnonzero(which != most).tolist():
        other = (joined.which != joined.which[r]) & (which != which[r])
        other &= may_link(sl, sl[r], p, q)
        rows = joined.join(r, set_rows(probe(planes, r, RADIUS, mask(other))))
        found.append(_pairs(node[rows], np.full(len(rows), node[r])))
    return np.concatenate(found)


def _wide_near(prints: np.ndarray, sizes: np.ndarray, r: int, other: np.ndarray, p: int, q: int) -> np.ndarray:
    """Of the rows set in other, those whose sizes and wide prints allow the similarity p/q with row r."""
    rows = np.flatnonzero(other & (np.minimum(sizes, sizes[r]) * q >= np.maximum(sizes, sizes[r]) * p))
    far = np.bitwise_count(prints[rows] ^ prints[r]).sum(axis=1, dtype=np.int64)
    return rows[far <= wide_radius(np.minimum(sizes[rows], sizes[r]))]


def print_links(node: np.ndarray, sizes: np.ndarray, label: np.ndarray, prints: np.ndarray, p: int, q: int) -> np.ndarray:
    """Fewer pairs than rows, which connect what pairs of different labels with near wide prints connect."""
    _, which = np.unique(label, return_inverse=True)
    most = int(np.bincount(which).argmax())
    joined = _Joined(np.arange(len(node)))
    found = [np.zeros((0, 2), np.int64)]
    for r in np.flatnonzero(which != most).tolist():
        rows = joined.join(r, _wide_near(prints, sizes, r, (joined.which != joined.which[r]) & (which != which[r]), p, q))
        found.append(_pairs(node[rows], np.full(len(rows), node[r])))
    return np.concatenate(found)


def set_links(node: np.ndarray, sets: list[np.ndarray], label: np.ndarray, prints: np.ndarray, p: int, q: int) -> np.ndarray:
    """Pairs of the similarity p/q which, with the labels, connect all that such pairs connect."""
    _, which = np.unique(label, return_inverse=True)
    most, at = int(np.bincount(which).argmax()), np.arange(len(node))
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    joined, held = _Joined(which), np.zeros(len(names), bool)
    found = [np.zeros((0, 2), np.int64)]
    for r in np.flatnonzero(which != most).tolist():
        # Of two rows outside of the largest label the first looks at the other.
        rows = _wide_near(prints, sizes, r, (joined.which != joined.which[r]) & ((which == most) | (at > r)), p, q)
        if not len(rows):
            continue
        own, ends = flat[starts[r] : starts[r] + sizes[r]], np.cumsum(sizes[rows])
        held[own] = True
        there = held[flat[np.repeat(starts[rows] - ends + sizes[rows], sizes[rows]) + np.arange(ends[-1])]]
        held[own] = False
        total = np.concatenate([[0], np.cumsum(there)])
        shared = total[ends] - total[ends - sizes[rows]]
        rows = joined.join(r, rows[shared * (p + q) >= p * (sizes[rows] + sizes[r])])
        found.append(_pairs(node[rows], np.full(len(rows), node[r])))
    return np.concatenate(found)


def nearest_pairs(node: np.ndarray, sl: np.ndarray, label: np.ndarray, p: int, q: int, prints: np.ndarray) -> np.ndarray:
    """One group's rows outside of the largest label, each with the row of another label that has the nearest print."""
    _, which = np.unique(label, return_inverse=True)
    most = int(np.bincount(which).argmax())
    found = []
    for r in np.flatnonzero(which != most):
        far = np.bitwise_count(prints ^ prints[r]).sum(axis=1, dtype=np.int64)
        far[(which == which[r]) | ~may_link(sl, sl[r], p, q)] = 1 << 10
        at = int(far.argmin())
        if far[at] <= RADIUS:
            found.append((node[r], node[at]))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return _pairs(a, b)


def _by_group(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups, rows sorted by the first column."""
    parts, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append([np.asarray(c) for c in batch.columns])
        held += batch.num_rows
        if held >= 1 << 18 and parts[-1][0][-1] != parts[0][0][0]:
            whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
            end = int(np.searchsorted(whole[0], whole[0][-1], "left"))  # the last group may go on
            yield [c[:end] for c in whole]
            parts, held = [[c[end:] for c in whole]], len(whole[0]) - end
    if held:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def counts(h: np.ndarray) -> np.ndarray:
    """Shingles in each bucket, 255 at most: two sets differ by as many shingles at least as their counts do."""
    return np.minimum(np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def alike(x: np.ndarray, y: np.ndarray, p: int, q: int) -> bool:
    """Whether two sorted sets have the similarity p/q. Their counts can rule it out without a merge."""
    both = len(x) + len(y)
    if int(np.abs(counts(x).astype(np.int64) - counts(y)).sum()) * (p + q) > (q - p) * both:
        return False
    merged = np.sort(np.concatenate([x, y]))
    return int((merged[1:] == merged[:-1]).sum()) * (p + q) >= p * both


def _each_cluster(rows: DataFrame, most_rows: int, data: str, links_of: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """a long, b long: links_of() whole clusters of rows (cluster, the binary column `data`, others), large ones in pairs of blocks."""
    sums = rows.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum(F.length(data)).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("rows") / most_rows, F.col("bytes") / BLOCK_BYTES)).cast("int")
    # Clusters of more than a block are fewer than the rows by that much.
    many = written(sums.select("cluster", blocks.alias("blocks")).where("blocks > 1"), "near-blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = F.when(F.col("blocks") > 1, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j"))))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = rows.join(F.broadcast(many), "cluster", "left").withColumn("p", F.explode(F.coalesce(pair, whole)))
    dealt = dealt.select(F.xxhash64("cluster", "p.i", "p.j").alias("g"), *[c for c in rows.columns if c != "cluster"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            pairs = links_of(pa.concat_batches(parts))
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        last, held = None, []
        for batch in batches:
            g = np.asarray(batch.column("g"))
            edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and g[lo] != last:
                    yield found(held)
                    held = []
                last = g[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield found(held)

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def _wide(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE)


def _clustered(edges: DataFrame, labels: Callable[[DataFrame], DataFrame], nodes: DataFrame, prints: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """a, b: links that connect what links among pairs of different labels connect, for edges that connect the ends of every such pair.

    labels(): a table of node with the column label. Clusters are cut down by wide prints first, so that few sets are needed.
    """
    spark = edges.sparkSession

    def by_prints(rows: pa.RecordBatch) -> np.ndarray:
        node, sizes, label = (np.asarray(rows.column(c)) for c in ("node", "size", "label"))
        return print_links(node, sizes.astype(np.int64), label, _wide(rows.column("print")), p, q)

    def by_sets(rows: pa.RecordBatch) -> np.ndarray:
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
        return set_links(np.asarray(rows.column("node")), sets, np.asarray(rows.column("label")), _wide(rows.column("print")), p, q)

    clusters = lambda edges: written(components(edges).withColumnRenamed("component", "cluster"), "near-clusters")
    rows = labels(clusters(edges).join(prints, "node"))
    rows = written(rows.select("cluster", "node", "label", "size", "print"), "near-rows")
    close = written(_each_cluster(rows, PRINT_BLOCK, "print", by_prints).distinct(), "near-close")
    _released(spark)
    close = clusters(close)
    named = rows.drop("cluster").join(close, "node")
    whole = named.join(_sets(nodes, close.select("node"), k), "node")
    return written(_each_cluster(written(whole, "near-sets"), SET_BLOCK, "set", by_sets).distinct(), "near-links")


def _sent(names: DataFrame) -> DataFrame:
    """A written table for a join: sent to every task if it has SENT rows at most."""
    return F.broadcast(names) if names.count() <= SENT else names


def _sets(nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node long, set binary of the wanted nodes, which are distinct."""
    # Texts that aren't wanted go before the others are moved.
    texts = nodes.join(_sent(written(wanted, "near-wanted")), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, k).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "set"])

    return texts.mapInArrow(sets, "node long, set binary")


def _prints(nodes: DataFrame, k: int) -> DataFrame:
    """node long, size int, print binary; a row a text and task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            found = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if node not in done:
                    done.add(node)
                    h = shingles(text, k)
                    found.append((node, len(h), wide_print(h).tobytes()))
            node, size, held = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(held, pa.binary())], names=["node", "size", "print"])

    return written(nodes.select("node", "text").mapInArrow(run, "node long, size int, print binary").distinct(), "wide-prints")


def _hopeful(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs whose wide prints lie within the radius: planes against planes, many pairs to a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (planes_of(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE)) for c in ("x", "y"))
            radii = wide_radius(np.minimum(np.asarray(batch.column("m")), np.asarray(batch.column("n"))))
            keep = np.zeros(batch.num_rows, bool)
            for radius in np.unique(radii).tolist():
                near = within(lambda k, at: x[k : k + 8, at] ^ y[k : k + 8, at], len(x), radius, mask(radii == radius))  # noqa: B023
                keep[set_rows(near)] = True
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(prints.toDF("a", "m", "x"), "a").join(prints.toDF("b", "n", "y"), "b")
    return written(joined.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long"), "near-pairs")


def _released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is written and no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _linked(pairs: DataFrame, nodes: DataFrame, prints: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """Of pairs a, b those whose sets have the similarity."""
    pairs = _hopeful(pairs, prints)
    _released(pairs.sparkSession)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("x", "y"))
            keep = [alike(x, y, p, q) for x, y in zip(*sets, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = written(_sets(nodes, ends, k), "shingle-sets")
    _released(pairs.sparkSession)
    joined = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
    return written(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links")


def linked(docs: DataFrame, k: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """node long, component long of texts that are alike in their k-word shingles, directly or by others between."""
    small_batches(docs.sparkSession)
    p, q = _need(similarity)
    nodes = _nodes(docs)
    tokens = _tokens(nodes, _common(nodes, k), k, p, q)
    both = lambda columns: np.stack(columns, axis=1).view(np.uint64)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, node, sl, token, kind, s0, s1 in _by_group(batches):
            yield from first_round(g, node, sl, token, kind, p, q, both((s0, s1)))

    found = written(tokens.repartition("g").sortWithinPartitions("g", "node").mapInArrow(first, "kind byte, x long, y long, z long, s0 long, s1 long"), "near-found")
    del tokens
    _released(docs.sparkSession)
    pairs = lambda kind: found.where(f"kind = {kind}").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    prints = _prints(nodes, k)
    links = _linked(pairs(0), nodes, prints, k, p, q)
    _released(docs.sparkSession)
    tried, groups = pairs(0), written(components(links), "near-groups")
    large = found.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("node"), F.col("z").alias("sl"), "s0", "s1")
    label = lambda df, node, name: df.join(groups.toDF(node, name), node, "left").withColumn(name, F.coalesce(name, node))

    def open_rows() -> DataFrame:
        """g, node, sl, label, s0, s1: large groups in pairs of blocks. Texts of one label have nothing left to find."""
        named = label(large, "node", "label")
        open_ = named.groupBy("token").agg(F.count("*").alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token", "rows")
        n_blocks = F.ceil(F.col("rows") / block).cast("int")
        own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
        rows = named.join(open_, "token").withColumn("p", F.explode(blocks)).select(F.xxhash64("token", "p.i", "p.j").alias("g"), "node", "sl", "label", "s0", "s1")
        return rows.repartition("g").sortWithinPartitions("g")

    def each_group(pairs_of):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, node, sl, name, s0, s1 in _by_group(batches):
                edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
                for lo, hi in zip(edges, edges[1:], strict=False):
                    for pair in pairs_of(node[lo:hi], sl[lo:hi], name[lo:hi], p, q, both((s0[lo:hi], s1[lo:hi]))):
                        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        return run

    # What lies nearest is linked first, so that few pairs of a large cluster are left to compare.
    for _ in range(NEAREST):
        more = open_rows().mapInArrow(each_group(lambda *group: [nearest_pairs(*group)]), "a long, b long")
        more = written(more.distinct().join(tried, ["a", "b"], "left_anti"), "near-more")
        if more.isEmpty():
            break
        tried, links = tried.union(more), links.union(_linked(more, nodes, prints, k, p, q))
        _released(docs.sparkSession)
        groups = written(components(links), "near-groups")
    others = label(label(pairs(2), "a", "of_a"), "b", "of_b").where("of_a <> of_b").select("a", "b")
    edges = open_rows().mapInArrow(each_group(lambda *group: [second_links(*group)]), "a long, b long").union(others)
    edges = written(edges.distinct(), "near-edges")
    if edges.isEmpty():
        return groups
    links = links.union(_clustered(edges, lambda df: label(df, "node", "label"), nodes, prints, k, p, q))
    _released(docs.sparkSession)
    return written(components(links), "near-groups")


def _rows(docs: DataFrame, **options) -> DataFrame:
    """doc_id long, node long, component long of every row."""
    named = written(_nodes(docs).select("doc_id", "node"), "near-nodes")
    groups = linked(docs, **options).select(F.col("node").alias("_linked"), "component")
    every = named.select("node").distinct().join(groups, F.col("node") == F.col("_linked"), "left").select("node", F.coalesce("component", "node").alias("component"))
    return join_names(named, written(every, "near-names"), "node")


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id long, component_id long of every row: the least doc_id among the rows of its group; null if none has one.

    Texts link when the Jaccard similarity of their k-word shingle sets (options k, similarity) is at
    least `similarity`; a group is what links connect. Texts without a word are all alike.
    """
    rows = written(_rows(docs, **options), "near-rows")
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return join_names(rows, written(least, "near-least"), "component").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one row of each near-duplicate group: the one of least doc_id stays, null being last.

    Rows are told apart by doc_id and text, so that rows of one doc_id with different texts go their own ways.
    """
    rows = written(_rows(docs, **options).groupBy("doc_id", "node", "component").agg(F.count("*").alias("n")), "near-rows")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
    marked = join_names(rows, written(best, "near-best"), "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node")))
    marked = written(marked.where("NOT stays OR n > 1").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "stays"), "near-marked")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64(text).alias("_key"))
    same = F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_node"))
    kept = whole.join(_sent(marked), same, "left_anti").select("_doc.*")
    repeated = marked.where("stays")
    if repeated.isEmpty():
        return kept
    return kept.union(whole.join(_sent(repeated), same, "left_semi").dropDuplicates(["_doc_id", "_key"]).select("_doc.*"))
