"""Near-duplicate documents by SimHash fingerprints and bit-sliced comparison.

Fingerprints are taken in place and equal ones become one node. Keys bring together nodes that may
link: the pigeonhole principle gives keys that miss no link. In a group of a key, fingerprints stand as bit
planes, 64 rows to a word, and many distances are counted at once by carry-save bitwise
counters; a word is abandoned once its rows are all beyond the radius. A group yields links from each
node to the least node it is connected with in the group, never all pairs. Larger groups are cut
into blocks, and each pair of blocks is a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import majority, mask, planes_of, probe, set_rows, short_links
from .common import cut, join_names, table, written
from .components import components
from .near import deduplicated, near_groups, words  # noqa: F401 - the near-duplicate stage's names are kept here

#: Rows of a group above which it is cut into pairs of blocks.
BLOCK = 16384
#: Runs up to this length are compared by shifts of the planes, longer ones by probes.
SHORT = 24

# ---- fingerprints -------------------------------------------------------------------------------


def shingle_print(text: bytes | None, k: int = 4, seed: int = 42) -> int:
    """64 bits from the XXH64 of every k-word shingle, repeats included; no words: 0."""
    import xxhash

    w = words(text)
    if not w:
        return 0
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()
    if len(w) <= k:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, last[k - 1 :], strict=False)]
    return int(majority(np.array(hashes, np.uint64)[:, None])[0])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))


# ---- links of a group -----------------------------------------------------------------------------


class _Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def run_links(planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """For the n rows of one group: each row's least row that links lead to.

    A row is a probe against all others at once. Rows need no further probe once those that weren't
    probes are all in one set, since only links between sets could change anything.
    """
    sets = _Sets(n)
    labels, probed, everyone = np.arange(n), np.zeros(n, bool), mask(np.ones(n, bool))
    while True:
        waiting = np.flatnonzero(~probed)
        if len(waiting) < 2:
            break
        sizes = np.bincount(labels[waiting], minlength=n)
        largest = int(sizes.argmax())
        if sizes[largest] == len(waiting):
            break
        first = int(waiting[0]) if sizes[largest] == 1 else int(waiting[labels[waiting] != largest][0])
        got = set_rows(probe(planes, first, radius, everyone))
        probed[first] = True
        if len(got) > 1:
            for x in np.unique(labels[got]).tolist():
                sets.join(first, x)
            labels = np.array([sets.root(x) for x in range(n)]) if n < 512 else _relabel(labels, sets)
    return labels


def _relabel(labels: np.ndarray, sets: _Sets) -> np.ndarray:
    names, where = np.unique(labels, return_inverse=True)
    return np.array([sets.root(int(x)) for x in names])[where]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def group_links(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Links of whole groups, rows sorted by key."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edges)
    out = []
    short = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
    if short.any():
        a, b = short_links(keys[short], prints[short], radius, int(sizes[sizes <= SHORT].max()))
        out.append((nodes[short][a], nodes[short][b]))
    for k in np.flatnonzero(sizes > SHORT):
        rows = slice(edges[k], edges[k + 1])
        order = np.argsort(nodes[rows], kind="stable")
        mine = nodes[rows][order]
        label = run_links(planes_of(prints[rows][order]), len(mine), radius)
        linked = label != np.arange(len(mine))
        out.append((mine[linked], mine[label[linked]]))
    if out:
        a, b = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
        differ = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[differ]), pa.array(b[differ])], schema=_LINKS)


def links(keyed: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """keyed: node long (a print), t int, key long. a long, b long of linked nodes."""
    many = keyed.groupBy("t", "key").agg(F.count("*").alias("rows")).where("rows > 1")
    grouped = keyed.join(many, ["t", "key"])
    n_blocks = F.ceil(F.col("rows") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    pair = F.when(F.col("rows") > block, F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j"))))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = grouped.withColumn("p", F.explode(F.coalesce(pair, whole))).select(F.xxhash64("t", "key", "p.i", "p.j").alias("g"), "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, fps = [], [], []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys.append(np.asarray(batch.column("g")))
            nodes.append(np.asarray(batch.column("node")))
            fps.append(nodes[-1].view(np.uint64)[:, None])
            held += batch.num_rows
            if held >= 32768 and keys[-1][-1] != keys[0][0]:
                k, v, p = np.concatenate(keys), np.concatenate(nodes), np.concatenate(fps)
                end = np.searchsorted(k, k[-1], "left")  # the last group may go on
                yield from group_links(k[:end], v[:end], p[:end], radius)
                keys, nodes, fps, held = [k[end:]], [v[end:]], [p[end:]], len(k) - end
        if held:
            yield from group_links(np.concatenate(keys), np.concatenate(nodes), np.concatenate(fps), radius)

    return rows.repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, "a long, b long").distinct()


# ---- the contract's operator: 64 bits, small radius ---------------------------------------------


def pigeonhole(n: int, radius: int, bits: int = 64) -> list[int]:
    """Masks of which any two prints within radius agree on one: bits in blocks, all choices of the blocks left over.

    More blocks make longer keys, so that groups stay small for more prints.
    """
    spare = 1
    while spare < 4 and bits * spare // (radius + spare) < math.log2(max(n, 2)) + 2:
        spare += 1
    ends = [round(bits * k / (radius + spare)) for k in range(radius + spare + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(ends, ends[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def clusters(docs: DataFrame, k: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id long, fingerprint string, component_id long of every row of (doc_id, text).

    Prints link at `radius` or fewer differing bits; component_id is the least doc_id reachable, the
    row's own included. Cases: null and empty texts and white space alone have print zero, linked like any
    other. Repeated rows stay, each with its component. A row with a null doc_id links like any other and
    gets a row; a component in which no row has a doc_id has a null name. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([shingle_print(t, k) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    prints = written(_texts(docs).mapInArrow(run, "doc_id long, fp long"), "simhash")
    # A node is a print, whoever has it; documents meet again only for their component's name.
    nodes = cut(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")))
    masks = pigeonhole(nodes.count(), radius)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("node").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for t, m in enumerate(masks)])
    keyed = nodes.select("node", F.explode(keys).alias("k")).select("node", "k.t", "k.key")
    found = components(links(keyed, radius, block))
    named = nodes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    plain = written(named.join(names, "component").select(F.col("node").alias("fp"), "component_id"), "simhash-names")
    whole = join_names(prints, plain, "fp")
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_near_dedup(spark, sf_dir):
    return clusters(table(spark, sf_dir, "documents"))
