"""SimHash near-duplicates by BK-trees.

A text's fingerprint has a bit for each position that is set in over half of the hashes of its three-word shingles;
fingerprints link at two or fewer differing bits; documents that links connect form a group.

BK-trees: a node's children are keyed by their integer Hamming distance to it, and a search follows only edges within
the radius. One tree over all fingerprints, or a broadcast of all shard trees, would grow with the corpus and make each
search pass over a good part of it, as distances of unrelated fingerprints all lie near 32. So the shards follow the
pigeonhole rule instead: two fingerprints that differ in two bits agree in two of their four 16-bit blocks, and each of
the six pairs of blocks with its 32 bits names a shard; a fingerprint is sought in its own six shards only, which loses
no link. A shard beyond tree_max fingerprints is split by the same rule over its other bits; what is still larger is dealt
to several trees, each built in one task, and each of its fingerprints is sought in all of them: memory stays bounded,
however hot a shard is, and so does the number of trees.

Copies meet in a map-side combined aggregation and are one fingerprint afterwards. A task returns only the links that
join groups it hasn't joined yet. The groups come from components().

Cases: a null text is an empty one; texts without words have fingerprint zero and link like any other. Fewer than three
words are one shingle. A null id never is a group's least id, unless all its ids are null (component_id null). Rows
with equal ids keep a row each. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read, row_keys, text_bytes
from .components import components

RADIUS = 2
TREE_MAX = 20_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes) -> int:
    """Of a text in UTF-8, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(3, len(words))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    for i in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.set_column(b.schema.get_field_index("text"), "fp", pa.array([fingerprint(t) for t in b.column("text").to_pylist()], pa.int64()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), text_bytes(text_col).alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, k1 long, k2 long, fp long")


class BKTree:
    """Integers under Hamming distance; children are keyed by the distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, node = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while at:
            d = (self.values[node] ^ value).bit_count()
            if d not in self.children[node]:
                self.children[node][d] = at
                return
            node = self.children[node][d]

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The values at the radius at most. A child at distance d from its parent can hold such only if d differs from the parent's distance by the radius at most."""
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield self.values[node]
            edges = self.children[node]
            todo += [edges[x] for x in range(d - radius, d + radius + 1) if x in edges]


class Groups:
    """Union-find over what one task has seen of one shard."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _tree_links(radius: int):
    mask = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, groups = None, BKTree(), Groups()
        for b in batches:
            a: list[int] = []
            c: list[int] = []
            for key, sub, target, own, fp in zip(*(b.column(x).to_pylist() for x in ("key", "sub", "target", "own", "fp"))):
                if (key, sub, target) != shard:
                    shard, tree, groups = (key, sub, target), BKTree(), Groups()
                met = set()
                for other in tree.within(fp & mask, radius):
                    root = groups.root(other)
                    if groups.join(fp & mask, other) if own else root not in met:
                        met.add(root)
                        a.append(fp)
                        c.append(other - (1 << 64) if other >> 63 else other)
                if own:
                    tree.add(fp & mask)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return run


PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
#: Bits of the three parts of the other two blocks, by which hot shards are split.
PARTS = ((0, 11), (11, 11), (22, 10))


def shard_keys(fp: str = "fp"):
    """The six pairs of 16-bit blocks, each as the pair's number and its 32 bits (key), and the other two blocks' bits (rest)."""
    block = [F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    both = lambda i, j: F.shiftleft(block[i], 16).bitwiseOR(block[j])
    others = [tuple(k for k in range(4) if k not in p) for p in PAIRS]
    return F.array(*[F.struct(F.lit(n << 32).bitwiseOR(both(*p)).alias("key"), both(*o).alias("rest")) for n, (p, o) in enumerate(zip(PAIRS, others))])


def links(distinct: DataFrame, radius: int = RADIUS, tree_max: int = TREE_MAX) -> DataFrame:
    """distinct: fp, each once. Links (a, b) that connect the same fingerprints as all pairs within the radius do, which is at most two.

    In a shard of more than tree_max fingerprints the pigeonhole rule holds again: of three parts of the other two blocks
    one at least agrees, so it becomes three times as many shards of 10 or 11 bits more, each of 2^22 fingerprints at most."""
    if radius > 2:
        raise ValueError("four blocks, of which two agree, hold for a radius of two at most")
    keyed = distinct.select("fp", F.inline(shard_keys()))
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = keyed.join(sizes, "key")
    part = [F.lit(i << 11).bitwiseOR(F.shiftright("rest", at).bitwiseAND(F.lit((1 << n) - 1))) for i, (at, n) in enumerate(PARTS)]
    subs = F.when(F.col("n") > tree_max, F.array(*part)).otherwise(F.array(F.lit(-1).cast("long")))
    rows = rows.select("fp", "key", F.explode(subs).alias("sub"))
    trees = F.ceil(F.col("m") / tree_max).cast("int").alias("trees")
    hot = sizes.filter(F.col("n") > tree_max).select("key")
    parts = materialise(rows.filter("sub >= 0").groupBy("key", "sub").agg(F.count("*").alias("m"))) if not hot.isEmpty() else None
    whole = rows.filter("sub < 0").select("fp", "key", "sub", F.lit(1).alias("trees"))
    if parts is not None:
        whole = whole.union(rows.filter("sub >= 0").join(parts.filter("m > 1"), ["key", "sub"]).select("fp", "key", "sub", trees))
    rows = whole.select("fp", "key", "sub", "trees", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("target"))
    rows = rows.select("key", "sub", "target", (F.pmod(F.xxhash64("fp"), F.col("trees")) == F.col("target")).alias("own"), "fp")
    dealt = rows.repartition("key", "sub", "target").sortWithinPartitions("key", "sub", "target", F.desc("own"), "fp")
    return dealt.mapInArrow(_tree_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree_max: int = TREE_MAX) -> DataFrame:
    """A row for each document: doc_id, k1 and k2 (keys of the row), fp, grp (the group's own key, its least fingerprint), component_id (its least id)."""
    fps = materialise(fingerprints(docs, id_col, text_col))
    first = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = materialise(components(links(first.select("fp"), tree_max=tree_max)))
    of = first.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("grp"))
    least = of.groupBy("grp").agg(F.min("least").alias("component_id"))
    # Written, so that its size decides the join below, and both of its sides are plain shuffles, which adaptive execution can split where a fingerprint is hot.
    named = materialise(of.select("fp", "grp").join(least, "grp"))
    return fps.join(named, "fp").select("doc_id", "k1", "k2", "fp", "grp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that of the least id, with all its columns. Groups are told apart by their own keys, so
    rows of other groups with the same id, or with null ids, stay. Of a group's rows that share the least id, one stays:
    that of the least key."""
    named = near_duplicates(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    firsts = named.groupBy("grp").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2")
    rows = docs.select(*row_keys(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(firsts, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
