"""Near copies of documents by the similarity of their shingles.

A document is the set of its five-word shingles (ASCII case and white space don't count). Documents link if their sets'
Jaccard similarity is SIMILARITY at least, which is verified on the sets themselves; documents that links connect are one
group. Candidates are found in two ways. The first are the links of op7's fingerprints, by its BK-trees: two bits at most.
They alone lose links: two sets at 0.8 differ in some 10 of the 64 bits and often in 17. So the others share a band of
min-hashes: BANDS bands of ROWS min-hashes each. A pair at the similarity s shares none with probability
(1 - s^ROWS)^BANDS, at 0.8 about 1 in 38,000, above it less.

Equal sets are one set from the start, in a map-side combined aggregation, so that copies cost no pairs. Each set is
first compared with the least sets of its fingerprint, of those linked to it and of each of its bands, then, in bands that still hold different groups, the sets of
different groups with each other: a pair within a group would connect nothing new. Only the sets of candidates are made a
second time, by the keys of one document each; all else is shuffled as hashes.

Cases: a null text is an empty one. Fewer than five words are one shingle; texts without words are equal. Null and equal
ids as in keep_first(). An empty table gives no rows. Other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_keys, sliced, text_bytes
from .components import components
from .op7_simhash import fingerprint, links

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
#: Shingles whose min-hashes are taken at once.
CHUNK = 1 << 12

_RANDOM = np.random.default_rng(7)
FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The hashes of a text's five-word shingles, each once, in order."""
    words = text.lower().split()
    digest, k = xxhash.xxh3_64_intdigest, min(WORDS, len(words))
    return np.unique(np.array([digest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)] if words else [], dtype=np.uint64))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def set_hash(own: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(own.tobytes()))


def bands(own: np.ndarray) -> list[int]:
    """A hash for each band, of its number and its min-hashes."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(own), CHUNK):
        least = np.minimum(least, (own[i : i + CHUNK] * FACTORS + OFFSETS).min(axis=1))
    return [signed(xxhash.xxh3_64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        texts = b.column("text").to_pylist()
        sets = [shingles(t) for t in texts]
        made = (pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(list(map(fingerprint, texts)), pa.int64()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k1", "k2")), *made], names=["doc_id", "k1", "k2", "h", "n", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        sets = [shingles(t).view(np.int64) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(sets, pa.list_(pa.int64()))], names=["h", "own"])


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of set hashes that are similar enough. sets: h, own."""
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long")


def fingerprint_pairs(feats: DataFrame) -> DataFrame:
    """Pairs (a, b) of set hashes: each set with the least one of its fingerprint, and the least ones of fingerprints that op7's BK-trees link. feats: h, fp."""
    rows = materialise(feats.select("h", "fp").distinct())
    leads = materialise(rows.groupBy("fp").agg(F.min("h").alias("lead")))
    same = rows.join(leads, "fp").select(F.col("lead").alias("a"), F.col("h").alias("b"))
    one, two = (leads.select(F.col("fp").alias(f"fp_{x}"), F.col("lead").alias(x)) for x in "ab")
    near = links(leads.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(one, "fp_a").join(two, "fp_b").select("a", "b")
    both = same.union(near).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def set_groups(docs: DataFrame, feats: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(node, component) of the set hashes that links connect, as by all candidates, but without making all of them."""
    distinct = materialise(feats.groupBy("h").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct("k1", "k2")).alias("k")))
    own = Window.partitionBy("key").orderBy("h")
    first = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = distinct.select("h", "n", F.explode("bands").alias("key"))
    rows = keyed.select("key", "h", "n", F.first("h").over(first).alias("lead"), F.first("n").over(first).alias("lead_n"), F.lead("h").over(own).alias("next"))
    rows = materialise(rows.filter("h <> lead or next is not null").drop("next"))
    near = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9
    linked = materialise(fingerprint_pairs(feats))
    wanted = rows.select("h").union(linked.select(F.explode(F.array("a", "b")))).distinct().join(distinct.select("h", "k.k1", "k.k2"), "h")
    texts = docs.select(*row_keys(id_col, text_col), text_bytes(text_col).alias("text")).join(wanted, ["k1", "k2"]).select("h", "text")
    sets = materialise(texts.mapInArrow(_sets, "h long, own array<long>").dropDuplicates(["h"]))
    pairs = materialise(rows.filter(F.col("h") != F.col("lead")).filter(near("n", "lead_n")).select(F.col("lead").alias("a"), F.col("h").alias("b")).union(linked).distinct())
    groups = materialise(components(similar(sets, pairs, similarity)))
    named = materialise(rows.select("key", "h", "n").join(groups.select(F.col("node").alias("h"), "component"), "h", "left").withColumn("component", F.coalesce("component", "h")))
    mixed = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("key")
    held = named.join(mixed, "key", "left_semi")
    a, b = (held.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("h", "n", "component")]) for x in "ab")
    others = a.join(b, (a["key"] == b["key"]) & (F.col("component_a") < F.col("component_b")) & near("n_a", "n_b"))
    more = materialise(others.select(F.col("h_a").alias("a"), F.col("h_b").alias("b")).distinct())
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(similar(sets, more, similarity)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document: doc_id, k1 and k2 (keys of the row), grp (the group's own key), component_id (its least id)."""
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), text_bytes(text_col).alias("text"))
    feats = materialise(given.mapInArrow(_features, f"doc_id {kind}, k1 long, k2 long, h long, n long, bands array<long>, fp long"))
    first = feats.groupBy("h").agg(F.min("doc_id").alias("least"))
    groups = materialise(set_groups(docs, feats, id_col, text_col, similarity))
    of = first.join(groups.select(F.col("node").alias("h"), "component"), "h", "left").select("h", "least", F.coalesce("component", "h").alias("grp"))
    least = of.groupBy("grp").agg(F.min("least").alias("component_id"))
    # Written, so that adaptive execution can split the join below where a set is hot.
    named = materialise(of.select("h", "grp").join(least, "grp"))
    return feats.select("doc_id", "k1", "k2", "h").join(named, "h").select("doc_id", "k1", "k2", "grp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, that of the least id, with all its columns. A null id is the least only where all of a
    group's ids are null. Of a group's rows that share the least id, one stays: that of the least key."""
    named = near_copies(docs, id_col, text_col, similarity).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    firsts = named.groupBy("grp").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2")
    rows = docs.select(*row_keys(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(firsts, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")
