"""Audit of filters that are applied one after another, by a subset-zeta transform.

Each document has a mask: the filters that it fails. What a part of the corpus loses to any order of the filters follows
from how many of its documents have each mask. The zeta transform sums these counts over all subsets of a mask, one
filter at a time; the sum over the subsets of a set's complement is the number of documents that survive the set. A step
of an order is the difference between the survivors of two neighbouring sets, for all documents and for labelled ones.

Filters: A, under min_words words; B, distinct words under distinct_percent % of the words; C, more than capital_percent %
of the characters are A-Z; D, a character of `[#$%&*|]`; E, the text of a smaller id, table-wide.

Plan: one pass over the texts leaves 60 bytes a document (id, part, 128 bits that stand for the text, mask). Labels come
by a join on the id; then equal texts of a part are one row with their least id, combined on the map side, so a text that
a third of the rows has is a few rows; the least id of all parts comes by a join of those. All that follows has 32
counts for each part. No group of documents meets in one task.

Cases: a null text is an empty one, which fails A only (and E, if it's not the first). A null part is ''. Rows equal in id
and text have no smaller id between them, so neither fails E by the other. A null id is neither smaller than another nor
larger: it fails nobody, never fails E and has no label. Of several labels of an id any 1 counts. An empty table gives
no rows. Columns other than those named are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read, sliced, text_bytes

LETTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
#: Bytes of a text whose words are held as a list at once.
CHUNK = 1 << 20


def chunks(text: bytes) -> Iterator[bytes]:
    """The text in parts of some CHUNK bytes that end before white space or at the end."""
    at = 0
    while len(text) - at > CHUNK:
        ends = [e for e in (text.find(c, at + CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if e >= 0]
        end = min(ends, default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words, distinct = 0, set()
    for part in chunks(text):
        own = part.split()
        words += len(own)
        distinct.update(own)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    length = len(text.decode("utf-8", "replace"))
    failed = (
        words < MIN_WORDS,
        100 * len(distinct) < DISTINCT_PERCENT * words,
        100 * capitals > CAPITAL_PERCENT * length,
        len(text.translate(None, SIGNS)) < len(text),
    )
    return sum(1 << i for i, f in enumerate(failed) if f)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        texts = b.column("text").to_pylist()
        digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
        masks = pa.array([mask_of(t) for t in texts], pa.int32())
        columns = [b.column("doc_id"), b.column("part"), digests, masks]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "mask"])


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, digest (of the text), mask (A to D) of every row."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("doc_id"), part.alias("part"), text_bytes(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(_masks, f"doc_id {kind}, part string, digest binary, mask int")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E), n, good, toxic: documents of each mask, and the labelled ones among them."""
    own = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("key")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    # Null ids are dealt by their texts, so that they don't meet in one task.
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\0"), F.hex("digest")))
    rows = masks.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")).withColumn("key", key)
    labelled = rows.join(own, "key", "left").fillna(0, ["good", "toxic"])
    with_id = F.when(F.col("doc_id").isNotNull(), F.col("n"))
    texts = materialise(
        labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(with_id), F.lit(0)).alias("n_ids"),
            F.min("doc_id").alias("own_first"),
            F.min_by(with_id, "doc_id").alias("n_first"),
        )
    )
    first = texts.groupBy("digest").agg(F.min("own_first").alias("first"))
    is_first = F.when(F.col("own_first") == F.col("first"), F.col("n_first")).otherwise(F.lit(0))
    later = texts.join(first, "digest").withColumn("later", F.col("n_ids") - is_first)
    split = later.select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), F.col("later").alias("n")),
            F.struct(F.col("mask"), (F.col("n") - F.col("later")).alias("n")),
        )),
    )
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def survivors(counts: DataFrame, letters: str = LETTERS, what: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """part and, for each count, an array: how many of the part's documents survive each set of filters, by the set's bits."""
    last = (1 << len(letters)) - 1
    of_mask = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*what)))).alias("of"))
    sums = of_mask.selectExpr("part", *(f"transform(sequence(0, {last}), m -> coalesce(of[m].{c}, 0L)) AS {c}" for c in what))
    for bit in (1 << i for i in range(len(letters))):
        sums = sums.selectExpr("part", *(f"transform({c}, (x, i) -> x + if(i & {bit} > 0, {c}[i ^ {bit}], 0L)) AS {c}" for c in what))
    return sums.selectExpr("part", *(f"reverse({c}) AS {c}" for c in what))  # a set's complement is as far from the end


def steps(letters: str = LETTERS) -> list[tuple[str, int, int, int]]:
    """filter_order, step, the set applied before it, the step's own bit."""
    out = []
    for order in permutations(letters):
        before = 0
        for k, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            out.append(("".join(order), k, before, bit))
            before |= bit
    return out


def filter_audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order and step of the filters, from mask_counts."""
    size, whole = len(letters), (1 << len(letters)) - 1
    rows = ", ".join(f"('{o}', {k}, {s}, {b})" for o, k, s, b in steps(letters))
    # Each set of other filters stands before a filter in |set|! (rest)! of the orders.
    weights = ", ".join(f"{factorial(s.bit_count()) * factorial(max(0, size - 1 - s.bit_count()))}L" for s in range(whole + 1))
    own = "shiftleft(1, k)"
    value = f"aggregate(sequence(0, {whole}), 0L, (sum, s) -> sum + if(s & {own} > 0, 0L, weights[s] * (n[s] - n[s | {own}])))"
    table = survivors(counts, letters).selectExpr("*", f"array({weights}) AS weights")
    table = table.selectExpr("*", f"transform(sequence(0, {size - 1}), k -> {value}) AS shapleys")
    return table.selectExpr("*", f"inline(array({rows})) AS (filter_order, step, before, bit)").selectExpr(
        "part", "filter_order", "step",
        "n[before | bit] AS kept",
        "n[before] - n[before | bit] AS removed",
        "n[0] - n[bit] - n[before] + n[before | bit] AS redundant",
        f"n[{whole} - bit] - n[{whole}] AS unique_fails",
        "good[before] - good[before | bit] AS good_lost",
        "toxic[before] - toxic[before | bit] AS toxic_lost",
        "shapleys[cast(log2(bit) AS int)] AS shapley",
    )


def op11_subset_zeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(mask_counts(failure_masks(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels")))
