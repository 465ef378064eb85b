"""Variable-capacity best-fit packing.

Documents become pieces of at most the largest permitted length (longer ones are cut at it, nothing is lost). Pieces
are taken longest first; each goes to the open bin whose room it leaves the least of. If none has room, a bin is opened,
of the size that costs the least for each token it can still be filled with. A bin of c tokens costs c * (1 + c / LONG)
+ START: the quadratic part stands for attention, the fixed one for a step's own cost. As a greedy choice of sizes can
mislead, each shard is packed under several opening rules, the least-cost rule and one fixed least size for each
permitted length; in the end every bin is downsized to the smallest permitted length that its contents need, and the
rule of the least total cost is taken.

Rows are dealt to shards of about SHARD_ROWS by hash, whose number grows with the table; a shard is packed within one
task in bounded memory. Rows that are equal in id and text are numbered and the number is hashed too, so there are no hot shards,
and the same rows are packed alike however their files are split. Only lengths are shuffled.

Cases: a null or empty text is the end token alone. Rows with equal or null ids are packed each. Ties go by id and row
key. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read, row_keys, sliced, text_bytes
from .tokens import piece_lengths, tokenizer_path

SIZES = (512, 1024, 2048, 4096, 8192)
MODEL = "piece_bpe_32k.model"
LONG = 32_768
START = 64
SHARD_ROWS = 20_000
#: Equal rows that are numbered at once.
BLOCK = 1 << 16


def cost(size: int) -> float:
    return size * (1 + size / LONG) + START


def smallest(need: int, sizes: tuple[int, ...]) -> int:
    return next(c for c in sizes if c >= need)


def best_fit(lengths: list[int], sizes: tuple[int, ...], least: int | None) -> list[list[int]]:
    """Bins of indexes. lengths: longest first, none above the largest size. least: the least size that is opened, or None for the least cost."""
    room_bins: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    open_rooms, bins, rest = 0, [], sum(lengths)
    for i, need in enumerate(lengths):
        fitting = open_rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            at = room_bins[room].pop()
            if not room_bins[room]:
                open_rooms ^= 1 << room
        else:
            able = [c for c in sizes if c >= need]
            room = min(able, key=lambda c: (cost(c) / max(1, min(c, rest)), c)) if least is None else smallest(max(need, least), sizes)
            at = len(bins)
            bins.append([])
        bins[at].append(i)
        room_bins[room - need].append(at)
        open_rooms |= 1 << (room - need)
        rest -= need
    return bins


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> list[tuple[int, list[int]]]:
    """(size, indexes) of each bin, of the cheapest rule. lengths: longest first."""
    found = []
    for least in (None, *sizes):
        bins = [(smallest(sum(lengths[i] for i in b), sizes), b) for b in best_fit(lengths, sizes, least)]
        found.append((sum(cost(c) for c, _ in bins), len(found), bins))
    return min(found)[2]


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, k1, k2 and n: a text's tokens and the end token."""
    path = model or tokenizer_path(MODEL)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = piece_lengths(path)
        for b in sliced(batches):
            n = [x + 1 for x in lengths.count([t.decode("utf-8", "replace") for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k1", "k2")), pa.array(n, pa.int64())], names=["doc_id", "k1", "k2", "n"])

    return docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), text_bytes(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, n long")


def _pack_shards(sizes: tuple[int, ...]):
    names = ["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"]

    def packed(shard: int, rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        out = []
        for k, (size, members) in enumerate(pack([r[3] for r in rows], sizes)):
            at = 0
            for i in members:
                doc, piece, start, length = rows[i]
                out.append((doc, piece, start, length, (shard << 32) + k, size, at))
                at += length
        kinds = (id_type, *[pa.int64()] * 6)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, id_type = None, [], None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for s, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "piece", "start", "length"))):
                if s != shard and rows:
                    yield packed(shard, rows, id_type)
                    rows = []
                shard = s
                rows.append(tuple(row))
        if rows:
            yield packed(shard, rows, id_type)

    return run


def packing(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lengths: doc_id, k1, k2, n. A row for each piece: doc_id, piece, start and length (tokens of the document), bin_id, capacity, offset (in the bin)."""
    kind = lengths.schema["doc_id"].dataType.simpleString()
    sizes = tuple(sorted(sizes))
    # Equal rows become one with their number, and are numbered when they are dealt out again, in two steps, as an array
    # can't hold any number: so copies go to different shards, and the same rows to the same ones however their files are split.
    held = materialise(lengths.groupBy("doc_id", "k1", "k2", "n").agg(F.count("*").alias("times")))
    n = max(1, -(-(held.agg(F.sum("times")).first()[0] or 0) // shard_rows))
    last = F.col("times") - 1
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(BLOCK).cast("long"))))
    held = held.withColumn("row", F.explode(F.sequence("block", F.least(last, F.col("block") + BLOCK - 1))))
    shard = F.pmod(F.xxhash64("k1", "k2", "row"), F.lit(n)).alias("shard")
    most = F.lit(sizes[-1])
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - 1), most.cast("long")))
    pieces = held.select(shard, "doc_id", "k1", "k2", F.coalesce("n", F.lit(0)).alias("n"), start.alias("start"))
    pieces = pieces.select("shard", "doc_id", "k1", "k2", (F.col("start") / most).cast("long").alias("piece"), "start", F.least(most, F.col("n") - F.col("start")).cast("long").alias("length"))
    dealt = pieces.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "k1", "k2", "piece", "start").select("shard", "doc_id", "piece", "start", "length")
    return dealt.mapInArrow(_pack_shards(sizes), f"doc_id {kind}, piece long, start long, length long, bin_id long, capacity long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES, model: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    return packing(token_lengths(docs, id_col, text_col, model), sizes, shard_rows)


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
