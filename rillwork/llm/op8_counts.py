"""Token counts by a map-side two-tier lookup.

Tier one: a compact table of the lengths of the corpus's frequent pre-tokens, of table_size entries at most, broadcast
to all tasks. It comes from a pass over all documents in which every task keeps its most frequent pre-tokens and passes
on at most PER_TASK of them with their counts; the stream of pre-tokens itself is never shuffled. Tier two: what the
table lacks is encoded by the library and kept in a bounded cache of the worker. Both tables change no count: they hold
what the library says. Texts that could be cut differently go to the library whole.

Cases: a null or empty text has no bytes and no tokens. Texts of any length are counted whole. Rows with equal or null
ids keep a row each. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sliced, text_bytes
from .tokens import PieceLengths, tokenizer_path, with_frequent

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
TABLE_SIZE = 20_000
PER_TASK = 4_000
#: Pre-tokens that a task holds while it counts; the rarest half goes when there are more.
HELD = 200_000


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    for b in sliced(batches):
        for t in b.column("text").to_pylist():
            seen.update(t.split(b" "))
            if len(seen) > HELD:
                seen = Counter(dict(seen.most_common(HELD // 2)))
    top = [(x, n) for x, n in seen.most_common(PER_TASK) if n > 1]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])


def frequent_lengths(docs: DataFrame, text_col: str = "text", model: str | None = None, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens, table_size at most; the driver holds no more than those."""
    sketch = docs.select(text_bytes(text_col).alias("text")).mapInArrow(_frequent, "piece binary, n long")
    top = sketch.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size)
    pieces = [p for p in (bytes(r.piece).decode("utf-8", "replace") for r in top.collect()) if p and "�" not in p]
    return dict(zip(pieces, PieceLengths(model or tokenizer_path(MODEL))._lengths(pieces)))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; no shuffle of rows."""
    path = model or tokenizer_path(MODEL)
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, path, table_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = with_frequent(path, table.value)
        for b in sliced(batches):
            texts = b.column("text").to_pylist()
            n = lengths.count([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
