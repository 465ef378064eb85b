"""Quality rules by cross-document line frequency.

Every document's lines are normalised (lower case, white space made one space) and hashed; the distinct documents of a
host that hold a line are counted; lines above the limit are removed; documents that this depletes are rejected, as are
those that fail the base rules.

Copies: exact copies of one document share all of their lines, but their lines are no boilerplate. Documents are
therefore counted by a hash of all their words, in lower case, which only copies share; the removal of copies is left to
the deduplication operators. Near copies count each: pages that differ in a line of their own and have the rest in common
are what the rule is for, and no digest of a part of the text tells the two apart.

The share of a host's documents is a limit that rises with the host; so a line on more than many_docs documents is above
the limits too, however large its host.

Plan: one pass over the texts writes a small feature table (counts, signature, line hashes) to the shared folder; all
shuffles work on hashes. The count of distinct documents is two aggregations with map-side combine, so a line that a
third of the rows holds doesn't meet in one task; the way back to the documents is a join salted by row.

Cases: a null text is an empty one (no words, base_failed). A null host is a host of its own, named ''. Lines without
words are neither counted nor removed. Rows with equal ids keep a result each. An empty table gives no rows. Columns
other than those named are neither read nor returned, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialise, read, row_keys, sliced, text_bytes

MIN_DOCS = 10
MAX_SHARE = 0.10
#: Distinct documents of a host beyond which a line goes, whatever their share.
MANY_DOCS = 100
LEAST_LEFT = 0.20
SALTS = 16
SYMBOLS = b"#*$%&|<>"

FEATURES = "doc_id {id}, host string, k1 long, k2 long, sig long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:int>>"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more, the first included."""
    grams = list(zip(words, words[1:], words[2:]))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    total = end = 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            total += i + 3 - max(end, i)
            end = i + 3
    return total


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    return signed(xxhash.xxh3_64_intdigest(line))


def signature(words: list[bytes], text: bytes) -> int:
    """Hash of all words in lower case, which copies share; of the text, if it has none."""
    return signed(xxhash.xxh3_64_intdigest(b" ".join(words).lower() if words else text))


def features(text: bytes) -> tuple:
    words = text.split()
    lines: dict[int, int] = {}
    raw: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        own = line.lower().split()
        if own:
            repeated += line in raw
            raw.add(line)
            h = line_hash(b" ".join(own))
            lines[h] = lines.get(h, 0) + len(own)
    return (signature(words, text), len(words), len(b"".join(words).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), repeated, repeat_words(words), [{"h": h, "w": w} for h, w in lines.items()])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["sig", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    line_type = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))
    for b in sliced(batches):
        rows = [features(t) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "host", "k1", "k2")), *(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], line_type)], names=["doc_id", "host", "k1", "k2", *names, "lines"])


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """A row for each document: base counts, base_failed, kept, n_removed_words, removed (hashes of the removed lines).

    A line is removed in a host where more than min_docs distinct documents and more than max_share of the host's
    distinct documents hold it, or where more than many_docs do. A document is depleted with less than least_left of its words left."""
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), *row_keys(id_col, text_col, host_col), text_bytes(text_col).alias("text"))
    feats = materialise(given.mapInArrow(_features, FEATURES.format(id=kind)).withColumn("row", F.monotonically_increasing_id()))
    lines = feats.select("row", "host", "sig", F.inline("lines"))
    counts = lines.select("host", "h", "sig").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    hosts = feats.select("host", "sig").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    frequent = counts.join(hosts, "host").filter((F.col("n") > F.col("n_host") * max_share) | (F.col("n") > many_docs))
    # Written, so that adaptive execution can split the join below where 16 salts are too few for a line.
    salted = materialise(frequent.select("host", "h")).select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = lines.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"])
    gone = hits.groupBy("row").agg(F.sum("w").alias("gone"), F.collect_list("h").alias("removed"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return feats.drop("lines", "sig").join(gone, "row", "left").select("doc_id", "k1", "k2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (left >= F.col("n_words") * least_left)).alias("kept"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed_words"), F.coalesce("removed", F.array().cast("array<long>")).alias("removed"))


def _strip(text_name: str, removed_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            at = b.schema.get_field_index(text_name)
            out = []
            for text, removed in zip(b.column(text_name).to_pylist(), b.column(removed_name).to_pylist()):
                if removed and text is not None:
                    gone = set(removed)
                    text = "\n".join(x for x in text.split("\n") if line_hash(normal_line(x.encode())) not in gone)
                out.append(text)
            yield b.set_column(at, pa.field(text_name, pa.string()), pa.array(out, pa.string())).drop_columns([removed_name])

    return run


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that stay, with all of their columns, their text without the removed lines."""
    kept = line_verdicts(docs, id_col, text_col, host_col, **limits).filter("kept").groupBy("k1", "k2").agg(F.first("removed").alias("removed"))
    text_name, removed_name = free_name(docs.columns, "text__"), free_name(docs.columns, "removed__")
    own = [F.col(f"row.`{c}`").alias(text_name if c == text_col else c) for c in docs.columns]
    joined = docs.select(*row_keys(id_col, text_col, host_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(kept, ["k1", "k2"])
    given = joined.select(*own, F.col("removed").alias(removed_name))
    out = given.mapInArrow(_strip(text_name, removed_name), given.drop(removed_name).schema)
    return out.select(*[F.col(text_name).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
