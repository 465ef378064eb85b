"""Token ids as directly addressable codes.

An id is cut into chunks of CHUNK_BITS bits, lowest first. Level k holds the k-th chunks of the ids that have one, and a
bitmap tells for each whether the id goes on at level k + 1. A rank directory holds the number of set bits before each
block of RANK_BITS bits; so the chunk's place at the next level is the number of set bits before it, found with one
directory entry and the bits of one block. Any token is read by at most as many steps as there are levels, and no block
of tokens is decoded for it.

File format. A segment is a file: the header "<4sBBHQ" (magic, chunk bits, levels, unused, tokens), a "<Q" for each level
(its entries), then each level's chunks (one byte each), bitmap (bits, lowest first, padded to 64) and rank directory (one
"<Q" for each block). So every place in the file follows from the header, and one token is read by seeking: a byte, the
bits of a block and a directory entry for each of its levels. Nothing is compressed around it.

Segment files lie in one folder in the shared storage; each task attempt writes files under names of its own, and the
directory table, which Spark's commit protocol writes, names those of the attempts that count, in ascending order, each
with its number of documents and tokens, its documents' ids and their starts. A lost or repeated task leaves at most files
that nothing names.

Plan: one range shuffle by document id; the writers then tokenise what they get. The starts of the segments come from
an aggregation over the segments' lengths alone.

Cases: a null or empty text is the end id alone. Rows with equal ids follow each other by text; null ids come first. A
segment takes documents up to SEGMENT_TOKENS ids; a longer document is a segment of its own. An empty table gives an
empty table of segments. Other columns are neither read nor returned.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read, shared_dir, text_bytes
from .tokens import SLICE, byte_level, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 20
MAGIC = b"RDAC"
HEADER = struct.Struct("<4sBBHQ")
COUNT = struct.Struct("<Q")


def encode_segment(ids: np.ndarray, chunk_bits: int = CHUNK_BITS) -> bytes:
    """ids: unsigned 32-bit integers. chunk_bits: 1 to 8."""
    rest, sizes, parts = ids.astype(np.uint32), [], []
    while not sizes or len(rest):
        chunks = (rest & np.uint32((1 << chunk_bits) - 1)).astype(np.uint8)
        rest = rest >> np.uint32(chunk_bits)
        more = rest > 0
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += bytes(-len(bits) % 8)
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate((np.zeros(1, np.uint64), np.cumsum(blocks, dtype=np.uint64)))[: len(blocks)]
        sizes.append(COUNT.pack(len(chunks)))
        parts += [chunks.tobytes(), bits, ranks.astype("<u8").tobytes()]
        rest = rest[more]
    return b"".join([HEADER.pack(MAGIC, chunk_bits, len(sizes), 0, len(ids)), *sizes, *parts])


class Segment:
    """Reads a segment through read(place, size): any token by access(), runs of them by ids(). Only the header is held."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        magic, self.chunk_bits, levels, _, self.n = HEADER.unpack(read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a segment")
        self.read = read
        sizes = struct.unpack(f"<{levels}Q", read(HEADER.size, levels * COUNT.size))
        at, self.levels = HEADER.size + levels * COUNT.size, []
        for n in sizes:
            n_bits = (-(-n // 8) + 7) // 8 * 8
            # Places of the chunks, the bitmap and the rank directory.
            self.levels.append((n, at, at + n, at + n + n_bits))
            at += n + n_bits + 8 * -(-n // RANK_BITS)
        self.size = at

    @classmethod
    def of(cls, data: bytes) -> "Segment":
        return cls(lambda at, size: data[at : at + size])

    def rank(self, level: int, i: int) -> int:
        """Set bits before place i of a level: a directory entry and the bits of its block."""
        n, _, bits, ranks = self.levels[level]
        if not n:
            return 0
        block = min(i // RANK_BITS, (n - 1) // RANK_BITS)
        start = block * RANK_BITS
        own = int.from_bytes(self.read(bits + start // 8, -(-i // 8) - start // 8), "little") & ((1 << (i - start)) - 1)
        return COUNT.unpack(self.read(ranks + 8 * block, COUNT.size))[0] + own.bit_count()

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            value |= self.read(chunks + i, 1)[0] << shift
            if not self.read(bits + (i >> 3), 1)[0] >> (i & 7) & 1:
                break
            i = self.rank(level, i)
            shift += self.chunk_bits
        return value

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop, each level read from its own range."""
        ranges = [(start, stop)]
        for level in range(len(self.levels) - 1):
            ranges.append((self.rank(level, ranges[-1][0]), self.rank(level, ranges[-1][1])))
        value = np.zeros(0, np.uint32)
        for (_, chunks, bits, _), (a, b) in zip(reversed(self.levels), reversed(ranges)):
            own = np.frombuffer(self.read(chunks + a, b - a), np.uint8).astype(np.uint32)
            held = np.frombuffer(self.read(bits + a // 8, -(-b // 8) - a // 8), np.uint8)
            more = np.unpackbits(held, bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            own[more] |= value << np.uint32(self.chunk_bits)
            value = own
        return value


def open_segment(path: str) -> Segment:
    """A segment file of any store that pyarrow reads; every read seeks."""
    store, name = fs.FileSystem.from_uri(path)
    held = store.open_input_file(name)
    return Segment(lambda at, size: held.read_at(size, at))


SEGMENTS = "first_id {id}, n_docs int, n_tokens long, doc_ids array<{id}>, starts array<long>, file string"


def write_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Encode every document, the end id after it, and write the segment files; returns their directory table as read back. place gives their order."""
    folder = f"{shared_dir(docs.sparkSession)}/segments-{uuid.uuid4().hex}"
    path = vocabulary or tokenizer_path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(path)
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        ids: list = []
        held: list[bytes] = []
        n = files = 0

        def flush() -> pa.RecordBatch:
            nonlocal files
            name = f"{task.partitionId():06d}-{files:06d}-{task.taskAttemptId()}.codes"
            files += 1
            starts = np.cumsum([0] + [len(x) // 4 for x in held])
            data = encode_segment(np.frombuffer(b"".join(held), np.uint32))
            with store.open_output_stream(f"{base}/{name}.part") as out:
                out.write(data)
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            rows = {"first_id": [ids[0]], "n_docs": [len(ids)], "n_tokens": [int(starts[-1])], "doc_ids": [list(ids)], "starts": [starts[:-1].tolist()], "file": [f"{folder}/{name}"]}
            out = pa.RecordBatch.from_pydict(rows, schema=pa.schema([("first_id", id_type), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(id_type)), ("starts", pa.list_(pa.int64())), ("file", pa.string())]))
            ids.clear()
            held.clear()
            return out

        for whole in batches:
            id_type = whole.schema.field("doc_id").type
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                for i, x in zip(b.column("doc_id").to_pylist(), encoder.encode([t.decode("utf-8", "replace") for t in b.column("text").to_pylist()])):
                    if ids and n + len(x) // 4 + 1 > segment_tokens:
                        yield flush()
                        n = 0
                    ids.append(i)
                    held.append(x + end)
                    n += len(x) // 4 + 1
        if ids:
            yield flush()

    dealt = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    written = dealt.mapInArrow(run, SEGMENTS.format(id=kind)).withColumn("place", F.monotonically_increasing_id())
    return materialise(written)


def segment_starts(segments: DataFrame) -> DataFrame:
    """place and base of each segment: the tokens of all segments before it. Sums by task come first, so only one row for each task meets in one window."""
    parts = segments.select("place", "n_tokens", F.shiftright("place", 33).alias("part"))
    sums = parts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    own = Window.partitionBy("part").orderBy("place")
    return parts.join(before, "part").select("place", (F.col("base") + F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("base"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for place, doc_ids, starts, n, path in zip(*(b.column(c) if c == "doc_ids" else b.column(c).to_pylist() for c in ("place", "doc_ids", "starts", "n_tokens", "file"))):
            segment = open_segment(path)
            # All of its documents are wanted, so the file is read once.
            segment = Segment.of(segment.read(0, segment.size))
            stops = [*starts[1:], n]
            crc = [zlib.crc32(segment.ids(s, e).astype("<u4").tobytes()) for s, e in zip(starts, stops)]
            lengths = pa.array([e - s for s, e in zip(starts, stops)], pa.int64())
            made = (pa.array([place] * len(starts), pa.int64()), doc_ids.values, pa.array(starts, pa.int64()), lengths, pa.array(crc, pa.int64()))
            yield pa.RecordBatch.from_arrays(list(made), names=["place", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(segments: DataFrame) -> DataFrame:
    """A row for each document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    kind = segments.schema["first_id"].dataType.simpleString()
    docs = segments.select("place", "doc_ids", "starts", "n_tokens", "file").mapInArrow(_read, f"place long, doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    return docs.join(segment_starts(segments), "place").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_at(segments: DataFrame, position: int) -> int | None:
    """The id at a position of the whole corpus, by seeking in one segment file. For many positions of one corpus keep segment_starts()."""
    place = segment_starts(segments).filter(F.col("base") <= position).orderBy(F.desc("base"), F.desc("place")).first()
    row = place and segments.filter(F.col("place") == place.place).select("n_tokens", "file").first()
    return open_segment(row.file).access(position - place.base) if row and position - place.base < row.n_tokens else None


def op6_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write_segments(read(spark, sf_dir, "documents")))
