"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

Encoding. A task cuts its texts into blocks of whole documents and explodes these into pre-tokens, the matches of the
pattern, with their positions. Pre-aggregation comes before the shuffle: a block keeps each distinct word once, with a number,
and the order of its words as a sequence of numbers. The words are dealt by hash to buckets, so all blocks' copies of a
word meet in one task, which has the library encode it once. Their ids are joined back to the blocks, whose documents are
put together by position. A word is one row's part at most for each block, so no frequent word is hot.

Two kinds of rows go through one exchange: a block's sequence is dealt by the block and stays where the join needs it; its words
are dealt by bucket. So the sequences, the greater part, move once. Words and sequences are compressed in their rows.

Blocks are named by their documents' place and content, so an input must give the same rows when a lost task is run again, as
files and checkpointed tables do. Should it not, a block's ids are missing, which is an error and never a wrong result.

Decoding. The token-byte table has a row for each id of the vocabulary, which bounds it; it is broadcast and joined in the tasks.

Cases: a null or empty text has no ids and decodes to no bytes. A text longer than a block is a block of its own. Rows with
equal or null ids keep a row each. Ids that the table lacks are an error. An empty table gives no rows. Other columns
are neither read nor returned, so their names can't clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import read, sliced, text_bytes
from .tokens import tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of a block's texts.
BLOCK = 8_000_000
#: Words that a task of the encoding holds with their ids; what comes beyond is encoded where it stands.
HELD = 1_000_000
#: White space, as the library's pattern has it; the pattern module's own \s may differ in control characters.
SPACE = r"\t-\r \x85\xa0  -     　"


#: The same classes of the code points up to U+00FF; fixed values.
LETTERS_255, NUMBERS_255, SPACE_255 = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
ABOVE_255 = re.compile("[^\\x00-\\xff]")


def pre_token_pattern():
    """public_tokenizers.PATTERN with its white space spelled out."""
    from public_tokenizers import PATTERN

    spelled = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)|\s+", rf"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    return regex.compile(spelled)


def pre_tokenizer():
    """A function from a text to its pre-tokens. Texts without code points above U+00FF need no tables of the pattern module."""
    whole = pre_token_pattern()
    classes = {r"\p{L}": LETTERS_255, r"\p{N}": NUMBERS_255, SPACE: SPACE_255}
    spelled = whole.pattern
    for kind, own in classes.items():
        spelled = spelled.replace(f" ?{kind}+", f" ?[{own}]+").replace(kind, own)
    small = re.compile(spelled)

    def cut(text: str) -> list[str]:
        return (whole if ABOVE_255.search(text) else small).findall(text)

    return cut


def ranks(path: str) -> dict[bytes, int]:
    """Bytes and id of each token of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(2)
def encoder(path: str):
    """The worker's own, for all of its tasks."""
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by their four bytes' planes, compressed: small numbers cost little."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(held: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(held), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def joined(words: list[bytes]) -> tuple[bytes, bytes]:
    """Words as their lengths and one string, compressed."""
    return packed(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.compress(b"".join(words), 1)


def parted(sizes: bytes, text: bytes) -> list[bytes]:
    ends = np.cumsum(unpacked(sizes), dtype=np.int64).tolist()
    held = zstandard.decompress(text)
    return [held[a:b] for a, b in zip([0, *ends], ends)]


BLOCKS = "key long, block long, sequence binary, doc_ids array<{id}>, pieces array<int>, numbers binary, sizes binary, words binary"


def exploded(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows of two kinds. A block: key and block (its name), sequence (numbers of its pre-tokens' words in order), doc_ids,
    pieces (pre-tokens of each document). A bucket of a block's words: key (the bucket), block, numbers, sizes and words."""
    kind = docs.schema[id_col].dataType
    schema = BLOCKS.format(id=kind.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, part, at = pre_tokenizer(), TaskContext.get().partitionId(), 0
        types: list = []
        numbers: dict[str, int] = {}
        ids, pieces, parts, held, name = [], [], [], 0, xxhash.xxh64(b"")

        def rows() -> Iterator[pa.RecordBatch]:
            name.update(f"{part} {at}".encode())
            own = name.intdigest() - (1 << 63)
            words = [w.encode() for w in numbers]
            dealt: list[list[int]] = [[] for _ in range(buckets)]
            for n, w in enumerate(words):
                dealt[xxhash.xxh64_intdigest(w) % buckets].append(n)
            sequence = packed(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
            out = [(own, own, sequence, ids, pieces, None, None, None)]
            for k, mine in enumerate(dealt):
                if mine:
                    out.append((k, own, None, None, None, packed(np.diff(np.array(mine, np.uint32), prepend=np.uint32(0))), *joined([words[n] for n in mine])))
            for start in range(0, len(out), 64):
                cols = list(zip(*out[start : start + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in sliced(batches, 64):
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(b.column("doc_id").type), pa.list_(pa.int32()), *[pa.binary()] * 3]
            for i, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if ids and held + len(raw) > block:
                    yield from rows()
                    numbers, ids, pieces, parts, held, name, at = {}, [], [], [], 0, xxhash.xxh64(b""), at + 1
                found = find(raw.decode("utf-8", "replace"))
                for w in set(found).difference(numbers):
                    numbers[w] = len(numbers)
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                ids.append(i)
                pieces.append(len(found))
                held += len(raw)
                name.update(f"{i} {len(raw)} ".encode())
                name.update(raw)
        if ids:
            yield from rows()

    return docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(explode, schema)


def _encoded(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, known = encoder(path), {}

        def of(word: bytes) -> bytes:
            ids = known.get(word)
            if ids is None:
                ids = np.array(library.encode_ordinary(word.decode()), "<u4").tobytes()
                if len(known) < HELD:
                    known[word] = ids
            return ids

        for b in batches:
            b = b.filter(b.column("words").is_valid())
            counts, flat = [], []
            for sizes, words in zip(b.column("sizes").to_pylist(), b.column("words").to_pylist()):
                own = [of(w) for w in parted(sizes, words)]
                counts.append(packed(np.fromiter((len(x) // 4 for x in own), np.uint32, len(own))))
                flat.append(packed(np.frombuffer(b"".join(own), "<u4")))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("numbers"), pa.array(counts, pa.binary()), pa.array(flat, pa.binary())], names=["block", "numbers", "counts", "ids"])

    return encode


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of each start and size, one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _assembled(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """One block: its ids by document from its sequence and its words' ids."""
    numbers, counts, flat = ([unpacked(x) for x in words.column(c).to_pylist()] for c in ("numbers", "counts", "ids"))
    number = np.concatenate([np.cumsum(x, dtype=np.int64) for x in numbers] or [np.zeros(0, np.int64)])
    count = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
    flat = np.concatenate([*flat, np.zeros(0, np.uint32)])
    size = np.zeros(number.max(initial=-1) + 1, np.int64)
    start = np.zeros(len(size), np.int64)
    size[number], start[number] = count, np.cumsum(count) - count
    out_ids, out = [], []
    for sequence, doc_ids, pieces in zip(*(blocks.column(c).to_pylist() for c in ("sequence", "doc_ids", "pieces"))):
        order = unpacked(sequence).astype(np.int64)
        if len(order) and (order.max() >= len(size) or not size[order].all()):
            raise RuntimeError("a block lacks words: its documents were not the same when a task was run again")
        at = 0
        for i, n in zip(doc_ids, pieces):
            own = order[at : at + n]
            out_ids.append(i)
            out.append(gathered(flat, start[own], size[own]).astype(np.int32))
            at += n
    offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
    values = pa.array(np.concatenate([*out, np.zeros(0, np.int32)]), pa.int32())
    id_type = blocks.schema.field("doc_ids").type.value_type
    return pa.table([pa.array(out_ids, id_type), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, ids array<int> of every row."""
    path = path or tokenizer_path(RANKS)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = exploded(docs, n, id_col, text_col, block).repartition(n, "key")
    # Both ways read one exchange. A filter that Catalyst pushed below it, or pruned columns, would make it two, and the
    # documents would be cut twice; the number of the partition, which is known behind it only, keeps the filter there.
    here = F.spark_partition_id()
    sequences = rows.filter(here + F.col("sequence").isNotNull().cast("int") > here)
    found = rows.mapInArrow(_encoded(path), "block long, numbers binary, counts binary, ids binary")
    kind = docs.schema[id_col].dataType.simpleString()
    return sequences.groupBy("key").cogroup(found.groupBy("block")).applyInArrow(_assembled, f"doc_id {kind}, ids array<int>")


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, bytes: the rank file as a table."""
    return spark.createDataFrame(sorted((i, t) for t, i in ranks(path or tokenizer_path(RANKS)).items()), "id int, bytes binary")


def decode(encoded: DataFrame, tokens: DataFrame) -> DataFrame:
    """encoded (ids array<int> and other columns) with decoded binary. tokens: id, bytes, a vocabulary's, with distinct ids from 0 on."""
    spark = encoded.sparkSession
    table = {r.id: bytes(r.bytes) for r in tokens.collect()}
    held = spark.sparkContext.broadcast(table)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.__getitem__
        for b in sliced(batches, 64):
            ids = b.column("ids")
            texts = [b"".join(map(get, x.as_py() or ())) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(join, StructType([*encoded.schema, StructField("decoded", BinaryType())]))


def op13_word_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(read(spark, sf_dir, "documents")), token_table(spark))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
