"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ten words (all its words, if it has fewer). A window occurs in a document only if all
of its words do, so under the order of rarity, taken from the document frequencies of the benchmark's words in the whole
corpus, one prefix token is enough: the window's rarest word. The join meets a document's words with these prefix tokens
only. The token's place in the window gives the candidate's place in the document (positional bound), which has to lie
inside it (length bound); then the window's words are compared one by one.

One pass over the documents counts the words of all windows, by a broadcast of at most VOCABULARY_MAX words, else by an
aggregation of each document's distinct words. The benchmark's windows are then broadcast in parts of at most part_windows
(window, item) pairs, whatever its size; one part is one pass over the documents. Documents are never shuffled, unless there
are several parts, whose findings meet by row.

Cases: a null text has no words. Items without words or without id have no windows; rows of one item id are one item. A
word is hit once, however many windows cover it. Rows with equal ids keep a row each. An empty benchmark finds nothing;
an empty table gives no rows. Other columns are neither read nor returned (clean() returns them untouched).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialise, read, row_keys, sliced, text_bytes

WINDOW = 10
PART_WINDOWS = 200_000
VOCABULARY_MAX = 1_000_000
#: A-Z become a-z; digits, letters and bytes of other characters stay; all else becomes a space.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))

Index = dict[bytes, list[tuple[int, tuple[bytes, ...], list[str]]]]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids: list[str] = []
        found: list[bytes] = []
        for i, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
            words = words_of(t)
            own = {b" ".join(words[k : k + WINDOW]) for k in range(max(1, len(words) - WINDOW + 1))} if words else set()
            ids += [i] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], names=["item", "window"])


def item_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", part_windows: int = PART_WINDOWS) -> list[DataFrame]:
    """The distinct (item, window) pairs, in parts of about part_windows."""
    given = bench.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), text_bytes(text_col).alias("text"))
    pairs = materialise(given.mapInArrow(_windows, "item string, window binary").distinct())
    n = max(1, -(-pairs.count() // part_windows))
    return [pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(n)) == k) for k in range(n)]


def _window_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = {w for x in b.column("window").to_pylist() for w in x.split(b" ")}
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary())], names=["word"])


def words_in(windows: DataFrame) -> DataFrame:
    return windows.select("window").mapInArrow(_window_words, "word binary").distinct()


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        words = [w for t in b.column("text").to_pylist() for w in set(words_of(t))]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], names=["word"])


def rarity(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text", vocabulary_max: int = VOCABULARY_MAX) -> DataFrame:
    """word, n: the documents of the whole corpus that hold each word of the vocabulary (word); words that none holds are left out."""
    texts = docs.select(text_bytes(text_col).alias("text"))
    vocabulary = materialise(vocabulary)
    if vocabulary.count() > vocabulary_max:
        counts = texts.mapInArrow(_document_words, "word binary").groupBy("word").agg(F.count("*").alias("n"))
        return materialise(counts.join(vocabulary, "word", "left_semi"))
    known = docs.sparkSession.sparkContext.broadcast({bytes(r.word) for r in vocabulary.collect()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict.fromkeys(known.value, 0)
        for b in sliced(batches):
            for t in b.column("text").to_pylist():
                for w in known.value.intersection(words_of(t)):
                    found[w] += 1
        seen = [(w, n) for w, n in found.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.binary()), pa.array([n for _, n in seen], pa.int64())], names=["word", "n"])

    return materialise(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def prefix_index(part: DataFrame, counts: DataFrame) -> Index:
    """Of a part's windows by prefix token: the token's place, the window's words and its items. A window with a word that no document has is left out. counts: as of rarity()."""
    items: dict[tuple[bytes, ...], list[str]] = {}
    for r in part.collect():
        items.setdefault(tuple(bytes(r.window).split(b" ")), []).append(r.item)
    found = {bytes(r.word): r.n for r in counts.join(words_in(part), "word", "left_semi").collect()} if items else {}
    index: Index = {}
    for window, own in items.items():
        if all(w in found for w in window):
            least = min(range(len(window)), key=lambda k: (found[window[k]], window[k], k))
            index.setdefault(window[least], []).append((least, window, own))
    return index


def part_indexes(docs: DataFrame, text_col: str, bench: DataFrame, item_col: str, item_text_col: str, part_windows: int) -> Iterator:
    """The parts' indexes, each broadcast when it is its turn."""
    parts = item_windows(bench, item_col, item_text_col, part_windows)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    counts = rarity(docs, words_in(every), text_col)
    for p in parts:
        yield docs.sparkSession.sparkContext.broadcast(prefix_index(p, counts))


def occurrences(words: list[bytes], index: Index) -> Iterator[tuple[int, int, list[str]]]:
    """start, end and items of every window that occurs."""
    n = len(words)
    for at, w in enumerate(words):
        if w in index:
            for place, window, items in index[w]:
                start = at - place
                if start >= 0 and start + len(window) <= n and tuple(words[start : start + len(window)]) == window:
                    yield start, start + len(window), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPAN = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _hits(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            counts, spans, found = [], [], []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                own = list(occurrences(words, index.value))
                counts.append(len(words))
                spans.append([{"s": s, "e": e} for s, e in merged([x[:2] for x in own])])
                found.append(sorted({i for x in own for i in x[2]}))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k1", "k2")), pa.array(counts, pa.int64()), pa.array(spans, SPAN), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "k1", "k2", "n_words", "spans", "items"])

    return run


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_windows: int = PART_WINDOWS) -> DataFrame:
    """A row for each document: doc_id, n_words, spans (merged, in words), items (ids of the items with occurring windows, as strings)."""
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), text_bytes(text_col).alias("text"))
    schema = f"doc_id {kind}, k1 long, k2 long, n_words long, spans array<struct<s:int,e:int>>, items array<string>"
    passes = [given.mapInArrow(_hits(index), schema) for index in part_indexes(docs, text_col, bench, item_col, item_text_col, part_windows)]
    if len(passes) == 1:
        return passes[0].select("doc_id", "n_words", "spans", "items")
    rest = passes[1]
    for p in passes[2:]:
        rest = rest.union(p)
    more = rest.filter(F.size("items") > 0).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
    none = F.coalesce("more_spans", F.expr("array()").cast("array<struct<s:int,e:int>>"))
    return passes[0].join(more, ["k1", "k2"], "left").select("doc_id", "n_words", F.concat("spans", none).alias("spans"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.expr("array()").cast("array<string>"))))).alias("items"))


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_windows: int = PART_WINDOWS) -> DataFrame:
    """The documents without any occurring window, as they are."""

    text_name = free_name(docs.columns, "text__")

    def keep(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                clean_ = [next(occurrences(words_of((t or "").encode()), index.value), None) is None for t in b.column(text_name).to_pylist()]
                yield b.filter(pa.array(clean_, pa.bool_())).drop_columns([text_name])

        return run

    out = docs
    for index in part_indexes(docs, text_col, bench, item_col, item_text_col, part_windows):
        out = out.withColumn(text_name, F.col(f"`{text_col}`").cast("string")).mapInArrow(keep(index), docs.schema)
    return out


def op5_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"] - 1))))
    n_hit = F.when(F.size("spans") == 0, 0).otherwise(F.size(places)).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
