"""Spelling variants: words of a distance of one, found by automata over broadcast trie shards.

Counting. Runs of letters are counted in the tasks, in tables of a bounded size, and their counts are added up behind a
shuffle of distinct words. A key of 199 plants a typing error: of a run whose crc32 with its document's id it divides, one
letter is deleted. A crc32 is linear, so that of `<id>:<run>` comes from that of `<id>:` moved on by the run's length and
that of the run alone, for all runs of a batch at once.

Neighbours. The words are sorted and cut into shards of SHARD_CHARS characters; each shard is a compact trie in breadth-first
order: a string of labels, in which the children of a node stand side by side, the place of its first child, and the
count of the word that ends there. Rounds of shards of ROUND_CHARS at most are broadcast, a bound that does not grow with
the corpus, and in each every word's distance-one automaton walks every shard depth-first: along the word itself without
an error, and from each node on the way with one error, then exactly. What accepts is emitted; counts and the
best form are aggregations. Forms grow at least RATIO-fold, so chains are short; roots come by doubling them.

Cases: null and empty texts have no runs. A null id counts as ''. Texts of any length are read whole. Ties between forms go
to the smaller one in code-point order. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialise, read, sliced

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
MODULUS = 199
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: Distinct words of a task's table; beyond it its counts are passed on and it starts anew.
HELD = 400_000
#: Characters of a shard's words, and of the shards that are broadcast in one round. A node takes 13 bytes or 16.
SHARD_CHARS = 1_000_000
ROUND_CHARS = 8_000_000
#: Words that a task walks through the tries of a round.
WALKED = 10_000
#: Bytes of a run up to which its crc32 is taken from those of its parts.
MOVED = 64


@lru_cache(1)
def crc_table() -> np.ndarray:
    """The crc32 remainders of the 256 bytes, by the standard's polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


def moved(crcs: np.ndarray, most: int = MOVED) -> np.ndarray:
    """Row k: what the crcs of prefixes add to that of a string of k bytes behind them."""
    out = np.empty((most + 1, len(crcs)), dtype=np.uint32)
    out[0] = crcs
    for k in range(most):
        out[k + 1] = (out[k] >> 8) ^ crc_table()[out[k] & 0xFF]
    return out


class Runs(dict):
    """Numbers of a task's distinct runs in lower case by the runs as written, with their crcs and lengths in bytes."""

    def __init__(self) -> None:
        self.words, self.crcs, self.sizes = [], array("I"), array("I")

    def __missing__(self, run: str) -> int:
        low = run.translate(LOWER)
        if low != run:
            self[run] = at = self[low]
            return at
        raw = run.encode()
        self.words.append(run)
        self.crcs.append(zlib.crc32(raw))
        self.sizes.append(len(raw))
        self[run] = at = len(self.words) - 1
        return at


def without(run: str, h: int) -> str:
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted(ids: list, texts: list[str], runs: Runs, modulus: int) -> tuple[np.ndarray, Counter]:
    """How often each run stays as it is, and the words that lost a letter with their counts."""
    found = [RUN.findall(t) for t in texts]
    own = np.fromiter(map(runs.__getitem__, chain.from_iterable(found)), np.int64)
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    prefixes = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    sizes = np.frombuffer(runs.sizes, np.uint32)[own] if len(own) else own
    short = np.minimum(sizes, MOVED).astype(np.int64)
    crcs = moved(np.array(prefixes, np.uint32))[short, owner] ^ (np.frombuffer(runs.crcs, np.uint32)[own] if len(own) else np.uint32(0))
    for k in np.nonzero(sizes > MOVED)[0]:
        crcs[k] = zlib.crc32(runs.words[own[k]].encode(), prefixes[owner[k]])
    hit = np.nonzero(crcs % modulus == 0)[0]
    changed = Counter(without(runs.words[own[k]], int(crcs[k])) for k in hit)
    stay = np.bincount(own, minlength=len(runs.words)) - np.bincount(own[hit], minlength=len(runs.words))
    return stay, changed


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = MODULUS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of min_length code points or more that occur min_count times or more in all texts."""

    def out(runs: Runs, total: np.ndarray, changed: Counter) -> pa.RecordBatch:
        rows = [(w, n) for w, n in zip(runs.words, total.tolist()) if n and len(w) >= min_length]
        rows += [(w, n) for w, n in changed.items() if len(w) >= min_length]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total, changed = Runs(), np.zeros(0, np.int64), Counter()
        for b in sliced(batches):
            stay, more = counted(b.column("id").to_pylist(), b.column("text").to_pylist(), runs, modulus)
            stay[: len(total)] += total
            total = stay
            changed.update(more)
            if len(runs) + len(changed) > HELD:
                yield out(runs, total, changed)
                runs, total, changed = Runs(), np.zeros(0, np.int64), Counter()
        yield out(runs, total, changed)

    given = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Trie:
    """Sorted words in breadth-first order: labels[i] leads to node i, whose children are first[i] to first[i + 1] - 1."""

    def __init__(self, labels: str, first: array, counts: array) -> None:
        self.labels, self.first, self.counts = labels, first, counts

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """words: sorted, distinct, none empty."""
        labels, first, own = ["\0"], array("I"), array("q", [0])
        level = [(0, len(words), 0)]
        while level:
            below = []
            for lo, hi, depth in level:
                first.append(len(labels))
                while lo < hi and len(words[lo]) == depth:
                    lo += 1
                while lo < hi:
                    c, end = words[lo][depth], lo + 1
                    while end < hi and words[end][depth] == c:
                        end += 1
                    labels.append(c)
                    own.append(counts[lo] if len(words[lo]) == depth + 1 else 0)
                    below.append((lo, end, depth + 1))
                    lo = end
            level = below
        first.append(len(labels))
        return cls("".join(labels), first, own)

    def pack(self) -> tuple[str, bytes, bytes]:
        return self.labels, self.first.tobytes(), self.counts.tobytes()

    @classmethod
    def unpack(cls, labels: str, first: bytes, counts: bytes) -> Trie:
        return cls(labels, array("I", first), array("q", counts))

    def exact(self, node: int, rest: str) -> int:
        """Count of the word that rest leads to from a node, 0 if there is none."""
        find, first = self.labels.find, self.first
        for c in rest:
            node = find(c, first[node], first[node + 1])
            if node < 0:
                return 0
        return self.counts[node]

    def neighbours(self, word: str) -> dict[str, int]:
        """Words of the trie that differ from word by one inserted, deleted or replaced code point, with their counts."""
        found: dict[str, int] = {}
        labels, first, exact = self.labels, self.first, self.exact
        node = 0
        for i in range(len(word) + 1):
            lo, hi = first[node], first[node + 1]
            rest, after = word[i:], word[i + 1 :]
            for child in range(lo, hi):
                c = labels[child]
                if i < len(word) and c != rest[0] and (n := exact(child, after)):
                    found[word[:i] + c + after] = n
                if n := exact(child, rest):
                    found[word[:i] + c + rest] = n
            if i == len(word):
                break
            if n := exact(node, after):
                found[word[:i] + after] = n
            node = labels.find(rest[0], lo, hi)
            if node < 0:
                break
        return found


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words and their counts to rows of a shard each."""

    def row(words: list[str], counts: list[int]) -> pa.RecordBatch:
        labels, first, own = Trie.of(words, counts).pack()
        cols = [pa.array([words[0]]), pa.array([sum(map(len, words))], pa.int64()), pa.array([labels]), pa.array([first]), pa.array([own])]
        return pa.RecordBatch.from_arrays(cols, names=["start", "chars", "labels", "first", "counts"])

    words, counts, held = [], [], 0
    for b in batches:
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            if words and held + len(w) > SHARD_CHARS:
                yield row(words, counts)
                words, counts, held = [], [], 0
            words.append(w)
            counts.append(n)
            held += len(w)
    if words:
        yield row(words, counts)


def trie_shards(words: DataFrame) -> DataFrame:
    """start, chars, labels, first, counts: a row for each shard of the sorted words. A shard has SHARD_CHARS at most, or one word."""
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    ranges = words.repartitionByRange(max(1, -(-chars // SHARD_CHARS)), "word").sortWithinPartitions("word")
    return materialise(ranges.mapInArrow(_shards, "start string, chars long, labels string, first binary, counts binary"))


def rounds(shards: DataFrame) -> list[list[str]]:
    """The shards' first words in lots of ROUND_CHARS; the driver has a word for each shard of a million characters."""
    lots, held = [], ROUND_CHARS
    for r in shards.select("start", "chars").orderBy("start").collect():
        if held + r.chars > ROUND_CHARS:
            lots.append([])
            held = 0
        lots[-1].append(r.start)
        held += r.chars
    return lots


def _walks(tries: list[Trie]):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            found = [(w, f, n) for w in b.column("word").to_pylist() for t in tries for f, n in t.neighbours(w).items()]
            words, forms, counts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(forms, pa.string()), pa.array(counts, pa.int64())], names=["word", "near", "near_n"])

    return walk


def neighbours(words: DataFrame) -> DataFrame:
    """word, near, near_n: all pairs at a distance of one, both ways, from rounds over broadcast shards."""
    spark, shards, out = words.sparkSession, trie_shards(words), None
    for lot in rounds(shards):
        held = spark.sparkContext.broadcast([tuple(r) for r in shards.filter(F.col("start").isin(lot)).select("labels", "first", "counts").collect()])

        def walk(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            return _walks([Trie.unpack(*t) for t in held.value])(batches)

        part = materialise(words.select("word").mapInArrow(walk, "word string, near string, near_n long"))
        out = part if out is None else out.union(part)
    drop_table(shards)
    return words.selectExpr("word", "word AS near", "n AS near_n").limit(0) if out is None else out


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form (null: none). word, root: the last of the word's forms. The path doubles in every round."""
    now = materialise(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        up = now.filter("word <> root").select(F.col("word").alias("root"), F.col("root").alias("up"))
        then = materialise(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        drop_table(now)
        now = then.select("word", "root")
        if then.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words: word, n, distinct. word, form, root, n, n_near, form_n."""
    words = materialise(words)
    # Words are spread anew, WALKED to a task: the files have as many as the counting left in a partition.
    spread = words.repartition(words.count() // WALKED + 1, "word")
    near = neighbours(spread).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    best = words.join(near, "word", "left").withColumn("form_n", -F.col("best.col1"))
    strong = F.col("form_n") >= ratio * F.col("n")
    table = materialise(
        best.select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("form_n")).alias("form_n"))
    )
    return table.join(roots(table), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op12_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(read(spark, sf_dir, "documents")))
