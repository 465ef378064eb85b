from collections import defaultdict

import pyarrow.parquet as pq

import brute
import corpus_pipeline
from rillwork.llm import op2_packing
from test_core import SF
from test_op10 import brute_lines


def normal(line):
    return " ".join(brute.SPACED.findall(brute.lowered(line)))


def plain_quality(docs):
    """{id: text} of what stays. Documents of the same words are one."""
    lines, hosts = defaultdict(set), defaultdict(set)
    for d in docs:
        words = normal(d["text"]) or d["text"]
        hosts[d["source"]].add(words)
        for x in d["text"].split("\n"):
            if normal(x):
                lines[d["source"], normal(x)].add(words)
    out = {}
    for d in docs:
        most, own = len(hosts[d["source"]]), d["text"].split("\n")
        often = lambda x: len(lines[d["source"], normal(x)])  # noqa: B023, E731
        gone = [bool(normal(x)) and often(x) > 10 and (often(x) > 0.1 * most or often(x) > 100) for x in own]
        n_words, *_, failed = brute.base_counts(d["text"])
        left = n_words - sum(len(normal(x).split()) for x, g in zip(own, gone) if g)
        if not failed and left >= 0.2 * n_words:
            out[d["doc_id"]] = "\n".join(x for x, g in zip(own, gone) if not g)
    return out


def plain_near(docs):
    """Ids of the documents that stay: the least of each group that a similarity of 0.8 of five-word shingles connects."""
    sets = {}
    for i, t in docs.items():
        words = normal(t).split()
        k = min(5, len(words))
        sets[i] = frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if words else frozenset()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {root(i) for i in sets}


def test_stages_against_brute_force(spark):
    """Each stage by its own input."""
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = table.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        table = corpus_pipeline.materialise(stage(spark, table, SF))
        steps[name] = table.collect()
    texts = {name: {r.doc_id: r.text for r in steps[name]} for name in list(steps)[:4]}
    assert texts["quality_rules"] == plain_quality(docs) and len(texts["quality_rules"]) > 100
    before, after = texts["quality_rules"], texts["line_dedup"]
    gone, _ = brute_lines(spark, sorted(before.items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in before.items()}
    assert after.keys() == want.keys() and sum(after[i] != want[i] for i in want) <= 0.03 * len(want)
    assert all(r.n_chars == len(r.text) for r in steps["line_dedup"])
    assert texts["near_dedup"].keys() == plain_near(after) and all(after[i] == t for i, t in texts["near_dedup"].items())
    assert texts["decontamination"] == {i: t for i, t in texts["near_dedup"].items() if not brute.hits(t, items)[1]}
    assert all(list(r.asDict()) == columns for name in list(steps)[:4] for r in steps[name][:3])
    assert {r.doc_id for r in steps["packing"]} == set(texts["decontamination"])
    bins = defaultdict(int)
    for r in steps["packing"]:
        bins[r.bin_id, r.capacity] += r.length
    assert all(c == op2_packing.smallest(n, op2_packing.SIZES) for (_, c), n in bins.items())
    assert corpus_pipeline.run(spark, SF).count() == len(steps["packing"])


def test_empty_and_odd_documents(spark):
    """Nulls, an empty and a long text, repeated rows, an empty table, and columns with names that the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, removed string, text__ int, `row` string, h long, k1 string, component string"
    more = ("r", 1, "w", 2, "k", "c")
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "word " * 60, "en", "s", 300), (3, "x" * 90_000, "en", "s", 90_000)]
    rows += [(4, " ".join(f"u{k}" for k in range(80)), "en", "s", 9)] * 2
    full = [(*r, *more) for r in rows]
    for table, n in ((spark.createDataFrame(full, schema), 1), (spark.createDataFrame([], schema), 0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = table.columns
            table = corpus_pipeline.materialise(stage(spark, table, SF))
            assert name == "packing" or table.columns == columns
        assert table.count() == n
