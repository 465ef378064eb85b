"""Candidates that earlier rounds left out: the rest of an op10 key, and the fingerprints' links in the pipeline's near copies."""

import random

from pyspark.sql import functions as F

from rillwork.llm import near_copies, op7_simhash, op10_lines
from rillwork.llm.common import row_keys, text_bytes


def test_all_pairs_of_a_large_key(spark):
    """Lines of one key whose likes differ at both ends, so that they stand far apart in both orders."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    texts = []
    for _ in range(30):
        line = [word() for _ in range(14)]
        texts += [" ".join(line), " ".join([word(), *line[1:-1], word()])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = docs.select("doc_id", *row_keys("doc_id", "text"), text_bytes("text").alias("text"))
    found = given.mapInArrow(op10_lines._features, "doc_id long, k1 long, k2 long, n_lines int, line int, h long, n int, keys array<long>").withColumn("keys", F.array(F.lit(7).cast("long")))
    got = {r.node: r.component for r in op10_lines.line_groups(docs, found, "doc_id", "text").collect()}
    h = [op10_lines.line_hash(t.encode()) for t in texts]
    assert all(got[h[i]] == got[h[i + 1]] for i in range(0, 60, 2)) and len(set(got.values())) == 30


def test_rest_pairs_against_loops(spark):
    rng = random.Random(9)
    rows = [(k, h, rng.randint(10, 14), rng.choice([h, 1])) for k, n in ((1, 9), (2, 5), (3, 40)) for h in range(100 * k, 100 * k + n)]
    got = {tuple(r) for r in op10_lines.rest_pairs(spark.createDataFrame(rows, "key long, h long, n int, component long"), 0.8).collect()}
    assert got == {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] != 2 and x[1] < y[1] and x[3] != y[3] and min(x[2], y[2]) >= 0.8 * max(x[2], y[2])}


def test_near_copies_take_the_links_of_fingerprints(spark, monkeypatch):
    """The pipeline's near copies ask op7's BK-trees, and a pair of fingerprints within two bits is a candidate."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(20):
        line = [word() for _ in range(900)]
        texts += [" ".join(line), " ".join([*line[:-1], word()])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, plain = [], near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda df: asked.append(df.count()) or plain(df))
    kept = {r.doc_id for r in near_copies.keep_first(docs).collect()}
    assert kept == set(range(0, 40, 2)) and asked
    fps, hs = [op7_simhash.fingerprint(t.encode()) for t in texts], [near_copies.set_hash(near_copies.shingles(t.encode())) for t in texts]
    near = [(i, j) for i in range(40) for j in range(i) if ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count() <= 2]
    feats = spark.createDataFrame(list(zip(hs, fps)), "h long, fp long")
    pairs = {tuple(r) for r in near_copies.fingerprint_pairs(feats).collect()}
    assert len(near) >= 10 and all(tuple(sorted((hs[i], hs[j]))) in pairs for i, j in near)
