import random

from pyspark.sql import functions as F

import corpus_pipeline
from rillwork.llm import op7_simhash
from test_core import SF


def sets_of(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_kept(docs):
    sets, up = [sets_of(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                up[root(i)] = root(j)
    return {min(d for k, (d, _) in enumerate(docs) if root(k) == root(i)) for i in range(len(docs))}


def test_near_copies_of_changed_words_go(spark):
    """About one word in 60 replaced: five-word similarity of 0.8 or more, mostly beyond two bits of a fingerprint."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(50, 600))]
        docs.append(" ".join(base))
        for _ in range(3):
            own = list(base)
            for k in rng.sample(range(len(own)), max(1, len(own) // 60)):
                own[k] = word()
            docs.append(" ".join(own))
        docs.append(" ".join(base[: len(base) // 2]))
    docs += ["", None, "a b", "A  b", "a c"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_kept([r[:2] for r in rows])
    got = corpus_pipeline.near_dedup(spark, table, SF)
    assert {r.doc_id for r in got.collect()} == want and len(want) == 12 * 2 + 3
    assert got.columns == table.columns
    assert op7_simhash.keep_first(table).count() > len(want)
    assert corpus_pipeline.near_dedup(spark, table.limit(0), SF).count() == 0
    nameless = table.filter("doc_id < 10").select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    assert corpus_pipeline.near_dedup(spark, nameless, SF).count() == len({d for d in want if d < 10})
