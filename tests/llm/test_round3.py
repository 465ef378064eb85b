"""Filter audit, spelling variants and the word shuffle against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from brute import SPACED, sha
from pyspark.sql import functions as F

from rillwork.llm import op11_audit, op12_variants, op13_pretokens, queries
from rillwork.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs():
    rng = random.Random(5)
    words = ["stone", "River", "THE", "a#b", "façade", "naïve", "l'été", "x" * 70, "über"]
    texts = [None, "", " ", "\n\t ", "one", "A" * 40, "#", "日本語 テキスト", "a\x1cb\x85c\xa0d  e　f", "'ll 's'", "emoji 👍🏽 ok"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice([3, 199, 200, 201, 400]))) for _ in range(60)]
    texts += texts[20:40] + [texts[30]] * 25
    rows = [(i, t, "en", rng.choice(["a", "b", None]), 1) for i, t in enumerate(texts)]
    return [*rows, (3, texts[15], "en", "a", 1), (None, texts[30], "en", "b", 1), (None, None, None, None, None), (30, texts[30], "en", "b", 1)]


def audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails, parts = [], sorted({r[3] or "" for r in rows})
    for d, t, _, s, _ in rows:
        t = t or ""
        w = SPACED.findall(t)
        fails.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(o[0] is not None and o[0] < d and (o[1] or "") == t for o in rows),
        })
    out = set()
    for part in parts:
        own = [i for i, r in enumerate(rows) if (r[3] or "") == part]
        steps, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                shapley[f] += len(gone)
                redundant = sum(fails[i][f] for i in own) - len(gone)
                unique = sum(fails[i][f] and sum(fails[i].values()) == 1 for i in own)
                steps.append((part, "".join(order), k, len(left), len(gone), redundant, unique, sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone), f))
        out |= {(*s[:-1], shapley[s[-1]]) for s in steps}
    return out


LABELS = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 100, 3)] + [(3, 1, None), (None, 1, 1), (6, None, 1)]


def test_audit_against_every_order(spark):
    rows = odd_docs()
    docs = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit(1)).withColumn("mask", F.lit(1)).withColumn("key", F.lit(1)).repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = op11_audit.filter_audit(op11_audit.mask_counts(op11_audit.failure_masks(docs), labels)).collect()
    assert len(got) == 3 * 600
    assert {tuple(r) for r in got} == audit(rows, LABELS)


def test_audit_of_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert op11_audit.filter_audit(op11_audit.mask_counts(op11_audit.failure_masks(docs), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))).count() == 0


def test_audit_counts_words_of_long_texts_in_parts():
    text = b"a b\tc " * 700_000 + "é" .encode() * 3_000_000
    assert b"".join(op11_audit.chunks(text)) == text
    assert sum(len(x.split()) for x in op11_audit.chunks(text)) == len(text.split())


def variants(rows):
    runs = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            runs[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in runs.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    form, n_near = {}, {}
    for w in words:
        own = [o for k in (-1, 0, 1) for o in by_size.get(len(w) + k, ()) if near(w, o)]
        n_near[w] = len(own)
        best = min(own, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, n_near[w], words[form[w]] if form[w] else None) for w, n in words.items()}


def typed(n=150):
    rng = random.Random(3)
    base = ["kitchen", "letters", "lettres", "garçons", "ÀÉÎõüß", "x×÷ÿabc", "Station", "mountain", "abbbba", "y" * 80]
    letters = "abcdeé"

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])

    pool = base + [slip(w) for w in base for _ in range(6)]
    pool += [slip(w) for w in pool[10:]]
    weights = [2 ** (i % 9) for i in range(len(pool))]
    return [(i, " ".join(rng.choices(pool, weights, k=120)), "en", "a", 1) for i in range(n)]


def test_variants_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(op12_variants, "SHARD_CHARS", 150)
    monkeypatch.setattr(op12_variants, "ROUND_CHARS", 400)
    rows = [*typed(), (None, "kitchen kitchenn " * 9, None, None, None), (4, None, "", "", 0), (4, "", "", "", 0), (4, "kitchem " * 20000, "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("id", F.lit("q")).repartition(3)
    words = op12_variants.word_counts(docs)
    assert op12_variants.trie_shards(words).count() > 5
    got = [tuple(r) for r in op12_variants.variants(words).collect()]
    want = variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] and r[1] != r[2] for r in want)


def test_variants_of_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in queries()["op12_trie_variants"](spark, SF).collect()} == variants(rows)


def test_variants_of_no_rows(spark):
    assert op12_variants.variants(op12_variants.word_counts(spark.createDataFrame([], DOCS))).count() == 0


def test_small_tables_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(op12_variants, "HELD", 3)
    rows = typed(20)
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.word: r.n for r in op12_variants.word_counts(docs).collect()}
    assert got == {w: n for w, _, _, n, _, _ in variants(rows)}


def test_trie_holds_its_words():
    words = sorted({"a", "ab", "abc", "b", "ba", "é", "日本"})
    trie = op12_variants.Trie.unpack(*op12_variants.Trie.of(words, list(range(1, len(words) + 1))).pack())
    assert [trie.exact(0, w) for w in words] == list(range(1, len(words) + 1))
    assert trie.exact(0, "") == trie.exact(0, "abcd") == 0
    assert trie.neighbours("ab") == {"a": 1, "abc": 3, "b": 4}


def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op13_pretokens.ranks(tokenizer_path(op13_pretokens.RANKS)), special_tokens={})


def digests(rows):
    own = library()
    out = []
    for d, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        out.append((d, len(ids), sha(" ".join(map(str, ids))), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1, 3000, op13_pretokens.BLOCK])
def test_word_shuffle_against_the_library(spark, block):
    rows = [*odd_docs(), (77, "many words here " * 60000, "en", "a", 1), (78, "<|endoftext|> x", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("i")).withColumn("key", F.lit(1)).withColumn("words", F.lit(1)).repartition(3, "n_chars", "text")
    coded = op13_pretokens.decode(op13_pretokens.encode(docs, block=block), op13_pretokens.token_table(spark))
    got = [(r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids))), hashlib.sha256(r.decoded).hexdigest()) for r in coded.collect()]
    assert sorted(got, key=str) == sorted(digests(rows), key=str)


def test_word_shuffle_of_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries()["op13_word_shuffle"](spark, SF).collect())) == sorted(digests(rows))


def test_word_shuffle_of_no_rows(spark):
    assert op13_pretokens.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_pattern_cuts_as_the_library():
    """Every code point between two words: cut by the pattern, its pieces have the library's ids."""
    own, find = library(), op13_pretokens.pre_tokenizer()
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for lot in (points[i : i + 500] for i in range(0, len(points), 500)):
        texts = [f"a{c}b {c}1{c}{c} x {c}\n" for c in lot]
        whole = own.encode_ordinary_batch(texts, num_threads=4)
        assert [[i for w in find(t) for i in own.encode_ordinary(w)] for t in texts] == whole


def test_each_word_is_encoded_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"same words w{i}") for i in range(50)], "doc_id long, text string").repartition(6)
    rows = op13_pretokens.exploded(docs, 4, block=20).filter("sequence IS NULL").collect()
    seen = Counter((r.key, w) for r in rows for w in set(op13_pretokens.parted(r.sizes, r.words)))
    assert len({w for _, w in seen}) == len(seen)  # a word has one bucket


def test_a_block_without_its_words_is_an_error(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    rows = op13_pretokens.exploded(docs, 4)
    sequences = rows.filter("sequence IS NOT NULL").select("key", "sequence", "doc_ids", "pieces")
    none = spark.createDataFrame([], "block long, numbers binary, counts binary, ids binary")
    with pytest.raises(Exception, match="lacks words"):
        sequences.groupBy("key").cogroup(none.groupBy("block")).applyInArrow(op13_pretokens._assembled, "doc_id long, ids array<int>").collect()
