import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import brute
from rillwork.llm import op1_quality, op6_codes, op7_simhash, op8_counts, op9_chat
from rillwork.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "one"), (4, "a b c d " * 30), (4, "a b c d " * 30), (None, "x  y\n\n z\t"), (6, "w" * 70_000), (7, " ".join(f"w{i}" for i in range(30_000))), (8, "it's <|endoftext|> <s> é ﬁ ▁ 日本\n \n q")]


def docs_of(name="documents"):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "h", 5, True) for i, t in ODD], "doc_id long, text string, source string, n_words long, k1 boolean")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_op1_base(spark, odd, none):
    want = sorted((r["doc_id"], *brute.base_counts(r["text"])) for r in docs_of())
    got = op1_quality.op1_line_frequency(spark, SF)
    assert sorted(tuple(r)[:7] for r in got.collect()) == want
    got = op1_quality.line_verdicts(odd).drop("k1", "k2").collect()
    assert sorted([tuple(r)[:7] for r in got], key=str) == sorted([(i, *brute.base_counts(t)) for i, t in ODD], key=str)
    assert op1_quality.line_verdicts(none).count() == 0 and op1_quality.apply_rules(none).columns == none.columns


def lines_docs():
    own = lambda i, n: " ".join(f"t{i}x{k}" for k in range(n))
    rows = [(i, own(i, 60) + "\nAccept  our cookies now\n" + own(-i, 20), "h") for i in range(1, 41)]
    rows += [(100 + i, own(100, 70) + "\n" + own(101, 70), "h") for i in range(30)]  # copies of one document
    rows += [(200, "\n".join(["accept our cookies now"] * 14 + [own(200, 6)]), "h"), (300, own(300, 55) + "\nAccept our cookies now", "other"), (301, own(301, 60) + "\nAccept our cookies now", None)]
    return rows


def test_op1_lines(spark):
    docs = spark.createDataFrame(lines_docs(), "doc_id long, text string, source string")
    got = {r.doc_id: r for r in op1_quality.line_verdicts(docs).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 4 for i in range(1, 41))
    assert all(got[100 + i].kept and not got[100 + i].n_removed_words for i in range(30))  # copies are left to other operators
    assert not got[200].kept and got[300].kept and got[300].n_removed_words == 0
    out = {r.doc_id: r.text for r in op1_quality.apply_rules(docs).collect()}
    assert 200 not in out and "cookies" not in out[5] and out[5].count("\n") == 1 and "cookies" in out[300] and "cookies" in out[301]


def test_op7(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in docs_of()]
    for table, own in ((op7_simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")), rows), (op7_simhash.near_duplicates(odd), ODD)):
        fps, least = brute.near_groups(own)
        got = sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in table.collect()], key=str)
        assert got == sorted([(i, f, c) for (i, _), f, c in zip(own, fps, least)], key=str)
    assert op7_simhash.near_duplicates(none).count() == 0
    kept = op7_simhash.keep_first(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute.near_groups(rows)[1]))
    assert op7_simhash.keep_first(odd).columns == odd.columns


def test_op7_trees_of_a_hot_shard(spark):
    import random

    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = {s ^ (1 << a) ^ (1 << b) for s in seeds for a in range(64) for b in rng.sample(range(64), 6)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_groups(fps)
    for tree_max in (20_000, 7):
        found = op7_simhash.links(table, tree_max=tree_max).collect()
        assert brute_groups(fps, [(r.a % (1 << 64), r.b % (1 << 64)) for r in found]) == want


def brute_groups(fps, links=None):
    fps = sorted(fps)
    links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2] if links is None else links
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 2
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in fps}


def test_op6(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for table, own in ((op6_codes.op6_addressable_codes(spark, SF), [(r["doc_id"], r["text"]) for r in docs_of()]), (op6_codes.read_back(op6_codes.write_segments(odd, segment_tokens=200)), ODD)):
        want, start = [], 0
        for i, t in sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((i, start, len(ids), brute.crc(ids)))
            start += len(ids)
        assert sorted([tuple(r) for r in table.collect()], key=lambda r: r[1]) == want
    segments = op6_codes.write_segments(spark.read.parquet(f"{SF}/documents.parquet"), segment_tokens=3000)
    ids = [x for r in sorted(docs_of(), key=lambda r: r["doc_id"]) for x in [*library.encode(r["text"], add_special_tokens=False).ids, 2]]
    assert [op6_codes.token_at(segments, i) for i in (0, 2999, 3000, 9999, len(ids) - 1, len(ids))] == [ids[0], ids[2999], ids[3000], ids[9999], ids[-1], None]
    assert op6_codes.read_back(op6_codes.write_segments(none)).count() == 0


def test_op6_one_token_by_offset(spark):
    """A token's bytes are where the header says, in a plain file."""
    import struct

    row = op6_codes.write_segments(spark.read.parquet(f"{SF}/documents.parquet")).first()
    path = row.file.removeprefix("file://")
    want = op6_codes.open_segment(row.file).ids(0, row.n_tokens).tolist()
    with open(path, "rb") as f:
        _, bits, levels, _, n = struct.unpack("<4sBBHQ", f.read(16))
        sizes = struct.unpack(f"<{levels}Q", f.read(8 * levels))
        assert (bits, n) == (8, row.n_tokens) and sizes[0] == n
        for i in (0, 1, 777, n - 1):
            f.seek(16 + 8 * levels + i)
            assert f.read(1)[0] == want[i] & 255
    reads = []
    held = op6_codes.open_segment(row.file)
    own = op6_codes.Segment(lambda at, size: reads.append(size) or held.read(at, size))
    assert [own.access(i) for i in (5, n // 2, n - 1)] == [want[5], want[n // 2], want[n - 1]]
    assert max(reads[2:]) <= op6_codes.RANK_BITS // 8 and len(reads) < 40


def test_op6_files_of_other_settings(tmp_path):
    """Where a tokenizer file has other settings, the library takes whole texts."""
    import json

    from rillwork.llm.tokens import ByteLevelIds, is_plain
    from tokenizers import Tokenizer

    held = json.load(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8"))
    held["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(held))
    assert is_plain(tokenizer_path("byte_bpe_50k.json")) and not is_plain(str(other))
    texts = ["one two, three", "it's\n\nso"]
    library = Tokenizer.from_file(str(other))
    assert [list(memoryview(x).cast("I")) for x in ByteLevelIds(str(other)).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_op6_strings_like_the_library():
    import random

    from rillwork.llm.tokens import ByteLevelIds
    from tokenizers import Tokenizer

    rng = random.Random(9)
    parts = ["a", "The", " ", "  ", "\n", "\n\n", "\t", ",", ".", "...", "'s", "'", "12", "é", "ß", "!", "?", ":", ";", "-", "_", "x1", "1x", "日本", "\xa0", "\0", "ª", "<|endoftext|>", "²", "½", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    path = tokenizer_path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    for most in (400_000, 50):
        got = ByteLevelIds(path, most).encode(texts)
        assert all(list(memoryview(g).cast("I")) == w.ids for g, w in zip(got, want))


def test_op6_random_access():
    import numpy as np

    rng = np.random.default_rng(5)
    for n, bits in ((0, 8), (1, 8), (511, 8), (512, 4), (5000, 8), (5000, 3), (5000, 1)):
        ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 33, n, dtype=np.uint64)).astype(np.uint32)
        s = op6_codes.Segment.of(op6_codes.encode_segment(ids, bits))
        assert [s.access(i) for i in range(0, n, 7)] == ids[::7].tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n, n), (max(0, n - 1), n)):
            assert s.ids(a, b).tolist() == ids[a:b].tolist()


def test_op8(spark, odd, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    odd_rows = [*ODD, (20, " a"), (21, "a  b"), (22, " "), (23, "a "), (24, "\nx\n\n y \n")]
    more = spark.createDataFrame([(i, t) for i, t in odd_rows], "doc_id long, text string")
    for table, own in ((op8_counts.op8_token_counts(spark, SF), [(r["doc_id"], r["text"]) for r in docs_of()]), (op8_counts.token_counts(more), odd_rows)):
        want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in own]
        assert sorted([tuple(r) for r in table.collect()], key=str) == sorted(want, key=str)
    assert op8_counts.token_counts(none).count() == 0


def conv_rows():
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in docs_of("conversations")]
    rows += [(900, k, "assistant" if k % 2 else "user", "word " * (7 * k % 61)) for k in range(40)] + [(901, 0, "system", "s " * 3000), (901, 1, "user", None), (901, 2, "assistant", "big " * 2500), (901, 3, "assistant", "end")]
    return rows + [(902, 1, "user", r"a\l <b> \\ </turn> \g" + "\0\1\0\2"), (902, 1, "user", "tie"), (902, 1, "user", "tie"), (None, 0, None, "n"), (None, None, "assistant", r"\\l")]


def test_op9(spark):
    rows = conv_rows()
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
    out = op9_chat.windows(table, budget=200, history=40)
    got = {r.conv_id: r for r in op9_chat.digests(out).collect()}
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        target = "".join(t for _, _, role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), brute.sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(target), brute.sha(target))
    windows = out.filter("conv_id is not null").collect()
    assert sum(len(w.formatted) for w in windows if w.conv_id == 900) == got[900].formatted_chars
    for w in windows:
        own = [p for p in w.parts if not p.repeated]
        assert w.n_tokens <= 200 or len(own) == 1 or w.conv_id == 901
        assert [p.n for p in own] == list(range(own[0].n, own[-1].n + 1))
        assert all(not p.loss for p in w.parts if p.repeated)
        if w.conv_id == 901:
            assert w.formatted.startswith("<turn system>")
    assert any(p.repeated for w in windows if w.conv_id == 900 for p in w.parts)
    assert op9_chat.digests(op9_chat.windows(table.limit(0))).count() == 0


def test_op9_budget_with_history(spark):
    """No window goes beyond the budget unless one turn does, with what is repeated and in long runs without spaces."""
    loads = [160, 160, 150, 170, 380, 512, 30, 30, 30, 400, 90, 700, 100, 20]
    rows = [(1, k, "assistant" if k % 2 else "user", "w " * (n - 6)) for k, n in enumerate(loads)]
    rows += [(2, 0, "system", "s " * 200)] + [(2, k + 1, "user", "w " * (n - 6)) for k, n in enumerate(loads)]
    rows += [(3, k, "user", "日本語" * 100) for k in range(8)] + [(4, k, "user", "x" * 900) for k in range(8)]
    out = op9_chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(w.n_tokens <= 1024 for w in out) and any(p.repeated for w in out if w.conv_id == 1 for p in w.parts)
    assert sum(w.conv_id == 3 for w in out) > 2 and sum(w.conv_id == 4 for w in out) > 2


def test_op9_query_is_native(spark):
    plan = op9_chat.op9_chat_windows(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert op9_chat.op9_chat_windows(spark, SF).filter("conv_id = -7").select(F.col("loss_sha256")).first()[0] == brute.sha(op9_chat.PROBE)
