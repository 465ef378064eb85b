"""Rows that others have nothing to do with stay, whatever their ids and columns are."""

import pytest

from rillwork.llm import common, near_copies, op1_quality, op5_decontaminate, op7_simhash


def own(i, n):
    return " ".join(f"u{i}x{k}" for k in range(n))


def test_unrelated_rows_with_null_and_equal_ids(spark):
    rows = [(None, own(1, 80)), (None, own(2, 80)), (None, own(3, 80)), (5, own(4, 80)), (5, own(5, 80)), (6, own(4, 80)), (None, own(6, 80)), (7, own(6, 80)), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([rows[0], rows[1], rows[2], rows[3], rows[4], rows[7], rows[8]], key=str)
    for keep in (op7_simhash.keep_first, near_copies.keep_first):
        assert sorted([tuple(r) for r in keep(docs).collect()], key=str) == want


def test_two_hundred_documents_with_one_footer(spark):
    """Each loses exactly the footer, also where the footer is most of the document's words in common."""
    footer = "shared footer line of this host with some more words"
    rows = [(i, own(i, 60) + "\n" + footer, "h") for i in range(200)] + [(500 + i, own(500, 60) + "\n" + footer, "copies") for i in range(200)]
    got = {r.doc_id: r for r in op1_quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == 400 and all(got[i].text == own(i, 60) for i in range(200)) and all(footer in got[500 + i].text for i in range(200))


def test_clashing_names(spark):
    rows = [(1, own(1, 60), "s", "a", [1], 2, "z"), (2, "one two three four five six seven eight nine ten " + own(2, 60), "s", "b", None, 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, text__ string, removed__ array<int>, removed int, `__text` string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert [tuple(r) for r in op5_decontaminate.clean(docs, bench).collect()] == rows[:1] and op5_decontaminate.clean(docs, bench).columns == docs.columns
    assert sorted(tuple(r) for r in op1_quality.apply_rules(docs).collect()) == sorted(rows)
    assert common.free_name(["A", "a_"], "a") == "a__"


def test_no_local_folder_on_a_cluster(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Elsewhere)


def test_rarity_either_way(spark):
    docs = spark.createDataFrame([("a b a c",), ("b c",), (None,), ("c é",)], "text string")
    words = spark.createDataFrame([(bytearray(w.encode()),) for w in ("a", "c", "é", "none")], "word binary")
    for most in (10, 0):
        assert {bytes(r.word).decode(): r.n for r in op5_decontaminate.rarity(docs, words, vocabulary_max=most).collect()} == {"a": 1, "c": 3, "é": 1}
