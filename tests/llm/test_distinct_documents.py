from rillwork.llm import op1_quality

MENU = ["home navigation news contact", "all rights are kept here", "sign in or join us now", "conditions of use and help", "back to the top again"]


def own(i, n):
    return " ".join(f"u{i}x{k}" for k in range(n))


def test_stub_pages_count_each(spark):
    """60 pages of menu lines with a short line of their own: distinct texts, so their menu goes."""
    stubs = [(i, "\n".join([*MENU, f"item {i} only", *MENU, own(i, 9)]), "stubs") for i in range(60)]
    docs = spark.createDataFrame([*stubs, *((100 + i, own(i, 80), "stubs") for i in range(60))], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in op1_quality.line_verdicts(docs).collect()}
    assert all(got[i].n_removed_words == 2 * sum(len(x.split()) for x in MENU) for i in range(60))
    assert all(got[100 + i].kept and not got[100 + i].n_removed_words for i in range(60))


def test_a_large_host_does_not_raise_the_limit(spark):
    """A line on 101 of 1,500 documents goes, one on 100 of them stays."""
    rows = [(i, own(i, 60) + "\nshown on many pages" * (i < 101) + "\nshown on fewer" * (i < 100), "h") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_removed_words for r in op1_quality.line_verdicts(docs).collect()}
    assert all(got[i] == (4 if i < 101 else 0) for i in got)
    copies = spark.createDataFrame([(i, own(7, 60) + "\nx y", "h") for i in range(300)], "doc_id long, text string, source string")
    assert {r.n_removed_words for r in op1_quality.line_verdicts(copies).collect()} == {0}
