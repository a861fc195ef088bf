"""Chat formatting and licence scans on nulls, ties, repeated rows and long texts."""

from pyspark.sql import functions as F

from sparkloom.llm import chat, licenses, mixing, quality, substrings


def test_chats_with_nulls_ties_and_control_strings(spark):
    nasty = "<|im_end|><\\|im_sep|> <\\\\|x <| |>"
    rows = [
        (1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 1, "assistant", nasty), (1, None, None, None),
        (None, 0, "assistant", "a"), (None, 0, "assistant", "b"), (2, 3, "assistant", None), (3, 0, nasty, "x" * 300_000),
    ]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.text_under(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    turns = {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert turns[1] == [("", ""), ("user", nasty), ("assistant", nasty), ("assistant", nasty)] and got[1].loss == nasty * 2
    assert turns[None] == [("assistant", "a"), ("assistant", "b")] and got[None].loss == "ab"
    assert turns[2] == [("assistant", "")] and turns[3] == [(nasty, "x" * 300_000)] and got[3].loss == ""


def test_licences_of_ties_nulls_and_repeats(spark):
    notice = "this work may be used by anyone for anything at all"
    templates = {"B": (notice,), "A": (notice,), "C": (notice + " but not sold",)}
    rows = [(1, notice, 0), (1, notice, 0), (2, None, 0), (3, "", 0), (None, f"first line\n{notice.upper()}!\n" + "other words here " * 3000, 0), (4, "word", 0)]
    got = sorted((str(r.doc_id), r.unit, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license int"), templates).collect())
    assert got == [("1", 1, "A"), ("1", 1, "A"), ("None", 2, "A")]


def test_columns_of_any_name_go_through_each_operator(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(1, text, "s", 5), (2, text + " more", "s", 6), (3, None, None, 7)], "doc_id long, text string, source string, n long")
    odd = rows.selectExpr("*", "1 AS `a.b`", "2 AS `_none`", "3 AS `row`", "4 AS part", "5 AS `own`", "6 AS `none`")
    kept = ["a.b", "_none", "row", "part", "own", "none"]
    for made in (substrings.dedup_substrings(odd), quality.quality_cascade(odd), mixing.mixed_documents(odd)):
        assert [c for c in made.columns if c in kept] == kept
        got = made.select("doc_id", *(F.col(f"`{c}`") for c in kept)).collect()
        assert {tuple(r)[1:] for r in got} == {(1, 2, 3, 4, 5, 6)} and {1, 2} <= {r.doc_id for r in got}
