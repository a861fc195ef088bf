"""Chat records of mixed layouts, with fields beyond those of their layout."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat

RECORDS = {
    1: ({"id": "x", "messages": [{"role": "human", "content": "a", "name": "n"}, {"role": "gpt", "content": None}], "source": {"url": "u"}}, "messages", [(0, "user", "a"), (1, "assistant", "")]),
    2: ({"conversations": [{"from": "gpt", "value": "b", "weight": 1.5}]}, "conversations", [(0, "assistant", "b")]),
    3: ({"prompt": "p", "response": "r", "score": 2}, "prompt_response", [(0, "user", "p"), (1, "assistant", "r")]),
    4: ({"system": "s", "prompt": "p", "response": "r", "tags": []}, "system_prompt", [(0, "system", "s"), (1, "user", "p"), (2, "assistant", "r")]),
    5: ({"instruction": "i", "input": "j", "output": "o", "id": 5}, "instruction_input", [(0, "user", "i\n\nj"), (1, "assistant", "o")]),
    6: ({"instruction": "i", "output": None, "lang": "en"}, "instruction", [(0, "user", "i"), (1, "assistant", "")]),
    7: ({"turn": None, "role": "human", "text": "t \u0000\"\n", "conv": 7}, "turn_row", [(None, "human", "t \u0000\"\n")]),
    8: ({"prompt": {"nested": "p"}, "response": "r"}, None, [(None, None, None)]),
    9: ({"messages": [{"role": "user", "content": [{"text": "part"}]}]}, None, [(None, None, None)]),
    10: ({"meta": {"prompt": "p", "response": "r"}}, None, [(None, None, None)]),
}


def rows_of(df):
    found = {}
    for r in df.collect():
        found.setdefault((r.conv_id, r.layout), []).append((r.turn, r.role, r.text))
    return {k: sorted(v, key=str) for k, v in found.items()}


def test_fingerprints_select_mappings_whatever_else_a_record_has(spark):
    records = [(k, json.dumps(r)) for k, (r, _, _) in RECORDS.items()] + [(11, None), (12, "no JSON {")]
    want = {(k, layout): turns for k, (_, layout, turns) in RECORDS.items()} | {(11, None): [(None, None, None)], (12, None): [(None, None, None)]}
    assert rows_of(chat.turns_of_records(spark.createDataFrame(records, "record_id long, record string"))) == want


def test_typed_tables_may_have_more_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, None, None, None, None)], "conv_id long, turn long, role string, text string, source string")
    assert rows_of(chat.turns_of_table(turns)) == {(1, "turn_row"): [(0, "user", "a"), (None, "", "")]}
    lists = spark.sql("SELECT 2L conv_id, array(named_struct('role', 'user', 'content', 'b', 'name', 'n')) messages, 1 extra")
    assert rows_of(chat.turns_of_table(lists)) == {(2, "messages"): [(0, "user", "b")]}
    assert rows_of(chat.turns_of_table(spark.sql("SELECT 3L conv_id, 'c' other"))) == {(3, None): [(None, None, None)]}


@pytest.mark.parametrize("million", [25, 60])
def test_texts_of_tens_of_millions_of_characters_are_kept(spark, million):
    text = F.concat(F.lit("<|im_end|>"), F.repeat(F.lit("0123456789"), F.lit(million * 100_000)))
    rows = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), text.alias("text"))
    made = chat.format_chats(chat.turns_of_table(rows))
    read = made.select(chat.read_back(F.col("formatted"))[0]["text"].alias("text"), chat.text_under(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = read.select(F.length("text"), F.md5("text"), F.md5("loss")).first()
    want = rows.select(F.length("text"), F.md5("text"), F.md5("text")).first()
    assert tuple(got) == tuple(want) and got[0] > million * 1_000_000
    records = rows.select(F.lit(1).alias("record_id"), F.concat(F.lit('{"prompt": "p", "response": "'), "text", F.lit('"}')).alias("record"))
    assert [(r.layout, r.n) for r in chat.turns_of_records(records).select("layout", F.length("text").alias("n")).collect()] == [("prompt_response", 1), ("prompt_response", want[0])]


def test_a_record_beyond_all_limits_is_an_error_and_not_lost(spark):
    record = F.concat(F.lit('{"prompt": "p", "response": "'), F.repeat(F.lit("x"), F.lit(140_000_000)), F.lit('"}'))
    with pytest.raises(Exception, match="128 MB"):
        chat.turns_of_records(spark.range(1).select(F.lit(1).alias("record_id"), record.alias("record"))).select(F.length("text")).collect()
