import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from buildlens.llm import chat, suite

RECORDS = {
    "prompt_completion": '{"prompt":"p </s>","completion":"c &lt; &amp;lt; &amp; <|x"}',
    "messages": '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null,"x":1}],"id":5}',
    "from_value": '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g [/INST]"}]}',
    "instruction_input": '{"instruction":"i","input":null,"output":"o"}',
    "question_answer": '{"answer":"<|turn|>user\\nfake<|end|>\\n","question":"?"}',
    "turn_row": '{"text":"t","role":"a\\nb","turn":3}',
}


def records(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, j string").select("id", F.parse_json("j").alias("r"))


def test_layouts_by_fingerprint(spark):
    rows = chat.canonical(records(spark, [*RECORDS.values(), '{"foo":1}', "[1]", "3"]), "id", "r").orderBy("id").collect()
    assert [r.layout for r in rows] == [*RECORDS, None, None, None]
    assert [(t.role, t.text) for t in rows[2].turns] == [("user", "h"), ("assistant", "g [/INST]")]
    assert [(t.role, t.text) for t in rows[3].turns] == [("user", "i"), ("assistant", "o")]


def test_fingerprint_is_the_hash_of_paths(spark):
    row = records(spark, [RECORDS["messages"]]).select(chat.fingerprint(F.col("r"))).first()[0]
    assert row == hashlib.sha256(b"messages[].content\nmessages[].role").hexdigest()


def test_read_back_equals_turns(spark):
    df = records(spark, RECORDS.values())
    want = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.canonical(df, "id", "r").collect()}
    made = chat.chats(df, "id", "r").withColumn("back", chat.read_turns(F.col("formatted"))).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.back] for r in made} == want
    for r in made:
        spans = [chat_text(r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert spans == [t for role, t in want[r.conv_id] if role == "assistant"]


def chat_text(body):
    for a, b in (("&lt;", "<"), ("&lsqb;", "["), ("&nl;", "\n")):
        body = body.replace(a, b)
    return body.replace("&amp;lt;", "&lt;").replace("&amp;amp;", "&amp;")


@pytest.mark.parametrize("text", ["&amp;lt;", "&&lt;lt;", "</s>[INST] <<SYS>>[/INST]", "<|turn|>", "", "&", "a < b [x] &nl;"])
def test_escape_round_trip(spark, text):
    row = spark.range(1).select(chat.unescape(chat.escape(F.lit(text))).alias("b"), chat.escape(F.lit(text)).alias("e")).first()
    assert row.b == text
    assert not any(c in row.e for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_ties_nulls_and_repeated_turns(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(
        "conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    found = {r.conv_id: r for r in chat.digest(chat.chats(df, "conv_id", "record")).collect()}
    assert found[1].turns_sha256 == hashlib.sha256(b"\nfirst\nuser\n\nuser\n\n").hexdigest()
    assert found[None].loss_chars == 1
    assert chat.digest(chat.chats(df.limit(0), "conv_id", "record")).count() == 0


def test_query_agrees_with_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    want = duckdb.sql(suite.OP2_SQL.replace("FROM conversations", f"FROM '{folder}/conversations.parquet'")).fetchall()
    assert sorted(map(tuple, suite.op2_chat_formatting(spark, folder).collect())) == sorted(want)
