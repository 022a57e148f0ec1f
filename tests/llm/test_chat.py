import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.llm import chat
from lumenframe.llm.queries import ORACLES, op4_chat_parts
from tests.llm.helpers import DATA
from tests.twins import database, same

PIECES = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|image|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|", "a", "\n", "é", "<|endoftext|>", "<\\|im_end|>"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), min_size=1, max_size=4), min_size=1, max_size=30))
def test_round_trip(spark, chats):
    rows = [(c, t, ("user", "assistant")[t % 2], x) for c, turns in enumerate(chats) for t, x in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("content")))
    for r in done.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss")).alias("m")).collect():
        turns = chats[r.conv_id]
        assert [x.text for x in r.t] == turns and r.m == "".join(turns[1::2])


def test_control_strings_are_broken(spark):
    df = spark.createDataFrame([("".join(PIECES),)], "t string")
    out = df.select(chat.escape(F.col("t")).alias("e")).first().e
    assert not any(p in out for p in PIECES if p[0] in "<[" and len(p) > 2 and "\\" not in p)


def test_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "img/1", 256), ("audio", "x", "a.ogg", None), ("document", None, "d.pdf", 9), (None, "y", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r.formatted == "<|im_start|>user<|im_sep|>see <\\|image|><|image|><|audio|><|document|>y<|im_end|>"
    assert [tuple(a) for a in r.attachments] == [("image", "img/1", 256), ("audio", "a.ogg", 0), ("document", "d.pdf", 9)] and r.attachment_tokens == 265


def test_query(spark):
    assert same(op4_chat_parts(spark, DATA), ORACLES["op4_chat_parts"], database()) > 1
    probe = op4_chat_parts(spark, DATA).filter("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert probe.loss_chars == len(text) and probe.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
