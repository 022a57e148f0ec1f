"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is an array of parts (type, text, ref, tokens). A visitor flattens the parts in order: text is
escaped and kept; an image, an audio clip or a document becomes one placeholder, and its reference and the number of
tokens that it expands to go to the row's `attachments`.

The template of a turn is <|im_start|>role<|im_sep|>content<|im_end|>. Inside roles and texts every backslash is doubled
and every control string gets a backslash after its first character, which `unescape` undoes exactly; so the marks that
are left belong to the template. Placeholders are control strings too: text cannot forge one. Control strings of other
templates that no mark of this one resembles (with digits or capitals between <| and |>, or in plain < >) stay as they are:
a reader of this template takes them for text, one of theirs must escape them by its own rules.

Null roles, texts and contents count as empty; part types other than the four are an error of the caller and are read as
text. Turns are ordered by (turn, role, text), null turns first; repeated rows are turns of their own. A null conv_id is a
conversation of its own. Empty tables give empty results. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks, the placeholders, and control strings of common templates, as one pattern.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = r"(<)(\|[a-z_]+\|>|/?s>|/?SYS>>|<SYS>>|</SYS>>)|(\[)(/?INST\])"
PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, "$1$3\\\\$2$4")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """A content that is one text."""
    null = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("ref"), F.lit(None).cast("int").alias("tokens")))


def visit(part: Column) -> Column:
    out = escape(part["text"])
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def flatten(content: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(content, F.array().cast(f"array<{PART}>")), visit), "")


def attachments(content: Column) -> Column:
    """(type, ref, tokens) of the parts that became placeholders, in order."""
    some = F.filter(F.coalesce(content, F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(p["type"].isin(*PLACEHOLDERS), F.lit(False)))
    return F.transform(some, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens")))


def format_chats(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, content) -> conv_id, formatted, loss (spans of assistant content in formatted, in
    code points), attachments, attachment_tokens. One shuffle: the window and the grouping share their key."""
    turns = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flatten(F.col("content")).alias("body"), attachments(F.col("content")).alias("att"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    turns = turns.withColumn("head", head).withColumn("len", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn("at", F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    row = F.struct("n", "role", F.concat("head", "body", F.lit(END)).alias("s"), (F.col("at") + F.length("head")).alias("from"), F.length("body").alias("len"), "att")
    g = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    spans = F.transform(F.filter("t", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["from"].cast("int").alias("from"), t["len"].alias("len")))
    g = g.select("conv_id", F.array_join(F.transform("t", lambda t: t["s"]), "").alias("formatted"), spans.alias("loss"), F.flatten(F.transform("t", lambda t: t["att"])).alias("attachments"))
    return g.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    body = lambda p: F.substring_index(F.substring_index(p, SEP, -1), END, 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(body(p)).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["from"] + 1, s["len"]))), "")
