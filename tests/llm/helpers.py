"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DATA = "/root/testdata/sf0.001"

TEXTS = [
    None, "", " ", "\n", "\n\n", "a", "A b\tc", "one two three four five", "ONE two three four five", "é" * 20 + "\nÉ" + "é" * 19,
    "the same long line\nand another one\nthe same long line", "The Same LONG line \nsomething else", "x" * 40000, " " * 3000, "word " * 30000,
    "line of some length\n" * 2000, "\\<s>[INST]<|im_start|>", "\U0001f600 日本語　text \x85 \xa0 \x1c odd spaces", "<|endoftext|> and <|endoftext|>", "tab\x0bvt\x0cff\rcr",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string, kept string, drop int, lines string, ids string, tokens int, class string, n int, `first` int, rejected_by string, score string, media string, target string"


def odd_rows(spark, texts=TEXTS):
    extra = ("s", "r", "k", 1, "l", "i", 2, "c", 3, 4, "x", "y", "m", "t")
    rows = [(i, t, None if i % 4 == 0 else "en", [None, "a", "b", "", "B"][i % 5], None, *extra) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "a null id", None, None, None, *extra), (None, None, None, None, None, *extra)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")
