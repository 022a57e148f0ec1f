from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import rules
from lumenframe.llm.queries import ORACLES, op8_rule_cascade
from tests.llm.helpers import DATA, TEXTS, odd_rows, words
from tests.twins import database, same


def brute(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def counts(text):
    c = rules.Counts(text)
    return c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words


def test_counts_of_odd_texts():
    for t in TEXTS:
        assert counts(t) == brute(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "\n", " ", "#", "é", "\t"]), max_size=60).map(" ".join))
def test_counts(text):
    assert counts(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_letters_of_any_script(text):
    assert rules.Counts(text).letters == (sum(c.isupper() and c.isalpha() for c in text), sum(c.isalpha() for c in text))


def test_a_foreign_acronym_is_no_text_in_capitals():
    for text in ("Сигнал GPS принимают все приборы на борту судна", "Το σύστημα GPS λειτουργεί σε όλο τον κόσμο", "نظام GPS يعمل في كل مكان من العالم", "מערכת GPS פועלת בכל מקום בעולם", "प्रणाली GPS पूरी दुनिया में काम करती है"):
        assert not rules.RULES["capitals"](rules.Counts(text))
    for text in ("BUY NOW and SAVE", "КУПИТЕ СЕЙЧАС, это ДЁШЕВО", "ÉÀÉ é"):
        assert rules.RULES["capitals"](rules.Counts(text))


def test_many_different_words_do_not_overflow():
    text = " ".join(f"w{i}" for i in range(9000))
    assert counts(text + " " + text)[4] == 18000 and counts(text)[4] == 0


def test_order_changes_no_verdict(spark):
    df = odd_rows(spark)
    kept = lambda order: sorted(str((r.doc_id, r.text)) for r in rules.cascade(df, order).collect() if r.rejected_by is None)
    assert kept(list(rules.RULES)) == kept(list(rules.RULES)[::-1])


def test_cascade_stops_at_the_first_rejection():
    asked = []
    own = {"a": lambda c: asked.append("a") or True, "b": lambda c: asked.append("b") or True}
    assert rules.first_reject(rules.Counts("x"), ["b", "a"], own) == "b" and asked == ["b"]


def test_plan_orders_by_gain(spark):
    df = spark.createDataFrame([(f"text number {i}",) for i in range(50)], "text string")
    slow = {"never": lambda c: sum(range(20000)) < 0, "always": lambda c: True}
    assert rules.plan(df, rules=slow) == ["always", "never"]


def test_query(spark):
    assert same(op8_rule_cascade(spark, DATA), ORACLES["op8_rule_cascade"], database()) > 100


def test_clean_documents_stay(spark):
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality == 1}
    lost = [r.doc_id for r in op8_rule_cascade(spark, DATA).collect() if r.doc_id in good and not r.kept and not r.base_failed]
    assert lost == []
