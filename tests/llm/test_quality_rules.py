import pytest

from dittograph.llm import quality_rules as Q

from .conftest import prose

CASES = {
    1: ("*** the*** cat### of&&& river%%%", "symbols"),
    2: (f"{'a' * 30} | {'b' * 30} | {'c' * 30}", "separators"),
    3: ("NO!! WAY!! EVER!!", "exclamations"),
    4: ("ALL THIS IS WRITTEN IN CAPITALS", "shouting"),
    5: ("word word word word word other other other other end", "repeated_words"),
    13: ("so so it goes", None),
    6: ("one line\none line\none line\none line\nlast", "repeated_lines"),
    14: ("- first point\n  - second point\n• third point\n* fourth point", "bullets"),
    15: ("it goes on...\nand it ends\nor it goes on… \nand it ends there", "ellipses"),
    16: ("river stone light window paper " * 5, "repeated_ngrams"),
    17: ("- a point\nand a line\n- a point more\nand it goes on...", None),
    7: ("1234 --- 567", "no_letters"),
    8: (None, "no_letters"),
    9: ("", "no_letters"),
    10: ("That it.", None),
    11: ("NATO", None),
    12: ("日本語のテキスト", None),
}


def test_each_rule_and_any_order(make):
    docs = make([*((k, t) for k, (t, _) in CASES.items()), (None, "fine text"), (20, prose(1, 50_000)), (20, prose(1, 50_000))])
    for order in (None, list(Q.RULES), list(reversed(Q.RULES))):
        out = Q.judged(docs, order=order)
        assert set(out.columns) == {*docs.columns, "reason"}
        rows = out.select("doc_id", "keep", "reason").collect()
        assert {r.doc_id: r.reason for r in rows} == {k: why for k, (_, why) in CASES.items()} | {None: None, 20: None}
        assert all(r.keep == (r.reason is None) for r in rows) and len(rows) == docs.count()


def test_order_is_by_rejections_per_second_of_what_is_left():
    hits = {frozenset(): 60, frozenset(["slow", "quick"]): 20, frozenset(["slow"]): 15, frozenset(["small"]): 5}
    found = Q.ordered({"slow": 1.0, "quick": 0.1, "small": 0.3, "idle": 0.01}, hits)
    # over all texts slow has 0.35 a second and small 0.17; of what quick leaves slow has 0.15
    assert [m.name for m in found] == ["quick", "small", "slow", "idle"]
    assert [m.rejects for m in found] == [0.2, 0.05, 0.15, 0.0]
    assert Q.ordered({"b": 1.0, "a": 1.0}, {})[0].name == "a"


def test_sample_is_by_row_not_by_id(spark, make):
    docs = spark.range(0, 4000, 1, 8).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text")
    assert sum(m.rejects for m in Q.measured(docs, sample=200)) == 0
    assert docs.sample(200 / 4000, 7).count() < 400


def test_measured_names_all_rules_and_empty_tables(make, nothing):
    docs = make([(k, t) for k, (t, _) in CASES.items()])
    measured = Q.measured(docs)
    assert {m.name for m in measured} == set(Q.RULES) and all(m.seconds > 0 for m in measured)
    assert next(m for m in measured if m.name == "no_letters").rejects == pytest.approx(3 / len(CASES))
    assert Q.judged(nothing).collect() == [] and Q.kept(nothing).collect() == []


def test_kept_keeps_columns(odd):
    left = Q.kept(odd)
    assert left.columns == odd.columns
    assert not {1, 2, 3, 8} & {r.doc_id for r in left.collect()}
