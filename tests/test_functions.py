"""Golden rows of the column functions."""

import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gradelake.functions import numbers, replies, text
from gradelake.operators import match


def apply(spark, values, fn, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_mc_letter(spark):
    got = apply(spark, ["b", " B or b", "BAD", "circle around B", "", None, "X"], replies.mc_letter)
    assert got == ["B", "B", "?", "?", "?", "?", "?"]


def test_bracket_marks(spark):
    got = apply(spark, ["a [2] b [3]", "[41]", "[Total: 9] [1]", "[0]", "[40][40][40]", "[99999999999999999999] [2]"], text.bracket_marks)
    assert got == [5, None, 1, None, 99, 2]


def test_inferred_marks(spark):
    got = apply(spark, ["x [3 marks]", "x (4)", "x (21)", "x", "y (3)\nz", "[50 marks]"], text.inferred_marks)
    assert got == [3, 4, 1, 1, 3, 1]


def test_mark_cues_are_removed(spark):
    got = apply(spark, ["a [2]\n\n\n\nb [41] [Total: 5]", "  ", "x [3 marks] "], text.without_mark_cues)
    assert got == ["a\n\nb [41]", "  ", "x"]


def test_science_text(spark):
    got = apply(spark, ["1.5 × 1011 m", "2.3 x 10–18", "a  b  c", "5 x10N. ok", "x 10^4", "x 10km"], text.science_text)
    assert got == ["1.5 x 10^11 m", "2.3 x 10^-18", "a • b → c", "5 x 10^N. ok", "x 10^4", "x 10km"]


def test_question_type(spark):
    got = apply(spark, ["A\nfoo\nB\nbar\nC\nbaz", "Calculate the speed", "q" * 401, "hi", "C\nx\nB\ny\nA\nz"], text.question_type)
    assert got == ["multiple_choice", "calculation", "long_answer", "short_answer", "short_answer"]


def test_question_number(spark):
    rows = spark.createDataFrame([(0, "9", 5.0), (1, "9 (a) x", 5.0), (2, "9 Star", 5.0), (3, "9 Star", 15.0), (4, "Star", 5.0), (5, "00", 5.0), (6, "123", 1.0)], "i int, v string, y double")
    got = [r[0] for r in rows.orderBy("i").select(text.question_number(F.col("v"), F.col("y"), F.lit(10.0))).collect()]
    assert got == [9, 9, 9, None, None, None, None]


def test_bullet_lines(spark):
    got = apply(spark, ["•\nitem\n•\n• b", "-\n\n x \n*\n-\nsecond"], text.bullet_lines)
    assert got == ["• item\n• • b", "• x\n*\n• second"]


def test_options(spark):
    df = spark.createDataFrame([(0, "Pick\nA\none\n b \ntwo\nC\n\nIGCSE Physics: s24\ntail"), (1, "A\nB\nC"), (2, "no options")], "i int, t string")
    got = text.with_options(df, "t", "stem", "opts").orderBy("i").select("stem", text.options_display(F.col("opts"))).collect()
    assert [tuple(r) for r in got] == [("Pick", "A: one  B: two"), ("A\nB\nC", ""), ("no options", "")]


def test_number_texts(spark):
    good = ["1", "1e5", "nan", "inf", "1_0", " 2 ", "-.5", "+3.", "Infinity"]
    bad = ["1d", "A", "", "1__0", "_1", "1f", "0x1", "1e"]
    assert apply(spark, good + bad, numbers.is_number) == [True] * len(good) + [False] * len(bad)
    for value in good:
        float(value)
    for value in bad:
        with pytest.raises(ValueError):
            float(value)
    assert apply(spark, ["1_0", " 2 ", "-.5", "x"], numbers.to_number) == [10.0, 2.0, -0.5, None]


def test_percent_texts(spark):
    assert apply(spark, [66.4, 2.5, 3.5, 87.5], numbers.pct_text, "double") == ["66%", "2%", "4%", "88%"]
    assert apply(spark, [80.0, 79.9, 50.0, 49.0], numbers.pct_band, "double") == ["green", "yellow", "yellow", "red"]


def test_json_salvage(spark):
    raw = ['{"a":1}', 'x {"a":1} y', '{"a":"b', "[1]", '{"a":1} {"b":2}', "", None, '{"a":1,"a":2}', '{"k": [1, "x"]}', '{"a": 01}', '{"a":{"b":[1]}}']
    got = apply(spark, raw, replies.salvaged_object)
    want = [{"a": 1}, {"a": 1}, {"a": "b"}, {}, {}, {}, {}, {"a": 2}, {"k": [1, "x"]}, {}, {"a": {"b": [1]}}]
    assert [json.loads(g) for g in got] == want
    assert apply(spark, ["[1]", "zz", '{"a": 1'], replies.salvaged_json) == ["[1]", None, '{"a": 1}']


def test_ratio_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r[0] for r in df.select(match.seq_ratio("a", "b")).collect()] == [0.25, 0.5]
    assert difflib.SequenceMatcher(None, "tide", "diet").ratio() == 0.25


def test_no_break_spaces(spark):
    assert apply(spark, ["a [ 2 ]"], text.bracket_marks) == [2]
    assert apply(spark, ["1.5 x 1011"], text.science_text) == ["1.5 x 10^11"]
    assert apply(spark, ["x [Total: 5] [ 1 ]"], text.without_mark_cues) == ["x"]


def test_answers_are_whole(spark):
    line = "word " * 2000
    df = spark.createDataFrame([(line,)], "v string")
    assert df.select(text.answer_fields(F.col("v"))[0]).first()[0] == line.strip()


def test_replies_equal_the_plain_reader(spark):
    """The readings against Python's own parser, on well-formed, damaged and random texts."""
    rng = random.Random(5)

    def plain(raw):
        text = raw.strip()
        found = re.search(r"(?s)\{.*\}", text)
        fixed = text + '"}' if text.count('"') % 2 else text
        fixed = fixed if fixed.endswith("}") else fixed + "}"
        for reading in (text, found and found[0], fixed):
            try:
                if reading:
                    return json.loads(reading)
            except ValueError:
                continue
        return None

    def value(depth):
        kind = rng.randrange(7 if depth < 4 else 5)
        if kind < 5:
            return [rng.randrange(-99, 99), rng.random(), rng.choice([True, False, None]), "".join(rng.choices('ab"\\/{}[]~,:\n é😀', k=rng.randrange(6))), 1e30][kind]
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 5 else {rng.choice("abcd"): value(depth + 1) for _ in range(rng.randrange(4))}

    texts = [json.dumps({"k": value(0), "m": value(1)}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(150)]
    texts += [t[: rng.randrange(len(t))] for t in texts] + ["Here: " + t + rng.choice([" done", "", "```"]) for t in texts[:60]]
    texts += ["".join(t[:i] + rng.choice('{}[],:"0 ~') + t[i + 1:]) for t in texts[:150] for i in [rng.randrange(len(t))]]
    texts += ['{"a": 1,}', "[1 2]", "1{}", '{"a":[]}x{"b":{}}', "~", '{"a":~}', "nul", "null", "-", "NaN", "[[[[[[[[1]]]]]]]]", '{"a":"\t"}', '{"a":"\\x"}', '{"a":"\\u12"}', "{}", "{ }", "", " "]
    wide = json.dumps({f"k{i}": i for i in range(15)})
    texts += [wide, wide[:-1] + ', "k3": 99}', wide + " and"]
    got = apply(spark, texts, replies.salvaged_json)
    for raw, found in zip(texts, got, strict=True):
        want = plain(raw)
        assert (json.loads(found) if found is not None else None) == want or (want != want), raw


def test_replies_run_on_built_in_functions(spark):
    plan = spark.createDataFrame([("{",)], "v string").select(replies.salvaged_object(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
