"""Answers of chat models, whole, fenced, doubled, cut off."""

import json

from pyspark.sql import functions as F

from clauselake.functions import answers as A
from clauselake.functions import display


def each(spark, column, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_object_text(spark):
    one = '{"a": {"b": "} ] \\" {"}, "c": [1, {"d": []}]}'
    got = each(spark, A.object_text, one, f"```json\n{one}\n```", f"Sure: {one} Done.", f"{one} {one}", one[:-2], f"[{one}]", "no object", "", None, "} {", '{"a": "' + "x\\n" * 20_000 + '"}', "{]}", '{"a": "b}')
    assert got[:3] == [one] * 3 and got[3:10] == [None] * 7 and got[10] is not None and got[11:] == [None, None]


def test_reasoning(spark):
    assert each(spark, display.without_reasoning, "<think>a</think> b ", "a <THINK>x", "plain", "<think>a</think><think>b") == ["b", "", "plain", ""]


POINT = {"category": "arbitration", "severity": "high", "title": "t", "detail": "d", "quote": "binding arbitration"}


def test_summary_points(spark):
    answer = lambda *points, **more: json.dumps({"points": list(points), **more})
    good = [answer(POINT), f"<think>{answer()}</think>```\n{answer(POINT, POINT | {'severity': 'low'})}```"]
    bad = [answer(), answer(*[POINT] * 7), answer(POINT, extra=1), answer(POINT | {"more": 1}), answer({k: v for k, v in POINT.items() if k != "quote"}), answer(POINT | {"category": "other"}), answer(POINT | {"severity": "huge"}), answer(POINT | {"title": ""}), answer(POINT | {"title": "x" * 121}), '{"points": 3}', "{}", f"<think>{answer(POINT)}", None, answer(POINT)[:-1]]
    got = each(spark, A.summary_points, *good, *bad)
    assert [len(x) for x in got[:2]] == [1, 2] and got[0][0].asDict() == POINT and got[2:] == [None] * len(bad)


def test_finalised(spark):
    answer = json.dumps({"points": [POINT, POINT | {"quote": "never said here", "severity": "medium"}, POINT | {"quote": "court"}, POINT | {"severity": "low", "quote": "“Binding   ARBITRATION” applies"}]})
    df = spark.createDataFrame([(answer, ['All "binding arbitration" applies.', "No court."]), (answer, []), (None, ["x"])], "t string, p array<string>")
    rows = [r.x for r in df.select(A.finalised(A.summary_points(F.col("t")), F.col("p")).alias("x")).collect()]
    assert [(r.risk_score, len(r.points), r.dropped) for r in rows[:2]] == [(29, 2, 2), (0, 0, 4)] and rows[2] is None


def test_form_assessment(spark):
    good = {"verdict": "danger", "confidence": 0.9, "reasons": ["a"], "advice": "leave", "checklist": []}
    bad = [good | {"verdict": "bad"}, good | {"confidence": 1.1}, good | {"reasons": []}, good | {"reasons": ["a"] * 6}, good | {"advice": ""}, good | {"checklist": ["x" * 201]}, good | {"more": 1}]
    got = each(spark, A.form_assessment, *[json.dumps(x) for x in (good, *bad)])
    assert got[0].verdict == "danger" and got[1:] == [None] * len(bad)
