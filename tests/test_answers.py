from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sigmill.operators import answers as an

SOURCE = "The shop-owner said: orders vanish every Monday, and nobody answers the phone."
QUOTE = "orders vanish every Monday"
GOOD = {"body": "Orders get lost", "audience": "shop owners", "quote": QUOTE}
LIE = {**GOOD, "quote": "orders vanish on Tuesday"}


def answer(*pains):
    return json.dumps({"pains": list(pains)})


def without(name):
    return {k: v for k, v in GOOD.items() if k != name}


# answer, parsed, then valid, hallucinated, schema_invalid, invalid_json, degraded_parse, extra_fields
CASES = {
    "valid": (answer(GOOD), True, 1, 0, 0, 0, 0, 0),
    "empty list": ('{"pains": []}', True, 0, 0, 0, 0, 0, 0),
    "hallucinated": (answer(LIE), True, 0, 1, 0, 0, 0, 0),
    "case differs": (answer({**GOOD, "quote": QUOTE.upper()}), True, 0, 1, 0, 0, 0, 0),
    "no quote": (answer(without("quote")), True, 0, 0, 1, 0, 0, 0),
    "no audience": (answer(without("audience")), True, 0, 0, 1, 0, 0, 0),
    "number": (answer({**GOOD, "body": 1}), True, 0, 0, 1, 0, 0, 0),
    "null": (answer({**GOOD, "body": None}), True, 0, 0, 1, 0, 0, 0),
    "blank": (answer({**GOOD, "body": "  "}), True, 0, 0, 1, 0, 0, 0),
    "array root": ("[1, 2]", False, 0, 0, 0, 1, 0, 0),
    "pains not a list": ('{"pains": "many"}', False, 0, 0, 0, 1, 0, 0),
    "no pains": ('{"other": true}', False, 0, 0, 0, 1, 0, 0),
    "not an object": ('{"pains": [42]}', True, 0, 0, 1, 0, 0, 0),
    "garbage": ("I did not understand.", False, 0, 0, 0, 1, 0, 0),
    "trailing text": (answer(GOOD) + " done", False, 0, 0, 0, 1, 0, 0),
    "extra field": (answer({**GOOD, "confidence": 0.9}), True, 1, 0, 0, 0, 0, 1),
    "extra on a bad shape": (answer({**without("quote"), "x": 1}), True, 0, 0, 1, 0, 0, 0),
    "extra on a lie": (answer({**LIE, "x": 1}), True, 0, 1, 0, 0, 0, 1),
    "fenced": (f"```json\n{answer(GOOD)}\n```", True, 1, 0, 0, 0, 1, 0),
    "fenced with prose": (f"```\nHere: {answer(GOOD)} ok\n```", True, 1, 0, 0, 0, 1, 0),
    "fence too short": (f"```{answer(GOOD)}```", False, 0, 0, 0, 1, 0, 0),
    "cap": (answer(GOOD, GOOD, GOOD, GOOD), True, 3, 0, 0, 0, 0, 0),
    "nothing counted past the cap": (answer(GOOD, LIE, GOOD, GOOD, LIE, 42), True, 3, 1, 0, 0, 0, 0),
    "duplicate key": ('{"pains": 1, "pains": []}', True, 0, 0, 0, 0, 0, 0),
}


def test_extract_counters(spark):
    frame = spark.createDataFrame([(k, v[0], SOURCE) for k, v in CASES.items()], "id string, answer string, text string")
    got = {r["id"]: tuple(r)[1:] for r in an.validate_extract(frame).select("id", "parsed", *an.EXTRACT_COUNTERS).collect()}
    assert got == {k: v[1:] for k, v in CASES.items()}


def test_extract_cap_stops_counting(spark, rows):
    frame = spark.createDataFrame([("p", answer(GOOD, LIE, GOOD, GOOD, LIE), SOURCE)], "id string, answer string, text string")
    judged = an.validate_extract(frame, max_pains=2)
    assert rows(judged, "valid", "hallucinated") == [(2, 1)]
    assert rows(an.accepted_pains(judged, "id"), "pos", "quote") == [(0, QUOTE), (2, QUOTE)]
    assert rows(an.rejected_pains(judged, "id")) == [("p", 1, "hallucinated")]


def test_extract_status(spark, rows):
    frame = spark.createDataFrame([(True, False), (False, False), (False, True)], "parsed boolean, failed boolean")
    assert rows(frame.select(an.extract_status(F.col("parsed"), F.col("failed")))) == [("extracted",), ("failed",), (None,)]


SCORES = {
    "ok": ({"score": 60, "rationale_md": "why", "quotes": ["late", "late"]}, None),
    "half": ({"score": 87.5, "rationale_md": "why", "quotes": ["late"]}, None),
    "empty quote is contained": ({"score": 0, "rationale_md": "why", "quotes": [""]}, None),
    "list": ([1], "not_an_object"),
    "true": ({"score": True, "rationale_md": "why", "quotes": ["late"]}, "score_not_a_number"),
    "text": ({"score": "60", "rationale_md": "why", "quotes": ["late"]}, "score_not_a_number"),
    "high": ({"score": 100.5, "rationale_md": "why", "quotes": ["late"]}, "score_out_of_range"),
    "low": ({"score": -1, "rationale_md": "why", "quotes": ["late"]}, "score_out_of_range"),
    "blank": ({"score": 1, "rationale_md": " ", "quotes": ["late"]}, "empty_rationale"),
    "no quotes": ({"score": 1, "rationale_md": "w", "quotes": []}, "no_quotes"),
    "quotes text": ({"score": 1, "rationale_md": "w", "quotes": "late"}, "no_quotes"),
    "number quote": ({"score": 1, "rationale_md": "w", "quotes": [1]}, "quote_not_a_string"),
    "lie": ({"score": 1, "rationale_md": "w", "quotes": ["late", "never said"]}, "quote_not_grounded"),
}


def test_score_answers(spark):
    cases = [(k, json.dumps(v[0])) for k, v in SCORES.items()] + [("fenced", "```\n{}\n```")]
    bodies = [(k, body) for k, _ in cases for body in ("parcels are late", "calls go unanswered")]
    judged = an.ground_scores(
        an.parse_score(spark.createDataFrame(cases, "cluster_id string, answer string")),
        spark.createDataFrame(bodies, "cluster_id string, body string"),
    )
    got = {r["cluster_id"]: r for r in judged.withColumn("stored", an.stored_score(F.col("score")).cast("string")).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {k: v[1] for k, v in SCORES.items()} | {"fenced": "invalid_json"}
    assert (got["ok"]["stored"], got["half"]["stored"], got["lie"]["stored"]) == ("6.00", "8.75", None)
    assert got["ok"]["quotes"] == ["late", "late"] and got["lie"]["quotes"] is None


@pytest.mark.parametrize(
    ("given", "phrases", "reason"),
    [
        (["a", " b ", "c", "a"], ["a", "b", "c"], None),
        (["same", "same ", " same"], ["same"], None),
        (["a", "b"], None, "wrong_count"),
        (list("abcdef"), None, "wrong_count"),
        (["a", "b", ""], None, "blank_or_not_a_string"),
        (["a", "b", 3], None, "blank_or_not_a_string"),
        (["a", "b", "x" * 121], None, "too_long"),
        ([" " + "x" * 120 + " ", "a", "b"], ["x" * 120, "a", "b"], None),
        ([], None, "no_phrases"),
        ("abc", None, "no_phrases"),
    ],
)
def test_phrases(spark, given, phrases, reason):
    frame = spark.createDataFrame([(json.dumps({"phrases": given}),)], "answer string")
    row = an.parse_phrases(frame).first()
    assert (row["phrases"], row["reason"]) == (phrases, reason)


def test_completion(spark, rows):
    cases = [
        ("full", '{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":3,"completion_tokens":4},"model":"m"}'),
        ("bare", "{}"), ("bool", '{"usage":{"prompt_tokens":true,"completion_tokens":1.5},"model":7}'), ("html", "<html>"),
        ("odd", '{"choices":[{"message":{"content":5}}]}'),
    ]
    parsed = an.parse_completion(spark.createDataFrame(cases, "id string, raw string"), "raw", F.lit("d"))
    assert rows(parsed, "id", "call_failed", "answer", "prompt_tokens", "completion_tokens", "model") == sorted(
        [("full", False, "hi", 3, 4, "m"), ("bare", False, "", 0, 0, "d"), ("bool", False, "", 0, 0, "7"),
         ("html", True, None, 0, 0, "d"), ("odd", False, "", 0, 0, "d")], key=repr,
    )


def test_frequency_and_cost(spark, rows):
    cases = ['{"results":[{"total":5},{"total":9}]}', '{"results":[]}', '{"results":[{"total":-1}]}', '{"results":[{"total":true}]}', "x"]
    parsed = an.parse_frequency(spark.createDataFrame([(c,) for c in cases], "raw string"), "raw")
    assert sorted(r["frequency"] for r in parsed.collect() if r["frequency"] is not None) == [5]
    cost = an.token_cost(F.lit(1000), F.lit(500), F.lit("0.5").cast("decimal(12,4)"))
    free = an.token_cost(F.lit(1000), F.lit(500), F.lit(None))
    row = spark.range(1).select(cost.cast("double").alias("c"), an.micro_units(cost).alias("m"), free.cast("double").alias("f")).first()
    assert (row["c"], row["m"], row["f"]) == (0.00075, 750, 0.0)
