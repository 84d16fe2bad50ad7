"""JSON out of models' answers."""

import json

import pytest

from tidepool.operators.recovery import recovered

FINE = '{"a": 1, "b": "x } { y", "c": [1, {"d": null}]}'
CASES = {
    "clean": (FINE, [], None),
    "spaces": (f"\n  {FINE}\t", [], None),
    "thought": (f"<think>maybe {{no}}</think>{FINE}", ["reasoning block"], None),
    "two thoughts": (f"<THINK>a</THINK><scratchpad>b\nc</scratchpad>\n{FINE}", ["reasoning block"], None),
    "fence": (f"```json\n{FINE}\n```", ["code fence"], None),
    "bare fence": (f"sure\n```\n{FINE}```\nbye", ["code fence"], None),
    "both": (f"<reasoning>x</reasoning>\n```JSON {FINE} ```", ["reasoning block", "code fence"], None),
    "prose": (f"Well, {FINE} it is", ["surrounding prose"], None),
    "two": (f'{FINE} {{"a": 2}}', ["surrounding prose"], None),
    "array": ("[1, 2]", [], None),
    "number": (" 42 ", [], None),
    "number and more": ("42, 43", [], "no JSON object in the response: 42, 43"),
    "escape": ('{"a": "\\$5 \\% \\n"}', ["surrounding prose", "invalid escape"], None),
    "escaped quote": ('x {"a": "say \\"}\\" "} y', ["surrounding prose"], None),
    "truncated": ('{"a": 1, "b": {"c"', [], 'no JSON object in the response: {"a": 1, "b": {"c"'),
    "malformed": ("{a: 1}", ["surrounding prose"], "found an object but it is malformed"),
    "trace": ("<think>I wonder", [], "the model produced only a reasoning trace, with no answer"),
    "trace after": (f"{FINE} <think>I wonder", [], None),
    "closing first": ("} {", [], "no JSON object in the response: } {"),
    "empty": ("", [], "the model said nothing"),
    "blank": (" \n ", [], "the model said nothing"),
    "null": (None, [], "the model said nothing"),
    "words": ("none", [], "no JSON object in the response: none"),
    "long": ("x " * 20_000 + FINE + '"' * 9, ["surrounding prose"], None),
}


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "name string, `model's.answer` string")
    made = frame.withColumn("r", recovered("model's.answer")).selectExpr("name", "to_json(r.value) as value", "r.repaired", "r.error")
    return {r["name"]: r for r in made.collect()}


@pytest.mark.parametrize("name", CASES)
def test_recovery(found, name):
    text, repaired, error = CASES[name]
    row = found[name]
    assert (row["repaired"], row["error"]) == (repaired, error)
    assert (row["value"] is None) == (error is not None)
    if name in ("clean", "thought", "fence", "both", "prose", "two", "long", "trace after"):
        assert json.loads(row["value"]) == json.loads(FINE)
    if name == "escape":
        assert json.loads(row["value"]) == {"a": "$5 % \n"}
