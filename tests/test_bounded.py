"""JSON within bounds, and the sections of stories."""

import pytest
from pyspark.sql import functions as F
from sediment.functions import bounded
from sediment.operators import documents
from sediment.plans.engine import Engine

CASES = [
    ("{}", None),
    (' {"a": [1, {"b": "x ] } \\" {"}]}\n', None),
    ("[]", None),
    ('[{"a": 1}, {"a": 2}]', None),  # the same key in two objects
    ('{"a": 1, "a": 2}', "JSON_DUPLICATE_KEY"),
    ('[{"a": 1, "a": 2}]', "JSON_DUPLICATE_KEY"),
    ('{"x": [{"a": {"b": 1, "\\u0062": 2}}]}', "JSON_DUPLICATE_KEY"),
    (None, "INVALID_JSON"),
    ("", "INVALID_JSON"),
    ('"x"', "INVALID_JSON"),
    ('{"a": 1} x', "INVALID_JSON"),
    ('{"a": 1}{"a": 1}', "INVALID_JSON"),
    ('{"a": 1}}', "INVALID_JSON"),
    ('{"a": NaN}', "INVALID_JSON"),
    ('{"a": -Infinity}', "INVALID_JSON"),
    ("{'a': 1}", "INVALID_JSON"),
    ('{"a": "open', "INVALID_JSON"),
    ("[" * 64 + "]" * 64, None),
    ("[" * 65 + "]" * 65, "JSON_DEPTH"),
    ("[" * 65, "JSON_DEPTH"),
    ("[" + "1," * 9998 + "1]", None),
    ("[" + "1," * 9999 + "1]", "JSON_NODES"),
    ('{"a": "' + "[{" * 30000 + '"}', None),  # brackets of a string
    ('{"a": "' + "\\\\" * 50000 + '"}', None),
]


def test_json_problems(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["p"] for r in rows.select("i", bounded.json_problem(F.col("t")).alias("p")).collect()}
    assert [(t or "")[:60] + " " + str(got[i]) for i, (t, _) in enumerate(CASES)] == [(t or "")[:60] + " " + str(p) for t, p in CASES]


@pytest.mark.parametrize("text, right", [('{"o": {}, "l": [{}], "t": ["a"]}', True), ("{}", True), ('{"l": [], "t": []}', True), ('{"o": 1}', False), ('{"o": null}', False), ('{"l": {}}', False), ('{"l": [null]}', False), ('{"l": [{}, 1]}', False), ('{"t": [1]}', False), ('{"t": "a"}', False), ("[]", False), ("{", True)])
def test_shapes(spark, text, right):
    row = spark.createDataFrame([(text,)], "t string").select(bounded.shape_problem(F.col("t"), ("o",), ("l",), ("t",)).alias("p")).first()
    assert row["p"] == (None if right else "SCHEMA_INVALID")


def test_sections_of_stories(spark):
    text = "# US-1 - x\n\n## Business Rules on data\n\n- BR1: no data\n\n## Datos\n- a: int\n\n# Other\n- z: lost\n\n## Data again\n* `b` - text: of b\nplain\n\n## Excepciones\r\n- E1: bad\r\n- oh\r\n"
    (row,) = documents.requirements(Engine.of(spark, {f"{documents.HOME}/requirements/a.md": text}).files).collect()
    assert row["required_data"] == [{"field": "a", "type": "int"}, {"field": "b", "type": "text: of b"}, {"field": "plain", "type": "string"}]
    assert row["validations"] == [] and row["problem"] is None
    assert row["exceptions"] == [{"code": "E1", "description": "bad"}, {"code": "EXCEPTION", "description": "oh"}]
