"""JSON items with pointers against the documents themselves."""

import json

from pyspark.sql import functions as F

from tessera.operators import nested


def resolve(document, pointer):
    for part in pointer.split("/")[1:]:
        document = document[int(part)] if isinstance(document, list) else document[part]
    return document


DOCS = [
    {"A": {"B": [{"c": {"d": 1}}, {"c": [{"d": 2}, {"d": 3}]}]}}, {"A": [{"B": {"c": {"d": "x", "a": [1, None]}}}, {"B": []}, {}]}, {"A": {"B": {"c": 5}}}, {"A": None}, {}, [1, 2], {"A": [{"B": [{"c": [{"d": 4}, 7, None]}]}]},
]


def test_items_stand_where_their_pointers_say(spark):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(90, '{"A": {}, "A": {}}'), (91, "no json"), (92, None), (93, "")], "id int, t string")
    found = nested.nested_items(rows.select("id", nested.parsed(F.col("t")).alias("v")), "v", ["A", "B", "c"], ["id"]).select("id", "pointer_2", nested.canonical(F.col("value_2")).alias("value")).collect()
    assert {(r["id"], r["pointer_2"]) for r in found} == {(0, "/A/B/0/c"), (0, "/A/B/1/c/0"), (0, "/A/B/1/c/1"), (1, "/A/0/B/c"), (6, "/A/0/B/0/c/0")}
    for r in found:
        assert json.loads(r["value"]) == resolve(DOCS[r["id"]], r["pointer_2"])


def test_equal_content_has_one_canonical_text(spark):
    rows = spark.createDataFrame([(1, '{"b": 1, "a": [1, 2]}'), (2, '{ "a":[1,2],"b":1 }'), (3, '{"a": [2, 1], "b": 1}'), (4, None)], "id int, t string").select("id", nested.parsed(F.col("t")).alias("v"))
    found = {r["content"]: (r["members"], r["ids"]) for r in nested.equal_content(rows, {"v": F.col("v")}, F.sort_array(F.collect_list("id")).alias("ids")).collect()}
    assert found == {'v={"a":[1,2],"b":1}': (2, [1, 2]), 'v={"a":[2,1],"b":1}': (1, [3]), "v=null": (1, [4])}
