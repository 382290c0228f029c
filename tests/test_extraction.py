"""Write-back of extraction payloads."""

import json

import pytest

from corvane.operators.extraction import parse_payloads, write_back


def test_write_back(spark):
    one = {
        "sha": "x",
        "entities": [
            {"name": "Acme Corp", "type": "Organisation", "description": "short", "aliases": ["ACME", "ac"]}, {"name": " Bob ", "type": "robot"}, {"name": "!"}, {"name": None},
        ],
        "relations": [
            {"src": "acme corp", "dst": "bob", "type": "Employs"}, {"src": "acme", "dst": "bob", "type": "employs", "description": "longer"}, {"src": "bob", "dst": "bob"},
            {"src": "bob", "dst": "nobody"}, {"src": "bob", "dst": "Edge", "type": None},
        ],
    }
    two = {"sha": "gone", "entities": [{"name": "Zed"}], "relations": None}
    three = {"sha": "x", "entities": [{"name": "ACME corp", "description": "a longer one"}]}
    rows = [(1, json.dumps([one])), (2, json.dumps({"results": [two, three, {"sha": None}]})), (3, "no json"), (4, None), (5, "{}"), (6, "[]")]
    results = parse_payloads(spark.createDataFrame(rows, "seq int, payload string"))
    assert results.count() == 3
    with pytest.raises(Exception, match="no JSON in payload 3"):
        parse_payloads(spark.createDataFrame(rows, "seq int, payload string"), strict=True).collect()
    chunks = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id long, sha string")
    known = spark.createDataFrame([("the-edge", "edge"), ("edgy", "edge")], "norm string, alias string")
    out = {k: {tuple(r) for r in v.collect()} for k, v in write_back(results, chunks, known).items()}
    assert out["entities"] == {("acme-corp", "Acme Corp", "organisation", "a longer one"), ("bob", "Bob", "concept", "")}
    assert out["aliases"] == {("acme-corp", "acme-corp"), ("acme-corp", "acme"), ("bob", "bob")}
    assert out["mentions"] == {(1, "acme-corp"), (2, "acme-corp"), (1, "bob"), (2, "bob")}
    assert out["relations"] == {("acme-corp", "bob", "employs", "longer", 1.5), ("bob", "edgy", "related", "", 1.0)}
    assert out["done"] == {("x",)} and out["skipped"] == {("gone",)}
