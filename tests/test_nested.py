from __future__ import annotations

import json
import sys

from evidra.functions.jsontext import INVALID, _iterative, parse, unwrap
from evidra.operators import nested
from evidra.operators.nested import KEYS, flatten, raw_rows, subtype_tables, version_rows, write_variants
from evidra.plans import problems
from tests.oracle import DATA

VERSION = {"post": {"id": "t3_p"}, "comments": [{"id": "c1", "parentId": "t3_p"}, 7, {"parentId": "c1"}, {"id": None, "parentId": 4}], "unresolvedMore": [{"id": "m", "parentId": "c1", "childIds": ["x", None, 3]}, {"childIds": None}]}


def t1(own, replies="", **more):
    return {"kind": "t1", "data": {"id": own, "name": f"t1_{own}", "replies": replies, **more}}


def below(*children):
    return {"kind": "Listing", "data": {"children": list(children)}}


def raw(*children, post={"kind": "t3", "data": {"id": "p", "name": "t3_p"}}):
    return {"path": "x", "content": [{"data": {"children": [post]}}, {"data": {"children": list(children)}}]}


def keys(rows):
    return [r[:4] for r in rows]


def test_version_nodes():
    expected = [("comment", "c1", "t3_p", 0), ("comment", "", "c1", 2), ("comment", "", "", 3), ("more", "m", "c1", 0), ("more_child", "x", "m", 0), ("more_child", "", "m", 1), ("more_child", "", "m", 2), ("more", "", "", 1)]
    for text in (json.dumps(VERSION), json.dumps(json.dumps(VERSION))):
        assert keys(version_rows(text)) == expected
    for text in (None, "", "{", "[]", "3", '"x"', "[NaN]", '{"comments": {"id": 1}}'):
        assert keys(version_rows(text)) == []


def test_raw_nodes():
    doc = raw(
        t1("a", below(t1("b", None), {"kind": "ad", "data": {"id": "z", "replies": below(t1("lost"))}}, {"kind": "more", "data": {"id": "m", "children": ["q", "r"]}})),
        {"kind": "t1", "data": {"id": 5, "replies": below(t1("lost2"))}}, {"kind": "t1", "data": {"id": "", "name": "t1_e"}}, "odd", None, {"kind": "more", "data": {}}, {"kind": "more", "data": {"count": 2, "children": None}},
        {"kind": "t1", "data": {"id": "n", "parent_id": "t1_lies"}},
    )
    expected = [("comment", "t1_a", "t3_p", 0), ("comment", "t1_b", "t1_a", 0), ("more", "m", "t1_a", 2), ("more_child", "q", "m", 0), ("more_child", "r", "m", 1), ("more", "", "t3_p", 6), ("comment", "t1_n", "t3_p", 7)]
    wrapped = {**doc, "content": json.dumps(doc["content"])}
    for d in (doc, json.dumps(doc), wrapped):
        assert keys(raw_rows(json.dumps(d))) == expected
    assert keys(raw_rows(json.dumps(raw(t1("a"), post={"kind": "t3", "data": {"id": "p", "name": None}})))) == [("comment", "t1_a", "t3_p", 0)]
    for text in (None, "", "x", "{}", json.dumps({"content": [{}]}), json.dumps(doc)[:-20]):
        assert keys(raw_rows(text)) == []


def test_any_depth():
    depth = 30_000
    text = '{"content":[{"data":{"children":[{"kind":"t3","data":{"id":"p"}}]}},{"data":{"children":[' + "".join(f'{{"kind":"t1","data":{{"id":"c{i}","replies":{{"data":{{"children":[' for i in range(depth)) + "]}}}}" * depth + "]}}]}"
    rows = list(raw_rows(text))
    assert len(rows) == depth and rows[-1][:4] == ("comment", f"t1_c{depth - 1}", f"t1_c{depth - 2}", 0)


def test_spark_tables(spark):
    rows = [(1, json.dumps(VERSION), "clash"), (1, json.dumps(VERSION), "clash"), (2, None, "x"), (3, "bad", "x")]
    df = spark.createDataFrame(rows, "row_id long, normalized_content string, node_kind string")
    nodes = flatten(df, "version", "row_id", "normalized_content")
    assert nodes.count() == 8
    tables = subtype_tables(nodes)
    assert {k: t.count() for k, t in tables.items()} == {"node": 8, "comment": 3, "more": 2, "more_child": 3}
    assert all(t.columns[: len(KEYS)] == KEYS for t in tables.values())
    assert {r["variant"] for r in tables["more"].collect()} == {"id:text/count:absent/childIds:array", "id:absent/count:absent/childIds:null"}
    assert flatten(df.where("false"), "version", "row_id", "normalized_content", False).count() == 0


def test_variants(spark, tmp_path):
    doc = raw(t1("a", below(t1("b", None, body="x"), {"kind": "more", "data": {"id": "m", "children": []}})), t1("c", below({"kind": "ad", "data": {}})))
    rows = {r[1]: r for r in raw_rows(json.dumps(doc))}
    assert rows["t1_a"][4] == "author:absent/body:absent/score:absent/replies:object/below:comment+more"
    assert rows["t1_b"][4] == "author:absent/body:text/score:absent/replies:null/below:none" and rows["t1_b"][5:8] == (1, None, "x")
    assert rows["t1_c"][4].endswith("below:other") and rows["m"][4] == "id:text/count:absent/children:none"
    assert [r[:4] for r in raw_rows(json.dumps(doc))] == list(raw_rows(json.dumps(doc), False))
    nodes = flatten(spark.createDataFrame([(7, json.dumps(doc))], "k long, d string"), "observation", "k", "d")
    write_variants(nodes, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v" / "comment")).count() == 3 and len([p for p in (tmp_path / "v" / "comment").iterdir() if p.is_dir()]) == 3


def test_json_text():
    for good in ('{"a": [1, -2.5e3, true, null, "x\\n"], "b": {}}', "[]", "3", '" "'):
        assert parse(good) == json.loads(good) == _iterative(good, False)
    for bad in ("", "[1,]", '{"a"}', "[1 2]", "01", "[NaN]", "nul", '"\n"', "[1]x"):
        assert parse(bad) is INVALID
    assert unwrap('"[1]"') == [1] and unwrap("3") == "3" and unwrap("plain") == "plain"
    assert parse("[1.0, 1e2, 100, 0.10, -0.0]", True) == [1, 100, 100, {"number": "1e-1"}, 0]


def test_keys_come_from_classified_nodes(monkeypatch):
    seen = []
    monkeypatch.setattr(nested.AUTOMATON, "shape", lambda value, fields: seen.append(value) or "x")
    doc = raw(t1("a", below(t1("b"))), {"kind": "more", "data": {"id": "m", "children": ["q"]}})
    assert len(list(version_rows(json.dumps(VERSION), False))) == 8 and len(seen) == 5
    assert len(list(raw_rows(json.dumps(doc), False))) == 4 and len(seen) == 8


def test_a_difference_at_any_depth_gives_another_state():
    def states(leaf):
        chain = t1("a", below(t1("b", below(t1("c", below(leaf))))))
        return [r[-1] for r in raw_rows(json.dumps(raw(chain)))]

    one, same, other = states(t1("d", body="x")), states(t1("e", body="y")), states(t1("d", body=None))
    assert one == same and all(x != y for x, y in zip(one, other))
    links = lambda body: [{"id": "t1_a", "parentId": "t3_p"}, {"id": "t1_b", "parentId": "T1_a"}, {"id": "t1_c", "parentId": "t1_b", "body": body}]
    of = lambda doc: [r[-1] for r in version_rows(json.dumps(doc))]
    one, other = of({"comments": links("x")}), of({"comments": links(None)})
    assert all(x != y for x, y in zip(one, other)) and len(set(one)) == 3
    assert of({"comments": links("x"), "unresolvedMore": [{"id": "m", "parentId": "t1_c", "childIds": ["q"]}]})[0] != one[0]
    ring = of({"comments": [{"id": "t1_a", "parentId": "t1_b"}, {"id": "t1_b", "parentId": "t1_a"}, {"parentId": ""}, {"id": "", "parentId": "t1_b"}]})
    assert len(ring) == 4 and all(ring)


def test_typed_tables_are_queries(spark):
    tables = {kind: problems.QUERIES[name](spark, DATA) for kind, name in (("comment", "p4_comments"), ("more", "p4_placeholders"), ("more_child", "p4_child_ids"))}
    rows = [tuple(r[c] for c in KEYS) for t in tables.values() for r in t.collect()]
    assert sorted(rows) == sorted(map(tuple, problems.p4_found(spark, DATA).collect())) and len(rows) == len(set(rows))
    for kind, t in tables.items():
        assert t.columns == [*KEYS, *nested.SUBTYPES[kind]] and {r["owner"] for r in t.select("owner").distinct().collect()} == {"version", "observation"}
        assert t.where(f"state IS NULL OR state NOT LIKE '{kind}:%'").isEmpty()


def _state(**fields):
    """The state of a top-level comment with one reply that has one node below it."""
    inner = fields.pop("inner", {"kind": "t1", "data": {"id": "c", "body": "x", "replies": ""}})
    listing = lambda *x: {"data": {"children": list(x)}}
    reply = {"kind": "t1", "data": {"id": "b", "body": "x", "replies": listing(inner)}}
    top = {"kind": "t1", "data": {"id": "a", "body": "x", "replies": listing(reply), **fields}}
    doc = {"content": [listing({"kind": "t3", "data": {"id": "p"}}), listing(top)]}
    return next(r[-1] for r in raw_rows(json.dumps(doc)) if r[1] == "t1_a")


def test_states_tell_grandchildren_and_all_fields_apart():
    assert _state() == _state() == _state(body="other words")
    assert _state() != _state(inner={"kind": "more", "data": {"id": "m", "children": []}})
    assert _state(author={"x": {"y": 1}}) != _state(author={"z": [1]}) != _state(author="text")
    assert _state(fifth=1) != _state(fifth="1") != _state()


def test_depth_alone_makes_no_new_states():
    node = {"kind": "t1", "data": {"id": "n0", "body": "x", "replies": ""}}
    for i in range(1, 500):
        node = {"kind": "t1", "data": {"id": f"n{i}", "body": "x", "replies": {"data": {"children": [node]}}}}
    sys.setrecursionlimit(20_000)
    doc = json.dumps({"content": [{"data": {"children": []}}, {"data": {"children": [node]}}]})
    assert len({r[-1] for r in raw_rows(doc)}) <= 3
