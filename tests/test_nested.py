import json

from cliplake.functions.jsonish import read_json
from cliplake.operators.nested import ANALYSIS_NESTS, flatten, p3_found, typed, visit, write_tables

FULL = ANALYSIS_NESTS["full_json"]
HOOKS = ANALYSIS_NESTS["hooks_json"]


def keys(text, nests=FULL):
    return [(t, k, p) for t, k, p, _ in visit(text, nests)]


def test_paths():
    doc = {"timeline": [{"shots": [{"objects": [{"name": "a"}, None, {"name": "b"}]}, None]}, None, {"shots": {"objects": {"name": "c"}}}]}
    want = [("timeline", "0", ""), ("shots", "0.0", "0"), ("objects", "0.0.0", "0.0"), ("objects", "0.0.2", "0.0"), ("timeline", "2", ""), ("shots", "2.0", "2"), ("objects", "2.0.0", "2.0")]
    assert keys(json.dumps(doc)) == want
    assert keys("Here you are:\n```json\n" + json.dumps(doc, indent=1) + "\n```") == want
    assert keys(json.dumps({"result": doc})) == want
    assert keys(json.dumps({"result": json.dumps(doc)})) == want
    assert keys(json.dumps(json.dumps(doc))) == want
    upper = json.dumps(doc).replace('"timeline"', '"TimeLine"').replace('"shots"', '"SHOTS"')
    assert keys(upper) == want
    inner = {"timeline": json.dumps(doc["timeline"])}
    assert keys(json.dumps(inner)) == want


def test_hooks_are_the_list_itself():
    assert keys('[{"evidence": [{}]}, null]', HOOKS) == [("hooks", "0", ""), ("evidence", "0.0", "0")]
    assert keys('{"opening_type": "x", "evidence": {"q": 1}}', HOOKS) == [("hooks", "0", ""), ("evidence", "0.0", "0")]
    assert keys('{"hooks": [{"opening_type": "x"}]}', HOOKS) == [("hooks", "0", "")]
    assert keys('{"evidence": [{}]}', HOOKS) == [("hooks", "0", ""), ("evidence", "0.0", "0")]


def test_nothing_to_read():
    for text in (None, "", "  ", "no json", "null", "5", '"text"', "[]", '{"a": 1', '{"timeline": [{"a": 1}, {"b"'):
        assert keys(text) == []
    assert keys('[{"opening_type": "x"}, {"opening', HOOKS) == []


def test_read_json_in_prose():
    assert read_json('As said [see above], {"a": [1]} and more') == {"a": [1]}
    assert read_json('{"a": 1} {"b": {"c": 2}}') == {"b": {"c": 2}}
    deep = "[" * 100_000
    assert read_json(deep) is None


def test_flatten_takes_the_latest(spark, tmp_path):
    rows = [("v", '{"timeline": [{"event": "old"}, {}]}', None, None, "2024-01-01"), ("v", '{"timeline": [{"event": "new", "n": 3}]}', '[{"evidence": null}]', '{"overlays": [{"fonts": [{"font": "f"}]}]}', "2024-01-02")]
    rows += rows[1:] + [("w", None, "", "x", None), (None, '{"timeline": {}}', None, None, "2024-01-01")]
    df = spark.createDataFrame(rows, "video_id string, full_json string, hooks_json string, style_json string, created_at string").selectExpr("*", "1 AS payload", "'z' AS row_key")
    out = flatten(df, "video_id", ANALYSIS_NESTS, "created_at")
    got = sorted((r.video_id or "", r.child_table, r.row_key, r.parent_key) for r in out.collect())
    assert got == [("", "timeline", "0", ""), ("v", "fonts", "0.0", "0"), ("v", "hooks", "0", ""), ("v", "overlays", "0", ""), ("v", "timeline", "0", "")]
    write_tables(out, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    r = typed(back, "timeline", "event string, n int").where("video_id = 'v'").first()
    assert (r.event, r.n, r.parent_key) == ("new", 3, "")


def test_empty_table(spark):
    df = spark.createDataFrame([], "video_id string, full_json string, hooks_json string, style_json string, created_at timestamp")
    assert flatten(df, "video_id", ANALYSIS_NESTS, "created_at").count() == 0


def test_every_row_has_its_parent(spark):
    rows = {(r.video_id, r.child_table, r.row_key): r.parent_key for r in p3_found(spark, "/root/testdata/sf0.001").collect()}
    above = {"shots": "timeline", "objects": "shots", "evidence": "hooks", "fonts": "overlays"}
    for (v, t, _), parent in rows.items():
        assert (t in above) == bool(parent)
        assert not parent or (v, above[t], parent) in rows
