"""Rows that fail to parse, and nested records, against plain Python."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagemill.operators import json_tables as jt
from pagemill.sources import page_export as pe

SCHEMA = "line_id long, line string"
GOOD = 'bk-00000001,3,body,true,"A, b",1.5,"He said ""so""\nand left"'
CASES = [
    (GOOD, None), (GOOD + "\r", None), (None, "columns"), ("", "columns"), ("bk-00000001,3,blank,false,,,", None),
    ("bk-00000001,3,body,false,,,", "value"), ("bk-00000001,0,body,false,t,1,x", "value"), ("bk-00000001,3,Body,false,t,1,x", "value"),
    ("bk-1,3,body,false,t,1,x", "value"), ("bk-00000001,3,body,yes,t,1,x", "value"), ("bk-00000001,3,body,false,t,-1,x", "value"),
    ("bk-00000001,3,body,false,t,1,x,y", "columns"), ("bk-00000001,3,body,false,t,1", "columns"), ('bk-00000001,3,body,false,a "b" c,1,x', "quoting"),
    ('bk-00000001,3,body,false,"t" (2),1,x', "quoting"), ('bk-00000001,3,body,false,t,1,"open', "quoting"), ('bk-00000001,3,body,false,"t,1,x', "quoting"),
    ("bk-00000001,3,cover,false,t,,x", None), ("bk-00000001,99999999999,body,false,t,1,x", None),
]


def test_reasons(spark):
    rows = [(i, line) for i, (line, _) in enumerate(CASES)]
    got = {r.line_id: r.reason for r in pe.load(spark.createDataFrame(rows * 2, SCHEMA)).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES)}
    assert pe.rejected(spark.createDataFrame(rows * 2, SCHEMA)).count() == sum(r is not None for _, r in CASES)


def test_typed_row_and_extras(spark):
    df = spark.createDataFrame([(1, GOOD, "kept")], "line_id long, line string, page string")
    row = pe.load(df).collect()[0]
    assert row.page == "kept" and row.rec.page == 3 and row.rec.title == "A, b" and row.rec.text == 'He said "so"\nand left' and row.rec.seconds == 1.5


def test_long_line_and_empty_table(spark):
    long = 'bk-00000001,3,body,true,t,1,"' + 'a""b\n' * 200_000 + '"'
    assert pe.load(spark.createDataFrame([(1, long)], SCHEMA)).collect()[0].reason is None
    assert pe.rejected(spark.createDataFrame([], SCHEMA)).count() == 0


def expected(text):
    """Children by plain reading, for valid JSON."""
    out = set()
    as_list = lambda x: [] if x is None else x if isinstance(x, list) else [x]
    top = json.loads(text)
    for i, e in enumerate(top.get("results") or [] if isinstance(top, dict) and isinstance(top.get("results"), list) else []):
        for kind, field in (("block", "blocks"), ("note", "notes"), ("illustration", "illustrations")):
            for j, b in enumerate(as_list(e.get(field) if isinstance(e, dict) else None)):
                if b is not None:
                    out.add((i, kind, j, -1))
                    if kind == "block" and isinstance(b, dict):
                        out |= {(i, "marker", j, m) for m, x in enumerate(as_list(b.get("note_markers"))) if x is not None}
    return out


LEAF = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text(max_size=6))
BLOCK = st.one_of(LEAF, st.dictionaries(st.sampled_from(["text", "level", "note_markers"]), st.one_of(LEAF, st.lists(LEAF, max_size=3)), max_size=3))
PAGE = st.one_of(st.none(), st.dictionaries(st.sampled_from(["blocks", "notes", "illustrations", "raw", "title"]), st.one_of(LEAF, BLOCK, st.lists(BLOCK, max_size=3)), max_size=4))


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PAGE, max_size=4), st.booleans())
def test_triples_against_json(results, spaced):
    text = json.dumps({"title": "t", "results": results}, indent=2 if spaced else None, ensure_ascii=spaced)
    kinds = {jt.TABLES[t][0]: k for k, t in (("block", "blocks"), ("note", "notes"), ("illustration", "illustrations"), ("marker", "block_markers"))}
    got = {(o[0], kinds[p], o[1], o[2] if len(o) > 2 else -1) for p, o, k, _ in jt.triples(text) if p in kinds and k != "null"}
    assert got == expected(text)


def test_invalid_json():
    for bad in ("", "{", '{"a":1,}', '{"a":NaN}', "[1 2]", '{"a":"\n"}', '{"a":1}}', "{'a':1}", '{"a":01}'):
        assert jt.triples(bad) is None, bad
    assert jt.triples('{"results":[{"blocks":[1],"blocks":[2,3]}]}')[-1] == ("results[].blocks[]", (0, 1), "number", "3")


def test_flat_tables(spark):
    text = json.dumps({"results": [{"page": 1, "blocks": {"type": "p", "text": "x", "note_markers": "1"}, "notes": ["plain", None, {"text": "n"}], "illustrations": [{"bbox": [0.1, 0.2, 0.3, 1], "caption": "c"}]}]})
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, "{", "x"), (3, None, "x")], "cache_id long, cache_json string, path string")
    parsed = jt.to_triples(df)
    blocks = jt.flat_table(parsed, "blocks").collect()
    assert [(r.cache_id, r.result_index, r.item_index, r.text) for r in blocks] == [(1, 0, 0, "x")]
    notes = {(r.item_index, r.kind, r.value or r.text) for r in jt.flat_table(parsed, "notes").collect()}
    assert notes == {(0, "string", "plain"), (2, "object", "n")}
    assert jt.flat_table(parsed, "illustrations").collect()[0].bbox == [0.1, 0.2, 0.3, 1.0]
    assert jt.flat_table(parsed, "block_markers").collect()[0].value == "1"
    assert jt.children(jt.to_triples(df.where("cache_id > 5"))).count() == 0


def test_empty_and_odd_tables(spark, small, tmp_path):
    """All queries of problems 1 and 2 on tables without rows, with nulls, repeats and clashing columns."""
    from pyspark.sql import functions as F

    from pagemill.plans.data_queries import QUERIES
    from pagemill.runtime import table

    for where, rows in (("empty", 0), ("odd", 60)):
        for name, key in (("page_export", "line_id"), ("recovery_caches", "cache_id")):
            df = table(spark, small, name).limit(rows)
            holes = df.limit(5).select(*((F.col(c) + 10_000_000 if c == key else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes))
            out = df.unionByName(df.limit(9)).unionByName(holes).withColumns({c: F.lit("clash") for c in ("reason", "rec", "raw", "path", "kind", "value", "ordinals", "page")})
            out.write.parquet(str(tmp_path / where / f"{name}.parquet"))
        for name, query in QUERIES.items():
            got = query(spark, str(tmp_path / where)).collect()
            assert len(got) == len(set(map(str, got))), name
            assert rows or not got, name


def test_large_page_numbers_load(spark):
    from pagemill.sources import page_export

    line = "bk-00000001,{},body,true,T,1.5,words"
    rows = [(1, line.format(99999999999)), (2, line.format("9" * 30)), (3, line.format(7))]
    got = {r.line_id: (r.reason, r.rec.page, r.raw) for r in page_export.load(spark.createDataFrame(rows, "line_id long, line string")).collect()}
    assert got == {1: (None, 99999999999, None), 2: (None, None, rows[1][1]), 3: (None, 7, None)}


def test_no_field_is_lost(spark):
    """Fields without a column and groups without a table come out too, linked to their parents."""
    record = {"title": "T", "authors": ["A", None, "B"], "job": {"host": "h", "runs": [{"n": 1}, {"n": 2, "logs": ["x", "y"]}]},
              "results": [{"page": 1, "usage": {"in": 5, "out": {"a": 1}}, "blocks": [{"type": "p", "text": "a\\nb", "style": {"bold": True, "font": {"runs": [1, 2]}}}], "illustrations": [{"bbox": [0.1, None, 1], "caption": "c"}]}, None]}
    rows = spark.createDataFrame([(1, json.dumps(record)), (1, json.dumps(record)), (2, "{"), (3, None), (4, "[]")], "cache_id long, cache_json string")
    t = {k: df.collect() for k, df in jt.every_table(rows).items()}
    assert {r.cache_id for r in t["caches"]} == {1, 4} and next(r for r in t["caches"] if r.cache_id == 1).other == {"job.host": "h"}
    assert [(r.author_index, r.value) for r in sorted(t["authors"], key=lambda r: r.author_index)] == [(0, "A"), (2, "B")]
    (page,) = t["pages"]
    assert page.page == 1 and page.other == {"usage.in": "5", "usage.out.a": "1"}
    (block,) = t["blocks"]
    assert (block.result_index, block.item_index, block.other) == (0, 0, {"style.bold": "true"}) and block.text == record["results"][0]["blocks"][0]["text"]
    (figure,) = t["illustrations"]
    assert figure.bbox[0] == 0.1 and figure.other == {}
    more = {(r.ancestor, tuple(r.ordinals)): (r.kind, r.value, r.fields) for r in t["further"]}
    assert more == {
        ("job.runs[]", (0,)): ("object", None, {"n": "1"}), ("job.runs[]", (1,)): ("object", None, {"n": "2"}), ("job.runs[].logs[]", (1, 0)): ("string", "x", {}), ("job.runs[].logs[]", (1, 1)): ("string", "y", {}),
        ("results[].blocks[].style.font.runs[]", (0, 0, 0)): ("number", "1", {}), ("results[].blocks[].style.font.runs[]", (0, 0, 1)): ("number", "2", {}),
    }


def test_odd_keys_are_no_levels(spark):
    """Keys that read like paths, empty ones and halves of characters name plain fields; children are the keys of the pivoted groups."""
    page = {"blocks": ["a", None, {"text": "b", "note_markers": ["1", None]}], "blocks[]": "x", "notes": "n", "blocks[].note_markers[]": 5, "usage": {"in": 1}, "usage.in": 2, "~": 3, "~0": 4, "\ud800": 5, "\ud801": 6, "": {"notes": ["no"]}}
    record = {"results": [page, None, {"illustrations[]": 1}], "results[].notes[]": ["no"], "": {"results": [{"notes": ["no"]}]}, "results[]": {"blocks": ["no"]}}
    text = json.dumps(record)
    parsed = jt.to_triples(spark.createDataFrame([(1, text), (2, "{"), (3, "[]")], "cache_id long, cache_json string"), root=None)
    got = [tuple(r) for r in jt.children(parsed).collect()]
    assert sorted(got) == sorted((1, i, kind, j, m) for i, kind, j, m in expected(text))
    tables = {"block": "blocks", "note": "notes", "marker": "block_markers"}
    assert {r[1:] for r in got} == {(r.result_index, k, r.item_index, r["sub_index"] if k == "marker" else -1) for k, t in tables.items() for r in jt.flat_table(parsed, t).collect()}
    (first, _) = sorted(jt.flat_table(parsed, "pages").collect(), key=lambda r: r.result_index)
    assert first.other == {"blocks~2]": "x", "blocks~2]~1note_markers~2]": "5", "usage.in": "1", "usage~1in": "2", "~0": "3", "~00": "4", "~d800": "5", "~d801": "6"}
    block = jt.elements(parsed, jt.F.col("ancestor") == "results[].blocks[]").where("kind = 'object'").collect()
    assert [(r.ordinals, r.fields) for r in block] == [([0, 2], {"text": "b"})]
    plan = jt.children(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [cache_id" in plan and "ancestor" in plan  # by group, not by a list of paths
