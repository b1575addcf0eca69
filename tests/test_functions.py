import json
import datetime

import pytest
from pyspark.sql import functions as F

from recordloom.functions import jsonschema
from recordloom.functions import text as t


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_dates_are_strict(spark):
    inputs = ["2026-01-01", "2026-1-1", "2026", " 2026-01-01 ", "2026-01-01T00:00:00", "20260101", "2026-W01-1", "2026-02-30", "", "2026-01-01\n"]
    expected = []
    for x in inputs:
        try:
            datetime.date.fromisoformat(x)
            expected.append(True)
        except ValueError:
            expected.append(False)
    assert values(spark, t.is_date(F.col("x")), inputs) == expected
    stamps = ["2026-01-01", "2026-01-01T10:00:00+00:00", "2026-01-01 10:00", "2026-01-01T10:00:00Z", "2026-01-01T25:00:00", "now"]
    assert values(spark, t.is_timestamp(F.col("x")), stamps) == [True, True, True, True, False, False]


def test_slugs_titles_numbers(spark):
    assert values(spark, t.slug("x"), ["Hello, World!", "--", "A_b"]) == ["hello-world", "item", "a-b"]
    assert values(spark, t.slug("x", 5), ["abcd efgh"]) == ["abcd-"]
    assert values(spark, t.clean_title("x"), ["107 — Foo", "21-multi", "12: "]) == ["Foo", "21-multi", "12: "]
    num, slug = t.split_number("x")
    assert values(spark, F.struct(num, slug), ["TODO-001-some thing", "12_search", "login"]) == [("001", "some-thing"), ("12", "search"), (None, "login")]
    assert values(spark, t.section_lifecycle("x"), ["Incomplete", "Unknown", "Later", "On hold", "Other"]) == ["completed", "active", "deferred", "blocked", None]
    assert values(spark, t.clean_inline("x"), ["`a` *b* _c_ "]) == ["a b c"]


def test_front_matter(spark):
    inputs = ["---\nid: 1\ntitle: \"A: b\"\nid: 2\nlist: [a, \"b, c\"]\n\n---\nbody", "no fence\n---", "---\nid: 1\n", "---\nodd line\n---\n", None]
    got = values(spark, t.front_matter("x"), inputs)
    assert got[0] == {"title": '"A: b"', "id": "2", "list": '[a, "b, c"]'}
    assert got[1:] == [None, None, None, None]
    assert values(spark, t.items(F.col("x")), ['[a, "b, c"]', "[]", "a"]) == [["a", "b", "c"], [], []]
    assert values(spark, t.scalar(F.col("x")), ['"A: b"', "'x'"]) == ["A: b", "x"]


def test_lines_break_as_python_breaks_them(spark):
    inputs = ["a\nb", "a\r\nb\n", "a b\x0bc\x85d", ""]
    assert values(spark, t.lines("x"), inputs) == [x.splitlines() for x in inputs]


@pytest.mark.parametrize("glob,text,fits", [("src/*", "src/a/b.py", True), ("a?c", "abc", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("**", "any/thing", True), ("a.b", "axb", False), ("A*", "ab", False)])
def test_globs(spark, glob, text, fits):
    import re

    assert bool(re.search(t.glob_regex(glob).replace(r"\z", r"\Z"), text)) is fits
    regex, head = t.glob_pattern("x")
    df = spark.createDataFrame([(glob, text)], "x string, y string").select(regex.alias("r"), head.alias("h"), "y")
    assert df.where("y rlike r and startswith(y, h)").count() == int(fits)


def test_paths(spark):
    assert values(spark, t.normal_path("x"), ["a/./b/../c", "../x/..", "", "a//b/", "a\\b"]) == ["a/c", "..", ".", "a/b", "a/b"]
    assert values(spark, t.relative_path("x", F.lit("work/active/001-a")), ["docs/x.md", "work/active/002-b/README.md", "work/active/001-a"]) == ["../../../docs/x.md", "../002-b/README.md", "."]
    assert values(spark, t.canonical_remote("x"), ["https://host.test/o/r.git", "git@host.test:o/r.git", "ssh://git@host.test/o/r", "nonsense"]) == ["o/r", "o/r", "o/r", None]
    assert values(spark, t.url_path("x"), ["a b/c+d"]) == ["a%20b/c%2Bd"]
    assert values(spark, t.rstrip_chars("x", "/*"), ["a/b/**", "a*/"]) == ["a/b", "a"]


def test_sections(spark):
    text = "# T\n## One\nbody 1\n```\nin\n```\n## Two\nbody 2\n"
    assert values(spark, t.section("x", "One"), [text]) == ["body 1\n```\nin\n```\n"]
    assert values(spark, t.section("x", "Three"), [text]) == [None]
    assert values(spark, t.fenced("x"), [text, "plain"]) == ["\nin\n", "plain"]


def schema_errors(spark, texts, docs):
    """The errors of each document (digest of its schema, text), as sets of (location, message)."""
    nodes = jsonschema.compiled(spark.createDataFrame([(k, x if isinstance(x, str) else json.dumps(x)) for k, x in texts.items()], "digest string, text string"))
    own = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(docs)], "doc int, digest string, text string")
    out = [set() for _ in docs]
    for r in jsonschema.errors(own.select("doc", "digest", F.try_parse_json("text").alias("v")), nodes).collect():
        out[r["doc"]].add((r["location"], r["message"]))
    return out


def test_schema_errors(spark):
    schema = {
        "type": "object", "required": ["id", "n"], "additionalProperties": False,
        "properties": {
            "id": {"type": "string", "pattern": "^a", "minLength": 2}, "n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string"}},
            "kind": {"enum": ["x", "y"]}, "yes": {"const": True}, "maybe": {"type": ["string", "null"]}, "either": {"oneOf": [{"type": "string"}, {"type": "integer"}]},
        },
        "allOf": [{"if": {"properties": {"kind": {"const": "y"}}, "required": ["kind"]}, "then": {"required": ["tags"]}}],
    }
    docs = ['{"id": "ab", "n": 1}', '{"id": "b", "n": 0.5}', '{"n": 2, "x": 1}', '{"id": "ab", "n": 1, "tags": ["a", 1, "a"]}', '{"id": "ab", "n": 1, "kind": "y"}', '{"id": "ab", "n": 1, "yes": false, "maybe": null, "either": []}', '{"id": "ab", "n": 1.0, "tags": []}', "[]"]
    told = schema_errors(spark, {"s": schema}, [("s", x) for x in docs])
    assert told[0] == set()
    assert ("id", "'b' does not match '^a'") in told[1] and ("id", "'b' is too short") in told[1] and any(a == "n" and "is not of type 'integer'" in b for a, b in told[1]) and any("less than the minimum" in b for _, b in told[1])
    assert told[2] == {("<root>", "'id' is a required property"), ("<root>", "Additional properties are not allowed ('x' was unexpected)")}
    assert ("tags/1", "1 is not of type 'string'") in told[3] and any("non-unique" in b for _, b in told[3])
    assert told[4] == {("<root>", "'tags' is a required property")}
    assert {a for a, _ in told[5]} == {"yes", "either"}
    assert told[6] == {("tags", "[] should be non-empty")}
    assert ("<root>", "[] is not of type 'object'") in told[7]


def test_schemas_are_rows(spark):
    """Each document by its own schema: nested decisions, references into the schema itself, and keywords of all kinds."""
    tree = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}}}}}
    nested = {"not": {"not": {"anyOf": [{"const": 1}, {"allOf": [{"type": "string"}, {"if": {"minLength": 3}, "then": {"pattern": "z$"}, "else": {"enum": ["a", "b"]}}]}]}}}
    either = {"oneOf": [{"type": "integer"}, {"minimum": 2}, {"type": "string"}]}
    keys = {"propertyNames": {"maxLength": 3}, "patternProperties": {"^n": {"type": "number"}}, "properties": {"a/b": {"const": {"x": [1]}}}, "additionalProperties": {"type": "boolean"}, "dependentRequired": {"n": ["m"]}, "minProperties": 2, "maxProperties": 3}
    rows = {"prefixItems": [{"type": "string"}, {"const": None}], "items": {"multipleOf": 0.5, "exclusiveMaximum": 9, "exclusiveMinimum": 0, "maximum": 7}, "maxItems": 4}
    texts = {"tree": tree, "nested": nested, "either": either, "keys": keys, "rows": rows, "lost": {"properties": {"a": {"$ref": "#/none"}, "b": False, "c": True}}, "odd": "{'x': 1}"}
    docs = [
        ("tree", '{"n": 1, "kids": [{"n": 2, "kids": [{"kids": 3}]}]}'), ("nested", '"a"'), ("nested", '"c"'), ("nested", '"xyy"'), ("nested", "1.0"), ("nested", "true"), ("either", "1"), ("either", "3"), ("either", '"it\'s"'), ("either", "[1, {\"a\": null}]"),
        ("keys", '{"n": "1", "long": true, "a/b": {"x": [1]}}'), ("keys", '{"a/b": 2}'), ("keys", '{"x": true, "n": 1, "m": false, "y": 3}'), ("rows", '[1, null, 0.25, 9, 8]'), ("rows", '["a", 0]'), ("lost", '{"a": 1, "b": 2, "c": 3}'), ("odd", "1"),
    ]
    root = lambda *x: {("<root>", m) for m in x}
    wrong = repr(nested["not"])[8:-1]
    told = schema_errors(spark, texts, docs)
    assert told[0] == {("kids/0/kids/0", "'n' is a required property"), ("kids/0/kids/0/kids", "3 is not of type 'array'")}
    assert told[1:6] == [set(), root(f"'c' should not be valid under {{'not': {wrong}}}"), root(f"'xyy' should not be valid under {{'not': {wrong}}}"), set(), root(f"True should not be valid under {{'not': {wrong}}}")]
    assert told[6:10] == [set(), root("3 is valid under each of {'minimum': 2}, {'type': 'integer'}"), root("\"it's\" is valid under each of {'type': 'string'}, {'minimum': 2}"), set()]
    assert told[10] == {("n", "'1' is not of type 'number'"), ("<root>", "'long' is too long"), ("<root>", "'m' is a dependency of 'n'")}
    assert told[11] == {("a/b", "{'x': [1]} was expected"), ("<root>", "{'a/b': 2} does not have enough properties")}
    assert told[12] == {("y", "3 is not of type 'boolean'"), ("<root>", "{'m': False, 'n': 1, 'x': True, 'y': 3} has too many properties")}
    assert told[13] == {("0", "1 is not of type 'string'"), ("2", "0.25 is not a multiple of 0.5"), ("3", "9 is greater than the maximum of 7"), ("3", "9 is greater than or equal to the maximum of 9"), ("4", "8 is greater than the maximum of 7"), ("<root>", "[1, None, 0.25, 9, 8] is too long")}
    assert told[14] == {("1", "None was expected")}
    assert told[15] == {("a", "Unresolvable reference #/none for 1"), ("b", "False schema does not allow 2")} and told[16] == root("False schema does not allow 1")


def test_a_level_meets_its_own_nodes_alone(spark):
    # `long` is reached by ways of two and of four steps; below it nodes come again, elsewhere each has one level.
    text = {"properties": {"a": {"$ref": "#/$defs/long"}, "b": {"items": {"properties": {"c": {"$ref": "#/$defs/long"}}}}, "d": {"minimum": 3}}, "$defs": {"long": {"items": {"minLength": 2}}}, "allOf": [{"required": ["e"]}]}
    nodes = jsonschema.compiled(spark.createDataFrame([("s", json.dumps(text))], "digest string, text string"))
    levels = {r["node"]: (r["deep"], r["again"]) for r in nodes.collect()}
    assert levels["#"] == (0, False) and levels["#/properties/d"] == levels["#/allOf/0"] == (1, False) and levels["#/$defs/long"] == (2, True) and levels["#/$defs/long/items"] == (3, True)
    doc = spark.createDataFrame([(1, "s", json.dumps({"a": ["x"], "b": [{"c": ["xx", "y"]}], "d": 1, "e": 0}))], "doc int, digest string, text string")
    found = jsonschema.errors(doc.select("doc", "digest", F.try_parse_json("text").alias("v")), nodes)
    assert sorted((r["location"], r["message"]) for r in found.collect()) == [("a/0", "'x' is too short"), ("b/0/c/1", "'y' is too short"), ("d", "1 is less than the minimum of 3")]
