"""JSON Schemas as data: a schema is rows, one for each of its parts, and documents walk them level by level.

compiled() turns distinct schema texts into rows (digest, node, deep, again, checks, steps). A node is a part of a schema,
named by its JSON pointer; deep is its least level in a walk, again whether it may come at later ones too, so a level meets
the nodes that can stand at it and no others; its checks are keywords with their arguments, its steps lead to the nodes that hold for a value's members,
elements or the value itself. errors() joins values with the nodes at which they stand, evaluates all checks of a node by
one expression over VARIANT, and goes on with what the steps give, until nothing is left. So the number of schemas is a
number of rows, never of branches of a plan, and a schema that half of all documents share is an ordinary skewed key of a
join. Parts that only decide (if, not, branches of anyOf and oneOf) are walked like others, in frames of their own; when
the walk is over, frames are settled from the innermost out.

Keywords: type, enum, const, required, properties, patternProperties, additionalProperties, propertyNames, items, prefixItems,
minItems, maxItems, uniqueItems, minLength, maxLength, pattern (searched for), minimum, maximum, exclusiveMinimum,
exclusiveMaximum, multipleOf, minProperties, maxProperties, dependentRequired, allOf, anyOf, oneOf, not, if/then/else, $ref
into the same schema, true and false. Others, format too, are ignored. A $ref to nothing is an error of each value there.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from recordloom.sources.stored import written

_CHECK = "struct<keyword: string, shown: string, number: double, names: array<string>, more: array<string>, numbers: array<double>>"
_STEP = "struct<kind: string, key: string, names: array<string>, more: array<string>, target: string, how: string, nth: int, shown: string>"
_NODE = f"digest string, node string, deep int, again boolean, checks array<{_CHECK}>, steps array<{_STEP}>"


# --- schemas as rows -------------------------------------------------------


def _check(keyword: str, shown: str = "", number: float | None = None, names=None, more=None, numbers=None) -> dict:
    return {"keyword": keyword, "shown": shown, "number": None if number is None else float(number), "names": names, "more": more, "numbers": numbers}


def _step(kind: str, target: str, key: str | None = None, names=None, more=None, how: str = "", nth: int = 0, shown: str = "") -> dict:
    return {"kind": kind, "key": key, "names": names, "more": more, "target": target, "how": how, "nth": nth, "shown": shown}


def _plain(x: object) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is_number(x: object) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _one_of(keyword: str, values: list, shown: str) -> dict:
    return _check(keyword, shown, names=[_plain(x) for x in values if not _is_number(x)], numbers=[float(x) for x in values if _is_number(x)])


#: Keywords with a number for argument.
_NUMBERS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")


def nodes_of(schema: dict | bool) -> Iterator[tuple[str, list[dict], list[dict]]]:
    """(node, checks, steps) of the parts of a schema that can be reached from its root, #."""
    todo, seen = ["#"], {"#"}

    def part(pointer: str):
        own = schema
        for key in pointer.split("/")[1:]:
            key = key.replace("~1", "/").replace("~0", "~")
            own = own[int(key)] if isinstance(own, list) else own[key]
        return own

    while todo:
        node, checks, steps = todo.pop(), [], []

        def go(kind: str, *keys: object, node=node, steps=steps, **more) -> None:
            target = "/".join([node, *(str(k).replace("~", "~0").replace("/", "~1") for k in keys)])
            steps.append(_step(kind, target, **more))

        try:
            own = part(node)
        except (KeyError, IndexError, ValueError, TypeError):
            own = None
        if own is False:
            checks.append(_check("never", "False schema does not allow "))
        elif own is None:
            checks.append(_check("never", f"Unresolvable reference {node} for "))
        elif isinstance(own, dict):
            if "$ref" in own:
                steps.append(_step("same", str(own["$ref"])))
            if "type" in own:
                kinds = own["type"] if isinstance(own["type"], list) else [own["type"]]
                checks.append(_check("type", ", ".join(map(repr, kinds)), names=kinds))
            if "enum" in own:
                checks.append(_one_of("enum", own["enum"], repr(own["enum"])))
            if "const" in own:
                checks.append(_one_of("const", [own["const"]], repr(own["const"])))
            if "pattern" in own:
                checks.append(_check("pattern", repr(own["pattern"]), names=[own["pattern"]]))
            checks += [_check(k, repr(own[k]), own[k]) for k in _NUMBERS if _is_number(own.get(k))]
            if own.get("uniqueItems") is True:
                checks.append(_check("uniqueItems"))
            checks += [_check("required", repr(k), names=[k]) for k in own.get("required", ())]
            checks += [_check("dependentRequired", f"{each!r} is a dependency of {k!r}", names=[k], more=[each]) for k, needs in own.get("dependentRequired", {}).items() for each in needs]
            properties, patterns = own.get("properties", {}), own.get("patternProperties", {})
            for key in properties:
                go("property", "properties", key, key=key)
            for key in patterns:
                go("pattern", "patternProperties", key, key=key)
            if own.get("additionalProperties") is False:
                checks.append(_check("closed", names=list(properties), more=list(patterns)))
            elif "additionalProperties" in own:
                go("others", "additionalProperties", names=list(properties), more=list(patterns))
            if "propertyNames" in own:
                go("names", "propertyNames")
            first = own.get("prefixItems", [])
            for k in range(len(first)):
                go("nth", "prefixItems", k, key=str(k))
            if "items" in own:
                go("items", "items", key=str(len(first)))
            for k in range(len(own.get("allOf", ()))):
                go("same", "allOf", k)
            for how in ("anyOf", "oneOf"):
                for k, sub in enumerate(own.get(how, ())):
                    go("same", how, k, how=how, nth=k, shown=repr(sub))
            if "not" in own:
                go("same", "not", how="not", shown=repr(own["not"]))
            if "if" in own:
                for how in ("if", "then", "else"):
                    if how in own:
                        go("same", how, how=how)
        for step in steps:
            if step["target"] not in seen:
                seen.add(step["target"])
                todo.append(step["target"])
        yield node, checks, steps


def _levels(nodes: list[tuple[str, list[dict], list[dict]]]) -> dict[str, tuple[int, bool]]:
    """deep and again of each node, the root first."""
    to = {node: [s["target"] for s in steps] for node, _, steps in nodes}
    deep, level = {"#": 0}, ["#"]
    while level:
        after = []
        for node in level:
            for x in to[node]:
                if x not in deep:
                    deep[x] = deep[node] + 1
                    after.append(x)
        level = after
    again, todo = set(), [x for node in to for x in to[node] if deep[x] != deep[node] + 1]
    while todo:  # what lies below such a node comes again as well
        x = todo.pop()
        if x not in again:
            again.add(x)
            todo += to[x]
    return {node: (deep[node], node in again) for node in to}


def compiled(texts: DataFrame) -> DataFrame:
    """The rows of distinct schemas (digest, text), as a written table; a text that is no JSON takes no value."""

    def run(batches):
        for batch in batches:
            # Equal lists of checks and steps, as most schemas have them, are made into columns once.
            heads, parts, own = [], {}, []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    schema = json.loads(text)
                except ValueError:
                    schema = False
                nodes = list(nodes_of(schema))
                levels = _levels(nodes)
                for node, checks, steps in nodes:
                    heads.append((digest, node, *levels[node]))
                    own.append(parts.setdefault(json.dumps((checks, steps)), (len(parts), checks, steps))[0])
            if heads:
                columns = [pa.array(x, t) for x, t in zip(zip(*heads, strict=True), arrow.types, strict=False)]
                columns += [pa.array([x[k] for x in parts.values()], arrow.types[3 + k]).take(pa.array(own)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(_NODE))
    return written(texts.select("digest", "text").dropDuplicates(["digest"]).mapInArrow(run, _NODE), "schemas")


# --- values ----------------------------------------------------------------


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_type(v: Column, name: str) -> Column:
    k = _kind(v)
    tests = {
        "string": lambda: k == "STRING",
        "boolean": lambda: k == "BOOLEAN",
        "null": lambda: F.is_variant_null(v),
        "array": lambda: k.startswith("ARRAY<"),
        "object": lambda: k.startswith("OBJECT<"),
        "number": lambda: k.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"),
        "integer": lambda: k.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))\z") | (k.rlike("^(FLOAT|DOUBLE|DECIMAL)") & (F.try_variant_get(v, "$", "double") % 1 == 0)),
    }
    return F.coalesce(tests[name](), F.lit(False))


def _quoted(text: Column) -> Column:
    """A text between quotes, those that aren't in it, with escapes for backslashes and line ends."""
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), text, F.lit('"'))).when(F.contains(text, F.lit("'")), single).otherwise(F.concat(F.lit("'"), text, F.lit("'")))


def shown(v: Column) -> Column:
    """A value as the messages show it; members of objects go by their keys."""

    def token(x: Column) -> Column:
        plain = F.replace(F.replace(x, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
        for name, new in (("true", "True"), ("false", "False"), ("null", "None")):
            plain = F.replace(plain, F.lit(name), F.lit(new))
        return F.when(x.startswith('"'), F.concat(F.lit("'"), F.substring(x, F.lit(2), F.length(x) - 2), F.lit("'"))).otherwise(plain)

    tokens = F.regexp_extract_all(F.to_json(v), F.lit(r'("(?:[^"\\]|\\.)*"|[^"]+)'))
    return (
        F.when(is_type(v, "string"), _quoted(F.try_variant_get(v, "$", "string"))).when(is_type(v, "boolean"), F.initcap(F.to_json(v))).when(is_type(v, "null"), F.lit("None"))
        .when(is_type(v, "number"), F.to_json(v)).otherwise(F.array_join(F.transform(tokens, token), ""))
    )


# --- the walk --------------------------------------------------------------


def _failure(c: Column) -> Column:
    """The message of a check c at a row of the walk, null where it holds."""
    text, number, members, fields, told = (F.col(x) for x in ("text", "num", "members", "fields", "told"))
    size, keys, n = F.size(members), F.map_keys(fields), c["number"]
    same = F.coalesce(F.array_contains(c["names"], F.col("plain")) | F.array_contains(c["numbers"], number), F.lit(False))
    kinds = F.coalesce(F.arrays_overlap(c["names"], F.col("kinds")), F.lit(False))
    again = F.size(F.array_distinct(F.transform(members, lambda x: F.to_json(x)))) < size
    extra = F.array_sort(F.filter(F.array_except(keys, c["names"]), lambda k: ~F.exists(c["more"], lambda p: F.regexp_like(k, p))))
    several = F.when(F.size(extra) > 1, " were unexpected)").otherwise(" was unexpected)")
    closed = F.concat(F.lit("Additional properties are not allowed ("), F.array_join(F.transform(extra, _quoted), ", "), several)
    least = lambda what: F.when(n == 1, " should be non-empty").otherwise(what)
    most = lambda what: F.when(n == 0, " is expected to be empty").otherwise(what)
    after = {  # keyword: condition of a failure, what its message says after the value
        "type": (~kinds, F.concat(F.lit(" is not of type "), c["shown"])),
        "enum": (~same, F.concat(F.lit(" is not one of "), c["shown"])),
        "pattern": (~F.regexp_like(text, F.get(c["names"], 0)), F.concat(F.lit(" does not match "), c["shown"])),
        "minLength": (F.char_length(text) < n, least(" is too short")),
        "maxLength": (F.char_length(text) > n, most(" is too long")),
        "minItems": (size < n, least(" is too short")),
        "maxItems": (size > n, most(" is too long")),
        "minProperties": (F.size(keys) < n, least(" does not have enough properties")),
        "maxProperties": (F.size(keys) > n, most(" has too many properties")),
        "minimum": (number < n, F.concat(F.lit(" is less than the minimum of "), c["shown"])),
        "maximum": (number > n, F.concat(F.lit(" is greater than the maximum of "), c["shown"])),
        "exclusiveMinimum": (number <= n, F.concat(F.lit(" is less than or equal to the minimum of "), c["shown"])),
        "exclusiveMaximum": (number >= n, F.concat(F.lit(" is greater than or equal to the maximum of "), c["shown"])),
        "multipleOf": (number % n != 0, F.concat(F.lit(" is not a multiple of "), c["shown"])),
        "uniqueItems": (again, F.lit(" has non-unique elements")),
    }
    whole = {  # keyword: condition, the whole message
        "const": (~same, F.concat(c["shown"], F.lit(" was expected"))),
        "required": (~F.array_contains(keys, F.get(c["names"], 0)), F.concat(c["shown"], F.lit(" is a required property"))),
        "dependentRequired": (F.array_contains(keys, F.get(c["names"], 0)) & ~F.array_contains(keys, F.get(c["more"], 0)), c["shown"]),
        "closed": (F.size(extra) > 0, closed),
        "never": (F.lit(True), F.concat(c["shown"], told)),
    }
    out, is_ = None, c["keyword"]
    for name, (fails, message) in [*((k, (f, F.concat(told, m))) for k, (f, m) in after.items()), *whole.items()]:
        own = F.when(fails, message)
        out = F.when(is_ == name, own) if out is None else out.when(is_ == name, own)
    return out


def _onward(s: Column) -> Column:
    """The rows to which a step s leads from a row of the walk: node, at, v, and the frame of a part that decides."""
    fields, members, at = F.col("fields"), F.col("members"), F.col("at")

    def row(where: Column, v: Column) -> Column:
        # Frames are told apart by where they began: the value's place, the node and the branch.
        inner = F.concat_ws("\x01", "frame", at, "node", s["how"], s["nth"].cast("string"))
        return F.struct(s["target"].alias("node"), where.alias("at"), v.alias("v"), F.when(s["how"] == "", F.col("frame")).otherwise(inner).alias("frame"), s["how"].alias("how"), s["nth"].alias("nth"), s["shown"].alias("branch"))

    def below(key: Column) -> Column:
        return F.when(at == "", key).otherwise(F.concat(at, F.lit("/"), key))

    def of_keys(keys: Column) -> Column:
        return F.transform(keys, lambda k: row(below(k), F.try_element_at(fields, k)))

    keys = F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))
    others = F.filter(F.array_except(keys, s["names"]), lambda k: ~F.exists(s["more"], lambda p: F.regexp_like(k, p)))
    elements = F.transform(F.coalesce(members, F.array().cast("array<variant>")), lambda x, i: row(below(i.cast("string")), x))
    kind, first = s["kind"], F.coalesce(s["key"].try_cast("int"), F.lit(0))
    return (
        F.when(kind == "same", F.array(row(at, F.col("v"))))
        .when(kind == "property", of_keys(F.filter(keys, lambda k: k == s["key"])))
        .when(kind == "pattern", of_keys(F.filter(keys, lambda k: F.regexp_like(k, s["key"]))))
        .when(kind == "others", of_keys(others))
        .when(kind == "names", F.transform(keys, lambda k: row(at, k.cast("variant"))))
        .when(kind == "nth", F.slice(elements, first + 1, 1))
        .otherwise(F.slice(elements, first + 1, F.greatest(F.size(elements), F.lit(1))))
    )


def _level(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc, digest, frame, at, told, errors and onward of each row (doc, digest, node, at, frame, v)."""
    v = F.col("v")
    kinds = F.array_compact(F.array(*(F.when(is_type(v, k), k) for k in ("string", "boolean", "null", "array", "object", "number", "integer"))))
    own = rows.join(nodes, ["digest", "node"]).withColumns({
        "kinds": kinds, "text": F.when(is_type(v, "string"), F.try_variant_get(v, "$", "string")), "num": F.when(is_type(v, "number"), F.try_variant_get(v, "$", "double")), "plain": F.when(~is_type(v, "number"), F.to_json(v)),
        "members": F.when(is_type(v, "array"), F.try_variant_get(v, "$", "array<variant>")), "fields": F.when(is_type(v, "object"), F.try_variant_get(v, "$", "map<string, variant>")), "told": shown(v),
    })
    found = F.array_compact(F.transform("checks", lambda c: _failure(c)))
    return own.select("doc", "digest", "node", "frame", "at", "told", F.transform(found, lambda m: F.struct(F.col("at").alias("at"), m.alias("message"))).alias("errors"), F.flatten(F.transform("steps", _onward)).alias("onward"))


def errors(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """location and message of each error, with doc (any column that tells values apart), of values (doc, digest, v: a VARIANT).

    location is like a/0/b, <root> for the whole. Each level of the walk is a written table, so a lost executor costs a level
    at most; there are as many as the deepest path through a schema, and through a document where a schema refers to itself.
    """
    rows, found, frames = values.where("v IS NOT NULL").select("doc", "digest", F.lit("#").alias("node"), F.lit("").alias("at"), F.lit("").alias("frame"), "v"), [], []
    for deep in itertools.count():
        level = written(_level(rows, nodes.where((F.col("deep") == deep) | (F.col("again") & (F.col("deep") < deep))).drop("deep", "again")), "walk")
        found.append(level.select("doc", "frame", F.explode("errors").alias("e")).select("doc", "frame", "e.*"))
        onward = level.select("doc", "digest", "node", "at", "told", F.col("frame").alias("outer"), F.explode("onward").alias("o"))
        frames.append(onward.where("o.how <> ''").select("doc", "outer", F.concat_ws("\x01", "outer", "at", "node").alias("place"), "at", "told", "o.frame", "o.how", "o.nth", "o.branch"))
        if level.where(F.size("onward") > 0).isEmpty():
            break
        rows = onward.select("doc", "digest", "o.node", "o.at", "o.frame", "o.v")
    inside = lambda c: F.size(F.split(c, "\x01"))
    return _settled(_union(found).withColumn("deep", inside("frame")), _union(frames).withColumn("deep", inside("frame"))).select("doc", F.when(F.col("at") == "", "<root>").otherwise(F.col("at")).alias("location"), "message")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _settled(found: DataFrame, frames: DataFrame) -> DataFrame:
    """The errors outside all frames, once each frame says whether its part holds; inner frames before outer ones."""
    depths = [r[0] for r in frames.select("deep").distinct().collect()]  # as many as parts that decide lie in one another
    if not depths:
        return found
    found, frames = written(found, "errors"), written(frames, "frames")
    for deep in sorted(depths, reverse=True):
        inside = found.where(F.col("deep") == deep)
        own = frames.where(F.col("deep") == deep).join(inside.select("doc", "frame").distinct().withColumn("bad", F.lit(True)), ["doc", "frame"], "left").withColumn("holds", F.col("bad").isNull())
        # A place has as many branches as its schema.
        place = own.groupBy("doc", "outer", "place", "at", "told", F.when(F.col("how").isin("then", "else"), "if").otherwise(F.col("how")).alias("kind")).agg(
            F.array_sort(F.collect_list(F.when(F.col("holds"), F.struct("nth", "branch")))).alias("held"), F.max(F.when(F.col("how") == "if", F.col("holds"))).alias("holds"))
        n, kind, told = F.size("held"), F.col("kind"), F.col("told")
        none, wrong = F.concat(told, F.lit(" is not valid under any of the given schemas")), F.concat(told, F.lit(" should not be valid under "), F.get("held", 0)["branch"])
        # The first branch that holds is told last.
        several = F.concat(told, F.lit(" is valid under each of "), F.array_join(F.transform(F.concat(F.slice("held", 2, F.greatest(n, F.lit(1))), F.slice("held", 1, 1)), lambda x: x["branch"]), ", "))
        message = F.when(kind.isin("anyOf", "oneOf") & (n == 0), none).when((kind == "oneOf") & (n > 1), several).when((kind == "not") & (n > 0), wrong)
        outer = lambda df, *columns: df.select("doc", F.col("outer").alias("frame"), "at", *columns, F.size(F.split("outer", "\x01")).alias("deep"))
        judged = outer(place.withColumn("message", message).where("message IS NOT NULL"), "message")
        # What then or else has found counts where the condition says so.
        taken = own.where("how IN ('then', 'else')").select("doc", "frame", "outer", "place", "how").join(place.where("kind = 'if'").select("doc", "place", "holds"), ["doc", "place"]).where("holds = (how = 'then')")
        promoted = outer(inside.select("doc", "frame", "at", "message").join(taken.select("doc", "frame", "outer"), ["doc", "frame"]), "message")
        found = written(found.where(F.col("deep") < deep).unionByName(judged).unionByName(promoted), "errors")
    return found
