"""JSON schemas over raw records: validation against a table of schemas, and inference by an associative merge.

Schemas are flattened into rows: edges lead from a schema node to those of its members, items and other members, and
rules are (node, keyword, argument). Records are flattened level by level, by one explode each, and a value's node is
found by joining the edges; then values meet the rules of their node in one join. So any number of schemas, chosen by
the record, is one plan, and a new schema is a row. A side of few rows is broadcast by Spark's own size check.

Inference counts (path, kind). Counts add up, so any partitioning and any order gives the same schema: the kinds of a
path are its types, and a member is required if it was seen as often as its parent was an object.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import variants
from tessera.functions.text import instant
from tessera.operators.raw import parsed

# Fixed names of JSON's types.
TYPES = {"null": "null", "bool": "boolean", "int": "integer", "float": "number", "str": "string", "arr": "array", "obj": "object"}
#: Keys of the edges to an array's items and to members that aren't named; no escaped name has a ~ before these.
ITEMS, OTHERS = "~[]", "~*"
RULES = "schema_id string, node string, parent string, key string, level int, keyword string, texts array<string>, number double"
_NUMBERS = ("minLength", "maxLength", "minimum", "maximum", "minItems", "minProperties")


def _escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _canonical(x: Any) -> str:
    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    if isinstance(x, (int, float)):
        return f"n:{float(x)!r}"
    return f"s:{x}" if isinstance(x, str) else f"j:{json.dumps(x, separators=(',', ':'), ensure_ascii=False)}"


def rules_of(schema_id: str, schema: dict) -> Iterator[tuple]:
    """Rows of RULES: one of keyword ``node`` for each node, with the edge to it, and one for each rule."""

    def walk(s: dict, node: str, parent: str | None, key: str | None, level: int):
        yield schema_id, node, parent, key, level, "node", None, None
        rule = lambda keyword, texts=None, number=None: (schema_id, node, None, None, level, keyword, texts, number)
        if "type" in s:
            yield rule("type", [s["type"]] if isinstance(s["type"], str) else list(s["type"]))
        if "enum" in s:
            yield rule("enum", [_canonical(x) for x in s["enum"]])
        for keyword in ("pattern", "format"):
            if keyword in s:
                yield rule(keyword, [s[keyword]])
        for keyword in _NUMBERS:
            if keyword in s:
                yield rule(keyword, None, float(s[keyword]))
        if s.get("required"):
            yield rule("required", list(s["required"]))
        properties = s.get("properties") or {}
        if s.get("additionalProperties") is False:
            yield rule("additionalProperties", list(properties))
        for k, sub in properties.items():
            yield from walk(sub, f"{node}/{_escaped(k)}", node, k, level + 1)
        for k, sub in ((ITEMS, s.get("items")), (OTHERS, s.get("additionalProperties"))):
            if isinstance(sub, dict):
                yield from walk(sub, f"{node}/{k}", node, k, level + 1)

    yield from walk(schema, f"{schema_id}#", None, None, 0)


def compile_schemas(schemas: DataFrame, schema_id: str = "schema_id", schema: str = "schema") -> DataFrame:
    """RULES of a table of schemas, whose texts are JSON. Keywords: type (one or several), enum, pattern, format date-time,
    minLength, maxLength, minimum, maximum, minItems, minProperties, required, properties, items and additionalProperties
    (false or a schema); others hold for everything. Rows without id or schema are left out."""

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RULES.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for i, s in zip(batch["i"], batch["s"], strict=True) for r in rules_of(i, json.loads(s))], columns=columns)

    return schemas.select(F.col(schema_id).cast("string").alias("i"), F.col(schema).cast("string").alias("s")).where("i IS NOT NULL AND s IS NOT NULL").mapInPandas(flatten, RULES)


def _kind_of(v: Column) -> Column:
    k = variants.kind(v)
    out = F
    for kind, name in TYPES.items():
        out = out.when(k == kind, name)
    return out


def _members(path: Column, parent: Column, v: Column) -> Column:
    """The members and items of a value as structs (path, parent, key, v)."""
    made = lambda key, name, x: F.struct(F.when(path == "$", name).otherwise(F.concat_ws(".", path, name)).alias("path"), parent.alias("parent"), key.alias("key"), x.alias("v"))
    none = F.array().cast("array<struct<path:string,parent:string,key:string,v:variant>>")
    named = F.transform(variants.entries(v), lambda e: made(e["key"], e["key"], e["value"]))
    listed = F.transform(variants.items(v), lambda x, i: made(F.lit(ITEMS), i.cast("string"), x))
    return F.coalesce(named, listed, none)


def _broken(keyword: Column) -> Column:
    """What is wrong with a node's value by its rule: a text, null if nothing is."""
    kind, x, n, texts, v = F.col("kind"), F.col("x"), F.col("number"), F.col("texts"), F.col("v")
    known = F.coalesce(F.transform(variants.entries(v), lambda e: e["key"]), F.array().cast("array<string>"))
    whole = (kind == "number") & (x == F.floor(x))
    typed = F.array_contains(texts, kind) | (F.array_contains(texts, "number") & (kind == "integer")) | (F.array_contains(texts, "integer") & whole)
    said = F.when(kind == "string", F.concat(F.lit("s:"), variants.text(v))).when(kind.isin("integer", "number"), F.concat(F.lit("n:"), x.cast("string"))).when(kind.isin("array", "object"), F.concat(F.lit("j:"), variants.text(v))).otherwise(F.to_json(v))
    length, text = F.char_length(variants.text(v)), variants.text(v)
    missing, more = F.array_sort(F.array_except(texts, known)), F.array_sort(F.array_except(known, texts))
    numeric, is_text = kind.isin("integer", "number"), kind == "string"
    listed = lambda names: F.concat(keyword, F.lit(": "), F.array_join(names, ", "))
    tests = {
        "type": ~typed, "enum": ~F.array_contains(texts, said), "pattern": is_text & ~F.regexp_like(text, F.get(texts, F.lit(0))), "format": is_text & (F.get(texts, F.lit(0)) == "date-time") & instant(text).isNull(),
        "minLength": is_text & (length < n), "maxLength": is_text & (length > n), "minimum": numeric & (x < n), "maximum": numeric & (x > n),
        "minItems": (kind == "array") & (F.size(variants.items(v)) < n), "minProperties": (kind == "object") & (F.size(known) < n),
    }
    out = F.when((keyword == "required") & (kind == "object") & (F.size(missing) > 0), listed(missing)).when((keyword == "additionalProperties") & (kind == "object") & (F.size(more) > 0), listed(more))
    for name, bad in tests.items():
        out = out.when((keyword == name) & F.coalesce(bad, F.lit(False)), F.lit(name))
    return out


def validate(lines: DataFrame, rules: DataFrame, ids: list[str], schema_id: str = "schema_id", column: str = "value", tolerant: bool = False) -> DataFrame:
    """(ids, schema_id, field, message, errors long): the first error of each record that breaks its schema.

    ``lines`` name each record by ``ids`` and its schema by ``schema_id``; ``rules`` are RULES. The field is the dotted
    path of the value that is wrong, with places in arrays, or $ for the record; the message is the keyword, and the
    names in question of required and additionalProperties. First is the least by field and message; ``errors`` counts
    all. A record of an unknown schema has the one error ``schema``. Keywords judge values of their own types only; a whole
    number is an integer, however it is written. Null lines have no row; malformed ones fail, or have none if ``tolerant``.
    """
    depth = rules.agg(F.max("level")).first()[0] or 0
    nodes = rules.where("keyword = 'node'")
    edges = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("__p"), F.col("key").alias("__k"), F.col("node").alias("__named"))
    others = edges.where(F.col("__k") == OTHERS).select(F.col("__p").alias("__q"), F.col("__named").alias("__other"))
    roots = nodes.where("level = 0").select(F.col("schema_id").alias("__s"), F.col("node"))
    rows = parsed(lines, column, tolerant).select(F.struct(*ids).alias("id"), F.col(schema_id).cast("string").alias("schema_id"), F.col("__v").alias("v"))
    rows = rows.join(roots, F.col("schema_id") == F.col("__s"), "left").select("id", "schema_id", F.lit("$").alias("path"), "node", "v", F.lit(True).alias("open"))
    for _ in range(depth):
        none = F.lit(None).cast("string")
        itself = F.array(F.struct(F.col("path").alias("path"), none.alias("parent"), none.alias("key"), F.col("v").alias("v")))
        below = F.when(F.col("open") & F.col("node").isNotNull(), _members(F.col("path"), F.col("node"), F.col("v")))
        each = rows.select("id", "schema_id", "node", F.explode(F.when(below.isNull(), itself).otherwise(F.concat(itself, below))).alias("m")).select("id", "schema_id", "node", "m.*")
        each = each.join(edges, (F.col("parent") == F.col("__p")) & (F.col("key") == F.col("__k")), "left")
        each = each.join(others, (F.col("parent") == F.col("__q")) & (F.col("key") != ITEMS), "left")
        new = F.col("key").isNotNull()
        rows = each.select("id", "schema_id", "path", F.when(new, F.coalesce("__named", "__other")).otherwise(F.col("node")).alias("node"), "v", new.alias("open"))
        rows = rows.where(~F.col("open") | F.col("node").isNotNull())
    of = rules.where("keyword <> 'node'").select(F.col("node").alias("__n"), "keyword", "texts", "number")
    judged = rows.withColumns({"kind": _kind_of(F.col("v")), "x": variants.number(F.col("v"))}).join(of, F.col("node") == F.col("__n"), "left")
    message = F.when(F.col("node").isNull(), "schema").otherwise(_broken(F.col("keyword")))
    broken = judged.select("id", "schema_id", F.col("path").alias("field"), message.alias("message")).where("message IS NOT NULL")
    first = broken.groupBy("id", "schema_id").agg(F.min(F.struct("field", "message")).alias("first"), F.count("*").alias("errors"))
    return first.select("id.*", "schema_id", "first.field", "first.message", "errors")


def _depth(v: Column) -> Column:
    """How deep brackets of a value are nested."""
    marks = F.regexp_replace(F.regexp_replace(F.to_json(v), r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.split(marks, ""), start, step, lambda s: s["most"])


def infer(lines: DataFrame, column: str = "value", tolerant: bool = False, all_items: bool = False) -> DataFrame:
    """(path, parent, key, types array<string>, n long, required boolean): the schema of all records, nested.

    Paths are JSON pointers, of the record '', with ~[] for the items of an array; types are sorted. A member is required
    if its parent never was anything but an object and always had it. Items are those of the first element, or of all if
    ``all_items``; those of an empty array count as a string. No rows where there are no records.
    """
    rows = parsed(lines, column, tolerant).select(F.col("__v").alias("v"))
    depth = rows.agg(F.max(_depth(F.col("v")))).first()[0] or 0
    none = F.lit(None).cast("string")
    rows = rows.select(F.lit("").alias("path"), none.alias("parent"), none.alias("key"), "v", F.lit(True).alias("open"))
    escaped = lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    made = lambda key, x: F.struct(F.concat(F.col("path"), F.lit("/"), F.when(key == ITEMS, key).otherwise(escaped(key))).alias("path"), F.col("path").alias("parent"), key.alias("key"), x.alias("v"), F.lit(True).alias("open"))
    for _ in range(depth):
        v = F.col("v")
        found = variants.items(v)
        some = F.when(F.size(found) == 0, F.array(F.lit("").cast("variant"))).otherwise(found if all_items else F.slice(found, 1, 1))
        below = F.when(F.col("open"), F.coalesce(F.transform(variants.entries(v), lambda e: made(e["key"], e["value"])), F.transform(some, lambda x: made(F.lit(ITEMS), x))))
        itself = F.array(F.struct("path", "parent", "key", "v", F.lit(False).alias("open")))
        rows = rows.select(F.explode(F.when(below.isNull(), itself).otherwise(F.concat(itself, below))).alias("m")).select("m.*")
    counts = rows.select("path", "parent", "key", _kind_of(F.col("v")).alias("type")).groupBy("path", "parent", "key", "type").agg(F.count("*").alias("n"))
    paths = counts.groupBy("path", "parent", "key").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("n").alias("n"))
    above = paths.select(F.col("path").alias("__path"), F.col("n").alias("__n"), (F.col("types") == F.array(F.lit("object"))).alias("__plain"))
    out = paths.join(above, F.col("parent") == F.col("__path"), "left")
    required = F.coalesce(F.col("__plain") & (F.col("n") == F.col("__n")) & (F.col("key") != ITEMS), F.lit(False))
    return out.select("path", "parent", "key", "types", "n", required.alias("required"))


def assemble(rows: list) -> dict:
    """The JSON schema that rows of ``infer`` stand for; {} for none. Items are told where a path is always an array."""
    below: dict[str, list] = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)

    def made(r) -> dict:
        types = list(r["types"])
        out: dict[str, Any] = {"type": types[0] if len(types) == 1 else types}
        if "object" in types:
            members = sorted((c for c in below.get(r["path"], []) if c["key"] != ITEMS), key=lambda c: c["key"])
            out |= {"properties": {c["key"]: made(c) for c in members}, "required": [c["key"] for c in members if c["required"]], "additionalProperties": True}
        if types == ["array"]:
            out["items"] = next((made(c) for c in below.get(r["path"], []) if c["key"] == ITEMS), {})
        return out

    return next((made(r) for r in rows if r["parent"] is None), {})
