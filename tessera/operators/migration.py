"""Adapters by pairs of versions: each record goes from its own schema version to the target, in one plan.

Rules belong to a step (from, to). Steps form a graph, and a version takes its shortest chain of steps to the target. The
chains make a tree, so each step is applied once, farthest first, to the records whose chain it is in: a conditional
rewrite of columns in a single pass, without shuffles and without splitting the table by version. A record keeps what was
done to it; outcomes and logs are aggregations over that.

All records share typed columns, so an absent value is a null; a coerced value stays in its column's type (a number read
from text is its canonical text), and one that can't be coerced stays as it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import three_part_version

# The steps that come with each contract.
BUILT_IN = {
    "week3-document-refinery-extractions": [
        {"source_version": "2.0.0", "target_version": "1.0.0", "type": "numeric_scaling", "field": "extracted_facts.confidence", "factor": 0.01, "above": 1.0, "description": "Convert percentage confidence back to a 0.0-1.0 scale."},
    ],
    "week5-event-records": [
        {"source_version": "0.9.0", "target_version": "1.0.0", "type": "field_rename", "from": "event_name", "to": "event_type", "description": "Map legacy event_name to event_type."},
        {"source_version": "0.9.0", "target_version": "1.0.0", "type": "default_value", "field": "schema_version", "value": "1.0", "description": "Inject the default event schema version for legacy events."},
    ],
    "langsmith-trace-records": [
        {"source_version": "0.9.0", "target_version": "1.0.0", "type": "default_value", "field": "tags", "value": [], "description": "Populate empty tags for older trace payloads that omitted them."},
    ],
}
_OPERATION = "struct<rule_type:string,description:string,changed_values:int>"
_IGNORED = ("description", "source_version", "target_version", "above")


def normal_version(value: object) -> str:
    """A version of three segments; 1.0.0 for none."""
    parts = str(value if value is not None else "").strip().split(".")
    return ".".join([*parts, "0", "0"][:3]) if parts != [""] else "1.0.0"


def rules_for(contract_id: str, extra: Sequence[dict] = ()) -> list[dict]:
    """The contract's built-in rules and further ones; one that repeats another of its step is left out."""
    out, seen = [], set()
    for rule in [*BUILT_IN.get(contract_id, []), *extra]:
        step = (normal_version(rule["source_version"]), normal_version(rule["target_version"]))
        sign = (step, json.dumps({k: v for k, v in rule.items() if k not in _IGNORED}, sort_keys=True, default=str))
        if sign not in seen:
            seen.add(sign)
            out.append({**rule, "source_version": step[0], "target_version": step[1]})
    return out


def chains(rules: Sequence[dict], target: str) -> dict[str, list[tuple[str, str]]]:
    """The shortest chain of steps to the target for each version that has one; of several, the least next version.

    The target's own chain is its step to itself, where there are rules of such a step.
    """
    target, steps = normal_version(target), sorted({(normal_version(r["source_version"]), normal_version(r["target_version"])) for r in rules})
    out: dict[str, list[tuple[str, str]]] = {target: []}
    edge = [target]
    while edge:
        found = {}
        for to in sorted(edge):
            for a, b in steps:
                if b == to and a not in out and a not in found:
                    found[a] = [(a, b), *out[b]]
        out |= found
        edge = list(found)
    out[target] = [(target, target)] if (target, target) in steps else []
    return out


def _literal(value: object, kind: T.DataType | None = None) -> Column:
    if isinstance(value, (list, dict)):
        text = json.dumps(value)
        if kind is None:
            kind = T.ArrayType(T.StringType()) if value == [] else T.StructType() if value == {} else None
        return F.from_json(F.lit(text), kind) if kind is not None else F.from_json(F.lit(text), F.schema_of_json(F.lit(text)))
    return F.lit(value) if kind is None else F.lit(value).cast(kind)


def _slots(col: Column, kind: T.DataType, parts: list[str], f: Callable[[Column, T.DataType], Column], within: bool) -> Column:
    if isinstance(kind, T.ArrayType) and (parts or within):
        inside = F.transform(col, lambda x: _slots(x, kind.elementType, parts, f, within))
        return F.coalesce(F.aggregate(inside, F.lit(0), lambda n, x: n + x), F.lit(0))
    if not parts:
        return F.coalesce(f(col, kind).cast("int"), F.lit(0))
    if isinstance(kind, T.StructType) and parts[0] in kind.names:
        return _slots(col[parts[0]], kind[parts[0]].dataType, parts[1:], f, within)
    return F.lit(0)


def _having(df: DataFrame, path: str, f: Callable[[Column, T.DataType], Column], within: bool = False) -> Column:
    """For how many values of a path f(value, type) holds. An array at its end is one value, or ``within`` its elements are."""
    head, *rest = path.split(".")
    return _slots(F.col(f"`{head}`"), df.schema[head].dataType, rest, f, within) if head in df.columns else F.lit(0)


def _rewrite(col: Column, kind: T.DataType, parts: list[str], f: Callable[[Column, T.DataType], Column], within: bool) -> Column:
    if isinstance(kind, T.ArrayType) and (parts or within):
        return F.transform(col, lambda x: _rewrite(x, kind.elementType, parts, f, within))
    if not parts:
        return f(col, kind)
    if isinstance(kind, T.StructType) and parts[0] in kind.names:
        return F.when(col.isNotNull(), col.withField(parts[0], _rewrite(col[parts[0]], kind[parts[0]].dataType, parts[1:], f, within)))
    return col


def _mapped(df: DataFrame, path: str, f: Callable[[Column, T.DataType], Column], within: bool = False) -> DataFrame:
    head, *rest = path.split(".")
    return df.withColumn(head, _rewrite(F.col(f"`{head}`"), df.schema[head].dataType, rest, f, within)) if head in df.columns else df


def _kind_of(df: DataFrame, path: str) -> T.DataType | None:
    """The type of a path's values; null where there is no such path."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def _per_value(df: DataFrame, path: str, on: Column, changes: Callable, new: Callable) -> tuple[DataFrame, Column]:
    """Values of a path for which ``changes`` holds, in records where ``on`` holds, replaced by ``new``."""
    n = F.when(on, _having(df, path, changes)).otherwise(0)
    return _mapped(df, path, lambda c, k: F.when(on & F.coalesce(changes(c, k), F.lit(False)), new(c, k)).otherwise(c)), n


def _rename(df: DataFrame, rule: dict, on: Column) -> tuple[DataFrame, Column]:
    """Within one parent, where the source has a value and the target none."""
    (parent, _, a), (other, _, b) = rule["from"].rpartition("."), rule["to"].rpartition(".")
    kind = _kind_of(df, rule["from"])
    if parent != other or kind is None or a == b:
        return df, F.lit(0)
    if not parent:
        x, y = F.col(f"`{a}`"), F.col(f"`{b}`") if b in df.columns else F.lit(None).cast(kind)
        moves = on & x.isNotNull() & y.isNull()
        return df.withColumns({b: F.when(moves, x).otherwise(y), a: F.when(~moves, x)}), moves.cast("int")
    moving = lambda c, k: c[a].isNotNull() & (c[b].isNull() if b in k.names else F.lit(True))
    old = lambda c, k: c[b] if b in k.names else F.lit(None).cast(k[a].dataType)
    n = F.when(on, _having(df, parent, lambda c, k: moving(c, k) if isinstance(k, T.StructType) else F.lit(False), within=True)).otherwise(0)
    move = lambda c, k: c.withField(b, F.when(on & moving(c, k), c[a]).otherwise(old(c, k))).withField(a, F.when(~(on & moving(c, k)), c[a]))
    return _mapped(df, parent, lambda c, k: F.when(c.isNotNull(), move(c, k)) if isinstance(k, T.StructType) else c, within=True), n


def _fill(col: Column, kind: T.DataType, parts: list[str], value: object, on: Column, always: bool) -> Column:
    """``col`` with the value set at a path of structs, which are made where they are null."""
    if not parts:
        new = _literal(value, kind)
        return F.when(on if always else on & col.isNull(), new).otherwise(col)
    if not isinstance(kind, T.StructType):
        return col
    whole = F.when(on & col.isNull(), F.from_json(F.lit("{}"), kind)).otherwise(col)
    if parts[0] not in kind.names:
        if len(parts) > 1:
            return col
        return F.when(whole.isNotNull(), whole.withField(parts[0], F.when(on, _literal(value))))
    return F.when(whole.isNotNull(), whole.withField(parts[0], _fill(whole[parts[0]], kind[parts[0]].dataType, parts[1:], value, on, always)))


def _set(df: DataFrame, path: str, value: object, on: Column, always: bool) -> tuple[DataFrame, Column]:
    """A default for nulls, or any value replaced; nothing on a path through arrays, or with two parts that don't exist."""
    head, *rest = path.split(".")
    if head not in df.columns:
        return (df.withColumn(head, F.when(on, _literal(value))), on.cast("int")) if not rest else (df, F.lit(0))
    top = at = F.col(f"`{head}`")
    kind = whole = df.schema[head].dataType
    for i, part in enumerate(rest):
        if not isinstance(kind, T.StructType) or part not in kind.names and i < len(rest) - 1:
            return df, F.lit(0)
        if part not in kind.names:
            return df.withColumn(head, _fill(top, whole, rest, value, on, always)), on.cast("int")
        at, kind = at[part], kind[part].dataType
    changes = ~at.eqNullSafe(_literal(value, kind)) if always else at.isNull()
    return df.withColumn(head, _fill(top, whole, rest, value, on, always)), F.when(on & changes, 1).otherwise(0)


def _coerced(to: str) -> tuple[Callable, Callable]:
    """(whether a value changes, the new value in the type of its column)."""
    def new(c: Column, k: T.DataType) -> Column:
        text = isinstance(k, T.StringType)
        if to in ("int", "integer"):
            x = c.try_cast("double")
            whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
            return whole.cast("string") if text else whole.cast(k)
        if to in ("float", "number"):
            return c.try_cast("double").cast("string") if text else c
        if to == "boolean":
            return F.lower(F.trim(c)).isin("true", "1", "yes").cast("string") if text else (c != 0).cast("int").cast(k) if isinstance(k, T.NumericType) else c
        return c

    return (lambda c, k: new(c, k) != c if isinstance(k, (T.StringType, T.NumericType)) else F.lit(False)), new


def _apply(df: DataFrame, rule: dict, on: Column) -> tuple[DataFrame, Column]:
    """The rule applied to records where ``on`` holds, and how many of its values changed in a record."""
    kind, path = rule["type"], rule.get("field", "")
    if kind in ("field_rename", "alias"):
        return _rename(df, rule, on)
    if kind == "numeric_scaling":
        factor, above = float(rule["factor"]), rule.get("above")
        fits = lambda c, k: F.lit(isinstance(k, T.NumericType)) & c.isNotNull() & (F.lit(True) if above is None else c > float(above))
        if not isinstance(_kind_of(df, path), T.NumericType):
            return df, F.lit(0)
        wide = _mapped(df, path, lambda c, k: c.cast("double") if isinstance(k, T.NumericType) else c)
        return _per_value(wide, path, on, fits, lambda c, k: F.round(c * factor, 6) if isinstance(k, T.NumericType) else c)
    if kind == "default_value":
        return _set(df, path, rule["value"], on, False)
    if kind == "optional_field":
        return df, F.when(on & (_having(df, path, lambda c, _: c.isNotNull()) == 0), 1).otherwise(0)
    if kind == "set_value":
        return _set(df, path, rule["value"], on, True)
    if kind == "remove_field":
        return _per_value(df, path, on, lambda c, _: c.isNotNull(), lambda c, k: F.lit(None).cast(k))
    if kind == "type_coercion":
        to = str(rule.get("target_type", rule.get("to", ""))).lower()
        if to == "string":
            known = isinstance(_kind_of(df, path), T.StringType)
            n = F.lit(0) if known else F.when(on, _having(df, path, lambda c, _: c.isNotNull())).otherwise(0)
            return _mapped(df, path, lambda c, k: c.cast("string") if isinstance(k, T.AtomicType) else c), n
        return _per_value(df, path, on, *_coerced(to))
    if kind == "enum_replace":
        old = [str(x) for x in rule.get("replace_values", rule.get("values", []))]
        if not old or not {"new_value", "value"} & set(rule):
            return df, F.lit(0)
        return _per_value(df, path, on, lambda c, _: c.cast("string").isin(old), lambda _, k: _literal(rule.get("new_value", rule.get("value")), k))
    if kind == "version_normalize":
        most = max(int(rule.get("segments") or 2), 1)
        parts = lambda c: F.filter(F.split(F.trim(c.cast("string")), r"\."), lambda x: x != "")
        return _per_value(df, path, on, lambda c, _: F.size(parts(c)) > most, lambda c, k: F.array_join(F.slice(parts(c), 1, most), ".").cast(k))
    return df, F.lit(0)


def _stated(df: DataFrame, version: str) -> Column:
    """The version that a record declares, if it does."""
    text = F.trim(F.col(f"`{version}`").cast("string")) if version in df.columns else F.lit(None).cast("string")
    return F.when(text == "", "1.0.0").when(text.isNotNull(), three_part_version(text))


def adapt(df: DataFrame, rules: Sequence[dict], target: str, version: str = "schema_version", heuristics: Sequence[tuple[str, str, str]] = (), into: str = "adaptation") -> DataFrame:
    """``df`` with its records at the target version, and a column ``into``: struct (source_version, target_version,
    detection_method, attempted, available, operations), operations being those rules that changed a value, in order.

    A record's version is the one that it declares; else that of the first of ``heuristics`` (name, SQL condition, version)
    that holds; else the target. Without a chain from its version it stays as it is. Nulls change nothing but where a
    default asks for it; repeated records are adapted alike, and an empty table gives the same columns. A column
    that is called ``into`` already is an error.
    """
    if into in df.columns:
        raise ValueError(f"column {into} is taken")
    goal, of = normal_version(target), chains(rules, target)
    stated = _stated(df, version)
    guess, how = F.lit(goal), F.lit("default_expected_version")
    for name, condition, at in reversed(heuristics):
        holds = F.coalesce(F.expr(condition), F.lit(False))
        guess, how = F.when(holds, normal_version(at)).otherwise(guess), F.when(holds, f"heuristic_{name}").otherwise(how)
    own, columns = f"__{into}_version", list(df.columns)
    df = df.withColumns({own: F.coalesce(stated, guess), f"__{into}_how": F.when(stated.isNotNull(), "payload_schema_version").otherwise(how)})
    done, helpers = [], [own, f"__{into}_how"]
    steps = {step: len(chain) - i for chain in of.values() for i, step in enumerate(chain)}
    for step in sorted(steps, key=lambda s: (-steps[s], s)):
        users = [v for v, chain in of.items() if step in chain]
        for rule in rules:
            if (normal_version(rule["source_version"]), normal_version(rule["target_version"])) != step:
                continue
            name = f"__{into}_{len(done)}"
            on = F.col(own).isin(users)
            # Counted on the columns as they are before the rule.
            df = df.withColumn(name, _apply(df, rule, on)[1])
            df = _apply(df, rule, on)[0]
            done.append((name, rule))
    made = [F.when(F.col(name) > 0, F.struct(F.lit(r["type"]).alias("rule_type"), F.lit(r.get("description", "")).alias("description"), F.col(name).cast("int").alias("changed_values"))) for name, r in done]
    log = F.array_compact(F.array(*made)) if made else F.array().cast(f"array<{_OPERATION}>")
    available = F.col(own).isin([v for v, chain in of.items() if chain])
    state = F.struct(F.col(own).alias("source_version"), F.lit(goal).alias("target_version"), F.col(helpers[1]).alias("detection_method"), (F.col(own) != goal).alias("attempted"), available.alias("available"), log.cast(f"array<{_OPERATION}>").alias("operations"))
    keep = [*columns, *[c for c in df.columns if c not in columns and c not in helpers and c not in {d[0] for d in done}]]
    return df.withColumn(into, state).select(*[f"`{c}`" for c in keep], into)


def outcomes(adapted: DataFrame, column: str = "adaptation") -> DataFrame:
    """(source_version, target_version, detection_method, records, changed, attempted, applied, succeeded, fallback_succeeded,
    failure_reason) for each version that records came from; one aggregation."""
    a = adapted.select(f"{column}.*")
    some = F.size("operations") > 0
    g = a.groupBy("source_version", "target_version", "detection_method").agg(F.count("*").alias("records"), F.count_if(some).alias("changed"), F.any_value("attempted").alias("attempted"), F.any_value("available").alias("available"))
    lost = F.col("attempted") & ~F.col("available")
    why = F.when(lost, F.concat(F.lit("no adapter rules available for "), F.col("source_version"), F.lit(" -> "), F.col("target_version"))).otherwise("")
    return g.select("source_version", "target_version", "detection_method", "records", "changed", "attempted", (F.col("changed") > 0).alias("applied"), (~lost).alias("succeeded"), (F.col("changed") > 0).alias("fallback_succeeded"), why.alias("failure_reason"))


def rule_log(adapted: DataFrame, column: str = "adaptation") -> DataFrame:
    """(source_version, rule_type, description, records, changed_values): what each rule did, by version."""
    ops = adapted.select(f"{column}.source_version", F.explode(f"{column}.operations").alias("o"))
    return ops.groupBy("source_version", "o.rule_type", "o.description").agg(F.count("*").alias("records"), F.sum("o.changed_values").alias("changed_values"))


def majority_version(df: DataFrame, target: str, version: str = "schema_version", heuristics: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """(detected_schema_version, original_schema_version, detection_method) of a whole table, one row: the version that most
    records declare (the least of several); if none declares one, what the heuristics say of any record; else the target."""
    stated = _stated(df, version)
    hits = [F.max(F.when(F.coalesce(F.expr(c), F.lit(False)), 1).otherwise(0)).alias(f"h{i}") for i, (_, c, _) in enumerate(heuristics)]
    # By version, so that what comes together is one row for each version.
    per = df.groupBy(stated.alias("v")).agg(F.count("*").alias("n"), *hits)
    best = F.min_by("v", F.when(F.col("v").isNotNull(), F.struct(-F.col("n"), F.col("v"))))
    one = per.agg(best.alias("v"), *[F.max(f"h{i}").alias(f"h{i}") for i in range(len(heuristics))])
    found, how = F.lit(normal_version(target)), F.lit("default_expected_version")
    for i, (name, _, at) in reversed(list(enumerate(heuristics))):
        found, how = F.when(F.col(f"h{i}") == 1, normal_version(at)).otherwise(found), F.when(F.col(f"h{i}") == 1, f"heuristic_{name}").otherwise(how)
    return one.select(F.coalesce("v", found).alias("detected_schema_version"), F.coalesce("v", F.lit("unknown")).alias("original_schema_version"), F.when(F.col("v").isNotNull(), "payload_schema_version").otherwise(how).alias("detection_method"))
