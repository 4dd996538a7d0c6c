"""What-if simulation: a proposed change applied to records and to their contract, judged against both.

The records as they are, after the change, and adapted back are three structs of one row, so all checks of all three
are one aggregation over one scan.
"""

from __future__ import annotations

import re
from copy import deepcopy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import adapter, evolution
from tessera.operators.checks import evaluate
from tessera.plans.contract import Clause, Contract, FieldRule

STAGES = ("baseline", "raw", "adapted")
#: Keys of a rule that name fields.
_NAMES = ("field", "fields", "left", "right", "parts", "output", "map_field", "group_by", "nodes", "edges")


def _field(change: dict) -> str:
    return change.get("field", change.get("from", ""))


def _in_place(change: dict) -> object:
    """The value that replaced ones become; none if nothing is replaced."""
    values = [change["sample_new_value"]] if "sample_new_value" in change else change.get("added_values")
    return values[0] if change.get("replaces") and values else None


def mutates(change: dict) -> bool:
    """Whether a change is about the records too, and not about the contract alone."""
    kind = change["change_type"]
    if "apply_to_records" in change:
        return bool(change["apply_to_records"])
    if kind == "add_field":
        return "default_value" in change
    if kind == "enum_change":
        return _in_place(change) is not None
    return kind in ("field_rename", "numeric_scale_change", "type_change", "remove_field")


def mutate(df: DataFrame, change: dict) -> DataFrame:
    """The records after a hypothetical change; a target version is set where there is a ``schema_version``."""
    kind, field = change["change_type"], _field(change)
    if not mutates(change):
        return df
    if kind == "field_rename":
        df = adapter.rename(df, change["from"], change["to"])
    elif kind in ("numeric_scale_change", "range_change") and float(change.get("factor", 1)) != 1:
        df = adapter.scale(df, field, float(change["factor"]))
    elif kind == "type_change" and "to" in change:
        df = adapter.coerce(df, field, change["to"])
    elif kind == "add_field":
        df = adapter.default(df, field, change["default_value"])
    elif kind == "remove_field":
        df = adapter.remove(df, field)
    elif kind == "enum_change" and _in_place(change) is not None:
        df = adapter.enum_replace(df, field, change["replaces"], _in_place(change))
    version = change.get("target_version")
    return df.withColumn("schema_version", F.lit(version)) if version and "schema_version" in df.columns else df


def _renamed(rule: dict, names: dict[str, str]) -> dict:
    of = lambda x: names.get(x, x)
    out = {k: ([of(x) for x in v] if isinstance(v, list) else of(v)) if k in _NAMES else v for k, v in rule.items()}
    if isinstance(rule.get("when"), dict):
        out["when"] = rule["when"] | {"field": of(rule["when"].get("field", ""))}
    return out


def _changed_rule(rule: FieldRule | None, change: dict) -> FieldRule:
    out = deepcopy(rule) if rule else FieldRule()
    out.type = out.type or change.get("original")
    for key in ("type", "required", "minimum", "maximum", "enum"):
        if key in change.get("field_schema", {}):
            setattr(out, key, change["field_schema"][key])
    if change["change_type"] == "type_change" and "to" in change:
        out.type = change["to"]
    for key in ("required", "minimum", "maximum"):
        if key in change:
            setattr(out, key, change[key])
    if change["change_type"] == "enum_change":
        values = change.get("to_values", [*(out.enum or []), *change.get("added_values", [])])
        out.enum = [v for v in dict.fromkeys(values) if v not in change.get("removed_values", [])]
    return out


def hypothetical(contract: Contract, change: dict) -> Contract:
    """The contract after the change."""
    out, field = deepcopy(contract), _field(change)
    out.version = change.get("target_version", out.version)
    if change["change_type"] == "field_rename":
        if field in out.fields:
            out.fields[change["to"]] = out.fields.pop(field)
            out.clauses = [Clause(c.id, _renamed(c.rule, {field: change["to"]}), c.severity, c.description) for c in out.clauses]
    elif change["change_type"] == "remove_field":
        out.fields.pop(field, None)
        out.clauses = [c for c in out.clauses if c.rule.get("field") != field]
    else:
        out.fields[field] = _changed_rule(out.fields.get(field), change)
    return out


def inverse(change: dict, contract: Contract | None = None) -> list[dict]:
    """Adapter rules that undo a change, where one can. What a field was before is told by the contract."""
    kind, field = change["change_type"], _field(change)
    before = contract.fields.get(field) if contract else None
    if kind == "field_rename":
        return [{"type": "field_rename", "from": change["to"], "to": change["from"]}]
    if kind in ("numeric_scale_change", "range_change") and float(change.get("factor", 1)) not in (0, 1):
        return [{"type": "numeric_scaling", "field": field, "factor": 1 / float(change["factor"])}]
    if kind == "type_change" and (old := change.get("original", before and before.type)):
        return [{"type": "type_coercion", "field": field, "to": old}]
    if kind == "add_field":
        return [{"type": "remove_field", "field": field}]
    if kind == "remove_field" and "default_value" in change:
        return [{"type": "default_value", "field": field, "value": change["default_value"]}]
    if kind == "enum_change" and _in_place(change) is not None:
        return [{"type": "enum_replace", "field": field, "values": [_in_place(change)] if "sample_new_value" in change else change["added_values"], "value": change["replaces"][0]}]
    return []


def _staged(contract: Contract, stage: str) -> Contract:
    names = {n: f"{stage}.{n}" for n in {*contract.fields, *(x for c in contract.clauses for k in _NAMES if k in c.rule for x in (c.rule[k] if isinstance(c.rule[k], list) else [c.rule[k]]))}}
    names |= {c.rule["when"]["field"]: f"{stage}.{c.rule['when']['field']}" for c in contract.clauses if c.rule.get("when")}
    clauses = [Clause(f"{stage}.{c.id}", _renamed(c.rule, names), c.severity, c.description) for c in contract.clauses]
    return Contract(contract.id, fields={f"{stage}.{n}": r for n, r in contract.fields.items()}, clauses=clauses)


def verdict(passed: dict[str, Column], recovered: Column, compatibility: Column, changes: Column) -> Column:
    """What becomes of the change; ``recovered``: adapted records pass and the adapter had part in it."""
    breaking = compatibility == "breaking"
    return (
        F.when(~passed["baseline"], "BREAKING")
        .when(recovered & (breaking | ~passed["raw"]), "BREAKING_BUT_ADAPTABLE")
        .when(breaking, "BREAKING_REQUIRES_MIGRATION")
        .when(~passed["raw"], "BREAKING")
        .when(compatibility == "forward", "FORWARD_COMPATIBLE")
        .when(changes == 0, "COMPATIBLE")
        .otherwise("BACKWARD_COMPATIBLE")
    )


def recommendation(word: Column) -> Column:
    """What to do about a verdict."""
    return (
        F.when(word == "BREAKING_BUT_ADAPTABLE", "deploy with the adapter and refresh baselines")
        .when(word.endswith("COMPATIBLE"), "proceed and bump the version")
        .when(word == "BREAKING_REQUIRES_MIGRATION", "hold until a migration plan is approved")
        .otherwise("reject or revise")
    )


def _differ(raw: T.StructType, adapted: T.StructType) -> Column:
    """Whether a record's columns ``raw`` and ``adapted`` differ; fields that no rule touched cost nothing, as both are
    the same expression."""
    if set(raw.names) != set(adapted.names):
        return F.lit(True)
    out = F.lit(False)
    for f in raw.fields:
        a, b = F.col("raw")[f.name], F.col("adapted")[f.name]
        same = f.dataType == adapted[f.name].dataType
        out = out | ~(a.eqNullSafe(b) if same else a.cast("string").eqNullSafe(b.cast("string")))
    return out


def _simulated(df: DataFrame, contract: Contract, change: dict, rules: list[dict] | None) -> DataFrame:
    """One row: stages (array of stage, total, failed, overall_status), verdict, compatibility, attempted, applied.

    Whether the adapter rewrote a record is one more check of it, so all is one aggregation over one scan.
    """
    spark = df.sparkSession
    after = hypothetical(contract, change)
    renames = {change["from"]: change["to"]} if change["change_type"] == "field_rename" else None
    compared = evolution.verdict(evolution.classify(evolution.field_table(spark, contract), evolution.field_table(spark, after), renames))
    steps = [*(rules or []), *inverse(change, contract)]
    names = lambda d: [c for c in d.columns if c not in STAGES]
    d = df.select(F.struct("*").alias("baseline"), "*")
    d = mutate(d, change)
    d = d.withColumn("raw", F.struct(*names(d)))
    d = adapter.apply_rules(d, steps)
    d = d.select("baseline", "raw", F.struct(*names(d)).alias("adapted"))
    d = d.withColumn("rewritten", F.when(_differ(d.schema["raw"].dataType, d.schema["adapted"].dataType), "yes").otherwise("no"))
    staged = [_staged(contract, s) for s in STAGES]
    results = evaluate(d, Contract(contract.id, fields={n: r for c in staged for n, r in c.fields.items()} | {"rewritten": FieldRule(enum=["no"])}, clauses=[x for c in staged for x in c.clauses]))
    stage, bad = F.substring_index("check_id", ".", 1), F.col("status").isin("FAIL", "ERROR")
    counts = [F.count_if(x).alias(f"{s}_{n}") for s in STAGES for n, x in (("total", stage == s), ("failed", (stage == s) & bad))]
    one = results.agg(*counts, F.coalesce(F.max(F.when(stage == "rewritten", F.col("records_failing"))), F.lit(0)).cast("long").alias("applied"))
    one = one.join(compared.select(F.col("verdict").alias("compatibility"), "changes"))
    flags = {s: F.col(f"{s}_failed") == 0 for s in STAGES}
    attempted = F.lit(bool(rules)) | (F.col("compatibility") == "breaking") | ~flags["raw"]
    ready = (F.col("applied") > 0) | (F.lit(bool(steps)) & flags["raw"] & (F.col("compatibility") == "breaking"))
    one = one.withColumn("attempted", attempted)
    one = one.withColumn("verdict", verdict(flags, F.col("attempted") & flags["adapted"] & ready, F.col("compatibility"), F.col("changes")))
    stages = [F.struct(F.lit(s).alias("stage"), F.col(f"{s}_total").alias("total"), F.col(f"{s}_failed").alias("failed"), F.when(flags[s], "PASS").otherwise("FAIL").alias("overall_status")) for s in STAGES]
    return one.select(F.filter(F.array(*stages), lambda x: x["total"] > 0).alias("stages"), "verdict", "compatibility", "attempted", "applied")


def what_if(df: DataFrame, contract: Contract, change: dict, rules: list[dict] | None = None) -> DataFrame:
    """(stage, total, failed, overall_status, verdict, recommendation, attempted, applied), a row for each stage.

    The records and their changed and adapted forms are held against the contract as it is; the contract after the
    change is compared with it. An adapter is attempted if the change breaks either, with ``rules`` and those that undo
    the change; ``applied`` counts the records it rewrote. Where changed records pass by themselves, rules that are
    ready count as a recovery although they rewrote none.
    """
    one = _simulated(df, contract, change, rules)
    return one.select(F.inline("stages"), "verdict", recommendation(F.col("verdict")).alias("recommendation"), "attempted", "applied")


def _told(change: dict) -> str:
    """What a change does to records, in words."""
    kind, field = change["change_type"], _field(change)
    if not mutates(change) or kind == "type_change" and "to" not in change:
        return "Records stay as they are; the change is one of the contract alone."
    if kind == "field_rename":
        return f"Records have {field} as {change['to']}."
    if kind in ("numeric_scale_change", "range_change"):
        return f"{field} is multiplied by {float(change.get('factor', 1))}."
    if kind == "type_change":
        return f"{field} is turned into {change['to']}."
    if kind == "add_field":
        return f"{field} is set where it is missing."
    if kind == "remove_field":
        return f"{field} is taken away."
    return f"{', '.join(map(str, change['replaces']))} of {field} become {_in_place(change)}."


def notes(df: DataFrame, contract: Contract, change: dict, rules: list[dict] | None = None) -> DataFrame:
    """(place int, note string): what a simulation did and found, in order: the change of the records, the comparison of
    the contracts, what the adapter came to, if it was tried, and how many rules undo the change."""
    made = len(inverse(change, contract))
    one = _simulated(df, contract, change, rules)
    sound = F.exists("stages", lambda x: (x["stage"] == "adapted") & (x["failed"] == 0)) | ~F.exists("stages", lambda x: x["stage"] == "adapted")
    outcome = (
        F.when(F.col("attempted") & sound & (F.col("applied") > 0), "The adapter brings records back to the contract as it is.")
        .when(F.col("attempted") & (F.col("verdict") == "BREAKING_BUT_ADAPTABLE"), "Rules to go back are ready, though no record needed them.")
        .when(F.col("attempted"), "The adapter was tried and doesn't repair the records.")
    )
    said = [F.lit(_told(change)), F.concat(F.lit("The comparison of the contracts is "), F.col("compatibility"), F.lit(".")), outcome, F.lit(f"{made} rules undo the change.") if made else F.lit(None).cast("string")]
    listed = one.select(F.posexplode(F.array_compact(F.array(*said))).alias("place", "note"))
    return listed.select((F.col("place") + 1).alias("place"), "note")


# Fixed patterns of written changes: a range, a type, and a transform of x by a factor or divisor. The same in Python and in Java.
RANGE = r"(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)"
TYPE = r"(?i)\b(int|integer|float|number|string|boolean)\b"
TRANSFORM = r"(?i)x\s*->\s*x\s*([*/])\s*(-?\d+(?:\.\d+)?)"
TYPES = {"int": "integer", "float": "number"}


def descriptor(text: Column) -> Column:
    """A struct (type, minimum, maximum) of what a text such as ``float 0.0-1.0`` declares; null what it doesn't. Null
    and empty texts declare nothing."""
    part = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    kind = F.lower(part(TYPE, 1))
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[kind], kind)
    return F.struct(named.alias("type"), part(RANGE, 1).cast("double").alias("minimum"), part(RANGE, 2).cast("double").alias("maximum"))


def factor(transform: Column) -> Column:
    """By what a transform such as ``x -> x * 100`` or ``x -> x / 4`` multiplies; 1 for none and for a division by zero."""
    sign, number = F.regexp_extract(transform, TRANSFORM, 1), F.nullif(F.regexp_extract(transform, TRANSFORM, 2), F.lit("")).cast("double")
    return F.coalesce(F.when(sign == "*", number), F.when(number != 0, 1 / number), F.lit(1.0))


def _declared(text: object) -> dict:
    """``descriptor`` of one declaration, on the driver; a mapping stands for itself."""
    if isinstance(text, dict):
        return dict(text)
    out, kind, span = {}, re.search(TYPE, str(text or "")), re.search(RANGE, str(text or ""))
    if kind:
        word = kind[1].lower()
        out["type"] = TYPES.get(word, word)
    return out | ({"minimum": float(span[1]), "maximum": float(span[2])} if span else {})


def specified(spec: dict) -> dict:
    """The change that a written specification means, as the functions here take it.

    Names come as field, from_field, to_field, new_field or target_field; types and ranges in words, as ``from``, ``to`` and
    to_type; factors as numbers or as a sample_transform; enumerations as replace_values with the sample_new_value in their place,
    and enum_values. A type that ``from`` tells stands in where the contract has none. What is there in this form already
    stays; a change to no known type changes no type.
    """
    first = lambda *keys: next((spec[k] for k in keys if spec.get(k) not in (None, "")), None)
    out = dict(spec) | {"change_type": str(spec.get("change_type", "")).lower()}
    kind, field = out["change_type"], first("field", "from_field")
    if kind == "field_rename":
        return out | {"from": first("from_field", "field", "from"), "to": first("to_field", "new_field", "target_field", "to")}
    out["field"] = field or ""
    if "factor" not in out and (found := re.search(TRANSFORM, str(spec.get("sample_transform", "")))):
        number = float(found[2])
        out["factor"] = number if found[1] == "*" else 1 / number if number else 1.0
    before, after = _declared(spec.get("from")), _declared(spec.get("to"))
    if "type" in before:
        out["original"] = before["type"]
    if kind == "type_change":
        to = _declared(first("to_type", "to")).get("type") or first("target_type")
        out.pop("to", None)
        out |= {"to": to} if to else {}
    if spec.get("target_type"):
        after["type"] = spec["target_type"]
    if after and "field_schema" not in out:
        out["field_schema"] = after
    for name, others in (("default_value", ("default_value", "value", "field_value")), ("replaces", ("replaces", "replace_values")), ("to_values", ("to_values", "enum_values"))):
        if any(k in spec for k in others):
            out[name] = next(spec[k] for k in others if k in spec)
    return out


def enriched(direct: DataFrame, entries: DataFrame) -> DataFrame:
    """(subscriber_id, fields, kind, source, relationship, contamination_depth int, via, is_direct): the affected subscribers
    with how far along the lineage they are, and all others that lineage reaches.

    ``direct``: of ``affected``; ``entries``: (id, kind, source, relationship, hops, via array), the nodes downstream of the
    contract. A depth is the hops less one, no less than 0; of several entries a subscriber has the farthest, and 0 without any.
    Other nodes keep a row for each entry. Entries without id are left out. One shuffle by id, after one row for each subscriber's.
    """
    e = entries.where("id IS NOT NULL")
    depth = F.greatest(F.col("hops") - 1, F.lit(0)).cast("int")
    row = F.struct("kind", "source", "relationship", depth.alias("contamination_depth"), "via")
    far = e.groupBy("id").agg(F.max_by(row, F.struct("hops", "source", "kind")).alias("e"))
    met = direct.join(far, direct["subscriber_id"] == far["id"], "left").select("subscriber_id", "fields", "e.kind", "e.source", "e.relationship", F.coalesce("e.contamination_depth", F.lit(0)).alias("contamination_depth"), "e.via", F.lit(True).alias("is_direct"))
    others = e.join(direct.select(F.col("subscriber_id").alias("id")).distinct(), "id", "left_anti").select("id", row.alias("e"))
    return met.unionByName(others.select(F.col("id").alias("subscriber_id"), F.lit(None).cast("string").alias("fields"), "e.*", F.lit(False).alias("is_direct")))


def affected(subscriptions: DataFrame, changes: DataFrame) -> DataFrame:
    """(subscriber_id, fields): subscribers with a field that meets a changed one, and which of theirs it is.

    ``subscriptions``: (subscriber_id, field, is_breaking); where fields declared breaking are met, the others that are
    merely read are not listed. Both tables are metadata, a row for each declaration and change.
    """
    changed = changes.where("change_type <> 'NO_CHANGE'").select("field_name")
    met = evolution.meeting(subscriptions, changed, path="field_name").select("subscriber_id", "field", "is_breaking").distinct()
    listed = met.groupBy("subscriber_id").agg(F.array_sort(F.collect_set(F.when(F.col("is_breaking"), F.col("field")))).alias("b"), F.array_sort(F.collect_set("field")).alias("f"))
    return listed.select("subscriber_id", F.concat_ws("|", F.when(F.size("b") > 0, F.col("b")).otherwise(F.col("f"))).alias("fields"))
