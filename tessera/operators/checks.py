"""Field checks and clauses compiled into one aggregation.

Every check on single records becomes a count of failing values; all counts of a dataset are taken in one pass over
it, as partial aggregates that leave one row for each task. A field without an array on its way is a plain conditional
count; array elements are tested inside their record, so nothing is exploded. Checks on groups and against other
tables are joined on as their own small results.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import paths
from tessera.functions.text import has_format, instant, matches
from tessera.plans.contract import SEVERITY, Clause, Contract, FieldRule

RESULT = "check_id string, check_type string, column_name string, status string, severity string, expected string, actual_value string, records_failing bigint, message string"


@dataclass
class Check:
    """``failing``: an aggregate that counts what fails; ``rows``: whether one record holds a failing value."""

    id: str
    kind: str
    column: str
    severity: str
    expected: str
    failing: Column
    actual: Column
    status: str = "FAIL"
    rows: Column | None = None


def _total(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("long")), F.lit(0).cast("long"))


def _is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def _number(x: Column, kind: T.DataType) -> Column:
    return x.cast("int").cast("double") if isinstance(kind, T.BooleanType) else x.cast("double")


def _fails(name: str, arg: object, kind: T.DataType) -> Callable[[Column], Column]:
    """The test of one non-null value: text rules fail on what is no text, enums compare by value."""
    if name == "format":
        return (lambda x: ~has_format(x, arg)) if _is_text(kind) else (lambda x: F.lit(True))
    if name == "pattern":
        return (lambda x: ~matches(x, str(arg))) if _is_text(kind) else (lambda x: F.lit(True))
    allowed = [a for a in arg if isinstance(a, str) == _is_text(kind)]
    if _is_text(kind):
        return lambda x: ~x.isin(allowed)
    return lambda x: ~_number(x, kind).isin([float(a) for a in allowed])


def _numbers(v: paths.Values) -> paths.Values:
    return v.map(lambda x: _number(x, v.kind), T.DoubleType())


def _outside(v: paths.Values, low: float | None, high: float | None, count: Callable) -> Column:
    """How many numbers break either bound: ``count`` is of a record or of all."""
    out = F.lit(0) if low is None else count(lambda x: x < low)
    return out + (F.lit(0) if high is None else count(lambda x: x > high))


def _extremes(least: Column, greatest: Column) -> Column:
    return F.to_json(F.struct(F.min(least).alias("min"), F.max(greatest).alias("max")))


def field_checks(schema: T.StructType, name: str, rule: FieldRule) -> list[Check]:
    """Checks of one field. A typed table can't tell an absent value from a null, so both count as missing.

    The actual value of a failed text rule is the least of the values that fail, as rows have no order.
    """
    n = F.count(F.lit(1))
    v = paths.found(schema, name)
    make = lambda kind, expected, failing, actual, status="FAIL", rows=None: Check(f"{name}.{kind}", kind, name, SEVERITY[kind], str(expected), failing, actual, status, rows)
    text_rules = {k: getattr(rule, k) for k in ("enum", "format", "pattern") if getattr(rule, k) is not None}
    bounded = rule.minimum is not None or rule.maximum is not None
    if v is None:
        out = [make("required", True, n, F.lit("missing column"))] if rule.required else []
        return out + [make(k, "present", n, F.lit("missing column"), "ERROR") for k in [*text_rules, *(["range"] if bounded else [])]]
    seen, out = v.total(), []
    if rule.required:
        missing = F.greatest(F.lit(0).cast("long"), n - seen)
        out.append(make("required", True, missing, F.concat(missing.cast("string"), F.lit(" missing")), rows=v.count() == 0))
    if rule.type:
        observed = paths.contract_type(v.kind)
        fine = observed == rule.type or (rule.type, observed) == ("number", "integer")
        out.append(make("type", rule.type, F.lit(0).cast("long") if fine else seen, F.lit(observed)))
    for k, arg in text_rules.items():
        bad = _fails(k, arg, v.kind)
        out.append(make(k, arg, v.total(bad), F.coalesce(F.min(v.first(bad).cast("string")), F.lit("all conforming")), rows=v.test(bad)))
    if bounded:  # texts have no numbers, so none is out of range
        expected = {"minimum": rule.minimum, "maximum": rule.maximum}
        if _is_number(v.kind):
            x = _numbers(v)
            out.append(make("range", expected, _outside(x, rule.minimum, rule.maximum, x.total), _extremes(x.least(), x.greatest()), rows=_outside(x, rule.minimum, rule.maximum, x.count) > 0))
        else:
            out.append(make("range", expected, F.lit(0).cast("long"), F.lit('{"min": null, "max": null}'), rows=F.lit(False)))
    return out


def condition(schema: T.StructType, when: dict | None) -> Column:
    """Whether any value of a field equals what is asked for; without a condition, true."""
    if not when:
        return F.lit(True)
    v = paths.found(schema, when.get("field", ""))
    wanted = [when["equals"]] if "equals" in when else when.get("in")
    if v is None or wanted is None:
        return F.lit(False)
    return v.test(lambda x: x.cast("string").isin([str(w) for w in wanted]))


_ORDER = {"<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}


def _as_time(schema: T.StructType, path: str) -> Column:
    v = paths.found(schema, path)
    if v is None:
        return F.lit(None).cast("timestamp")
    first = v.of if v.flat else F.get(v.of, F.lit(0))
    return first.cast("timestamp") if isinstance(v.kind, (T.DateType, T.TimestampType)) else instant(first.cast("string"))


def clause_check(schema: T.StructType, clause: Clause) -> Check:
    """A clause on single records. A path that the schema lacks has no values: it passes unless the rule demands one."""
    r, kind = clause.rule, clause.rule["type"]
    name = r.get("field") or ",".join(r.get("fields", [])) or r.get("left") or ""
    make = lambda failing, actual=None, rows=None: Check(clause.id, kind, name, clause.level, str({k: v for k, v in r.items() if k != "type"}), failing, F.lit("") if actual is None else actual, rows=rows)
    zero = F.lit(0).cast("long")
    by_record = lambda bad: make(_total(F.coalesce(bad, F.lit(True)).cast("int")), rows=F.coalesce(bad, F.lit(True)))

    if kind in ("field_format", "field_pattern", "field_enum", "conditional_pattern"):
        v, when = paths.found(schema, r["field"]), condition(schema, r.get("when"))
        rule, arg = {"field_format": ("format", r.get("format")), "field_enum": ("enum", r.get("allowed"))}.get(kind, ("pattern", r.get("pattern")))
        if v is None:
            return make(_total(when.cast("int"))) if kind == "conditional_pattern" else make(zero)
        bad = _fails(rule, arg, v.kind)
        if kind == "conditional_pattern":
            each = F.when(when, F.greatest(v.count(bad), (v.count() == 0).cast("int"))).otherwise(0)
            return make(_total(each), rows=each > 0)
        return make(v.total(bad), rows=v.test(bad))
    if kind in ("numeric_range", "conditional_numeric_range", "multi_field_numeric_range"):
        each, when = F.lit(0), condition(schema, r.get("when"))
        actual = None
        for field in r.get("fields") or [r["field"]]:
            v = paths.found(schema, field)
            if v is None:
                each = each + (1 if kind == "conditional_numeric_range" else 0)
                continue
            if _is_number(v.kind):
                x = _numbers(v)
                each = each + _outside(x, r.get("minimum"), r.get("maximum"), x.count)
                if kind != "multi_field_numeric_range":
                    actual = _extremes(F.when(when, x.least()), F.when(when, x.greatest()))
            else:
                each = each + v.count()
            if kind == "conditional_numeric_range":
                each = each + (v.count() == 0).cast("int")
        each = F.when(when, each).otherwise(0)
        return make(_total(each), actual, each > 0)
    if kind == "array_min_items":
        found = paths.raw(schema, r["field"])
        size = F.size(found[0]) if found and isinstance(found[1], T.ArrayType) else F.lit(-1)
        return by_record(F.coalesce(size, F.lit(-1)) < r.get("minimum", 1))
    if kind == "string_length":
        v = paths.found(schema, r["field"])
        if v is None:
            return make(zero)
        bad = (lambda x: F.char_length(x) < r.get("minimum", 1)) if _is_text(v.kind) else (lambda x: F.lit(True))
        return make(v.total(bad), rows=v.test(bad))
    if kind == "temporal_order":
        fine = _ORDER.get(r.get("operator", "<="), lambda a, b: a <= b)
        return by_record(~fine(_as_time(schema, r["left"]), _as_time(schema, r["right"])))
    if kind == "sum_equals":
        parts = [paths.first_scalar(schema, p).cast("double") for p in r["parts"]]
        whole = paths.first_scalar(schema, r["output"]).cast("double")
        return by_record(~(F.abs(sum(parts[1:], parts[0]) - whole) <= r.get("tolerance", 0)))
    if kind == "weighted_mean_equals":
        m = paths.raw(schema, r["map_field"])
        if m is None:
            return by_record(F.lit(True))
        score, weight = r.get("score_key", "score"), r.get("weight_key", "weight")
        entry = m[1].valueType if isinstance(m[1], T.MapType) else m[1].elementType
        items = F.map_values(m[0]) if isinstance(m[1], T.MapType) else m[0]
        w = lambda x: F.when(x[weight].cast("double") > 0, x[weight].cast("double")).otherwise(1.0) if weight in entry.names else F.lit(1.0)
        add = lambda f: F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))
        mean = add(lambda x: x[score].cast("double") * w(x)) / F.nullif(add(w), F.lit(0.0))
        return by_record(~(F.abs(mean - paths.first_scalar(schema, r["output"]).cast("double")) <= r.get("tolerance", 0)))
    if kind == "edge_endpoints_exist":
        ids = F.transform(F.col(r.get("nodes", "nodes")), lambda x: x[r.get("node_key", "node_id")])
        edges = F.col(r.get("edges", "edges"))
        ends = F.flatten(F.transform(F.filter(edges, lambda e: e.isNotNull()), lambda e: F.array(e["source"], e["target"])))
        each = F.size(F.filter(edges, lambda e: e.isNull())) + paths.absent(ends, F.filter(ids, lambda x: x.isNotNull()))
        return make(_total(F.coalesce(each, F.lit(0))), rows=each > 0)
    raise ValueError(f"unknown rule type: {kind}")


ON_RECORDS = (
    "field_format", "field_pattern", "field_enum", "conditional_pattern", "numeric_range", "conditional_numeric_range", "multi_field_numeric_range", "array_min_items", "string_length",
    "temporal_order", "sum_equals", "weighted_mean_equals", "edge_endpoints_exist",
)
ON_GROUPS = ("group_monotonic",)
ON_FILES = ("repo_path_exists",)


def compile_checks(schema: T.StructType, contract: Contract) -> list[Check]:
    """All checks of single records: fields in order of name, then clauses. Rules of no known type give no check, only
    a warning; a rule of a known type that is ill-formed raises its error."""
    out = [c for name in sorted(contract.fields) for c in field_checks(schema, name, contract.fields[name])]
    for clause in contract.clauses:
        kind = clause.rule.get("type")
        if kind in ON_RECORDS:
            out.append(clause_check(schema, clause))
        elif kind not in ON_GROUPS + ON_FILES:
            warnings.warn(f"{clause.id}: no check for a rule of type {kind}", stacklevel=2)
    return out


def broken_sequences(df: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Groups whose non-null numbers aren't exactly 1 to n. Counts only are kept of a group, whatever its size."""
    number = F.col(field).cast("long")
    g = df.groupBy(*keys).agg(F.count(number).alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.count_distinct(number).alias("kinds"))
    return g.where((F.col("n") > 0) & ~((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("kinds") == F.col("n"))))


def missing_references(df: DataFrame, column: str, reference: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null value no row of the reference has."""
    known = reference.select(F.col(key).alias("__known")).distinct()
    return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__known"), "left_anti")


def _result(check_id: str, kind: str, column: str, severity: str, expected: str, counted: DataFrame) -> DataFrame:
    n = counted.agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") > 0, "FAIL").otherwise("PASS")
    return n.select(F.lit(check_id).alias("check_id"), F.lit(kind).alias("check_type"), F.lit(column).alias("column_name"), status.alias("status"), F.lit(severity).alias("severity"), F.lit(expected).alias("expected"), F.col("n").cast("string").alias("actual_value"), F.col("n").cast("long").alias("records_failing"), F.concat(F.lit(f"{check_id}: "), F.col("n").cast("string"), F.lit(" failing")).alias("message"))


def evaluate(df: DataFrame, contract: Contract, files: DataFrame | None = None) -> DataFrame:
    """One row for each check of the contract (RESULT). ``files`` (path) is what repo_path_exists looks up."""
    checks = compile_checks(df.schema, contract)
    parts = []
    if checks:
        agg = df.agg(*[c.failing.alias(f"f{i}") for i, c in enumerate(checks)], *[c.actual.cast("string").alias(f"a{i}") for i, c in enumerate(checks)])
        rows = []
        for i, c in enumerate(checks):
            f = F.col(f"f{i}").cast("long")
            status = F.lit("ERROR") if c.status == "ERROR" else F.when(f > 0, "FAIL").otherwise("PASS")
            message = F.concat(F.lit(f"{c.id}: "), f.cast("string"), F.lit(" failing"))
            rows.append(F.struct(F.lit(c.id).alias("check_id"), F.lit(c.kind).alias("check_type"), F.lit(c.column).alias("column_name"), status.alias("status"), F.lit(c.severity).alias("severity"), F.lit(c.expected).alias("expected"), F.col(f"a{i}").alias("actual_value"), f.alias("records_failing"), message.alias("message")))
        parts.append(agg.select(F.inline(F.array(*rows))))
    for clause in contract.clauses:
        r = clause.rule
        if r.get("type") == "group_monotonic":
            parts.append(_result(clause.id, r["type"], r["field"], clause.level, "1..n", broken_sequences(df, r["group_by"], r["field"])))
        elif r.get("type") == "repo_path_exists" and files is not None:
            found = paths.scalars(df.schema, r["field"])
            values = df.select(F.explode_outer(found[0] if found else F.array().cast("array<string>")).alias("path"))
            unsafe = F.col("path").isNull() | F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
            known = files.select(F.col("path").alias("__known")).distinct().withColumn("__is", F.lit(True))
            parts.append(_result(clause.id, r["type"], r["field"], clause.level, "file", values.join(known, F.col("path") == F.col("__known"), "left").where(unsafe | F.col("__is").isNull())))
    if not parts:
        return df.sparkSession.createDataFrame([], RESULT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_failures(df: DataFrame, contract: Contract, check_id: str, order: str, limit: int = 5) -> DataFrame:
    """The first records, by ``order``, that fail a check; asked for failing checks only, as a top-k."""
    check = next(c for c in compile_checks(df.schema, contract) if c.id == check_id)
    return df.where(check.rows).orderBy(order).limit(limit)


def all_samples(df: DataFrame, contract: Contract, order: str, limit: int = 5) -> DataFrame:
    """(check_id, n, columns of df): for each check the first records, by ``order``, that fail it, numbered from 1.

    Each record is tested once for all checks; of those that fail, a task passes on at most ``limit`` for each check.
    """
    tested = [c for c in compile_checks(df.schema, contract) if c.rows is not None]
    if not tested:
        return df.limit(0).select(F.lit("").alias("check_id"), F.lit(0).alias("n"), *df.columns)
    failed = F.filter(F.array(*[F.when(c.rows, F.lit(c.id)) for c in tested]), lambda x: x.isNotNull())
    out = df.select("*", F.explode(failed).alias("check_id"))
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("check_id").orderBy(order))).where(F.col("n") <= limit)
    return out.select("check_id", "n", *df.columns)


def summary(results: DataFrame) -> DataFrame:
    """Counts by status and the overall status: FAIL before WARN before PASS."""
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("long")), F.lit(0).cast("long"))
    overall = F.when(n("FAIL", "ERROR") > 0, "FAIL").when(n("WARN") > 0, "WARN").otherwise("PASS")
    return results.agg(F.count(F.lit(1)).alias("total"), n("PASS").alias("passed"), n("FAIL").alias("failed"), n("WARN").alias("warned"), n("ERROR").alias("errored"), overall.alias("overall_status"))


_BLOCKS = {"AUDIT": [], "WARN": ["CRITICAL"], "ENFORCE": ["CRITICAL", "HIGH"]}


def gates(results: DataFrame) -> DataFrame:
    """(mode, blocking) for each mode: which severities of failures stop a pipeline."""
    bad = F.col("status").isin("FAIL", "ERROR")
    one = results.agg(*[F.coalesce(F.bool_or(bad & F.col("severity").isin(s)), F.lit(False)).alias(m) if s else F.lit(False).alias(m) for m, s in _BLOCKS.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("blocking")) for m in _BLOCKS])))
