"""Contracts over raw JSON records, where absent and null, 1 and true, and values of several kinds are told apart.

Lines are parsed once into VARIANT. Each field of a contract becomes one array of the values that its path has in a
record, and all checks of all fields are conditional sums over these arrays in a single aggregation: no value is
exploded, no Python runs, and a task passes on one row. Where records have an order, the value that a failed check
names is the first that fails, by a minimum over (order, place in the record).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import variants
from tessera.functions.text import has_format, matches
from tessera.plans.contract import SEVERITY, Contract, FieldRule

_SOME = ("bool", "int", "float", "str", "arr", "obj")


def parsed(lines: DataFrame, column: str = "value", tolerant: bool = False) -> DataFrame:
    """``lines`` and ``__v``, the record as a variant; null and blank lines are left out. A malformed line fails, or is
    left out if ``tolerant``."""
    some = lines.where(F.col(column).isNotNull() & F.col(column).rlike(r"\S"))
    if tolerant:
        return some.withColumn("__v", F.try_parse_json(column)).where("__v IS NOT NULL")
    return some.withColumn("__v", F.parse_json(column))


def _invalid(rule: FieldRule) -> dict[str, object]:
    """The test of one value that isn't null, by check."""
    out = {}
    if rule.enum is not None:
        texts = [a for a in rule.enum if isinstance(a, str)]
        numbers = [float(a) for a in rule.enum if isinstance(a, (bool, int, float))]
        out["enum"] = lambda x: ~F.when(x["kind"] == "str", x["text"].isin(texts)).otherwise(F.coalesce(x["number"].isin(numbers), F.lit(False)))
    if rule.format is not None:
        out["format"] = lambda x: ~F.coalesce((x["kind"] == "str") & has_format(x["text"], rule.format), F.lit(False))
    if rule.pattern is not None:
        out["pattern"] = lambda x: ~F.coalesce((x["kind"] == "str") & matches(x["text"], str(rule.pattern)), F.lit(False))
    if rule.minimum is not None or rule.maximum is not None:
        low = lambda x: F.lit(False) if rule.minimum is None else x["number"] < float(rule.minimum)
        high = lambda x: F.lit(False) if rule.maximum is None else x["number"] > float(rule.maximum)
        out["range"] = lambda x: F.coalesce(low(x) | high(x), F.lit(False))
    return out


@dataclass
class _Check:
    kind: str
    field: str
    expected: str
    values: str
    bad: object = None


def _checks(contract: Contract) -> tuple[list[_Check], dict[str, str]]:
    names = {f: f"__o{i}" for i, f in enumerate(sorted(contract.fields))}
    checks = []
    for f, rule in sorted(contract.fields.items()):
        if rule.required:
            checks.append(_Check("required", f, "True", names[f]))
        if rule.type:
            checks.append(_Check("type", f, rule.type, names[f]))
        expected = {"enum": rule.enum, "format": rule.format, "pattern": rule.pattern, "range": {"minimum": rule.minimum, "maximum": rule.maximum}}
        checks += [_Check(k, f, str(expected[k]), names[f], bad) for k, bad in _invalid(rule).items()]
    return checks, names


def _with_observations(lines: DataFrame, contract: Contract, column: str, tolerant: bool) -> tuple[DataFrame, list[_Check]]:
    checks, names = _checks(contract)
    return parsed(lines, column, tolerant).withColumns({n: variants.observed(F.col("__v"), f) for f, n in names.items()}), checks


def _some(x: Column) -> Column:
    return x["kind"].isin(*_SOME)


def _failing(c: _Check) -> Column:
    return F.filter(F.col(c.values), lambda x: _some(x) & c.bad(x))


def _placed(values: Column, name: str, key: str) -> Column:
    """Structs (``name`` key, place, value) of an array of observations."""
    return F.transform(values, lambda x, i: F.struct(F.lit(key).alias(name), i.alias("place"), x["text"].alias("value")))


def _all_kinds(values: Column, *kinds: str) -> Column:
    return F.coalesce(F.bool_and(F.forall(values, lambda x: x["kind"].isin(*kinds))), F.lit(True))


def evaluate(lines: DataFrame, contract: Contract, column: str = "value", tolerant: bool = False, order: Column | None = None) -> DataFrame:
    """(check_id, check_type, column_name, status, severity, expected, actual_value, records_failing, message), a row for
    each check of each field.

    A field is absent from a record that doesn't have it, not from one where it is null; ``required`` fails by as
    many records as sightings are missing. Type, enum, format, pattern and range judge values that aren't null; where there
    are none, they have no row, and where the field was never seen, they are an ERROR of all records, but for the type,
    which has no row. Values of more than one kind are of type number if all are numbers, else string. Enums compare
    numbers and truth values by number and texts by text; formats and patterns fail on what is no text; ranges judge
    numbers only. With ``order`` (of a record in its dataset), the actual value is the first that fails, without it the
    least.
    """
    rows, checks = _with_observations(lines, contract, column, tolerant)
    total = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0).cast("long"))
    at = F.lit(0) if order is None else order
    numbers = {}
    for n, values in {c.values: F.col(c.values) for c in checks}.items():
        some, seen = F.filter(values, _some), F.filter(values, lambda x: x["counted"])
        numbers |= {f"{n}_seen": total(F.size(seen)), f"{n}_known": total(F.size(F.filter(values, lambda x: x["kind"] != "none"))), f"{n}_some": total(F.size(some)), f"{n}_type": F.when(_all_kinds(some, "bool"), "boolean").when(_all_kinds(some, "int"), "integer").when(_all_kinds(some, "int", "float"), "number").otherwise("string")}
        numeric = F.transform(F.filter(some, lambda x: x["number"].isNotNull()), lambda x: x["number"])
        if any(c.kind == "range" and c.values == n for c in checks):
            numbers |= {f"{n}_low": F.min(F.array_min(numeric)), f"{n}_high": F.max(F.array_max(numeric))}
    for i, c in enumerate(checks):
        if c.bad is not None:
            failing = _failing(c)
            numbers[f"n{i}"] = total(F.size(failing))
            first = F.get(failing, F.lit(0))["text"] if order is not None else F.array_min(F.transform(failing, lambda x: x["text"]))
            numbers[f"first{i}"] = F.min(F.when(F.size(failing) > 0, F.struct(at.alias("at"), first.alias("value"))))["value"]
    agg = rows.agg(F.count(F.lit(1)).alias("records"), *[x.alias(k) for k, x in numbers.items()])
    out = []
    for i, c in enumerate(checks):
        seen, known, some, observed = (F.col(f"{c.values}_{k}") for k in ("seen", "known", "some", "type"))
        missing = known == 0
        if c.kind == "required":
            n = F.when(missing, F.col("records")).otherwise(F.greatest(F.lit(0).cast("long"), F.col("records") - seen))
            status, actual, there = F.when(n > 0, "FAIL").otherwise("PASS"), F.concat(n.cast("string"), F.lit(" missing")), F.lit(True)
        elif c.kind == "type":
            fine = (observed == c.expected) | (F.lit(c.expected == "number") & (observed == "integer"))
            n = F.when(fine, 0).otherwise(some).cast("long")
            status, actual, there = F.when(fine, "PASS").otherwise("FAIL"), observed, some > 0
        else:
            n = F.when(missing, F.col("records")).otherwise(F.col(f"n{i}")).cast("long")
            bounds = F.to_json(F.struct(F.col(f"{c.values}_low").alias("min"), F.col(f"{c.values}_high").alias("max")), {"ignoreNullFields": "false"}) if c.kind == "range" else F.coalesce(F.col(f"first{i}"), F.lit("all conforming"))
            status = F.when(missing, "ERROR").when(n > 0, "FAIL").otherwise("PASS")
            actual, there = F.when(missing, "column missing").otherwise(bounds), missing | (some > 0)
        check_id = f"{c.field}.{c.kind}"
        out.append(
            F.when(
                there,
                F.struct(
                    F.lit(check_id).alias("check_id"), F.lit(c.kind).alias("check_type"), F.lit(c.field).alias("column_name"), status.alias("status"), F.lit(SEVERITY[c.kind]).alias("severity"),
                    F.lit(c.expected).alias("expected"), actual.alias("actual_value"), n.alias("records_failing"), F.concat(F.lit(f"{check_id}: "), n.cast("string"), F.lit(" failing")).alias("message"),
                ),
            )
        )
    if not out:
        raise ValueError("the contract has no checks of fields")
    return agg.select(F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("r")).select("r.*")


def first_failures(lines: DataFrame, contract: Contract, order: Column, column: str = "value", tolerant: bool = False, limit: int = 5) -> DataFrame:
    """(check_id, n, value): the first values, by record and place in it, that fail each check of values, from 1.

    Of the failing values alone, and of those a task passes on at most ``limit`` for each check.
    """
    rows, checks = _with_observations(lines, contract, column, tolerant)
    tested = [c for c in checks if c.bad is not None]
    each = F.flatten(F.array(*[_placed(F.slice(_failing(c), 1, limit), "check_id", f"{c.field}.{c.kind}") for c in tested]))
    found = rows.select(order.alias("at"), F.explode(each).alias("f")).select("at", "f.*")
    n = F.row_number().over(Window.partitionBy("check_id").orderBy("at", "place"))
    return found.withColumn("n", n).where(F.col("n") <= limit).select("check_id", "n", "value")


def first_seen(lines: DataFrame, fields: list[str], order: Column, column: str = "value", tolerant: bool = False, limit: int = 5) -> DataFrame:
    """(field, n, value): the first distinct values of each path, in the order in which records show them, from 1.

    Two-phase: a distinct value's first place is a minimum, taken in each task and then over all; of these a task passes
    on at most ``limit`` for each field.
    """
    rows = parsed(lines, column, tolerant)
    each = F.flatten(F.array(*[_placed(F.filter(variants.observed(F.col("__v"), f), _some), "field", f) for f in fields]))
    found = rows.select(order.alias("at"), F.explode(each).alias("f")).groupBy("f.field", "f.value").agg(F.min(F.struct("at", "f.place")).alias("at"))
    n = F.row_number().over(Window.partitionBy("field").orderBy("at"))
    return found.withColumn("n", n).where(F.col("n") <= limit).select("field", "n", "value")


def coerce(lines: DataFrame, kinds: dict[str, str], column: str = "value", tolerant: bool = False) -> DataFrame:
    """``lines`` with a column for each named member of the record, coerced to its kind; what can't be stays as it is."""
    rows = parsed(lines, column, tolerant)
    return rows.withColumns({k: variants.coerced(variants.child(F.col("__v"), k), to) for k, to in kinds.items()}).drop("__v")
