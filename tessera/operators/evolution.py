"""Schema evolution: a full outer join of two field tables, one cascade of change kinds, and a verdict."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import ancestors
from tessera.plans.contract import Contract

FIELDS = "field string, type string, required boolean, minimum double, maximum double, enum array<string>, low double, high double"
RENAME_LEAST, LEAF_BONUS = 0.55, 0.15


def field_table(spark: SparkSession, contract: Contract) -> DataFrame:
    """The contract's fields (FIELDS); low and high are observed statistics."""
    rows = [(n, r.type, r.required, r.minimum, r.maximum, None if r.enum is None else sorted(str(x) for x in r.enum), (r.stats or {}).get("minimum"), (r.stats or {}).get("maximum")) for n, r in contract.fields.items()]
    return spark.createDataFrame([(a, b, c, *(None if x is None else float(x) for x in (d, e)), f, *(None if x is None else float(x) for x in (g, h))) for a, b, c, d, e, f, g, h in rows], FIELDS)


@lru_cache(maxsize=1 << 14)
def _named(name: str) -> tuple[frozenset[str], str]:
    """A name's tokens and its leaf."""
    return frozenset(re.findall("[a-z0-9]{2,}", name.lower())), name.rsplit(".", 1)[-1]


def _shared(a: str, b: str) -> tuple[float, float]:
    """Token overlap of two names, and what is added where the leaves agree."""
    (ta, la), (tb, lb) = _named(a), _named(b)
    both = len(ta & tb)
    return both / (len(ta) + len(tb) - both) if ta or tb else 0.0, LEAF_BONUS if la == lb else 0.0


def matching_ratio(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b).ratio()``: the longest common block, the first in a and then in b, and so on to its left
    and right. Blocks are found by searching for ever longer ones; from 200 characters on the library leaves out frequent ones."""
    if len(b) >= 200:
        return difflib.SequenceMatcher(None, a, b).ratio()
    matches, parts, length = 0, [(a, b)], len(a) + len(b)
    while parts:
        x, y = parts.pop()
        at = best = 0
        for i in range(len(x)):
            if i + best >= len(x):
                break
            while i + best < len(x) and x[i : i + best + 1] in y:
                at, best = i, best + 1
        if best:
            matches += best
            to = y.index(x[at : at + best])
            parts += [(x[:at], y[:to]), (x[at + best :], y[to + best :])]
    return 2.0 * matches / length if length else 1.0


def similarity(a: str, b: str) -> float:
    """How alike two field names are: the larger of token overlap and matching blocks, more if the leaves agree."""
    overlap, bonus = _shared(a, b)
    return max(overlap, matching_ratio(a, b)) + bonus


def similarity_bound(a: str, b: str) -> float:
    """What ``similarity`` can't pass, from tokens and lengths alone."""
    overlap, bonus = _shared(a, b)
    length = len(a) + len(b)
    return max(overlap, 2.0 * min(len(a), len(b)) / length if length else 1.0) + bonus


def detect_renames(old: Contract, new: Contract) -> dict[str, str]:
    """Removed fields and the added ones that they have become; metadata of two contracts, on the driver.

    Greedy in the old order; type, format and pattern must agree, and enumerations where both have one.
    """
    added, out = [n for n in new.fields if n not in old.fields], {}
    for name, rule in old.fields.items():
        if name in new.fields:
            continue
        fits = [t for t in added if t not in out.values() and all(getattr(rule, k) == getattr(new.fields[t], k) for k in ("type", "format", "pattern")) and (not rule.enum or not new.fields[t].enum or set(rule.enum) == set(new.fields[t].enum))]
        scored = sorted((-similarity(name, t), t) for t in fits)
        if scored and -scored[0][0] >= RENAME_LEAST:
            out[name] = scored[0][1]
    return out


def _unit(side: str) -> Column:
    high = F.coalesce(F.col(f"{side}.high"), F.col(f"{side}.maximum"))
    low = F.coalesce(F.col(f"{side}.low"), F.col(f"{side}.minimum"))
    return (low >= 0) & (high <= 1)


def _percent(side: str) -> Column:
    high = F.coalesce(F.col(f"{side}.high"), F.col(f"{side}.maximum"))
    low = F.coalesce(F.col(f"{side}.low"), F.col(f"{side}.minimum"))
    return (low >= 0) & (high > 1) & (high <= 100)


def classify(source: DataFrame, target: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """(field_name, change_type, compatibility_class, severity, backward_compatible, forward_compatible).

    Required, format and pattern of a field that stays are not compared.
    """
    renames = renames or {}
    t = target.where(~F.col("field").isin(list(renames.values()))) if renames else target
    return _classified(source.alias("s").join(t.alias("t"), F.col("s.field") == F.col("t.field"), "full_outer"), [], renames)


def _classified(j: DataFrame, keys: list[str], renames: dict[str, str]) -> DataFrame:
    """The change of each pair of a field before (s) and after (t), either of which may be missing."""
    numeric = lambda side: F.col(f"{side}.type").isin("integer", "number")
    shift = F.coalesce((_unit("s") & _percent("t")) | (_percent("s") & _unit("t")), F.lit(False))
    same = F.col("s.type") == F.col("t.type")
    # A bound that only one side has counts as widened.
    lower = F.coalesce(F.col("t.minimum") > F.col("s.minimum"), F.lit(False))
    upper = F.coalesce(F.col("t.maximum") < F.col("s.maximum"), F.lit(False))
    differ = ~F.col("s.minimum").eqNullSafe(F.col("t.minimum")) | ~F.col("s.maximum").eqNullSafe(F.col("t.maximum"))
    values = lambda side: F.coalesce(F.col(f"{side}.enum"), F.array().cast("array<string>"))
    gone, came = F.size(F.array_except(values("s"), values("t"))) > 0, F.size(F.array_except(values("t"), values("s"))) > 0
    change = (
        F.when(F.col("s.field").isin(list(renames)) if renames else F.lit(False), "FIELD_RENAME")
        .when(F.col("s.field").isNull(), F.when(F.col("t.required"), "FIELD_ADDED_REQUIRED").otherwise("FIELD_ADDED_OPTIONAL"))
        .when(F.col("t.field").isNull(), F.when(F.col("s.required"), "FIELD_REMOVED_REQUIRED").otherwise("FIELD_REMOVED_OPTIONAL"))
        .when(same & numeric("s") & shift, "NUMERIC_SCALE_SHIFT")
        .when((F.col("s.type") == "integer") & (F.col("t.type") == "number"), "TYPE_WIDENING")
        .when(~same & numeric("s") & numeric("t") & shift, "TYPE_NARROWING_SCALE_SHIFT")
        .when(~same & numeric("s") & numeric("t"), "TYPE_NARROWING")
        .when(~same, "TYPE_CHANGE")
        .when(differ & (lower | upper), "RANGE_NARROWING")
        .when(differ, "RANGE_WIDENING")
        .when(gone, "ENUM_VALUE_REMOVED")
        .when(came, "ENUM_VALUE_ADDED")
        .otherwise("NO_CHANGE")
    )
    # Fixed verdicts: change kind, class, severity, backward, forward.
    table = [
        ("FIELD_RENAME", "breaking", "HIGH", False, False), ("FIELD_ADDED_REQUIRED", "breaking", "HIGH", False, True), ("FIELD_ADDED_OPTIONAL", "backward", "LOW", True, True),
        ("FIELD_REMOVED_REQUIRED", "breaking", "HIGH", True, False), ("FIELD_REMOVED_OPTIONAL", "forward", "MEDIUM", True, True), ("NUMERIC_SCALE_SHIFT", "breaking", "CRITICAL", False, False),
        ("TYPE_WIDENING", "backward", "LOW", True, True), ("TYPE_NARROWING_SCALE_SHIFT", "breaking", "CRITICAL", False, False), ("TYPE_NARROWING", "breaking", "CRITICAL", False, False),
        ("TYPE_CHANGE", "breaking", "HIGH", False, False), ("RANGE_NARROWING", "breaking", "HIGH", False, False), ("RANGE_WIDENING", "forward", "LOW", False, True),
        ("ENUM_VALUE_REMOVED", "breaking", "HIGH", False, False), ("ENUM_VALUE_ADDED", "forward", "LOW", False, True), ("NO_CHANGE", "backward", "LOW", True, True),
    ]
    of = lambda i: F.coalesce(*[F.when(F.col("change_type") == row[0], F.lit(row[i])) for row in table])
    out = j.select(*keys, F.coalesce("s.field", "t.field").alias("field_name"), change.alias("change_type"))
    return out.select(*keys, "field_name", "change_type", of(1).alias("compatibility_class"), of(2).alias("severity"), of(3).alias("backward_compatible"), of(4).alias("forward_compatible"))


_DEFINED = ["field", "type", "required", "minimum", "maximum", "enum", "low", "high"]


#: Least tasks of a history. Snapshots that repeat each other pack so small that sizes of shuffles ask for a few tasks, each with
#: a great many rows to sort.
TASKS = 200


def _steps(fields: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(contract_id, version, n, latest, next_version, before, now, after_n): each field of each snapshot, and itself in the one
    before (null: it wasn't there), by one window over a contract's field; snapshots of a contract are numbered from 1."""
    tasks = max(TASKS, int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = Window.partitionBy("contract_id")
    versions = snapshots.select("contract_id", "version").distinct()
    numbered = versions.withColumns({"n": F.row_number().over(by.orderBy("version")), "next_version": F.lead("version").over(by.orderBy("version"))}).withColumn("latest", F.max("n").over(by))
    on = ["contract_id", "version"]
    rows = fields.select("contract_id", "version", F.struct(*_DEFINED).alias("now")).repartition(tasks, *on).join(numbered.repartition(tasks, *on), on)
    of = Window.partitionBy("contract_id", "__field").orderBy("n")
    rows = rows.withColumn("__field", F.col("now.field")).repartition(tasks, "contract_id", "__field")
    rows = rows.withColumns({"before": F.lag("now").over(of), "before_n": F.lag("n").over(of), "after_n": F.lead("n").over(of)})
    return rows.withColumn("before", F.when(F.col("before_n") == F.col("n") - 1, F.col("before"))).drop("before_n", "__field")


def field_history(fields: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(contract_id, version, field_name, change_type, compatibility_class, severity, backward_compatible,
    forward_compatible): what changed with each snapshot of each contract, in one plan.

    ``fields``: those of ``classify``, with contract_id and version, once for each snapshot; ``snapshots``: (contract_id,
    version), those without fields included. Versions are in the order of their column. A contract's first snapshot changes
    nothing; a field that goes and comes again is removed and added.
    """
    steps, none = _steps(fields, snapshots), F.when(F.lit(False), F.col("now"))
    pair = lambda version, s, t: F.struct(version.alias("version"), s.alias("s"), t.alias("t"))
    came = F.when((F.col("n") > 1) & ~F.col("before").eqNullSafe(F.col("now")), pair(F.col("version"), F.col("before"), F.col("now")))
    gone = F.when((F.col("n") < F.col("latest")) & (F.col("after_n").isNull() | (F.col("after_n") > F.col("n") + 1)), pair(F.col("next_version"), F.col("now"), none))
    changes = steps.select("contract_id", F.inline(F.array_compact(F.array(came, gone))))
    return _classified(changes, ["contract_id", "version"], {}).where("change_type <> 'NO_CHANGE'")


def validity(fields: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(contract_id, field, type, required, first_version, last_version, current): the spans of snapshots over which a field was
    defined alike and without a gap."""
    steps = _steps(fields, snapshots)
    fresh = ~F.col("before").eqNullSafe(F.col("now"))
    span = F.sum(fresh.cast("int")).over(Window.partitionBy("contract_id", "now.field").orderBy("n"))
    spans = steps.withColumn("span", span).groupBy("contract_id", F.col("now.field").alias("field"), "span")
    out = spans.agg(F.first("now").alias("now"), F.min(F.struct("n", "version")).alias("a"), F.max(F.struct("n", "version")).alias("b"), F.max("latest").alias("latest"))
    return out.select("contract_id", "field", "now.type", "now.required", F.col("a.version").alias("first_version"), F.col("b.version").alias("last_version"), (F.col("b.n") == F.col("latest")).alias("current"))


def history_reports(history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(contract_id, status, verdict, changes, rollback): how each contract's last snapshot differs from the one before.

    The status is INSUFFICIENT_SNAPSHOTS where there is one only, else OK; the verdict is that of ``verdict``, and a
    rollback is planned where it is breaking.
    """
    last = snapshots.groupBy("contract_id").agg(F.max("version").alias("version"), F.count_distinct("version").alias("n"))
    j = last.join(history, ["contract_id", "version"], "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    word = F.when(some(F.col("compatibility_class") == "breaking"), "breaking").when(~some(~F.col("backward_compatible")), "backward").when(~some(~F.col("forward_compatible")), "forward").otherwise("backward")
    out = j.groupBy("contract_id", "n").agg(word.alias("verdict"), F.count("change_type").alias("changes"))
    few = F.col("n") < 2
    return out.select("contract_id", F.when(few, "INSUFFICIENT_SNAPSHOTS").otherwise("OK").alias("status"), F.when(~few, F.col("verdict")).alias("verdict"), "changes", (~few & (F.col("verdict") == "breaking")).alias("rollback"))


def failure_modes(history: DataFrame, snapshots: DataFrame, subscriptions: DataFrame, hops: DataFrame | None = None) -> DataFrame:
    """(contract_id, subscriber_id, fields, failure_mode, hops): consumers whose declared field meets a breaking change of the
    last snapshot, by equi-joins on contract and paths.

    ``subscriptions``: (contract_id, subscriber_id, field, reason); without reasons the mode names the fields. ``hops``:
    (contract_id, subscriber_id, hops) of the lineage, 0 where it has none.
    """
    last = snapshots.groupBy("contract_id").agg(F.max("version").alias("version"))
    broken = history.where("compatibility_class = 'breaking'").join(last, ["contract_id", "version"], "left_semi")
    at = lambda c: F.concat(F.col("contract_id").cast("string"), F.lit("\x00"), F.col(c))
    declared = subscriptions.withColumn("__field", at("field"))
    met = meeting(declared, broken.select(at("field_name").alias("__path"), "field_name"), "__field", "__path").select("contract_id", "subscriber_id", "field", "reason").distinct()
    out = met.groupBy("contract_id", "subscriber_id").agg(F.array_sort(F.collect_set("field")).alias("f"), F.array_sort(F.collect_set("reason")).alias("r"))
    mode = F.when(F.size("r") > 0, F.array_join("r", "; ")).otherwise(F.concat(F.lit("Consumer may fail on "), F.array_join("f", ", "), F.lit(".")))
    out = out.select("contract_id", "subscriber_id", F.array_join("f", ",").alias("fields"), mode.alias("failure_mode"))
    if hops is None:
        return out.withColumn("hops", F.lit(0))
    return out.join(hops.select("contract_id", "subscriber_id", "hops"), ["contract_id", "subscriber_id"], "left").withColumn("hops", F.coalesce("hops", F.lit(0)))


def verdict(changes: DataFrame) -> DataFrame:
    """One row: breaking if any change is; else backward or forward if all material changes are; else backward."""
    material = F.col("change_type") != "NO_CHANGE"
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    word = F.when(some(F.col("compatibility_class") == "breaking"), "breaking").when(~some(material & ~F.col("backward_compatible")), "backward").when(~some(material & ~F.col("forward_compatible")), "forward").otherwise("backward")
    return changes.agg(word.alias("verdict"), F.count_if(material).alias("changes"))


def notifications(changes: DataFrame, registry: DataFrame, contract_id: str) -> DataFrame:
    """(subscriber_id, field_name, change_type): breaking changes of fields that a subscriber declared breaking.

    ``registry``: (contract_id, subscriber_id, breaking_field), a small table.
    """
    breaking = changes.where("compatibility_class = 'breaking'")
    subs = registry.where(F.col("contract_id") == contract_id)
    return subs.join(breaking, F.col("breaking_field") == F.col("field_name")).select("subscriber_id", "field_name", "change_type")


def meeting(declared: DataFrame, failing: DataFrame, field: str = "field", path: str = "failing", how: str = "either") -> DataFrame:
    """Rows of both where the failing path is the declared field or, by ``how``, lies in it (below) or around it (either).

    Each pair once for each pair of rows, by two equi-joins on the paths that the one or the other lies in; ``path_matches``
    says the same of one pair.
    """
    if how == "exact":
        return declared.join(failing, F.col(field) == F.col(path))
    inside = failing.withColumn("__in", F.explode(ancestors(F.col(path))))
    out = declared.join(inside, F.col(field) == F.col("__in")).drop("__in")
    if how == "below":
        return out
    around = declared.withColumn("__in", F.explode(ancestors(F.col(field)))).where(F.col("__in") != F.col(field))
    return out.unionByName(around.join(failing, F.col("__in") == F.col(path)).drop("__in"))


def blast_radius(subscriptions: DataFrame, failing: DataFrame, how: str = "either") -> DataFrame:
    """Subscribers whose declared field meets a failing one; ``subscriptions``: (subscriber_id, field), ``failing``: (failing)."""
    return meeting(subscriptions.select("subscriber_id", "field"), failing.select("failing"), how=how).select("subscriber_id", "field", "failing").distinct()


def checklist(changes: Iterable) -> list[str]:
    """The steps that breaking changes ask for, in order of field."""
    out = [f"Migrate consumers of {c['field_name']}: {c['change_type'].lower().replace('_', ' ')}" for c in sorted(changes, key=lambda c: c["field_name"]) if c["compatibility_class"] == "breaking"]
    return [*out, "Publish the new snapshot", "Keep the previous snapshot for rollback"] if out else ["No migration needed"]
