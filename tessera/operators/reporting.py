"""Reports over check results and violations: totals, health, deduplication, ranking and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import kept

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for i, s in enumerate(reversed(SEVERITIES), 1):
        rank = F.when(severity == s, i).otherwise(rank)
    return rank


def numbered_overall(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 over the whole table in an order that tells them apart, without bringing them together: ranges
    of the order are numbered by themselves, from where those before them end."""
    parts = kept(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = parts.withColumn("__own", own).join(sizes.select("__part", before.alias("__before")), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__own")).cast("int")).drop("__part", "__own", "__before")


def health_score(passed: Column, total: Column, critical: Column) -> Column:
    """Percent passed, less 20 for each critical failure, held to 0 to 100; 100 without checks."""
    raw = F.floor(passed * F.lit(100.0) / F.nullif(total, F.lit(0))) - 20 * critical
    return F.when(total == 0, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), raw))).cast("int")


def totals(results: DataFrame) -> DataFrame:
    """One row: checks, passed, failed, warned, critical failures and health."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    bad = F.col("status").isin("FAIL", "ERROR")
    t = results.agg(F.count(F.lit(1)).alias("total"), n(F.col("status") == "PASS").alias("passed"), n(bad).alias("failed"), n(F.col("status") == "WARN").alias("warned"), n(bad & (F.col("severity") == "CRITICAL")).alias("critical"))
    return t.withColumn("health", health_score(F.col("passed"), F.col("total"), F.col("critical")))


def severity_histogram(results: DataFrame) -> DataFrame:
    """One row of failures by severity."""
    bad = F.col("status").isin("FAIL", "ERROR")
    return results.agg(*[F.count_if(bad & (F.col("severity") == s)).alias(s.lower()) for s in SEVERITIES])


def deduplicated(violations: DataFrame, tie: str = "seq") -> DataFrame:
    """One violation for each (check_id, field, status): of higher severity, then of more records, then the first."""
    order = Window.partitionBy("check_id", "field", "status").orderBy(severity_rank(F.col("severity")).desc(), F.desc("records_failing"), tie)
    return violations.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def last_wins(violations: DataFrame, tie: str = "seq") -> DataFrame:
    """One violation for each (check_id, field, status): of more records, then the last."""
    order = Window.partitionBy("check_id", "field", "status").orderBy(F.desc("records_failing"), F.desc(tie))
    return violations.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def ordered(violations: DataFrame, n: int, systems: str = "systems", at: str = "detected_at", tie: str = "seq") -> DataFrame:
    """The first n violations by severity, affected systems, failing records and time, each from the highest."""
    return violations.orderBy(severity_rank(F.col("severity")).desc(), F.desc(systems), F.desc("records_failing"), F.desc(at), tie).limit(n)


def report_totals(reports: DataFrame) -> DataFrame:
    """Totals over reports of (total, passed, failed, warned, results array<struct<status, severity>>).

    A count that a report doesn't give is counted from its results; ERROR counts as failed.
    """
    of = lambda *s: F.size(F.filter(F.coalesce("results", F.array().cast(reports.schema["results"].dataType)), lambda r: r["status"].isin(*s) if s else F.lit(True))).cast("long")
    n = lambda name, *s: F.coalesce(F.sum(F.coalesce(F.col(name).cast("long"), of(*s))), F.lit(0).cast("long")).alias(name)
    critical = F.size(F.filter("results", lambda r: r["status"].isin("FAIL", "ERROR") & (r["severity"] == "CRITICAL")))
    return reports.agg(n("total"), n("passed", "PASS"), n("failed", "FAIL", "ERROR"), n("warned", "WARN"), F.coalesce(F.sum(F.when(F.col("results").isNotNull(), critical)), F.lit(0)).cast("long").alias("critical"))


def ai_counts(checks: DataFrame) -> DataFrame:
    """One row of counts of (name, status): a baseline that was just set counts as passed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return checks.agg(F.count(F.lit(1)).alias("total"), n("PASS", "BASELINE_SET").alias("passed"), n("FAIL", "ERROR").alias("failed"), n("WARN").alias("warned"))


def first_match(rows: DataFrame, key: str, reference: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``rows`` with the first row of ``reference``, by the place of the column in ``columns`` and then by ``order``,
    that has the key in any of the columns; nulls where none has.

    The reference is cut down to one row for each value before it is joined, so no key is joined with many.
    """
    each = F.array(*[F.struct(F.col(c).cast("string").alias("__value"), F.lit(i).alias("__place")) for i, c in enumerate(columns)])
    r = reference.select("*", F.inline(each)).where("__value IS NOT NULL")
    whole = F.struct(*[F.col(c) for c in reference.columns])
    r = r.groupBy("__value").agg(F.min_by(whole, F.struct("__place", order)).alias("match"))
    return rows.join(r, F.col(key).cast("string") == F.col("__value"), "left").drop("__value")


def top(violations: DataFrame, n: int = 3, tie: str = "seq") -> DataFrame:
    """The n gravest violations."""
    return violations.orderBy(severity_rank(F.col("severity")).desc(), F.desc("records_failing"), tie).limit(n)


def radius_by_field(violations: DataFrame) -> DataFrame:
    """(field, max_depth, records, violations, systems): systems in order, joined by commas."""
    return violations.groupBy("field").agg(F.max("depth").alias("max_depth"), F.sum("records_failing").alias("records"), F.count(F.lit(1)).alias("violations"), F.concat_ws(",", F.array_sort(F.collect_set("system"))).alias("systems"))


def blame_summary(blames: DataFrame) -> DataFrame:
    """(file, commit, impact, fields, best, author): how often, the distinct fields in order, the highest confidence and
    the author of that one (of several, the least)."""
    return blames.groupBy("file", "commit").agg(
        F.count(F.lit(1)).alias("impact"), F.array_sort(F.collect_set("field")).alias("fields"), F.max("confidence").alias("best"), F.min_by("author", F.struct(-F.col("confidence"), "author")).alias("author")
    )


def search(violations: DataFrame, severity: str | None = None, text: str | None = None, columns: tuple[str, ...] = ("field", "message")) -> DataFrame:
    """Violations of a severity that hold a text in any of the columns, in any case."""
    out = violations if severity is None else violations.where(F.upper("severity") == severity.upper())
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
        out = out.where(hit)
    return out


def timeline(parts: list[DataFrame], limit: int, at: str = "at", tie: tuple[str, ...] = ("kind", "ref")) -> DataFrame:
    """The newest entries of several sources of (at, kind, ref, ...)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc(at), *tie).limit(limit)


def drift_score(changes: Column, failed: Column, warned: Column) -> Column:
    return F.least(F.lit(100), 15 * changes + 4 * failed + 2 * warned)


def rollup(results: DataFrame, by: list[str]) -> DataFrame:
    """(by..., level, total, passed, failed, warned, critical, health): check results at every level of ``by``, from each of its
    values together down to all results (level 0, whose columns are null), in one aggregation."""
    bad = F.col("status").isin("FAIL", "ERROR")
    g = results.rollup(*by).agg(
        F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(bad).alias("failed"), F.count_if(F.col("status") == "WARN").alias("warned"),
        F.count_if(bad & (F.col("severity") == "CRITICAL")).alias("critical"),
    )
    level = (F.lit(len(by)) - F.bit_count("__g")).cast("int")
    return g.select(*by, level.alias("level"), "total", "passed", "failed", "warned", "critical", health_score(F.col("passed"), F.col("total"), F.col("critical")).alias("health"))


# The checks whose violation stands for all, the first one there is, and the lines of its summary.
PREFERRED = ("extracted_facts.confidence.range", "week3.confidence_unit_scale", "extracted_facts.confidence.drift")
SUMMARY_TITLE = "ViolationAttributor live summary"
SUMMARY_LINES = ("Failing check", "Field", "Top cause", "Commit", "Author", "Lineage traversal", "First downstream hop", "Blast radius")


def primary(violations: DataFrame, order: list[str]) -> DataFrame:
    """The violation of the first of PREFERRED that there is, of several the first in ``order``; else the first of all. No
    row without violations; each task passes on one."""
    place = F.coalesce(*[F.when(F.col("check_id") == c, i) for i, c in enumerate(PREFERRED)], F.lit(len(PREFERRED)))
    return violations.orderBy(place, *order).limit(1)


def live_summary(violations: DataFrame, order: list[str]) -> DataFrame:
    """(summary): the primary violation in lines of text.

    ``violations``: (check_id, field_name, blame array<struct<file_path, commit_hash, author>>, the likeliest first, lineage
    array, affected array). What is missing is unknown for causes, none for places.
    """
    top = lambda name: F.coalesce(F.get("blame", F.lit(0))[name], F.lit("unknown"))
    check, hops = F.coalesce("check_id", F.lit("")), F.coalesce("lineage", F.array().cast("array<string>"))
    reached = F.when(F.size("affected") > 0, F.array_join("affected", ", ")).otherwise("none")
    said = (check, F.coalesce("field_name", F.lit("")), top("file_path"), top("commit_hash"), top("author"), F.array_join(F.array_prepend(hops, check), " -> "), F.coalesce(F.get(hops, F.lit(0)), F.lit("none")), reached)
    lines = [F.concat(F.lit(f"{name}: "), text) for name, text in zip(SUMMARY_LINES, said, strict=True)]
    return primary(violations, order).select(F.concat_ws("\n", F.lit(SUMMARY_TITLE), *lines).alias("summary"))
