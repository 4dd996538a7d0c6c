"""Checks of model inputs and outputs: hashed vectors and their drift, JSON-schema rules, prompts and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import instant, tokens

DIMENSIONS, DRIFT_LIMIT = 128, 0.15
RATE_WARN, RATE_FAIL, TREND = 0.02, 0.05, 0.005


def bucket_counts(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """(by..., bucket, n): tokens counted by hash bucket; each distinct token is hashed once for each task."""
    keys = by or []
    words = df.select(*keys, F.explode(tokens(F.col(text))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("k"))
    bucket = (F.conv(F.substring(F.sha2(F.col("token"), 256), 1, 8), 16, 10).cast("long") % DIMENSIONS).cast("int")
    return words.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("k").alias("n"))


def unit_vectors(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., v): counts as arrays of DIMENSIONS, of length 1; of nothing but zeros they stay so."""
    m = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"), F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("norm"))
    at = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    return m.select(*by, at.alias("v"))


def centroids(df: DataFrame, by: list[str], vector: str, name: str = "v") -> DataFrame:
    """(by..., name): the mean of each component over a group's vectors, of any length; a task passes on one row for each
    component and group."""
    means = df.select(*by, F.posexplode(vector).alias("__i", "__x")).groupBy(*by, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda c: c["__m"]).alias(name))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; 1 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm).otherwise(F.lit(1.0))


def drift_status(distance: Column, limit: float = DRIFT_LIMIT) -> Column:
    return F.when(distance.isNull(), "BASELINE_SET").when(distance > limit, "FAIL").otherwise("PASS")


def schema_error(col: Column, name: str, schema: dict) -> Column:
    """The first violation of a JSON-schema subset by a typed column, as text; null if it conforms.

    Keywords: required (by the parent), enum, pattern (anywhere), minLength, maxLength, minimum, maximum, minItems,
    items, properties and format date-time.
    """
    out: list[Column] = []
    say = lambda bad, what: out.append(F.when(bad, F.lit(f"{name}: {what}")))
    if "enum" in schema:
        say(~col.isin(schema["enum"]), "enum")
    if "pattern" in schema:
        say(~col.rlike(schema["pattern"]), "pattern")
    if "minLength" in schema:
        say(F.char_length(col) < schema["minLength"], "minLength")
    if "maxLength" in schema:
        say(F.char_length(col) > schema["maxLength"], "maxLength")
    if "minimum" in schema:
        say(col < schema["minimum"], "minimum")
    if "maximum" in schema:
        say(col > schema["maximum"], "maximum")
    if schema.get("format") == "date-time":
        say(instant(col).isNull(), "format")
    if "minItems" in schema:
        say(F.size(col) < schema["minItems"], "minItems")
    if "items" in schema:
        say(F.exists(col, lambda x: schema_error(x, name, schema["items"]).isNotNull()), "items")
    for key, sub in (schema.get("properties") or {}).items():
        if key in schema.get("required", []):
            out.append(F.when(col[key].isNull(), F.lit(f"{name}.{key}: required")))
        out.append(F.when(col[key].isNotNull(), schema_error(col[key], f"{name}.{key}", sub)))
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def violation_rate(df: DataFrame, error: Column, baseline: float | None = None) -> DataFrame:
    """One row: records, violations, rate, trend against a baseline rate, and status."""
    r = df.agg(F.count(F.lit(1)).alias("total"), F.count(error).alias("violations"))
    rate = F.coalesce(F.col("violations") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    base = F.lit(baseline).cast("double")
    trend = F.when(base.isNull(), "unknown").when(rate > base + TREND, "rising").when(rate < base - TREND, "falling").otherwise("stable")
    r = r.withColumn("rate", rate).withColumn("trend", trend)
    return r.withColumn("status", F.when(F.col("rate") > RATE_FAIL, "FAIL").when((F.col("violations") > 0) | (F.col("trend") == "rising"), "WARN").otherwise("PASS"))


def prompt_inputs(df: DataFrame, doc_id: Column, path: Column, facts: Column, metadata: Column | None = None, most: int = 8000) -> DataFrame:
    """(doc_id, source_path, preview) of each record: what its metadata says comes before the record's own, and the preview
    is the start of its first fact (a struct with ``source_excerpt``)."""
    over = lambda name, own: own if metadata is None else F.coalesce(metadata[name], own)
    first = F.coalesce(F.get(facts, F.lit(0))["source_excerpt"], F.lit(""))
    return df.select(over("doc_id", doc_id).cast("string").alias("doc_id"), over("source_path", path).alias("source_path"), over("content_preview", F.substring(first, 1, most)).alias("preview"))


#: Fixed ids of the checks of model inputs and outputs: the field that each is about, and the severity of FAIL and of WARN
#: (none: no violation).
AI_CHECKS = {
    "prompt_input_validation": ("content_preview", "MEDIUM", "MEDIUM"),
    "structured_llm_output_enforcement": ("overall_verdict", "MEDIUM", "LOW"),
    "embedding_drift": ("extracted_facts.text", "HIGH", None),
    "langsmith_trace_schema_contracts": ("id", "HIGH", "MEDIUM"),
}


def ai_violations(checks: DataFrame) -> DataFrame:
    """(check_id, field_name, status, severity, records_failing, message): a violation for each of (name, status, failing,
    detail) of AI_CHECKS that failed or warns, but for drift, which must have failed and counts as one record."""
    rules = checks.sparkSession.createDataFrame(
        [(name, field, status, severity) for name, (field, *both) in AI_CHECKS.items() for status, severity in zip(("FAIL", "WARN"), both, strict=True) if severity], "name string, field_name string, status string, severity string"
    )
    n = F.when(F.col("name") == "embedding_drift", 1).otherwise(F.col("failing")).cast("long")
    found = checks.join(F.broadcast(rules), ["name", "status"])
    return found.select(F.concat(F.lit("ai."), "name").alias("check_id"), "field_name", "status", "severity", n.alias("records_failing"), F.concat_ws(": ", "name", "detail").alias("message"))


def combined_status(checks: DataFrame) -> DataFrame:
    """(total, passed, status) of check results (status): SKIPPED without any, FAIL before WARN before PASS."""
    bad, warned = F.count_if(F.col("status").isin("FAIL", "ERROR")), F.count_if(F.col("status") == "WARN")
    word = F.when(F.count(F.lit(1)) == 0, "SKIPPED").when(bad > 0, "FAIL").when(warned > 0, "WARN").otherwise("PASS")
    return checks.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"), word.alias("status"))


def trace_contract(traces: DataFrame, results: DataFrame) -> DataFrame:
    """The combined status of a trace dataset's check results; SKIPPED where there are no traces."""
    some = traces.limit(1).agg((F.count(F.lit(1)) > 0).alias("some"))
    return combined_status(results.join(some).where("some"))


def classify_producer(rules: list[tuple[str, Column]], other: str = "other") -> Column:
    """The first rule that holds names the producer."""
    out = F.lit(other)
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out
