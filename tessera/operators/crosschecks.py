"""Checks across records and tables for the known kinds of dataset: intents, verdicts, extractions, lineage, events, traces.

Conditions on single records are compiled into one aggregation like any contract; those against files, hashes, schemas
and groups are joins. Typed schemas are expected (arrays of structs, maps of structs).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import absent
from tessera.functions.text import instant
from tessera.operators.checks import RESULT, broken_sequences
from tessera.plans import catalogue

# Kinds of dataset and the words that name them, the first that fits wins.
KINDS = (("extractions", ("extract",)), ("events", ("event",)), ("lineage", ("lineage",)), ("verdicts", ("verdict",)), ("traces", ("trace",)), ("intents", ("intent",)))
RUN_TYPES = ["llm", "chain", "tool", "retriever", "embedding"]


def kind_of(name: str) -> str:
    """The kind of dataset that a source or contract id speaks of; generic if none."""
    return next((kind for kind, words in KINDS if any(w in name.lower() for w in words)), "generic")


def counted(df: DataFrame, rules: Mapping[str, tuple[str, Column]], column: str = "") -> DataFrame:
    """Check results of (severity, failing number of a record) by check id, all in one pass. Null counts as none."""
    agg = df.agg(*[F.coalesce(F.sum(F.coalesce(n.cast("long"), F.lit(0))), F.lit(0)).cast("long").alias(f"n{i}") for i, (_, n) in enumerate(rules.values())])
    rows = []
    for i, (name, (severity, _)) in enumerate(rules.items()):
        n = F.col(f"n{i}")
        status = F.when(n > 0, "WARN" if severity == "MEDIUM" else "FAIL").otherwise("PASS")
        rows.append(F.struct(F.lit(name).alias("check_id"), F.lit("cross_record").alias("check_type"), F.lit(column).alias("column_name"), status.alias("status"), F.lit(severity).alias("severity"), F.lit("none").alias("expected"), n.cast("string").alias("actual_value"), n.alias("records_failing"), F.concat(F.lit(f"{name}: "), n.cast("string"), F.lit(" failing")).alias("message")))
    return agg.select(F.inline(F.array(*rows)))


def _bad(c: Column) -> Column:
    """1 where a condition fails or can't be told."""
    return F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)


def _each(arr: str, f) -> Column:
    return F.aggregate(F.coalesce(F.col(arr), F.array()), F.lit(0), lambda s, x: s + f(x))


def _rows(check_id: str, severity: str, failing: DataFrame) -> DataFrame:
    return counted(failing, {check_id: (severity, F.lit(1))})


def intents(df: DataFrame, files: DataFrame) -> DataFrame:
    """code_refs are there, name existing files (``files``: path), have sound lines and confidences of 0 to 1."""
    ref = lambda f: F.aggregate("code_refs", F.lit(0), lambda s, x: s + f(x))
    rules = {
        "week1.code_refs_non_empty": ("HIGH", _bad(F.size("code_refs") > 0)),
        "week1.code_ref_line_bounds": ("HIGH", ref(lambda x: _bad((x["line_start"] >= 1) & (x["line_end"] >= x["line_start"])))),
        "week1.code_ref_confidence_scale": ("CRITICAL", ref(lambda x: _bad(x["confidence"].between(0, 1)))),
    }
    named = df.select(F.explode("code_refs.file").alias("path"))
    unsafe = F.col("path").isNull() | F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    missing = named.where(unsafe).unionByName(named.where(~unsafe).join(files.select("path").distinct(), "path", "left_anti"))
    return counted(df, rules, "code_refs").unionByName(_rows("week1.code_ref_file_present", "HIGH", missing))


def verdicts(df: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rubrics are known by hash (``hashes``: sha256), scores are 1 to 5, and the overall score is their weighted mean
    to three places."""
    v = F.map_values("scores")
    weight = lambda x: F.when(x["weight"] > 0, x["weight"]).otherwise(1.0)
    add = lambda f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
    mean = add(lambda x: x["score"].cast("double") * weight(x)) / F.nullif(add(weight), F.lit(0.0))
    rules = {
        "week2.score_range_valid": ("CRITICAL", F.aggregate(v, F.lit(0), lambda s, x: s + _bad(x["score"].cast("double").isin([1.0, 2.0, 3.0, 4.0, 5.0])))),
        "week2.overall_score_weighted_mean": ("CRITICAL", _bad(F.round(mean, 3) == F.round(F.col("overall_score"), 3))),
    }
    unknown = df.join(hashes.select(F.col("sha256").alias("rubric_id")).distinct(), "rubric_id", "left_anti")
    return counted(df, rules, "scores").unionByName(_rows("week2.rubric_hash_exists", "HIGH", unknown))


def extractions(df: DataFrame, rules_hash: str | None) -> DataFrame:
    """Facts refer to entities of their record, each missing reference counts, and the rules are the current ones.

    Without a reference hash that check is an ERROR for all rows; rows without a hash are skipped.
    """
    ids = F.transform("entities", lambda e: e["entity_id"])
    wanted = F.flatten(F.transform("extracted_facts", lambda f: F.coalesce(f["entity_refs"], F.array())))
    missing = F.coalesce(absent(wanted, F.filter(ids, lambda x: x.isNotNull())), F.lit(0))
    out = counted(df, {"week3.entity_refs_exist": ("HIGH", missing), "week3.extraction_rules_hash_exists": ("HIGH", F.lit(1) if rules_hash is None else F.when(F.col("extraction_rules_hash") != rules_hash, 1).otherwise(0))})
    if rules_hash is None:
        return out.withColumn("status", F.when(F.col("check_id").endswith("hash_exists"), "ERROR").otherwise(F.col("status")))
    return out


def lineage(df: DataFrame) -> DataFrame:
    """Both ends of each edge are nodes of the same snapshot."""
    ids = F.transform("nodes", lambda n: n["node_id"])
    ends = F.flatten(F.transform("edges", lambda e: F.array(e["source"], e["target"])))
    return counted(df, {"week4.edges_reference_nodes": ("CRITICAL", F.coalesce(absent(ends, F.filter(ids, lambda x: x.isNotNull())), F.lit(0)))}, "edges")


def events(df: DataFrame, schemas: DataFrame | None = None, error: Column | None = None) -> DataFrame:
    """Records aren't recorded before they occur, sequences of an aggregate are contiguous, and payloads have a schema.

    ``schemas``: (event_type, schema_version) of known ones; ``error``: what is wrong with a payload, null if nothing.
    """
    out = counted(df, {"week5.recorded_after_occurred": ("CRITICAL", _bad(instant(F.col("recorded_at")) >= instant(F.col("occurred_at"))))})
    numbers = df.withColumn("sequence_number", F.coalesce("sequence_number", F.lit(0)))
    out = out.unionByName(_rows("week5.sequence_monotonic", "CRITICAL", broken_sequences(numbers, ["aggregate_id"], "sequence_number")))
    if schemas is None:
        return out
    known = schemas.select("event_type", "schema_version").distinct().withColumn("__known", F.lit(True))
    bad = df.join(known, ["event_type", "schema_version"], "left").where(F.col("__known").isNull() | (F.lit(False) if error is None else error.isNotNull()))
    return out.unionByName(_rows("week5.payload_matches_schema", "HIGH", bad))


def traces(df: DataFrame) -> DataFrame:
    """Runs end after they start, token counts add up, run types are known and costs aren't negative."""
    rules = {
        "traces.end_after_start": ("CRITICAL", _bad(instant(F.col("end_time")) > instant(F.col("start_time")))),
        "traces.total_tokens_add_up": ("CRITICAL", _bad(F.col("total_tokens") == F.col("prompt_tokens") + F.col("completion_tokens"))),
        "traces.run_type_allowed": ("HIGH", _bad(F.lower(F.trim("run_type")).isin(RUN_TYPES))),
        "traces.total_cost_non_negative": ("CRITICAL", _bad(F.coalesce(F.col("total_cost").cast("string").try_cast("double"), F.lit(-1.0)) >= 0)),
    }
    return counted(df, rules)


def producer_of(rules: Mapping[str, Mapping[str, Sequence[str]]], late: Sequence[str], tags: bool = True) -> Column:
    """Which producer a trace comes from: by tag in the order of ``rules``; else by JSON paths that inputs and outputs
    have, by name, and by what an error text holds, each in the order of ``late``; else other.

    ``rules``: producer to tags, paths, names, fragments. Paths begin with inputs. or outputs., which hold JSON. Tags and
    names count without their case and the blanks around them.
    """
    def has_path(p: str) -> Column:
        head, _, rest = p.partition(".")
        return F.get_json_object(F.col(head), "$." + rest).isNotNull()

    def any_of(conditions: list[Column]) -> Column:
        out = F.lit(False)
        for c in conditions:
            out = out | F.coalesce(c, F.lit(False))
        return out

    out = F
    if tags:
        for name, r in rules.items():
            out = out.when(F.coalesce(F.exists("tags", lambda t: F.lower(F.trim(t)).isin([x.lower() for x in r["tags"]])), F.lit(False)), name)
    signals = (
        lambda r: any_of([has_path(p) for p in r["paths"]]),
        lambda r: F.coalesce(F.lower(F.trim("name")).isin([n.lower() for n in r["names"]]), F.lit(False)),
        lambda r: any_of([F.contains(F.lower("error"), F.lit(f.lower())) for f in r["fragments"]]),
    )
    for signal in signals:
        for name in late:
            out = out.when(signal(rules[name]), name)
    return out.otherwise("other")


def producers(df: DataFrame, rules: Mapping[str, Mapping[str, Sequence[str]]] | None = None, late: Sequence[str] | None = None) -> DataFrame:
    """How many rows have no producer, and how many of each have no signal of it but a tag; without ``rules``, by those
    of ``catalogue.producer_rules``, the last of which comes first where no tag tells."""
    rules = catalogue.producer_rules() if rules is None else rules
    late = list(reversed(rules)) if late is None else late
    who = producer_of(rules, late)
    checks = {"traces.producer_classification.coverage": ("MEDIUM", F.when(who == "other", 1).otherwise(0))}
    for name in rules:
        alone = producer_of({name: rules[name]}, [name], tags=False)
        checks[f"traces.{name}.row_shape"] = ("HIGH", F.when((who == name) & (alone == "other"), 1).otherwise(0))
    return counted(df, checks)


__all__ = ["RESULT", "counted", "events", "extractions", "intents", "kind_of", "lineage", "producer_of", "producers", "traces", "verdicts"]
