"""Queries over the driver's tables, one for each operator of the contract engine, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import adapter, checks, crosschecks, evolution, ingest, jsonschema, lineage, migration, payloads, profile, raw, renames, reporting, sketches, whatif
from tessera.plans.contract import Clause, Contract, FieldRule
from tessera.sources import flatten, records, store
from tessera.sources.shared import folder
from tessera.streaming.status import latest_statuses, statuses
from tessera.streaming.watch import latest_results, sequences, watch, windowed_failures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcome(df: DataFrame, contract: Contract) -> DataFrame:
    return checks.evaluate(df, contract).select("check_id", "status", "severity", "records_failing")


def _rows(*parts: tuple[str, str, str, str]) -> str:
    """SQL of check results: (id, severity, failing count, table)."""
    one = "SELECT '{0}' AS check_id, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, '{1}' AS severity, n::BIGINT AS records_failing FROM (SELECT {2} AS n FROM {3})"
    return " UNION ALL ".join(one.format(*p) for p in parts)


def _fields(**rules: FieldRule) -> Contract:
    return Contract("t", fields=rules)


def _clause(id: str, severity: str = "error", **rule) -> Contract:
    return Contract("t", clauses=[Clause(id, rule, severity)])


LINEITEM = Contract(
    "lineitem",
    fields={
        "l_orderkey": FieldRule("integer", True), "l_discount": FieldRule("number", True, minimum=0.0, maximum=0.08), "l_tax": FieldRule("number", minimum=0.0, maximum=0.08),
        "l_returnflag": FieldRule("string", enum=["A", "N"]), "l_linestatus": FieldRule("string", enum=["O", "F"]), "l_quantity": FieldRule("number", True, minimum=1, maximum=50),
    },
    clauses=[Clause("lines.contiguous", {"type": "group_monotonic", "group_by": ["l_orderkey"], "field": "l_linenumber"}, "warn"), Clause("price.positive", {"type": "numeric_range", "field": "l_extendedprice", "minimum": 0})],
)
_CONTIGUOUS = "(SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(l_linenumber) AND count(DISTINCT l_linenumber) = count(l_linenumber)))"
_LINEITEM_SQL = _rows(
    ("l_discount.range", "CRITICAL", "count(*) FILTER (l_discount < 0) + count(*) FILTER (l_discount > 0.08::DOUBLE)", "lineitem"), ("l_discount.required", "CRITICAL", "count(*) - count(l_discount)", "lineitem"), ("l_discount.type", "CRITICAL", "0", "(SELECT 1)"),
    ("l_linestatus.enum", "HIGH", "count(*) FILTER (l_linestatus NOT IN ('O', 'F'))", "lineitem"), ("l_linestatus.type", "CRITICAL", "0", "(SELECT 1)"), ("l_orderkey.required", "CRITICAL", "count(*) - count(l_orderkey)", "lineitem"), ("l_orderkey.type", "CRITICAL", "0", "(SELECT 1)"),
    ("l_quantity.range", "CRITICAL", "count(*) FILTER (l_quantity < 1) + count(*) FILTER (l_quantity > 50)", "lineitem"), ("l_quantity.required", "CRITICAL", "count(*) - count(l_quantity)", "lineitem"), ("l_quantity.type", "CRITICAL", "0", "(SELECT 1)"),
    ("l_returnflag.enum", "HIGH", "count(*) FILTER (l_returnflag NOT IN ('A', 'N'))", "lineitem"), ("l_returnflag.type", "CRITICAL", "0", "(SELECT 1)"), ("l_tax.range", "CRITICAL", "count(*) FILTER (l_tax < 0) + count(*) FILTER (l_tax > 0.08::DOUBLE)", "lineitem"), ("l_tax.type", "CRITICAL", "0", "(SELECT 1)"),
    ("lines.contiguous", "WARNING", "count(*)", _CONTIGUOUS), ("price.positive", "CRITICAL", "count(*) FILTER (l_extendedprice < 0)", "lineitem"),
)


@query(_LINEITEM_SQL)
def validate_lineitem(spark, sf_dir):
    """Every check of a whole contract in one aggregation, and one grouping for contiguity."""
    return outcome(table(spark, sf_dir, "lineitem"), LINEITEM)


FLAGSHIP = validate_lineitem


@query(_rows(("c_custkey.required", "CRITICAL", "count(*) - count(c_custkey)", "customer"), ("c_name.required", "CRITICAL", "count(*) - count(c_name)", "customer")))
def field_required(spark, sf_dir):
    return outcome(table(spark, sf_dir, "customer"), _fields(c_custkey=FieldRule(required=True), c_name=FieldRule(required=True)))


@query(_rows(("value.type", "CRITICAL", "count(value)", "events"), ("user_id.type", "CRITICAL", "0", "(SELECT 1)"), ("event_type.type", "CRITICAL", "0", "(SELECT 1)")))
def field_type(spark, sf_dir):
    """A number where an integer is due fails; an integer where a number is due doesn't."""
    return outcome(table(spark, sf_dir, "events"), _fields(value=FieldRule("integer"), user_id=FieldRule("number"), event_type=FieldRule("string")))


@query(_rows(("o_orderstatus.enum", "HIGH", "count(*) FILTER (o_orderstatus NOT IN ('O', 'F'))", "orders")))
def field_enum(spark, sf_dir):
    return outcome(table(spark, sf_dir, "orders"), _fields(o_orderstatus=FieldRule(enum=["O", "F"])))


@query(_rows(("id.format", "HIGH", "count(*) FILTER (NOT regexp_matches(id, '^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'))", "(SELECT substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS id FROM (SELECT md5(event_id::VARCHAR) AS m FROM events))")))
def field_format_uuid(spark, sf_dir):
    m = F.md5(F.col("event_id").cast("string"))
    ids = table(spark, sf_dir, "events").select(F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("id"))
    return outcome(ids, _fields(id=FieldRule(format="uuid")))


@query(_rows(("p_brand.pattern", "HIGH", "count(*) FILTER (NOT regexp_matches(p_brand, '^(?:Brand#[1-3])'))", "part")))
def field_pattern(spark, sf_dir):
    return outcome(table(spark, sf_dir, "part"), _fields(p_brand=FieldRule(pattern="Brand#[1-3]")))


@query(_rows(("c_acctbal.range", "CRITICAL", "count(*) FILTER (c_acctbal < 0) + count(*) FILTER (c_acctbal > 9000)", "customer")))
def field_range(spark, sf_dir):
    return outcome(table(spark, sf_dir, "customer"), _fields(c_acctbal=FieldRule(minimum=0, maximum=9000)))


@query("SELECT 'gone.' || k AS check_id, CASE WHEN k = 'required' THEN 'FAIL' ELSE 'ERROR' END AS status, s AS severity, n FROM (SELECT count(*)::BIGINT AS n FROM region), (VALUES ('required', 'CRITICAL'), ('enum', 'HIGH'), ('format', 'HIGH'), ('pattern', 'HIGH'), ('range', 'CRITICAL')) v(k, s)".replace(", n FROM", ", n AS records_failing FROM"))
def missing_column_error(spark, sf_dir):
    return outcome(table(spark, sf_dir, "region"), _fields(gone=FieldRule("string", True, "uuid", "x", 0, 1, ["a"])))


@query(_rows(("c", "CRITICAL", "count(*) FILTER (coalesce(len(embedding), -1) < 65)", "embeddings")))
def array_min_items(spark, sf_dir):
    return outcome(table(spark, sf_dir, "embeddings"), _clause("c", type="array_min_items", field="embedding", minimum=65))


@query(_rows(("c", "CRITICAL", "count(*) FILTER (len(list_filter(embedding, lambda x: x < -0.3::DOUBLE)) > 0)", "embeddings")).replace("count(*) FILTER (len(list_filter(embedding, lambda x: x < -0.3::DOUBLE)) > 0)", "sum(len(list_filter(embedding, lambda x: x::DOUBLE < -0.3::DOUBLE)) + len(list_filter(embedding, lambda x: x::DOUBLE > 0.3::DOUBLE)))"))
def nested_range(spark, sf_dir):
    """Values inside arrays, counted within their record."""
    return outcome(table(spark, sf_dir, "embeddings"), _clause("c", type="numeric_range", field="embedding", minimum=-0.3, maximum=0.3))


@query(_rows(("c", "WARNING", "count(*) FILTER (length(text) < 200)", "documents")))
def string_length(spark, sf_dir):
    return outcome(table(spark, sf_dir, "documents"), _clause("c", "warn", type="string_length", field="text", minimum=200))


@query(_rows(("c", "CRITICAL", "count(*) FILTER (l_discount > 0.05::DOUBLE) + count(*) FILTER (l_tax > 0.05::DOUBLE)", "lineitem")))
def multi_field_range(spark, sf_dir):
    return outcome(table(spark, sf_dir, "lineitem"), _clause("c", type="multi_field_numeric_range", fields=["l_discount", "l_tax"], maximum=0.05))


@query(_rows(("c", "CRITICAL", "count(*) FILTER (NOT coalesce(o_orderdate < l_shipdate, false))", "lineitem JOIN orders ON l_orderkey = o_orderkey")))
def temporal_order(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return outcome(j, _clause("c", type="temporal_order", left="o_orderdate", right="l_shipdate", operator="<"))


@query(_rows(("c", "CRITICAL", "count(*)", "(SELECT 1 FROM (SELECT conv_id, turn + 1 AS t FROM conversations) GROUP BY conv_id HAVING NOT (min(t) = 1 AND max(t) = count(t) AND count(DISTINCT t) = count(t)))")))
def group_contiguous(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("t"))
    return outcome(c, _clause("c", type="group_monotonic", group_by=["conv_id"], field="t"))


@query(_rows(("c", "CRITICAL", "count(*) FILTER (event_type = 'purchase' AND (value IS NULL OR value < 10 OR value > 90))", "events")))
def conditional_range(spark, sf_dir):
    return outcome(table(spark, sf_dir, "events"), _clause("c", type="conditional_numeric_range", field="value", minimum=10, maximum=90, when={"field": "event_type", "equals": "purchase"}))


@query(_rows(("c", "CRITICAL", "count(*) FILTER (o_orderstatus IN ('O', 'P') AND NOT coalesce(regexp_matches(o_orderpriority, '^(?:[1-3]-)'), false))", "orders")))
def conditional_pattern(spark, sf_dir):
    return outcome(table(spark, sf_dir, "orders"), _clause("c", type="conditional_pattern", field="o_orderpriority", pattern="[1-3]-", when={"field": "o_orderstatus", "in": ["O", "P"]}))


@query(_rows(("c", "CRITICAL", "count(*) FILTER (NOT coalesce(abs(m - w) <= 5000, false))", "(SELECT avg(l_extendedprice) AS m, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS w FROM lineitem GROUP BY l_orderkey)")))
def weighted_mean_equals(spark, sf_dir):
    lines = F.collect_list(F.struct(F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("weight")))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"), F.avg("l_extendedprice").alias("m"))
    return outcome(g, _clause("c", type="weighted_mean_equals", map_field="lines", output="m", tolerance=5000))


@query(_rows(("c", "CRITICAL", "count(*) FILTER (NOT coalesce(abs(l_discount + l_tax - 0.1::DOUBLE) <= 0.05::DOUBLE, false))", "lineitem")))
def sum_equals(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_discount", "l_tax", F.lit(0.1).alias("whole"))
    return outcome(d, _clause("c", type="sum_equals", parts=["l_discount", "l_tax"], output="whole", tolerance=0.05))


@query(_rows(("c", "CRITICAL", "sum(CASE WHEN a NOT IN (SELECT unnest(ids)) THEN 1 ELSE 0 END + CASE WHEN b NOT IN (SELECT unnest(ids)) THEN 1 ELSE 0 END)", "(SELECT n_nationkey AS a, n_regionkey + 100 AS b FROM nation), (SELECT list(n_nationkey) AS ids FROM nation)")).replace("a NOT IN (SELECT unnest(ids))", "NOT list_contains(ids, a)").replace("b NOT IN (SELECT unnest(ids))", "NOT list_contains(ids, b)"))
def edge_endpoints_exist(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    snapshot = n.agg(F.collect_list(F.struct(F.col("n_nationkey").alias("node_id"))).alias("nodes"), F.collect_list(F.struct(F.col("n_nationkey").alias("source"), (F.col("n_regionkey") + 100).alias("target"))).alias("edges"))
    return outcome(snapshot, _clause("c", type="edge_endpoints_exist"))


@query("SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1")
def reference_exists(spark, sf_dir):
    """Anti-join against a reference table."""
    part = table(spark, sf_dir, "part").where("p_size <= 25")
    return checks.missing_references(table(spark, sf_dir, "lineitem"), "l_partkey", part, "p_partkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_discount > 0.08::DOUBLE ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5")
def sample_failures(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return checks.sample_failures(d, LINEITEM, "l_discount.range", "k").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


_STATS = " UNION ALL ".join(f"SELECT '{c}' AS path, count({c})::BIGINT AS n, min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS stddev FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"))


@query(_STATS)
def numeric_profile(spark, sf_dir):
    s = profile.numeric_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
    return s.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query(" UNION ALL ".join(f"SELECT '{c}' AS path, count({c})::BIGINT AS observed, (count(*) - count({c}))::BIGINT AS nulls, count(DISTINCT {c})::BIGINT AS cardinality, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM orders ORDER BY v LIMIT 5)) AS samples FROM orders" for c in ("o_orderstatus", "o_orderpriority")))
def string_profile(spark, sf_dir):
    found = profile.field_profile(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return found.withColumn("samples", F.array_join("samples", "|"))


@query("SELECT c AS field, e AS enum FROM (SELECT 'c_mktsegment' AS c, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS e, count(DISTINCT c_mktsegment) AS n FROM customer) WHERE n <= 5")
def enum_inference(spark, sf_dir):
    """Fields of at most five short values become enumerations."""
    c = profile.infer_contract(table(spark, sf_dir, "customer"), "customer")
    return spark.createDataFrame([(n, "|".join(sorted(r.enum))) for n, r in c.fields.items() if r.enum], "field string, enum string")


@query("WITH m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS t FROM events), b AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events, m WHERE ts < t), n AS (SELECT avg(value) + 40 AS m FROM events, m WHERE ts >= t) SELECT 'value' AS path, round(abs(n.m - b.m) / greatest(b.s, 1e-9::DOUBLE), 6) AS z, CASE WHEN abs(n.m - b.m) / greatest(b.s, 1e-9::DOUBLE) > 3 THEN 'FAIL' WHEN abs(n.m - b.m) / greatest(b.s, 1e-9::DOUBLE) > 2 THEN 'WARN' ELSE 'PASS' END AS status FROM b, n")
def drift_zscore(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    half = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("t"))
    e = e.join(half)
    base = profile.numeric_profile(e.where("ts < t").select("value"), ["value"])
    now = profile.numeric_profile(e.where("ts >= t").select((F.col("value") + 40).alias("value")), ["value"])
    return profile.drift(now, base).select("path", F.round("z", 6).alias("z"), "status")


@query("SELECT path, round(m, 6) AS mean FROM (SELECT 'quality' AS path, avg(quality) AS m FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels UNION ALL SELECT 'l_linenumber', avg(l_linenumber) FROM lineitem) WHERE m > 0.99 OR m < 0.01")
def suspicious_distribution(spark, sf_dir):
    s = profile.numeric_profile(table(spark, sf_dir, "labels"), ["quality", "toxic"]).unionByName(profile.numeric_profile(table(spark, sf_dir, "lineitem"), ["l_linenumber"]))
    return profile.suspicious(s).select("path", F.round("mean", 6).alias("mean"))


@query(f"WITH r AS ({_LINEITEM_SQL}) SELECT count(*)::BIGINT AS total, count(*) FILTER (status = 'PASS')::BIGINT AS passed, count(*) FILTER (status = 'FAIL')::BIGINT AS failed, 0::BIGINT AS warned, 0::BIGINT AS errored, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status FROM r")
def status_summary(spark, sf_dir):
    return checks.summary(checks.evaluate(table(spark, sf_dir, "lineitem"), LINEITEM))


@query(f"WITH r AS ({_LINEITEM_SQL}) SELECT 'AUDIT' AS mode, false AS blocking UNION ALL SELECT 'WARN', bool_or(status = 'FAIL' AND severity = 'CRITICAL') FROM r UNION ALL SELECT 'ENFORCE', bool_or(status = 'FAIL' AND severity IN ('CRITICAL', 'HIGH')) FROM r")
def gate_modes(spark, sf_dir):
    return checks.gates(checks.evaluate(table(spark, sf_dir, "lineitem"), LINEITEM))


@query(f"WITH r AS ({_LINEITEM_SQL}), t AS (SELECT count(*)::BIGINT AS total, count(*) FILTER (status = 'PASS')::BIGINT AS passed, count(*) FILTER (status = 'FAIL')::BIGINT AS failed, 0::BIGINT AS warned, count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL')::BIGINT AS critical FROM r) SELECT *, greatest(0, least(100, floor(passed * 100.0::DOUBLE / total) - 20 * critical))::INTEGER AS health FROM t")
def health_score(spark, sf_dir):
    return reporting.totals(checks.evaluate(table(spark, sf_dir, "lineitem"), LINEITEM))


@query(f"WITH r AS ({_LINEITEM_SQL}) SELECT count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL')::BIGINT AS critical, count(*) FILTER (status = 'FAIL' AND severity = 'HIGH')::BIGINT AS high, 0::BIGINT AS medium, 0::BIGINT AS low FROM r")
def severity_histogram(spark, sf_dir):
    return reporting.severity_histogram(checks.evaluate(table(spark, sf_dir, "lineitem"), LINEITEM))


def _violations(spark, sf_dir):
    """Violations made of events: four severities by user, a check by type."""
    sev = F.get(F.array(*[F.lit(s) for s in reporting.SEVERITIES]), F.pmod("user_id", F.lit(4)).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("check_id"), F.concat(F.lit("f"), F.pmod("user_id", F.lit(7)).cast("string")).alias("field"), F.lit("FAIL").alias("status"), sev.alias("severity"), F.floor("value").cast("long").alias("records_failing"), F.col("event_id").alias("seq"), F.pmod("event_id", F.lit(3)).cast("int").alias("depth"), F.concat(F.lit("s"), F.pmod("event_id", F.lit(5)).cast("string")).alias("system"), F.col("props").alias("message"))


_VIOLATIONS = "v AS (SELECT event_type AS check_id, 'f' || user_id % 7 AS field, 'FAIL' AS status, (['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'])[user_id % 4 + 1] AS severity, (4 - user_id % 4) AS rank, floor(value)::BIGINT AS records_failing, event_id AS seq, (event_id % 3)::INTEGER AS depth, 's' || event_id % 5 AS system, props AS message FROM events)"


@query(f"WITH {_VIOLATIONS} SELECT check_id, field, severity, records_failing, seq FROM v QUALIFY row_number() OVER (PARTITION BY check_id, field, status ORDER BY rank DESC, records_failing DESC, seq) = 1")
def dedupe_violations(spark, sf_dir):
    return reporting.deduplicated(_violations(spark, sf_dir)).select("check_id", "field", "severity", "records_failing", "seq")


@query(f"WITH {_VIOLATIONS} SELECT check_id, field, severity, records_failing, seq FROM v ORDER BY rank DESC, records_failing DESC, seq LIMIT 3")
def top_failures(spark, sf_dir):
    return reporting.top(_violations(spark, sf_dir)).select("check_id", "field", "severity", "records_failing", "seq")


@query(f"WITH {_VIOLATIONS} SELECT field, max(depth) AS max_depth, sum(records_failing)::BIGINT AS records, count(*)::BIGINT AS violations, string_agg(DISTINCT system, ',' ORDER BY system) AS systems FROM v GROUP BY field")
def blast_radius_by_field(spark, sf_dir):
    return reporting.radius_by_field(_violations(spark, sf_dir))


@query(f"WITH {_VIOLATIONS} SELECT seq FROM v WHERE severity = 'HIGH' AND contains(lower(message), '\"k\": 7')")
def search_filter(spark, sf_dir):
    return reporting.search(_violations(spark, sf_dir), "high", '"K": 7').select("seq")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.event_type")


@query("SELECT o_custkey, o_orderkey, days, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY confidence DESC, hops, path) AS rank FROM (SELECT *, greatest(0.0::DOUBLE, round((1.0::DOUBLE - days * 0.1::DOUBLE) - hops * 0.2::DOUBLE, 2)) AS confidence FROM (SELECT o_custkey, o_orderkey, o_orderkey::VARCHAR AS path, (o_orderkey % 9)::INTEGER AS days, (o_orderkey % 3)::INTEGER AS hops FROM orders))) WHERE rank <= 5")
def blame_rank(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("path"), F.pmod("o_orderkey", F.lit(9)).cast("int").alias("days"), F.pmod("o_orderkey", F.lit(3)).cast("int").alias("hops"))
    return lineage.ranked_blame(c, ["o_custkey"]).select("o_custkey", "o_orderkey", "days", "confidence", F.col("rank").cast("long").alias("rank"))


@query("SELECT * FROM (SELECT ts AS \"at\", 'event' AS kind, event_id AS ref FROM events UNION ALL SELECT o_orderdate, 'order', o_orderkey FROM orders) ORDER BY \"at\" DESC, kind, ref LIMIT 50")
def timeline_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.lit("event").alias("kind"), F.col("event_id").alias("ref"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("at"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("ref"))
    return reporting.timeline([e, o], 50)


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_number, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8)::BIGINT AS batch FROM events")
def sequence_assign(spark, sf_dir):
    e = ingest.numbered(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    return ingest.batched(e, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "sequence_number", "batch")


def _edges(spark, sf_dir):
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    key = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    return n.select(key("r", "n_regionkey").alias("source"), key("n", "n_nationkey").alias("target")).unionByName(s.select(key("n", "s_nationkey").alias("source"), key("s", "s_suppkey").alias("target"))).unionByName(c.select(key("n", "c_nationkey").alias("source"), key("c", "c_custkey").alias("target")))


_EDGES = "e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query(f"WITH RECURSIVE {_EDGES}, b AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS hops FROM region UNION SELECT start, target, hops + 1 FROM b JOIN e ON node = source) SELECT start, node, min(hops)::INTEGER AS hops FROM b WHERE node <> start GROUP BY ALL")
def lineage_bfs_downstream(spark, sf_dir):
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))
    return lineage.traverse(_edges(spark, sf_dir), starts)


@query(f"WITH RECURSIVE {_EDGES}, b AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0 AS hops FROM supplier UNION SELECT start, source, hops + 1 FROM b JOIN e ON node = target) SELECT start, node, min(hops)::INTEGER AS hops FROM b WHERE node <> start GROUP BY ALL")
def lineage_bfs_upstream(spark, sf_dir):
    starts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("start"))
    return lineage.traverse(_edges(spark, sf_dir), starts, backward=True)


@query(f"WITH {_EDGES}, r AS (SELECT target AS node, 1 AS hops FROM e WHERE source = 'r1' UNION SELECT b.target, 2 FROM e a JOIN e b ON a.target = b.source WHERE a.source = 'r1') SELECT node, hops, hops AS depth FROM r")
def contamination_depth(spark, sf_dir):
    """Direct subscribers at 1, what lies behind them deeper."""
    e = _edges(spark, sf_dir)
    reached = lineage.traverse(e.withColumn("relationship", F.lit("OF")), spark.createDataFrame([("r1",)], "start string"), paths=True)
    return lineage.contamination_depth(reached, e.where("source = 'r1'").select(F.col("target").alias("node"))).drop("start")


@query(f"WITH RECURSIVE {_EDGES}, b AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS hops, ['r' || r_regionkey] AS path FROM region UNION ALL SELECT start, target, hops + 1, list_append(path, target) FROM b JOIN e ON node = source) SELECT start, node, hops, array_to_string(path, '>') AS path, repeat('OF>', hops - 1) || 'OF' AS relationships FROM b WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY hops, path) = 1")
def lineage_paths(spark, sf_dir):
    """The shortest way to every node, and the relationships along it."""
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))
    out = lineage.traverse(_edges(spark, sf_dir).withColumn("relationship", F.lit("OF")), starts, paths=True)
    return out.select("start", "node", "hops", F.concat_ws(">", "path").alias("path"), F.concat_ws(">", "relationships").alias("relationships"))


def _nodes(spark, sf_dir):
    """Regions as datasets, nations as services, and suppliers as files of their nation's service."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("node_id"), F.lit("DATASET").alias("type"), F.concat(F.lit("outputs/"), F.lower("r_name"), F.lit("/records.jsonl")).alias("path"), F.concat(F.lower("r_name"), F.lit(" records")).alias("label"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("node_id"), F.lit("SERVICE").alias("type"), F.concat(key("services/n", "n_nationkey"), F.lit("/main.py")).alias("path"), F.col("n_name").alias("label"))
    s = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("node_id"), F.lit("FILE").alias("type"), F.concat(key("services/n", "s_nationkey"), key("/s", "s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "_price.py").otherwise(".py")).alias("path"), F.col("s_name").alias("label"))
    return r.unionByName(n).unionByName(s)


def _upstream(spark, sf_dir):
    """Services feed the dataset of their region."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("target"))


@query("SELECT 'r' || r_regionkey AS node_id FROM region WHERE lower(r_name) = (SELECT lower(r_name) FROM region WHERE r_regionkey = 1)")
def dataset_seeds(spark, sf_dir):
    """The dataset nodes that a source path speaks of."""
    name = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.lower("r_name")).first()[0]
    return lineage.dataset_seeds(_nodes(spark, sf_dir), f"elsewhere/{name}/records.csv", "none")


_PRODUCERS = "p AS (SELECT 'services/n' || s_nationkey || '/s' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '_price.py' ELSE '.py' END AS file_path, 2 AS hops, 'n' || s_nationkey AS service, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS token_matches FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)"


@query(f"WITH {_PRODUCERS} SELECT *, (row_number() OVER (ORDER BY token_matches DESC, hops, file_path))::INTEGER AS rank FROM p")
def upstream_producers(spark, sf_dir):
    """Files of the services upstream of a dataset, ranked for a failing field."""
    seeds = spark.createDataFrame([("r1",)], "node_id string")
    return lineage.upstream_producers(_upstream(spark, sf_dir), _nodes(spark, sf_dir), seeds, "lines.unit_price")


@query(f"WITH {_PRODUCERS}, h AS (SELECT file_path AS path, token_matches, hops, (length(file_path) % 12)::INTEGER AS days FROM p), c AS (SELECT path, days, hops, greatest(0.0::DOUBLE, round((1.0::DOUBLE - days * 0.1::DOUBLE) - hops * 0.2::DOUBLE, 2)) AS confidence FROM h) SELECT (row_number() OVER (ORDER BY confidence DESC, hops, path))::INTEGER AS rank, path, days, confidence FROM c ORDER BY rank LIMIT 5")
def blame_chain(spark, sf_dir):
    """From a failing field over the producers of its dataset to the last changes of their files."""
    producers = lineage.upstream_producers(_upstream(spark, sf_dir), _nodes(spark, sf_dir), spark.createDataFrame([("r1",)], "node_id string"), "lines.unit_price")
    path = F.col("path")
    files = _nodes(spark, sf_dir).where("type = 'FILE'")
    history = files.select("path", F.sha1("path").alias("commit"), F.lit("someone").alias("author"), F.date_format(F.date_sub(F.lit("2024-06-30").cast("date"), F.length(path) % 12), "yyyy-MM-dd'T'00:00:00").alias("committed_at"))
    return lineage.blame(producers, history, F.lit("2024-06-30").cast("date")).select("rank", "path", "days", "confidence")


@query("SELECT 'services/n' || s_nationkey || '/s' || s_suppkey || '_price.py' AS path FROM supplier WHERE s_suppkey % 3 = 0")
def candidate_files(spark, sf_dir):
    """Files that a field's name speaks of."""
    return lineage.candidate_files(_nodes(spark, sf_dir), "unit_price")


@query("WITH s AS (SELECT s_name AS node_id, CASE WHEN lower(s_name) = 'supplier#000000007' THEN 6 ELSE 0 END + 2 * len(list_intersect(list_distinct(regexp_extract_all(lower(s_name), '[a-z0-9]{3,}')), ['supplier', '000000007'])) + len(list_intersect(list_distinct(regexp_extract_all(lower(s_name), '[a-z0-9]{3,}')), ['supplier', '000000007'])) AS score FROM supplier) SELECT node_id, score::INTEGER AS score FROM s WHERE score >= (SELECT greatest(4, max(score) - 1) FROM s)")
def seed_match(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("node_id"), F.lit(None).cast("string").alias("path"), F.col("s_name").alias("label"))
    return lineage.match_seeds(nodes, "x/supplier_000000007.py".replace("_", " "), "Supplier#000000007")


@query("SELECT c_nationkey AS source, n_regionkey AS target, 'IN' AS relationship, max(greatest(0, least(1, c_acctbal / 10000.0::DOUBLE)))::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def edge_merge_max(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lineage.merged_edges(j.select(F.col("c_nationkey").alias("source"), F.col("n_regionkey").alias("target"), F.lit("IN").alias("relationship"), (F.col("c_acctbal") / 10000.0).alias("confidence")))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_SIZES = " UNION ALL ".join(f"SELECT '{c}' AS field, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM lineitem" for c in _MEASURES)
#: Old and new fields: l_discount in percent, l_tax gone, l_linenumber a number, l_quantity an integer, prices bounded by what was seen.
_CHANGED = f"""m AS ({_SIZES}), c AS (
  SELECT field, CASE
    WHEN field = 'l_discount' THEN CASE WHEN low >= 0 AND high <= 1 AND high * 100 > 1 THEN 'NUMERIC_SCALE_SHIFT' ELSE 'NO_CHANGE' END
    WHEN field = 'l_tax' THEN 'FIELD_REMOVED_OPTIONAL' WHEN field = 'l_linenumber' THEN 'TYPE_WIDENING' WHEN field = 'l_quantity' THEN 'TYPE_NARROWING'
    WHEN high < 100000 THEN 'RANGE_NARROWING' WHEN high > 100000 THEN 'RANGE_WIDENING' ELSE 'NO_CHANGE' END AS change_type FROM m
  UNION ALL SELECT 'added', 'FIELD_ADDED_REQUIRED')"""
_CLASSES = "(VALUES ('NUMERIC_SCALE_SHIFT', 'breaking', 'CRITICAL'), ('FIELD_REMOVED_OPTIONAL', 'forward', 'MEDIUM'), ('TYPE_WIDENING', 'backward', 'LOW'), ('TYPE_NARROWING', 'breaking', 'CRITICAL'), ('RANGE_NARROWING', 'breaking', 'HIGH'), ('RANGE_WIDENING', 'forward', 'LOW'), ('NO_CHANGE', 'backward', 'LOW'), ('FIELD_ADDED_REQUIRED', 'breaking', 'HIGH')) k(t, class, severity)"


def _field_tables(spark, sf_dir):
    """Fields of lineitem as measured, before and after a release that changes them."""
    d = table(spark, sf_dir, "lineitem")
    none, kind = F.lit(None).cast("double"), F.when(F.col("path") == "l_linenumber", "integer").otherwise("number")
    fields = lambda stats, kind, top: stats.select(F.col("path").alias("field"), kind.alias("type"), F.lit(False).alias("required"), none.alias("minimum"), top.alias("maximum"), F.lit(None).cast("array<string>").alias("enum"), F.col("minimum").alias("low"), F.col("maximum").alias("high"))
    priced = lambda value: F.when(F.col("path") == "l_extendedprice", value)
    old = fields(profile.numeric_profile(d, _MEASURES), kind, priced(F.lit(100000.0)))
    stats = profile.numeric_profile(d.withColumn("l_discount", F.round(F.col("l_discount") * 100, 6)).drop("l_tax"), [m for m in _MEASURES if m != "l_tax"])
    new = fields(stats, F.when(F.col("path") == "l_quantity", "integer").otherwise("number"), priced(F.col("maximum")))
    added = spark.createDataFrame([("added", "string", True, None, None, None, None, None)], evolution.FIELDS)
    return old, new.unionByName(added)


@query(f"WITH {_CHANGED} SELECT field AS field_name, change_type, class AS compatibility_class, severity FROM c JOIN {_CLASSES} ON t = change_type")
def schema_diff(spark, sf_dir):
    """Change kinds of fields whose bounds and statistics are measured."""
    return evolution.classify(*_field_tables(spark, sf_dir)).select("field_name", "change_type", "compatibility_class", "severity")


@query(f"WITH {_CHANGED} SELECT CASE WHEN bool_or(class = 'breaking') THEN 'breaking' ELSE 'backward' END AS verdict, count(*) FILTER (change_type <> 'NO_CHANGE')::BIGINT AS changes FROM c JOIN {_CLASSES} ON t = change_type")
def schema_verdict(spark, sf_dir):
    return evolution.verdict(evolution.classify(*_field_tables(spark, sf_dir)))


_REGISTRY = "r AS (SELECT 'c' || (p_partkey % 2) AS contract_id, p_brand AS subscriber_id, (['l_discount', 'l_quantity', 'l_linenumber', 'l_tax', 'added'])[p_size % 5 + 1] AS breaking_field FROM part)"


@query(f"WITH {_CHANGED}, {_REGISTRY} SELECT subscriber_id, breaking_field AS field_name, change_type FROM r JOIN c ON field = breaking_field JOIN {_CLASSES} ON t = change_type WHERE class = 'breaking' AND contract_id = 'c1'")
def change_notifications(spark, sf_dir):
    """Subscribers of a contract, made of parts, whose declared breaking fields have changed."""
    field = F.get(F.array(*[F.lit(f) for f in ("l_discount", "l_quantity", "l_linenumber", "l_tax", "added")]), (F.col("p_size") % 5).cast("int"))
    registry = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), (F.col("p_partkey") % 2).cast("string")).alias("contract_id"), F.col("p_brand").alias("subscriber_id"), field.alias("breaking_field"))
    return evolution.notifications(evolution.classify(*_field_tables(spark, sf_dir)), registry, "c1")


_PATHS = "s AS (SELECT DISTINCT p_brand AS subscriber_id, lower(p_type) || (['', '.s' || (p_size % 4), '.s' || (p_size % 4) || '.x'])[p_partkey % 3 + 1] AS field FROM part), f AS (SELECT DISTINCT lower(p_type) || '.s1' AS failing FROM part WHERE p_size % 10 = 1)"


@query(f"WITH {_PATHS} SELECT DISTINCT subscriber_id, field, failing FROM s JOIN f ON field = failing OR starts_with(failing, field || '.') OR starts_with(field, failing || '.')")
def registry_blast_radius(spark, sf_dir):
    """Subscriptions to part types, sizes and what lies below as field paths, and sizes that fail."""
    p, kind, size = table(spark, sf_dir, "part"), F.lower("p_type"), F.concat(F.lit(".s"), (F.col("p_size") % 4).cast("string"))
    field = F.concat(kind, F.get(F.array(F.lit(""), size, F.concat(size, F.lit(".x"))), (F.col("p_partkey") % 3).cast("int")))
    return evolution.blast_radius(p.select(F.col("p_brand").alias("subscriber_id"), field.alias("field")).distinct(), p.where("p_size % 10 = 1").select(F.concat(kind, F.lit(".s1")).alias("failing")).distinct())


_SUBSCRIBED = "s AS (SELECT DISTINCT 'r' || n_regionkey || '-v' || n_nationkey AS c, 'r' || (n_nationkey % 7) || '-app' AS u FROM nation)"


@query(f"WITH {_SUBSCRIBED} SELECT c AS source, u AS target, 'CONSUMED_BY' AS relationship FROM s UNION ALL SELECT a.u, b.c, 'PUBLISHES' FROM (SELECT DISTINCT u FROM s) a JOIN (SELECT DISTINCT c FROM s) b ON split_part(a.u, '-', 1) = split_part(b.c, '-', 1) AND a.u <> b.c")
def contract_graph(spark, sf_dir):
    """Edges of a registry made of nations, and those that names imply."""
    n = table(spark, sf_dir, "nation")
    text_of = lambda c: c.cast("string")
    contract = F.concat(F.lit("r"), text_of(F.col("n_regionkey")), F.lit("-v"), text_of(F.col("n_nationkey")))
    return lineage.contract_graph(n.select(contract.alias("contract_id"), F.concat(F.lit("r"), text_of(F.col("n_nationkey") % 7), F.lit("-app")).alias("subscriber_id")))



@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 100, 6) AS l_discount, l_tax AS rate, l_linenumber::DOUBLE AS n, CASE WHEN l_returnflag IN ('A', 'N') THEN 'X' ELSE l_returnflag END AS l_returnflag, 'v' AS added FROM lineitem")
def adapter_rules(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_linenumber"))
    rules = [{"type": "numeric_scaling", "field": "l_discount", "factor": 100}, {"type": "field_rename", "from": "l_tax", "to": "rate"}, {"type": "type_coercion", "field": "n", "to": "number"}, {"type": "enum_replace", "field": "l_returnflag", "values": ["A", "N"], "value": "X"}, {"type": "default_value", "field": "added", "value": "v"}, {"type": "remove_field", "field": "l_shipdate"}]
    return adapter.apply_rules(d, rules).select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "rate", "n", "l_returnflag", "added")


@query("SELECT v AS version, n FROM (SELECT (user_id % 3 + 1)::VARCHAR || '.0' AS v, count(*)::BIGINT AS n FROM events GROUP BY 1) ORDER BY n DESC, v LIMIT 1")
def version_majority(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat((F.col("user_id") % 3 + 1).cast("string"), F.lit(".0.7")).alias("schema_version"))
    return adapter.majority_version(adapter.version_normalize(e, "schema_version", 2))


def _what_if_sql(baseline: str, raw: str, adapted: str, verdict: str, advice: str, attempted: bool, applied: str, total: int = 1, of: str = "lineitem") -> str:
    """SQL of a simulation's rows from the failing records of each stage."""
    one = "SELECT '{0}' AS stage, {1}::BIGINT AS total, CASE WHEN {2} > 0 THEN 1 ELSE 0 END::BIGINT AS failed, CASE WHEN {2} > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status, '{3}' AS verdict, '{4}' AS recommendation, {5} AS attempted, {6}::BIGINT AS applied FROM b"
    b = f"WITH b AS (SELECT {baseline} AS f, {raw} AS g, {adapted} AS h, {applied} AS a FROM {of}) "
    return b + " UNION ALL ".join(one.format(s, total, k, verdict, advice, str(attempted).lower(), "a") for s, k in (("baseline", "f"), ("raw", "g"), ("adapted", "h")))


_OUT = "count(*) FILTER (l_discount < 0 OR l_discount > 1)"


@query(_what_if_sql(_OUT, "count(*) FILTER (round(l_discount * 100, 6) > 1)", _OUT, "BREAKING_BUT_ADAPTABLE", "deploy with the adapter and refresh baselines", True, "count(*) FILTER (round(l_discount * 100, 6) <> l_discount)"))
def whatif_scale_change(spark, sf_dir):
    """A producer sends percent instead of shares; scaling back repairs it."""
    c = _fields(l_discount=FieldRule(minimum=0, maximum=1))
    return whatif.what_if(table(spark, sf_dir, "lineitem"), c, {"change_type": "numeric_scale_change", "field": "l_discount", "factor": 100, "field_schema": {"minimum": 0.0, "maximum": 100.0}})


_FLAG = "count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R'))"


@query(_what_if_sql(_FLAG, _FLAG, _FLAG, "FORWARD_COMPATIBLE", "proceed and bump the version", False, "0"))
def whatif_enum_addition(spark, sf_dir):
    """A value more in an enumeration: old readers must be ready for it."""
    c = _fields(l_returnflag=FieldRule(enum=["A", "N", "R"]))
    return whatif.what_if(table(spark, sf_dir, "lineitem"), c, {"change_type": "enum_change", "field": "l_returnflag", "added_values": ["X"]})


@query(_what_if_sql("count(*) - count(l_orderkey)", "count(*) - count(l_orderkey)", "count(*) - count(l_orderkey)", "BREAKING_BUT_ADAPTABLE", "deploy with the adapter and refresh baselines", True, "count(*)"))
def whatif_required_addition(spark, sf_dir):
    """A new required field breaks the contract but not these records; dropping it adapts them."""
    c = _fields(l_orderkey=FieldRule(required=True))
    return whatif.what_if(table(spark, sf_dir, "lineitem"), c, {"change_type": "add_field", "field": "basis", "default_value": "none", "required": True})


@query(_what_if_sql("count(*) - count(l_tax)", "count(*)", "count(*)", "BREAKING_REQUIRES_MIGRATION", "hold until a migration plan is approved", True, "0"))
def whatif_removal(spark, sf_dir):
    """A required field goes and nothing brings it back."""
    c = _fields(l_tax=FieldRule(required=True))
    return whatif.what_if(table(spark, sf_dir, "lineitem"), c, {"change_type": "remove_field", "field": "l_tax"})


@query("SELECT 'n' || (n_nationkey % 3) AS subscriber_id, CASE WHEN n_nationkey % 3 = 0 THEN 'l_discount' ELSE 'l_tax' END AS fields FROM nation WHERE n_nationkey % 3 < 2 GROUP BY ALL")
def whatif_affected(spark, sf_dir):
    """Subscribers, made of nations, whose fields meet those of a diff."""
    subs = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), (F.col("n_nationkey") % 3).cast("string")).alias("subscriber_id"), F.get(F.array(F.lit("l_discount"), F.lit("l_tax"), F.lit("l_comment")), (F.col("n_nationkey") % 3).cast("int")).alias("field"), (F.col("n_nationkey") % 2 == 0).alias("is_breaking"))
    old = _fields(l_discount=FieldRule("number"), l_tax=FieldRule("number"), l_comment=FieldRule("string"))
    new = _fields(l_discount=FieldRule("string"), l_comment=FieldRule("string"))
    return whatif.affected(subs, evolution.classify(evolution.field_table(spark, old), evolution.field_table(spark, new)))


_DECLARED = r"(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)"


@query(rf"""WITH d AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'Float ' || l_suppkey || ' - ' || l_partkey WHEN 1 THEN 'int' WHEN 2 THEN 'between -' || l_suppkey || '.5-2' ELSE NULL END AS d, CASE l_linenumber % 3 WHEN 0 THEN 'x -> x * ' || l_suppkey WHEN 1 THEN 'X->x / ' || (l_suppkey % 3) ELSE 'y' END AS t FROM lineitem),
  p AS (SELECT lower(nullif(regexp_extract(d, '(?i)\b(int|integer|float|number|string|boolean)\b', 1), '')) AS k, nullif(regexp_extract(d, '{_DECLARED}', 1), '')::DOUBLE AS minimum, nullif(regexp_extract(d, '{_DECLARED}', 2), '')::DOUBLE AS maximum, nullif(regexp_extract(t, '(?i)x -> x \* (\d+)', 1), '')::DOUBLE AS m, nullif(regexp_extract(t, '(?i)x->x / (\d+)', 1), '')::DOUBLE AS v FROM d)
SELECT CASE k WHEN 'int' THEN 'integer' WHEN 'float' THEN 'number' ELSE k END AS type, minimum, maximum, round(coalesce(m, CASE WHEN v <> 0 THEN 1 / v END, 1), 6) AS factor, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def whatif_descriptors(spark, sf_dir):
    """Types, ranges and factors read from words, made of lines."""
    name = lambda c: F.col(c).cast("string")
    kind, third = F.col("l_linenumber") % 4, F.col("l_linenumber") % 3
    said = F.when(kind == 0, F.concat(F.lit("Float "), name("l_suppkey"), F.lit(" - "), name("l_partkey"))).when(kind == 1, "int").when(kind == 2, F.concat(F.lit("between -"), name("l_suppkey"), F.lit(".5-2")))
    turned = F.when(third == 0, F.concat(F.lit("x -> x * "), name("l_suppkey"))).when(third == 1, F.concat(F.lit("X->x / "), (F.col("l_suppkey") % 3).cast("string"))).otherwise("y")
    d = table(spark, sf_dir, "lineitem").select(whatif.descriptor(said).alias("d"), F.round(whatif.factor(turned), 6).alias("factor"))
    return d.groupBy("d", "factor").agg(F.count("*").alias("n")).select("d.*", "factor", "n")


@query(f"""WITH b AS (SELECT {_OUT} AS f, count(*) FILTER (round(l_discount * 100, 6) > 1) AS g, count(*) FILTER (round(l_discount * 100, 6) <> l_discount) AS a FROM lineitem)
SELECT 1 AS place, 'l_discount is multiplied by 100.0.' AS note UNION ALL SELECT 2, 'The comparison of the contracts is breaking.' UNION ALL SELECT 3, CASE WHEN f > 0 OR a = 0 AND g > 0 THEN 'The adapter was tried and doesn''t repair the records.' WHEN a > 0 THEN 'The adapter brings records back to the contract as it is.' ELSE 'Rules to go back are ready, though no record needed them.' END FROM b UNION ALL SELECT 4, '1 rules undo the change.'""")
def whatif_notes(spark, sf_dir):
    """What is to be said of a change of scale that comes as a written specification."""
    c = _fields(l_discount=FieldRule("number", minimum=0, maximum=1))
    return whatif.notes(table(spark, sf_dir, "lineitem"), c, whatif.specified({"change_type": "numeric_scale_change", "from_field": "l_discount", "sample_transform": "x -> x * 100", "from": "float 0.0-1.0", "to": "integer 0-100"}))


@query(f"""WITH {_EDGES}, h AS (SELECT target AS id, 1 AS hops, [] :: VARCHAR[] AS via FROM e WHERE source = 'r1' UNION ALL SELECT b.target, 2, [a.target] FROM e a JOIN e b ON a.target = b.source WHERE a.source = 'r1'),
  d AS (SELECT 'n' || n_nationkey AS subscriber_id, 'f' || (n_nationkey % 3) AS fields FROM nation WHERE n_nationkey % 2 = 0)
SELECT subscriber_id, fields, CASE WHEN id IS NOT NULL THEN 'n' END AS kind, CASE WHEN id IS NOT NULL THEN 'OF' END AS relationship, coalesce(hops - 1, 0)::INTEGER AS contamination_depth, array_to_string(via, '>') AS via, true AS is_direct FROM d LEFT JOIN h ON id = subscriber_id
UNION ALL SELECT id, NULL, substr(id, 1, 1), 'OF', (hops - 1)::INTEGER, array_to_string(via, '>'), false FROM h ANTI JOIN d ON id = subscriber_id""")
def whatif_lineage(spark, sf_dir):
    """Affected nations with their depth in the lineage of a region, and all else that it reaches."""
    key = F.col("n_nationkey").cast("string")
    direct = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), key).alias("subscriber_id"), F.concat(F.lit("f"), (F.col("n_nationkey") % 3).cast("string")).alias("fields"))
    reached = lineage.traverse(_edges(spark, sf_dir).withColumn("relationship", F.lit("OF")), spark.createDataFrame([("r1",)], "start string"), paths=True)
    entries = reached.select(F.col("node").alias("id"), F.substring("node", 1, 1).alias("kind"), F.lit("lineage_graph").alias("source"), F.element_at("relationships", -1).alias("relationship"), "hops", F.slice("path", F.lit(2), F.size("path") - 2).alias("via"))
    return whatif.enriched(direct, entries).select("subscriber_id", "fields", "kind", "relationship", "contamination_depth", F.array_join("via", ">").alias("via"), "is_direct")


@query("SELECT CASE WHEN role = 'user' AND length(text) > 100 THEN 'long-user' WHEN role = 'user' THEN 'user' WHEN contains(text, '?') THEN 'question' ELSE 'other' END AS producer, count(*)::BIGINT AS n FROM conversations GROUP BY 1")
def producer_classification(spark, sf_dir):
    is_user = F.col("role") == "user"
    who = payloads.classify_producer([("long-user", is_user & (F.char_length("text") > 100)), ("user", is_user), ("question", F.contains(F.col("text"), F.lit("?")))])
    return table(spark, sf_dir, "conversations").groupBy(who.alias("producer")).agg(F.count("*").alias("n"))


_BUCKETS = "b AS (SELECT lang, (('0x' || substr(sha256(t), 1, 8))::BIGINT % 128)::INTEGER AS bucket, count(*)::BIGINT AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) GROUP BY ALL)"


@query(f"WITH {_BUCKETS} SELECT * FROM b")
def hashed_vector(spark, sf_dir):
    return payloads.bucket_counts(table(spark, sf_dir, "documents"), "text", ["lang"])


@query(f"WITH {_BUCKETS}, v AS (SELECT lang, list(coalesce(n, 0)::DOUBLE ORDER BY i) AS v FROM (SELECT l.lang, i, n FROM (SELECT DISTINCT lang FROM b) l CROSS JOIN range(128) r(i) LEFT JOIN b ON b.lang = l.lang AND b.bucket = i) GROUP BY lang) SELECT a.lang, round(1 - list_cosine_similarity(a.v, e.v), 6) AS distance, CASE WHEN 1 - list_cosine_similarity(a.v, e.v) > 0.15::DOUBLE THEN 'FAIL' ELSE 'PASS' END AS status FROM v a, v e WHERE e.lang = 'en'")
def embedding_drift(spark, sf_dir):
    v = payloads.unit_vectors(payloads.bucket_counts(table(spark, sf_dir, "documents"), "text", ["lang"]), ["lang"])
    d = v.join(v.where("lang = 'en'").select(F.col("v").alias("base")))
    dist = payloads.cosine_distance(F.col("v"), F.col("base"))
    return d.select("lang", (F.round(dist, 6) + 0.0).alias("distance"), payloads.drift_status(dist).alias("status"))


_ERROR = "CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang: enum' WHEN length(text) < 100 THEN 'text: minLength' END"


@query(f"SELECT coalesce({_ERROR}, 'valid') AS error, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def prompt_validation(spark, sf_dir):
    e = F.coalesce(payloads.schema_error(F.col("lang"), "lang", {"enum": ["en", "de", "fr"]}), payloads.schema_error(F.col("text"), "text", {"minLength": 100}))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(e, F.lit("valid")).alias("error")).agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (quality = 0)::BIGINT AS violations, count(*) FILTER (quality = 0) / count(*) AS rate, 'rising' AS trend, 'FAIL' AS status FROM labels")
def schema_violation_rate(spark, sf_dir):
    return payloads.violation_rate(table(spark, sf_dir, "labels"), payloads.schema_error(F.col("quality"), "quality", {"minimum": 1}), baseline=0.01)


@query("SELECT 'k' AS key, 'integer' AS kinds, true AS required")
def json_schema_infer(spark, sf_dir):
    return ingest.json_types(table(spark, sf_dir, "events"), "props")


@query(_rows(("value.range", "CRITICAL", "count(*) FILTER (user_id % 10 = 0 OR value > 100)", "events"), ("value.required", "CRITICAL", "count(*) - count(value)", "events")))
def fault_injection_detect(spark, sf_dir):
    e = ingest.inject(table(spark, sf_dir, "events"), "value", F.lit(127.0), F.col("user_id") % 10 == 0)
    return outcome(e.withColumn("value", F.when(F.col("value") == 127.0, 127.0).otherwise(F.least("value", F.lit(1e9)))), _fields(value=FieldRule(required=True, maximum=100)))


@query("SELECT n_regionkey AS source, n_nationkey AS target FROM nation WHERE n_regionkey IN (SELECT s_nationkey FROM supplier) AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def dangling_edges(spark, sf_dir):
    e = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("target"))
    return lineage.without_dangling(e, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node_id")))


@query("SELECT o_orderkey, list_aggregate(list_transform(string_split(o_orderpriority, '-'), lambda x: x), 'string_agg', '/') AS parts, len(list_intersect(regexp_extract_all(lower(o_orderpriority), '[a-z0-9]+'), ['low', '5'])) / len(list_distinct(list_concat(regexp_extract_all(lower(o_orderpriority), '[a-z0-9]+'), ['low', '5']))) AS alike FROM orders")
def scalar_functions(spark, sf_dir):
    a = text.tokens(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", F.split("o_orderpriority", "-")).alias("parts"), text.jaccard(a, F.array(F.lit("low"), F.lit("5"))).alias("alike"))


@query("SELECT 'k' AS path, 'integer' AS type, count(*)::BIGINT AS seen, count(*)::BIGINT AS observed, 0::BIGINT AS nulls, count(DISTINCT json_extract_string(props, '$.k'))::BIGINT AS cardinality FROM events")
def raw_json_profile(spark, sf_dir):
    """Types of raw JSON values, told apart one by one."""
    return flatten.profile(flatten.observations(table(spark, sf_dir, "events"), "props"))


@query("WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i), v AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY label) SELECT vec_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * m[i])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(m, lambda x: x * x)))), 5) AS distance FROM embeddings e JOIN v ON v.label = e.label")
def cosine_distance(spark, sf_dir):
    """Each vector against the centroid of its label."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return e.join(payloads.centroids(e, ["label"], "embedding", "m"), "label").select("vec_id", F.round(payloads.cosine_distance(F.col("embedding"), F.col("m")), 5).alias("distance"))


@query("SELECT event_type, sum(CASE WHEN coalesce(n >= 0, false) THEN 0 ELSE 1 END)::BIGINT AS negative FROM (SELECT event_type, value - 50 AS n FROM events) GROUP BY 1")
def conditional_counts(spark, sf_dir):
    """Failing counts of several conditions, by group."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(~F.coalesce(F.col("value") - 50 >= 0, F.lit(False))).alias("negative"))


@query(_rows(("events.value_present", "HIGH", "count(*) FILTER (value IS NULL)", "events"), ("events.known_type", "HIGH", "count(*) FILTER (event_type NOT IN ('view', 'click'))", "events")))
def cross_record_checks(spark, sf_dir):
    """Several conditions of a dataset counted in one pass."""
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    d = crosschecks.counted(table(spark, sf_dir, "events"), {"events.value_present": ("HIGH", one(F.col("value").isNotNull())), "events.known_type": ("HIGH", one(F.col("event_type").isin("view", "click")))})
    return d.select("check_id", "status", "severity", "records_failing")


@query("SELECT path, n FROM (SELECT 'e' || (event_id % 7) AS path, count(*)::BIGINT AS n FROM events GROUP BY 1) WHERE path IN ('e1', 'e3')")
def semi_join(spark, sf_dir):
    """Rows kept where a reference has their key."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), (F.col("event_id") % 7).cast("string")).alias("path"))
    keys = spark.createDataFrame([("e1",), ("e3",), ("e9",)], "path string")
    return e.join(keys, "path", "left_semi").groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT path, cardinality FROM (SELECT 'c_name' AS path, count(DISTINCT c_name)::BIGINT AS cardinality FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer) WHERE path LIKE '%name' AND cardinality > 20")
def ambiguous_columns(spark, sf_dir):
    """Text columns whose names say too little."""
    p = profile.field_profile(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])
    return p.where(profile.is_ambiguous(F.col("path"), F.lit("string"), F.col("cardinality"))).select("path", "cardinality")


@query("SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN value > 1 THEN value / 100 ELSE value END)) AS confidence, ts AS at FROM events")
def normalised_facts(spark, sf_dir):
    """Confidences on one scale and the first parsable timestamp."""
    return table(spark, sf_dir, "events").select("event_id", ingest.confidence(F.col("value")).alias("confidence"), ingest.first_timestamp(F.lit("none"), F.col("ts")).alias("at"))


@query(_rows(("value.range", "CRITICAL", "count(*) FILTER (value < 10) + count(*) FILTER (value > 90)", "events"), ("event_type.enum", "HIGH", "count(*) FILTER (event_type NOT IN ('view', 'click'))", "events")))
def streaming_validation(spark, sf_dir):
    """The events as a file stream, validated batch by batch; the counts of all batches are added up."""
    where = f"{folder(spark)}/watch-{uuid.uuid4().hex}"
    contract = _fields(value=FieldRule(minimum=10, maximum=90), event_type=FieldRule(enum=["view", "click"]))
    source = table(spark, sf_dir, "events")
    watch(spark, sf_dir, source.schema, contract, f"{where}/results", f"{where}/progress", files="events.parquet").awaitTermination()
    r = latest_results(spark, f"{where}/results").groupBy("check_id", "severity").agg(F.sum("records_failing").alias("records_failing"))
    return r.select("check_id", F.when(F.col("records_failing") > 0, "FAIL").otherwise("PASS").alias("status"), "severity", "records_failing")


def _split(spark: SparkSession, sf_dir: str, name: str, parts: int) -> str:
    """A table as a folder of files that a stream takes one by one."""
    where = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, name).repartition(parts).write.parquet(where)
    return where


def _worked_off(frame: DataFrame, mode: str) -> DataFrame:
    """The last state of a streaming aggregate, once all that is there is worked off."""
    spark, where = frame.sparkSession, f"{folder(frame.sparkSession)}/state-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{where}/last")
    frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/last")


@query("SELECT conv_id, count(*)::BIGINT AS n, NOT (min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*)) AS broken FROM conversations WHERE turn IS NOT NULL GROUP BY 1")
def streaming_sequences(spark, sf_dir):
    """Contiguity of conversations whose turns come in several micro-batches."""
    where = _split(spark, sf_dir, "conversations", 3)
    stream = spark.readStream.schema(spark.read.parquet(where).schema).option("maxFilesPerTrigger", 1).parquet(where)
    return _worked_off(sequences(stream.withColumn("turn", F.col("turn") + 1), ["conv_id"], "turn"), "complete")


@query("SELECT date_trunc('day', ts) AS day, count(*)::BIGINT AS records, count(*) FILTER (value > 50)::BIGINT AS failing FROM events GROUP BY 1")
def streaming_windows(spark, sf_dir):
    """Failing and total events of each day, over micro-batches."""
    where = _split(spark, sf_dir, "events", 3)
    stream = spark.readStream.schema(spark.read.parquet(where).schema).option("maxFilesPerTrigger", 1).parquet(where)
    out = _worked_off(windowed_failures(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.col("value") > 50, "1 day", "10000 days"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "records", "failing")


_WATCHED = """WITH e AS (SELECT 'd' || user_id AS dataset, ts AS t, event_id AS n, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'scan' END AS event, (floor(value / 50))::BIGINT AS signature FROM events WHERE user_id IS NOT NULL),
  s AS (SELECT *, event = 'scan' AND lag(signature) OVER (PARTITION BY dataset, event ORDER BY t, n) <> signature AS changed FROM e),
  c AS (SELECT *, lead(t) OVER (PARTITION BY dataset ORDER BY t, n) AS next FROM s WHERE changed OR event <> 'scan'),
  m AS (SELECT dataset, max(t) AS last, max(max(t)) OVER () - INTERVAL 1 HOUR AS passed FROM e GROUP BY dataset),
  d AS (SELECT dataset, t + INTERVAL 6 HOURS AS t, n, 'late' AS event FROM c JOIN m USING (dataset) WHERE event = 'start' AND (next IS NULL OR next > t + INTERVAL 6 HOURS) AND (last > t + INTERVAL 6 HOURS OR passed > t + INTERVAL 6 HOURS)),
  a AS (SELECT dataset, t, n, event FROM c UNION ALL SELECT * FROM d),
  w AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY t DESC, n DESC) AS r FROM a),
  l AS (SELECT dataset, count(*) FILTER (event = 'done')::BIGINT AS validation_count, max(t) FILTER (event IN ('done', 'error', 'late')) AS last_completed_at, arg_max(CASE event WHEN 'scan' THEN 'outputs_changed' ELSE 'asked' END, t) FILTER (event IN ('scan', 'start')) AS last_reason,
    arg_max(CASE event WHEN 'error' THEN 'broken' WHEN 'late' THEN 'no outcome in time' ELSE '' END, t) FILTER (event IN ('error', 'late', 'start')) AS last_error, max(CASE WHEN r = 1 THEN event END) AS event FROM w GROUP BY dataset)
SELECT dataset, CASE event WHEN 'scan' THEN 'stale' WHEN 'start' THEN 'validating' WHEN 'done' THEN 'watching' WHEN 'error' THEN 'error' WHEN 'late' THEN 'error' ELSE 'idle' END AS status, coalesce(validation_count, 0) AS validation_count, last_reason, nullif(last_error, '') AS last_error, last_completed_at FROM m LEFT JOIN l USING (dataset)"""


@query(_WATCHED)
def streaming_statuses(spark, sf_dir):
    """The state of each user's dataset, whose events come in micro-batches in order of time."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    event = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("scan")
    detail = F.when(event == "start", "asked").when(event == "error", "broken")
    rows = e.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("dataset"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("n"), event.alias("event"), F.floor(F.col("value") / 50).cast("string").alias("signature"), detail.alias("detail"))
    where = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")
    day = F.dayofmonth("at")
    for wanted in (day <= 10, (day > 10) & (day <= 20), day > 20):  # all files of ten days are one batch, worked off before the next come
        rows.where(wanted).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{where}/in")
        statuses(stream, limit=6 * 3600, late="1 hour").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    out = latest_statuses(spark.read.parquet(f"{where}/out"))
    return out.select("dataset", "status", "validation_count", "last_reason", "last_error", F.col("last_completed_at").cast("timestamp_ntz").alias("last_completed_at"))


def _cross(*parts: tuple[str, str, str, str]) -> str:
    """SQL of cross-record checks: (id, severity, failing count, table)."""
    return _rows(*parts).replace("'FAIL' ELSE 'PASS' END AS status, 'MEDIUM'", "'WARN' ELSE 'PASS' END AS status, 'MEDIUM'")


def _counts(results: DataFrame) -> DataFrame:
    return results.select("check_id", "status", "severity", "records_failing")


_REFS = "(SELECT o_orderkey, l_orderkey, 'f' || (l_partkey % 30) AS file, l_linenumber AS a, l_linenumber + (l_partkey % 4) - 1 AS b, l_discount * 12 AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"


@query(_cross(
    ("week1.code_refs_non_empty", "HIGH", "count(*)", "orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"), ("week1.code_ref_line_bounds", "HIGH", "count(*) FILTER (l_orderkey IS NOT NULL AND NOT (a >= 1 AND b >= a))", _REFS),
    ("week1.code_ref_confidence_scale", "CRITICAL", "count(*) FILTER (l_orderkey IS NOT NULL AND NOT c BETWEEN 0 AND 1)", _REFS), ("week1.code_ref_file_present", "HIGH", "count(*) FILTER (l_orderkey IS NOT NULL AND file NOT IN (SELECT 'f' || n_nationkey FROM nation))", _REFS),
))
def cross_intents(spark, sf_dir):
    """Orders as intents, their lines as references into files."""
    ref = F.struct(F.concat(F.lit("f"), (F.col("l_partkey") % 30).cast("string")).alias("file"), F.col("l_linenumber").alias("line_start"), (F.col("l_linenumber") + F.col("l_partkey") % 4 - 1).alias("line_end"), (F.col("l_discount") * 12).alias("confidence"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(ref).alias("code_refs"))
    d = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("code_refs", F.coalesce("code_refs", F.array()))
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("path"))
    return _counts(crosschecks.intents(d, files))


_MEANS = "(SELECT c_nationkey AS n, sum((c_custkey % 6)::DOUBLE * CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 ELSE 1 END) / sum(CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 ELSE 1 END) AS m FROM customer GROUP BY 1)"


@query(_cross(
    ("week2.score_range_valid", "CRITICAL", "count(*) FILTER (c_custkey % 6 = 0)", "customer"), ("week2.overall_score_weighted_mean", "CRITICAL", "count(*) FILTER (n % 3 = 0)", _MEANS),
    ("week2.rubric_hash_exists", "HIGH", "count(*) FILTER (n >= 20)", _MEANS),
))
def cross_verdicts(spark, sf_dir):
    """Nations as verdicts, scored by their customers."""
    score, weight = (F.col("c_custkey") % 6).cast("double"), (F.col("c_custkey") % 4).cast("double")
    used = F.when(weight > 0, weight).otherwise(1.0)
    entry = F.struct(F.col("c_custkey").cast("string").alias("key"), F.struct(score.cast("int").alias("score"), weight.alias("weight")).alias("value"))
    d = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(entry)).alias("scores"), (F.sum(score * used) / F.sum(used)).alias("m"))
    d = d.select("scores", F.when(F.col("c_nationkey") % 3 == 0, F.col("m") + 0.5).otherwise(F.col("m")).alias("overall_score"), F.sha2(F.col("c_nationkey").cast("string"), 256).alias("rubric_id"))
    hashes = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.sha2(F.col("n_nationkey").cast("string"), 256).alias("sha256"))
    return _counts(crosschecks.verdicts(d, hashes))


@query(_cross(
    ("week3.entity_refs_exist", "HIGH", "count(*) FILTER (b.s_suppkey IS NULL)", "supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 AND b.s_nationkey = a.s_nationkey"),
    ("week3.extraction_rules_hash_exists", "HIGH", "count(*) FILTER (n % 2 = 1)", "(SELECT DISTINCT s_nationkey AS n FROM supplier)"),
))
def cross_extractions(spark, sf_dir):
    """Nations as extractions: their suppliers as entities, and facts about each supplier and the next."""
    s = table(spark, sf_dir, "supplier")
    key = lambda k: F.concat(F.lit("s"), k.cast("string"))
    entity, fact = F.struct(key(F.col("s_suppkey")).alias("entity_id")), F.struct(F.array(key(F.col("s_suppkey")), key(F.col("s_suppkey") + 1)).alias("entity_refs"))
    d = s.groupBy("s_nationkey").agg(F.collect_list(entity).alias("entities"), F.collect_list(fact).alias("extracted_facts"))
    return _counts(crosschecks.extractions(d.withColumn("extraction_rules_hash", F.concat(F.lit("h"), (F.col("s_nationkey") % 2).cast("string"))), "h0"))


@query(_cross(("week4.edges_reference_nodes", "CRITICAL", "count(*) FILTER (b.n_nationkey IS NULL)", "nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 AND b.n_regionkey = a.n_regionkey")))
def cross_lineage(spark, sf_dir):
    """Regions as snapshots of nations, each with an edge to the next."""
    n = table(spark, sf_dir, "nation")
    d = n.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("node_id"))).alias("nodes"), F.collect_list(F.struct(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") + 1).alias("target"))).alias("edges"))
    return _counts(crosschecks.lineage(d))


def _iso(seconds: Column) -> Column:
    return F.date_format(seconds.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS s FROM events)"


@query(_cross(
    ("week5.recorded_after_occurred", "CRITICAL", "count(*) FILTER (NOT coalesce(floor(value - 20) >= 0, false))", "events"), ("week5.sequence_monotonic", "CRITICAL", "count(*)", f"(SELECT 1 FROM {_NUMBERED} GROUP BY user_id HAVING NOT (min(s) = 1 AND max(s) = count(*) AND count(DISTINCT s) = count(*)))"),
    ("week5.payload_matches_schema", "HIGH", "count(*) FILTER (event_type NOT IN ('view', 'click') OR event_id % 2 = 1 OR value < 5)", "events"),
))
def cross_events(spark, sf_dir):
    """Recording times, sequences by user, and payloads by type and version."""
    e = ingest.numbered(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    at = F.col("ts").cast("timestamp").cast("long")
    d = e.select(
        _iso(at).alias("occurred_at"), _iso(at + F.floor(F.col("value") - 20)).alias("recorded_at"), F.col("user_id").alias("aggregate_id"), "event_type", "value",
        (F.col("sequence_number") + F.when(F.col("user_id") % 5 == 0, 1).otherwise(0)).alias("sequence_number"), F.concat((F.col("event_id") % 2).cast("string"), F.lit(".0")).alias("schema_version"),
    )
    schemas = spark.createDataFrame([("view", "0.0"), ("click", "0.0")], "event_type string, schema_version string")
    return _counts(crosschecks.events(d, schemas, F.when(F.col("value") < 5, "value: minimum")))


def _traces(spark, sf_dir):
    e, at = table(spark, sf_dir, "events"), F.col("ts").cast("timestamp").cast("long")
    known = F.get(F.array(*[F.lit(t) for t in ("LLM ", "chain", "planner")]), (F.col("event_id") % 3).cast("int"))
    cost = F.when(F.col("event_id") % 13 == 0, "-1").when(F.col("event_id") % 17 == 0, "x").otherwise("0.5")
    return e.select(
        _iso(at).alias("start_time"), _iso(at + F.floor(F.col("value") / 20)).alias("end_time"), (F.col("user_id") % 10).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"),
        (F.col("user_id") % 10 + F.col("event_id") % 7 + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).alias("total_tokens"), known.alias("run_type"), cost.alias("total_cost"),
        F.when(F.col("event_id") % 4 == 0, F.array("event_type")).alias("tags"), F.col("props").alias("inputs"), F.lit("{}").alias("outputs"), F.concat(F.lit("Run-"), F.col("event_type")).alias("name"), F.when(F.col("event_id") % 10 == 1, "at /q/file").alias("error"),
    )


@query(_cross(
    ("traces.end_after_start", "CRITICAL", "count(*) FILTER (NOT coalesce(floor(value / 20) > 0, false))", "events"), ("traces.total_tokens_add_up", "CRITICAL", "count(*) FILTER (event_id % 11 = 0)", "events"),
    ("traces.run_type_allowed", "HIGH", "count(*) FILTER (event_id % 3 = 2)", "events"), ("traces.total_cost_non_negative", "CRITICAL", "count(*) FILTER (event_id % 13 = 0 OR event_id % 17 = 0)", "events"),
))
def cross_traces(spark, sf_dir):
    """Times, token counts, run types and costs of traces."""
    return _counts(crosschecks.traces(_traces(spark, sf_dir)))


PRODUCERS = {"p": {"tags": ["view"], "paths": ["inputs.none"], "names": ["run-click"], "fragments": []}, "q": {"tags": ["click"], "paths": ["outputs.r"], "names": [], "fragments": ["/Q/"]}}
_WHO = "(SELECT CASE WHEN event_id % 4 = 0 AND event_type = 'view' THEN 'p' WHEN event_id % 4 = 0 AND event_type = 'click' THEN 'q' WHEN event_type = 'click' THEN 'p' WHEN event_id % 10 = 1 THEN 'q' ELSE 'other' END AS who, event_id, event_type FROM events)"


@query(_cross(
    ("traces.producer_classification.coverage", "MEDIUM", "count(*) FILTER (who = 'other')", _WHO), ("traces.p.row_shape", "HIGH", "count(*) FILTER (who = 'p' AND event_type <> 'click')", _WHO),
    ("traces.q.row_shape", "HIGH", "count(*) FILTER (who = 'q' AND event_id % 10 <> 1)", _WHO),
))
def cross_producers(spark, sf_dir):
    """Traces without a producer, and those that only a tag gives one."""
    return _counts(crosschecks.producers(_traces(spark, sf_dir), PRODUCERS, ["q", "p"]))


@query("SELECT 'value.drift' AS check_id, 'value' AS column_name, CASE WHEN z > 3 THEN 'FAIL' WHEN z > 2 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN z > 2 AND z <= 3 THEN 'WARNING' ELSE 'MEDIUM' END AS severity, (z > 2)::BIGINT AS records_failing FROM (SELECT abs(avg(value * 2) - avg(value)) / greatest(stddev_pop(value), 1e-9::DOUBLE) AS z FROM events) UNION ALL SELECT 'baseline.' || k, '*', 'PASS', 'MEDIUM', 0 FROM (VALUES ('initialized'), ('unavailable')) v(k)")
def drift_checks(spark, sf_dir):
    """Drift against a baseline, and the first and the read-only run without one."""
    e = table(spark, sf_dir, "events")
    base = profile.numeric_profile(e.select("value"), ["value"])
    now = profile.numeric_profile(e.select((F.col("value") * 2).alias("value")), ["value"])
    return profile.drift_results(now, base).unionByName(profile.drift_results(now, None)).unionByName(profile.drift_results(now, None, read_only=True))


@query("SELECT 'value' AS path, 'number' AS type, count(value) >= count(*) AS required, count(value) < count(*) AS nullable FROM events UNION ALL SELECT 'event_type', 'string', count(event_type) >= count(*), count(event_type) < count(*) FROM events UNION ALL SELECT 'user_id', 'integer', count(user_id) >= count(*), count(user_id) < count(*) FROM events")
def structural_summary(spark, sf_dir):
    """Types and presence of fields."""
    return profile.structure(table(spark, sf_dir, "events"), ["value", "event_type", "user_id"])


def _ranked(spark, sf_dir):
    return _violations(spark, sf_dir).withColumns({"systems": F.col("seq") % 4, "detected_at": F.col("seq") % 100})


@query(f"WITH {_VIOLATIONS} SELECT seq, severity, records_failing FROM v ORDER BY rank DESC, seq % 4 DESC, records_failing DESC, seq % 100 DESC, seq LIMIT 20")
def violations_order(spark, sf_dir):
    """Severity, affected systems, failing records and time, from the highest."""
    return reporting.ordered(_ranked(spark, sf_dir), 20).select("seq", "severity", "records_failing")


@query(f"WITH {_VIOLATIONS} SELECT check_id, field, records_failing, seq FROM v QUALIFY row_number() OVER (PARTITION BY check_id, field, status ORDER BY records_failing DESC, seq DESC) = 1")
def dedupe_last_wins(spark, sf_dir):
    """Of equal counts the later violation stays."""
    return reporting.last_wins(_violations(spark, sf_dir)).select("check_id", "field", "records_failing", "seq")


@query("SELECT 'f' || (user_id % 5) AS file, event_type AS commit, count(*)::BIGINT AS impact, string_agg(DISTINCT 'x' || (event_id % 6), ',' ORDER BY 'x' || (event_id % 6)) AS fields, max((event_id % 10) / 10.0::DOUBLE) AS best, arg_min('a' || (event_id % 100), (-((event_id % 10) / 10.0::DOUBLE), 'a' || (event_id % 100))) AS author FROM events GROUP BY 1, 2")
def blame_summary(spark, sf_dir):
    """Impact, fields, confidence and author of each file and commit."""
    key = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    b = table(spark, sf_dir, "events").select(key("f", F.col("user_id") % 5).alias("file"), F.col("event_type").alias("commit"), key("x", F.col("event_id") % 6).alias("field"), (F.col("event_id") % 10 / F.lit(10.0)).alias("confidence"), key("a", F.col("event_id") % 100).alias("author"))
    return reporting.blame_summary(b).withColumn("fields", F.concat_ws(",", "fields"))


_STATUS = "(['PASS', 'FAIL', 'WARN', 'ERROR'])[l_linenumber % 4 + 1]"


@query(f"SELECT sum(n)::BIGINT AS total, sum(CASE WHEN o % 3 = 0 THEN 5 ELSE p END)::BIGINT AS passed, sum(f)::BIGINT AS failed, sum(w)::BIGINT AS warned, sum(c)::BIGINT AS critical FROM (SELECT l_orderkey AS o, count(*) AS n, count(*) FILTER ({_STATUS} = 'PASS') AS p, count(*) FILTER ({_STATUS} IN ('FAIL', 'ERROR')) AS f, count(*) FILTER ({_STATUS} = 'WARN') AS w, count(*) FILTER ({_STATUS} IN ('FAIL', 'ERROR') AND l_returnflag = 'A') AS c FROM lineitem GROUP BY 1)")
def report_totals(spark, sf_dir):
    """Orders as reports, their lines as results; some give a count of their own."""
    status = F.get(F.array(*[F.lit(x) for x in ("PASS", "FAIL", "WARN", "ERROR")]), (F.col("l_linenumber") % 4).cast("int"))
    result = F.struct(status.alias("status"), F.when(F.col("l_returnflag") == "A", "CRITICAL").otherwise("LOW").alias("severity"))
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(result).alias("results"))
    none = F.lit(None).cast("long")
    return reporting.report_totals(r.select("results", none.alias("total"), F.when(F.col("l_orderkey") % 3 == 0, 5).alias("passed"), none.alias("failed"), none.alias("warned")))


@query("SELECT p_partkey, CASE WHEN p_size < 25 THEN p_size WHEN p_size + 0 IN (SELECT n_nationkey * 2 FROM nation) THEN p_size // 2 END AS nation FROM part")
def first_match_lookup(spark, sf_dir):
    """Parts whose size is a nation's key, else twice a nation's key."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 2).alias("double"))
    return reporting.first_match(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", n, ["n_nationkey", "double"], "n_nationkey").select("p_partkey", F.col("match.n_nationkey").alias("nation"))


_AI = "a AS (SELECT (['embedding_drift', 'prompt_input_validation', 'structured_llm_output_enforcement', 'langsmith_trace_schema_contracts', 'another'])[event_id % 5 + 1] AS name, (['PASS', 'FAIL', 'WARN', 'BASELINE_SET'])[event_id % 4 + 1] AS status, event_id % 50 AS failing FROM events)"


def _ai(spark, sf_dir):
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n).cast("int"))
    return table(spark, sf_dir, "events").select(pick(("embedding_drift", "prompt_input_validation", "structured_llm_output_enforcement", "langsmith_trace_schema_contracts", "another"), 5).alias("name"), pick(("PASS", "FAIL", "WARN", "BASELINE_SET"), 4).alias("status"), (F.col("event_id") % 50).alias("failing"), F.lit("seen").alias("detail"))


@query(f"WITH {_AI} SELECT count(*)::BIGINT AS total, count(*) FILTER (status IN ('PASS', 'BASELINE_SET'))::BIGINT AS passed, count(*) FILTER (status = 'FAIL')::BIGINT AS failed, count(*) FILTER (status = 'WARN')::BIGINT AS warned FROM a")
def ai_counts(spark, sf_dir):
    return reporting.ai_counts(_ai(spark, sf_dir))


@query(f"""WITH {_AI} SELECT 'ai.' || name AS check_id,
  CASE name WHEN 'embedding_drift' THEN 'extracted_facts.text' WHEN 'prompt_input_validation' THEN 'content_preview' WHEN 'structured_llm_output_enforcement' THEN 'overall_verdict' ELSE 'id' END AS field_name, status,
  CASE name WHEN 'embedding_drift' THEN 'HIGH' WHEN 'prompt_input_validation' THEN 'MEDIUM' WHEN 'structured_llm_output_enforcement' THEN if(status = 'FAIL', 'MEDIUM', 'LOW') ELSE if(status = 'FAIL', 'HIGH', 'MEDIUM') END AS severity,
  CASE WHEN name = 'embedding_drift' THEN 1 ELSE failing END::BIGINT AS records_failing, name || ': seen' AS message
  FROM a WHERE name <> 'another' AND (status = 'FAIL' OR status = 'WARN' AND name <> 'embedding_drift')""")
def ai_violations(spark, sf_dir):
    return payloads.ai_violations(_ai(spark, sf_dir))


@query("SELECT 'all' AS of, 4::BIGINT AS total, (SELECT count(*) FROM (SELECT count(*) FILTER (NOT coalesce(floor(value / 20) > 0, false)) AS n FROM events UNION ALL SELECT count(*) FILTER (event_id % 11 = 0) FROM events UNION ALL SELECT count(*) FILTER (event_id % 3 = 2) FROM events UNION ALL SELECT count(*) FILTER (event_id % 13 = 0 OR event_id % 17 = 0) FROM events) WHERE n = 0)::BIGINT AS passed, 'FAIL' AS status UNION ALL SELECT 'none', 0, 0, 'SKIPPED'")
def trace_contract(spark, sf_dir):
    """The combined verdict on traces, and on none."""
    t = _traces(spark, sf_dir)
    some = lambda d, name: payloads.trace_contract(d, crosschecks.traces(d)).select(F.lit(name).alias("of"), "total", "passed", "status")
    return some(t, "all").unionByName(some(t.limit(0), "none"))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey ELSE c_custkey::VARCHAR END AS doc_id, c_name AS source_path, substr(c_mktsegment, 1, 4) AS preview FROM customer")
def prompt_inputs(spark, sf_dir):
    """Inputs from metadata where it speaks, else from the record."""
    c = table(spark, sf_dir, "customer")
    told = F.struct(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("m"), F.col("c_custkey").cast("string"))).alias("doc_id"), F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("content_preview"))
    d = c.select("c_custkey", "c_name", F.array(F.struct(F.col("c_mktsegment").alias("source_excerpt"))).alias("facts"), told.alias("metadata"))
    return payloads.prompt_inputs(d, F.col("c_custkey").cast("string"), F.col("c_name"), F.col("facts"), F.col("metadata"), most=4)


@query("WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(list_filter(['discount', 'quantity'], lambda x: (x = 'discount' AND l_discount > 0.05::DOUBLE) OR (x = 'quantity' AND l_quantity > 30))) AS k FROM lineitem) SELECT CASE WHEN k = 'discount' THEN 'l_discount.range' ELSE 'l_quantity.range' END AS check_id, n, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))::INTEGER AS n FROM f) WHERE n <= 5")
def sample_all_failures(spark, sf_dir):
    """The first records that fail each check, of all checks at once."""
    d = table(spark, sf_dir, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    c = _fields(l_discount=FieldRule(maximum=0.05), l_quantity=FieldRule(maximum=30))
    return checks.all_samples(d, c, "k").select("check_id", "n", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("WITH i AS (SELECT o_orderkey % 500 AS intent_id, o_orderkey AS k FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 500 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), r AS (SELECT DISTINCT l_orderkey % 500 AS intent_id, 'f' || (l_partkey % 9) AS path, l_linenumber AS a, l_linenumber + 2 AS b FROM lineitem UNION SELECT l_orderkey % 500, 'f' || (l_partkey % 9), 0, 1 FROM lineitem), g AS (SELECT intent_id, string_agg(path || ':' || a || '-' || b, ',' ORDER BY path, a, b) AS refs FROM r GROUP BY 1) SELECT i.intent_id, k, coalesce(refs, '') AS refs FROM i LEFT JOIN g ON g.intent_id = i.intent_id")
def intents_traces(spark, sf_dir):
    """The newest intent of each id with the references of its traces."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 500).alias("intent_id"), F.col("o_orderkey").alias("k"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    span = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    zero = F.lit(0).cast("long")
    n = F.col("l_linenumber").cast("long")
    files = F.array(F.struct(F.concat(F.lit("f"), (F.col("l_partkey") % 9).cast("string")).alias("path"), F.array(span(n, n + 2), span(zero, zero + 1)).alias("ranges")))
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("intent_id"), files.alias("files"))
    out = ingest.intents_with_refs(o, t)
    said = lambda r: F.concat(r["path"], F.lit(":"), r["first"].cast("string"), F.lit("-"), r["last"].cast("string"))
    return out.select("intent_id", "k", F.array_join(F.transform("code_refs", said), ",").alias("refs"))


@query("WITH b AS (SELECT conv_id, turn, trim(text) AS t, (turn * 37 % 150)::DOUBLE AS c FROM conversations WHERE trim(text) <> ''), n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY length(t) < 60, turn, t))::INTEGER AS fact_no FROM b) SELECT conv_id, fact_no, t AS text, greatest(0, least(1, CASE WHEN c > 1 THEN c / 100 ELSE c END))::DOUBLE AS confidence FROM n WHERE fact_no <= 3")
def facts_of_documents(spark, sf_dir):
    """The first long blocks of each conversation, filled up with short ones."""
    c = table(spark, sf_dir, "conversations").withColumn("score", (F.col("turn") * 37 % 150).cast("double"))
    return ingest.facts(c, "conv_id", ["turn", "text"], "text", "score", most=3, least=60)


@query("SELECT n_nationkey, 0::BIGINT AS section_no, n_name AS title, 'v' || n_regionkey AS status, 'second' AS twice FROM nation UNION ALL SELECT n_nationkey, 1, 'Notes', NULL, NULL FROM nation")
def markdown_records(spark, sf_dir):
    """Sections and named lines of Markdown texts made of nations."""
    text = F.concat(F.lit("# head\n\n## "), "n_name", F.lit("\n- **status**: v"), F.col("n_regionkey").cast("string"), F.lit("\n- **twice**: first\n- **twice**: second\nfree text\n## Notes\nnone\n"))
    s = ingest.markdown_sections(table(spark, sf_dir, "nation").withColumn("md", text), "md", ["n_nationkey"])
    return s.select("n_nationkey", "section_no", "title", F.try_element_at("fields", F.lit("status")).alias("status"), F.try_element_at("fields", F.lit("twice")).alias("twice"))


@query("SELECT CASE WHEN contains(text, 'a') AND regexp_matches(lower(text), 'th|en') THEN 'first' WHEN regexp_matches(lower(text), 'er') THEN 'second' ELSE 'unknown' END AS service, count(*)::BIGINT AS n FROM (SELECT coalesce(role, '') || ' a ' || coalesce(text, '') AS text FROM conversations) GROUP BY 1")
def service_routing(spark, sf_dir):
    """The first route whose words a turn has."""
    who = ingest.routed([("th|en", "first"), ("er", "second")], F.col("role"), F.lit("a"), F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy(who.alias("service")).agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT n_name, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || n_name::BLOB) AS h FROM nation) SELECT n_name, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || (['8', '9', 'a', 'b'])[('0x' || substr(h, 17, 1))::INTEGER % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h")
def uuid5_ids(spark, sf_dir):
    """Version 5 identifiers of names."""
    return table(spark, sf_dir, "nation").select("n_name", text.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("n_name")).alias("id"))


_CLAUSED = "(SELECT p_partkey, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS id, p_brand, p_type, 'src/' || lower(p_type) || '/' || (p_partkey % 9) || '.py' AS path FROM (SELECT *, md5(p_partkey::VARCHAR) AS m FROM part))"


@query(_rows(
    ("c.format", "CRITICAL", "count(*) FILTER (NOT regexp_matches(id, '^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'))", _CLAUSED), ("c.pattern", "WARNING", "count(*) FILTER (NOT regexp_matches(p_brand, '^(?:Brand#[1-9]$)'))", _CLAUSED),
    ("c.enum", "LOW", "count(*) FILTER (p_type NOT IN ('ECONOMY', 'SMALL'))", _CLAUSED), ("c.path", "CRITICAL", "count(*) FILTER (p_partkey % 9 > 3)", _CLAUSED),
))
def clause_rules(spark, sf_dir):
    """Format, pattern, enumeration and path clauses with their own severities."""
    m = F.md5(F.col("p_partkey").cast("string"))
    path = lambda n: F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), n.cast("string"), F.lit(".py"))
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("id"), "p_brand", "p_type", path(F.col("p_partkey") % 9).alias("path"))
    files = table(spark, sf_dir, "part").select("p_type", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("n")).select(path(F.col("n")).alias("path")).distinct()
    rules = [("c.format", "error", {"type": "field_format", "field": "id", "format": "uuid"}), ("c.pattern", "warn", {"type": "field_pattern", "field": "p_brand", "pattern": "Brand#[1-9]$"}), ("c.enum", "info", {"type": "field_enum", "field": "p_type", "allowed": ["ECONOMY", "SMALL"]}), ("c.path", "error", {"type": "repo_path_exists", "field": "path"})]
    c = Contract("t", clauses=[Clause(i, r, s) for i, s, r in rules])
    return checks.evaluate(d, c, files).select("check_id", "status", "severity", "records_failing")


@query("SELECT o_orderstatus, count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS keys FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def jsonl_round_trip(spark, sf_dir):
    """Orders written as JSON lines beside comments and broken lines, and read back tolerantly."""
    where = f"{folder(spark)}/jsonl-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    records.write_jsonl(o.where("o_orderkey % 7 <> 0"), where)
    o.where("o_orderkey % 7 = 0").select(F.when(F.col("o_orderkey") % 2 == 0, "# a comment").otherwise('{"o_orderkey": ').alias("value")).write.mode("append").text(where)
    back = records.read_jsonl(spark, where, o.schema, tolerant=True)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query("SELECT coalesce(e, 'valid') AS error, count(*)::BIGINT AS n FROM (SELECT CASE WHEN value < 10 THEN 'value: minimum' WHEN event_type = 'view' THEN 'event_type: enum' END AS e FROM events) GROUP BY 1")
def quarantine_split(spark, sf_dir):
    """Valid records and those kept out, with what keeps them out."""
    error = F.coalesce(payloads.schema_error(F.col("value"), "value", {"minimum": 10}), F.when(F.col("event_type") == "view", "event_type: enum"))
    fine, bad = records.split_quarantine(table(spark, sf_dir, "events"), error)
    return fine.select(F.lit("valid").alias("error")).unionByName(bad.select("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, max(coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END, o_orderdate - INTERVAL 1 DAY)) AS at FROM orders GROUP BY 1")
def latest_records(spark, sf_dir):
    """The newest order of each customer, by the first time that a record has."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("generated_at"), (F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("run_timestamp"))
    return records.latest(o, ["o_custkey"], ["generated_at", "run_timestamp"]).select("o_custkey", F.coalesce("generated_at", "run_timestamp").alias("at"))


@query("SELECT 'l_quantity' AS path, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax * 2), 6) FROM lineitem UNION ALL SELECT 'l_discount', round(avg(l_discount), 6) FROM lineitem")
def baseline_upsert(spark, sf_dir):
    """A baseline kept over two runs: the second replaces one field and adds another."""
    where, d = f"{folder(spark)}/baseline-{uuid.uuid4().hex}", table(spark, sf_dir, "lineitem")
    store.upsert_baseline(profile.numeric_profile(d, ["l_quantity", "l_tax"]), where)
    store.upsert_baseline(profile.numeric_profile(d.withColumn("l_tax", F.col("l_tax") * 2), ["l_tax", "l_discount"]), where)
    return store.read_baseline(spark, where).select("path", F.round("mean", 6).alias("mean"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'fixed' AS l_returnflag, 1 AS added FROM lineitem")
def adapter_set_remove(spark, sf_dir):
    """Fields set and removed."""
    rules = [{"type": "set_value", "field": "l_returnflag", "value": "fixed"}, {"type": "remove_field", "field": "l_tax"}, {"type": "set_value", "field": "added", "value": 1}, {"type": "optional_field", "field": "gone"}]
    out = adapter.apply_rules(table(spark, sf_dir, "lineitem"), rules)
    return out.select([c for c in out.columns if c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_tax", "added")])


@query(f"WITH {_EDGES}, m AS (SELECT 'graph' AS source, 'NODE' AS kind, target AS id, 1 AS hops FROM e WHERE source = 'r1' UNION ALL SELECT 'graph', 'NODE', b.target, 2 FROM e a JOIN e b ON a.target = b.source WHERE a.source = 'r1' UNION ALL SELECT 'registry', 'CONTRACT', 'n' || n_nationkey, 3 FROM nation UNION ALL SELECT 'graph', 'NODE', 'n' || n_nationkey, 5 FROM nation) SELECT source, kind, id, min(hops)::INTEGER AS hops FROM m GROUP BY ALL")
def lineage_merge(spark, sf_dir):
    """Entries of two graphs as one list, the nearest of each."""
    reached = lineage.traverse(_edges(spark, sf_dir), spark.createDataFrame([("r1",)], "start string"))
    of = lambda d, source, kind, hops: d.select(F.lit(source).alias("source"), F.lit(kind).alias("kind"), "id", hops.cast("int").alias("hops"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    parts = of(reached.select(F.col("node").alias("id"), "hops"), "graph", "NODE", F.col("hops")), of(nations, "registry", "CONTRACT", F.lit(3)), of(nations, "graph", "NODE", F.lit(5))
    return lineage.merged_entries(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("SELECT field_name, change_type FROM (SELECT 'l_tax' AS field_name, 'FIELD_RENAME' AS change_type UNION ALL SELECT 'l_quantity', 'NO_CHANGE' UNION ALL SELECT 'l_discount', CASE WHEN (SELECT min(l_discount) >= 0 AND max(l_discount) <= 1 AND max(l_discount) * 100 > 1 FROM lineitem) THEN 'TYPE_NARROWING_SCALE_SHIFT' ELSE 'TYPE_NARROWING' END)")
def schema_rename(spark, sf_dir):
    """A renamed field found by its likeness, a share that becomes whole percents, and a field that stays."""
    d = table(spark, sf_dir, "lineitem")
    learned = profile.infer_contract(d.select("l_tax", "l_quantity", "l_discount"), "old")
    later = d.select(F.col("l_tax").alias("l_tax_rate"), "l_quantity", F.round(F.col("l_discount") * 100).cast("long").alias("l_discount"))
    after = profile.infer_contract(later, "new")
    renames = evolution.detect_renames(learned, after)
    changes = evolution.classify(evolution.field_table(spark, learned), evolution.field_table(spark, after), renames)
    return changes.select("field_name", "change_type")


@query("SELECT p_partkey, lower(p_type) || '.sizes.s' || p_size AS path, p_size || '.' || (p_partkey % 5) || '.0' AS version FROM part")
def path_and_version_rules(spark, sf_dir):
    """Field paths without indexes and stray dots, and versions of three parts."""
    size = F.col("p_size").cast("string")
    raw = F.concat(F.lit("."), F.lower("p_type"), F.lit("[0]..sizes[*]. s"), size, F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", text.normal_field_path(raw).alias("path"), text.three_part_version(F.concat(size, F.lit("."), (F.col("p_partkey") % 5).cast("string"))).alias("version"))


def _raw(spark, sf_dir):
    """Events as raw JSON, whose member v is absent, null, true, a text, an array, an integer or a fraction in turn."""
    i = F.col("event_id")
    v = F.when(i % 7 == 1, "null").when(i % 7 == 2, "true").when(i % 7 == 3, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(i % 7 == 4, '[1,"x",null]').when(i % 7 == 5, F.col("user_id").cast("string")).when(i % 7 == 6, "0.5")
    inner = F.concat(F.lit('[{"k":'), (i % 50).cast("string"), F.lit("}"), F.when(i % 3 == 0, ',{"k":"late"}').otherwise(""), F.lit("]"))
    line = F.concat(F.lit('{"id":'), i.cast("string"), F.coalesce(F.concat(F.lit(',"v":'), v), F.lit("")), F.lit(',"in":'), inner, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("value"))


_RAW_CONTRACT = Contract("raw", fields={"v": FieldRule("integer", True, enum=["click", "view", 1], minimum=0, maximum=40), "in.k": FieldRule("integer", True, maximum=30), "id": FieldRule("integer", True), "gone": FieldRule("string", True, pattern="x")})
_BAD_V = "(i % 7 = 3 AND event_type NOT IN ('click', 'view') OR i % 7 = 4 OR i % 7 = 5 AND user_id <> 1 OR i % 7 = 6)"
_RAW_SQL = "WITH e AS (SELECT event_id AS i, event_type, user_id FROM events) " + _rows(
    ("v.required", "CRITICAL", "count(*) FILTER (i % 7 = 0)", "e"), ("v.type", "CRITICAL", "count(*) FILTER (i % 7 > 1) + count(*) FILTER (i % 7 = 4)", "e"), ("v.enum", "HIGH", f"count(*) FILTER {_BAD_V}", "e"), ("v.range", "CRITICAL", "count(*) FILTER (i % 7 = 5 AND user_id > 40)", "e"),
    ("in.k.required", "CRITICAL", "0", "(SELECT 1)"), ("in.k.type", "CRITICAL", "count(*) + count(*) FILTER (i % 3 = 0)", "e"), ("in.k.range", "CRITICAL", "count(*) FILTER (i % 50 > 30)", "e"), ("id.required", "CRITICAL", "0", "(SELECT 1)"), ("id.type", "CRITICAL", "0", "(SELECT 1)"),
    ("gone.required", "CRITICAL", "count(*)", "e"),
) + " UNION ALL SELECT 'gone.pattern', 'ERROR', 'HIGH', count(*)::BIGINT FROM e"


@query(_RAW_SQL)
def raw_contract(spark, sf_dir):
    """A contract over raw records: absent, null and values of many kinds told apart in one scan."""
    return raw.evaluate(_raw(spark, sf_dir), _RAW_CONTRACT, order=F.col("event_id")).select("check_id", "status", "severity", "records_failing")


@query(f"""WITH e AS (SELECT event_id AS i, event_type, user_id FROM events),
  f AS (SELECT 'v.enum' AS check_id, i, CASE i % 7 WHEN 3 THEN event_type WHEN 4 THEN 'x' WHEN 5 THEN user_id::VARCHAR ELSE '0.5' END AS value FROM e WHERE {_BAD_V}
    UNION ALL SELECT 'v.range', i, user_id::VARCHAR FROM e WHERE i % 7 = 5 AND user_id > 40 UNION ALL SELECT 'in.k.range', i, (i % 50)::VARCHAR FROM e WHERE i % 50 > 30)
  SELECT check_id, n::INTEGER AS n, value FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY i) AS n FROM f) WHERE n <= 5""")
def raw_first_failures(spark, sf_dir):
    """The first five values, in the order of records, that fail each check."""
    return raw.first_failures(_raw(spark, sf_dir), _RAW_CONTRACT, F.col("event_id"))


@query("""WITH e AS (SELECT event_id AS i, event_type, user_id FROM events),
  v AS (SELECT 'v' AS field, i, 0 AS place, CASE i % 7 WHEN 2 THEN 'true' WHEN 3 THEN event_type WHEN 4 THEN '1' WHEN 5 THEN user_id::VARCHAR ELSE '0.5' END AS value FROM e WHERE i % 7 > 1
    UNION ALL SELECT 'v', i, 1, 'x' FROM e WHERE i % 7 = 4 UNION ALL SELECT 'in.k', i, 0, (i % 50)::VARCHAR FROM e UNION ALL SELECT 'in.k', i, 1, 'late' FROM e WHERE i % 3 = 0),
  f AS (SELECT field, value, min((i, place)) AS seen FROM v GROUP BY ALL)
  SELECT field, n::INTEGER AS n, value FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY seen) AS n FROM f) WHERE n <= 5""")
def raw_first_seen(spark, sf_dir):
    """The first five distinct values of a path, in the order in which records show them."""
    return raw.first_seen(_raw(spark, sf_dir), ["v", "in.k"], F.col("event_id"))


@query("SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'null' WHEN 2 THEN '1' WHEN 3 THEN '\"' || event_type || '\"' WHEN 4 THEN '[1,\"x\",null]' WHEN 5 THEN user_id::VARCHAR WHEN 6 THEN '0' END AS v FROM events")
def raw_coercion(spark, sf_dir):
    """Values coerced to integers; texts and arrays that can't be stay as they are."""
    return raw.coerce(_raw(spark, sf_dir), {"v": "integer"}).select("event_id", F.to_json("v").alias("v"))


def _schema_table(spark, sf_dir):
    """A schema for each type of event and each of four versions."""
    t = table(spark, sf_dir, "events").select("event_type").distinct().withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(3))))
    text = F.format_string(
        '{"type":"object","required":["k","t"],"additionalProperties":false,"properties":{"k":{"type":"integer","maximum":%d},"t":{"type":["string","null"],"minLength":%d},"xs":{"type":"array","minItems":1,"items":{"type":"integer","minimum":%d}}}}',
        60 + 10 * F.col("version") - F.length("event_type"), 1 + F.col("version"), F.col("version"),
    )
    return t.select(F.concat_ws("/", "event_type", F.col("version").cast("string")).alias("schema_id"), text.alias("schema"))


@query("""WITH e AS (SELECT event_id AS i, event_type, event_id // 7 % 5 AS v FROM events),
  c AS (SELECT i, event_type || '/' || v AS schema_id, unnest([
    CASE WHEN v = 4 THEN ('$', 'schema') END,
    CASE WHEN v < 4 AND i % 11 = 0 THEN ('$', 'additionalProperties: extra') END, CASE WHEN v < 4 AND i % 5 = 0 THEN ('$', 'required: t') END,
    CASE WHEN v < 4 AND i % 100 > 60 + 10 * v - length(event_type) THEN ('k', 'maximum') END, CASE WHEN v < 4 AND i % 5 = 2 AND 2 < 1 + v THEN ('t', 'minLength') END, CASE WHEN v < 4 AND i % 5 = 4 THEN ('t', 'type') END,
    CASE WHEN v < 4 AND i % 8 = 0 THEN ('xs', 'minItems') END, CASE WHEN v < 4 AND i % 8 <> 0 AND i % 4 < v THEN ('xs.0', 'minimum') END, CASE WHEN v < 4 AND i % 8 <> 0 AND i % 6 < v THEN ('xs.1', 'minimum') END]) AS f FROM e)
  SELECT i AS event_id, schema_id, min(f)[1] AS field, min(f)[2] AS message, count(*)::BIGINT AS errors FROM c WHERE f IS NOT NULL GROUP BY ALL""")
def payload_schemas(spark, sf_dir):
    """Payloads against the schema of their own type and version, 20 of them and one unknown version, in one plan."""
    i = F.col("event_id")
    t = F.when(i % 5 == 1, ',"t":null').when(i % 5 == 2, ',"t":"ab"').when(i % 5 == 3, ',"t":"abcdef"').when(i % 5 == 4, ',"t":7').otherwise("")
    xs = F.when(i % 8 == 0, "[]").otherwise(F.format_string("[%d,%d]", i % 4, i % 6))
    line = F.concat(F.format_string('{"k":%d', i % 100), t, F.lit(',"xs":'), xs, F.when(i % 11 == 0, ',"extra":1').otherwise(""), F.lit("}"))
    lines = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "event_type", F.floor(i / 7 % 5).cast("int").cast("string")).alias("schema_id"), line.alias("value"))
    return jsonschema.validate(lines, jsonschema.compile_schemas(_schema_table(spark, sf_dir)), ["event_id"])


@query("""WITH n AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (event_id % 7 <> 0)::BIGINT AS v, count(*) FILTER (event_id % 7 = 4)::BIGINT AS a FROM events)
  SELECT '' AS path, 'object' AS types, n, false AS required FROM n UNION ALL SELECT '/id', 'integer', n, true FROM n UNION ALL SELECT '/v', 'array,boolean,integer,null,number,string', v, false FROM n UNION ALL SELECT '/v/~[]', 'integer', a, false FROM n
  UNION ALL SELECT '/in', 'array', n, true FROM n UNION ALL SELECT '/in/~[]', 'object', n, false FROM n UNION ALL SELECT '/in/~[]/k', 'integer', n, true FROM n""")
def json_schema_nested(spark, sf_dir):
    """The nested schema of raw records, by counts that add up."""
    return jsonschema.infer(_raw(spark, sf_dir)).select("path", F.array_join("types", ",").alias("types"), "n", "required")


@query("SELECT c_nationkey AS source, 1 AS target, 'IN' AS relationship, max(CASE WHEN c_acctbal < 0 THEN 0.95::DOUBLE ELSE least(1, c_acctbal / 20000.0::DOUBLE) END)::DOUBLE AS confidence FROM customer GROUP BY ALL")
def edge_merge_unsaid(spark, sf_dir):
    """Edges that name no confidence."""
    c = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 20000.0)
    return lineage.merged_edges(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source"), F.lit(1).alias("target"), F.lit("IN").alias("relationship"), c.alias("confidence")))


def _snapshots(spark, sf_dir):
    """Ten snapshots of a contract for each supplier: a type widens at 5, a bound narrows at 7, and a note comes and goes."""
    none = lambda kind: F.lit(None).cast(kind)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("contract_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("version"))
    one = lambda name, kind, top=None: F.struct(F.lit(name).alias("field"), kind.alias("type"), F.lit(name == "id").alias("required"), none("double").alias("minimum"), (none("double") if top is None else top).alias("maximum"), none("array<string>").alias("enum"), none("double").alias("low"), none("double").alias("high"))
    v = F.col("version")
    fields = F.array(one("id", F.lit("integer")), one("amount", F.when(v < 5, "integer").otherwise("number")), one("score", F.lit("number"), F.when(v < 7, 100.0).otherwise(50.0)))
    fields = F.when((v + F.col("contract_id")) % 4 == 0, fields).otherwise(F.concat(fields, F.array(one("note", F.lit("string")))))
    return s, s.select("contract_id", "version", F.explode(fields).alias("f")).select("contract_id", "version", "f.*")


@query("""WITH s AS (SELECT s_suppkey AS contract_id, unnest(range(2, 11))::INTEGER AS version FROM supplier)
  SELECT contract_id, version, 'amount' AS field_name, 'TYPE_WIDENING' AS change_type, 'backward' AS compatibility_class FROM s WHERE version = 5
  UNION ALL SELECT contract_id, version, 'score', 'RANGE_NARROWING', 'breaking' FROM s WHERE version = 7
  UNION ALL SELECT contract_id, version, 'note', 'FIELD_REMOVED_OPTIONAL', 'forward' FROM s WHERE (version + contract_id) % 4 = 0
  UNION ALL SELECT contract_id, version, 'note', 'FIELD_ADDED_OPTIONAL', 'backward' FROM s WHERE (version - 1 + contract_id) % 4 = 0""")
def field_history(spark, sf_dir):
    """What changed with every snapshot of every contract."""
    snapshots, fields = _snapshots(spark, sf_dir)
    return evolution.field_history(fields, snapshots).select("contract_id", "version", "field_name", "change_type", "compatibility_class")


@query("""WITH s AS (SELECT s_suppkey AS contract_id, unnest(range(1, 11))::INTEGER AS version FROM supplier),
  f AS (SELECT contract_id, version, 'id' AS field, 1 AS d FROM s UNION ALL SELECT contract_id, version, 'amount', CASE WHEN version < 5 THEN 1 ELSE 2 END FROM s
    UNION ALL SELECT contract_id, version, 'score', CASE WHEN version < 7 THEN 1 ELSE 2 END FROM s UNION ALL SELECT contract_id, version, 'note', 1 FROM s WHERE (version + contract_id) % 4 <> 0),
  g AS (SELECT *, version - row_number() OVER (PARTITION BY contract_id, field, d ORDER BY version) AS island FROM f)
  SELECT contract_id, field, min(version)::INTEGER AS first_version, max(version)::INTEGER AS last_version, max(version) = 10 AS current FROM g GROUP BY contract_id, field, d, island""")
def field_validity(spark, sf_dir):
    """The spans of snapshots over which each field was defined alike."""
    snapshots, fields = _snapshots(spark, sf_dir)
    return evolution.validity(fields, snapshots).select("contract_id", "field", "first_version", "last_version", "current")


@query("""WITH r AS (SELECT event_type AS dataset, CASE WHEN event_id % 3 = 0 THEN 'range' ELSE 'enum' END AS check_type, (['PASS', 'FAIL', 'WARN', 'PASS'])[event_id % 4 + 1] AS status, CASE WHEN event_id % 97 = 1 THEN 'CRITICAL' ELSE 'LOW' END AS severity FROM events),
  g AS (SELECT dataset, check_type, (2 - grouping(dataset) - grouping(check_type))::INTEGER AS level, count(*)::BIGINT AS total, count(*) FILTER (status = 'PASS')::BIGINT AS passed, count(*) FILTER (status = 'FAIL')::BIGINT AS failed, count(*) FILTER (status = 'WARN')::BIGINT AS warned,
    count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL')::BIGINT AS critical FROM r GROUP BY ROLLUP (dataset, check_type))
  SELECT *, greatest(0, least(100, floor(passed * 100.0 / total) - 20 * critical))::INTEGER AS health FROM g""")
def results_rollup(spark, sf_dir):
    """Check results by dataset and kind, by dataset, and of all, with the health of each."""
    i = F.col("event_id")
    status = F.get(F.array(*[F.lit(x) for x in ("PASS", "FAIL", "WARN", "PASS")]), (i % 4).cast("int"))
    r = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.when(i % 3 == 0, "range").otherwise("enum").alias("check_type"), status.alias("status"), F.when(i % 97 == 1, "CRITICAL").otherwise("LOW").alias("severity"))
    return reporting.rollup(r, ["dataset", "check_type"])


_MIGRATION = [
    *migration.rules_for("week5-event-records"),
    {"source_version": "0.8", "target_version": "0.9", "type": "numeric_scaling", "field": "value", "factor": 10, "description": "Tenths."},
    {"source_version": "2.0", "target_version": "1.0", "type": "numeric_scaling", "field": "facts.confidence", "factor": 0.01, "above": 1.0, "description": "Percent."},
    {"source_version": "2.0", "target_version": "1.0", "type": "optional_field", "field": "event_name", "description": "Gap."},
]
_MIGRATED = """WITH e AS (SELECT event_id, event_id % 5 AS k, event_type AS t, value AS v, least(value, 100) AS p FROM events),
  r AS (SELECT event_id, t, v, p, k, CASE WHEN k = 0 THEN '0.8.0' WHEN k = 1 THEN '0.9.0' WHEN k = 4 THEN '7.0.0' WHEN k = 2 AND p > 1 THEN '2.0.0' ELSE '1.0.0' END AS source_version,
    CASE WHEN k <> 2 THEN 'payload_schema_version' WHEN p > 1 THEN 'heuristic_percent' ELSE 'default_expected_version' END AS detection_method FROM e)"""


def _mixed_versions(spark, sf_dir):
    """Events of several schema versions in one table, some of which don't say theirs."""
    k, p = F.col("event_id") % 5, F.least("value", F.lit(100.0))
    facts = F.array(F.struct(F.when(k == 2, p).otherwise(p / 100).alias("confidence")), F.struct(F.lit(None).cast("double").alias("confidence")))
    version = F.when(k == 0, "0.8").when(k == 1, "0.9.0").when(k == 3, "1.0").when(k == 4, "7")
    e = table(spark, sf_dir, "events").select("event_id", version.alias("schema_version"), F.when(k < 2, F.col("event_type")).alias("event_name"), F.when(k >= 2, F.col("event_type")).alias("event_type"), "value", facts.alias("facts"))
    return migration.adapt(e, _MIGRATION, "1.0", heuristics=[("percent", "exists(facts, f -> f.confidence > 1)", "2.0")])


@query(_MIGRATED + """ SELECT event_id, source_version, t AS event_type, CASE WHEN k = 0 THEN round(v * 10, 6) ELSE v END AS value, CASE WHEN source_version = '2.0.0' THEN round(p * 0.01::DOUBLE, 6) WHEN k = 2 THEN p ELSE p / 100 END AS confidence,
  CASE source_version WHEN '0.8.0' THEN 2 WHEN '0.9.0' THEN 1 WHEN '2.0.0' THEN 2 ELSE 0 END AS changed_values FROM r""")
def adapter_by_version(spark, sf_dir):
    """Each record taken from its own version to the target by its chain of steps."""
    changed = F.aggregate("adaptation.operations", F.lit(0), lambda n, o: n + o["changed_values"])
    return _mixed_versions(spark, sf_dir).select("event_id", "adaptation.source_version", "event_type", "value", F.col("facts")[0]["confidence"].alias("confidence"), changed.alias("changed_values"))


@query(_MIGRATED + """ SELECT source_version, detection_method, count(*)::BIGINT AS records, (count(*) FILTER (source_version NOT IN ('1.0.0', '7.0.0')))::BIGINT AS changed, source_version <> '1.0.0' AS attempted,
  source_version NOT IN ('1.0.0', '7.0.0') AS applied, source_version <> '7.0.0' AS succeeded, CASE WHEN source_version = '7.0.0' THEN 'no adapter rules available for 7.0.0 -> 1.0.0' ELSE '' END AS failure_reason FROM r GROUP BY ALL""")
def adapter_outcomes(spark, sf_dir):
    """What became of the records of each version."""
    return migration.outcomes(_mixed_versions(spark, sf_dir)).drop("target_version", "fallback_succeeded")


@query(_MIGRATED + """ SELECT source_version, rule_type, count(*)::BIGINT AS records, count(*)::BIGINT AS changed_values FROM r, (VALUES ('0.8.0', 'numeric_scaling'), ('0.8.0', 'field_rename'), ('0.9.0', 'field_rename'), ('2.0.0', 'numeric_scaling'), ('2.0.0', 'optional_field')) x(version, rule_type)
  WHERE source_version = version GROUP BY ALL""")
def adapter_rule_log(spark, sf_dir):
    """How many values each rule changed in records of each version."""
    return migration.rule_log(_mixed_versions(spark, sf_dir)).drop("description")


@query("""SELECT event_type, path, count(*)::BIGINT AS n, (count(*) FILTER (nothing))::BIGINT AS nulls, min(x) AS minimum, max(x) AS maximum FROM (
  SELECT event_type, 'value' AS path, CASE WHEN event_id % 10 > 0 THEN value END AS x, event_id % 10 = 0 AS nothing FROM events UNION ALL SELECT event_type, 'user_id', user_id::DOUBLE, user_id IS NULL FROM events
  UNION ALL SELECT event_type, 'props', NULL, props IS NULL FROM events) GROUP BY ALL""")
def sketch_profile(spark, sf_dir):
    """Profiles by day, merged over all days: nothing but the sketches is read a second time."""
    e = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "value": F.when(F.col("event_id") % 10 > 0, F.col("value"))})
    daily = sketches.sketched(e, ["value", "user_id", "props"], ["event_type", "day"])
    return sketches.estimates(sketches.merged(daily, ["event_type"])).select("event_type", "path", "n", "nulls", "minimum", "maximum")


@query("""WITH b AS (SELECT o_totalprice AS price, o_custkey::DOUBLE AS customer, o_orderkey::DOUBLE AS id, o_orderpriority AS priority FROM orders WHERE year(o_orderdate) < 1997),
  c AS (SELECT o_totalprice * 1.5 AS price, o_custkey * 1.2::DOUBLE AS customer, o_orderkey::DOUBLE AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority FROM orders WHERE year(o_orderdate) >= 1997),
  q AS (SELECT 'price' AS path, (SELECT quantile_disc(price, [0.05, 0.25, 0.5, 0.75, 0.95]) FROM b) AS was, (SELECT quantile_disc(price, [0.05, 0.25, 0.5, 0.75, 0.95]) FROM c) AS now
    UNION ALL SELECT 'customer', (SELECT quantile_disc(customer, [0.05, 0.25, 0.5, 0.75, 0.95]) FROM b), (SELECT quantile_disc(customer, [0.05, 0.25, 0.5, 0.75, 0.95]) FROM c)
    UNION ALL SELECT 'id', (SELECT quantile_disc(id, [0.05, 0.25, 0.5, 0.75, 0.95]) FROM b), (SELECT quantile_disc(id, [0.05, 0.25, 0.5, 0.75, 0.95]) FROM c)),
  s AS (SELECT path, list_max(list_transform(range(1, 6), lambda i: abs(now[i] - was[i]))) / (was[5] - was[1]) AS d FROM q UNION ALL SELECT 'priority', abs((SELECT avg(CASE WHEN priority IS NULL THEN 1 ELSE 0 END) FROM c) - (SELECT avg(CASE WHEN priority IS NULL THEN 1 ELSE 0 END) FROM b)))
  SELECT path, CASE WHEN d > 0.25 THEN 'FAIL' WHEN d > 0.1 THEN 'WARN' ELSE 'PASS' END AS status FROM s UNION ALL SELECT 'fresh', 'BASELINE_SET'""")
def sketch_drift(spark, sf_dir):
    """Orders of late years against sketches of the years before, made year by year."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    late = o.where("year >= 1997").withColumns({"price": F.col("price") * 1.5, "customer": F.col("customer") * 1.2, "priority": F.when(F.col("id") % 2 == 0, F.col("priority")), "fresh": F.lit("x")})
    before = sketches.sketched(o.where("year < 1997"), ["price", "customer", "id", "priority"], ["year"])
    return sketches.drift(sketches.sketched(late, ["price", "customer", "id", "priority", "fresh"], ["year"]), before).select("path", "status")


@query("""SELECT p_partkey // 10 AS contract_id, 'k' || p_partkey || '.amount' AS old_field, 'k' || p_partkey || '.total.amount' AS new_field, 2 / 3::DOUBLE AS tokens_shared FROM part WHERE p_partkey % 5 > 0
  UNION ALL SELECT p_partkey // 10, 'Q' || p_partkey || 'x', 'Q' || p_partkey || 'y', 0 FROM part WHERE p_partkey % 10 = 7""")
def rename_match(spark, sf_dir):
    """Planted renames of ten fields a contract, some of which have another type now, and one told by its letters alone."""
    key = F.col("p_partkey")
    name = lambda a, b: F.concat(F.lit(a), key.cast("string"), F.lit(b))
    p = table(spark, sf_dir, "part").select(F.floor(key / 10).alias("contract_id"), key)
    fields = lambda path, kind, letters: p.select("contract_id", path.alias("field"), kind.alias("type"), key.alias("position")).unionByName(p.where(key % 10 == 7).select("contract_id", letters.alias("field"), F.lit("boolean").alias("type"), key.alias("position")))
    old = fields(name("k", ".amount"), F.when(key % 5 > 0, "number").otherwise("integer"), name("Q", "x"))
    new = fields(name("k", ".total.amount"), F.when(key % 5 > 0, "number").otherwise("string"), name("Q", "y"))
    found = renames.matched(old, new)
    words = lambda c: F.array_distinct(text.tokens(F.col(c), 2))
    return found.select("contract_id", "old_field", "new_field", text.jaccard(words("old_field"), words("new_field")).alias("tokens_shared"))


_HALF = _BUCKETS.replace("FROM documents)", "FROM documents WHERE {})")


@query(f"""WITH {_BUCKETS.replace("b AS", "b0 AS", 1)}, {_HALF.format("doc_id % 3 = 0 AND lang <> 'de'").replace("b AS", "b1 AS", 1)},
  v AS (SELECT i, lang, list(coalesce(n, 0)::DOUBLE ORDER BY k) AS v FROM (SELECT l.i, l.lang, k, n FROM (SELECT DISTINCT 0 AS i, lang FROM b0 UNION SELECT 1, lang FROM b1) l CROSS JOIN range(128) r(k) LEFT JOIN (SELECT 0 AS i, * FROM b0 UNION ALL SELECT 1, * FROM b1) b ON b.i = l.i AND b.lang = l.lang AND b.bucket = k) GROUP BY i, lang)
SELECT a.lang, CASE WHEN e.lang IS NULL THEN 'BASELINE_SET' WHEN 1 - list_cosine_similarity(a.v, e.v) > 0.01::DOUBLE THEN 'FAIL' ELSE 'PASS' END AS status, coalesce(round(1 - list_cosine_similarity(a.v, e.v), 4), 0) + 0.0 AS drift FROM v a LEFT JOIN v e ON e.i = 1 AND e.lang = a.lang WHERE a.i = 0""")
def stored_embedding_drift(spark, sf_dir):
    """Languages against the vectors that a first run over a third of their documents kept; one has none yet."""
    d, path = table(spark, sf_dir, "documents"), f"{folder(spark)}/baseline-{uuid.uuid4().hex}"
    vectors = lambda docs: payloads.unit_vectors(payloads.bucket_counts(docs, "text", ["lang"]), ["lang"])
    store.centroid_drift(vectors(d.where("doc_id % 3 = 0 AND lang <> 'de'")), ["lang"], path)
    return store.centroid_drift(vectors(d), ["lang"], path, limit=0.01)


_MADE_BY = "(SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'week4' WHEN event_id % 6 = 2 THEN 'week5' WHEN event_id % 6 = 1 THEN 'week4' WHEN event_id % 6 = 0 THEN 'week3' WHEN event_id % 5 = 0 THEN 'week5' WHEN event_id % 7 = 0 THEN 'week3' ELSE 'other' END AS who FROM events)"


@query(_cross(
    ("traces.producer_classification.coverage", "MEDIUM", "count(*) FILTER (who = 'other')", _MADE_BY), ("traces.week3.row_shape", "HIGH", "0 * count(*)", _MADE_BY),
    ("traces.week4.row_shape", "HIGH", "count(*) FILTER (who = 'week4' AND event_id % 6 <> 1)", _MADE_BY), ("traces.week5.row_shape", "HIGH", "0 * count(*)", _MADE_BY),
))
def cross_trace_producers(spark, sf_dir):
    """Traces by the fixed rules of producers: by tag, else by what inputs hold, by name and by error text."""
    n = F.col("event_id")
    inputs = F.when(n % 6 == 0, '{"doc_id": "d"}').when(n % 6 == 1, '{"arg": 1}').when(n % 6 == 2, '{"command": {"a": 1}}').otherwise(F.col("props"))
    name, error = F.when(n % 5 == 0, " Load_Context").otherwise("run"), F.when(n % 7 == 0, "in /WEEK3/x")
    traces = table(spark, sf_dir, "events").select(F.when(n % 4 == 0, F.array(F.lit("a"), F.lit(" Week4 "))).alias("tags"), inputs.alias("inputs"), F.lit("{}").alias("outputs"), name.alias("name"), error.alias("error"))
    return _counts(crosschecks.producers(traces))


def _map(spark, sf_dir):
    def named(k: Column) -> Column:
        t = k.cast("string")
        return F.when(k % 3 == 0, F.concat(F.lit("service::week"), t)).when(k % 3 == 1, F.concat(F.lit(" dataset::outputs/"), t)).otherwise(F.concat(F.lit("file::"), t))

    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    nodes = n.select(named(F.col("n_nationkey")).alias("node_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("label"), F.lit("TABLE").alias("type"), F.lit("").alias("path"), F.lit(None).cast("string").alias("purpose"))
    k = F.col("c_custkey")
    edges = c.select(named(F.col("c_nationkey")).alias("source"), named(k % 30).alias("target"), F.when(k % 4 > 0, "READS").alias("relationship"), F.when(k % 7 > 0, (k % 11 / 10).cast("string")).otherwise("x").alias("confidence"))
    shown = lambda c: c.startswith("dataset::outputs/") | c.startswith("service::week")
    return lineage.subgraph(*lineage.map_view(nodes.unionByName(nodes), edges), shown)


_MAP = """n AS (SELECT n_nationkey AS k, (['service::week', 'dataset::outputs/', 'file::'])[n_nationkey % 3 + 1] || n_nationkey AS id, n_name FROM nation),
  e AS (SELECT a.id AS source, b.id AS target, CASE WHEN c_custkey % 4 > 0 THEN 'READS' ELSE 'DEPENDS_ON' END AS relationship, max(CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 11 / 10 ELSE 0 END)::DOUBLE AS confidence FROM customer JOIN n a ON a.k = c_nationkey JOIN n b ON b.k = c_custkey % 30 WHERE a.k % 3 < 2 AND b.k % 3 < 2 GROUP BY ALL)"""


@query(f"WITH {_MAP} SELECT source, target, relationship, least(confidence, 1.0::DOUBLE) AS confidence FROM e")
def lineage_map_edges(spark, sf_dir):
    """Edges between systems of a graph with odd names, loose ends and repeats."""
    return _map(spark, sf_dir)[1]


@query(f"WITH {_MAP} SELECT id, CASE WHEN k % 2 = 0 THEN n_name ELSE id END AS label, 'TABLE' AS type, '' AS path, '' AS purpose FROM n WHERE id IN (SELECT source FROM e UNION SELECT target FROM e)")
def lineage_map_nodes(spark, sf_dir):
    """The nodes of those edges."""
    return _map(spark, sf_dir)[0]


@query("""WITH b AS (SELECT conv_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1) // 3 AS batch FROM conversations WHERE turn IS NOT NULL AND text IS NOT NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, batch ORDER BY turn, text) AS i FROM b WHERE length(t) >= 60),
  r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY batch)::INTEGER AS record_no, string_agg(t, '|' ORDER BY i) FILTER (i <= 2) AS facts FROM f GROUP BY conv_id, batch)
SELECT conv_id, record_no, facts FROM r WHERE record_no > 1 UNION ALL (SELECT conv_id, record_no, facts FROM r WHERE record_no = 1 ORDER BY conv_id LIMIT greatest(0, 80 - (SELECT count(*) FROM r WHERE record_no > 1)))""")
def chunk_records(spark, sf_dir):
    """Turns of conversations as records of up to two facts from three turns; later ones, topped up by first ones."""
    c = table(spark, sf_dir, "conversations").where("turn IS NOT NULL AND text IS NOT NULL")
    r = ingest.chunk_records(c, "conv_id", ["turn", "text"], "text", size=3, most=2, least=60)
    out = ingest.topped_up(r.where("record_no > 1"), r.where("record_no = 1"), ["conv_id"], 80)
    return out.select("conv_id", "record_no", F.array_join("facts", "|").alias("facts"))


@query(r"""WITH v AS (SELECT * FROM events ORDER BY event_type <> 'click', ts, event_id LIMIT 1)
SELECT 'ViolationAttributor live summary' || chr(10) || 'Failing check: ' || c || chr(10) || 'Field: ' || event_type || chr(10) || 'Top cause: ' || f || chr(10) || 'Commit: ' || user_id || chr(10) || 'Author: unknown' || chr(10) || 'Lineage traversal: ' || c || ' -> n1 -> n' || event_id || chr(10) || 'First downstream hop: n1' || chr(10) || 'Blast radius: none' AS summary
FROM (SELECT *, CASE WHEN event_type = 'click' THEN 'week3.confidence_unit_scale' ELSE event_type || '.range' END AS c, 'f' || event_id AS f FROM v)""")
def live_summary(spark, sf_dir):
    """The violation that stands for those made of events, in words."""
    e, name = table(spark, sf_dir, "events"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    check = F.when(F.col("event_type") == "click", "week3.confidence_unit_scale").otherwise(F.concat("event_type", F.lit(".range")))
    blame = F.array(F.struct(name("f", "event_id").alias("file_path"), F.col("user_id").cast("string").alias("commit_hash"), F.lit(None).cast("string").alias("author")))
    v = e.select("ts", "event_id", check.alias("check_id"), F.col("event_type").alias("field_name"), blame.alias("blame"), F.array(F.lit("n1"), name("n", "event_id")).alias("lineage"), F.array().cast("array<string>").alias("affected"))
    return reporting.live_summary(v, ["ts", "event_id"])
