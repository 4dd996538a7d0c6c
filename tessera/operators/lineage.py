"""Lineage graphs: traversal, blast radius, seeds and blame, as joins over edge tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.reporting import numbered_overall
from tessera.sources.shared import kept


def traverse(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, backward: bool = False, paths: bool = False) -> DataFrame:
    """(start, node, hops) of all nodes reached, by the fewest hops; a start itself is left out.

    ``edges``: (source, target); ``starts``: (start). A frontier is joined with the edges until nothing new is found,
    so the number of joins is the depth of the graph; a node is visited once for each start, and written once, with
    those of its hop. ``max_hops`` bounds the hops only where it is given. With ``paths``, edges have a column
    ``relationship``, and the result also has ``path``, the nodes from start to node, and ``relationships``; of several
    shortest paths it is the least.
    """
    a, b = ("target", "source") if backward else ("source", "target")
    more = [F.col("relationship").alias("__by")] if paths else []
    e = edges.select(F.col(a).alias("__from"), F.col(b).alias("__to"), *more).where("__from IS NOT NULL AND __to IS NOT NULL").distinct()
    first = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct()
    if paths:
        first = first.withColumns({"path": F.array("start"), "relationships": F.array().cast("array<string>")})
    levels = [kept(first)]
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        step = levels[-1].join(e, levels[-1]["node"] == e["__from"])
        if paths:
            way = F.min(F.struct(F.array_append("path", F.col("__to")).alias("path"), F.array_append("relationships", F.col("__by")).alias("relationships"))).alias("way")
            step = step.groupBy("start", F.col("__to").alias("node")).agg(way)
        else:
            step = step.select("start", F.col("__to").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, [x.select("start", "node") for x in levels])
        step = step.join(seen, ["start", "node"], "left_anti")
        new = kept(step.select("start", "node", F.lit(hop).alias("hops"), *(["way.path", "way.relationships"] if paths else [])))
        if new.isEmpty():
            break
        levels.append(new)
    return reduce(DataFrame.unionByName, levels).where("node <> start")


def contract_graph(subscriptions: DataFrame) -> DataFrame:
    """(source, target, relationship): CONSUMED_BY of each subscription, PUBLISHES by the prefix before the first dash.

    ``subscriptions``: (contract_id, subscriber_id), small metadata. No self edges.
    """
    s = subscriptions.select("contract_id", "subscriber_id").distinct()
    consumed = s.select(F.col("contract_id").alias("source"), F.col("subscriber_id").alias("target"), F.lit("CONSUMED_BY").alias("relationship"))
    head = lambda c: F.substring_index(c, "-", 1)
    who, what = s.select(F.col("subscriber_id").alias("source")).distinct(), s.select(F.col("contract_id").alias("target")).distinct()
    published = who.join(what, head(F.col("source")) == head(F.col("target"))).where("source <> target")
    return consumed.unionByName(published.select("source", "target", F.lit("PUBLISHES").alias("relationship")))


def contamination_depth(reached: DataFrame, direct: DataFrame) -> DataFrame:
    """(start, node, hops, depth): 1 for direct subscribers; else the steps from the first of them on the node's own path,
    and 1 more; else the hops.

    ``reached``: of ``traverse`` with paths; ``direct``: (node) of the contract's own subscribers. A path's nodes are
    looked up by one join, and each task passes on the first place for each path.
    """
    d = direct.select(F.col("node").alias("__direct")).distinct()
    between = F.col("size") - 2
    ways = reached.select("start", "node", "hops", F.size("path").alias("size"), "path")
    steps = ways.select("start", "node", F.posexplode(F.slice("path", F.lit(2), F.greatest(between, F.lit(0)))).alias("place", "__direct"))
    first = steps.join(d, "__direct", "left_semi").groupBy("start", "node").agg(F.min("place").alias("place"))
    out = ways.drop("path").join(first, ["start", "node"], "left").join(d.withColumn("is_direct", F.lit(True)), F.col("node") == F.col("__direct"), "left")
    depth = F.when(F.col("is_direct"), 1).when(F.col("place").isNotNull(), 1 + between - F.col("place")).otherwise(F.greatest(F.col("hops"), F.lit(1)))
    return out.select("start", "node", "hops", depth.cast("int").alias("depth"))


def match_seeds(nodes: DataFrame, path: str, label: str) -> DataFrame:
    """(node_id, score): nodes that speak of a path and label, those within one point of the best and at least 4.

    ``nodes``: (node_id, path, label). The same path gives 10, an ending 8, the label 6, each token of the file stem 2
    and each other token 1.
    """
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    have = F.array_union(tokens(F.coalesce("path", F.lit("")), 3), tokens(F.coalesce("label", F.lit("")), 3))
    hits = lambda text: F.size(F.array_intersect(have, tokens(F.lit(text), 3)))
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = flag(F.col("path") == path, 10) + flag((F.col("path") != path) & F.lit(path).endswith(F.col("path")), 8) + flag(F.lower("label") == label.lower(), 6) + 2 * hits(stem) + hits(label)
    scored = nodes.select("node_id", score.alias("score"))
    best = scored.agg(F.greatest(F.lit(4), F.max("score") - 1).alias("least"))
    return scored.join(best, F.col("score") >= F.col("least")).select("node_id", "score")


def dataset_seeds(nodes: DataFrame, source_path: str, contract_id: str) -> DataFrame:
    """(node_id): the node of that very path, and datasets that at least two words of path and contract id speak of.

    ``nodes``: (node_id, type, path, label).
    """
    words = F.array_distinct(tokens(F.lit(f"{source_path} {contract_id}"), 3))
    told = F.lower(F.concat_ws(" ", "node_id", "path", "label"))
    hits = F.size(F.filter(words, lambda w: F.contains(told, w)))
    return nodes.where((F.col("path") == source_path) | ((F.upper("type") == "DATASET") & (hits >= 2))).select("node_id").distinct()


def upstream_producers(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, field: str) -> DataFrame:
    """(file_path, hops, service, token_matches, rank): files of the services upstream of the seeds, the likeliest first.

    A service owns the files below ``services/<name>``. Files whose path and label speak of more of the field's words
    come first, then near ones; a file counts once, by its best service.
    """
    reached = traverse(edges, seeds.select(F.col("node_id").alias("start")), backward=True).groupBy("node").agg(F.min("hops").alias("hops"))
    root = F.regexp_extract("path", r"^(.*?services/[^/]+)", 1)
    services = reached.join(nodes, F.col("node") == F.col("node_id")).where(F.upper("type") == "SERVICE").select(F.col("node_id").alias("service"), root.alias("root"), "hops").where("root <> ''")
    files = nodes.where(F.upper("type") == "FILE").select(F.col("path").alias("file_path"), root.alias("root"), "label")
    words = F.array_distinct(tokens(F.lit(field), 3))
    told = F.lower(F.concat_ws(" ", "file_path", "label"))
    found = files.join(services, "root").withColumn("token_matches", F.size(F.filter(words, lambda w: F.contains(told, w))))
    order = F.struct(-F.col("token_matches"), F.col("hops") + 1, "service")
    best = found.groupBy("file_path").agg(F.min_by(F.struct((F.col("hops") + 1).alias("hops"), "service", "token_matches"), order).alias("b")).select("file_path", "b.*")
    return numbered_overall(best, [F.desc("token_matches"), F.col("hops"), F.col("file_path")], "rank")


def candidate_files(nodes: DataFrame, field: str, hints: dict[str, list[str]] | None = None) -> DataFrame:
    """(path): files of nodes that speak of a part of the field's name; if none does, of a hint that its name asks for.

    ``hints``: a part of a name to the words to look for.
    """
    told = F.lower(F.concat_ws(" ", "node_id", "path", "label"))
    speaks = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(told, w)) if words else F.lit(False)
    parts = [p.lower() for p in field.replace("_", ".").split(".") if p]
    hinted = next((words for part, words in (hints or {}).items() if part in field.lower()), [])
    both = nodes.where("path IS NOT NULL AND path <> ''").select("path", speaks(parts).alias("direct"), speaks(hinted).alias("hinted")).where("direct OR hinted")
    direct = both.agg(F.coalesce(F.bool_or("direct"), F.lit(False)).alias("any"))
    return both.join(direct).where(F.col("direct") | ~F.col("any")).select("path").distinct()


def blame(producers: DataFrame, history: DataFrame, now: Column, top: int = 5) -> DataFrame:
    """(rank, path, commit, author, days, hops, confidence): who changed the likeliest files last.

    ``producers``: of ``upstream_producers``; ``history``: of ``git_history``, whose files without a commit are new today.
    """
    h = history.select(F.col("path").alias("file_path"), "commit", "author", F.greatest(F.lit(0), F.coalesce(F.date_diff(now, F.to_date("committed_at")), F.lit(0))).alias("days"))
    found = producers.join(h, "file_path").select(F.col("file_path").alias("path"), "commit", "author", "days", "hops")
    return ranked_blame(found, [], top).select("rank", "path", "commit", "author", "days", "hops", "confidence")


def merged_edges(edges: DataFrame, missing: float = 0.95) -> DataFrame:
    """One edge for each (source, target, relationship), of the highest confidence, held to 0 to 1; edges that name none
    have ``missing``."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence"), F.lit(missing))))
    return edges.groupBy("source", "target", "relationship").agg(F.max(inside).alias("confidence"))


def map_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, type, path, purpose) and edges (source, target, relationship, confidence) of a graph to be shown.

    Ids are trimmed, nodes without one and repeated ones left out (of those the least row stays); names that are missing get
    their id, UNKNOWN and DEPENDS_ON. Edges have both ends, the highest confidence of their like, none counting 0.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    said = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), other)
    n = nodes.select(text("node_id").alias("id"), said("label", text("node_id")).alias("label"), said("type", F.lit("UNKNOWN")).alias("type"), said("path", F.lit("")).alias("path"), said("purpose", F.lit("")).alias("purpose"))
    n = n.where("id <> ''").groupBy("id").agg(F.min(F.struct("label", "type", "path", "purpose")).alias("n")).select("id", "n.*")
    e = edges.select(text("source").alias("source"), text("target").alias("target"), said("relationship", F.lit("DEPENDS_ON")).alias("relationship"), F.col("confidence").cast("string").try_cast("double").alias("confidence"))
    return n, without_dangling(merged_edges(e, missing=0.0), n.select(F.col("id").alias("node_id")))


def subgraph(nodes: DataFrame, edges: DataFrame, shown: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The edges between nodes whose id is ``shown``, and the nodes that such an edge ends in."""
    e = edges.where(shown(F.col("source")) & shown(F.col("target")))
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi"), e


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist; ``nodes``: (node_id)."""
    n = nodes.select("node_id").distinct()
    return edges.join(n, F.col("source") == n["node_id"], "left_semi").join(n, F.col("target") == n["node_id"], "left_semi")


def merged_entries(entries: DataFrame) -> DataFrame:
    """Lineage entries by (source, kind, id), the fewest hops of each, in order of hops and id."""
    return entries.groupBy("source", "kind", "id").agg(F.min("hops").alias("hops")).orderBy("hops", "id")


def blame_confidence(days: Column, hops: Column) -> Column:
    """1, less a tenth for each day since the commit and a fifth for each hop; no less than 0."""
    return F.greatest(F.lit(0.0), F.round((F.lit(1.0) - days * 0.1) - hops * 0.2, 2))


def ranked_blame(candidates: DataFrame, per: list[str], top: int = 5) -> DataFrame:
    """The best candidates of each failure, or of all without ``per``: ``candidates`` (..., path, days, hops)."""
    scored = candidates.withColumn("confidence", blame_confidence(F.col("days"), F.col("hops")))
    order = [F.desc("confidence"), "hops", "path"]
    if not per:  # each task passes on its best, so the window sees no more than ``top`` rows
        scored = scored.orderBy(*order).limit(top)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def git_history(spark: SparkSession, repo: str, files: list[str], since: str | None = None) -> DataFrame:
    """(path, commit, author, committed_at, message): the last commit of each file, no older than ``since`` (14 days ago,
    2024-01-31); files without one get a hash of their name and content. A handful of files on the driver."""
    import hashlib
    import pathlib
    import subprocess

    rows = []
    for f in files:
        out = subprocess.run(["git", "-C", repo, "log", "-1", "--follow", *([f"--since={since}"] if since else []), "--format=%H%x1f%an%x1f%aI%x1f%s", "--", f], capture_output=True, text=True).stdout.strip()
        path = pathlib.Path(repo, f)
        if out:
            rows.append((f, *out.split("\x1f")[:4]))
        elif path.is_file():
            rows.append((f, hashlib.sha1(f.encode() + path.read_bytes()).hexdigest(), "unknown", None, "uncommitted"))
    return spark.createDataFrame(rows, "path string, commit string, author string, committed_at string, message string")
