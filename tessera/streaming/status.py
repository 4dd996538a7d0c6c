"""What becomes of watched datasets: a state for each of them, kept over micro-batches, with a timer for validations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "signature string, status string, last_scan_us long, last_event_us long, last_completed_us long, last_reason string, last_error string, validation_count long, due_us long"
_NAMES = [c.split()[0] for c in STATE.split(", ")]
CHANGED, NO_OUTCOME = "outputs_changed", "no outcome in time"
#: Shares of the datasets, each of which has one state and one timer.
SHARES = 1024


def _step(s: dict, at: int, event: str, signature: str | None, detail: str | None, limit_us: int | None) -> None:
    """Take one event into the state ``s``."""
    _expire(s, at)
    if event == "scan":
        s["last_scan_us"] = at
        if None not in (s["signature"], signature) and s["signature"] != signature:
            s.update(status="stale", last_reason=CHANGED, last_event_us=at, due_us=None)
        s["signature"] = signature if signature is not None else s["signature"]
    elif event == "start":
        s.update(status="validating", last_reason=detail, last_event_us=at, last_error=None, due_us=None if limit_us is None else at + limit_us)
    elif event == "done":
        s.update(status="watching", last_completed_us=at, validation_count=s["validation_count"] + 1, due_us=None)
    elif event == "error":
        s.update(status="error", last_error=detail, last_completed_us=at, due_us=None)


def _expire(s: dict, now: int) -> bool:
    """A validation that was due before ``now`` ended without an outcome."""
    if s["due_us"] is None or s["due_us"] >= now:
        return False
    s.update(status="error", last_error=NO_OUTCOME, last_completed_us=s["due_us"], due_us=None)
    return True


def statuses(events: DataFrame, limit: float | None = None, late: str = "0 seconds", shares: int = SHARES) -> DataFrame:
    """A stream of (dataset, status, busy, validation_count, last_reason, last_error, last_scan_at, last_event_at,
    last_completed_at), a row for each dataset that a micro-batch changes; write it in update mode.

    ``events``: a stream of (dataset string, at timestamp, n long, event, signature, detail string). A ``scan`` tells the
    signature of a dataset's files, the first of which only sets it; ``start``, ``done`` and ``error`` tell of validations,
    with their reason or message in ``detail``. A dataset is idle at first, stale once its signature changes, validating
    from start on, then watching or in error. A validation without an outcome in ``limit`` seconds of event time is in
    error, by a timer where no later event of the dataset says so: an executor that is lost leaves none validating for ever.

    Events of a micro-batch are taken in order of time and n, batches as they come; those later than ``late`` are left out.
    Datasets are dealt by hash into ``shares``, since a call for each dataset takes more than its few events; a checkpoint
    keeps to the number it began with. A task holds the events of one share in one micro-batch, so the source's limit of
    files by trigger bounds it, and the states of the share, a short text for each dataset, whatever the length of its
    history. Events of no dataset, time or known name don't count, null signatures change nothing.
    """
    limit_us = None if limit is None else int(limit * 1_000_000)
    known = events.where(F.col("dataset").isNotNull() & F.col("at").isNotNull() & F.col("event").isin("scan", "start", "done", "error"))
    chosen = known.withWatermark("at", late).select(F.pmod(F.xxhash64("dataset"), F.lit(shares)).alias("share"), "dataset", "at", F.unix_micros("at").alias("us"), F.coalesce("n", F.lit(-1)).alias("n"), "event", "signature", "detail")

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {d: dict(zip(_NAMES, values, strict=True)) for d, values in json.loads(state.get[0]).items()} if state.exists else {}
        changed = {}
        if not state.hasTimedOut:
            rows = pd.concat([b[["dataset", "us", "n", "event", "signature", "detail"]] for b in batches]).sort_values(["us", "n"], kind="stable")
            texts = {c: rows[c].astype("object").where(rows[c].notna(), None).tolist() for c in ("signature", "detail")}
            for dataset, us, event, signature, detail in zip(rows["dataset"].tolist(), rows["us"].tolist(), rows["event"].tolist(), texts["signature"], texts["detail"], strict=True):
                s = known.get(dataset)
                if s is None:
                    s = known[dataset] = dict.fromkeys(_NAMES) | {"status": "idle", "validation_count": 0}
                _step(s, us, event, signature, detail, limit_us)
                changed[dataset] = s
        passed = state.getCurrentWatermarkMs()
        changed |= {d: s for d, s in known.items() if _expire(s, passed * 1000)}
        state.update((json.dumps({d: [s[c] for c in _NAMES] for d, s in known.items()}),))
        due = min((s["due_us"] for s in known.values() if s["due_us"] is not None), default=None)
        if due is not None:
            state.setTimeoutTimestamp(max(due // 1000 + 1, passed + 1))
        out = [(d, *(s[c] for c in _NAMES)) for d, s in changed.items()]
        yield pd.DataFrame(out, columns=["dataset", *_NAMES], dtype="object").astype({c: "Int64" for c in _NAMES if c.endswith("_us") or c == "validation_count"})

    out = chosen.groupBy("share").applyInPandasWithState(take, f"dataset string, {STATE}", "states string", "update", GroupStateTimeout.EventTimeTimeout)
    at = lambda name: F.timestamp_micros(f"{name}_us").alias(f"{name}_at")
    return out.select("dataset", "status", (F.col("status") == "validating").alias("busy"), "validation_count", "last_reason", "last_error", at("last_scan"), at("last_event"), at("last_completed"))


def latest_statuses(written: DataFrame) -> DataFrame:
    """The newest row of each dataset; ``written``: rows of ``statuses`` with the number of their ``batch``."""
    newest = F.max_by(F.struct(*[c for c in written.columns if c not in ("dataset", "batch")]), "batch").alias("s")
    return written.groupBy("dataset").agg(newest).select("dataset", "s.*")
