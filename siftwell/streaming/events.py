"""Stateful streams over attempts, job events and captures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell.operators.jobs import allowed_targets


def illegal_transitions(events: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """A stream of ``job_id, seq, state`` to the events that their predecessor does not allow.

    The state per job is its last state. Within a micro-batch events are taken in order of ``seq``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        bad = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            legal = row.state == "QUEUED" if last is None else row.state in allowed_targets(stages, last)
            if not legal:
                bad.append((row.job_id, row.seq, last, row.state))
            last = row.state
        state.update((last,))
        yield pd.DataFrame(bad, columns=["job_id", "seq", "previous", "state"])

    return events.select("job_id", "seq", "state").groupBy("job_id").applyInPandasWithState(
        step, "job_id string, seq int, previous string, state string", "state string", "append", GroupStateTimeout.NoTimeout
    )


def breaker(attempts: DataFrame, threshold: int = 3) -> DataFrame:
    """A stream of attempts ``provider, idx, status`` with ``open_before``.

    The state per provider is its run of failures; success or an empty answer ends it, a skipped
    call leaves it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        run = state.get[0] if state.exists else 0
        rows = []
        for row in pd.concat(list(batches)).sort_values("idx").itertuples(index=False):
            rows.append((row.provider, row.idx, row.status, run >= threshold))
            run = run + 1 if row.status == "FAILED" else 0 if row.status in ("OK", "EMPTY") else run
        state.update((run,))
        yield pd.DataFrame(rows, columns=["provider", "idx", "status", "open_before"])

    return attempts.select("provider", "idx", "status").groupBy("provider").applyInPandasWithState(
        step, "provider string, idx long, status string, open_before boolean", "run int", "append", GroupStateTimeout.NoTimeout
    )


def attempt_windows(attempts: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Attempts ``at, provider, status`` per event-time window and provider, behind a watermark."""
    s = F.col("status")
    return (
        attempts.withWatermark("at", late)
        .groupBy(F.window("at", size).alias("w"), "provider")
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_if(s == "FAILED").alias("failed"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "provider", "attempts", "failed")
    )


def first_documents(documents: DataFrame, late: str = "1 day") -> DataFrame:
    """Arriving documents ``at, text_sha256, ...`` once per text within the watermark.

    An addition for ingestion; it does not replace grouping, which drops nothing.
    """
    return documents.withWatermark("at", late).dropDuplicatesWithinWatermark(["text_sha256"])


def capture(stream: DataFrame, folder: str, checkpoint: str):
    """Append source captures per micro-batch; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def captured(batches: DataFrame) -> DataFrame:
    """The latest capture of each source."""
    fields = [c for c in batches.columns if c not in ("job_id", "position")]
    latest = batches.groupBy("job_id", "position").agg(F.max_by(F.struct(*fields), "batch").alias("r"))
    return latest.select("job_id", "position", "r.*")


def robots_ttl(events: DataFrame, ttl_s: float = 86_400.0) -> DataFrame:
    """A stream of ``origin, at, seq, kind, outcome`` to the pages' rows with the entry that holds for them.

    kind ``entry`` is a robots.txt fetch with its outcome, ``page`` a request. An entry that allows or
    was parsed holds for ``ttl_s`` from its time on; others hold for no later request. The state per
    origin is the entry and when it expires.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        outcome, expires = state.get if state.exists else (None, 0.0)
        rows = []
        for row in pd.concat(list(batches)).sort_values(["at", "seq"]).itertuples(index=False):
            now = row.at.timestamp()
            if row.kind == "entry":
                keeps = row.outcome in ("PARSED", "UNAVAILABLE_ALLOW")
                outcome, expires = (row.outcome, now + ttl_s) if keeps else (None, 0.0)
            else:
                rows.append((row.origin, row.seq, outcome if now < expires else None))
        state.update((outcome, expires))
        yield pd.DataFrame(rows, columns=["origin", "seq", "outcome"])

    return events.select("origin", "at", "seq", "kind", "outcome").groupBy("origin").applyInPandasWithState(
        step, "origin string, seq long, outcome string", "outcome string, expires double", "append", GroupStateTimeout.NoTimeout
    )


def missed_sources(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of ``job_id, position, at, kind, deadline`` to the sources that their job's deadline cut off.

    kind is ``selected``, ``started`` or ``captured``. When event time passes the deadline, sources that
    were started and not captured are INTERRUPTED and others not captured are NOT_RUN rows; none is
    dropped. The state per job is its open sources.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        open_sources = dict(json.loads(state.get[0])) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            rows = [(key[0], int(p), "INTERRUPTED" if started else "NOT_RUN") for p, started in sorted(open_sources.items(), key=lambda x: int(x[0]))]
            yield pd.DataFrame(rows, columns=["job_id", "position", "state"])
            return
        deadline = None
        order = {"selected": 0, "started": 1, "captured": 2}
        rows = pd.concat(list(batches))
        for row in rows.assign(_o=rows["kind"].map(order)).sort_values(["at", "_o"]).itertuples(index=False):
            if row.kind == "captured":
                open_sources.pop(str(row.position), None)
            else:
                open_sources[str(row.position)] = row.kind == "started"
            deadline = row.deadline
        state.update((json.dumps(open_sources),))
        if deadline is not None:
            state.setTimeoutTimestamp(max(int(deadline.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    keyed = events.withWatermark("at", late).select("job_id", "position", "at", "kind", "deadline")
    return keyed.groupBy("job_id").applyInPandasWithState(step, "job_id string, position int, state string", "open string", "append", GroupStateTimeout.EventTimeTimeout)
