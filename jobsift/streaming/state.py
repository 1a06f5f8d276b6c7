"""Rules that need a memory of their own for each source (S09 with W06 and W07, T06), on Structured Streaming state.

``applyInPandasWithState`` keeps a few numbers a source in the checkpoint; a
restart goes on from them, and a replayed batch starts from the state before it.
Rows of one batch are put in order inside their group, so their order of
arrival in the batch does not matter.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# --- fixed values: stop and alert rules ------------------------------------
FAILURES_MAX = 5       # consecutive failed pages
NO_NEW_HOURS = 24      # no new postings in 24 hours,
HELD_HOURS = 1         # held for 1 hour
# --- end of fixed values --------------------------------------------------

PAGE_STATUS = "source string, page long, n_postings long, status string, empty_streak long, failure_streak long, alert boolean"
ALERTS = "source string, event string, at timestamp, last_seen timestamp"


def streaks(hit: np.ndarray, before: int) -> np.ndarray:
    """How many hits in a row end at each place; ``before`` of them came before the first."""
    place = np.arange(1, len(hit) + 1)
    last_miss = np.maximum.accumulate(np.where(hit, 0, place))
    return np.where(hit, place - last_miss + np.where(last_miss == 0, before, 0), 0)


def stop_pages(pages: DataFrame, max_empty: int | None = None, failures_max: int = FAILURES_MAX) -> DataFrame:
    """S09 / W07 / W06 on a stream of pages (source, page, n_postings, has_next, failed): each page's status.

    ``max_empty=None``: a source stops at its first page without postings or
    without a next one; ``max_empty=k``: at the k-th page without postings in a
    row.  Pages up to the stop are ``kept``, later ones ``after_stop`` whenever
    they come, and a page before the last one seen is judged by the stop alone.
    Consecutive failed pages are counted up to the stop and alert at ``failures_max``.
    A null n_postings counts as none, a null has_next as a next page.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stop, last, empty, failures = state.get if state.exists else (-1, -1, 0, 0)
        rows = pd.concat(list(chunks)).sort_values("page", kind="stable")
        page = rows["page"].to_numpy(np.int64)
        n = rows["n_postings"].fillna(0).to_numpy(np.int64)
        failed = rows["failed"].fillna(False).to_numpy(bool)
        new = page > last  # in order after what came before
        empties, fails = np.zeros(len(page), np.int64), np.zeros(len(page), np.int64)
        empties[new], fails[new] = streaks(n[new] == 0, empty), streaks(failed[new], failures)
        if stop < 0:
            ends = (n == 0) | ~rows["has_next"].fillna(True).to_numpy(bool) if max_empty is None else new & (empties >= max_empty)
            if ends.any():
                stop = int(page[ends].min())
        kept = (page <= stop) | (stop < 0)
        if new.any():
            last, empty, failures = int(page[-1]), int(empties[new][-1]), int(fails[new][-1])
        state.update((stop, last, empty, failures))
        fails = np.where(kept, fails, 0)
        yield pd.DataFrame({"source": key[0], "page": page, "n_postings": n, "status": np.where(kept, "kept", "after_stop"),
                            "empty_streak": np.where(kept, empties, 0), "failure_streak": fails, "alert": fails >= failures_max})

    shaped = pages.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("page").cast("long").alias("page"),
                          F.col("n_postings").cast("long").alias("n_postings"), "has_next", "failed").where(F.col("page").isNotNull())
    return shaped.groupBy("source").applyInPandasWithState(
        run, PAGE_STATUS, "stop long, last long, empty long, failures long", "append", GroupStateTimeout.NoTimeout)


def until_stop(postings: DataFrame, statuses: DataFrame, apart: bool = False) -> DataFrame:
    """The postings (source, page, ...) of the pages that are kept; with ``apart`` those of the pages after the stop."""
    wanted = statuses.where(F.col("status") == ("after_stop" if apart else "kept")).select("source", "page")
    return postings.join(wanted, ["source", "page"], "left_semi")


def no_new_alerts(rows: DataFrame, time: str = "ts", delay: str = "1 hour", hours: int = NO_NEW_HOURS, held: int = HELD_HOURS) -> DataFrame:
    """T06 on a stream of new postings (source, ts): alerts that fire and clear.

    A source's alert fires ``hours + held`` hours after its last posting, by an
    event-time timer, so also when no row of it arrives any more (the watermark
    moves on by other sources); a new posting clears it.  Rows: the event
    (``fired`` or ``cleared``), when, and the last posting before.  Rows later
    than the watermark are dropped; a row before the last one seen changes nothing.
    """
    limit = _dt.timedelta(hours=hours + held)

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            last, _ = state.get
            at = pd.Timestamp(last, unit="us")
            out.append((key[0], "fired", at + limit, at))
            state.update((last, True))
        else:
            last, fired = state.get if state.exists else (None, False)
            times = np.sort(pd.concat(list(chunks))["ts"].to_numpy("datetime64[us]").astype(np.int64))
            gap = int(limit.total_seconds() * 1_000_000)
            times = times[times > last] if last is not None else times
            if len(times):
                before = np.concatenate([[times[0] if last is None else last], times[:-1]])
                for k in np.flatnonzero((times - before > gap) | (fired & (np.arange(len(times)) == 0))):
                    seen, at = pd.Timestamp(before[k], unit="us"), pd.Timestamp(times[k], unit="us")
                    if not (fired and k == 0):
                        out.append((key[0], "fired", seen + limit, seen))
                    out.append((key[0], "cleared", at, seen))
                last, fired = int(times[-1]), False
            state.update((last, fired))
            if not fired:
                # timers cannot lie behind the watermark: then the next batch fires it
                state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["source", "event", "at", "last_seen"]).astype({"at": "datetime64[us]", "last_seen": "datetime64[us]"})

    shaped = rows.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col(time).cast("timestamp").alias("ts")).where("ts IS NOT NULL")
    return shaped.withWatermark("ts", delay).groupBy("source").applyInPandasWithState(
        run, ALERTS, "last long, fired boolean", "append", GroupStateTimeout.EventTimeTimeout)
