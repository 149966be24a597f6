"""Streams with event time: fingerprints seen for the first time, and hours in which a batch was uploaded.

Both keep state that the watermark bounds.  A watermark of ``delay`` stands that long behind the newest event that
an earlier micro-batch has brought.  *Late rows* are those older than the watermark with which the micro-batch before
theirs worked; Spark drops them, and they neither show up nor change the state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keysift import wordlists as w
from keysift.catalog import Rule
from keysift.operators.detect import describe, detect, explode_secrets


def first_seen_events(files: DataFrame, time_col: str, delay: str, content: str = "content",
                      rules: Sequence[Rule] | None = None) -> DataFrame:
    """Detections whose fingerprint is new: none with it came within ``delay`` before.

    ``files`` is a stream with the event time in ``time_col``.  State holds one row per
    fingerprint until the watermark has passed its first event by ``delay``; one that turns up after that is reported
    anew.  Of equal fingerprints in one micro-batch any one is reported.  Rows without a time
    never expire and are left out.
    """
    timed = files.where(F.col(time_col).isNotNull()).withWatermark(time_col, delay)
    found = describe(explode_secrets(detect(timed, content, rules)), rules)
    return found.dropDuplicatesWithinWatermark(["sha256_fingerprint"])


def batch_alerts(findings: DataFrame, delay: str = "1 hour", time_col: str = "latest_commit_date", repo_col: str = "repo_url",
                 least: int = w.BATCH_REPOS_MIN) -> DataFrame:
    """(hour, repos) as soon as the ``least``-th distinct repository of an hour arrives; once per hour.

    ``findings`` is a stream of LEAKED findings.  An hour's state holds fewer than ``least`` names, or that it has been
    reported, and is dropped once the watermark has passed its end.  Before the shuffle each task reduces an
    hour to as many distinct repositories as matter, so an hour with most of the rows is no hot key.  Rows
    without a time or repository count for nothing.
    """
    hours = findings.where(F.col(time_col).isNotNull() & F.col(repo_col).isNotNull()).select(
        F.date_trunc("HOUR", time_col).alias("start"), F.col(repo_col).cast("string").alias("repo"))

    def few(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """At most ``least`` distinct repositories of an hour; if these are fewer, all of them."""
        seen: dict = {}
        for frame in frames:
            distinct = frame.drop_duplicates()
            keep = []
            for start, repo in zip(distinct["start"], distinct["repo"]):
                names = seen.setdefault(start, set())
                keep.append(len(names) < least and repo not in names)
                if keep[-1]:
                    names.add(repo)
            yield distinct[keep]

    def alert(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names = list(state.get[0]) if state.exists else []
        reported = len(names) >= least
        for frame in frames:
            for repo in frame["repo"]:
                if len(names) < least and repo not in names:
                    names.append(repo)
        state.update((names,))
        end = int((key[0] + pd.Timedelta(hours=1)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if len(names) >= least and not reported:
            yield pd.DataFrame({"start": [key[0]], "repos": [sorted(names)]})

    reduced = hours.mapInPandas(few, "start timestamp, repo string").withWatermark("start", delay)
    alerts = reduced.groupBy("start").applyInPandasWithState(
        alert, "start timestamp, repos array<string>", "repos array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return alerts.select(F.date_format("start", "yyyy-MM-dd'T'HH").alias("hour"), "repos")


def write_events(events: DataFrame, out_dir: str, state_dir: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of events to a table; each is there once, also after a restart."""
    return (events.writeStream.format("parquet").outputMode("append").option("path", out_dir)
            .option("checkpointLocation", state_dir).trigger(**(trigger or {"availableNow": True})).start())
