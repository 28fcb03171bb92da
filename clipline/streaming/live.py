"""Operators on live events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clipline.constants import STALE_AFTER_S
from clipline.streaming.events import run_batches, use_rocksdb

TERMINAL = ("done", "error")
#: Time after which the state of a silent key is dropped.
FORGET_AFTER_S = 90 * 86_400.0


def dedupe_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Every module of a video once, although reconnects replay it within ``delay``."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["video_id", "module_id"])


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The rows of a key in this micro-batch by time, however many Arrow batches they come in.

    Holds one key's rows of one micro-batch, which the source's trigger limits.
    """
    parts = list(rows)
    if parts:
        yield from pd.concat(parts).sort_values(["ts", "seq"]).itertuples(index=False)


class _Throttle(StatefulProcessor):
    """Remembers the newest row that came through, and in each stretch of ``every`` seconds the one that did.

    Rows that come through lie ``every`` seconds apart, so a stretch holds one
    at most; only a row behind the newest looks at the stretches around it.
    """

    def __init__(self, every: float, forget_after: float):
        self.every, self.forget_ms = every, int(forget_after * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us bigint", ttlDurationMs=self.forget_ms)
        self.passed = handle.getMapState("passed", "stretch bigint", "us bigint", ttlDurationMs=self.forget_ms)

    def _free(self, us: int, width: int) -> bool:
        around = [(us // width + d,) for d in (-1, 0, 1)]
        return all(not self.passed.containsKey(k) or abs(self.passed.getValue(k)[0] - us) >= width for k in around)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        width, kept = max(1, int(self.every * 1e6)), []
        for row in _in_order(rows):
            us = row.ts.value // 1000
            if newest is None or us - newest >= width or (us < newest and self._free(us, width)):
                newest = us if newest is None else max(us, newest)
                self.passed.updateValue((us // width,), (us,))
                kept.append((key[0], row.ts, row.seq, min(max(row.progress, 0.0), 1.0)))
        if kept:
            self.newest.update((newest,))
        yield pd.DataFrame(kept, columns=["job_id", "ts", "seq", "progress"])

    def close(self) -> None:
        pass


def throttle(events: DataFrame, every: float = 2.0, forget_after: float = FORGET_AFTER_S) -> DataFrame:
    """At most one progress row per job and ``every`` seconds, the value clamped to 0..1.

    Rows are taken by time inside a micro-batch. However late a row is, it
    counts: it comes through unless another row that did lies within ``every``
    seconds before or after it. The state of a row that came through goes
    ``forget_after`` seconds of processing time later.
    """
    use_rocksdb(events.sparkSession)
    rows = events.filter(F.col("progress").isNotNull()).select("job_id", "ts", "seq", "progress")
    return rows.groupBy("job_id").transformWithStateInPandas(
        _Throttle(every, forget_after), "job_id bigint, ts timestamp, seq bigint, progress double", "Append",
        "ProcessingTime")


class _Expire(StatefulProcessor):
    def __init__(self, after: float):
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp")

    def _out(self, key, last) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "last_beat": [last],
                             "expired_at": [last + pd.Timedelta(seconds=self.after)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        expired = []
        for row in _in_order(rows):
            if last is not None and (row.ts - last).total_seconds() > self.after:
                expired.append(self._out(key, last))
            if last is None or row.ts > last:
                last = row.ts
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last.timestamp() + self.after) * 1000))
        self.last.update((last.to_pydatetime(),))
        if expired:
            yield pd.concat(expired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            last = pd.Timestamp(self.last.get()[0])
            self.last.clear()
            yield self._out(key, last)

    def close(self) -> None:
        pass


def expire_heartbeats(events: DataFrame, after: float = STALE_AFTER_S, delay: str = "10 minutes") -> DataFrame:
    """A row whenever a job had no beat for ``after`` seconds, by event time. Beats later than ``delay`` are dropped."""
    use_rocksdb(events.sparkSession)
    rows = events.select("job_id", "ts", "seq").withWatermark("ts", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(
        _Expire(after), "job_id bigint, last_beat timestamp, expired_at timestamp", "Append", "EventTime")


def latest_progress(events: DataFrame) -> DataFrame:
    """Newest progress per job, for update mode."""
    rows = events.filter(F.col("progress").isNotNull())
    return rows.groupBy("job_id").agg(
        F.max_by("progress", F.struct("ts", "seq")).alias("progress"), F.max("ts").alias("ts"))


def latest_of_batches(written: DataFrame) -> DataFrame:
    """Last update per job among the micro-batches written by ``run_batches``."""
    return written.groupBy("job_id").agg(F.max_by("progress", "batch").alias("progress"),
                                         F.max_by("ts", "batch").alias("ts"))


class _UntilTerminal(StatefulProcessor):
    """Remembers when a key ended: time and number of its first terminal row so far."""

    def __init__(self, forget_after: float):
        self.forget_ms = int(forget_after * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getValueState("ended", "us bigint, seq bigint", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = tuple(self.ended.get()) if self.ended.exists() else None
        before, kept = end, []
        for row in _in_order(rows):
            at = (row.ts.value // 1000, row.seq)
            if end is not None and at > end:
                break
            kept.append((key[0], row.ts, row.seq, row.kind))
            if row.kind in TERMINAL:
                end = at
        if end != before:
            self.ended.update(end)
        yield pd.DataFrame(kept, columns=["video_id", "ts", "seq", "kind"])

    def close(self) -> None:
        pass


def until_terminal(events: DataFrame, forget_after: float = FORGET_AFTER_S) -> DataFrame:
    """Events of a video up to and including its first ``done`` or ``error``.

    However late a row is, it passes if it lies before the first terminal row
    known when it comes, so no such row is lost; rows that passed before an
    earlier terminal row came are not taken back. That a video ended is
    forgotten ``forget_after`` seconds of processing time later.
    """
    use_rocksdb(events.sparkSession)
    rows = events.select("video_id", "ts", "seq", "kind")
    return rows.groupBy("video_id").transformWithStateInPandas(
        _UntilTerminal(forget_after), "video_id bigint, ts timestamp, seq bigint, kind string", "Append",
        "ProcessingTime")


def replay(history: DataFrame, live: DataFrame, name: str = "replay") -> DataFrame:
    """History rows (``origin`` 0) followed by live events (``origin`` 1), keyed by video.

    Both have (video_id, seq, kind).  History is written before the stream
    starts; ordering by (origin, seq) gives the order of delivery.  A video
    whose history no live event follows ends with a ``done`` row (``origin`` 2)
    whose ``seq`` is the number of its history rows.
    """
    columns = ["video_id", "seq", "kind"]
    old = history.select(*columns).withColumn("origin", F.lit(0))

    def prepare(rows: DataFrame, batch_id: int) -> DataFrame:
        return rows.select(*columns).withColumn("origin", F.lit(1))

    sent = run_batches(live, name, "append", prepare, first=old).select(*columns, "origin")
    followed = sent.filter("origin = 1").select("video_id").distinct()
    done = (sent.filter("origin = 0").groupBy("video_id").agg(F.count(F.lit(1)).alias("seq"))
            .join(followed, "video_id", "left_anti")
            .select("video_id", "seq", F.lit("done").alias("kind"), F.lit(2).alias("origin")))
    return sent.unionByName(done)


def live_windows(points: DataFrame, size: str = "1 second", step: str = "500 milliseconds",
                 delay: str = "5 seconds") -> DataFrame:
    """Points per sliding window of a live video; later rows than ``delay`` are dropped."""
    return (points.withWatermark("ts", delay).groupBy("video_id", F.window("ts", size, step).alias("w"))
            .agg(F.count(F.lit(1)).alias("cuts"))
            .select("video_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cuts"))


# Evidence travels as JSON.
_SEGMENT = "start_s double, end_s double, structure_type string, sub_type string, confidence double, evidence string"
_OPEN = f"{_SEGMENT}, end_ms bigint"
_FIELDS = ["start_s", "end_s", "structure_type", "sub_type", "confidence", "evidence"]
#: Media time whose waiting segments are read at once.
STRETCH_MS = 10_000
#: Waiting segments of a video that are kept in one value; where there are more, all wait by stretches.
TOGETHER = 500


def _joined(a: tuple, b: tuple) -> tuple:
    """Segment ``a`` continued by ``b``: last end, first sub-type, highest confidence, ordered union of evidence."""
    both = [x for x in (a[4], b[4]) if x is not None]
    evidence = list(dict.fromkeys([*json.loads(a[5] or "[]"), *json.loads(b[5] or "[]")]))
    return (a[0], b[1], a[2], a[3], max(both) if both else None, json.dumps(evidence))


class _Merge(StatefulProcessor):
    """Holds the open segment; other segments wait until the watermark has passed their start.

    Up to ``TOGETHER`` waiting segments are one value with one timer, since
    every call to the state is a round trip. A video with more keeps them, from
    then on, by stretches of media time: what a micro-batch brings for a
    stretch is one entry of a map, and the stretch has a timer at its first
    start. Timers come in order of time, so stretches are read one after the
    other; only one is in memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.few = handle.getValueState("few", "rows string")  # in order; null where segments wait by stretches
        self.entries = handle.getMapState("entries", "stretch bigint", "n bigint")
        self.waiting = handle.getMapState("waiting", "stretch bigint, i bigint", "rows string")

    @staticmethod
    def _gap(kind: str) -> float:
        return 0.8 if kind == "highlight" else 1.5

    def _together(self) -> list[list] | None:
        """The waiting segments, or nothing where they wait by stretches."""
        rows = self.few.get()[0] if self.few.exists() else "[]"
        return None if rows is None else json.loads(rows)

    def _wait(self, stretch: int, rows: list[list]) -> None:
        n = self.entries.getValue((stretch,))[0] if self.entries.containsKey((stretch,)) else 0
        self.waiting.updateValue((stretch, n), (json.dumps(rows),))
        self.entries.updateValue((stretch,), (n + 1,))
        self.handle.registerTimer(min(r[0] for r in rows) + 1)

    def _wait_by_stretches(self, rows: list[list]) -> None:
        stretches: dict[int, list[list]] = {}
        for row in rows:
            stretches.setdefault(row[0] // STRETCH_MS, []).append(row)
        for stretch, waiting in stretches.items():
            self._wait(stretch, waiting)

    def _take(self, stretch: int) -> list[list]:
        if not self.entries.containsKey((stretch,)):
            return []
        rows = []
        for i in range(self.entries.getValue((stretch,))[0]):
            rows.extend(json.loads(self.waiting.getValue((stretch, i))[0]))
            self.waiting.removeKey((stretch, i))
        self.entries.removeKey((stretch,))
        return sorted(rows, key=lambda r: r[:3])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        few = self._together()
        together, first = few is not None, few[0][0] if few else None
        for part in rows:
            own = [[None if x is None or x != x else x for x in part[f].tolist()] for f in _FIELDS]
            new = [list(r) for r in zip([int(t.timestamp() * 1000) for t in part["ts"]], *own)]
            if few is not None:
                few += new
                if len(few) <= TOGETHER:
                    continue
                new, few = few, None
            self._wait_by_stretches(new)
        if few:
            few.sort(key=lambda r: r[:3])
            self.few.update((json.dumps(few),))
            if first is None or few[0][0] < first:
                self.handle.registerTimer(few[0][0] + 1)
        elif few is None and together:
            self.few.update((None,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        stretch = (expiredTimerInfo.getExpiryTimeInMs() - 1) // STRETCH_MS
        few = self._together()
        rows = self._take(stretch) if few is None else few
        later = [r for r in rows if r[0] > now]
        current = tuple(self.open.get()) if self.open.exists() else None
        before, closed = current, []
        for at, *segment in rows[:len(rows) - len(later)]:
            start, end, kind = segment[:3]
            end_ms = at + int((end - start) * 1000)
            joins = current and current[2] == kind and kind != "unclassified"
            if joins and abs(current[1] - start) < self._gap(kind):
                current = (*_joined(current, segment), end_ms)
            else:
                if current:
                    closed.append(current[:6])
                current = (*segment, end_ms)
        if few is None:
            if later:
                self._wait(stretch, later)
        elif later:
            if len(later) < len(few):
                self.few.update((json.dumps(later),))
            self.handle.registerTimer(later[0][0] + 1)
        elif few:
            self.few.clear()
        if current:
            reach = current[6] + int(self._gap(current[2]) * 1000)
            last = min(now, reach) // STRETCH_MS
            if reach > now:
                self.handle.registerTimer(reach + 1)
            # Nothing that starts later can reach an end this far back.
            elif not (later if few is not None else any(self.entries.containsKey((s,)) for s in range(stretch, last + 1))):
                closed.append(current[:6])
                current = None
        if current is None:
            if before is not None:
                self.open.clear()
        elif current != before:
            self.open.update(current)
        if closed:
            out = pd.DataFrame(closed, columns=_FIELDS).astype({"confidence": float})
            out.insert(0, "video_id", key[0])
            yield out

    def close(self) -> None:
        pass


def live_merge(segments: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Merge neighbouring segments of one type as they arrive (see ``windows.merge_adjacent``).

    ``segments`` has (video_id, ts, start_s, end_s, structure_type) with
    ``ts`` the media time as a timestamp, and may have sub_type, confidence and
    evidence, which are combined as there.  A segment leaves when the next one
    does not join it or the watermark is past its reach.  Segments may come in
    any order within ``delay`` of media time; later ones are dropped.
    """
    use_rocksdb(segments.sparkSession)
    have = segments.columns
    evidence = F.to_json("evidence") if "evidence" in have else F.lit(None)
    rows = segments.withWatermark("ts", delay).select(
        "video_id", "ts", "start_s", "end_s", "structure_type",
        (F.col("sub_type") if "sub_type" in have else F.lit(None)).cast("string").alias("sub_type"),
        (F.col("confidence") if "confidence" in have else F.lit(None)).cast("double").alias("confidence"),
        evidence.cast("string").alias("evidence"))
    merged = rows.groupBy("video_id").transformWithStateInPandas(
        _Merge(), f"video_id bigint, {_SEGMENT}", "Append", "EventTime")
    return merged.withColumn("evidence", F.from_json("evidence", "array<string>"))
