"""Live operators over several micro-batches that come in wrong time order."""

import heapq
import json
import os
import random
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
import pytest

from clipline.session import scratch
from clipline.streaming import events as E
from clipline.streaming import live as L

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stream(spark, batches, schema=E.EVENT_SCHEMA):
    """A stream that reads one file, that is one batch, at a time, in the order given."""
    path = scratch(spark, "batches")
    os.makedirs(path)
    for i, rows in enumerate(batches):
        name = f"{path}/{i}.json"
        with open(name, "w") as out:
            out.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    return E.read_events(spark, path, schema, files_per_trigger=1)


def at(seconds):
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def made(order):
    """Five batches of an hour each, hours apart, two jobs; ``order`` says which comes when."""
    rng, rows = random.Random(1), []
    for hour in range(5):
        rows.append([{"job_id": job, "video_id": job, "ts": at(hour * 7200 + s), "seq": hour * 1000 + i,
                      "kind": "progress", "progress": 0.5}
                     for job in (1, 2) for i, s in enumerate(sorted(rng.sample(range(3600), 60)))])
    return [rows[i] for i in order]



ORDERS = [[0, 1, 2, 3, 4], [4, 1, 3, 0, 2]]


@pytest.mark.parametrize("order", ORDERS)
def test_throttle_keeps_one_row_in_every_stretch_whatever_the_order(spark, order):
    batches = made(order)
    kept = [(r.job_id, r.ts.timestamp() - START.timestamp())
            for r in E.run_append(L.throttle(stream(spark, batches), 300.0), "t", idle_batches=False).collect()]
    for job in (1, 2):
        own = sorted(t for j, t in kept if j == job)
        assert all(b - a >= 300 for a, b in zip(own, own[1:]))
        times = [datetime.strptime(r["ts"], "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=timezone.utc).timestamp()
                 - START.timestamp() for b in batches for r in b if r["job_id"] == job]
        assert all(any(abs(t - k) < 300 for k in own) for t in times)
        if order == ORDERS[0]:
            wanted, last = [], None
            for t in sorted(times):
                if last is None or t - last >= 300:
                    wanted.append(t)
                    last = t
            assert own == wanted


@pytest.mark.parametrize("order", ORDERS)
def test_until_terminal_loses_no_row_before_the_end(spark, order):
    batches = made(order)
    for batch in batches:
        for row in batch:
            if row["seq"] == 2030 and row["job_id"] == 1:
                row["kind"] = "done"
    kept = {(r.video_id, r.seq) for r in E.run_append(L.until_terminal(stream(spark, batches)), "u", idle_batches=False).collect()}
    wanted = {(r["video_id"], r["seq"]) for b in batches for r in b if r["video_id"] == 2 or r["seq"] <= 2030}
    assert wanted <= kept
    if order == ORDERS[0]:
        assert kept == wanted
    else:  # hours 4 and 3 came before the end was known; the rows of hour 2 behind it did not pass
        assert {s for v, s in kept - wanted} == {h * 1000 + i for h in (4, 3) for i in range(60)}


def plain_merge(rows):
    out = []
    for start, end, kind in sorted(rows):
        gap = 0.8 if kind == "highlight" else 1.5
        if out and out[-1][2] == kind and abs(out[-1][1] - start) < gap:
            out[-1] = (out[-1][0], end, kind)
        else:
            out.append((start, end, kind))
    return out


def test_merge_takes_segments_in_any_order_within_the_delay(spark):
    rng, rows, t = random.Random(2), [], 0.0
    for _ in range(400):
        t = round(t + rng.choice([0.5, 1.0, 2.0]), 3)
        rows.append((t, round(t + rng.choice([0.2, 0.6, 1.1]), 3), rng.choice(["highlight", "effect"])))
    mixed = sorted(rows, key=lambda r: r[0] + rng.random() * 40)
    batches = [[{"video_id": 1, "ts": at(s), "start_s": s, "end_s": e, "structure_type": k} for s, e, k in mixed[i:i + 40]]
               for i in range(0, len(mixed), 40)]
    batches.append([{"video_id": 2, "ts": at(5000.0), "start_s": 5000.0, "end_s": 5001.0, "structure_type": "effect"}])
    schema = "video_id bigint, ts timestamp, start_s double, end_s double, structure_type string"
    found = E.run_append(L.live_merge(stream(spark, batches, schema)), "m").filter("video_id = 1").collect()
    assert sorted((r.start_s, r.end_s, r.structure_type) for r in found) == sorted(plain_merge(rows))


class _State:
    """Value or map state of one key in a dictionary; counts the longest value it gave."""

    def __init__(self):
        self.rows, self.longest = {}, 0

    def exists(self):
        return () in self.rows

    containsKey = lambda self, key: key in self.rows
    clear = lambda self: self.rows.clear()

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.rows[()] = value

    def updateValue(self, key, value):
        self.rows[key] = value

    def getValue(self, key):
        value = self.rows[key]
        self.longest = max(self.longest, len(str(value[0])))
        return value

    def removeKey(self, key):
        del self.rows[key]


class _Handle:
    def __init__(self):
        self.timers, self.states = [], {}

    def getValueState(self, name, schema, **_):
        return self.states.setdefault(name, _State())

    getMapState = lambda self, name, *_, **__: self.states.setdefault(name, _State())

    def registerTimer(self, ms):
        if ms not in self.timers:
            heapq.heappush(self.timers, ms)


def test_merge_of_many_waiting_rows_reads_a_stretch_at_a_time():
    merge, handle, rows = L._Merge(), _Handle(), []
    merge.init(handle)
    n = 100_000
    for low in range(0, n, 10_000):
        part = pd.DataFrame({"start_s": [i * 0.4 for i in range(low, low + 10_000)]})
        part["ts"] = pd.to_datetime(part.start_s, unit="s", utc=True)
        part["end_s"] = part.start_s + 0.1
        part["structure_type"] = ["highlight" if (i // 50) % 2 else "effect" for i in range(low, low + 10_000)]
        part = part.assign(sub_type=None, confidence=0.5, evidence="[]")
        list(merge.handleInputRows((7,), iter([part]), None))
        rows += list(part[["start_s", "end_s", "structure_type"]].itertuples(index=False, name=None))
    found, now = [], int(n * 400) + 10_000
    while handle.timers and handle.timers[0] <= now:
        ms = heapq.heappop(handle.timers)
        for out in merge.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now),
                                            SimpleNamespace(getExpiryTimeInMs=lambda: ms)):
            found += list(out[["start_s", "end_s", "structure_type"]].itertuples(index=False, name=None))
    assert found == plain_merge(rows)
    assert handle.states["waiting"].longest < 10_000 and not handle.states["waiting"].rows


def test_merge_of_few_waiting_rows_keeps_them_in_one_value():
    """A row in every stretch, in two batches out of order: one value and a timer or two, not an entry and a timer each."""
    merge, handle = L._Merge(), _Handle()
    merge.init(handle)
    rows = [(i * 10.0, i * 10.0 + (8.7 if i % 3 else 1.0), "effect" if i % 7 else "highlight") for i in range(60)]

    def fire(now):
        found = []
        while handle.timers and handle.timers[0] <= now:
            ms = heapq.heappop(handle.timers)
            for out in merge.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now),
                                                SimpleNamespace(getExpiryTimeInMs=lambda: ms)):
                found += list(out[["start_s", "end_s", "structure_type"]].itertuples(index=False, name=None))
        return found

    for half in (rows[1::2], rows[::2]):
        part = pd.DataFrame(half, columns=["start_s", "end_s", "structure_type"]).assign(sub_type=None, confidence=0.5, evidence="[]")
        part["ts"] = pd.to_datetime(part.start_s, unit="s", utc=True)
        list(merge.handleInputRows((7,), iter([part]), None))
    assert len(handle.timers) <= 2 and not handle.states["waiting"].rows
    found = fire(305_000)
    assert found and len(handle.timers) <= 2
    assert found + fire(700_000) == plain_merge(rows) and not handle.timers
    assert not any(s.rows for s in handle.states.values())


def test_merge_goes_over_to_stretches_when_many_rows_wait(monkeypatch):
    monkeypatch.setattr(L, "TOGETHER", 20)
    test_merge_of_few_waiting_rows_in_batches()


def test_merge_of_few_waiting_rows_in_batches():
    """Small batches with the watermark behind them, few and more rows than are kept together: as a plain loop."""
    rng = random.Random(5)
    rows = [(i * 1.0, i + rng.choice([0.1, 0.5, 0.9]), rng.choice(["highlight", "effect", "unclassified"])) for i in range(300)]
    merge, handle, found = L._Merge(), _Handle(), []
    merge.init(handle)

    for low in range(0, 400, 15):
        own = rows[low:low + 15]
        rng.shuffle(own)
        if own:
            part = pd.DataFrame(own, columns=["start_s", "end_s", "structure_type"]).assign(sub_type=None, confidence=0.5, evidence="[]")
            part["ts"] = pd.to_datetime(part.start_s, unit="s", utc=True)
            list(merge.handleInputRows((7,), iter([part]), None))
        now = low * 1000 - 20_500
        while handle.timers and handle.timers[0] <= now:
            ms = heapq.heappop(handle.timers)
            for out in merge.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now),
                                                SimpleNamespace(getExpiryTimeInMs=lambda: ms)):
                found += list(out[["start_s", "end_s", "structure_type"]].itertuples(index=False, name=None))
    want = []
    for start, end, kind in rows:
        gap = 0.8 if kind == "highlight" else 1.5
        if want and want[-1][2] == kind != "unclassified" and abs(want[-1][1] - start) < gap:
            want[-1] = (want[-1][0], end, kind)
        else:
            want.append((start, end, kind))
    assert found == want and not handle.states["waiting"].rows
