"""Sequential walks over positions, split into chunks that run in parallel.

Two samplers decide the next position from the current one, so they look
inherently serial.  A walk never moves further than ``reach`` positions, so all
that a chunk needs from the chunks before it is where the walk enters it: one
of ``reach`` offsets.  Pass 1 works out, per chunk, where each entry offset
leads to in the next chunk; pass 2 follows these small tables along a video;
pass 3 replays each chunk from its true entry.  Only what can change the walk
reaches Python: the candidates of a sparse walk, or the runs of equal steps of
a dense one.  No task ever holds more than one chunk of a video, or one small
integer row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipline.operators import ordered as ordered_module


def chunk_size(reach: int, chunk: int | None = None) -> int:
    """Positions of a chunk; a walk never jumps over a whole one."""
    return max(chunk or ordered_module.ROWS_PER_CHUNK, reach)


def _with_entries(rows: DataFrame, leaves: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """``rows`` (video_id, _chunk, ...) with ``_entry``, the offset at which the walk enters their chunk.

    ``leaves`` gives, for each entry offset of a chunk, the offset in the next
    one. Chunks without rows let the walk pass, at offset 0 of the next.
    """
    key = rows.schema["video_id"].dataType.simpleString()

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]], "_chunk": [pdf["_chunk"].iloc[0]],
                             "_next": [leaves(pdf).tolist()]})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        entries, at, expected = [], 0, 0
        for chunk, leads_to in zip(pdf["_chunk"], pdf["_next"]):
            at = at if chunk == expected else 0
            entries.append(at)
            at, expected = int(leads_to[at]), chunk + 1
        return pd.DataFrame({"video_id": pdf["video_id"], "_chunk": pdf["_chunk"], "_entry": entries})

    several = rows.filter(F.col("_chunk") > 0).select("video_id").distinct()
    tables = rows.join(several, "video_id", "left_semi").groupBy("video_id", "_chunk").applyInPandas(
        leave, f"video_id {key}, _chunk bigint, _next array<bigint>")
    found = tables.groupBy("video_id").applyInPandas(follow, f"video_id {key}, _chunk bigint, _entry bigint")
    return rows.join(found, ["video_id", "_chunk"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(0)))


def sparse_walk(candidates: DataFrame, distance: int, *, chunk: int | None = None) -> DataFrame:
    """Of ``candidates`` (video_id, idx, ...) the first and each next one at least ``distance`` after the last taken."""
    distance, names = max(1, distance), candidates.columns
    size = chunk_size(distance, chunk)
    rows = candidates.withColumn("_chunk", F.floor(F.col("idx") / F.lit(size)).cast("long"))

    def leaves(pdf: pd.DataFrame) -> np.ndarray:
        start = int(pdf["_chunk"].iloc[0]) * size
        own = np.sort(pdf["idx"].to_numpy()) - start
        after = np.searchsorted(own, own + distance)
        exits = np.empty(len(own) + 1, dtype=np.int64)
        exits[-1] = 0
        for i in range(len(own) - 1, -1, -1):
            exits[i] = exits[after[i]] if after[i] < len(own) else max(0, own[i] + distance - size)
        first = np.searchsorted(own, np.arange(distance + 1))
        return exits[first]

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        own = pdf["idx"].to_numpy() - int(pdf["_chunk"].iloc[0]) * size
        taken, i = [], int(np.searchsorted(own, int(pdf["_entry"].iloc[0])))
        while i < len(own):
            taken.append(i)
            i = int(np.searchsorted(own, own[i] + distance))
        return pdf.iloc[taken][names]

    return _with_entries(rows, leaves).groupBy("video_id", "_chunk").applyInPandas(replay, candidates.schema)


def run_walk(runs: DataFrame, reach: int) -> DataFrame:
    """Positions (video_id, idx) that a walk visits from position 0, step by step.

    ``runs`` has (video_id, _chunk, start, n, step): stretches of ``n``
    positions where the walk moves ``step`` (1 to ``reach``), without holes,
    none across a chunk. Visits inside a run follow from the first, so Python
    gives one row for each run and the positions are filled in afterwards.
    """
    def passed(at: np.ndarray, n: int, step: int) -> np.ndarray:
        """Offsets behind a run of those before it."""
        return np.where(at >= n, at - n, at - n + -(-(n - at) // step) * step)

    def leaves(pdf: pd.DataFrame) -> np.ndarray:
        at = np.arange(reach + 1)
        for n, step in pdf.sort_values("start")[["n", "step"]].itertuples(index=False):
            at = passed(at, n, step)
        return at

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        at, first = int(pdf["_entry"].iloc[0]), []
        for n, step in pdf[["n", "step"]].itertuples(index=False):
            first.append(at if at < n else -1)
            at = at - n if at >= n else at - n + -(-(n - at) // step) * step
        pdf = pdf.assign(first=pdf["start"] + first, last=pdf["start"] + pdf["n"] - 1)[np.array(first) >= 0]
        return pdf[["video_id", "first", "last", "step"]]

    key = runs.schema["video_id"].dataType.simpleString()
    visits = _with_entries(runs, leaves).groupBy("video_id", "_chunk").applyInPandas(
        replay, f"video_id {key}, first bigint, last bigint, step bigint")
    return visits.select("video_id", F.explode(F.sequence("first", "last", "step")).alias("idx"))
