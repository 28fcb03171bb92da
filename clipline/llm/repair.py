"""Conversation structure repair: alignment of turns to the alternating grammar, with bands and backtraced audits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an edit costs; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Rows aligned at once. Longer conversations go on from the grammar states that the rows before can end in.
ROWS = 32
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn. A conversation ends in
#: the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
_SPACES = " \t\n\x0b\x0c\r"


def target(start: int, end: int, length: int) -> str | None:
    """The only string of so many role initials that leads from one state to another, if there is one."""
    if length == 0:
        return "" if start == end else None
    if start == START and end == SYSTEM:
        return "s" if length == 1 else None
    if end < USER:
        return None
    first, head = ("a", "") if start == USER else ("u", "")
    if start == START and (length % 2 == 0) != (end == ASSISTANT):
        head, length = "s", length - 1
        if not length:
            return None
    other = "u" if first == "a" else "a"
    last = first if length % 2 else other
    if last != ("u" if end == USER else "a"):
        return None
    return head + (first + other) * (length // 2) + first * (length % 2)


def _gap(d: int) -> int:
    """The least cost of d more targets than rows, or of rows too many."""
    return INSERT * d if d > 0 else -DELETE * d


def align_to(rows: tuple, wanted: str, most: int) -> tuple[int, str] | None:
    """The least cost at which ``rows`` become ``wanted`` and the least such audit; None above ``most``.

    ``rows`` are (role initial, must be deleted, truncated). Only cells that a
    path of cost ``most`` can reach are filled: the difference between targets
    and rows that may stay bounds the cost on both sides of a cell.
    """
    n, size = len(rows), len(wanted)
    ahead = [0]
    for _, must, _ in rows:
        ahead.append(ahead[-1] + (not must))
    spare = most - DELETE * (n - ahead[-1])
    surplus = size - ahead[-1]
    if spare < _gap(surplus):
        return None
    reach = 1 + max(spare // min(INSERT, DELETE), 0)
    band = [d for d in range(-reach, reach + 1) if _gap(d) + _gap(surplus - d) <= spare]
    low, high = band[0], band[-1]
    far = most + 1
    costs: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here, below = costs[i], costs[i + 1] if i < n else {}
        for j in range(min(size, ahead[i] + high), max(0, ahead[i] + low) - 1, -1):
            best = 0 if i == n and j == size else far
            free = j < size and wanted[j] != "s"
            if free and (c := here.get(j + 1)) is not None:
                best = min(best, INSERT + c)
            if i < n:
                initial, must, truncated = rows[i]
                if (c := below.get(j)) is not None:
                    best = min(best, DELETE + c)
                if not must and j < size and (c := below.get(j + 1)) is not None:
                    if initial == wanted[j]:
                        best = min(best, truncated + c)
                    elif free:
                        best = min(best, REROLE + truncated + c)
            if best < far:
                here[j] = best
    if 0 not in costs[0]:
        return None
    i, j, audit = 0, 0, []
    while i < n or j < size:
        now = costs[i][j]
        initial, must, truncated = rows[i] if i < n else ("", True, 0)
        both = costs[i + 1].get(j + 1) if i < n and not must and j < size else None
        if i < n and costs[i + 1].get(j) == now - DELETE:
            audit.append("D")
            i += 1
        elif j < size and wanted[j] != "s" and costs[i].get(j + 1) == now - INSERT:
            audit.append("I")
            j += 1
        elif both is not None and initial == wanted[j] and both == now - truncated:
            audit.append("K")
            i, j = i + 1, j + 1
        else:
            audit.append("R")
            i, j = i + 1, j + 1
    return costs[0][0], "".join(audit)


@lru_cache(maxsize=20_000)
def align(rows: tuple, start: int, end: int) -> tuple[int, str] | None:
    """The least (cost, audit) over all targets from ``start`` to ``end``, the nearest lengths first.

    The first feasible length is solved under doubled bounds; from then on the
    cost found so far bounds the band of every other length, and lengths that
    must cost more are left out. Equal costs are settled by the audits.
    """
    stay = sum(not must for _, must, _ in rows)
    base, best = DELETE * (len(rows) - stay), None
    for length in sorted(range(2 * len(rows) + 4), key=lambda x: _gap(x - stay)):
        least = base + _gap(length - stay)
        if best is not None and least > best[0]:
            break
        wanted = target(start, end, length)
        if wanted is None:
            continue
        if best is None:
            bound, ceiling = least + 3, DELETE * len(rows) + INSERT * length
            best = align_to(rows, wanted, bound)
            while best is None and bound < ceiling:
                bound *= 2
                best = align_to(rows, wanted, bound)
        elif (found := align_to(rows, wanted, best[0])) is not None:
            best = min(best, found)
    return best


class Conversation:
    """One conversation read row by row; it holds ROWS rows, and costs, audits and hash states of up to four paths."""

    def __init__(self, rows_at_once: int = ROWS):
        self.rows_at_once = rows_at_once
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self.before = None
        self.waiting: list[tuple[tuple, str, str]] = []
        self.settled: list[str] = []
        self.paths = {START: (0, "", hashlib.sha256())}

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            self.distinct += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        initial, said = role[:1], text.strip(_SPACES)
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        must = truncated = False
        if not said:
            self.blank, must = self.blank + 1, True
        elif seen:
            self.duplicate, must = self.duplicate + 1, True
        elif said[-1] not in ".!?":
            self.truncated, truncated = self.truncated + 1, True
        self.waiting.append(((initial if initial in "sua" else "?", must, int(truncated)), role, text))
        if len(self.waiting) >= self.rows_at_once:
            self.advance(range(4))

    def advance(self, ends) -> None:
        """Every path over the waiting rows to every state of ``ends``; what all paths share is settled."""
        rows, paths = tuple(w[0] for w in self.waiting), {}
        for end in ends:
            met = [(cost + found[0], audit + found[1], start, found[1]) for start, (cost, audit, _) in self.paths.items()
                   if (found := align(rows, start, end)) is not None]
            if met:
                cost, audit, start, tail = min(met)
                digest = self.paths[start][2].copy()
                self.write(digest, start, end, tail)
                paths[end] = cost, audit, digest
        shared = commonprefix([p[1] for p in paths.values()])
        self.settled.append(shared)
        self.paths = {k: (c, a[len(shared):], d) for k, (c, a, d) in paths.items()}
        self.waiting = []

    def write(self, digest, start: int, end: int, audit: str) -> None:
        """Adds the repaired rows of ``audit`` to a hash."""
        wanted = iter(target(start, end, sum(e != "D" for e in audit)))
        rows, first = iter(self.waiting), start == START
        for edit in audit:
            _, role, text = next(rows) if edit != "I" else (None, "", "")
            if edit != "D":
                place = next(wanted)
                line = f"{role if edit == 'K' else ROLES[place]}:{text}"
                digest.update((line if first else "\n" + line).encode("utf-8"))
                first = False

    def result(self) -> tuple:
        self.advance((START, ASSISTANT))
        cost, audit, digest = min(self.paths.values(), key=lambda p: p[:2])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled) + audit,
                digest.hexdigest())


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, dropped: damaged by crc32 of ``conv_id:turn`` mod 20; dropped rows stay, marked.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it and
    4 makes it a user's. Nulls count as one space in the hash, in roles and in
    texts.
    """
    blank = F.lit(" ")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    damaged = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return damaged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def repair_conversations(rows: DataFrame, rows_at_once: int = ROWS) -> DataFrame:
    """One row for each conv_id: faults, and the cheapest edits that make its roles ``(s?(ua)+)?``.

    ``rows`` has conv_id, turn, role, text and, optionally, dropped (rows that
    are no longer there). Rows go by turn, nulls first, then by role and text.
    A text without a visible character is blank, one whose role and text came
    earlier a duplicate, one that does not end in ``.!?`` truncated; the first
    that holds counts. Columns: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256. Among edits of equal cost the audit
    that sorts first wins. Conversations without rows give zeros, an empty
    audit and the hash of nothing. Null roles and texts count as one space; a
    null conv_id is a conversation; an empty table gives no rows.

    Rows are shuffled once, by conversation, sorted, and read as a stream. The
    hash of a whole repaired conversation needs its rows one after the other,
    so a conversation is one task's work, but never held: ROWS rows at a time
    are aligned from each grammar state to each. That is exact, since rows
    before a border matter to those behind it only through the state there.
    """
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    blank = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"),
                       F.coalesce("text", blank).alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"))
    earlier = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    sorted_rows = (rows.repartition("conv_id").withColumn("seen", F.row_number().over(earlier) > 1)
                   .sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", "seen"))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    id_type = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, ids, found = None, None, [], []

        def made() -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 8
            arrays = [pa.array(list(c), pa.int64()) for c in columns[:6]] + [
                pa.array(list(c), pa.string()) for c in columns[6:]]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_arrow), *arrays], ["conv_id", *names, "audit", "repaired_sha256"])

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for conv, turn, role, text, dropped, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or conv != now:
                    if own is not None:
                        ids.append(now)
                        found.append(own.result())
                    now, own = conv, Conversation(rows_at_once)
                if not dropped:
                    own.add(turn, role, text, seen)
            if len(ids) >= 1000:
                yield made()
                ids, found = [], []
        if own is not None:
            ids.append(now)
            found.append(own.result())
            yield made()

    schema = f"conv_id {id_type}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"
    return sorted_rows.mapInArrow(run, schema)
