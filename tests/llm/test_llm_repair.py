"""Conversation repair against a plain search over grammar states and against all edit sequences."""

import hashlib
import random
import zlib
from itertools import product

import pytest
from clipline.llm import repair
from pyspark.sql import functions as F

ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        said = text.strip(SPACE)
        kind = ("blank" if not said else "duplicate" if (role, text) in seen else
                "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
        out.append(kind)
    return out


def plain_repair(rows):
    """The least (cost, audit, repaired) by relaxing states of a graph: rows used, last role, so the grammar is local."""
    kinds = faults(rows)
    best = {(0, ""): (0, "", ())}
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts lead on within one i
            for last in ("", "s", "u", "a"):
                if (i, last) in best:
                    cost, audit, done = best[i, last]
                    for role in set(follows[last]) & set("ua"):
                        new = (cost + 2, audit + "I", (*done, (ROLES[role], "")))
                        if (i, role) not in best or new[:2] < best[i, role][:2]:
                            best[i, role] = new
        if i == len(rows):
            break
        role, text = rows[i]
        for last in ("", "s", "u", "a"):
            if (i, last) not in best:
                continue
            cost, audit, done = best[i, last]
            ways = [(3, "D", last, ())]
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                if role[:1] and role[:1] in follows[last]:
                    ways.append((more, "K", role[:1], ((role, text),)))
                ways += [(2 + more, "R", r, ((ROLES[r], text),)) for r in set(follows[last]) & set("ua")]
            for c, edit, state, line in ways:
                new = (cost + c, audit + edit, done + line)
                if (i + 1, state) not in best or new[:2] < best[i + 1, state][:2]:
                    best[i + 1, state] = new
    return min((best[len(rows), s] for s in ("", "a") if (len(rows), s) in best), key=lambda b: b[:2])


def plain_result(rows):
    """The whole digest of one conversation: rows (turn, role, text) after damage, in order."""
    kinds = faults([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, done = plain_repair([r[1:] for r in rows])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    lines = "\n".join(f"{r}:{t}" for r, t in done)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
            kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def plain_damage(rows):
    """conv_id -> rows in order, from (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        kept.extend([row] * {0: 0, 3: 2}.get(kind, 1))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def rows_of(found):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[n] for n in names) for r in found.collect()}


def random_rows(rng, n):
    roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "tool", "assistant", "", "s"]])
    texts = ["Hello there.", "So what?", "cut off", " ", "", "Fine!", "x", "y.", "z."]
    if rng.random() < 0.5:
        return [(("user", "assistant")[i % 2] if rng.random() < 0.8 else rng.choice(roles), rng.choice(texts) + str(i) * (rng.random() < .7))
                for i in range(n)]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def all_edits(rows):
    """Every edit sequence with at most two inserts at a place; only for a few rows."""
    kinds, best = faults(rows), None
    options = []
    for (role, _), kind in zip(rows, kinds):
        must = kind in ("blank", "duplicate")
        options.append([("D", "", 3)] + ([] if must else [("K", role[:1], kind == "truncated")] + [
            ("R", r, 2 + (kind == "truncated")) for r in "ua"]))
    inserts = ["", "u", "a", "ua", "au", "uaua"]
    for gaps in product(inserts, repeat=len(rows) + 1):
        for edits in product(*options):
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * len(gaps[0])
            for (edit, role, price), gap in zip(edits, gaps[1:]):
                roles, audit, cost = roles + role + gap, audit + edit + "I" * len(gap), cost + price + 2 * len(gap)
            rest = roles[1:] if roles[:1] == "s" else roles
            if (not roles or rest) and rest == "ua" * (len(rest) // 2) and all(
                    edit != "K" or role for edit, role, _ in edits):
                best = min(best or (cost + 1, ""), (cost, audit))
    return best


def repaired(rows, size):
    one, seen = repair.Conversation(size), set()
    for i, (role, text) in enumerate(rows):
        one.add(i, role, text, (role, text) in seen)
        seen.add((role, text))
    return one.result()


def test_plain_search_is_right():
    rng = random.Random(5)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(0, 3))
        assert plain_repair(rows)[:2] == all_edits(rows)


@pytest.mark.parametrize("size", [1, 2, 5, 32])
def test_alignment_equals_the_plain_search_at_every_block_size(size):
    rng = random.Random(size)
    for _ in range(300):
        rows = random_rows(rng, rng.choice([0, 1, 2, 3, 5, 8, 12, 20]))
        assert repaired(rows, size) == plain_result([(i, *r) for i, r in enumerate(rows)]), rows


def test_targets_are_the_strings_of_the_grammar():
    assert [repair.target(repair.START, repair.ASSISTANT, n) for n in range(6)] == [
        None, None, "ua", "sua", "uaua", "suaua"]
    assert repair.target(repair.START, repair.START, 0) == "" and repair.target(repair.START, repair.SYSTEM, 1) == "s"
    assert repair.target(repair.USER, repair.ASSISTANT, 3) == "aua"
    assert repair.target(repair.SYSTEM, repair.USER, 3) == "uau" and repair.target(repair.USER, repair.SYSTEM, 1) is None


def test_a_long_conversation_is_linear():
    rng = random.Random(9)
    rows = random_rows(rng, 3000)
    assert repaired(rows, 32)[:7] == plain_result([(i, *r) for i, r in enumerate(rows)])[:7]


def made():
    rng, rows = random.Random(3), []
    for conv in range(80):
        n = rng.choice([1, 2, 4, 6, 9, 60])
        rows += [(conv, i, *r) for i, r in enumerate(random_rows(rng, n))]
    rows += [(None, i % 7, "user", "same.") for i in range(20)] + [(None, None, None, None)] * 3
    rows += [(500, None, "user", "Late."), (500, 4, "assistant", "Yes."), (500, 4, "assistant", "Yes."), (500, 9, "user", None)]
    dropped = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.")], dropped


def test_query_equals_the_plain_version(spark):
    rows, dropped = made()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seen", F.lit(1))
    wanted = {c: plain_result(r) for c, r in plain_damage(rows).items()}
    for size in (3, 32):
        assert rows_of(repair.repair_conversations(repair.damage(table), size)) == wanted
    assert wanted[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_conversations(repair.damage(table.filter("false"))).count() == 0


def test_registered_query_over_the_whole_table(spark):
    from clipline.llm import queries
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_repair(spark, folder)) == {c: plain_result(r) for c, r in plain_damage(rows).items()}
