"""Conversation repair against plain dynamic programming over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lacuna.llm import conversation_repair as cr
from lacuna.llm import turn_lattice as tl

SOLID = re.compile("[^\x20\x09-\x0d]")


def plain_damage(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        show = lambda x: " " if x is None else str(x)
        role, text, how = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        own += [(turn, role, text)] * (1 + (how == 3))
    for conv in by:
        by[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return by


def plain_faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(turns, faults):
    """Bellman-Ford over prefixes of turns by last initial: role strings are grown and tested against the grammar."""
    legal = lambda s: re.fullmatch("(s|s?(ua)*u?)?", s)  # noqa: E731  beginnings of legal strings
    best = {"": (0, "", ())}

    def grow(table):
        while True:
            new = dict(table)
            for state, (cost, audit, lines) in table.items():
                for role in ("user", "assistant"):
                    grown = after(state, role[0])
                    if grown is not None and (key := (cost + 5, audit + "I", (*lines, f"{role}:"))) < new.get(grown, (1 << 60,)):
                        new[grown] = key
            if new == table:
                return table
            table = new

    def after(state, initial):
        head = {"": "", "s": "s", "u": "u", "a": "ua"}[state]
        return initial if legal(head + initial) and len(initial) == 1 else None

    best = grow(best)
    for (_, role, text), fault in zip(turns, faults):
        new = {}

        def offer(state, way):
            if state is not None and way < new.get(state, (1 << 60,)):
                new[state] = way

        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                offer(after(state, role[:1]), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for own in ("user", "assistant"):
                    offer(after(state, own[0]), (cost + 1 + more, audit + "R", (*lines, f"{own}:{text}")))
        best = grow(new)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    out = {}
    for conv, turns in plain_damage(rows).items():
        faults = plain_faults(turns)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len({*numbers}) if numbers else 0
        pairs = [(a[1][:1], b[1][:1]) for a, b in zip(turns, turns[1:])]
        cost, audit, lines = plain_repair(turns, faults)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum("".join(p) not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.withColumns({"copies": F.lit("x"), "fault": F.lit(1), "done": F.lit(0), "how": F.lit(7), "c": F.lit(0)})


def some(n=60, seed=4):
    rng, rows = random.Random(seed), []
    say = lambda: rng.choice(["yes.", "no!", "well", "", " \t", "so it is? ", "cut off", "\u2028", "so.\u2028", "\x85", "é.", f"w{rng.random()}."])
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 12])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("system", "user", "assistant")[0 if turn == 0 and conv % 3 == 0 else 1 + (turn + (conv % 3 == 0)) % 2]
            rows.append((conv, turn if rng.random() < 0.95 else turn + 2, role, say()))
    rows += [(500, None, None, None), (500, None, "user", "a."), (500, 3, "", "b."), (501, None, "tool", None), (None, 1, "user", "hi."), (None, 2, "assistant", "ho.")]
    return rows + rows[:9]


def compare(got, rows):
    want = expected(rows)
    have = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got.collect()}
    assert have == want


@pytest.mark.parametrize("piece", [cr.PIECE, 3, 1])
def test_against_plain_python(spark, piece):
    rows = some()
    compare(cr.repair(conversations(spark, rows), piece=piece), rows)


def test_one_conversation_has_most_rows(spark):
    """1,500 of its turns are one row, some are long texts, and it lies over all ranges."""
    rng = random.Random(8)
    hot = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"c {t}."])) for t in range(3000)]
    rows = [*hot, *([(7, 40, "user", "again.")] * 1500), (7, 41, "user", "long " * 300_000), *some(20, 5)]
    compare(cr.repair(conversations(spark, rows)), rows)


def test_empty_table_and_all_dropped(spark):
    assert cr.repair(conversations(spark, [])).count() == 0
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    row = cr.repair(conversations(spark, [(9, turn, "user", "x")])).first()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_over_its_table(spark):
    from lacuna.llm.queries import op12_conversation_repair

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(op12_conversation_repair(spark, sf), rows)


def test_search_stops_at_the_first_accepting_end():
    turns = [("u", tl.SOUND), ("u", tl.SOUND), ("a", tl.CUT), ("s", tl.BLANK)]
    (state, best), = tl.search(turns).items()
    ways = tl.follow({tl.START: (0, "")}, tl.through(turns[:2]))
    assert best == tl.cheapest(tl.follow(ways, tl.through(turns[2:]))) and state in tl.ACCEPTING
