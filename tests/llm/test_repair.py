"""Repair of conversations against a search through all sequences of edits."""

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from causalbars.llm import repair

ROLES = ["system", "user", "assistant", "tool", " ", "", "u", "a"]
TEXTS = ["Yes.", "No!", "cut", "  ", "", "why?", "é ", "line\n", "a.\x0b"]
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        if not signs:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("sound" if signs[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and lines of the cheapest repair, by a search that orders states by cost, then audit."""
    faults = fault_of(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, said, lines = heapq.heappop(heap)
        if i == len(rows) and said in ("", "a"):
            return cost, audit, lines
        if (i, said) in done:
            continue
        done.add((i, said))
        role_next = {"u": "user", "a": "assistant"}[NEXT[said]]
        heapq.heappush(heap, (cost + 5, audit + "I", i, NEXT[said], (*lines, f"{role_next}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, said, lines))
            if faults[i] in ("sound", "truncated"):
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, NEXT[said], (*lines, f"{role_next}:{text}")))
                if role[:1] == NEXT[said] or (said == "" and role[:1] == "s"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
    raise AssertionError


def brute(rows):
    talks = {}
    for key, turn, role, text in rows:
        talks.setdefault(key, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for key, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, turns = fault_of(talk), [t for t, *_ in talk if t is not None]
        cost, audit, lines = cheapest(talk)
        initials = [r[:1] for _, r, _ in talk]
        out[key] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(6)
    out = []
    for key in range(120):
        for turn in range(draw.choice([1, 2, 3, 6, 12])):
            role = draw.choice(ROLES[:3]) if draw.random() < 0.7 else draw.choice(ROLES)
            out.append((key, draw.choice([turn, turn, turn, None, 2 * turn, -turn]), role, draw.choice(TEXTS)))
    out += [(200, 1, None, None), (200, 2, None, "x."), (201, None, "user", "a."), (None, 1, "user", "a."), (None, 2, "assistant", "b.")]
    out += [(202, i, draw.choice(ROLES[:4]), f"{i}{draw.choice(['.', '', '!'])}") for i in range(150)]
    return out + out[-3:]


def got(table, **options):
    repaired = repair.repair_conversations(table, **options)
    both = repaired.conversations.join(repair.digests(repaired.edits), "_c")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in both.collect()}


@pytest.mark.parametrize("rows_per_block", [65_536, 3, 1])
def test_repairs_equal_brute_force(spark, rows, rows_per_block):
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    table = table.withColumn("_c", F.lit(0)).withColumn("edit", F.lit("x"))
    assert got(table, rows_per_block=rows_per_block) == brute(rows)


def test_repaired_turns_have_the_form(spark, rows):
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    repaired = repair.repair_conversations(table)
    assert repaired.edits.columns == ["_c", "at", "step", "edit", "role", "text", "cost"]
    talks = {}
    for r in sorted(repaired.edits.collect(), key=lambda r: (r._c, r.at, r.step)):
        talks.setdefault(r._c, []).append(r)
        assert (r.text is None) == (r.edit == "D")
    for edits in talks.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(e.role[0] for e in edits if e.edit != "D"))
    assert sum(e.cost for edits in talks.values() for e in edits) == repaired.conversations.agg(F.sum("cost")).first()[0]


def test_walk_keeps_few_vectors():
    every, held = repair._checkpoints(bytes([3]) * 10_000, repair.END)
    assert every == 101 and len(held) == 100


def test_far_turn_numbers(spark):
    far = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, -(2**62), "user", "a."), (2, 5, "assistant", "b.")]
    table = spark.createDataFrame(far, "conv_id bigint, turn bigint, role string, text string")
    assert {k: v[0] for k, v in got(table).items()} == {1: None, 2: 5 + 2**62 - 1}


def test_no_rows(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert got(table) == {}
