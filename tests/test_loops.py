"""Loops of items and nested matching, cut into slices or not, against walks over each item's events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from looptrace.operators.slices import scanned, sliced
from looptrace.plans import trace

START = datetime(2025, 1, 1)


def when(hour):
    return str(START + timedelta(hours=hour))


def drawn_log(seed, items=12, hot=160):
    """(checkouts, returns, inspections, washes, births) in which one item has most events."""
    draw = random.Random(seed)
    births = [(i, 1, f"u{i}", "available", when(draw.choice([0, 0, 30])), None) for i in range(items) if i % 5]
    loans, backs, seen, washes = [], [], [], []
    for i in range(items):
        hour = 0
        for _ in range(hot if i == 1 else draw.randrange(0, 14)):
            hour += draw.choice([0, 1, 2, 9])
            kind = draw.choice("cccrrrwiII")
            if kind == "c":
                loans.append((len(loans), i, 1, 1, when(hour), 7))
            elif kind == "r":
                backs.append((len(backs), i, None, 1, when(hour), None))
            elif kind == "w":
                washes.append((len(washes), 1, "b", when(hour), None, None, None))
                seen.append((len(seen), i, len(washes) - 1, None, draw.choice(["pass", "fail"]), None, when(hour + 1)))
            else:
                seen.append((len(seen), i, None, None, draw.choice(["pass", "fail"]), None, when(hour)))
    linked = [b[:5] + (draw.choice(loans)[0] if draw.random() < 0.2 else None,) for b in backs]
    return loans, linked, seen, washes, births


AFTER = {"wash": "washed", "pass": "ready", "fail": "back"}
IN_TURN = {("unborn", "birth"), ("ready", "checkout"), ("out", "return"), ("back", "wash"),
           ("washed", "pass"), ("washed", "fail")}


def walk_loops(loans, backs, seen, washes, births):
    events = [(b[0], b[4], 0, b[0], "birth") for b in births]
    events += [(c[1], c[4], 1, c[0], "checkout") for c in loans]
    events += [(r[1], r[4], 2, r[0], "return") for r in backs]
    events += [(i[1], washes[i[2]][3], 3, i[2], "wash") for i in seen if i[2] is not None]
    events += [(i[1], i[6], 4, i[0], i[4]) for i in seen]
    loops = {}

    def loop(item, number):
        return loops.setdefault((item, number), {"at": None, "n": 0, "reached": False, "breaks": []})

    now = {}
    for item, ts, _, _, event in sorted(events):
        state, number = now.get(item, ("unborn", 0))
        fine = (state, event) in IN_TURN
        name = "inspection" if event in ("pass", "fail") else event
        if not fine:
            loop(item, number)["breaks"].append((ts, f"{name} while {state}"))
        number += event == "checkout"
        own = loop(item, number)
        own["at"] = own["at"] or ts
        own["n"] += 1
        own["reached"] |= fine and event in ("birth", "pass")
        if event in ("checkout", "return"):
            state = {"checkout": "out", "return": "back"}[event]
        elif state != "out":
            state = AFTER.get(event, "ready" if state == "unborn" else state)
        now[item] = state, number
    return sorted(
        (item, number, x["at"], x["n"], x["reached"] and not x["breaks"], len(x["breaks"]),
         *(x["breaks"][0] if x["breaks"] else (None, None)))
        for (item, number), x in loops.items()
    )


def walk_matches(loans, backs):
    taken = {b[5] for b in backs}
    events = [(c[1], c[4], 0, c[0]) for c in loans if c[0] not in taken]
    events += [(r[1], r[4], 1, r[0]) for r in backs if r[5] is None]
    held, out = {}, [(r[0], r[1], r[5]) for r in backs if r[5] is not None]
    for item, _, step, number in sorted(events):
        stack = held.setdefault(item, [])
        if step == 0:
            stack.append(number)
        else:
            out.append((number, item, stack.pop() if stack else None))
    return sorted(out)


@pytest.mark.parametrize("seed, slices", [(1, 1), (1, 25), (2, 60), (3, None)])
def test_loops_equal_a_walk(spark, table, seed, slices):
    log = drawn_log(seed)
    loans, backs, seen, washes, births = log
    got = trace.loop_conformance(
        table("packaging_instances", *births), table("checkouts", *loans), table("returns", *backs),
        table("inspections", *seen), table("wash_cycles", *washes), slices)
    assert got.columns == ["instance_id", "loop_no", "started_at", "events", "complete", "breaks",
                           "break_at", "rule"]
    rows = [tuple(str(v) if isinstance(v, datetime) else v for v in r) for r in got.collect()]
    assert sorted(rows, key=lambda r: r[:2]) == walk_loops(*log)


def test_a_whole_loop_and_each_kind_of_break(table):
    births = [(i, 1, f"u{i}", "available", when(0), None) for i in (1, 2, 3)]
    loans = [(1, 1, 1, 1, when(1), 7), (2, 1, 1, 1, when(9), 7), (3, 2, 1, 1, when(1), 7),
             (4, 2, 1, 1, when(5), 7), (5, 4, 1, 1, when(1), 7)]
    backs = [(1, 1, None, 1, when(2), None), (2, 3, None, 1, when(2), None)]
    washes = [(1, 1, "b", when(3), None, None, None), (2, 1, "b", when(5), None, None, None),
              (3, 1, "b", when(2), None, None, None)]
    seen = [(1, 1, 1, None, "fail", None, when(4)), (2, 1, 2, None, "pass", None, when(6)),
            (3, 2, 3, None, "pass", None, when(3))]
    got = {
        (r.instance_id, r.loop_no): (r.complete, r.rule)
        for r in trace.loop_conformance(
            table("packaging_instances", *births), table("checkouts", *loans),
            table("returns", *backs), table("inspections", *seen),
            table("wash_cycles", *washes)).collect()
    }
    assert got == {
        (1, 0): (True, None),
        (1, 1): (True, None),  # washed twice, as the first inspection failed
        (1, 2): (False, None),  # still out
        (2, 0): (True, None),
        (2, 1): (False, "wash while out"),  # and not returned before the next checkout
        (2, 2): (False, None),
        (3, 0): (False, "return while ready"),
        (4, 0): (False, "checkout while unborn"),
        (4, 1): (False, None),
    }


@pytest.mark.parametrize("seed, slices", [(4, 1), (4, 30), (5, 70), (6, None)])
def test_nested_matching_equals_stacks(table, seed, slices):
    loans, backs, *_ = drawn_log(seed)
    got = trace.match_returns_nested(table("checkouts", *loans), table("returns", *backs), slices)
    assert got.columns == ["return_id", "instance_id", "matched_checkout_id"]
    assert sorted(tuple(r) for r in got.collect()) == walk_matches(loans, backs)


def test_two_open_checkouts_and_two_anonymous_returns(table):
    loans = [(1, 7, 1, 1, when(1), 7), (2, 7, 1, 1, when(2), 7)]
    backs = [(i, 7, None, 1, when(2 + i), None) for i in (1, 2, 3)]
    matched = trace.match_returns_nested(table("checkouts", *loans), table("returns", *backs))
    assert {r.return_id: r.matched_checkout_id for r in matched.collect()} == {1: 2, 2: 1, 3: None}
    back = trace.with_matches(table("returns", *backs), matched)
    assert {r.return_id: r.checkout_id for r in back.collect()} == {1: 2, 2: 1, 3: None}


def test_hot_item_with_deep_loans_in_many_slices(table):
    n = 400
    loans = [(i, 7, 1, 1, when(i), 7) for i in range(n)]
    backs = [(i, 7, None, 1, when(n + i), None) for i in range(n + 5)]
    matched = trace.match_returns_nested(table("checkouts", *loans), table("returns", *backs), 40)
    got = {r.return_id: r.matched_checkout_id for r in matched.collect()}
    assert got == {i: n - 1 - i if i < n else None for i in range(n + 5)}


def test_no_events(table):
    empty = [table(t) for t in ("packaging_instances", "checkouts", "returns", "inspections", "wash_cycles")]
    assert trace.loop_conformance(*empty).collect() == []
    assert trace.match_returns_nested(empty[1], empty[2]).collect() == []


@pytest.mark.parametrize("slices", [1, 30])
def test_scans_equal_plain_loops(spark, slices):
    draw = random.Random(9)
    rows = [(draw.choice([None, 1, 1, 1, 2, 3]), i, draw.choice([None, -2, 1, 3])) for i in range(300)]
    log = spark.createDataFrame(rows, "k int, id int, v int")
    got = scanned(sliced(log, "k", ["id"], slices), "k", ["id"], total=("sum", F.col("v")),
                  least=("min", F.col("v")), newest=("last", F.col("v"))).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for k, i, v in rows if k == r.k and i < r.id and v is not None]
        assert (r.total, r.least, r.newest) == (
            sum(before), min(before, default=None), before[-1] if before else None)
