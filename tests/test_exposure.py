"""Exposure in the order of time, against all pairs of stays."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from looptrace.plans.exposure import exposed_items, stays

START, END = datetime(2025, 1, 1), "2025-03-01 00:00:00"


def when(hour):
    return str(START + timedelta(hours=hour))


def brute(moves, incidents, severity=4):
    visits = []
    for item in {m[1] for m in moves}:
        own = sorted((m[4], m[0], m[3]) for m in moves if m[1] == item)
        for (came, _, place), after in zip(own, [*own[1:], (END, 0, None)]):
            if place is not None:
                visits.append((item, place, came, after[0]))
    found = {}
    for i in incidents:
        if i[3] >= severity:
            found[i[1]] = min(found.get(i[1], "9"), i[5])
    own = dict(found)
    while True:
        new = dict(found)
        for item, place, came, left in visits:
            if item in found and left >= found[item]:
                for other, where, a, b in visits:
                    t = max(found[item], came, a)
                    if where == place and t <= min(left, b):
                        new[other] = min(new.get(other, "9"), t)
        if new == found:
            return sorted((i, t, own.get(i, "9") <= t) for i, t in found.items())
        found = new


def asked(table, moves, incidents, slices=None):
    out = exposed_items(table("movements", *moves), table("contamination_incidents", *incidents), END,
                        slices=slices)
    assert out.columns == ["instance_id", "exposed_at", "incident"]
    return sorted((r.instance_id, str(r.exposed_at), r.incident) for r in out.collect())


@pytest.mark.parametrize("seed, slices", [(1, 1), (1, 30), (2, None)])
def test_exposure_equals_all_pairs_of_stays(table, seed, slices):
    draw = random.Random(seed)
    # a third of all moves go to one hub; few incidents, late ones too
    moves = [(n, draw.randrange(30), None, draw.choice([0, 0, 0, None, *range(1, 9)]), when(draw.randrange(300)), None)
             for n in range(170)]
    incidents = [(n, draw.randrange(30), "chemical", draw.choice([1, 4, 5]), None, when(draw.randrange(60, 290)))
                 for n in range(5)]
    assert asked(table, moves, incidents, slices) == brute(moves, incidents)


def test_a_chain_of_places_in_time(table):
    moves = [
        (1, 1, None, 10, when(0), None),  # the contaminated item, at 10 up to hour 20
        (2, 1, None, 11, when(20), None),
        (3, 2, None, 10, when(5), None),  # leaves before the incident
        (4, 2, None, 12, when(8), None),
        (5, 3, None, 10, when(9), None),  # there when it happens, later at 13
        (6, 3, None, 13, when(30), None),
        (7, 4, None, 13, when(29), None),  # exposed at 13 by item 3
        (8, 4, None, 14, when(40), None),
        (9, 5, None, 13, when(10), None),  # left 13 before item 3 came
        (10, 5, None, 15, when(25), None),
        (11, 6, None, 14, when(100), None),  # comes while item 4 is still there
        (12, 7, None, 10, when(20), None),  # comes as item 1 leaves
    ]
    incidents = [(1, 1, "chemical", 5, None, when(10)), (2, 5, "chemical", 3, None, when(1))]
    assert asked(table, moves, incidents) == [
        (1, when(10), True), (3, when(10), False), (4, when(30), False), (6, when(100), False),
        (7, when(20), False)]


def test_incidents_without_stays_and_nothing_at_all(table):
    assert asked(table, [], [(1, 8, "chemical", 4, None, when(1)), (2, 8, "chemical", 4, None, when(3))]) == [
        (8, when(1), True)]
    assert asked(table, [(1, 1, None, 2, when(1), None)], []) == []
    assert asked(table, [(1, 1, None, 2, when(9000), None)], [(1, 1, "chemical", 4, None, when(9000))]) == []
    assert stays(table("movements"), END).collect() == []


def test_equal_moments_and_repeated_moves(table):
    moves = [(1, 1, None, 5, when(1), None), (2, 1, None, 6, when(1), None), (3, 2, None, 5, when(1), None),
             (3, 2, None, 5, when(1), None), (4, 3, None, 6, when(1), None)]
    incidents = [(1, 1, "chemical", 4, None, when(0))]
    assert asked(table, moves, incidents) == brute(moves, incidents)
