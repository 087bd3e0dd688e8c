"""Chains of through flights by both ways through a run, against brute force over all chains."""

import random
from datetime import datetime, timedelta

from skylattice.operators import assembly


def least(f, own):
    """The least chain of two or more flights that ``f`` stands for, itself if none."""
    dep, arr, origin, dest = f
    found, open_ = [], [[q] for q in own if q[0] == dep and q[2] == origin and q[1] <= arr and (q[2], q[3]) != (origin, dest)]
    while open_:
        c = open_.pop()
        if (c[-1][1], c[-1][3]) == (arr, dest):
            found.append(c)
            continue
        open_ += [[*c, q] for q in own if q[2] == c[-1][3] and q[0] >= c[-1][1] and q[1] <= arr and (q[2], q[3]) != (origin, dest)]
    return min(found, default=[f])


def test_least_chains_equal_brute_force(spark, monkeypatch):
    pick, rows = random.Random(7), set()
    for number in range(10):
        for _ in range(60):
            dep = pick.randrange(8)
            a, b = pick.sample("ABC", 2)
            rows.add((str(number), dep, dep + pick.randrange(1, 6), a, b))
    at = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    df = spark.createDataFrame([("O", n, at(x), at(y), a, b) for n, x, y, a, b in rows], "company string, number string, dep timestamp_ntz, arr timestamp_ntz, origin string, dest string")
    own = {}
    for n, x, y, a, b in rows:
        own.setdefault(n, []).append((at(x), at(y), a, b))
    want = {(n, f): least(f, fs) for n, fs in own.items() for f in fs}
    assert sum(len(c) > 1 for c in want.values()) > 20
    for short in (assembly.SHORT_RUN, 0):
        monkeypatch.setattr(assembly, "SHORT_RUN", short)
        told = assembly.same_flight_expand(df)
        assert {(r.number, tuple(r.flight)): [tuple(q) for q in r.legs] for r in told.collect()} == want
        # the least is known by its place: chains are not compared
        assert "array_min(" not in told._jdf.queryExecution().optimizedPlan().toString()
