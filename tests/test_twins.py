"""Rows of chains that only flights with twins can have twice."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from skylattice.operators import itineraries, network
from tests.test_assembly import AIRPORTS, FLIGHTS, fly


def test_chains_that_look_alike_have_a_twin(spark):
    pick, rows = random.Random(3), []
    for _ in range(160):
        a, b = pick.sample(["AAA", "BBB", "BBX", "CCC", "DDD"], 2)
        dep = pick.randrange(60)
        rows.append(fly(pick.choice("KL"), str(pick.randrange(2)), a, b, dep, dep + pick.randrange(1, 4)))
    rows += [fly("K", "1", "AAA", "BBB", 5, 7), fly("K", "1", "AAA", "BBB", 5, 7)]
    # BBB and BBX are one city
    land = spark.createDataFrame([(c, "X", c[:2], None, float(i % 3), float(i)) for i, c in enumerate(("AAA", "BBB", "BBX", "CCC", "DDD"))], AIRPORTS)
    f = itineraries.twins(spark.createDataFrame(rows, FLIGHTS), land)
    assert 0 < f.filter("twin").count() < len(rows)
    path = itineraries.paths(network.edges(f, land), network.siblings(land), 3)
    x = itineraries.along(path, f, land, 3, fields=[*itineraries.MEASURED, "twin"])
    own = [F.get("flights", i) for i in range(3)]
    seen = x.groupBy(F.concat_ws("|", *[F.concat_ws(":", o["company"], o["number"]) for o in own]).alias("d"), own[0]["dep"].alias("dep"), own[2]["arr"].alias("arr"), "circuity", "transfer_time", "travel", "flown", "airports")
    told = seen.agg(F.count("*").alias("n"), F.min(own[0]["twin"] | own[1]["twin"] | own[2]["twin"]).alias("twin")).groupBy(F.expr("n > 1").alias("alike"), "twin").count().collect()
    found = {(r.alike, r.twin): r["count"] for r in told}
    assert found[True, True] and found[False, False] and (True, False) not in found


def test_rows_without_twins_meet_over_no_shuffle(spark):
    plan = entry.queries()["itin_2stop"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
