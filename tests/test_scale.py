"""Work per row that does not grow with dimensions, and rows that are not dealt by few keys."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from skylattice.operators import assembly, maintenance, mct, network, rule_index
from skylattice.sources import derived

NOON = datetime(2026, 3, 1, 12)
FLIGHTS = "company string, number string, origin string, dest string, dep timestamp_ntz, arr timestamp_ntz, block int, op_company string, op_number string, duplicates array<string>, departure_terminal string, arrival_terminal string"
AIRPORTS = "code string, country string, city string, state string, latitude double, longitude double"


def _land(spark):
    return spark.createDataFrame([(c, c, c, None, float(i), float(i)) for i, c in enumerate(("AAX", "BBX", "CCX", "DDX"))], AIRPORTS)


def _met(spark, only=None):
    fly = lambda company, number, a, b, dep: (company, number, a, b, dep, dep + timedelta(hours=1), 60, company, number, [], None, None)
    first = spark.createDataFrame([fly(f"C{i}", "1", "AAX", "BBX", NOON) for i in range(3)], FLIGHTS)
    second = spark.createDataFrame([fly("C9", "2", "BBX", d, NOON + timedelta(hours=5)) for d in ("CCX", "DDX")], FLIGHTS)
    return first, second, network.siblings(_land(spark))


def test_a_lookup_ends_with_the_first_rule_that_fits(spark, monkeypatch):
    # 20,000 rules of nobody, any of which fits: 313 words of bits
    rules = mct.complete(spark.range(20_000).select(F.col("id").alias("rule_pos"), F.lit("II").alias("status"), F.format_string("%02d%02d", (1 + F.col("id") % 3).cast("int"), F.lit(0)).alias("time")))
    looked, before = [], rule_index.RuleIndex._first
    monkeypatch.setattr(rule_index.RuleIndex, "_first", lambda self, rows, first, some, *more: (looked.append(int(np.sum(some))), before(self, rows, first, some, *more))[1])
    first, second, pairs = _met(spark)
    batches = []
    monkeypatch.setattr(type(first), "mapInArrow", lambda self, f, schema: batches.append(self) or self.withColumn("mct", F.lit(0)))
    book = mct.RuleBook(rules)
    mct.connection_minutes(network.connections(first, second, pairs), book, spark.createDataFrame([], "submitter string, partner string"), _land(spark))
    batch = batches[0].toArrow().combine_chunks().to_batches()[0]
    rank, pos, minutes = book.indexes[0].value.best({n: batch.column(n) for n in batch.schema.names})
    assert len(pos) == 6 and set(pos.tolist()) == {0} and set(minutes.tolist()) == {60}
    assert sum(looked) <= 6 * rule_index.WORDS


def test_many_indexes_are_one_pass(spark, monkeypatch):
    monkeypatch.setattr(mct, "RULES_AT_ONCE", 4)
    rules = mct.complete(spark.createDataFrame([(i, "II", f"C{i}", f"0{i % 9}30") for i in range(20)], "rule_pos long, status string, arrival_carrier string, time string"))
    book = mct.RuleBook(rules)
    assert len(book.indexes) >= 5 and len(book.passes) == 1
    first, second, pairs = _met(spark)
    told = mct.connection_minutes(network.connections(first, second, pairs), book, spark.createDataFrame([], "submitter string, partner string"), _land(spark))
    assert {(r.company, r.mct) for r in told.collect()} == {("C0", 30), ("C1", 90), ("C2", 150)}
    assert told._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    monkeypatch.setattr(mct, "PASS_BYTES", 1)
    several = mct.RuleBook(rules)
    assert len(several.passes) == len(several.indexes)
    told = mct.connection_minutes(network.connections(first, second, pairs), several, spark.createDataFrame([], "submitter string, partner string"), _land(spark))
    assert {(r.company, r.mct) for r in told.collect()} == {("C0", 30), ("C1", 90), ("C2", 150)}


def test_flights_are_not_dealt_by_airport(spark):
    met = network.connections(*_met(spark))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dest#" not in plan and "hashpartitioning(hub#" in plan


def test_connections_off_the_paths_are_not_looked_up(spark, monkeypatch):
    first, second, pairs = _met(spark)
    only = spark.createDataFrame([("AAX", "BBX", "BBX", "CCX")], "origin string, dest string, origin2 string, dest2 string")
    rules, none = mct.default_rules(spark, 60), spark.createDataFrame([], "submitter string, partner string")
    seen, before = [], mct.connection_minutes
    monkeypatch.setattr(mct, "connection_minutes", lambda met, *more: seen.append(met) or before(met, *more))
    got = network.connections_by_rules(first, second, pairs, rules, none, _land(spark), only=only)
    assert sorted((r.company, r.dest2) for r in got.collect()) == [(f"C{i}", "CCX") for i in range(3)]
    assert seen[0].count() == 3


def test_through_flights_are_dealt_once(spark):
    at = lambda h: NOON + timedelta(hours=h)
    rows = [("O", n, at(24 * d + a), at(24 * d + b), o, e) for n in ("1", "2") for d in range(40) for a, b, o, e in ((0, 9, "AAA", "DDD"), (0, 2, "AAA", "BBB"), (3, 5, "BBB", "CCC"), (6, 9, "CCC", "DDD"), (3, 9, "BBB", "DDD"), (3, 9, "BBB", "DDD"))]
    # one that is in the air all the time, so that all days are one run
    rows += [("O", "2", at(-1), at(24 * 41), "XXX", "YYY")]
    told = assembly.same_flight_expand(spark.createDataFrame(rows, "company string, number string, dep timestamp_ntz, arr timestamp_ntz, origin string, dest string"))
    assert told._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    got = {(r.number, r.flight.dep, r.flight.arr, r.flight.origin): [q.origin + q.dest for q in r.legs] for r in told.collect()}
    assert len(got) == told.count() == 2 * 40 * 5 + 1
    for n in ("1", "2"):
        for d in range(40):
            assert got[n, at(24 * d), at(24 * d + 9), "AAA"] == ["AAABBB", "BBBCCC", "CCCDDD"]
            assert got[n, at(24 * d + 3), at(24 * d + 9), "BBB"] == ["BBBCCC", "CCCDDD"]
            assert got[n, at(24 * d), at(24 * d + 2), "AAA"] == ["AAABBB"]
    assert got["2", at(-1), at(24 * 41), "XXX"] == ["XXXYYY"]


def test_flights_of_unknown_times_stand_for_themselves(spark):
    at = lambda h: NOON + timedelta(hours=h)
    rows = [("O", "1", at(0), at(5), "AAA", "CCC"), ("O", "1", at(0), at(2), "AAA", "BBB"), ("O", "1", at(3), at(5), "BBB", "CCC"), ("O", "1", None, at(4), "AAA", "BBB"), ("O", "1", at(3), None, "BBB", "CCC"), ("O", "1", at(4), at(1), "BBB", "CCC")]
    told = assembly.same_flight_expand(spark.createDataFrame(rows, "company string, number string, dep timestamp_ntz, arr timestamp_ntz, origin string, dest string")).collect()
    assert sorted(len(r.legs) for r in told) == [1] * 5 + [2]


def test_nobodys_rules_are_numbered_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "STRETCH_BITS", 2)
    rule = lambda ids, time: mct.complete(ids.select(F.col("id").alias("rule_pos"), F.lit("DD").alias("status"), F.concat(F.lit("C"), F.col("id") % 40).alias("arrival_carrier"), F.lit(time).alias("time")))
    current, adds = maintenance.upserted(rule(spark.range(0), "0100"), rule(spark.range(1, 31), "0100")), rule(spark.range(25, 61), "0200")
    after = maintenance.upserted(current, adds)
    got = {r.rule_pos: (r.arrival_carrier, r.time) for r in after.collect()}
    old = [f"C{i}" for i in range(1, 31)]
    later = [f"C{i % 40}" for i in range(31, 61) if f"C{i % 40}" not in old]
    added = {f"C{i % 40}" for i in range(25, 61)}
    assert got == {n: (c, "0200" if c in added else "0100") for n, c in enumerate([*old, *later], 1)}
    # no window holds all rules of an owner
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(owner#" in plan and "_stretch#" in plan.split("row_number() windowspecdefinition(")[1].split(" ASC")[0]


def test_coded_flights_are_looked_up_alike(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    a, partners = derived.airports(spark, sf), derived.filters(spark, sf)
    f = derived.flights(spark, sf).unionByName(derived.flights(spark, sf).limit(40).withColumns({"number": F.lit(None).cast("string"), "duplicates": F.array(F.lit("C1"), F.lit("C3"), F.lit("ZZ")), "origin": F.lit("QQX")}))
    f = f.localCheckpoint()
    pairs, columns = network.siblings(a), ["company", "number", "origin", "dep", "company2", "number2", "dest2", "dep2"]
    for passes in (mct.PASS_BYTES, 1):
        monkeypatch.setattr(mct, "PASS_BYTES", passes)
        monkeypatch.setattr(mct, "RULES_AT_ONCE", 100)
        book = mct.RuleBook(derived.rules(spark, sf))
        assert len(book.indexes) > 1 and (len(book.passes) > 1) == (passes == 1)
        told = mct.connection_minutes(network.connections(mct.coded(f, book, a), mct.coded(f, book, a, "2"), pairs, 0, 9000), book, partners, a, keep=columns)
        # the flights' texts stay out of the lookup of a pair
        assert told.columns == [*columns, "mct"] and (passes == 1 or "MapInArrow" not in told._jdf.queryExecution().optimizedPlan().toString())
        plain = mct.connection_minutes(network.connections(f, f, pairs, 0, 9000), book, partners, a, keep=columns)
        want = plain.groupBy(*plain.columns).count()
        assert want.count() > 500 and want.select("mct").distinct().count() > 5
        assert told.groupBy(*told.columns).count().exceptAll(want).count() == 0 == want.exceptAll(told.groupBy(*told.columns).count()).count()


def test_more_lines_and_flights_make_more_tasks(spark, monkeypatch):
    from skylattice.plans import itinerary_queries, schedule_queries
    from skylattice.sources import tables

    kind, calls = type(spark.range(1)), []
    before = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by: calls.append(n) or before(self, n, *by))

    def dealt(query):
        calls.clear()
        query(spark, "/root/testdata/sf0.001")
        return len(calls)

    assert dealt(schedule_queries.schedule_blocks) == dealt(itinerary_queries.segment_lookup) == 0
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 500)
    assert dealt(schedule_queries.schedule_blocks) >= 3 and dealt(itinerary_queries.segment_lookup) == 1
    rows = schedule_queries.schedule_blocks(spark, "/root/testdata/sf0.001")
    assert rows.select("block", "pos").distinct().count() == rows.count() > 4000


def test_names_of_a_route_are_told_apart_before_they_are_gathered(spark):
    from skylattice.operators import schedule

    plan = schedule.routes(derived.flights(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
