"""Connection-time rules against a plain restatement, and the precedence of small rule sets."""

import random
from datetime import date, datetime, timedelta

import pytest

from skylattice.functions.geo import effective_date
from skylattice.operators import mct, network, rule_index
from skylattice.sources import derived
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
FLIGHTS = "company string, number string, origin string, dest string, dep timestamp_ntz, arr timestamp_ntz, block int, op_company string, op_number string, duplicates array<string>, departure_terminal string, arrival_terminal string"
AIRPORTS = "code string, country string, city string, state string, latitude double, longitude double"
NOON = datetime(2026, 3, 1, 12)


def fits(r, c, land, partners):
    """Whether one rule fits a connection, field by field."""
    (a, b), status = (c.first, c.second), c.status
    if r.status != status or r.owner not in (None, a.dest, b.origin):
        return False
    if any(r[x] is not None for x in (*mct.AIRCRAFT, *mct.REGION, *mct.SUPPRESSED_PLACE)):
        return False
    for field, value in (("arrival_station", a.dest), ("departure_station", b.origin), ("previous_station", a.origin), ("next_station", b.dest), ("previous_country", land[a.origin][0]), ("next_country", land[b.dest][0]), ("previous_state", land[a.origin][1]), ("next_state", land[b.dest][1]), ("arrival_terminal", a.arrival_terminal), ("departure_terminal", b.departure_terminal)):
        if r[field] is not None and r[field] != value:
            return False
    for side, f in (("arrival", a), ("departure", b)):
        carrier, flag, operating = r[side + "_carrier"], r[side + "_codeshare"], r[side + "_operating"]
        shared = bool(f.duplicates) or f.company != f.op_company or f.number != f.op_number
        if carrier is not None:
            if carrier != f.company and carrier not in f.duplicates or carrier != f.company and not flag and operating is None:
                return False
        elif flag and not shared:
            return False
        if operating is not None and not (shared and f.op_company == operating):
            return False
        low, high = r[side + "_from"], r[side + "_to"]
        if low is not None and high is not None and not int(low) <= int(f.number) <= int(high):
            return False
    read = lambda x: datetime.strptime(x.title(), "%d%b%y").date()
    if r.effective_from is not None and read(r.effective_from) > b.dep.date() or r.effective_to is not None and read(r.effective_to) < b.dep.date():
        return False
    return not r.needs_filter or (a.company, b.company) in partners or (b.company, a.company) in partners


def rank(r):
    has = lambda f: bool(r[f]) if f in mct.FLAGS else r[f] is not None
    groups = [n for n, fields in mct.GROUPS.items() if any(map(has, fields))]
    return max(groups, default=0), len(groups), sum(has(f) for f in mct.SCOPE if f != "status"), has("arrival_station") + has("departure_station")


def minutes_of(rules, c, land, partners):
    if c.status is None:
        return 180
    met = [r for r in rules if fits(r, c, land, partners)]
    gone = {tuple(r[x] for x in mct.SCOPE) for r in met if r.suppression}
    source = lambda r: 2 if r.owner is None else 0 if r.owner == c.first.dest else 1
    for r in sorted(met, key=lambda r: (*(-x for x in rank(r)), source(r), r.rule_pos)):
        if not r.suppression and tuple(r[x] for x in mct.SCOPE) not in gone and r.time and len(r.time) == 4:
            return int(r.time[:2]) * 60 + int(r.time[2:])
    return 180


class Pair:
    def __init__(self, first, second, land):
        self.first, self.second = first, second
        lands = [land[x][0] for x in (first.origin, first.dest, second.origin, second.dest)]
        self.status = None if None in lands else "".join("D" if lands[i] == lands[i + 1] else "I" for i in (0, 2))


@pytest.mark.parametrize("index_bytes", [rule_index.INDEX_BYTES, 15_000])
def test_all_rules_against_a_restatement(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(rule_index, "INDEX_BYTES", index_bytes)
    airports, rules, partners = derived.airports(spark, SF), derived.rules(spark, SF), derived.filters(spark, SF)
    land = {r.code: (r.country, r.state) for r in airports.collect()}
    rng = random.Random(1)
    flights = rng.sample(derived.flights(spark, SF).collect(), 500)
    df = spark.createDataFrame(flights, FLIGHTS)
    met = network.connections(df, df, network.siblings(airports), 0, 40000)
    told = mct.connection_minutes(met, rules, partners, airports)
    assert len(mct.RuleBook(rules).indexes) > (index_bytes < 1 << 20)
    assert "CartesianProduct" not in told._jdf.queryExecution().executedPlan().toString()
    own, pairs = rules.collect(), {(r.submitter, r.partner) for r in partners.collect()}
    by = {}
    for f in flights:
        by.setdefault((f.company, f.number, f.origin, f.dest, f.dep), f)
    rows = told.collect()
    rows = rng.sample(rows, min(400, len(rows)))
    assert len(rows) > 100 and len({r.mct for r in rows}) > 10
    for r in rows:
        c = Pair(by[r.company, r.number, r.origin, r.dest, r.dep], by[r.company2, r.number2, r.origin2, r.dest2, r.dep2], land)
        assert r.mct == minutes_of(own, c, land, pairs), r


def told(spark, rules, flights=None, partners=(), airports=None):
    """Minutes per (company, number) of the second flight of connections at BBB."""
    fly = lambda company, number, a, b, dep, **more: (company, number, a, b, dep, dep + timedelta(hours=1), 60, more.get("op", company), number, more.get("dups", []), more.get("dt"), more.get("at"))
    first, second = flights(fly) if flights else ([fly("AA", "1", "AAA", "BBB", NOON, at="T1")], [fly(c, "2", "BBB", "CCC", NOON + timedelta(hours=6)) for c in ("UA", "LH")])
    land = spark.createDataFrame(airports or [(c, c, c, "HI" if c != "BBB" else "NY", float(i), float(i)) for i, c in enumerate(("AAA", "BBB", "CCC"))], AIRPORTS)
    names = sorted({k for r in rules for k in r} | {"rule_pos", "status", "time"})
    kind = lambda n: "boolean" if n in (*mct.FLAGS, "suppression") else "long" if n == "rule_pos" else "string"
    table = mct.complete(spark.createDataFrame([tuple({"rule_pos": i, "status": "II", **r}.get(n, False if kind(n) == "boolean" else None) for n in names) for i, r in enumerate(rules)], ", ".join(f"{n} {kind(n)}" for n in names)))
    a, b = spark.createDataFrame(first, FLIGHTS), spark.createDataFrame(second, FLIGHTS)
    met = network.connections(a, b, network.siblings(land), 0)
    out = mct.connection_minutes(met, table, spark.createDataFrame(list(partners), "submitter string, partner string"), land)
    return {(r.company2, r.number2): r.mct for r in out.collect()}


@pytest.mark.parametrize("rules,want", [
    ([], 180),
    ([{"time": "0300"}, {"time": "0130", "owner": "BBB", "arrival_station": "BBB"}], 90),
    # a carrier outranks a station, and the far station both
    ([{"time": "0030", "arrival_station": "BBB", "departure_station": "BBB"}, {"time": "0200", "arrival_carrier": "AA"}], 120),
    ([{"time": "0200", "arrival_carrier": "AA", "arrival_from": "0001", "arrival_to": "0009"}, {"time": "0045", "next_station": "CCC"}], 45),
    # the most specific has no time: the next counts
    ([{"time": None, "arrival_carrier": "AA"}, {"time": "0040"}], 40),
    # a suppression takes away its own scope only
    ([{"time": "0130"}, {"time": "0100", "arrival_station": "BBB"}, {"suppression": True, "arrival_station": "BBB"}], 90),
    ([{"time": "0130"}, {"time": "0100", "arrival_station": "BBB"}, {"suppression": True, "arrival_station": "BBB", "suppression_region": "EUR"}], 60),
    # one of another airport takes it away only where that airport is met
    ([{"time": "0130"}, {"time": "0100", "arrival_carrier": "AA"}, {"suppression": True, "arrival_carrier": "AA", "owner": "BBB"}], 90),
    ([{"time": "0130"}, {"time": "0100", "arrival_carrier": "AA"}, {"suppression": True, "arrival_carrier": "AA", "owner": "AAA"}], 60),
    # a range asks for both ends, and for numbers
    ([{"time": "0130"}, {"time": "0100", "arrival_from": "0001"}], 60),
    ([{"time": "0130"}, {"time": "0100", "arrival_from": "0002", "arrival_to": "0009"}, {"time": "0045", "arrival_from": "x", "arrival_to": "0009"}], 130 - 40),
    # states, unknown values, aircraft and regions never fit
    ([{"time": "0035", "previous_state": "HI", "next_state": "HI", "previous_country": "AAA", "next_country": "CCC"}], 35),
    ([{"time": "0035", "previous_state": "NY"}, {"time": "0036", "arrival_aircraft_type": "320"}, {"time": "0037", "next_region": "EUR"}], 180),
    ([{"time": "0050", "arrival_terminal": "T1"}, {"time": "0055", "arrival_terminal": "T2"}], 50),
    # dates include both ends; what does not parse fits nothing
    ([{"time": "0050", "effective_from": "01mar26", "effective_to": "01MAR26"}, {"time": "0055", "effective_from": "02MAR26"}, {"time": "0056", "effective_to": "99XXX26"}], 50),
    # owners: the airport itself before nobody, others never
    ([{"time": "0050"}, {"time": "0070", "owner": "BBB"}, {"time": "0020", "owner": "AAA"}], 70),
])
def test_precedence(spark, rules, want):
    assert set(told(spark, rules).values()) == {want}


def test_interline_filter_and_codeshares(spark):
    rules = [{"time": "0400", "needs_filter": True}]
    assert told(spark, rules, partners=[("UA", "AA")]) == {("UA", "2"): 240, ("LH", "2"): 180}
    shared = lambda fly: ([fly("AA", "1", "AAA", "BBB", NOON)], [fly("UA", "2", "BBB", "CCC", NOON + timedelta(hours=6), op="UA", dups=["NH"]), fly("UA", "3", "BBB", "CCC", NOON + timedelta(hours=6))])
    assert told(spark, [{"time": "0100", "departure_carrier": "UA"}], shared) == {("UA", "2"): 60, ("UA", "3"): 60}
    assert told(spark, [{"time": "0100", "departure_carrier": "NH"}], shared) == {("UA", "2"): 180, ("UA", "3"): 180}
    assert told(spark, [{"time": "0100", "departure_carrier": "NH", "departure_codeshare": True, "departure_operating": "UA"}], shared) == {("UA", "2"): 60, ("UA", "3"): 180}
    assert told(spark, [{"time": "0100", "departure_codeshare": True}], shared) == {("UA", "2"): 60, ("UA", "3"): 180}


def test_unknown_country_means_the_default(spark):
    land = [(c, None if c == "CCC" else c, c, "HI", float(i), float(i)) for i, c in enumerate(("AAA", "BBB", "CCC"))]
    assert set(told(spark, [{"time": "0035"}], airports=land).values()) == {180}


def test_connections_keep_their_own_minimum(spark):
    airports = spark.createDataFrame([(c, c, c, None, float(i), float(i)) for i, c in enumerate(("AAX", "BBX", "CCX"))], AIRPORTS)
    fly = lambda company, number, a, b, dep: (company, number, a, b, dep, dep + timedelta(hours=1), 60, company, number, [], None, None)
    first = [fly(f"C{i}", "1", "AAX", "BBX", NOON) for i in range(3)]
    second = [fly("C9", str(m), "BBX", "CCX", NOON + timedelta(hours=1, minutes=m)) for m in (39, 40, 179, 180, 220, 224, 225, 720, 721)]
    rules = mct.complete(spark.createDataFrame([(1, "II", "C0", "0040"), (2, "II", "C1", "0345")], "rule_pos long, status string, arrival_carrier string, time string"))
    none = spark.createDataFrame([], "submitter string, partner string")
    met = network.connections_by_rules(spark.createDataFrame(first, FLIGHTS), spark.createDataFrame(second, FLIGHTS), network.siblings(airports), rules, none, airports)
    got = {(r.company, int(r.number2)) for r in met.collect()}
    assert got == {("C0", m) for m in (40, 179, 180, 220, 224, 225, 720)} | {("C1", m) for m in (225, 720)} | {("C2", m) for m in (180, 220, 224, 225, 720)}


def test_effective_dates(spark):
    texts = ["01JAN26", "31dec69", "01Jan70", "29FEB25", "1JAN26", None, "01XXX26"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(effective_date(F.col("t"))).collect()]
    assert got == [date(2026, 1, 1), date(2069, 12, 31), date(1970, 1, 1), None, None, None, None]


def test_a_flight_that_meets_many_is_looked_up_once(spark, monkeypatch):
    """The bits that a flight leaves are worked out per flight of a batch, not per connection; the minutes are the same."""
    a, book = derived.airports(spark, SF), mct.RuleBook(derived.rules(spark, SF))
    f = derived.flights(spark, SF)
    hub = f.groupBy("origin").count().orderBy(F.desc("count"), "origin").first()[0]
    first, second = f.filter(F.col("dest") == hub).limit(40), f.filter(F.col("origin") == hub).limit(40)
    met = mct.coded(first, book, a).select("_codes").crossJoin(mct.coded(second, book, a, "2").select(F.col("_codes").alias("_codes2")))
    table = met.select("_codes", "_codes2", F.lit(False).alias("_partners"), F.lit(9000).cast("long").alias("_day")).toArrow().combine_chunks()
    whole, index, most = {x: table[x].chunk(0) for x in rule_index.CODED}, book.indexes[0].value, []
    index.meet(book.names.value)
    own = rule_index.RuleIndex._fits
    monkeypatch.setattr(rule_index.RuleIndex, "_fits", lambda self, of, *rest: most.append(len(of)) or own(self, of, *rest))
    together = index.best(whole)
    # a group of rules for each side's status, and both flights and whether they are partners
    assert table.num_rows == 1600 and max(most) <= 40 * 4
    monkeypatch.undo()
    each = [index.best({x: c.slice(i, 1) for x, c in whole.items()}) for i in range(0, 1600, 7)]
    for k in range(3):
        assert [int(x[k][0]) for x in each] == together[k][::7].tolist()


def test_no_row_of_the_first_flights_is_dealt_twice(spark):
    """A long window touches several buckets: departures go to each of them, the arrivals (chains of flights) to one."""
    f = spark.createDataFrame([("A", str(i), "XXX", "YYY", NOON + timedelta(hours=i), NOON + timedelta(hours=i + 1), 60) for i in range(40)] + [("B", str(i), "YYY", "ZZZ", NOON + timedelta(hours=i), NOON + timedelta(hours=i + 1), 60) for i in range(40)], "company string, number string, origin string, dest string, dep timestamp_ntz, arr timestamp_ntz, block int")
    pairs = spark.createDataFrame([(x, x) for x in ("XXX", "YYY", "ZZZ")], "code string, sibling string")
    met = network.connections(f.filter("origin = 'XXX'"), f.filter("origin = 'YYY'"), pairs)
    got = {(int(r.number), int(r.number2)) for r in met.collect()}
    assert got == {(i, j) for i in range(40) for j in range(40) if 3 <= j - i - 1 <= 12} and met.count() == len(got)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(made) == 1 and "dep2" in made[0] and "_low" not in made[0]
