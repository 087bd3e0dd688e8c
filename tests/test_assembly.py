"""Legs, segments, through flights, rule files and table upkeep on small inputs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skylattice.operators import assembly, itineraries, lines, maintenance
from skylattice.sources import fixed_width


def line(record, fields, layout):
    text = [" "] * 200
    text[0] = record
    for name, value in fields.items():
        first, last = layout[name]
        text[first - 1 : last] = list(str(value).ljust(last - first + 1)[: last - first + 1])
    return "".join(text)


def leg(seq, a, b, dep, arr, **more):
    return line("3", {"airline": "XX", "flight": "0012", "variation": "01", "leg_sequence": f"{seq:02d}", "service_type": "J", "from_date": "01JAN26", "to_date": "31JAN26", "days": "1234567", "departure_station": a, "aircraft_std": dep, "departure_offset": "+0100", "arrival_station": b, "passenger_sta": arr, "arrival_offset": "+0100", "departure_day": "0", "arrival_day": "0", "owner": "OWN", "joint_operation": "AA BB ", "serial": f"{seq:06d}", **more}, fixed_width.LEG)


def test_blocks_plans_and_segments(spark):
    lines = [leg(1, "AAA", "BBB", "0800", "0900"), line("4", {"board_point_indicator": "A", "off_point_indicator": "B", "dei": "010", "board_point": "AAA", "off_point": "BBB", "data": "YY 0123 /ZZ 0456A"}, fixed_width.SEGMENT), leg(2, "BBB", "CCC", "1000", "1130", arrival_day="1"), line("4", {"board_point_indicator": "A", "off_point_indicator": "C", "dei": "050", "board_point": "AAA", "off_point": "CCC", "data": "QQ 0009"}, fixed_width.SEGMENT), leg(1, "CCC", "AAA", "1300", "1400")]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "file int, line_no long, value string")
    legs = fixed_width.legs(df)
    first = legs.orderBy("line_no").first()
    assert (first.owner, first.joint_operation, first.dep_std_minute, first.arr_sta_minute) == ("OWN", ["AA", "BB"], 480, 540)
    legs = legs.withColumnRenamed("dep_std_minute", "dep_minute").withColumnRenamed("arr_sta_minute", "arr_minute")
    blocked = assembly.blocks(legs, ["file"])
    assert [(r.block, r.pos) for r in blocked.orderBy("line_no").collect()] == [(1, 1), (1, 2), (2, 1)]
    assert assembly.broken(blocked, ["file"]).count() == 0
    plans = assembly.plans(blocked, ["file"])
    assert {(r.block, r.first, r.last, r.origin, r.dest, r.day_offset, r.block_minutes) for r in plans.collect()} == {(1, 1, 1, "AAA", "BBB", 0, 60), (1, 2, 2, "BBB", "CCC", 1, 1530), (1, 1, 2, "AAA", "CCC", 1, 1650), (2, 1, 1, "CCC", "AAA", 0, 60)}
    segments = assembly.attached(fixed_width.segments(df), legs, ["file"])
    assert {(r.line_no, r.leg_line) for r in segments.collect()} == {(1, 0), (3, 2)}
    block_of = blocked.select("file", F.col("line_no").alias("leg_line"), "block")
    told = assembly.overlay(assembly.span_segments(plans, segments.join(block_of, ["file", "leg_line"]), ["file", "block"]), ["block", "first", "last"]).collect()
    got = {(r.first, r.last): ([d.company + d.flight_number + (d.operational_suffix or "") for d in r.duplicates or []], r.operating and r.operating.company) for r in told}
    assert got == {(1, 1): (["YY0123", "ZZ0456A"], None), (1, 2): ([], "QQ")}


def test_orphan_segments(spark):
    seg = spark.createDataFrame([(1, 0, "x"), (1, 5, "y")], "file int, line_no long, data string")
    legs = spark.createDataFrame([(1, 3)], "file int, line_no long")
    assert {(r.data, r.leg_line) for r in assembly.attached(seg, legs, ["file"]).collect()} == {("x", None), ("y", 3)}


def test_rule_files(spark):
    def errors(lines):
        df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
        return sorted((r.line_no, r.error) for r in fixed_width.rule_file_errors(df).collect())

    head = lambda content: line("1", {"title": "RULES", "content": content, "serial": "000001"}, fixed_width.RULE_HEADER)
    rule = lambda n, **more: line("2", {"time": "0130", "status": "DD", "serial": f"{n:06d}", **more}, fixed_width.RULE)
    pair = lambda n: line("3", {"submitter": "AA", "partners": "BBCCDD", "serial": f"{n:06d}"}, fixed_width.FILTER)
    end = lambda n, kind="4": line(kind, {"serial": f"{n:06d}"}, fixed_width.FILTER)[:193] + "E" + f"{n:06d}"
    assert errors([head("F"), rule(2), rule(3), end(3)]) == [] and errors([head("F"), rule(2), end(2, "3") + "\r"]) == []
    asks = rule(2, departure_station="***", arrival_carrier="AA")
    assert errors([head("F"), asks, end(2)]) == [(1, "no filter record")]
    assert errors([head("F"), asks, pair(3), end(3)]) == []
    df = spark.createDataFrame(list(enumerate([head("F"), asks, pair(3), end(3, "3")])), "line_no long, value string")
    assert [r.partner for r in fixed_width.rule_filters(df).collect()] == ["BB", "CC", "DD"]
    r = fixed_width.rules(df).first()
    assert r.needs_filter and r.departure_station is None and r.minutes == 90 and not r.suppression
    assert errors([head("F"), rule(3, action="A"), end(9), rule(2)[:100]]) == [(1, "action in a full file"), (1, "serial does not follow"), (2, "trailer does not tell the last serial"), (3, "no trailer"), (3, "not 200 bytes"), (3, "record out of order"), (3, "serial does not follow")]
    assert errors([head("U"), rule(2), end(2)]) == [(1, "no action in an updates file")]


def test_through_flights(spark):
    t = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    rows = [("XX", "1", "A", "D", t(0), t(9)), ("XX", "1", "A", "B", t(0), t(2)), ("XX", "1", "B", "C", t(3), t(5)), ("XX", "1", "C", "D", t(6), t(9)), ("XX", "1", "A", "C", t(0), t(5)), ("XX", "1", "B", "D", t(3), t(9)), ("XX", "2", "A", "D", t(0), t(9)), ("XX", "3", "A", "C", t(0), t(5)), ("XX", "3", "A", "B", t(0), t(2))]
    df = spark.createDataFrame(rows, "company string, number string, origin string, dest string, dep timestamp_ntz, arr timestamp_ntz")
    got = {(r.number, r.flight.origin + r.flight.dest): [x.origin + x.dest for x in r.legs] for r in assembly.same_flight_expand(df).collect()}
    assert got == {("1", "AD"): ["AB", "BC", "CD"], ("1", "AB"): ["AB"], ("1", "BC"): ["BC"], ("1", "CD"): ["CD"], ("1", "AC"): ["AB", "BC"], ("1", "BD"): ["BC", "CD"], ("2", "AD"): ["AD"], ("3", "AC"): ["AC"], ("3", "AB"): ["AB"]}


def test_measures_and_filters(spark):
    t = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    legs = [("AA", "1", "AA", "A", "B", t(8), t(12), 240), ("UA", "2", "UX", "B", "C", t(14.5), t(23), 510)]
    one = [("AA", "1", "AA", "A", "B", t(0), t(5), 300), ("AA", "1", "AA", "B", "C", t(7), t(25), 1065)]
    flight = "array<struct<company:string,number:string,op_company:string,origin:string,dest:string,dep:timestamp_ntz,arr:timestamp_ntz,block:int>>"
    x = itineraries.measured(spark.createDataFrame([(1, legs), (2, one)], f"id int, flights {flight}"))
    got = {r.id: (r.transports, r.transfers, r.transfer_time, r.travel, r.flown, r.airports) for r in x.collect()}
    assert got == {1: (2, 1, 150, 900, 750, ["A", "B", "C"]), 2: (1, 0, 0, 1500, 1365, ["A", "B", "C"])}
    kept = lambda **k: {r.id for r in itineraries.allowed(x, **k).collect()}
    assert kept(carriers=["AA", "UX"]) == {1, 2} and kept(carriers=["AA", "UA"]) == {2} and kept(transfers=0) == {2} and kept(days=1) == {1}


AIRPORTS = "code string, country string, city string, state string, latitude double, longitude double"
FLIGHTS = "company string, number string, op_company string, op_number string, duplicates array<string>, origin string, dest string, dep timestamp_ntz, arr timestamp_ntz, block int, departure_terminal string, arrival_terminal string"


def fly(company, number, a, b, dep, arr):
    t = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    return company, number, company, number, [], a, b, t(dep), t(arr), int(60 * (arr - dep)), None, None


def airports(spark):
    return spark.createDataFrame([(c, c, c, None, 0.0, float(i)) for i, c in enumerate(("AAA", "BBB", "CCC", "DDD"))], AIRPORTS)


def test_a_flight_and_its_through_flight_are_two_keys(spark):
    f = spark.createDataFrame([fly("AA", "1", "AAA", "BBB", 8, 9), fly("AA", "1", "AAA", "CCC", 8, 12), fly("AA", "1", "BBB", "CCC", 10, 12)], FLIGHTS)
    hot = spark.createDataFrame([("AAA", "CCC"), ("CCC", "AAA")], "origin string, dest string")
    cached = itineraries.cache(hot, f, airports(spark))
    day = datetime(2026, 1, 1).date()
    assert {(r.origin, r.dest, r.dep_date): r.itineraries for r in cached.collect()} == {("AAA", "CCC", day): [["AA_1_AAA_CCC_2026-01-01"]], ("CCC", "AAA", day): []}
    got = itineraries.answer(cached, cached, f).collect()
    assert [(r.asked_dest, [(x.origin, x.dest) for x in r.flights], r.travel) for r in got] == [("CCC", [("AAA", "CCC")], 240)]
    found = itineraries.search(cached, f, airports(spark), transfers=2).collect()
    assert [[(x.origin, x.dest) for x in r.flights] for r in found] == [[("AAA", "CCC")]]
    assert itineraries.search(cached.limit(0), f, airports(spark), transfers=2).collect() == []


def test_cached_answers_follow_flights_and_filters(spark):
    first, second, gone = fly("AA", "1", "AAA", "BBB", 8, 12), fly("UA", "2", "BBB", "CCC", 16, 24), fly("ZZ", "9", "BBB", "CCC", 17, 24)
    before = spark.createDataFrame([first, second, gone], FLIGHTS)
    hot = spark.createDataFrame([("AAA", "CCC"), ("AAA", "BBB")], "origin string, dest string")
    cached = itineraries.cache(hot, before, airports(spark))
    assert sorted(map(len, (r.itineraries for r in cached.collect()))) == [1, 2]
    # a flight goes, another is later now
    now = spark.createDataFrame([first, fly("UA", "2", "BBB", "CCC", 18, 26)], FLIGHTS)
    got = lambda **k: {(r.asked_dest, len(r.flights), r.transfers, r.travel) for r in itineraries.answer(cached, cached, now, **k).collect()}
    assert got() == {("CCC", 2, 1, 1080), ("BBB", 1, 0, 240)} and got(transfers=0) == {("BBB", 1, 0, 240)} and got(carriers=["AA"]) == {("BBB", 1, 0, 240)}


def test_through_flights_are_taken_apart_before_measures(spark):
    f = spark.createDataFrame([fly("AA", "1", "AAA", "CCC", 8, 13), fly("AA", "1", "AAA", "BBB", 8, 10), fly("AA", "1", "BBB", "CCC", 11, 13), fly("UA", "2", "CCC", "DDD", 17, 20)], FLIGHTS)
    asked = spark.createDataFrame([("AAA", "DDD", datetime(2026, 1, 1).date())], "origin string, dest string, dep_date date")
    plain = lambda **k: sorted(([x.origin + x.dest for x in r.flights], r.transports, r.transfers, r.transfer_time, r.travel, r.flown, r.airports) for r in itineraries.search(asked, f, airports(spark), transfers=2, **k).collect())
    # the connection AAA-BBB-CCC of one flight number is none: the through flight stands for it
    assert plain() == [(["AAACCC", "CCCDDD"], 2, 1, 240, 720, 480, ["AAA", "CCC", "DDD"])]
    legs = itineraries.through(f)
    assert plain(legs=legs) == [(["AAABBB", "BBBCCC", "CCCDDD"], 2, 1, 240, 720, 420, ["AAA", "BBB", "CCC", "DDD"])]
    cached = itineraries.cache(asked, f, airports(spark))
    assert [[x.origin + x.dest for x in r.flights] for r in itineraries.answer(cached, asked, f, legs=legs).collect()] == [["AAABBB", "BBBCCC", "CCCDDD"]]


def test_refresh_equals_a_full_rebuild(spark):
    hot = spark.createDataFrame([("AAA", "DDD"), ("AAA", "BBB"), ("BBB", "DDD")], "origin string, dest string")
    old = [fly("AA", "1", "AAA", "BBB", 8, 12), fly("UA", "2", "BBB", "CCC", 16, 26), fly("LH", "3", "CCC", "DDD", 31, 33), fly("LH", "5", "CCC", "DDD", 40, 41), fly("KL", "7", "AAA", "BBB", 80, 82)]
    # one goes, one moves, one comes on a new edge and one on a new day
    new = [old[0], old[1], fly("LH", "3", "CCC", "DDD", 30, 33), fly("XX", "4", "AAA", "DDD", 9, 12), fly("KL", "8", "AAA", "BBB", 104, 105)]
    before, after, land = spark.createDataFrame(old, FLIGHTS), spark.createDataFrame(new, FLIGHTS), airports(spark)
    rows = lambda df: sorted(map(str, df.select("origin", "dest", "dep_date", "itineraries").collect()))
    cached = itineraries.cache(hot, before, land)
    want = rows(itineraries.cache(hot, after, land))
    assert any("3_CCC_DDD" in r and "1_AAA_BBB" in r for r in want)
    assert rows(itineraries.refresh(cached, hot, before, after, land)) == want
    dirty = itineraries.touched(hot, itineraries.changed(before, before.limit(0).unionByName(before.filter("company <> 'KL'"))), before, land)
    assert {(r.origin, r.dest, str(r.dep_date)) for r in dirty.collect()} == {("AAA", d, f"2026-01-0{i}") for d in ("BBB", "DDD") for i in (3, 4, 5)}


def test_table_upkeep(spark):
    now = spark.createDataFrame([("AAA", "x"), ("BBB", "y")], "code string, name string")
    new = spark.createDataFrame([("BBB", "z"), ("CCC", "w"), ("CCC", "w")], "code string, name string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(maintenance.inserted(now, new, ["code"])) == [("AAA", "x"), ("BBB", "y"), ("CCC", "w")]
    assert rows(maintenance.updated(now, new, ["code"])) == [("AAA", "x"), ("BBB", "z")]
    assert rows(maintenance.deleted(now, new, ["code"])) == [("AAA", "x")] and rows(maintenance.looked_up(now, new, ["code"])) == [("BBB", "y")]
    old, none = spark.createDataFrame([("AA", "BB")], "submitter string, partner string"), spark.createDataFrame([], "submitter string, partner string")
    assert rows(maintenance.filters_after(old, none, False)) == [("AA", "BB")] and rows(maintenance.filters_after(old, none, True)) == []
    raw = spark.createDataFrame([(1, " dd ", None, " aa", "0130", True), (2, "XX", "BBB", "A", "2561", False)], "rule_pos long, status string, arrival_station string, arrival_carrier string, time string, needs_filter boolean")
    got = maintenance.normalised(raw, "BBB").withColumn("errors", maintenance.rule_errors()).orderBy("rule_pos").collect()
    assert (got[0].status, got[0].arrival_station, got[0].departure_station, got[0].arrival_carrier, got[0].needs_filter, got[0].errors) == ("DD", "BBB", "BBB", "AA", False, [])
    assert got[1].errors == ["status", "time", "arrival_carrier"]


def test_lines_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(lines, "STRETCH_BITS", 2)
    rows = [(f, i * 3 % 100, (i * 7) % 5 if i % 4 else None) for f in ("a", None) for i in range(33)]
    df = spark.createDataFrame(rows, "f string, n long, v long")
    x = lines.previous(lines.running(lines.running(df, ["f"], "n", "v", "total"), ["f"], "n", "v", "top", "max"), ["f"], "n", ["n", "v"], "p")
    got = {(r.f, r.n): (r.total, r.top, r.p and tuple(r.p)) for r in x.collect()}
    for f in ("a", None):
        own, total, top, before = sorted(r[1:] for r in rows if r[0] == f), 0, None, None
        for n, v in own:
            total, top = total + (v or 0), max([y for y in (top, v) if y is not None], default=None)
            assert got[f, n] == (total, top, before)
            before = (n, v)
