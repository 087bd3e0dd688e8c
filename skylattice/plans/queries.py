"""Named queries over the test tables, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators import maintenance, mct, network, schedule, zones
from skylattice.sources import derived, fixed_width

AIRPORTS = """airports AS (SELECT chr(CAST(65 + n_nationkey // 5 AS INT)) || chr(CAST(65 + n_nationkey % 5 AS INT)) || 'X' AS code, r_name AS country,
 CAST(n_nationkey // 10 AS VARCHAR) AS city, 'S' || (n_nationkey % 3) AS state, CAST(-60 + (37 * n_nationkey) % 120 AS DOUBLE) AS lat, CAST(-180 + (73 * n_nationkey) % 360 AS DOUBLE) AS lon
 FROM nation JOIN region ON n_regionkey = r_regionkey)"""
FLIGHTS = """flights AS (SELECT 'C' || (l_partkey % 7) AS company, CAST(l_partkey % 97 AS VARCHAR) AS number,
 chr(CAST(65 + s_nationkey // 5 AS INT)) || chr(CAST(65 + s_nationkey % 5 AS INT)) || 'X' AS origin, chr(CAST(65 + c_nationkey // 5 AS INT)) || chr(CAST(65 + c_nationkey % 5 AS INT)) || 'X' AS dest,
 l_shipdate + to_minutes(CAST((37 * l_orderkey + 101 * l_linenumber) % 1440 AS INT)) AS dep,
 l_shipdate + to_minutes(CAST((37 * l_orderkey + 101 * l_linenumber) % 1440 + 60 + (13 * l_partkey) % 600 AS INT)) AS arr, CAST(60 + (13 * l_partkey) % 600 AS INT) AS block,
 'C' || ((CASE WHEN l_suppkey % 5 = 0 THEN l_partkey + 2 ELSE l_partkey END) % 7) AS op_company, CASE WHEN l_linenumber % 4 = 0 THEN 'C' || ((l_partkey + 1) % 7) END AS dup, 'T' || (l_partkey % 3) AS dterm, 'T' || (l_suppkey % 3) AS aterm, l_quantity AS quantity, l_linenumber AS line
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey)"""


def _distance(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


SIBLINGS = "sib AS (SELECT a.code, b.code AS sibling FROM airports a JOIN airports b ON a.code = b.code OR (a.country = b.country AND a.city = b.city))"
PATHS = f"""od AS (SELECT DISTINCT origin, dest FROM flights),
paths AS (SELECT e.origin AS a, e.dest AS b, f.origin AS c, f.dest AS d, ({_distance('pa', 'pb')} + CASE WHEN e.dest = f.origin THEN 0 ELSE {_distance('pb', 'pc')} END + {_distance('pc', 'pd')}) / {_distance('pa', 'pd')} AS circuity
 FROM od e JOIN sib ON sib.code = e.dest JOIN od f ON f.origin = sib.sibling JOIN airports pa ON pa.code = e.origin JOIN airports pb ON pb.code = e.dest JOIN airports pc ON pc.code = f.origin JOIN airports pd ON pd.code = f.dest
 WHERE f.dest <> e.dest AND f.dest <> e.origin AND (f.origin = e.dest OR f.origin <> e.origin)
 AND ((pd.country = pb.country AND pd.city = pb.city) OR NOT (pd.country = pa.country AND pd.city = pa.city)) AND {_distance('pa', 'pd')} > 1e-9)"""
MET = """met AS (SELECT x.company, x.number, x.origin, x.dest, x.dep, x.arr, x.block, y.company AS company2, y.number AS number2, y.origin AS origin2, y.dest AS dest2, y.dep AS dep2, y.arr AS arr2, y.block AS block2
 FROM (SELECT flights.*, sibling, unnest(generate_series(CAST(CAST(arr + INTERVAL 180 MINUTE AS DATE) AS TIMESTAMP), CAST(CAST(arr + INTERVAL 720 MINUTE AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM flights JOIN sib ON code = dest) x
 JOIN (SELECT *, CAST(CAST(dep AS DATE) AS TIMESTAMP) AS day FROM flights) y ON y.origin = x.sibling AND y.day = x.day
 WHERE y.dep BETWEEN x.arr + INTERVAL 180 MINUTE AND x.arr + INTERVAL 720 MINUTE AND (x.company <> y.company OR x.number <> y.number))"""
STATION = "chr(CAST(65 + ({0} % 25) // 5 AS INT)) || chr(CAST(65 + ({0} % 25) % 5 AS INT)) || 'X'"
# rules as they stand under their owners, those that fit each connection of 0 to 720 minutes, and the best in force
RULES = f"""parts AS (SELECT p_partkey AS k, p_size AS z FROM part),
rules0 AS (SELECT k AS rule_pos, ['DD', 'DI', 'ID', 'II'][CAST(k % 4 + 1 AS INT)] AS status, CASE WHEN k % 3 = 0 THEN {STATION.format('k')} END AS ast, CASE WHEN k % 9 = 0 THEN {STATION.format('k')} END AS dst,
 CASE WHEN k % 5 = 0 THEN 'C' || (k % 7) END AS ac, CASE WHEN k % 7 = 0 THEN 'C' || (z % 7) END AS dc, CASE WHEN k % 19 = 0 THEN 'C' || ((k + 1) % 7) END AS aop, CASE WHEN k % 11 = 0 THEN z END AS af, CASE WHEN k % 11 = 0 THEN z + 40 END AS ato,
 CASE WHEN k % 23 = 0 THEN z END AS df, CASE WHEN k % 23 = 0 THEN z + 60 END AS dt, CASE WHEN k % 29 = 0 THEN 'T' || (k % 3) END AS aterm, CASE WHEN k % 31 = 0 THEN 'T' || (z % 3) END AS dterm, CASE WHEN k % 41 = 0 THEN {STATION.format('z')} END AS pst,
 CASE WHEN k % 37 = 0 THEN 'S' || (k % 3) END AS pstate, CASE WHEN k % 43 = 0 THEN 'S' || (z % 3) END AS nstate, CASE WHEN k % 47 = 0 THEN DATE '1995-01-01' END AS ef, CASE WHEN k % 53 = 0 THEN DATE '1996-12-31' END AS et,
 k % 59 = 0 AS air, k % 61 = 0 AS supreg, k % 67 = 0 AS reg, k % 17 = 0 AS acs, k % 29 = 1 AS nf, k % 13 = 0 AS off, CASE WHEN k % 71 <> 0 THEN 30 + 5 * (z % 40) END AS minutes FROM parts),
rules1 AS MATERIALIZED (SELECT *, greatest(CASE WHEN ast IS NOT NULL OR dst IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN aterm IS NOT NULL OR dterm IS NOT NULL THEN 3 ELSE 0 END, CASE WHEN af IS NOT NULL OR df IS NOT NULL THEN 4 ELSE 0 END,
  CASE WHEN ac IS NOT NULL OR dc IS NOT NULL OR aop IS NOT NULL OR acs OR nf THEN 5 ELSE 0 END, CASE WHEN pst IS NOT NULL THEN 6 ELSE 0 END, CASE WHEN pstate IS NOT NULL OR nstate IS NOT NULL THEN 7 ELSE 0 END) AS hi,
 (ast IS NOT NULL OR dst IS NOT NULL)::INT + (aterm IS NOT NULL OR dterm IS NOT NULL)::INT + (af IS NOT NULL OR df IS NOT NULL)::INT + (ac IS NOT NULL OR dc IS NOT NULL OR aop IS NOT NULL OR acs OR nf)::INT + (pst IS NOT NULL)::INT + (pstate IS NOT NULL OR nstate IS NOT NULL)::INT AS groups,
 (ast IS NOT NULL)::INT + (dst IS NOT NULL)::INT + nf::INT + (ac IS NOT NULL)::INT + acs::INT + (aop IS NOT NULL)::INT + (dc IS NOT NULL)::INT + (aterm IS NOT NULL)::INT + (dterm IS NOT NULL)::INT + (pst IS NOT NULL)::INT + 2 * (af IS NOT NULL)::INT + 2 * (df IS NOT NULL)::INT + (pstate IS NOT NULL)::INT + (nstate IS NOT NULL)::INT + (ef IS NOT NULL)::INT + (et IS NOT NULL)::INT AS fields,
 (ast IS NOT NULL)::INT + (dst IS NOT NULL)::INT AS stations, concat_ws('/', coalesce(ast, '-'), coalesce(dst, '-'), status, coalesce(ac, '-'), coalesce(dc, '-'), coalesce(aop, '-'), coalesce(af, -1), coalesce(ato, -1), coalesce(df, -1), coalesce(dt, -1), coalesce(aterm, '-'), coalesce(dterm, '-'), coalesce(pst, '-'), coalesce(pstate, '-'), coalesce(nstate, '-'), coalesce(ef, DATE '1900-01-01'), coalesce(et, DATE '1900-01-01'), acs, nf) AS scope FROM rules0 WHERE NOT (air OR supreg OR reg)),
owned AS MATERIALIZED (SELECT *, NULL AS owner FROM rules1 WHERE ast IS NULL AND dst IS NULL UNION ALL SELECT *, ast FROM rules1 WHERE ast IS NOT NULL UNION ALL SELECT *, dst FROM rules1 WHERE dst IS NOT NULL AND dst IS DISTINCT FROM ast),
partners AS (SELECT DISTINCT 'C' || (k % 7) AS a, 'C' || (z % 7) AS b FROM parts UNION SELECT DISTINCT 'C' || (z % 7), 'C' || (k % 7) FROM parts)"""
TIMED = f"""{RULES},
cand AS MATERIALIZED (SELECT x.*, y.company AS company2, y.number AS number2, y.origin AS origin2, y.dest AS dest2, y.dep AS dep2, y.arr AS arr2, y.block AS block2, y.dterm AS dterm2,
 (CASE WHEN a.country = b.country THEN 'D' ELSE 'I' END) || (CASE WHEN c.country = d.country THEN 'D' ELSE 'I' END) AS cs, a.state AS s1, d.state AS s2, (x.dup IS NOT NULL OR x.company <> x.op_company) AS shared, row_number() OVER () AS id
 FROM (SELECT flights.*, sibling, unnest(generate_series(CAST(CAST(arr AS DATE) AS TIMESTAMP), CAST(CAST(arr + INTERVAL 720 MINUTE AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM flights JOIN sib ON code = dest) x
 JOIN (SELECT *, CAST(CAST(dep AS DATE) AS TIMESTAMP) AS day FROM flights) y ON y.origin = x.sibling AND y.day = x.day
 JOIN airports a ON a.code = x.origin JOIN airports b ON b.code = x.dest JOIN airports c ON c.code = y.origin JOIN airports d ON d.code = y.dest
 WHERE y.dep BETWEEN x.arr AND x.arr + INTERVAL 720 MINUTE AND (x.company <> y.company OR x.number <> y.number)),
fit AS MATERIALIZED (SELECT c.id, r.rule_pos, r.hi, r.groups, r.fields, r.stations, r.scope, r.off, r.minutes, CASE WHEN r.owner IS NULL THEN 2 WHEN r.owner = c.dest THEN 0 ELSE 1 END AS source
 FROM cand c JOIN owned r ON r.status = c.cs AND (r.owner IS NULL OR r.owner = c.dest OR r.owner = c.origin2) AND (r.ast IS NULL OR r.ast = c.dest) AND (r.dst IS NULL OR r.dst = c.origin2)
 AND (r.ac IS NULL OR r.ac = c.company OR (r.ac = c.dup AND (r.acs OR r.aop IS NOT NULL))) AND (r.ac IS NOT NULL OR NOT r.acs OR c.shared) AND (r.aop IS NULL OR (c.shared AND c.op_company = r.aop)) AND (r.dc IS NULL OR r.dc = c.company2)
 AND (r.af IS NULL OR CAST(c.number AS INT) BETWEEN r.af AND r.ato) AND (r.df IS NULL OR CAST(c.number2 AS INT) BETWEEN r.df AND r.dt) AND (r.aterm IS NULL OR r.aterm = c.aterm) AND (r.dterm IS NULL OR r.dterm = c.dterm2)
 AND (r.pst IS NULL OR r.pst = c.origin) AND (r.pstate IS NULL OR r.pstate = c.s1) AND (r.nstate IS NULL OR r.nstate = c.s2) AND (r.ef IS NULL OR CAST(c.dep2 AS DATE) >= r.ef) AND (r.et IS NULL OR CAST(c.dep2 AS DATE) <= r.et)
 LEFT JOIN partners p ON p.a = c.company AND p.b = c.company2 WHERE NOT r.nf OR p.a IS NOT NULL),
gone AS (SELECT DISTINCT id, scope FROM fit WHERE off),
best AS MATERIALIZED (SELECT f.id, f.minutes, row_number() OVER (PARTITION BY f.id ORDER BY hi DESC, groups DESC, fields DESC, stations DESC, source, rule_pos) AS rn FROM fit f ANTI JOIN gone g ON g.id = f.id AND g.scope = f.scope WHERE NOT off AND minutes IS NOT NULL),
mcts AS MATERIALIZED (SELECT c.*, CAST(coalesce(best.minutes, 180) AS INT) AS mct FROM cand c LEFT JOIN best ON best.rn = 1 AND best.id = c.id),
timed AS (SELECT * FROM mcts WHERE dep2 >= arr + to_minutes(mct))"""
PAIR = ["company", "number", "origin", "dest", "dep", "company2", "number2", "origin2", "dest2", "dep2"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"WITH {AIRPORTS} SELECT code, country, city, lat AS latitude, lon AS longitude FROM airports WHERE regexp_matches(code, '^[A-Z]{{3}}$') AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def airport_validity(spark, sf):
    return derived.airports(spark, sf).drop("state").filter("code rlike '^[A-Z]{3}$' and latitude between -90 and 90 and longitude between -180 and 180")


@query(f"WITH {AIRPORTS}, {SIBLINGS} SELECT code, string_agg(sibling, '|' ORDER BY sibling) AS siblings FROM sib GROUP BY code")
def city_equivalence(spark, sf):
    return network.siblings(derived.airports(spark, sf)).groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("sibling")), "|").alias("siblings"))


_OFFSET = "((CASE WHEN {0} % 25 < 12 THEN -1 ELSE 1 END) * (abs({0} % 25 - 12) * 60 + CASE WHEN {0} % 2 = 0 THEN 30 ELSE 0 END))"
_DAY = "[0, 0, 1, 2, -1, -1][CAST({0} % 6 + 1 AS INT)]"


@query(f"""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) + to_minutes(CAST((37 * l_orderkey + 101 * l_linenumber) % 1440 - {_OFFSET.format('l_partkey')} AS INT)) AS dep,
 CAST(l_shipdate AS DATE) + to_minutes(CAST((17 * l_partkey + l_suppkey) % 1440 + 1440 * ({_DAY.format('l_orderkey')} - {_DAY.format('l_partkey')}) - {_OFFSET.format('l_suppkey')} AS INT)) AS arr FROM lineitem""")
def dated_flights_utc(spark, sf):
    p = derived.dated_plans(spark, sf).withColumn("day_offset", geo.day_variation(F.col("arrival_day")) - geo.day_variation(F.col("departure_day")))
    return zones.dated(p).select("l_orderkey", "l_linenumber", "dep", "arr")


# offsets of each airport's zone in time; flights with what the clock at their origin says
ZONES = """years AS (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem),
steps AS (SELECT chr(CAST(65 + n_nationkey // 5 AS INT)) || chr(CAST(65 + n_nationkey % 5 AS INT)) || 'X' AS code, TIMESTAMP '1900-01-01' AS since, (n_nationkey % 25 - 12) * 60 AS m FROM nation
 UNION ALL SELECT chr(CAST(65 + n_nationkey // 5 AS INT)) || chr(CAST(65 + n_nationkey % 5 AS INT)) || 'X', make_timestamp(y, mo, d, 1, 0, 0), (n_nationkey % 25 - 12) * 60 + more FROM nation, years, (VALUES (4, 1, 60), (10, 25, 0)) v(mo, d, more) WHERE n_nationkey % 2 = 0)"""
LOCAL = FLIGHTS.replace("flights AS (", "scheduled AS (", 1) + ", " + ZONES + ", flights AS MATERIALIZED (SELECT f.*, f.dep + to_minutes(CAST(s.m AS INT)) AS dep_local, CAST(s.m AS INT) AS off, CAST(f.dep + to_minutes(CAST(s.m AS INT)) AS DATE) AS ldate FROM scheduled f ASOF JOIN steps s ON s.code = f.origin AND f.dep >= s.since)"


@query(f"""WITH {LOCAL}, back AS (SELECT f.*, (SELECT min(dep_local - to_minutes(CAST(s.m AS INT))) FROM (SELECT *, lead(since) OVER (PARTITION BY code ORDER BY since) AS until FROM steps) s WHERE s.code = f.origin AND dep_local - to_minutes(CAST(s.m AS INT)) >= s.since AND (s.until IS NULL OR dep_local - to_minutes(CAST(s.m AS INT)) < s.until)) AS again FROM flights f)
SELECT company, number, origin, dest, dep, dep_local, strftime(dep_local, '%Y-%m-%dT%H:%M:%S') || CASE WHEN off < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(off) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(off) % 60 AS VARCHAR), 2, '0') AS departure, again FROM back""")
def local_times(spark, sf):
    """Departures by the clock at the origin, and the instants that these times stand for."""
    a, steps = derived.zones(spark, sf)
    f = derived.flights(spark, sf).join(a.select(F.col("code").alias("origin"), "zone"), "origin")
    told = zones.with_instant(zones.with_local(f, "dep", "zone", steps, "dep_local"), "dep_local", "zone", steps, "again")
    return told.select("company", "number", "origin", "dest", "dep", "dep_local", zones.rfc3339(F.col("dep_local"), F.col("dep_local_offset")).alias("departure"), "again")


@query(f"WITH {AIRPORTS}, {LOCAL}, {SIBLINGS}, {TIMED.replace('CAST(c.dep2 AS DATE)', 'c.ldate2').replace('y.dterm AS dterm2', 'y.dterm AS dterm2, y.ldate AS ldate2')} SELECT {', '.join(PAIR)}, mct, ldate2 AS dep_date2 FROM timed")
def connections_local(spark, sf):
    """Connections whose rules are in force on the local date of the second departure."""
    (a, steps), r = derived.zones(spark, sf), derived.rules(spark, sf)
    f = zones.with_departure_dates(derived.flights(spark, sf), a, steps)
    return network.connections_by_rules(f, f, network.siblings(a), r, derived.filters(spark, sf), a, keep=[*PAIR, "dep_date2"]).select(*PAIR, "mct", "dep_date2")


@query(f"WITH {FLIGHTS} SELECT DISTINCT CAST(dep AS DATE) AS dep_date FROM flights")
def dep_dates(spark, sf):
    return derived.flights(spark, sf).select(F.to_date("dep").alias("dep_date")).distinct()


@query(f"""WITH {FLIGHTS}, sold AS (SELECT origin, dest, op_company AS company FROM flights UNION ALL SELECT origin, dest, company FROM flights UNION ALL SELECT origin, dest, dup FROM flights WHERE dup IS NOT NULL)
SELECT origin, dest, companies, flights FROM (SELECT origin, dest, string_agg(DISTINCT company, '|' ORDER BY company) AS companies FROM sold GROUP BY ALL) JOIN (SELECT origin, dest, string_agg(DISTINCT op_company || '_' || number, '|' ORDER BY op_company || '_' || number) AS flights FROM flights GROUP BY ALL) USING (origin, dest)""")
def route_aggregate(spark, sf):
    r = schedule.routes(derived.flights(spark, sf))
    return r.select("origin", "dest", F.array_join("companies", "|").alias("companies"), F.array_join("flights", "|").alias("flights"))


@query(f"WITH {FLIGHTS}, k AS (SELECT *, row_number() OVER (PARTITION BY company, number, origin, dest, CAST(dep AS DATE) ORDER BY dep DESC, arr DESC) AS rn, count(*) OVER (PARTITION BY company, number, origin, dest, CAST(dep AS DATE)) AS n FROM flights) SELECT company, number, origin, dest, CAST(dep AS DATE) AS date, dep, arr, block, n FROM k WHERE rn = 1")
def snapshot_dedup(spark, sf):
    return schedule.merge_flights(derived.flights(spark, sf))


@query("""WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, 1 + o_orderkey % 127 AS mask, 1 + o_orderkey % 2 AS freq FROM orders), d AS (SELECT *, unnest(range(28)) AS i FROM p)
SELECT o_orderkey, CAST(s + CAST(i AS INT) AS DATE) AS date FROM d WHERE (mask >> CAST((isodow(s + CAST(i AS INT)) - 1) AS INT)) & 1 = 1 AND (i // 7) % freq = 0""")
def calendar_expand(spark, sf):
    return schedule.operating_dates(derived.plans(spark, sf)).select("o_orderkey", "date")


@query(f"WITH {AIRPORTS}, {FLIGHTS}, od AS (SELECT DISTINCT origin, dest FROM flights) SELECT origin, dest, round({_distance('a', 'b')}, 3) AS distance FROM od JOIN airports a ON a.code = origin JOIN airports b ON b.code = dest")
def route_distance(spark, sf):
    return network.edges(derived.flights(spark, sf), derived.airports(spark, sf)).select("origin", "dest", F.round("distance", 3).alias("distance"))


@query(f"WITH {AIRPORTS}, {FLIGHTS}, {SIBLINGS}, {PATHS} SELECT a, b, c, d, round(circuity, 6) AS circuity FROM paths WHERE circuity <= 2.5")
def paths_2hop(spark, sf):
    a, f = derived.airports(spark, sf), derived.flights(spark, sf)
    return network.paths_2(network.edges(f, a), network.siblings(a), a).select("a", "b", "c", "d", F.round("circuity", 6).alias("circuity"))


@query(f"WITH {AIRPORTS}, {FLIGHTS}, {SIBLINGS}, {MET} SELECT {', '.join(PAIR)} FROM met")
def connections(spark, sf):
    f = derived.flights(spark, sf)
    return network.connections(f, f, network.siblings(derived.airports(spark, sf))).select(*PAIR)


@query(f"WITH {AIRPORTS}, {FLIGHTS}, {SIBLINGS}, {PATHS}, {MET} SELECT {', '.join(PAIR)}, round(circuity, 6) AS circuity, date_diff('minute', dep, arr2) AS travel, date_diff('minute', arr, dep2) AS transfer, block + block2 AS flown FROM met JOIN paths ON a = origin AND b = dest AND c = origin2 AND d = dest2 WHERE circuity <= 2.5")
def itin_1stop(spark, sf):
    return network.itineraries_1(derived.flights(spark, sf), derived.airports(spark, sf)).select(*PAIR, "circuity", "travel", "transfer", "flown")


@query(f"WITH {AIRPORTS}, {FLIGHTS}, {SIBLINGS}, {TIMED} SELECT {', '.join(PAIR)}, mct FROM mcts WHERE dep2 >= arr + INTERVAL 180 MINUTE")
def mct_match(spark, sf):
    f, a, book = derived.flights(spark, sf), derived.airports(spark, sf), mct.RuleBook(derived.rules(spark, sf))
    met = network.connections(mct.coded(f, book, a), mct.coded(f, book, a, "2"), network.siblings(a))
    return mct.connection_minutes(met, book, derived.filters(spark, sf), a, keep=PAIR)


@query(f"WITH {AIRPORTS}, {FLIGHTS}, {SIBLINGS}, {TIMED} SELECT {', '.join(PAIR)}, mct FROM timed")
def connections_mct(spark, sf):
    f, a = derived.flights(spark, sf), derived.airports(spark, sf)
    return network.connections_by_rules(f, f, network.siblings(a), derived.rules(spark, sf), derived.filters(spark, sf), a, keep=PAIR)


@query(f"WITH {AIRPORTS}, {FLIGHTS}, {SIBLINGS}, {PATHS}, {TIMED} SELECT {', '.join(PAIR)}, mct, round(circuity, 6) AS circuity, date_diff('minute', dep, arr2) AS travel, date_diff('minute', arr, dep2) AS transfer, block + block2 AS flown FROM timed JOIN paths ON a = origin AND b = dest AND c = origin2 AND d = dest2 WHERE circuity <= 2.5")
def itin_1stop_mct(spark, sf):
    return network.itineraries_1(derived.flights(spark, sf), derived.airports(spark, sf), rules=derived.rules(spark, sf), filters=derived.filters(spark, sf)).select(*PAIR, "mct", "circuity", "travel", "transfer", "flown")


@query(f"WITH {AIRPORTS}, {FLIGHTS} SELECT company, number, origin, dest, dep, arr, date_diff('minute', dep, arr) AS travel, block AS flown FROM flights JOIN airports a ON a.code = origin JOIN airports b ON b.code = dest WHERE a.lat <> b.lat OR a.lon <> b.lon")
def itin_direct(spark, sf):
    return network.itineraries_0(derived.flights(spark, sf), derived.airports(spark, sf)).select("company", "number", "origin", "dest", "dep", "arr", "travel", "flown")


@query("SELECT 'C' || (p_partkey % 7) AS submitter, string_agg(DISTINCT 'C' || (p_size % 7), '|' ORDER BY 'C' || (p_size % 7)) AS partners FROM part GROUP BY 1")
def filter_merge(spark, sf):
    return maintenance.merge_filters(derived.filters(spark, sf)).select("submitter", F.array_join("partners", "|").alias("partners"))


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM events)
SELECT user_id, CAST(b AS BIGINT) AS block, count(*) AS n FROM e GROUP BY 1, 2""")
def block_assembly(spark, sf):
    e = derived.table(spark, sf, "events")
    e = e.join(F.broadcast(e.agg(F.min("event_type").alias("first"))), F.lit(True))  # one row
    return schedule.sessions(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == F.col("first")).groupBy("user_id", "block").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, CAST(a AS INT) AS first, CAST(b AS INT) AS last FROM (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1), range(1, 20) x(a), range(1, 20) y(b) WHERE a <= b AND b <= n")
def leg_spans(spark, sf):
    return schedule.spans(derived.table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT user_id, CAST(count(*) FILTER (WHERE event_id <> p + 1) AS BIGINT) AS breaks FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1")
def serial_continuity(spark, sf):
    return schedule.serial_breaks(derived.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_id")


@query("SELECT 'C' || (s_suppkey % 7) AS airline, CAST(s_suppkey % 9999 AS VARCHAR) AS flight, CAST(1 + s_suppkey % 9 AS INT) AS leg_sequence, CAST((s_suppkey % 24) * 60 + s_suppkey % 60 AS INT) AS dep_minute, DATE '2026-01-01' + CAST(s_suppkey % 28 AS INT) AS from_date FROM supplier")
def fixed_width_parse(spark, sf):
    text = F.expr("rpad(concat('3 ', rpad(concat('C', s_suppkey % 7), 3, ' '), lpad(cast(s_suppkey % 9999 as string), 4, ' '), '01', lpad(cast(1 + s_suppkey % 9 as string), 2, '0'), 'J', upper(date_format(date_add(date'2026-01-01', cast(s_suppkey % 28 as int)), 'ddMMMyy')), '31DEC26', '1234567', ' ', 'AAX', '    ', lpad(cast(s_suppkey % 24 as string), 2, '0'), lpad(cast(s_suppkey % 60 as string), 2, '0')), 200, ' ')")
    legs = fixed_width.legs(derived.table(spark, sf, "supplier").select(text.alias("value")))
    return legs.select("airline", "flight", "leg_sequence", F.col("dep_std_minute").alias("dep_minute"), "from_date")


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN 'C' || (p_partkey % 7) END AS company, CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS VARCHAR) END AS number FROM part")
def designator_chunks(spark, sf):
    p = derived.table(spark, sf, "part").withColumn("x", geo.designator(F.expr("concat(rpad(concat('C', p_partkey % 7), 3, ' '), case when p_size % 4 > 0 then cast(p_size as string) else '' end)")))
    return p.select("p_partkey", F.col("x.company").alias("company"), F.col("x.flight_number").alias("number"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(range(0, 5), lambda i: trim(substr(t, CAST(3 * i + 1 AS INT), 3))), lambda x: x <> ''), '|') AS chunks FROM (SELECT p_partkey, rpad('C' || (p_partkey % 7), 3, ' ') || CASE WHEN p_size % 3 = 0 THEN '   ' ELSE ' D' || (p_size % 10) END || rpad(CAST(p_size AS VARCHAR), 3, ' ') AS t FROM part)")
def text_chunks(spark, sf):
    text = F.expr("concat(rpad(concat('C', p_partkey % 7), 3, ' '), if(p_size % 3 = 0, '   ', concat(' D', p_size % 10)), rpad(cast(p_size as string), 3, ' '))")
    return derived.table(spark, sf, "part").select("p_partkey", F.array_join(geo.chunks(text, 3, 5), "|").alias("chunks"))
