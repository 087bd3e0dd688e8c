"""Queries on legs, segments and merged flights."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import elements
from skylattice.operators import assembly
from skylattice.plans.queries import query
from skylattice.sources import derived
from skylattice.sources.tables import dealt

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
CODES = "[50, 10, 125, 109, 503, 720]"


def _lines(spark, sf):
    """Line items as segment records in file order: a code and some data."""
    li = derived.table(spark, sf, "lineitem")
    return li.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("line_no"), "l_linenumber", F.expr("element_at(array(50, 10, 125, 109, 503, 720), cast(l_partkey % 6 + 1 as int))").alias("dei"), F.expr("concat('D', l_suppkey)").alias("data"), "l_returnflag", "l_linestatus")


@query(f"WITH s AS (SELECT l_orderkey, row_number() OVER (ORDER BY {ORDER}) AS line_no, {CODES}[CAST(l_partkey % 6 + 1 AS INT)] AS dei, 'D' || l_suppkey AS data FROM lineitem) SELECT l_orderkey, " + ", ".join(f"arg_min(data, line_no) FILTER (WHERE dei = {d}) AS {n}" for n, d in (("operating", 50), ("duplicates", 10), ("joint", 125), ("meal", 109), ("service", 503))) + " FROM s GROUP BY 1")
def dei_first_match(spark, sf):
    names = {"operating": assembly.OPERATING, "duplicates": assembly.DUPLICATES, "joint": assembly.JOINT, "meal": assembly.MEAL, "service": assembly.SERVICE}
    return _lines(spark, sf).groupBy("l_orderkey").agg(*[assembly.first_data(d).alias(n) for n, d in names.items()])


@query(f"SELECT CASE WHEN dei BETWEEN 713 AND 799 THEN 'traffic' ELSE ['operating', 'duplicates', 'joint', 'meal', 'service', ''][k] END AS kind, count(*) AS n FROM (SELECT CAST(l_partkey % 6 + 1 AS INT) AS k, {CODES}[CAST(l_partkey % 6 + 1 AS INT)] AS dei FROM lineitem) GROUP BY 1")
def dei_decode(spark, sf):
    return _lines(spark, sf).groupBy(assembly.dei_kind(F.col("dei")).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1), spans AS (SELECT l_orderkey, a AS first, b AS last FROM n, range(1, 20) x(a), range(1, 20) y(b) WHERE a <= b AND b <= n),
seg AS (SELECT l_orderkey, chr(CAST(64 + 1 + l_suppkey % 3 AS INT)) AS f, chr(CAST(64 + 1 + l_suppkey % 3 + 1 + l_partkey % 3 AS INT)) AS t FROM lineitem)
SELECT s.l_orderkey, CAST(first AS INT) AS first, CAST(last AS INT) AS last, count(*) AS n FROM spans s JOIN seg g ON g.l_orderkey = s.l_orderkey AND g.f = chr(CAST(64 + first AS INT)) AND g.t = chr(CAST(65 + last AS INT)) GROUP BY ALL""")
def segment_match(spark, sf):
    from skylattice.operators import schedule

    li = derived.table(spark, sf, "lineitem")
    spans = schedule.spans(li, ["l_orderkey"], "l_linenumber").withColumn("origin", F.lit("AAX")).withColumn("dest", F.lit("BBX"))
    seg = li.select("l_orderkey", F.expr("char(64 + 1 + l_suppkey % 3)").alias("board_point_indicator"), F.expr("char(64 + 1 + l_suppkey % 3 + 1 + l_partkey % 3)").alias("off_point_indicator"), F.lit("AAX").alias("board_point"), F.lit("BBX").alias("off_point"), F.lit(50).alias("dei"), F.lit("x").alias("data"), F.lit(1).alias("line_no"))
    return assembly.span_segments(spans, seg, ["l_orderkey"]).groupBy("l_orderkey", "first", "last").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS pos FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS v, min(l_returnflag) AS f FROM s GROUP BY 1),
vals AS (SELECT l_orderkey, pos, 0 AS i, l_returnflag AS x FROM s UNION ALL SELECT l_orderkey, pos, 1, l_linestatus FROM s), own AS (SELECT DISTINCT l_orderkey, pos, x FROM vals),
held AS (SELECT a.l_orderkey, a.i, a.x FROM vals a JOIN g ON g.l_orderkey = a.l_orderkey WHERE a.pos = 1 AND (SELECT count(*) FROM own o WHERE o.l_orderkey = a.l_orderkey AND o.x = a.x) = g.n)
SELECT g.l_orderkey, CASE WHEN v = 1 THEN f END AS flag, coalesce((SELECT string_agg(x, '|' ORDER BY i) FROM held h WHERE h.l_orderkey = g.l_orderkey), '') AS common FROM g""")
def common_values(spark, sf):
    legs = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.array("l_returnflag", "l_linestatus").alias("v"), "l_returnflag"))), lambda x: x)
    x = _lines(spark, sf).groupBy("l_orderkey").agg(legs.alias("legs"))
    lists = F.transform("legs", lambda x: x["v"])
    return x.select("l_orderkey", assembly.common_value(F.transform("legs", lambda x: x["l_returnflag"])).alias("flag"), F.array_join(assembly.common_values(lists), "|").alias("common"))


@query("""WITH p AS (SELECT p_partkey, (p_partkey * 7) % 1440 AS dep, (p_partkey * 11) % 1440 AS arr, ['+0000', '+0530', '-0500', '+0930'][CAST(p_size % 4 + 1 AS INT)] AS doff, ['-0330', '+0100', '+0800', '+0000'][CAST(p_partkey % 4 + 1 AS INT)] AS aoff, [0, 1, -1, 2][CAST(p_size % 4 + 1 AS INT)] AS dv, [1, 0, 2, -1][CAST(p_partkey % 4 + 1 AS INT)] AS av FROM part),
m AS (SELECT *, (CASE WHEN doff[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(doff, 2, 2) AS INT) * 60 + CAST(substr(doff, 4, 2) AS INT)) AS d, (CASE WHEN aoff[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(aoff, 2, 2) AS INT) * 60 + CAST(substr(aoff, 4, 2) AS INT)) AS a FROM p)
SELECT p_partkey, CAST((arr - a + 1440 * (av - dv)) - (dep - d) AS INT) AS block FROM m""")
def block_time(spark, sf):
    from skylattice.functions.geo import day_variation

    pick = lambda values, by: F.expr(f"element_at(array({values}), cast({by} % 4 + 1 as int))")
    days = day_variation(pick("'1', ' ', '2', 'A'", "p_partkey")) - day_variation(pick("'0', '1', 'J', '2'", "p_size"))
    block = assembly.block_minutes(F.expr("cast((p_partkey * 7) % 1440 as int)"), pick("'+0000', '+0530', '-0500', '+0930'", "p_size"), F.expr("cast((p_partkey * 11) % 1440 as int)"), pick("'-0330', '+0100', '+0800', '+0000'", "p_partkey"), days)
    return derived.table(spark, sf, "part").select("p_partkey", block.cast("int").alias("block"))


MERGED = """m AS (SELECT l_orderkey, CAST(l_partkey % 5 AS INT) AS grp, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_shipdate AS dep, l_quantity AS block, 'C' || (l_partkey % 7) AS op, CASE WHEN l_suppkey % 4 > 0 THEN repeat('m', CAST(l_suppkey % 4 AS INT)) || (l_partkey % 3) END AS meal, ['C' || (l_suppkey % 7), 'C' || (l_partkey % 7), 'C' || (l_linenumber % 7)] AS dups FROM lineitem),
f AS (SELECT l_orderkey, grp, arg_min(dep, pos) AS dep, arg_min(block, pos) AS block, arg_min(op, pos) AS op, count(*) AS n FROM m GROUP BY ALL),
t AS (SELECT l_orderkey, grp, meal FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, grp ORDER BY length(meal) DESC, pos) AS rn FROM m WHERE meal IS NOT NULL) WHERE rn = 1),
u AS (SELECT l_orderkey, grp, x, min(pos * 10 + i) AS place FROM (SELECT l_orderkey, grp, pos, unnest(dups) AS x, unnest([0, 1, 2]) AS i FROM m) GROUP BY ALL)"""


def _merged(spark, sf):
    li = derived.table(spark, sf, "lineitem")
    rows = li.select("l_orderkey", F.expr("cast(l_partkey % 5 as int)").alias("grp"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), F.col("l_shipdate").alias("dep"), F.col("l_quantity").alias("block"), F.expr("concat('C', l_partkey % 7)").alias("op"), F.expr("case when l_suppkey % 4 > 0 then concat(repeat('m', cast(l_suppkey % 4 as int)), l_partkey % 3) end").alias("meal"), F.expr("array(concat('C', l_suppkey % 7), concat('C', l_partkey % 7), concat('C', l_linenumber % 7))").alias("dups"))
    # the place in file order as a number
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("pos"))).drop("pos")


@query(f"WITH {MERGED} SELECT f.l_orderkey, f.grp, f.dep, f.block, f.op, t.meal, coalesce((SELECT string_agg(x, '|' ORDER BY place) FROM u WHERE u.l_orderkey = f.l_orderkey AND u.grp = f.grp AND u.x <> f.op), '') AS dups, f.n FROM f LEFT JOIN t ON t.l_orderkey = f.l_orderkey AND t.grp = f.grp")
def codeshare_merge(spark, sf):
    out = assembly.merge_codeshares(_merged(spark, sf), ["l_orderkey", "grp"], ["dep", "block", "op"], ["meal"], ["dups"], "op", "place")
    return out.withColumn("dups", F.array_join("dups", "|"))


@query(f"WITH {MERGED} SELECT DISTINCT m.l_orderkey, m.grp, t.meal FROM m LEFT JOIN t ON t.l_orderkey = m.l_orderkey AND t.grp = m.grp")
def prefer_richer(spark, sf):
    return _merged(spark, sf).groupBy("l_orderkey", "grp").agg(assembly.richer("meal", "place").alias("meal"))


_STOP = "chr(CAST(65 + {0} // 5 AS INT)) || chr(CAST(65 + {0} % 5 AS INT)) || 'X'"


# all chains of a flight, by recursion; the least is what the flight stands for
@query(f"""WITH RECURSIVE orders_ AS (SELECT l_orderkey AS k, max(l_linenumber) AS n, min(l_shipdate) AS d, list(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS gone FROM lineitem GROUP BY 1),
spans AS (SELECT k, d, unnest(range(1, n + 1)) AS a, n, gone FROM orders_), spans2 AS (SELECT k, d, a, unnest(range(a, n + 1)) AS b, gone FROM spans),
fl AS (SELECT k, d::TIMESTAMP + to_minutes(CAST(300 * a + k % 60 AS INT)) AS dep, d::TIMESTAMP + to_minutes(CAST(300 * b + k % 60 + 100 + k % 100 AS INT)) AS arr, {_STOP.format('((3 * k + 7 * a) % 25)')} AS origin, {_STOP.format('((3 * k + 7 * b + 7) % 25)')} AS dest FROM spans2 WHERE a < b OR NOT coalesce(list_contains(gone, a), FALSE)),
chain AS (SELECT f.k, f.dep, f.arr, f.origin, f.dest, [struct_pack(dep := q.dep, arr := q.arr, origin := q.origin, dest := q.dest)] AS c FROM fl f JOIN fl q ON q.k = f.k AND q.origin = f.origin AND q.dep = f.dep AND q.arr <= f.arr AND q.dest <> f.dest
 UNION ALL SELECT h.k, h.dep, h.arr, h.origin, h.dest, list_append(h.c, struct_pack(dep := q.dep, arr := q.arr, origin := q.origin, dest := q.dest)) FROM chain h JOIN fl q ON q.k = h.k AND q.origin = h.c[-1].dest AND q.dep >= h.c[-1].arr AND q.arr <= h.arr WHERE NOT (h.c[-1].dest = h.dest AND h.c[-1].arr = h.arr)),
best AS (SELECT k, dep, arr, origin, dest, min(c) AS c FROM chain WHERE c[-1].dest = dest AND c[-1].arr = arr GROUP BY ALL)
SELECT CAST(fl.k AS VARCHAR) AS number, fl.origin, fl.dest, fl.dep, fl.arr, coalesce(array_to_string(list_transform(c, lambda x: x.origin || '>' || x.dest), '|'), fl.origin || '>' || fl.dest) AS legs FROM fl LEFT JOIN best USING (k, dep, arr, origin, dest)""")
def same_flight_expand(spark, sf):
    x = assembly.same_flight_expand(derived.through_flights(spark, sf))
    return x.select("number", "flight.origin", "flight.dest", "flight.dep", "flight.arr", F.array_join(F.transform("legs", lambda p: F.concat_ws(">", p["origin"], p["dest"])), "|").alias("legs"))


# legs of one file in line order: a block ends where an order does, and after each line that was returned
@query("""WITH l AS (SELECT l_orderkey * 100 + l_linenumber AS line_no, l_orderkey AS k, l_linenumber AS i, max(l_returnflag) = 'R' AS gone FROM lineitem GROUP BY ALL),
n AS (SELECT *, coalesce(lag(k) OVER w = k AND lag(i) OVER w = i - 1 AND NOT lag(gone) OVER w, FALSE) AS goes_on FROM l WINDOW w AS (ORDER BY line_no)),
b AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM n)
SELECT line_no, CAST(block AS BIGINT) AS block, CAST(row_number() OVER (PARTITION BY block ORDER BY line_no) AS INT) AS pos FROM b""")
def schedule_blocks(spark, sf):
    li = derived.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    li = dealt(li, li.count(), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    legs = li.select(F.expr("l_orderkey * 100 + l_linenumber").alias("line_no"), F.lit("XX").alias("airline"), F.col("l_orderkey").cast("string").alias("flight"), F.lit("01").alias("variation"), F.lit("J").alias("service_type"), F.lit(None).cast("string").alias("frequency"), F.col("l_linenumber").cast("int").alias("leg_sequence"), F.expr("concat('S', l_linenumber)").alias("departure_station"), F.expr("if(l_returnflag = 'R', 'END', concat('S', l_linenumber + 1))").alias("arrival_station"))
    return assembly.blocks(legs, []).select("line_no", "block", "pos")


_NAMED = ", ".join(f"({k}, {k}, '{v}')" for k, v in elements.DESCRIPTIONS.items()) + ", " + ", ".join(f"({a}, {b}, '{v}')" for (a, b), v in elements.RANGES.items())


@query(f"SELECT coalesce(what, '{elements.UNKNOWN}') AS what, count(*) AS n, min(code) AS first, max(code) AS last FROM (SELECT lpad(CAST(l_partkey * 7 % 1000 AS VARCHAR), 3, '0') AS code FROM lineitem) LEFT JOIN (VALUES {_NAMED}) v(a, b, what) ON CAST(code AS INT) BETWEEN a AND b GROUP BY 1")
def dei_descriptions(spark, sf):
    x = derived.table(spark, sf, "lineitem").select(F.lpad((F.col("l_partkey") * 7 % 1000).cast("string"), 3, "0").alias("code"))
    return x.groupBy(elements.description(F.col("code")).alias("what")).agg(F.count("*").alias("n"), F.min("code").alias("first"), F.max("code").alias("last"))
