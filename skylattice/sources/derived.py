"""Airports, flights, plans and rules stated over the star tables by arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.maintenance import owned
from skylattice.operators.mct import complete


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(k: str):
    return F.expr(f"concat(char(65 + {k} div 5), char(65 + {k} % 5), 'X')")


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(code("n_nationkey").alias("code"), F.col("r_name").alias("country"), F.expr("cast(n_nationkey div 10 as string)").alias("city"), F.expr("concat('S', n_nationkey % 3)").alias("state"), F.expr("cast(-60 + (37 * n_nationkey) % 120 as double)").alias("latitude"), F.expr("cast(-180 + (73 * n_nationkey) % 360 as double)").alias("longitude"))


def flights(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Dated flights: one per line item, of those for which ``where`` holds, between two nations."""
    li = table(spark, sf_dir, "lineitem").filter(where).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).filter("s_nationkey <> c_nationkey")
    x = x.withColumn("dep", F.expr("l_shipdate + make_dt_interval(0, 0, cast((37 * l_orderkey + 101 * l_linenumber) % 1440 as int))")).withColumn("block", F.expr("cast(60 + (13 * l_partkey) % 600 as int)"))
    return x.select(F.expr("concat('C', l_partkey % 7)").alias("company"), F.expr("cast(l_partkey % 97 as string)").alias("number"), code("s_nationkey").alias("origin"), code("c_nationkey").alias("dest"), "dep", F.expr("dep + make_dt_interval(0, 0, block)").alias("arr"), "block",
                    F.expr("concat('C', if(l_suppkey % 5 = 0, l_partkey + 2, l_partkey) % 7)").alias("op_company"), F.expr("cast(l_partkey % 97 as string)").alias("op_number"),
                    F.expr("if(l_linenumber % 4 = 0, array(concat('C', (l_partkey + 1) % 7)), cast(array() as array<string>))").alias("duplicates"), F.expr("concat('T', l_partkey % 3)").alias("departure_terminal"), F.expr("concat('T', l_suppkey % 3)").alias("arrival_terminal"))


def through_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights of designators with as many legs as an order has lines: every span of two legs or more, and the legs that were not returned."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.min("l_shipdate").alias("day"), F.collect_set(F.expr("case when l_returnflag = 'R' then l_linenumber end")).alias("gone"))
    x = o.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("a")).select("*", F.explode(F.sequence(F.col("a"), F.col("n"))).alias("b")).filter("a < b or not array_contains(gone, a)")
    x = x.withColumn("o", F.expr("(3 * l_orderkey + 7 * a) % 25")).withColumn("d", F.expr("(3 * l_orderkey + 7 * b + 7) % 25"))
    at = lambda m: F.expr(f"cast(day as timestamp_ntz) + make_dt_interval(0, 0, cast({m} as int))")
    return x.select(F.lit("O").alias("company"), F.col("l_orderkey").cast("string").alias("number"), code("o").alias("origin"), code("d").alias("dest"), at("300 * a + l_orderkey % 60").alias("dep"), at("300 * b + l_orderkey % 60 + 100 + l_orderkey % 100").alias("arr"))


def zones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(airports with ``zone``, transitions): a zone per nation, from 12 hours west to 12 east; every second has summer time."""
    n = table(spark, sf_dir, "nation")
    own = airports(spark, sf_dir).join(n.select(code("n_nationkey").alias("code"), F.expr("concat('Z', n_nationkey)").alias("zone")), "code")
    years = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y")).distinct()
    base = n.select(F.expr("concat('Z', n_nationkey)").alias("zone"), F.expr("cast((n_nationkey % 25 - 12) * 60 as int)").alias("m"), F.col("n_nationkey").alias("k"))
    winter = base.select("zone", F.expr("timestamp_ntz'1900-01-01 00:00:00'").alias("from_utc"), F.col("m").alias("minutes"))
    summer = base.filter("k % 2 = 0").join(F.broadcast(years), F.lit(True))  # dimensions
    for month, day, more in ((4, 1, 60), (10, 25, 0)):
        winter = winter.unionByName(summer.select("zone", F.expr(f"cast(make_date(y, {month}, {day}) as timestamp_ntz) + make_dt_interval(0, 1)").alias("from_utc"), (F.col("m") + more).cast("int").alias("minutes")))
    return own, winter


def dated_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans on their dates: local minutes, offsets as texts and day variations of line items."""
    li = table(spark, sf_dir, "lineitem")
    offset = lambda k: f"concat(if(({k}) % 25 < 12, '-', '+'), lpad(cast(abs(({k}) % 25 - 12) as string), 2, '0'), if(({k}) % 2 = 0, '30', '00'))"
    day = lambda k: F.expr(f"element_at(array(' ', '0', '1', '2', 'A', 'J'), cast(({k}) % 6 + 1 as int))")
    return li.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"), F.expr("cast((37 * l_orderkey + 101 * l_linenumber) % 1440 as int)").alias("dep_minute"), F.expr("cast((17 * l_partkey + l_suppkey) % 1440 as int)").alias("arr_minute"), F.expr(offset("l_partkey")).alias("departure_offset"), F.expr(offset("l_suppkey")).alias("arrival_offset"), day("l_partkey").alias("departure_day"), day("l_orderkey").alias("arrival_day"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("start_date"), F.expr("date_add(to_date(o_orderdate), 27)").alias("end_date"), F.expr("array_join(transform(filter(sequence(0, 6), i -> (1 + o_orderkey % 127) & shiftleft(1L, i) <> 0), i -> cast(i + 1 as string)), '')").alias("days"), F.expr("cast(1 + o_orderkey % 2 as int)").alias("frequency"))


#: Rule fields by the residue of the part number that sets them, and their text.
RULE_FIELDS = {
    "arrival_station": (3, "concat(char(65 + (k % 25) div 5), char(65 + (k % 25) % 5), 'X')"), "departure_station": (9, "concat(char(65 + (k % 25) div 5), char(65 + (k % 25) % 5), 'X')"),
    "arrival_carrier": (5, "concat('C', k % 7)"), "departure_carrier": (7, "concat('C', z % 7)"), "arrival_operating": (19, "concat('C', (k + 1) % 7)"),
    "arrival_from": (11, "cast(z as string)"), "arrival_to": (11, "cast(z + 40 as string)"), "departure_from": (23, "cast(z as string)"), "departure_to": (23, "cast(z + 60 as string)"),
    "arrival_terminal": (29, "concat('T', k % 3)"), "departure_terminal": (31, "concat('T', z % 3)"), "previous_station": (41, "concat(char(65 + (z % 25) div 5), char(65 + (z % 25) % 5), 'X')"),
    "previous_state": (37, "concat('S', k % 3)"), "next_state": (43, "concat('S', z % 3)"), "effective_from": (47, "'01JAN95'"), "effective_to": (53, "'31dec96'"),
    "arrival_aircraft_type": (59, "'320'"), "suppression_region": (61, "'EUR'"), "next_region": (67, "'SCH'"),
}


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection-time rules, one per part and owner: each airport whose station it names, nobody if none. A null field fits all."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    fields = [F.expr(f"case when k % {n} = 0 then {value} end").alias(name) for name, (n, value) in RULE_FIELDS.items()]
    r = p.select(F.col("k").alias("rule_pos"), F.expr("element_at(array('DD', 'DI', 'ID', 'II'), cast(k % 4 + 1 as int))").alias("status"), *fields, F.expr("k % 17 = 0").alias("arrival_codeshare"), F.expr("k % 29 = 1").alias("needs_filter"), F.expr("k % 13 = 0").alias("suppression"), F.expr("case when k % 71 <> 0 then format_string('%02d%02d', (30 + 5 * (z % 40)) div 60, (30 + 5 * (z % 40)) % 60) end").alias("time"))
    return owned(complete(r))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr("concat('C', p_partkey % 7)").alias("submitter"), F.expr("concat('C', p_size % 7)").alias("partner"))
