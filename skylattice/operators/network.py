"""Route graph and itineraries: sibling airports, short paths with low circuity, connections, connection times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import city_key, haversine
from skylattice.operators import mct
from skylattice.sources.tables import stored

CIRCUITY = 2.5
WINDOW_MINUTES = 12 * 60
DEFAULT_MCT = mct.DEFAULT_MCT
#: Width of the time buckets of the connection join.
BUCKET_HOURS = 6


def siblings(airports: DataFrame) -> DataFrame:
    """(code, sibling): each airport with itself and those of its city. One row per pair: airports are a dimension."""
    a = airports.select("code", city_key(F.col("country"), F.col("city")).alias("city"))
    b = a.select(F.col("code").alias("sibling"), "city")
    return a.join(b, "city").select("code", "sibling").union(a.select("code", F.col("code").alias("sibling"))).distinct()


def edges(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """(origin, dest, distance) of all routes whose airports are known."""
    a = airports.select(F.col("code").alias("origin"), F.col("latitude").alias("la"), F.col("longitude").alias("lo"), city_key(F.col("country"), F.col("city")).alias("origin_city"))
    b = airports.select(F.col("code").alias("dest"), F.col("latitude").alias("lb"), F.col("longitude").alias("lp"), city_key(F.col("country"), F.col("city")).alias("dest_city"))
    od = flights.select("origin", "dest").distinct()
    return od.join(a, "origin").join(b, "dest").select("origin", "dest", "origin_city", "dest_city", "la", "lo", "lb", "lp", haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")).alias("distance"))


def paths_2(routes: DataFrame, pairs: DataFrame, airports: DataFrame, limit: float = CIRCUITY) -> DataFrame:
    """Simple two-edge paths (a, b, c, d): edge a-b, ground transfer to a sibling c or none, edge c-d; circuity under the limit."""
    one = routes.select(F.col("origin").alias("a"), F.col("dest").alias("b"), F.col("origin_city").alias("ca"), F.col("dest_city").alias("cb"), F.col("la").alias("la1"), F.col("lo").alias("lo1"), F.col("lb").alias("lb1"), F.col("lp").alias("lp1"), F.col("distance").alias("d1"))
    two = routes.select(F.col("origin").alias("c"), F.col("dest").alias("d"), F.col("dest_city").alias("cd"), F.col("la").alias("la2"), F.col("lo").alias("lo2"), F.col("lb").alias("lb2"), F.col("lp").alias("lp2"), F.col("distance").alias("d2"))
    met = one.join(pairs.select(F.col("code").alias("b"), F.col("sibling").alias("c")), "b").join(two, "c")
    met = met.filter("d <> b and d <> a and (c = b or c <> a)")
    met = met.filter("cd is null or cd <=> cb or not (cd <=> ca or cd <=> cb)")
    ground = F.when(F.col("b") == F.col("c"), 0.0).otherwise(haversine(F.col("lb1"), F.col("lp1"), F.col("la2"), F.col("lo2")))
    direct = haversine(F.col("la1"), F.col("lo1"), F.col("lb2"), F.col("lp2"))
    met = met.withColumn("direct", direct).withColumn("total", F.col("d1") + F.col("d2") + ground).filter("direct > 1e-9")
    return met.withColumn("circuity", F.col("total") / F.col("direct")).filter(F.col("circuity") <= limit).select("a", "b", "c", "d", "circuity")


#: The two routes of a connection.
ROUTES = ["origin", "dest", "origin2", "dest2"]


def connections(first: DataFrame, second: DataFrame, pairs: DataFrame, minimum: int = DEFAULT_MCT, window: int = WINDOW_MINUTES, only: DataFrame | None = None) -> DataFrame:
    """Flights of ``first`` with those of ``second`` that leave a sibling of the arrival airport in time.

    A range join by buckets of BUCKET_HOURS: an arrival is in that of its first possible departure, a departure in the few whose
    arrivals it may suit, so that a task's share of a busy hub is some hours' flights, and of ``first``, which may be
    chains of many flights, no row is dealt twice. Columns of the second flight carry the suffix ``2``. With ``only``
    (ROUTES) just connections of these two routes. Airports are a dimension: flights are not dealt by their few names.
    """
    late = lambda c, m: F.expr(f"{c} + make_dt_interval(0, 0, {m})")
    bucket = lambda c: F.floor(F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / BUCKET_HOURS)
    a = first.join(F.broadcast(pairs.select(F.col("code").alias("dest"), F.col("sibling").alias("hub"))), "dest")
    # both ends of the window are worked out once per flight, not per pair
    a = a.withColumn("_low", late("arr", minimum)).withColumn("_high", late("arr", window))
    a = a.withColumn("bucket", bucket(F.col("_low")))
    b = second.select(*[F.col(c).alias(c + "2") for c in second.columns]).withColumn("hub", F.col("origin2"))
    b = b.withColumn("bucket", F.explode(F.sequence(bucket(late("dep2", min(0, minimum - window))), bucket(F.col("dep2")))))
    met = a.join(b, ["hub", "bucket"]).filter((F.col("dep2") >= F.col("_low")) & (F.col("dep2") <= F.col("_high")) & ((F.col("company") != F.col("company2")) | (F.col("number") != F.col("number2"))))
    met = met.drop("bucket", "hub", "_low", "_high")
    return met if only is None else met.join(only.select(*ROUTES).distinct(), ROUTES, "left_semi")


def connections_by_rules(first: DataFrame, second: DataFrame, pairs: DataFrame, rules: DataFrame | mct.RuleBook, filters: DataFrame, airports: DataFrame, default: int = DEFAULT_MCT, window: int = WINDOW_MINUTES, keep: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """Connections that leave no sooner than their own minimum ``mct`` after the arrival, and within the window; columns ``keep``, or all.

    Those that ``only`` leaves out are not looked up. What rules ask of a flight is coded once per flight (``mct.coded``).
    """
    book = rules if isinstance(rules, mct.RuleBook) else mct.RuleBook(rules)
    first, second = mct.coded(first, book, airports), mct.coded(second, book, airports, "2")
    met = connections(first, second, pairs, default if book.least is None else min(book.least, default), window, only)
    day = F.col("dep_date2") if "dep_date2" in met.columns else None  # the local one, where flights have it
    kept = keep or [c for c in met.columns if c not in ("_codes", "_codes2")]
    told = mct.connection_minutes(met, book, filters, airports, default, day, list(dict.fromkeys([*kept, "arr", "dep2"])))
    return told.filter("dep2 >= arr + make_dt_interval(0, 0, mct)").select(*kept, "mct")


def itineraries_0(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Itineraries of one flight between two known airports, with their measures in minutes."""
    known = edges(flights, airports).filter("distance > 1e-9").select("origin", "dest")
    return flights.join(known, ["origin", "dest"]).withColumn("travel", F.expr("timestampdiff(MINUTE, dep, arr)")).withColumn("flown", F.col("block"))


def itineraries_1(flights: DataFrame, airports: DataFrame, minimum: int = DEFAULT_MCT, rules: DataFrame | None = None, filters: DataFrame | None = None) -> DataFrame:
    """Itineraries of two flights along simple low-circuity paths, with their measures in minutes.

    With ``rules`` each connection keeps its own minimum, and ``minimum`` where no rule fits.
    """
    pairs = siblings(airports)
    path = paths_2(edges(flights, airports), pairs, airports).select(F.col("a").alias("origin"), F.col("b").alias("dest"), F.col("c").alias("origin2"), F.col("d").alias("dest2"), F.round("circuity", 6).alias("circuity"))
    path = stored(path)  # a dimension, read thrice: once its size is known, connections are not dealt by routes to meet it
    # flights that no path begins or ends with go before they are joined in time
    first = flights.join(path.select("origin", "dest").distinct(), ["origin", "dest"], "left_semi")
    second = flights.join(path.select(F.col("origin2").alias("origin"), F.col("dest2").alias("dest")).distinct(), ["origin", "dest"], "left_semi")
    met = connections(first, second, pairs, minimum) if rules is None else connections_by_rules(first, second, pairs, rules, filters, airports, minimum, keep=[c + s for s in ("", "2") for c in ("company", "number", "op_company", "origin", "dest", "dep", "arr", "block")], only=path)
    met = met.join(path, ROUTES)
    return met.withColumn("travel", F.expr("timestampdiff(MINUTE, dep, arr2)")).withColumn("transfer", F.expr("timestampdiff(MINUTE, arr, dep2)")).withColumn("flown", F.col("block") + F.col("block2"))
