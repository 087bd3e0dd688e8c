"""Plans from legs and their segment records: chains, spans, what a segment says of a span, and merged dated flights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.geo import day_variation, designator
from skylattice.operators import lines
from skylattice.sources.tables import dealt, stored

#: Fields that two legs of one flight agree in.
SAME_FLIGHT = ["airline", "flight", "variation", "service_type", "frequency"]
#: The data element codes that change a plan.
OPERATING, DUPLICATES, JOINT, MEAL, SERVICE, TICKETING = 50, 10, 125, 109, 503, 505

#: Flights of a run that are looked through one by one.
SHORT_RUN = 32


def continues(w) -> Column:
    """Whether a leg goes on with the flight of the leg before it in ``w``."""
    same = [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in SAME_FLIGHT]
    out = F.lag("arrival_station").over(w).eqNullSafe(F.col("departure_station")) & (F.col("leg_sequence") == F.lag("leg_sequence").over(w) + 1)
    for c in same:
        out &= c
    return F.coalesce(out, F.lit(False))


def blocks(legs: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Legs with ``block``, which rises where a leg does not continue the one before it, and ``pos`` in the block from 1.

    ``keys`` are the file, or the part of it between two hard borders: a block never crosses them.
    """
    legs = stored(legs)  # read four times
    rows = legs.count()
    x = lines.previous(legs, keys, order, [*SAME_FLIGHT, "arrival_station", "leg_sequence"], "_before", rows)
    on = F.col("_before.arrival_station").eqNullSafe(F.col("departure_station")) & (F.col("leg_sequence") == F.col("_before.leg_sequence") + 1)
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("_before." + c)) for c in SAME_FLIGHT], on & F.col("_before").isNotNull())
    x = x.withColumn("_new", (~F.coalesce(on, F.lit(False))).cast("int")).drop("_before")
    x = dealt(lines.running(x, keys, order, "_new", "block", rows=rows), rows, *keys, "block")
    return x.withColumn("pos", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(order))).drop("_new")


def broken(blocked: DataFrame, keys: list[str]) -> DataFrame:
    """Legs after the first of a block that do not continue the leg before: none in what ``blocks`` gives."""
    w = Window.partitionBy(*keys, "block").orderBy("pos")
    return blocked.withColumn("_ok", continues(w)).filter("pos > 1 and not _ok").drop("_ok")


def attached(segments: DataFrame, legs: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Segment records with ``leg_line``, the line of the leg above them; null for orphans, which are errors."""
    both = legs.select(*keys, order, F.col(order).alias("leg_line"), F.lit(None).cast("long").alias("_s")).unionByName(segments.select(*keys, order, F.lit(None).cast("long").alias("leg_line"), F.col(order).cast("long").alias("_s")))
    # line numbers rise: the last leg above is the one with the largest
    found = lines.running(both.withColumnRenamed("leg_line", "_leg"), keys, order, "_leg", "leg_line", "max").filter("_s is not null").drop("_s", "_leg")
    return segments.join(found, [*keys, order])


def plans(blocked: DataFrame, keys: list[str]) -> DataFrame:
    """One plan per contiguous run of a block's legs: (keys, block, first, last, ...).

    Origin, departure, validity, days and frequency are those of the first leg, destination and arrival of the last;
    ``day_offset`` is the last arrival's day variation less the first departure's, ``block_minutes`` the time between.
    Work per block is the square of its legs, of which a flight has few.
    """
    fields = ["departure_station", "dep_minute", "departure_offset", "from_date", "to_date", "days", "frequency", "departure_day", "arrival_station", "arr_minute", "arrival_offset", "arrival_day"]
    legs = blocked.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("l"))
    x = legs.select(*keys, "block", "l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("first")).select("*", F.explode(F.sequence(F.col("first"), F.size("l"))).alias("last"))
    a, b = F.element_at("l", F.col("first")), F.element_at("l", F.col("last"))
    x = x.select(*keys, "block", "first", "last", a["departure_station"].alias("origin"), b["arrival_station"].alias("dest"), *[a[c].alias(c) for c in fields[1:7]], b["arr_minute"].alias("arr_minute"), b["arrival_offset"].alias("arrival_offset"), (day_variation(b["arrival_day"]) - day_variation(a["departure_day"])).alias("day_offset"))
    return x.withColumn("block_minutes", block_minutes(F.col("dep_minute"), F.col("departure_offset"), F.col("arr_minute"), F.col("arrival_offset"), F.col("day_offset")))


def offset_minutes(text: Column) -> Column:
    """Minutes east of UTC of a +HHMM or -HHMM text; null if it is none."""
    ok = F.coalesce(text.rlike("^[+-][0-9]{4}$"), F.lit(False))
    return F.when(ok, F.when(F.substring(text, 1, 1) == "-", -1).otherwise(1) * (F.substring(text, 2, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int")))


def block_minutes(dep: Column, dep_offset: Column, arr: Column, arr_offset: Column, days: Column) -> Column:
    """Minutes from a departure to an arrival, each a local time with its offset from UTC, ``days`` apart."""
    return (arr - offset_minutes(arr_offset) + 1440 * days) - (dep - offset_minutes(dep_offset))


def letter(n: Column) -> Column:
    """A for 1, B for 2 and so on."""
    return F.char(64 + n)


def span_segments(spans: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segment records of each span (first, last, origin, dest): its letters are those of its first board and last off point."""
    s = segments.select(*keys, "board_point_indicator", "off_point_indicator", "board_point", "off_point", "dei", "data", "line_no")
    x = spans.withColumn("board_point_indicator", letter(F.col("first"))).withColumn("off_point_indicator", letter(F.col("last") + 1)).withColumn("board_point", F.col("origin")).withColumn("off_point", F.col("dest"))
    return x.join(s, [*keys, "board_point_indicator", "off_point_indicator", "board_point", "off_point"]).drop("board_point_indicator", "off_point_indicator", "board_point", "off_point")


def first_data(dei: int) -> Column:
    """The data of the first record with a code in file order, as an aggregate."""
    return F.min_by("data", F.when(F.col("dei") == dei, F.col("line_no")))


def overlay(matched: DataFrame, by: list[str]) -> DataFrame:
    """(by, operating, duplicates, joint, meal, service, ticketing): what the segment records say of each span; null where none does."""
    x = matched.groupBy(*by).agg(*[first_data(d).alias(n) for n, d in (("operating", OPERATING), ("duplicates", DUPLICATES), ("joint", JOINT), ("meal", MEAL), ("service", SERVICE), ("ticketing", TICKETING))])
    parts = lambda c: F.filter(F.transform(F.split(c, "/"), lambda t: F.trim(t)), lambda t: t != "")
    duplicates = F.filter(F.transform(F.split("duplicates", "/"), lambda t: designator(t)), lambda d: d.isNotNull())
    return x.withColumn("operating", designator(F.col("operating"))).withColumn("duplicates", duplicates).withColumn("joint", parts(F.col("joint"))).withColumn("meal", F.nullif(F.trim("meal"), F.lit(""))).withColumn("service", F.nullif(F.trim("service"), F.lit(""))).withColumn("ticketing", F.nullif(F.trim("ticketing"), F.lit("")))


def common_values(lists: Column) -> Column:
    """Values of the first list that all others hold, in its order, repeats kept."""
    return F.filter(F.element_at(lists, 1), lambda x: F.forall(lists, lambda other: F.array_contains(other, x)))


def common_value(values: Column) -> Column:
    """The value that all legs have; null if they differ or one has none."""
    return F.when(F.forall(values, lambda x: x.isNotNull() & (x == F.element_at(values, 1))), F.element_at(values, 1))


def dei_kind(code: Column) -> Column:
    """Group of a data element code: those that change plans by name, the ranges by what they are, others unknown."""
    named = {OPERATING: "operating", DUPLICATES: "duplicates", JOINT: "joint", MEAL: "meal", SERVICE: "service", TICKETING: "ticketing"}
    out = F.when(code.between(713, 799), "traffic").when(code.between(800, 899), "free").when(code.between(900, 999), "private")
    for n, name in named.items():
        out = out.when(code == n, name)
    return out.otherwise("unknown")


def richer(value: str, place: str) -> Column:
    """The longest text in bytes, of equal ones the first, as an aggregate; nulls lose."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(F.octet_length(value), -F.col(place))))


def ordered_distinct(lists: str, place: str) -> Column:
    """All values of the rows' lists in order of first sight, as an aggregate."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place, lists))), lambda x: x[lists])))


def merge_codeshares(rows: DataFrame, key: list[str], scalars: list[str], texts: list[str], lists: list[str], primary: str, place: str) -> DataFrame:
    """One row per ``key``: the first row's ``scalars``, the richest of each of ``texts``, and ``lists`` in order of first sight
    without the value of ``primary``; ``n`` rows were merged. ``place`` is the order of the file."""
    out = rows.groupBy(*key).agg(*[F.min_by(c, place).alias(c) for c in scalars], *[richer(c, place).alias(c) for c in texts], *[ordered_distinct(c, place).alias(c) for c in lists], F.count("*").alias("n"))
    for c in lists:
        out = out.withColumn(c, F.filter(c, lambda x: ~x.eqNullSafe(F.col(primary))))
    return out


def _before(times: Column, at: Column, also: bool) -> Column:
    """How many of sorted ``times`` are before ``at``, or with ``also`` at it: halving, as there may be many."""
    ends = F.struct(F.lit(0).alias("a"), F.size(times).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        # unknown times come first
        less = F.coalesce((F.get(times, mid) <= at) if also else (F.get(times, mid) < at), F.lit(True))
        up = F.struct((mid + 1).alias("a"), s["b"].alias("b"))
        return F.when(s["a"] >= s["b"], s).when(less, up).otherwise(F.struct(s["a"].alias("a"), mid.alias("b")))

    # an array of n is halved as often as n has binary digits
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(times)))), ends, halve)["a"]


def same_flight_expand(flights: DataFrame) -> DataFrame:
    """(company, number, flight, legs): each dated flight with the chain of flights of its designator that it stands for, itself if none.

    A through flight is replaced by the chain, least by (dep, arr, origin, dest) flight by flight, of two or more flights of
    its company and number that begins at its departure and ends at its arrival, each leaving where and after the one before
    arrived. Those are the shortest pieces: a piece that is a chain itself has later pieces ahead of it in that order.
    Flights are dealt once, by designator. A *run* of a designator ends where none of its flights is in the air; within its run
    a flight looks only at those that leave while it flies. Of these the least chain from each to the end is found once, the
    last to leave first, so that chains are not enumerated and pairs of flights are not dealt. Flights take time.
    """
    piece = F.struct("dep", "arr", "origin", "dest")
    order = Window.partitionBy("company", "number").orderBy("dep")
    new = F.col("dep") > F.max("arr").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = flights.select("company", "number", "dep", "arr", "origin", "dest").withColumn("_new", F.coalesce(new, F.lit(False)).cast("int"))
    x = x.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # flights of one departure are of one run: the second is no later than the arrival of the first
    runs = x.groupBy("company", "number", "_run").agg(F.array_sort(F.collect_set(piece)).alias("own"))
    runs = runs.withColumn("deps", F.transform("own", lambda q: q["dep"]))
    none = F.slice(F.transform("own", lambda q: F.array(q)), 1, 0)

    def chain(f: Column) -> Column:
        # of a long run only what leaves while the flight flies; a short one is looked through sooner than halved
        between = F.transform(F.array(_before(F.col("deps"), f["dep"], False)), lambda low: F.slice("own", low + 1, F.greatest(_before(F.col("deps"), f["arr"], True) - low, F.lit(0))))
        part = F.when(F.size("own") <= SHORT_RUN, F.col("own")).otherwise(F.get(between, 0))
        inside = lambda q: (q["dep"] >= f["dep"]) & (q["dep"] <= f["arr"]) & (q["arr"] <= f["arr"]) & ~((q["origin"] == f["origin"]) & (q["dest"] == f["dest"]))

        def longer(chains: Column, q: Column) -> Column:
            # each begins with another flight, the least with the one added last: nothing is compared, or worked out twice
            after = F.filter(chains, lambda c: (F.get(c, 0)["origin"] == q["dest"]) & (F.get(c, 0)["dep"] >= q["arr"]))
            ends = (q["dest"] == f["dest"]) & (q["arr"] == f["arr"])
            best = F.when(ends, F.array(q)).otherwise(F.concat(F.array(q), F.try_element_at(after, F.lit(-1))))
            return F.concat(chains, F.array_compact(F.array(best)))

        found = F.aggregate(F.reverse(F.filter(part, inside)), none, longer)
        whole = F.filter(found, lambda c: (F.get(c, 0)["origin"] == f["origin"]) & (F.get(c, 0)["dep"] == f["dep"]))
        return F.when(F.col("company").isNotNull() & F.col("number").isNotNull(), F.try_element_at(whole, F.lit(-1)))

    told = runs.select("company", "number", F.explode(F.transform("own", lambda f: F.struct(f.alias("flight"), F.coalesce(chain(f), F.array(f)).alias("legs")))).alias("t"))
    return told.select("company", "number", "t.flight", "t.legs")
