"""Connection times: rules with many optional fields, of which the most specific one that fits a connection counts.

A rule's fields speak of the arriving flight, of the departing flight, or of both. What can be told from the rules alone is
told once by Spark: which can fit at all, their rank, and which a suppression takes away. The rest, per connection, is a lookup
in bitmaps of the rules (``rule_index``), a dimension that is broadcast in pieces of bounded size, as many in a pass as a task
may hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import clock_minutes, effective_date, is_codeshare, leg_status
from skylattice.operators import rule_index
from skylattice.sources.tables import stored

DEFAULT_MCT = 180
#: Fields of a rule that speak of the arriving flight.
ARRIVAL = ["arrival_station", "arrival_carrier", "arrival_codeshare", "arrival_operating", "arrival_terminal", "previous_station", "previous_country", "previous_state", "arrival_from", "arrival_to"]
#: Fields of a rule that speak of the departing flight.
DEPARTURE = ["departure_station", "departure_carrier", "departure_codeshare", "departure_operating", "departure_terminal", "next_station", "next_country", "next_state", "departure_from", "departure_to"]
#: Fields without a match in the schedule: a rule that sets one never fits.
AIRCRAFT = ["arrival_aircraft_type", "arrival_aircraft_body", "departure_aircraft_type", "departure_aircraft_body"]
REGION = ["previous_region", "next_region"]
SUPPRESSED_PLACE = ["suppression_region", "suppression_country", "suppression_state"]
#: What two rules of one scope have in common: all but the time and the suppression's own fields.
SCOPE = ["status", "needs_filter", *ARRIVAL, *DEPARTURE, *AIRCRAFT, *REGION, "effective_from", "effective_to"]
DESIGNATOR = ["company", "number", "op_company", "op_number", "duplicates"]
FLAGS = ("needs_filter", "arrival_codeshare", "departure_codeshare")
#: The groups of fields by rising rank.
GROUPS = {
    1: ["arrival_station", "departure_station"],
    2: AIRCRAFT,
    3: ["arrival_terminal", "departure_terminal"],
    4: ["arrival_from", "arrival_to", "departure_from", "departure_to"],
    5: ["arrival_carrier", "departure_carrier", "arrival_codeshare", "departure_codeshare", "arrival_operating", "departure_operating", "needs_filter"],
    6: ["previous_station", "next_station"],
    7: ["previous_country", "next_country", "previous_state", "next_state"],
    8: REGION,
}
#: Rules that are brought to the driver at a time.
RULES_AT_ONCE = 1 << 16
#: Bytes of bitmaps that connections are looked up in at a time; more make several passes over them.
PASS_BYTES = 2 * rule_index.INDEX_BYTES


def given(field: str) -> str:
    """1 if a rule sets the field: not null, or true for a flag. As SQL: a rank has a hundred of these."""
    return f"int(coalesce({field}, false))" if field in FLAGS else f"int({field} is not null)"


def specificity() -> Column:
    """(highest group, groups, fields, stations) that a rule sets; the larger wins, field by field."""
    group = {n: f"greatest({', '.join(map(given, fields))})" for n, fields in GROUPS.items()}
    counted = [f for f in SCOPE if f != "status"]
    return F.expr(
        f"named_struct('highest', greatest({', '.join(f'{n} * {g}' for n, g in group.items())}), 'groups', {' + '.join(group.values())}, "
        f"'fields', {' + '.join(map(given, counted))}, 'stations', {given('arrival_station')} + {given('departure_station')})"
    )


def prepared(rules: DataFrame) -> DataFrame:
    """Rules that can fit at all, with minutes (null if the time is none), ``spec`` and dates."""
    r = rules.filter(" and ".join(f"{c} is null" for c in [*AIRCRAFT, *REGION, *SUPPRESSED_PLACE]))
    for flag in FLAGS:
        r = r.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    r = r.withColumn("minutes", clock_minutes(F.col("time"))).withColumn("spec", specificity())
    # dates that do not parse fit nothing
    for name in ("effective_from", "effective_to"):
        r = r.withColumn("_" + name, effective_date(F.col(name))).filter(f"{name} is null or _{name} is not null")
    return r


def usable(rules: DataFrame) -> DataFrame:
    """Rules with a time that no suppression always takes away, with what an index needs of them.

    A suppression takes away the rules of its scope wherever both fit. As a scope names its stations, a suppression that such a
    station or nobody owns fits with every rule of its scope; one of another airport, of ``gone_at``, only where that airport
    is one of the connection's.
    """
    r = prepared(rules).withColumn("_scope", F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in SCOPE])))
    always = F.col("owner").isNull() | F.coalesce(F.col("owner") == F.col("arrival_station"), F.lit(False)) | F.coalesce(F.col("owner") == F.col("departure_station"), F.lit(False))
    gone = r.filter("suppression").groupBy("_scope").agg(F.max(always).alias("_always"), F.collect_set(F.when(~always, F.col("owner"))).alias("gone_at"))
    day = lambda c: F.date_diff(F.col(c), F.lit("1970-01-01").cast("date"))
    r = r.filter(~F.col("suppression") & F.col("minutes").isNotNull() & F.col("status").isin(*rule_index.STATUSES)).join(gone, "_scope", "left").filter("_always is null or not _always")
    for side in ("arrival", "departure"):
        low, high = F.col(side + "_from"), F.col(side + "_to")
        r = r.withColumn(side + "_low", low.try_cast("long")).withColumn(side + "_high", high.try_cast("long"))
        # a range that is no pair of numbers holds none
        r = r.filter(low.isNull() | high.isNull() | (F.col(side + "_low").isNotNull() & F.col(side + "_high").isNotNull()))
        r = r.withColumn(side + "_low", F.when(high.isNotNull(), F.col(side + "_low"))).withColumn(side + "_high", F.when(low.isNotNull(), F.col(side + "_high")))
    rank = F.lit(1 << 16) - (((F.col("spec.highest") * 16 + F.col("spec.groups")) * 64 + F.col("spec.fields")) * 4 + F.col("spec.stations"))
    texts = ["owner", "status", *[f for f, _ in rule_index.EQUAL], *[f"{s}_{f}" for s in ("arrival", "departure") for f in ("carrier", "operating")]]
    return r.select(
        F.col("rule_pos").cast("long").alias("rule_pos"), rank.cast("long").alias("rank"), F.col("minutes").cast("long").alias("minutes"), "needs_filter", "arrival_codeshare", "departure_codeshare",
        *[F.col(c).cast("string").alias(c) for c in texts], *[f"{s}_{e}" for s in ("arrival", "departure") for e in ("low", "high")],
        day("_effective_from").cast("long").alias("day_from"), day("_effective_to").cast("long").alias("day_to"), F.coalesce("gone_at", F.array().cast("array<string>")).alias("gone_at"),
    )


def rule_tables(rules: DataFrame) -> Iterator[pa.Table]:
    """The usable rules in pieces of about RULES_AT_ONCE: a dimension, but no piece grows with it."""
    r, pieces = usable(rules), -(-rules.count() // RULES_AT_ONCE)
    if pieces > 1:  # read once per piece
        r = stored(r)
    for i in range(pieces):
        yield r.filter(F.pmod(F.xxhash64("owner", "rule_pos"), F.lit(pieces)) == i).toArrow()


class RuleBook:
    """Rules made ready for lookups, once for as many joins as one likes: broadcast indexes and the fewest minutes of any rule."""

    def __init__(self, rules: DataFrame):
        spark = rules.sparkSession
        self.least, self.indexes, self.passes, room, texts = None, [], [], 0, pa.array([], pa.string())
        for table in rule_tables(rules):
            texts = rule_index.every_text(table, texts)
            for index in rule_index.indexes(table):
                self.indexes.append(spark.sparkContext.broadcast(index))  # each bounded: rule_index.INDEX_BYTES
                room -= index.nbytes()
                if room < 0:
                    self.passes.append([])
                    room = PASS_BYTES - index.nbytes()
                self.passes[-1].append(self.indexes[-1])
            self.least = min([x for x in (self.least, pc.min(table["minutes"]).as_py()) if x is not None], default=None)
        # every value that some rule names: what flights are coded by
        self.names = spark.sparkContext.broadcast(rule_index.Names(texts))


def coded(flights: DataFrame, book: RuleBook, airports: DataFrame, suffix: str = "") -> DataFrame:
    """Adds ``_codes``: what rules ask of an arriving flight, or with the suffix ``2`` of a departing one, as one binary value.

    With both, a lookup reads the two values and none of the flights' texts.
    """
    (at, far), names, columns = (("origin", "dest") if suffix else ("dest", "origin")), book.names, flights.columns
    f = flights
    for end, kept in ((far, ["country", "state"]), (at, ["country"])):
        f = f.join(airports.select(F.col("code").alias(end), *[F.col(c).alias(f"_{c}_{end}") for c in kept]), end, "left")
    told = {"_country": f"_country_{far}", "_state": f"_state_{far}"}
    texts = [x.removesuffix(suffix) if suffix else x for x in rule_index.texts(suffix)]
    shown = [F.col(told.get(x, x)).alias(x + suffix) for x in texts]
    shown += [is_codeshare(*[F.col(x) for x in DESIGNATOR]).alias("_shared" + suffix), F.col("number").try_cast("long").alias("_number" + suffix), F.array_join("duplicates", rule_index.BETWEEN).alias("_lent" + suffix)]
    shown.append((leg_status(F.col(f"_country_{far}"), F.col(f"_country_{at}")) == "I").cast("long").alias("_abroad" + suffix))

    @F.arrow_udf("binary")
    def code(own: pa.Array) -> pa.Array:
        return rule_index.coded({x.name: own.field(x.name) for x in own.type}, names.value, suffix)

    return f.select(*columns, code(F.struct(*shown)).alias("_codes"))


def connection_minutes(met: DataFrame, rules: DataFrame | RuleBook, filters: DataFrame, airports: DataFrame, default: int = DEFAULT_MCT, day: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``mct`` to connections: the minutes of the most specific rule that fits and is in force on the day of departure.

    ``met`` has flights and, with the suffix 2, those that follow. Without a known country at an end, or without a rule, it is
    the default. ``day`` is the date that rules must be in force on, that of ``dep2`` by default. The result has the columns
    ``keep`` of ``met``, all by default; the fewer, the less comes back from the lookup.
    """
    book, kept = rules if isinstance(rules, RuleBook) else RuleBook(rules), keep or met.columns
    if "_codes" in met.columns:
        kept = [x for x in kept if x not in rule_index.CODED]
        c = met
    else:
        c = with_status(met, airports).withColumnRenamed("status", "_status")
    # one partner table, both ways round
    both = filters.select(F.col("submitter").alias("_a"), F.col("partner").alias("_b"))
    # a dimension; stored, so that its size is known before the connections are dealt by carriers
    both = stored(both.union(both.select("_b", "_a")).distinct().withColumn("_partners", F.lit(True)))
    c = c.join(both, (F.col("company") == F.col("_a")) & (F.col("company2") == F.col("_b")), "left").withColumn("_partners", F.coalesce("_partners", F.lit(False)))
    c = c.withColumn("_day", F.date_diff(F.to_date("dep2") if day is None else day, F.lit("1970-01-01").cast("date")).cast("long"))
    if "_codes" in met.columns:
        return _coded_minutes(c.select(*kept, *rule_index.CODED), book, default, kept)
    for s in rule_index.SIDES.values():
        c = c.withColumn("_shared" + s, is_codeshare(*[F.col(x + s) for x in DESIGNATOR])).withColumn("_number" + s, F.col("number" + s).try_cast("long")).withColumn("_lent" + s, F.array_join("duplicates" + s, rule_index.BETWEEN))
    c = c.withColumn("_rank", F.lit(rule_index.NEVER)).withColumn("_pos", F.lit(rule_index.NEVER)).withColumn("mct", F.lit(default))
    found = ["_rank", "_pos", "mct"]
    names = list(dict.fromkeys([*kept, *rule_index.NEEDED]))
    c = c.select(*names, *found)
    for n, several in enumerate(book.passes, 1):
        out = [*names, *found] if n < len(book.passes) else [*kept, "mct"]

        def look_up(batches: Iterator[pa.RecordBatch], several=several, out=out) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
                best = tuple(own[x].to_numpy().astype(np.int64) for x in found)
                for shared in several:
                    best = shared.value.best(own, best)
                told = {x: pa.array(new.astype(kind)) for x, new, kind in zip(found, best, (np.int64, np.int64, np.int32))}
                yield pa.RecordBatch.from_arrays([told.get(x, own.get(x)) for x in out], out)

        c = c.mapInArrow(look_up, c.select(*out).schema)
        if n < len(book.passes):  # the indexes of one pass in a task at a time
            c = stored(c)
    return c.select(*kept, "mct")


def _coded_minutes(c: DataFrame, book: RuleBook, default: int, kept: list[str]) -> DataFrame:
    """The same for ``coded`` flights: only the codes are handed to Python, and only the minutes come back."""
    for n, several in enumerate(book.passes, 1):
        last = n == len(book.passes)
        none = F.struct(F.lit(rule_index.NEVER).alias("rank"), F.lit(rule_index.NEVER).alias("pos"), F.lit(default).alias("mct"))
        found = _look_up(several, book.names, last)(*rule_index.CODED, none if n == 1 else F.col("_found"))
        c = c.select(*kept, *([] if last else rule_index.CODED), found.alias("mct" if last else "_found"))
        if not last:  # the indexes of one pass in a task at a time
            c = stored(c)
    return c if book.passes else c.select(*kept, F.lit(default).alias("mct"))


def _look_up(several: list, names, last: bool):
    """What is best of some indexes and of what was found so far; of the last pass the minutes alone."""

    @F.arrow_udf("int" if last else "struct<rank: bigint, pos: bigint, mct: int>")
    def look_up(codes: pa.Array, codes2: pa.Array, partners: pa.Array, day: pa.Array, found: pa.Array) -> pa.Array:
        best = tuple(found.field(x).to_numpy().astype(np.int64) for x in ("rank", "pos", "mct"))
        batch = dict(zip(rule_index.CODED, (codes, codes2, partners, day)))
        for shared in several:
            shared.value.meet(names.value)
            best = shared.value.best(batch, best)
        out = [pa.array(x.astype(kind)) for x, kind in zip(best, (np.int64, np.int64, np.int32))]
        return out[2] if last else pa.StructArray.from_arrays(out, ["rank", "pos", "mct"])

    # so that Spark does not work it out twice, for a filter and for a column
    return look_up.asNondeterministic()


def with_status(met: DataFrame, airports: DataFrame) -> DataFrame:
    """Adds ``status``: D or I of the first flight, then of the second; null if a country is unknown.

    Also the country and state of the far ends: ``_country``, ``_state``, and those with the suffix 2.
    """
    land = airports.select("code", "country", "state")
    c = met
    for col, name, state in (("origin", "_country", "_state"), ("dest", "_k2", "_s2"), ("origin2", "_k3", "_s3"), ("dest2", "_country2", "_state2")):
        c = c.join(land.select(F.col("code").alias(col), F.col("country").alias(name), F.col("state").alias(state)), col, "left")
    return c.withColumn("status", F.concat(leg_status(F.col("_country"), F.col("_k2")), leg_status(F.col("_k3"), F.col("_country2")))).drop("_k2", "_k3", "_s2", "_s3")


def default_rules(spark, minutes: int = DEFAULT_MCT) -> DataFrame:
    """One global rule per status."""
    rows = [(i, s, f"{minutes // 60:02d}{minutes % 60:02d}") for i, s in enumerate(("DD", "DI", "ID", "II"))]
    return complete(spark.createDataFrame(rows, "rule_pos long, status string, time string"))


def complete(rules: DataFrame) -> DataFrame:
    """``rules`` with every column of a rule; those that it lacks are null, or false for flags."""
    r = rules
    for name in ["owner", *SCOPE, *SUPPRESSED_PLACE, "time"]:
        if name not in r.columns:
            r = r.withColumn(name, F.lit(False) if name in FLAGS else F.lit(None).cast("string"))
    return r if "suppression" in r.columns else r.withColumn("suppression", F.lit(False))
