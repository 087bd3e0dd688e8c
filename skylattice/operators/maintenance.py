"""Upkeep of rules, filters, airports and pairs of interest: whole tables in, whole tables out.

Rules are in long form: ``owner`` (null: nobody) and ``rule_pos``, the place in file order. Two rules have one *scope* if
they agree in all but the time, one *content* if they agree in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skylattice.functions.geo import effective_date, hhmm_minutes
from skylattice.operators import itineraries, mct
from skylattice.sources.tables import stored

CONTENT = [*mct.SCOPE, "suppression", *mct.SUPPRESSED_PLACE, "time"]
#: Places of rules that one task counts, as a power of two.
STRETCH_BITS = 14
#: What replaces what: here the suppression counts, other than in matching.
UPSERT_SCOPE = [c for c in CONTENT if c != "time"]


def same(fields: list[str]) -> Column:
    """A text that is equal exactly if the fields are, nulls included."""
    return F.to_json(F.struct(*[F.coalesce(F.col(f), F.lit(False)).alias(f) if f in (*mct.FLAGS, "suppression") else F.col(f).cast("string").alias(f) for f in fields]), {"ignoreNullFields": "false"})


def named_stations(rules: DataFrame) -> DataFrame:
    """Each rule once per distinct station that it names, as ``target``; rules that name none have the target null."""
    stations = F.array_compact(F.array_distinct(F.array("arrival_station", "departure_station")))
    return rules.withColumn("target", F.explode_outer(stations))


def owned(rules: DataFrame) -> DataFrame:
    """Each rule under every station that it names as ``owner``; a rule that names none has no owner."""
    return named_stations(rules.drop("owner")).withColumnRenamed("target", "owner")


def targets(rules: DataFrame, airports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules under the airports that exist, codes that do not); a rule that names no station is nobody's."""
    named = named_stations(rules.drop("owner")).withColumnRenamed("target", "owner")
    known = airports.select(F.col("code").alias("owner")).distinct()
    held = named.filter("owner is null").unionByName(named.join(known, "owner", "left_semi").select(named.columns))
    return held, named.filter("owner is not null").join(known, "owner", "left_anti").select(F.col("owner").alias("code")).distinct()


def upserted(current: DataFrame, adds: DataFrame) -> DataFrame:
    """``current`` after each of ``adds`` in order: it takes the place of the rule of its owner and scope, or goes to the end.

    ``current`` has one rule per owner and scope, as every upsert leaves it. The last add of a scope is what stays.
    """
    a = mct.complete(adds).withColumn("_scope", same(UPSERT_SCOPE))
    c = mct.complete(current).withColumn("_scope", same(UPSERT_SCOPE))
    fields = ["owner", *CONTENT]
    both = c.select(*fields, "_scope", F.col("rule_pos").alias("pos"), F.lit(0).alias("added")).unionByName(a.select(*fields, "_scope", F.col("rule_pos").alias("pos"), F.lit(1).alias("added")))
    folded = both.groupBy("owner", "_scope").agg(F.max_by(F.struct(*CONTENT), F.struct("added", "pos")).alias("x"), F.min(F.struct("added", "pos")).alias("at"))
    # old places first, then the new in the order of their first add; places are counted per owner, of which nobody has most
    # rules: within stretches of places by a window, before them by a table of one row per stretch
    folded = folded.withColumn("_stretch", F.shiftright(F.col("at.pos").cast("long"), STRETCH_BITS))
    stretches = folded.groupBy("owner", "at.added", "_stretch").agg(F.count("*").alias("_n")).withColumnsRenamed({"owner": "_owner", "added": "_added", "_stretch": "_at"})
    before = Window.partitionBy("_owner").orderBy("_added", "_at").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("_owner", "_added", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    here = F.row_number().over(Window.partitionBy("owner", "at.added", "_stretch").orderBy("at"))
    placed = folded.withColumn("_here", here).join(F.broadcast(stretches), F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("at.added") == F.col("_added")) & (F.col("_stretch") == F.col("_at")))
    return placed.select("owner", (F.col("_here") + F.col("_carry")).cast("long").alias("rule_pos"), "x.*")


def upsert_status(current: DataFrame, adds: DataFrame) -> DataFrame:
    """(owner, rule_pos, status of the upsert) of each add in its order: ``added``, ``replaced`` or ``unchanged``."""
    a = mct.complete(adds).withColumn("_scope", same(UPSERT_SCOPE)).withColumn("_all", same(CONTENT))
    c = mct.complete(current).withColumn("_scope", same(UPSERT_SCOPE)).groupBy("owner", "_scope").agg(F.min_by(same(CONTENT), "rule_pos").alias("_held"))
    c = c.select(F.col("owner").alias("_owner"), F.col("_scope").alias("_s"), "_held")
    met = a.join(c, F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("_scope") == F.col("_s")), "left")
    w = Window.partitionBy("owner", "_scope").orderBy("rule_pos")
    before = F.coalesce(F.lag("_all").over(w), F.col("_held"))
    return met.select("owner", "rule_pos", F.when(before.isNull(), "added").when(before == F.col("_all"), "unchanged").otherwise("replaced").alias("result"))


def without(current: DataFrame, deletes: DataFrame) -> DataFrame:
    """``current`` less the rules that equal one of ``deletes`` of their owner in every field."""
    d = mct.complete(deletes).select(F.col("owner").alias("_owner"), same(CONTENT).alias("_all")).distinct()
    c = mct.complete(current)
    return c.join(d, F.col("owner").eqNullSafe(F.col("_owner")) & (same(CONTENT) == F.col("_all")), "left_anti")


def full_replace(file_rules: DataFrame, airports: DataFrame) -> DataFrame:
    """The rules after a full file: none of those before. Of one owner and scope the last stays, at the first's place."""
    held, _ = targets(file_rules, airports)
    held = mct.complete(held)
    return upserted(held.limit(0), held)


def delta(current: DataFrame, file_rules: DataFrame, airports: DataFrame) -> DataFrame:
    """The rules after an updates file: all its deletes (action D), then its adds (action A) in order."""
    held, _ = targets(file_rules, airports)
    return upserted(without(current, held.filter("action = 'D'")), held.filter("action = 'A'"))


def delta_summary(current: DataFrame, file_rules: DataFrame, airports: DataFrame) -> DataFrame:
    """One row: added, replaced, unchanged, deleted, nobody's rules in the file, and the missing airports in order."""
    held, missing = targets(file_rules, airports)
    gone = held.filter("action = 'D'")
    left = without(current, gone)
    told = upsert_status(left, held.filter("action = 'A'"))
    count = lambda x: F.count_if(F.col("result") == x).alias(x)
    one = told.agg(count("added"), count("replaced"), count("unchanged"))
    deleted = current.agg(F.count("*").alias("_n")).crossJoin(left.agg(F.count("*").alias("_m"))).select((F.col("_n") - F.col("_m")).alias("deleted"))
    lost = missing.agg(F.array_join(F.array_sort(F.collect_list("code")), "|").alias("missing"))
    # single rows side by side
    return one.crossJoin(deleted).crossJoin(file_rules.agg(F.count_if(F.expr("arrival_station is null and departure_station is null")).alias("global_records"))).crossJoin(lost)


def filters_after(current: DataFrame, file_filters: DataFrame, full: bool) -> DataFrame:
    """(submitter, partner) pairs after a file: its own if it is full or has any, else those before."""
    own = file_filters.select("submitter", "partner").distinct()
    if full:
        return own
    any_ = file_filters.select(F.lit(1).alias("_x")).limit(1)
    return own.unionByName(current.select("submitter", "partner").distinct().join(any_, F.lit(True), "left_anti"))


def merge_filters(filters: DataFrame) -> DataFrame:
    """(submitter, partners): sorted distinct partners of each submitting carrier."""
    return filters.groupBy("submitter").agg(F.array_sort(F.collect_set("partner")).alias("partners"))


def normalised(rules: DataFrame, airport: str) -> DataFrame:
    """Rules put to one airport by hand: texts trimmed and in capitals, blanks null, stations its own by default, no filter asked."""
    r = mct.complete(rules)
    for name in CONTENT:
        if name not in (*mct.FLAGS, "suppression"):
            r = r.withColumn(name, F.nullif(F.upper(F.trim(F.col(name))), F.lit("")))
    for name in ("arrival_station", "departure_station"):
        r = r.withColumn(name, F.coalesce(F.col(name), F.lit(airport)))
    return r.withColumn("needs_filter", F.lit(False)).withColumn("owner", F.lit(airport))


def rule_errors() -> Column:
    """The names of all checks that a rule fails, in order; an empty array for a valid rule."""
    bad = lambda field, pattern: F.when(~F.col(field).rlike(pattern), field)
    one = lambda a, b: F.col(a).isNotNull() != F.col(b).isNotNull()
    set_ = lambda f: F.col(f).isNotNull()
    flag = lambda f: F.coalesce(F.col(f), F.lit(False))
    checks = [F.when(~F.coalesce(F.col("status").rlike("^[DI]{2}$"), F.lit(False)), "status"), F.when(set_("time") & hhmm_minutes(F.col("time")).isNull(), "time")]
    checks += [bad(f, "^[A-Za-z0-9]{3}$") for f in ("arrival_station", "departure_station", "previous_station", "next_station", *[f for f in mct.AIRCRAFT if f.endswith("type")], *mct.REGION, "suppression_region")]
    checks += [bad(f, "^[A-Za-z0-9]{2}$") for f in ("arrival_carrier", "arrival_operating", "departure_carrier", "departure_operating", "previous_country", "next_country", "previous_state", "next_state", "suppression_country", "suppression_state")]
    checks += [bad(f, "^[NW]$") for f in mct.AIRCRAFT if f.endswith("body")]
    checks += [bad(f, "^[A-Za-z0-9]{1,2}$") for f in ("arrival_terminal", "departure_terminal")]
    checks += [bad(f, "^[0-9]{4}$") for f in ("arrival_from", "arrival_to", "departure_from", "departure_to")]
    checks += [F.when(set_(f) & effective_date(F.col(f)).isNull(), f) for f in ("effective_from", "effective_to")]
    checks += [F.when(one(f"{s}_from", f"{s}_to"), f"{s} range") for s in ("arrival", "departure")]
    checks += [F.when(set_(f"{s}_state") & ~set_(f"{s}_country"), f"{s} state without country") for s in ("previous", "next")]
    checks += [F.when(set_(f"{s}_aircraft_type") & set_(f"{s}_aircraft_body"), f"{s} type and body") for s in ("arrival", "departure")]
    checks += [F.when(set_(f"{s}_operating") & ~flag(f"{s}_codeshare"), f"{s} operating without codeshare") for s in ("arrival", "departure")]
    checks += [F.when(~flag("suppression") & ~set_("time"), "no time")]
    return F.array_compact(F.array(*checks))


def loaded(flights: DataFrame, airports: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(flights in memory, counters): one per key, the last, between airports that are loaded.

    ``read`` rows came, ``skipped`` name an airport that is not loaded, ``duplicates`` gave way to another of their key, and
    ``loaded`` stay. The counters are observed while the flights are written; nothing is scanned for them.
    """
    known = airports.select("code").distinct()
    seen, kept = Observation("seen"), Observation("kept")
    x = flights.join(known.select(F.col("code").alias("origin"), F.lit(True).alias("_o")), "origin", "left").join(known.select(F.col("code").alias("dest"), F.lit(True).alias("_d")), "dest", "left")
    x = x.withColumn("_in", F.col("_o").isNotNull() & F.col("_d").isNotNull()).observe(seen, F.count("*").alias("read"), F.count_if("_in").alias("held"))
    out = stored(itineraries.latest(x.filter("_in").select(flights.columns)).observe(kept, F.count("*").alias("loaded")))
    read, held, n = seen.get["read"], seen.get["held"], kept.get["loaded"]
    return out, {"read": read, "skipped": read - held, "duplicates": held - n, "loaded": n}


def inserted(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and those of ``rows`` whose key it lacks, each key once: create, or add to the pairs of interest."""
    return current.unionByName(rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti").select(current.columns))


def updated(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of those keys replaced; keys that it lacks are left out."""
    there = rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_semi").select(current.columns)
    return current.join(there.select(*keys), keys, "left_anti").select(current.columns).unionByName(there)


def deleted(current: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(keys_gone.select(*keys).distinct(), keys, "left_anti").select(current.columns)


def looked_up(current: DataFrame, keys_wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the keys asked for; a few keys of one column become a filter that reaches the scan."""
    return current.join(keys_wanted.select(*keys).distinct(), keys, "left_semi").select(current.columns)
