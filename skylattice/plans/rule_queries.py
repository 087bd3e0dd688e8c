"""Queries on the upkeep of connection-time rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions.geo import leg_status
from skylattice.operators import maintenance, mct
from skylattice.plans.queries import AIRPORTS, RULES, query
from skylattice.sources import derived
from skylattice.sources.tables import shared_dir
from skylattice.streaming import rule_updates

FILE = f"""{RULES}, named AS (SELECT rules0.*, ast AS owner FROM rules0 WHERE ast IS NOT NULL UNION ALL SELECT *, dst FROM rules0 WHERE dst IS NOT NULL AND dst IS DISTINCT FROM ast UNION ALL SELECT *, NULL FROM rules0 WHERE ast IS NULL AND dst IS NULL),
known AS (SELECT chr(CAST(65 + n_nationkey // 5 AS INT)) || chr(CAST(65 + n_nationkey % 5 AS INT)) || 'X' AS code FROM nation WHERE n_nationkey < 20),
told AS MATERIALIZED (SELECT coalesce(owner, '') AS owner, rule_pos, coalesce(CAST(minutes AS VARCHAR), '-') AS minutes, concat_ws('/', status, coalesce(ast, '-'), coalesce(dst, '-'), coalesce(ac, '-'), coalesce(dc, '-'), coalesce(aop, '-'), coalesce(af, -1), coalesce(df, -1), coalesce(dt, -1), coalesce(aterm, '-'), coalesce(dterm, '-'), coalesce(pst, '-'), coalesce(pstate, '-'), coalesce(nstate, '-'), coalesce(ef, DATE '1900-01-01'), coalesce(et, DATE '1900-01-01'), air, supreg, reg, acs, nf, off) AS scope FROM named WHERE owner IS NULL OR owner IN (SELECT code FROM known))"""
# of all airports; what mct_targets tells is which are missing
EVERY = FILE.replace(" WHERE n_nationkey < 20", "")
OLD = "(SELECT owner, scope, arg_max(minutes, rule_pos) AS minutes, min(rule_pos) AS place FROM told WHERE rule_pos % 2 = 0 GROUP BY ALL)"


def _airports(spark, sf, where="true"):
    return derived.table(spark, sf, "nation").filter(where).select(derived.code("n_nationkey").alias("code"))


def _file(spark, sf):
    return derived.rules(spark, sf).drop("owner").dropDuplicates(["rule_pos"]).withColumn("action", F.expr("case when rule_pos % 5 = 0 then 'D' else 'A' end"))


def _told(rules):
    minutes = F.coalesce(F.expr("cast(substr(time, 1, 2) as int) * 60 + cast(substr(time, 3, 2) as int)").cast("string"), F.lit("-"))
    return rules.select(F.coalesce("owner", F.lit("")).alias("owner"), "rule_pos", "status", F.coalesce("arrival_station", F.lit("-")).alias("station"), minutes.alias("minutes"))


@query(f"WITH {FILE} SELECT owner, count(*) AS n FROM told GROUP BY 1 UNION ALL SELECT 'missing ' || owner, -1 FROM (SELECT DISTINCT owner FROM named WHERE owner IS NOT NULL AND owner NOT IN (SELECT code FROM known))")
def mct_targets(spark, sf):
    held, missing = maintenance.targets(_file(spark, sf), _airports(spark, sf, "n_nationkey < 20"))
    return held.groupBy(F.coalesce("owner", F.lit("")).alias("owner")).agg(F.count("*").alias("n")).unionByName(missing.select(F.concat(F.lit("missing "), "code").alias("owner"), F.lit(-1).cast("long").alias("n")))


@query(f"WITH {EVERY}, x AS (SELECT owner, scope, arg_max(minutes, rule_pos) AS minutes, min(rule_pos) AS place FROM told GROUP BY ALL) SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY place) AS rule_pos, split_part(scope, '/', 1) AS status, split_part(scope, '/', 2) AS station, minutes FROM x")
def mct_full_replace(spark, sf):
    return _told(maintenance.full_replace(_file(spark, sf), _airports(spark, sf)))


@query(f"""WITH {EVERY}, old AS {OLD}, dels AS (SELECT DISTINCT owner, scope, minutes FROM told WHERE rule_pos % 5 = 0), kept AS (SELECT * FROM old ANTI JOIN dels USING (owner, scope, minutes)),
adds AS (SELECT owner, scope, arg_max(minutes, rule_pos) AS minutes, min(rule_pos) AS place FROM told WHERE rule_pos % 5 <> 0 GROUP BY ALL),
x AS (SELECT k.owner, k.scope, coalesce(a.minutes, k.minutes) AS minutes, 0 AS new, k.place FROM kept k LEFT JOIN adds a USING (owner, scope) UNION ALL SELECT owner, scope, minutes, 1, place FROM adds ANTI JOIN kept USING (owner, scope))
SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY new, place) AS rule_pos, split_part(scope, '/', 1) AS status, split_part(scope, '/', 2) AS station, minutes FROM x""")
def mct_delta(spark, sf):
    a = _airports(spark, sf)
    current = maintenance.full_replace(_file(spark, sf).filter("rule_pos % 2 = 0"), a)
    return _told(maintenance.delta(current, _file(spark, sf), a))


@query(f"""WITH {EVERY}, old AS {OLD}, adds AS (SELECT t.*, lag(t.minutes) OVER (PARTITION BY t.owner, t.scope ORDER BY t.rule_pos) AS before, old.minutes AS held FROM told t LEFT JOIN old ON old.owner = t.owner AND old.scope = t.scope WHERE t.rule_pos % 5 <> 0)
SELECT owner, rule_pos, CASE WHEN coalesce(before, held) IS NULL THEN 'added' WHEN coalesce(before, held) = minutes THEN 'unchanged' ELSE 'replaced' END AS result FROM adds""")
def mct_upsert_status(spark, sf):
    a = _airports(spark, sf)
    current = maintenance.full_replace(_file(spark, sf).filter("rule_pos % 2 = 0"), a)
    held, _ = maintenance.targets(_file(spark, sf).filter("action = 'A'"), a)
    return maintenance.upsert_status(current, held).select(F.coalesce("owner", F.lit("")).alias("owner"), "rule_pos", "result")


@query(f"""WITH {RULES} SELECT rule_pos, concat_ws('|', CASE WHEN af IS NOT NULL THEN 'arrival_from' END, CASE WHEN ato IS NOT NULL THEN 'arrival_to' END, CASE WHEN df IS NOT NULL THEN 'departure_from' END, CASE WHEN dt IS NOT NULL THEN 'departure_to' END,
 CASE WHEN pstate IS NOT NULL THEN 'previous state without country' END, CASE WHEN nstate IS NOT NULL THEN 'next state without country' END, CASE WHEN aop IS NOT NULL AND NOT acs THEN 'arrival operating without codeshare' END, CASE WHEN NOT off AND minutes IS NULL THEN 'no time' END) AS errors FROM rules0""")
def rule_validation(spark, sf):
    return _file(spark, sf).select("rule_pos", F.array_join(maintenance.rule_errors(), "|").alias("errors"))


@query(f"WITH {RULES} SELECT rule_pos, hi, groups, fields, stations FROM rules1")
def mct_specificity(spark, sf):
    r = mct.prepared(_file(spark, sf).withColumn("owner", F.lit(None).cast("string"))).select("rule_pos", "spec.*")
    return r.select("rule_pos", F.col("highest").alias("hi"), "groups", "fields", "stations")


@query(f"WITH {AIRPORTS} SELECT a.code AS origin, b.code AS dest, CASE WHEN a.country = b.country THEN 'D' ELSE 'I' END AS status FROM airports a, airports b")
def leg_statuses(spark, sf):
    a = derived.airports(spark, sf)
    x = a.select(F.col("code").alias("origin"), F.col("country").alias("_a")).join(a.select(F.col("code").alias("dest"), F.col("country").alias("_b")), F.lit(True))  # a dimension with itself
    return x.select("origin", "dest", leg_status(F.col("_a"), F.col("_b")).alias("status"))


@query(f"""WITH {FILE}, old AS {OLD}, dels AS (SELECT DISTINCT owner, scope, minutes FROM told WHERE rule_pos % 5 = 0), kept AS (SELECT * FROM old ANTI JOIN dels USING (owner, scope, minutes)),
adds AS (SELECT t.minutes, coalesce(lag(t.minutes) OVER (PARTITION BY t.owner, t.scope ORDER BY t.rule_pos), kept.minutes) AS held FROM told t LEFT JOIN kept ON kept.owner = t.owner AND kept.scope = t.scope WHERE t.rule_pos % 5 <> 0)
SELECT count(*) FILTER (WHERE held IS NULL) AS added, count(*) FILTER (WHERE held <> minutes) AS replaced, count(*) FILTER (WHERE held = minutes) AS unchanged, (SELECT count(*) FROM old) - (SELECT count(*) FROM kept) AS deleted,
 (SELECT count(*) FROM rules0 WHERE ast IS NULL AND dst IS NULL) AS global_records, (SELECT coalesce(string_agg(DISTINCT owner, '|' ORDER BY owner), '') FROM named WHERE owner IS NOT NULL AND owner NOT IN (SELECT code FROM known)) AS missing FROM adds""")
def mct_summary(spark, sf):
    a = _airports(spark, sf, "n_nationkey < 20")
    current = maintenance.full_replace(_file(spark, sf).filter("rule_pos % 2 = 0"), a)
    return maintenance.delta_summary(current, _file(spark, sf), a)


# three updates files, one after the other: each a third of the rules
_THIRD = "(rule_pos * 3 // (SELECT max(p_partkey) + 1 FROM part))"
_DELTAS = ", ".join(f"""dels{i} AS (SELECT DISTINCT owner, scope, minutes FROM told WHERE rule_pos % 5 = 0 AND {_THIRD} = {i}), kept{i} AS (SELECT * FROM state{i} ANTI JOIN dels{i} USING (owner, scope, minutes)),
adds{i} AS (SELECT owner, scope, arg_max(minutes, rule_pos) AS minutes, min(rule_pos) AS place FROM told WHERE rule_pos % 5 <> 0 AND {_THIRD} = {i} GROUP BY ALL),
x{i} AS (SELECT k.owner, k.scope, coalesce(a.minutes, k.minutes) AS minutes, 0 AS new, k.place FROM kept{i} k LEFT JOIN adds{i} a USING (owner, scope) UNION ALL SELECT owner, scope, minutes, 1, place FROM adds{i} ANTI JOIN kept{i} USING (owner, scope)),
state{i + 1} AS (SELECT owner, scope, minutes, row_number() OVER (PARTITION BY owner ORDER BY new, place) AS place FROM x{i})""" for i in range(3))


@query(f"WITH {EVERY}, state0 AS (SELECT owner, scope, minutes, rule_pos AS place FROM told WHERE FALSE), {_DELTAS} SELECT owner, place AS rule_pos, split_part(scope, '/', 1) AS status, split_part(scope, '/', 2) AS station, minutes FROM state3")
def mct_delta_stream(spark, sf):
    """Three updates read by a stream, a batch each whatever number of files it has; the rules after the last."""
    at, rules = shared_dir(spark), _file(spark, sf)
    last = derived.table(spark, sf, "part").agg(F.max("p_partkey").alias("_last"))
    rules = rules.join(F.broadcast(last), F.lit(True)).withColumn("_third", F.expr("rule_pos * 3 div (_last + 1)")).drop("_last")  # one row
    updates = spark.readStream.schema(rules.drop("_third").schema).parquet(f"{at}/files/*")
    for i in range(3):
        rules.filter(F.col("_third") == i).drop("_third").write.parquet(f"{at}/files/{i}")
        query_ = rule_updates.follow(updates, f"{at}/rules", f"{at}/log", _airports(spark, sf))
        query_.awaitTermination()
    return _told(rule_updates.current(spark, f"{at}/rules", query_))
