"""Fixed-width schedule and connection-time lines as typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.geo import chunks, hhmm_minutes
from skylattice.operators import lines as file_lines

# First and last byte, counted from 1, of each field of the formats.
LEG = {"airline": (3, 5), "flight": (6, 9), "variation": (10, 11), "leg_sequence": (12, 13), "service_type": (14, 14), "from_date": (15, 21), "to_date": (22, 28), "days": (29, 35), "frequency": (36, 36), "departure_station": (37, 39), "passenger_std": (40, 43), "aircraft_std": (44, 47), "departure_offset": (48, 52), "departure_terminal": (53, 54), "arrival_station": (55, 57), "aircraft_sta": (58, 61), "passenger_sta": (62, 65), "arrival_offset": (66, 70), "arrival_terminal": (71, 72), "equipment": (73, 75), "prbd": (76, 95), "prbm": (96, 100), "meal": (101, 110), "joint_operation": (111, 119), "secure_flight": (122, 122), "departure_day": (193, 193), "arrival_day": (194, 194), "serial": (195, 200)}
SEGMENT = {"board_point_indicator": (29, 29), "off_point_indicator": (30, 30), "dei": (31, 33), "board_point": (34, 36), "off_point": (37, 39), "data": (40, 194)}
RULE = {"arrival_station": (2, 4), "time": (5, 8), "status": (9, 10), "departure_station": (11, 13), "arrival_carrier": (14, 15), "arrival_codeshare": (16, 16), "arrival_operating": (17, 18), "departure_carrier": (19, 20), "departure_codeshare": (21, 21), "departure_operating": (22, 23), "arrival_terminal": (32, 33), "departure_terminal": (34, 35), "previous_country": (36, 37), "previous_station": (38, 40), "next_country": (41, 42), "next_station": (43, 45), "effective_from": (72, 78), "effective_to": (79, 85), "suppression": (87, 87), "submitter": (95, 96), "action": (104, 104), "serial": (195, 200)}


def field(line: Column, first: int, last: int) -> Column:
    """Trimmed bytes first..last; null if blank."""
    return F.nullif(F.trim(F.substring(line, first, last - first + 1)), F.lit(""))


def parse(lines: DataFrame, layout: dict[str, tuple[int, int]], record_type: str) -> DataFrame:
    """The fields of all lines of one record type, by byte 1; other columns of ``lines`` stay."""
    rest = [lines[c] for c in lines.columns if c != "value"]
    return lines.filter(F.substring("value", 1, 1) == record_type).select(*rest, *[field(lines["value"], a, b).alias(n) for n, (a, b) in layout.items()])


def legs(lines: DataFrame) -> DataFrame:
    """Type-3 records with dates, minutes and lists of joint-operation carriers; what does not parse is null."""
    raw = parse(lines, LEG, "3")
    for name in ("from_date", "to_date"):
        raw = raw.withColumn(name, F.to_date(F.expr(f"try_to_timestamp(initcap({name}), 'ddMMMyy')")))
    for name in ("aircraft_std", "passenger_sta"):
        raw = raw.withColumn(name.replace("aircraft_", "dep_").replace("passenger_", "arr_") + "_minute", hhmm_minutes(F.col(name)))
    return raw.withColumn("leg_sequence", F.col("leg_sequence").try_cast("int")).withColumn("serial", F.col("serial").try_cast("int")).withColumn("joint_operation", chunks(F.rpad(F.coalesce("joint_operation", F.lit("")), 9, " "), 3, 3))


def segments(lines: DataFrame) -> DataFrame:
    return parse(lines, SEGMENT, "4").withColumn("dei", F.col("dei").try_cast("int"))


def rules(lines: DataFrame) -> DataFrame:
    """Type-2 connection-time records; station ``***`` is any station and asks for a partner filter on departure."""
    raw = parse(lines, RULE, "2").withColumn("needs_filter", F.coalesce(F.col("departure_station") == "***", F.lit(False)))
    for name in ("arrival_station", "departure_station"):
        raw = raw.withColumn(name, F.nullif(F.col(name), F.lit("***")))
    # flags are Y or blank, some N too
    for name in ("arrival_codeshare", "departure_codeshare", "suppression"):
        raw = raw.withColumn(name, F.coalesce(F.col(name) == "Y", F.lit(False)))
    return raw.withColumn("minutes", hhmm_minutes(F.col("time"))).withColumn("serial", F.col("serial").try_cast("int"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): line numbers rise within the file as Spark splits it."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


# The other records of the two formats.
LEG |= {"variation_overflow": (128, 128), "owner": (129, 131), "cockpit_crew": (132, 134), "cabin_crew": (135, 137), "onward_airline": (138, 140), "onward_flight": (141, 144), "onward_layover": (145, 145), "onward_suffix": (146, 146), "disclosure": (149, 149), "restriction": (150, 160), "restriction_overflow": (161, 161), "configuration": (173, 192)}
SCHEDULE_HEADER = {"title": (2, 35), "serial": (195, 200)}
SEASON = {"time_mode": (2, 2), "airline": (3, 5), "from_date": (15, 21), "to_date": (22, 28), "serial": (195, 200)}
SCHEDULE_TRAILER = {"airline": (3, 5), "check": (188, 193), "continuation": (194, 194), "serial": (195, 200)}
RULE |= {"arrival_aircraft_type": (24, 26), "arrival_aircraft_body": (27, 27), "departure_aircraft_type": (28, 30), "departure_aircraft_body": (31, 31), "arrival_from": (46, 49), "arrival_to": (50, 53), "departure_from": (54, 57), "departure_to": (58, 61), "previous_state": (62, 63), "next_state": (64, 65), "previous_region": (66, 68), "next_region": (69, 71), "suppression_region": (88, 90), "suppression_country": (91, 92), "suppression_state": (93, 94), "filed": (97, 103)}
RULE_HEADER = {"title": (2, 31), "creator": (32, 66), "date": (67, 73), "time": (74, 77), "content": (78, 78), "serial": (195, 200)}
FILTER = {"submitter": (2, 3), "partners": (5, 194), "serial": (195, 200)}


def schedule_records(lines: DataFrame) -> dict[str, DataFrame]:
    """Header, season and trailer records of a schedule file by kind; an absent continuation is E."""
    trailer = parse(lines, SCHEDULE_TRAILER, "5").withColumn("continuation", F.coalesce("continuation", F.lit("E")))
    return {"header": parse(lines, SCHEDULE_HEADER, "1"), "season": parse(lines, SEASON, "2"), "trailer": trailer}


def rule_filters(lines: DataFrame) -> DataFrame:
    """(submitter, partner, serial) of the filter records of a rule file: partners are pieces of two bytes."""
    raw = parse(lines.filter(F.substring("value", 194, 1) != "E"), FILTER, "3")
    return raw.select("submitter", F.explode(chunks(F.rpad(F.coalesce("partners", F.lit("")), 190, " "), 2, 95)).alias("partner"), F.col("serial").try_cast("int").alias("serial"))


def rule_file_errors(lines: DataFrame) -> DataFrame:
    """(line_no, error): what is wrong with a rule file; no rows if nothing is. ``lines`` has (line_no, value), one file.

    Every line has 200 bytes after a trailing CR; the header comes first with serial 1, then rules, filters, and the trailer
    last; serials rise by one and the trailer tells the last; rules that ask for a filter need one filter record; a full
    file has no actions, an updates file one on every rule. A large file is dealt over many tasks (``operators.lines``).
    """
    v = F.regexp_replace("value", "\r$", "")
    x = lines.select("line_no", v.alias("value"))
    kind = F.substring("value", 1, 1)
    x = x.withColumn("kind", F.when((kind == "3") & (F.substring("value", 194, 1) == "E"), "4").otherwise(kind)).withColumn("serial", F.trim(F.substring("value", 195, 6)).try_cast("int"))
    x = file_lines.previous(x, [], "line_no", ["kind", "serial"], "_before").withColumn("_k", F.col("_before.kind")).withColumn("_s", F.col("_before.serial"))
    # what is true of the file: one row
    whole = x.agg(F.max("line_no").alias("_end"), F.min_by(F.when(F.col("kind") == "1", F.substring("value", 78, 1)), F.when(F.col("kind") == "1", F.col("line_no"))).alias("_content"), F.count_if(F.col("kind") == "3").alias("_filters"))
    x = x.join(F.broadcast(whole), F.lit(True)).withColumn("_last", F.col("line_no") == F.col("_end"))
    action = F.trim(F.substring("value", 104, 1))
    order = F.when(F.col("_k").isNull(), F.col("kind") == "1").otherwise(F.col("kind").isin("2", "3", "4") & (F.col("kind") >= F.col("_k")) & (F.col("_k") != "4"))
    checks = [
        F.when(F.octet_length("value") != 200, "not 200 bytes"),
        F.when(~order, "record out of order"),
        F.when((F.col("kind") == "1") & ~F.col("serial").eqNullSafe(F.lit(1)), "header serial is not 1"),
        F.when(F.col("kind").isin("2", "3") & ~F.col("serial").eqNullSafe(F.col("_s") + 1), "serial does not follow"),
        F.when((F.col("kind") == "4") & ~F.col("serial").eqNullSafe(F.col("_s")), "trailer does not tell the last serial"),
        F.when(F.col("_last") & (F.col("kind") != "4"), "no trailer"),
        F.when((F.col("kind") == "2") & (F.substring("value", 11, 3) == "***") & (F.col("_filters") == 0), "no filter record"),
        F.when((F.col("kind") == "2") & (F.col("_content") == "F") & (action != ""), "action in a full file"),
        F.when((F.col("kind") == "2") & (F.col("_content") == "U") & ~action.isin("A", "D"), "no action in an updates file"),
    ]
    return x.select("line_no", F.explode(F.array_compact(F.array(*checks))).alias("error"))
