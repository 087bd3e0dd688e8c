"""Updates files as a stream: equal to one delta after the other, whatever runs twice."""

from skylattice.operators import maintenance, mct
from skylattice.streaming import rule_updates


def test_batches_are_deltas_and_may_run_again(spark, tmp_path):
    land = spark.createDataFrame([("AAA",), ("BBB",)], "code string")
    kind = "rule_pos long, status string, arrival_station string, time string, action string"
    rows = [[(1, "DD", "AAA", "0100", "A"), (2, "II", None, "0200", "A"), (3, "DD", "BBB", "0030", "A")], [(1, "DD", "AAA", "0100", "D"), (2, "II", None, "0230", "A"), (3, "DI", "BBB", "0040", "A"), (4, "DD", "XXX", "0040", "A")], [(1, "DD", "BBB", "0045", "A"), (2, "DI", "BBB", "0041", "D")]]
    files = [mct.complete(spark.createDataFrame(r, kind)) for r in rows]
    state = spark.createDataFrame([], rule_updates.STATE)
    told = lambda df: sorted(map(str, df.select("owner", "rule_pos", "status", "arrival_station", "time").collect()))
    want = []
    for f in files:
        state = maintenance.delta(state, f, land)
        want.append(told(state))
    path = str(tmp_path / "rules")
    updates = lambda: spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for n, f in enumerate(files):
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = rule_updates.follow(updates(), path, str(tmp_path / "log"), land)
        q.awaitTermination()
        assert told(rule_updates.current(spark, path, q)) == want[n]
    # nothing new: nothing changes
    q = rule_updates.follow(updates(), path, str(tmp_path / "log"), land)
    q.awaitTermination()
    assert told(rule_updates.version(spark, path, 2)) == want[2]
    # a batch that runs again finds and writes the same
    rule_updates.apply(files[2], 2, path, land)
    assert told(rule_updates.version(spark, path, 2)) == want[2]
    assert rule_updates.version(spark, path, 0).count() == 0
