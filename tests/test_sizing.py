"""Hot keys are spread, results stay whole."""

from pyspark.sql import functions as F

from buildlens.operators import sizing as SZ


def hot(spark, n=3000):
    """Half of the rows share one key; NULL keys included."""
    return spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 == 0, F.lit(None))
                                 .otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))


def test_hot_keys_are_spread_and_rows_kept(spark):
    left = hot(spark)
    right = left.select("k").distinct().filter("k IS NOT NULL").withColumn("v", F.upper("k"))
    by_id = lambda df: sorted((tuple(r) for r in df.select("id", "k", "v").collect()), key=lambda r: r[0])
    for how in ("left", "inner"):
        assert by_id(SZ.join_unique(left, right, ["k"], how, small=False, hot_rows=100)) == by_id(left.join(right, "k", how))
    slots = SZ._hot_keys(SZ.key_counts(left, ["k"]), ["k"], 100).collect()
    assert {r["_k"]: r["_slots"] for r in slots} == {"hot": 15, None: 5}


def test_parts_are_ranges_of_the_order(spark):
    df = hot(spark).withColumn("v", F.xxhash64("id"))
    rows = SZ.with_part(df, ["k"], ["v"], 100).collect()
    assert len(rows) == 3000
    groups = {}
    for r in rows:
        groups.setdefault(r["k"], []).append((r["v"], r["part"]))
    for found in groups.values():
        assert [part for _, part in sorted(found)] == [i // 100 for i in range(len(found))]
    assert SZ.with_part(df, ["k"], ["v"], 5000).select("part").distinct().collect()[0][0] == 0


def test_places_in_an_order(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
                                  (F.col("id") % 400).alias("v"), "id")
    placed = SZ.with_ordinal(df, ["k"], ["v", "id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.columns == ["k", "v", "id", "ordinal"]
    groups = {}
    for r in placed.collect():
        groups.setdefault(r["k"], []).append((r["v"], r["id"], r["ordinal"]))
    for found in groups.values():
        assert [o for *_, o in sorted(found)] == list(range(len(found)))
    assert SZ.with_ordinal(df.limit(0), ["k"], ["v"]).count() == 0
    assert sorted(r["ordinal"] for r in SZ.with_ordinal(df, [], ["id"]).collect()) == list(range(5000))


def test_measure(spark):
    df = spark.createDataFrame([("ab", 1), (None, 22)], "s string, n int")
    assert SZ.measure(df) == (2, 5)
    assert SZ.is_small(df, 2, 5) and not SZ.is_small(df, 1, 5) and not SZ.is_small(df, 2, 4)


def test_cut_lineage_reads_its_own_table(spark):
    df = SZ.cut_lineage(spark.range(5).withColumn("a", F.array(F.lit("x"))))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()
    assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_semi_join_keeps_hot_rows(spark):
    left = hot(spark)
    names = spark.createDataFrame([("hot",), ("k1",)], "k string")
    got = SZ.join_unique(left, names, ["k"], "left_semi", small=False, hot_rows=100)
    assert got.columns == ["id", "k"] and sorted(r["id"] for r in got.collect()) == sorted([1, *range(0, 3000, 2)])
