"""S: what lies in files. The suppliers' rows are written as files, which are then read as any folder is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.registry import Tables, query
from orrery.sources import files, scratch


def stored(rows: DataFrame, by: list[str], path: str) -> None:
    """A text file for each value of `by`: written by all cores, and moved to its place by the task that wrote it and not by the driver."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows.repartition(n, by[0]).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*by).text(path)


@query("s03_schema_files", """
WITH d AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'no schema declared' ELSE 'v' || s_nationkey % 2 END AS tag FROM supplier), c AS (SELECT tag, count(*) AS n FROM d GROUP BY 1)
SELECT CASE WHEN tag IS NULL THEN 'unreadable' WHEN tag = 'v1' THEN 'read' ELSE 'other_schema' END AS status, tag, CASE WHEN tag = 'v1' THEN least(n, 3) ELSE n END AS documents FROM c UNION ALL SELECT 'beyond_limit', tag, n - 3 FROM c WHERE tag = 'v1' AND n > 3""")
def s03(t: Tables) -> DataFrame:
    """A file for each supplier, a fourth of them torn, a third without a schema; three current ones are read."""
    root = scratch.fresh(t.spark, "census")
    k = F.col("s_suppkey")
    tag = F.when(k % 3 != 0, F.concat(F.lit("v"), (F.col("s_nationkey") % 2).cast("string")))
    document = F.to_json(F.struct(tag.alias("schema"), F.col("s_name").alias("name")))
    stored(t.supplier.select(k.alias("k"), F.when(k % 4 == 0, F.concat(F.lit("{"), document)).otherwise(document).alias("value")), ["k"], root)
    return files.census(t.spark, f"{root}/k=*", "v1", "name string", limit=3)[1]


@query("s05_authenticated_files", """
SELECT s_suppkey AS run, array_to_string(list_sort(list_filter([CASE WHEN s_suppkey % 7 = 0 THEN 'missing log' END, CASE WHEN s_suppkey % 5 = 0 THEN 'changed name' END, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 7 <> 0 THEN 'length log' END], lambda x: x IS NOT NULL)), ',') AS reasons,
  s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AS accepted FROM supplier""")
def s05(t: Tables) -> DataFrame:
    """Two files for each supplier; some are gone, some have other contents of the same length, some are longer than claimed."""
    root = scratch.fresh(t.spark, "claimed")
    k = F.col("s_suppkey")
    kinds = F.explode(F.array(F.struct(F.lit("name").alias("kind"), F.col("s_name").alias("text")), F.struct(F.lit("log").alias("kind"), F.col("s_acctbal").cast("string").alias("text")))).alias("f")
    claimed = t.supplier.select(k.alias("run"), kinds).select("run", "f.*").withColumn("line", F.concat("text", F.lit("\n")))
    other = F.when((F.col("kind") == "name") & (F.col("run") % 5 == 0), F.regexp_replace("text", ".$", "\u0001")).when((F.col("kind") == "log") & (F.col("run") % 3 == 0), F.concat("text", F.lit("0"))).otherwise(F.col("text"))
    there = claimed.where("kind = 'name' OR run % 7 <> 0").select("run", "kind", other.alias("value"))
    stored(there, ["run", "kind"], f"{root}/store")
    found = files.contents(t.spark, f"{root}/store", "store").where("name LIKE '%.txt'").withColumn("name", F.regexp_replace("name", "/[^/]*$", ""))  # the writer names the file
    claims = claimed.select("run", "kind", F.concat(F.lit("run="), F.col("run").cast("string"), F.lit("/kind="), F.col("kind")).alias("name"), F.octet_length("line").cast("long").alias("bytes"), F.sha2("line", 256).alias("sha256"))
    runs = files.authenticated(claims, found, ["name", "log"])[1]
    return runs.select("run", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query("s17_sweep_files", """
WITH e AS (SELECT o_orderkey, o_custkey, unnest(['even', 'odd']) AS radio FROM orders), u AS (SELECT * FROM e WHERE NOT (radio = 'odd' AND o_orderkey % 5 = 0))
SELECT radio, count(*) AS entries, count(*) FILTER (o_orderkey % 5 = 0) AS alone, sum(CASE WHEN radio = 'even' THEN o_custkey % 8 ELSE o_custkey % 8 + 1 END)::BIGINT AS first_channels, round(sum(0.25 * (o_custkey % 3)), 6) AS last_skews FROM u GROUP BY 1""")
def s17(t: Tables) -> DataFrame:
    """A sweep for each order: both radios scan the same two tunings, one the other way round; every fifth odd radio failed."""
    root = scratch.fresh(t.spark, "sweeps")
    c = F.col("o_custkey") % 8
    low, high = F.array(c.cast("string"), F.lit("lower")), F.array((c + 1).cast("string"), F.lit("upper"))
    skew = F.array(F.lit(0.0), 0.25 * (F.col("o_custkey") % 3))
    radio = lambda failed, *order: F.struct(F.when(failed, F.lit("timeout")).alias("error"), F.array(*order).alias("tunings"), skew.alias("skew_s"), F.struct(F.array(F.lit(2)).alias("shape")).alias("iq"))
    radios = F.create_map(F.lit("even"), radio(F.lit(False), low, high), F.lit("odd"), radio(F.col("o_orderkey") % 5 == 0, high, low))
    t.orders.select(F.col("o_orderkey").cast("string").alias("sweep"), radios.alias("radios")).write.json(root)
    entries = files.sweeps(files.read_sweeps(t.spark, root), {"lower": "lower-edge", "upper": "upper-edge"})[0]
    return entries.groupBy("radio").agg(
        F.count("*").alias("entries"), F.count_if(F.size("peers") == 0).alias("alone"), F.sum(F.get("order", F.lit(0))["channel"]).alias("first_channels"), F.round(F.sum(F.get("order", F.lit(1))["skew_s"]), 6).alias("last_skews"),
    )
