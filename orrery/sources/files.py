"""Files as they lie in a folder: a census by declared schema, claims held against contents, sweeps of several radios.

Spark's file sources leave out files of no bytes, so these are not counted, and a claim of one is refused as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.currency import all_reasons, first_reason

#: The name under which documents are counted that declare no schema.
UNDECLARED = "no schema declared"


def census(spark: SparkSession, path: str, current: str, schema: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, document) of the documents of the current schema, and (status, tag, documents) of all files.

    A file is one JSON document whose `schema` field is its tag. The first `limit` current ones by path are read, the
    others are `beyond_limit`; those of other tags are `other_schema`, those that are no JSON object `unreadable`. The
    limit bounds what is read as documents and not what is counted.
    """
    texts = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    parsed = texts.withColumn("__v", F.try_parse_json("value"))
    readable = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    tagged = parsed.withColumn("tag", F.when(readable, F.coalesce(F.try_variant_get("__v", "$.schema", "string"), F.lit(UNDECLARED)))).drop("__v")
    status = first_reason(unreadable=F.col("tag").isNull(), other_schema=F.col("tag") != current)
    counted = tagged.groupBy(F.coalesce(status, F.lit("read")).alias("status"), "tag").agg(F.count("*").alias("documents"))
    own = tagged.where(F.col("tag") == current)
    if limit is not None:
        own = own.orderBy("path").limit(limit)
        within = F.when(F.col("status") == "read", F.least("documents", F.lit(limit))).otherwise(F.col("documents"))
        parts = F.array(F.struct("status", within.alias("documents")), F.struct(F.lit("beyond_limit").alias("status"), (F.col("documents") - within).alias("documents")))
        counted = counted.select("tag", F.explode(parts).alias("p")).select("p.status", "tag", "p.documents").where("documents > 0")
    return own.select("path", F.from_json("value", schema).alias("document")), counted.select("status", "tag", "documents")


def contents(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(name, bytes, sha256) of files, names relative to a folder of the path that ends in `root`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", f"/{root}/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def authenticated(claims: DataFrame, files: DataFrame, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Each claim (run, kind, name, bytes, sha256) with its `refused` reason or null, and each run with all reasons against it.

    A name that is absolute or leaves the folder is unsafe and is not looked up. A run stands if none of its claims is
    refused and it claims every required kind; a kind is claimed once for a run.
    """
    unsafe = F.col("name").isNull() | F.col("name").startswith("/") | F.array_contains(F.split("name", "/"), "..")
    held = files.select("name", F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha256"))
    met = claims.join(held, "name", "left")
    why = first_reason(unsafe=unsafe, missing=F.col("__bytes").isNull(), length=~F.col("bytes").eqNullSafe(F.col("__bytes")), changed=~F.col("sha256").eqNullSafe(F.col("__sha256")))
    told = met.select(*claims.columns, why.alias("refused"))
    lacking = [F.when(~F.bool_or(F.col("kind") == kind), F.lit(f"unclaimed {kind}")) for kind in required]
    against = F.collect_set(F.when(F.col("refused").isNotNull(), F.concat_ws(" ", "refused", "kind")))  # as many as a run has kinds
    runs = told.groupBy("run").agg(against.alias("a"), F.array(*lacking).alias("b") if lacking else F.array().cast("array<string>").alias("b"))
    whole = runs.select("run", F.array_sort(F.concat("a", F.filter("b", lambda x: x.isNotNull()))).alias("reasons"))
    return told, whole.withColumn("accepted", F.size("reasons") == 0)


#: A sweep: what each radio scanned, in its own order.
SWEEP = "sweep string, radios map<string, struct<error:string, tunings:array<array<string>>, skew_s:array<double>, iq:struct<shape:array<bigint>>>>"


def sweeps(documents: DataFrame, regions: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Entries (sweep, radio, peers, order) of the usable radios of sweep records, and (reason, radios) of the others.

    Order is the radio's own list of (channel, region, skew_s), never its peer's; skews are by place, null where there is
    none. A radio that failed does not keep the others of its sweep out; `peers` are the others that came in.
    """
    each = documents.select("sweep", F.explode("radios").alias("radio", "r"))
    names = F.create_map(*(F.lit(x) for pair in regions.items() for x in pair))
    tunings = F.col("r.tunings")
    channel = lambda t: F.get(t, F.lit(0)).try_cast("int")
    region = lambda t: F.element_at(names, F.coalesce(F.get(t, F.lit(1)), F.lit("")))
    why = first_reason(**{
        "radio failed": F.col("r").isNull() | F.col("r.error").isNotNull(), "no tunings": F.coalesce(F.size(tunings), F.lit(0)) <= 0,
        "tuning is not (channel, edge)": F.exists(tunings, lambda t: channel(t).isNull() | (F.size(t) != 2)), "unknown edge": F.exists(tunings, lambda t: region(t).isNull()),
        "samples of another number of tunings": F.coalesce(F.get("r.iq.shape", F.lit(0)) != F.size(tunings), F.lit(True)),
    })
    told = each.withColumn("reason", why)
    order = F.transform(tunings, lambda t, i: F.struct(channel(t).alias("channel"), region(t).alias("region"), F.get("r.skew_s", i).alias("skew_s")))
    usable = told.where("reason IS NULL").select("sweep", "radio", order.alias("order"))
    others = usable.groupBy("sweep").agg(F.collect_set("radio").alias("all"))  # the radios of a sweep
    entries = usable.join(others, "sweep").select("sweep", "radio", F.array_sort(F.array_remove("all", F.col("radio"))).alias("peers"), "order")
    return entries, told.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("radios"))


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """Sweep records of JSON files, one a line."""
    return spark.read.schema(SWEEP).option("mode", "FAILFAST").json(path)
