"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's code holds one bit for each dimension, set where the value is above
zero, in 64-bit words. The code is cut into segments about as wide as the
logarithm of the number of distinct codes, and no wider where WIDE allows: then
a segment has no more values than there are codes, few probes meet nothing, and
a segment value holds few codes however many there are. Each distinct code is
indexed under the value of every segment. A query first looks
up its own segment values, then all values one bit away, then two, and so on:
once radius r has been searched in all m segments, every code at a distance
below m * (r + 1) has been seen, so a query ends when its k-th verified distance
is below that bound. Only queries that are not yet covered enter the next round,
and each takes its k-th distance so far along: codes further away are dropped
where they are met, and once d - m * r + 1 segments have been searched at radius
r (the others at r - 1), no code within d is left, so the rest are not probed.

Equal codes are one entry that keeps how many rows it has and the k smallest
ids, so a vector shared by a third of all rows is probed and verified once.
The k best so far of each open query go along from round to round through the
shared folder; nothing but the number of open queries reaches the driver.

Queries are the rows whose id is divisible by 50. Ties go to the smaller id; a
query finds itself first. Null ids and null vectors are no rows of the index,
null values inside a vector count as not above zero, vectors of different
lengths are searched apart (each length has an index of its own), repeated ids
count as rows of their own, in the index and among the queries, vectors without
dimensions are no rows, and an empty table gives an empty result. Segment values
that very many codes share are split by Spark's skew join (adaptive execution).
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize, table

K = 10
#: Bits of the narrowest and of the widest segment.
NARROW, WIDE = 8, 22
QUERY_EVERY = 50
#: Parts that an often repeated code is split into before its smallest ids are found.
SALT = 64


def code_of(vector: Column, dims: int) -> list[Column]:
    """The code's words, the first dimension in the lowest bit."""
    words = []
    for at in range(0, dims, 64):
        bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(at, min(at + 64, dims))]
        word = F.lit(0).cast("long")
        for j, b in enumerate(bits):
            word = word.bitwiseOR(F.shiftleft(b, j))
        words.append(word)
    return words


def segments(dims: int, codes: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: widths differ by one at most and are the logarithm of the number of codes or just below."""
    wanted = min(WIDE, max(NARROW, log2(max(codes, 2))))
    m = ceil(dims / wanted)
    bounds = [i * dims // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def segment_of(words: list[Column], first: int, width: int) -> Column:
    word, shift = divmod(first, 64)
    bits = F.shiftrightunsigned(words[word], shift)
    if shift + width > 64:
        bits = bits.bitwiseOR(F.shiftleft(words[word + 1], 64 - shift))
    return bits.bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def distance(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total.cast("int")


def masks(spark: SparkSession, radius: int, width: int) -> Column:
    """All segment values of so many bits with so many of them set, as one array that Spark makes: C(width, radius) integers, whatever the table."""
    every = spark.range(1 << width).where(F.bit_count("id") == radius)
    return every.agg(F.collect_list(F.col("id").cast("int")).alias("masks")).scalar()


def smallest_ids(rows: DataFrame, words: list[str], k: int) -> DataFrame:
    """Each distinct code with its k smallest ids; a code is first split into SALT parts, each cut to k ids."""
    part = F.pmod(F.xxhash64("id", "row"), F.lit(SALT))
    inside = rows.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy(*words, "part").orderBy("id", "row")))
    return inside.where(F.col("place") <= k).groupBy(*words).agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("ids"))


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k rows of `vectors` nearest to each row of `queries`."""
    spark = vectors.sparkSession
    usable = F.col(key).isNotNull() & (F.size(vector) > 0)
    lengths = [r.dims for r in queries.where(usable).select(F.size(vector).alias("dims")).distinct().orderBy("dims").collect()]  # a few lengths
    found = [nearest(*(df.where(usable & (F.size(vector) == d)) for df in (vectors, queries)), key, vector, k, d) for d in lengths]
    return reduce(DataFrame.union, found, spark.createDataFrame([], "query_id long, rank int, neighbour_id long, distance int"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, dims: int) -> DataFrame:
    """top_k of vectors of one length."""
    spark, n_words = vectors.sparkSession, -(-dims // 64)
    names = [f"w{i}" for i in range(n_words)]

    def coded(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), *(w.alias(n) for w, n in zip(code_of(F.col(vector), dims), names, strict=True)))

    codes = materialize(smallest_ids(coded(vectors), names, k))
    asked = materialize(coded(queries).drop("row"))
    here = [F.col(n) for n in names]
    parts = segments(dims, codes.count())
    m, widest = len(parts), max(width for _, width in parts)
    values = lambda words: F.array(*(F.struct(F.lit(i).alias("segment"), segment_of(words, *p).alias("value")) for i, p in enumerate(parts)))
    index = materialize(codes.drop("ids").withColumn("s", F.explode(values(here))).select("s.*", *names))

    q_names = [f"q{n}" for n in names]
    open_ = asked.select(*(F.col(n).alias(q) for n, q in zip(names, q_names, strict=True))).distinct()
    best = open_.select(*q_names, *(F.lit(None).cast("long").alias(n) for n in names), F.lit(0).alias("d")).limit(0)
    done: list[DataFrame] = []
    state = materialize(open_.withColumn("upper", F.lit(dims)).withColumn("covered", F.lit(False)))
    for radius in range(widest + 1):
        open_ = state.where(~F.col("covered")).drop("covered")
        there = [F.col(q) for q in q_names]
        needed = F.col("upper") - m * radius + 1
        probes = open_.withColumn("p", F.explode(values(there))).where(F.col("p.segment") < needed)
        probes = probes.withColumn("masks", masks(spark, radius, widest)).withColumn("mask", F.explode("masks"))
        width = F.element_at(F.array(*(F.lit(w) for _, w in parts)), F.col("p.segment") + 1)
        probes = probes.where(F.col("mask") < F.pow(F.lit(2), width)).select(*q_names, "upper", F.col("p.segment").alias("segment"), F.col("p.value").bitwiseXOR(F.col("mask")).alias("value"))
        # A merge join: Spark would take the probes for as small as the queries they come from, and broadcast them.
        met = probes.join(index.hint("merge"), ["segment", "value"]).withColumn("d", distance(there, here))
        found = met.where(F.col("d") <= F.col("upper")).select(*q_names, *names, "d").distinct()
        by_distance = Window.partitionBy(*q_names).orderBy("d", *names)
        # k codes hold k rows at least; equal distances need all their codes, so ties at the k-th place stay.
        ranked = found.union(best).distinct().withColumn("r", F.rank().over(Window.partitionBy(*q_names).orderBy("d"))).where(F.col("r") <= k).drop("r")
        kept = materialize(ranked)
        rows = kept.join(codes.select(*names, F.size("ids").alias("has")), names).withColumn("upto", F.sum("has").over(by_distance))
        kth = rows.groupBy(*q_names).agg(F.min(F.when(F.col("upto") >= k, F.col("d"))).alias("kth"))
        bound = m * (radius + 1)
        # Below `bound` in all segments; where `upper` asked for fewer segments, these were enough.
        covered = F.coalesce(F.col("kth") < bound, F.lit(False)) | (F.col("upper") + 1 < bound)
        before, state = state, materialize(open_.join(kth, q_names, "left").select(*q_names, F.coalesce("kth", F.lit(dims)).alias("upper"), covered.alias("covered")))
        discard(before)
        ended = state.where("covered").select(*q_names)
        done.append(materialize(kept.join(ended, q_names, "left_semi")))
        best = kept.join(ended, q_names, "left_anti")
        if state.where(~F.col("covered")).isEmpty():
            break
    else:
        done.append(best)  # fewer than k rows in all: every code has been seen
    all_ = reduce(DataFrame.union, done)
    expanded = all_.join(codes, names).select(*q_names, "d", F.explode("ids").alias("neighbour_id"))
    by_query = asked.select(F.col("id").alias("query_id"), *(F.col(n).alias(q) for n, q in zip(names, q_names, strict=True)))
    cut = expanded.withColumn("rank", F.row_number().over(Window.partitionBy(*q_names).orderBy("d", "neighbour_id"))).where(F.col("rank") <= k)
    return by_query.join(cut, q_names).select("query_id", "rank", "neighbour_id", F.col("d").alias("distance"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


QUERIES = {"op4_multi_index": op4_multi_index}

ORACLE_SQL = {
    "op4_multi_index": """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id,
             CAST(list_sum(list_transform(list_zip(q.bits, v.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM c q CROSS JOIN c v WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank, neighbour_id, distance FROM p)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10"""
}
