"""Mixing sources to target weights by weighted fair queueing.

A source's target is its weight's share of the budget, stopped at REPEATS times
its own size, with the excess shared again by weight (the water level is found
in closed form over the few-rows table of sources). Documents are shuffled by
a hash of their id, and each source queues its shuffled documents REPEATS times
over. A queued document is cut into packets of at most PACKET words, as queues
of unequal packets would else let a long one hold the line; a packet's virtual
finish time is its source's words up to and with it, divided by the source's
target. All packets of all sources are range-sorted by that time, words are
summed along the order, and the mix is what comes before the budget's end: the
sort and the cut alone decide what is taken. Since finish times of all sources
grow alike, each source has its target, to within a packet, when the budget is
used up.

Running sums never gather a source, or the whole mix, into one task: a source
is split into ranges of the shuffle hash (more of them the more rows there are),
each range is summed on its own, and range totals offset them; the same is done
along the range-sorted mix. Only DataFrame functions run; no Python on the
executors.

Null text has size 0, and a document of size 0 is never served. A null source
is a source of its own and comes last. Every input row gives one row of the
result, equal rows and null or repeated ids included: a row key goes along. No
row is served more than REPEATS times its size. Ties of the shuffle hash go by
id, size and text hash. Other columns are ignored. An empty table gives an
empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import materialize, shuffle_partitions, table

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
REPEATS = 2
#: Words of the longest packet: as near as this a source comes to its target.
PACKET = 128
#: Rows of a table for each range of the shuffle hash that its sources are split into.
RANGE_ROWS = 1 << 20


def words_of(text: Column) -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    blanks = F.translate(text, "\t\n\x0b\f\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(blanks, " ", -1), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def shuffle_hash(key: Column) -> Column:
    """The shuffled place of a document: the same in every run."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("null")))


def range_digits(rows: int) -> int:
    """Hex digits of the shuffle hash that part a source into ranges: 16 ranges at least."""
    return max(1, ceil(log(max(1, rows) / RANGE_ROWS, 16)) + 1)


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = BUDGET_SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, weight, target, budget) of (source, source_size), one row each: the water level over the sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumns({"cap": F.col("source_size") * float(repeats), "budget": F.sum("source_size").over(every) * share, "all_weight": F.sum("weight").over(every)})
        .withColumns({"full": F.coalesce(F.sum("cap").over(filling), F.lit(0.0)), "full_weight": F.coalesce(F.sum("weight").over(filling), F.lit(0.0))})
        .withColumn("level", (F.col("budget") - F.col("full")) / (F.col("all_weight") - F.col("full_weight")))
        .withColumn("reached", F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(every))
    )
    target = F.when(F.col("reached").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("reached") * F.col("weight")))
    return level.select("source", "source_size", "weight", target.alias("target"), "budget")


def queued(docs: DataFrame, digits: int, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """A row for each document: words before it in its source's queue, its source's size and target, and the budget."""
    docs = docs.withColumn("range", F.substring("shuffled", 1, digits))
    ranges = docs.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sources = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, repeats)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.withColumn("base", F.coalesce(F.sum("range_size").over(before), F.lit(0))).drop("range_size")
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    bases = bases.join(sources, same(bases, sources, "source")).select(bases["source"], "range", "base", "source_size", "target", "budget")
    inside = Window.partitionBy("source", "range").orderBy("shuffled", "key", "size", "row_hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(bases, same(placed, bases, "source", "range")).select("row", "key", placed["source"], "size", "row_hash", "shuffled", "source_size", "target", "budget", (F.col("base") + F.col("inside")).alias("first"))


def packets(rows: DataFrame, repeats: int, most: int = PACKET) -> DataFrame:
    """A row for each document, pass and packet, with its words and virtual finish time; documents without words send none."""
    each = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / most).cast("int")))
    sent = rows.where(F.col("size") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("packet", each)
    to = F.least(F.col("size"), (F.col("packet") + 1) * most)
    finish = (F.col("first") + F.col("pass") * F.col("source_size") + to) / F.col("target")
    return sent.withColumns({"words": to - F.col("packet") * most, "finish": finish}).select("row", "row_hash", "shuffled", "words", "finish", "budget")


ORDER = ("finish", "shuffled", "row_hash", "row")


def cut_at_budget(sent: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """(row, taken): the packets in their global order, cut where the words before them reach the budget."""
    ranged = materialize(sent.repartitionByRange(shuffle_partitions(sent.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("words").alias("part_words"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(F.broadcast(parts), "part")  # a row for each range
    taken = F.greatest(F.lit(0), F.least("words", F.floor("budget") - F.col("base") - F.col("inside")))
    return placed.groupBy("row").agg(F.sum(taken).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = BUDGET_SHARE, repeats: int = REPEATS, key: str = "doc_id", text: str = "text", source: str = "source", order: Sequence[str] = ORDER) -> DataFrame:
    """key, source, size, row_hash (of the text), source_size, target and taken of each row of docs."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), words_of(F.col(text)).alias("size"), shuffle_hash(F.col(key)).alias("shuffled"), F.xxhash64(text).alias("row_hash"))
    base = materialize(base)  # row keys are drawn once
    rows = materialize(queued(base, range_digits(base.count()), weights, share, repeats))
    out = rows.join(cut_at_budget(packets(rows, repeats), order), "row", "left")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "row_hash", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def op3_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_fair_queueing": op3_fair_queueing}

ORACLE_SQL = {
    "op3_fair_queueing": """
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS shuffled,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight FROM r),
f AS (SELECT *, coalesce(sum(cap) OVER w, 0.0::DOUBLE) AS full_, coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS full_weight FROM c
      WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - full_) / (all_weight - full_weight) AS level FROM f),
m AS (SELECT *, max(CASE WHEN cap > level * weight THEN level END) OVER () AS reached FROM l),
t AS (SELECT source, source_size, CASE WHEN reached IS NULL THEN cap ELSE least(cap, reached * weight) END AS target FROM m),
q AS (SELECT d.doc_id, d.shuffled, d.size, t.source_size, t.target, (sum(d.size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffled, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, pass, packet, least(size, (packet + 1) * 128) AS upto
      FROM q, (SELECT unnest([0, 1]) AS pass) AS passes, LATERAL (SELECT unnest(range(CAST(ceil(size / 128.0) AS BIGINT))) AS packet) AS cut),
f2 AS (SELECT *, upto - packet * 128 AS words, (first + pass * source_size + upto)::DOUBLE / target AS finish FROM p),
o AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, shuffled ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM f2),
k AS (SELECT doc_id, sum(greatest(0, least(words, floor(budget) - place))) AS taken FROM o GROUP BY doc_id)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id"""
}
