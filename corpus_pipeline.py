"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's result to the
shared folder before the next one reads it, so a lost executor costs a stage at
most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import materialize, table
from orrery.llm.mixing import mix
from orrery.llm.near_dups import near_duplicates
from orrery.llm.packing import packed
from orrery.llm.secrets import without_secrets
from orrery.llm.toxicity import fit, score

#: Documents that score this or more are rejected.
REJECT_AT = 0.3

#: No SQL: a fitted random field, MinHash candidates and tokenizer ids are outside it; tests compare each stage with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted field does not hold to be toxic.

    Null and empty texts score as texts without tokens and stay; null and repeated ids and equal rows are judged row by
    row, alike where their texts are; with no toxic label, or an empty table, nothing goes.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, spans=False, out="__toxicity")
    return scored.where(F.col("__toxicity") < REJECT_AT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Rows that repeat an id are one document: if it stays, its first row by the other columns stays. Rows without an id
    belong to no group and stay, repeated or not; a text without words is like no other and stays.
    """
    found = near_duplicates(docs)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    again = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    others = [c for c in docs.columns if c != "doc_id"]
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("__row"))
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).union(one.select("doc_id", "__row.*").select(*docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars as it then is.

    A null text stays null, with the n_chars that it had; every row is masked on its own, so null and repeated ids and
    equal rows stay as they are.
    """
    masked = without_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as whole documents: a row for each whole time that the mix takes a document, rounded to the nearest.

    A document without words stays as it is. A null source is a source. Rows alike in id, source and text share evenly
    what the mix takes of them.
    """
    taken = mix(docs)
    copies = taken.groupBy("doc_id", "source", "row_hash").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    copies = copies.select("doc_id", "source", "row_hash", times.alias("__copies"))
    docs_ = docs.withColumn("__hash", F.xxhash64("text"))
    on = [docs_["doc_id"].eqNullSafe(copies["doc_id"]), docs_["source"].eqNullSafe(copies["source"]), docs_["__hash"] == copies["row_hash"]]
    joined = docs_.join(copies.where(F.col("__copies") > 0), on).select(*(docs_[c] for c in docs.columns), "__copies")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences along the Hilbert curve.

    A null or empty text is its end id alone; each row is packed once, whatever its id; an empty table has no pieces.
    """
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dups", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
