"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

Tier one is a broadcast table of the most frequent pre-tokens and their token
counts, found over the whole table by mergeable frequent-item sketches (one
sketch per task leaves the map side). Tier two is a bounded cache in each
Python worker that asks the tokenizer library about what tier one lacks.
Both tiers only remember the library's own answers, so counts are exact.

Null text counts as empty (0 tokens). A text that holds a special string of
the tokenizer is split there and the string counts as the library counts it.
Rows keep whatever doc_id they have, null and repeated ones included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import slices, table, text_array

#: Entries of the broadcast tier; at most TIER_ONE short strings and integers (about 2 MB).
TIER_ONE = 16_384
#: Sketches that are merged at once on the way to the last one.
MERGE_WAYS = 32
#: Entries of a worker's own cache.
TIER_TWO = 200_000
#: A pre-token longer than this is not kept in a cache.
LONGEST_KEPT = 64

# White space and the pre-token pattern of byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
PRE_TOKEN_JAVA = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Lengths(dict):
    """Pre-token to token count; what is missing is asked of the library and kept while there is room."""

    def __init__(self, tokenizer, known: dict[str, int], room: int = TIER_TWO):
        super().__init__(known)
        self.encode, self.most = tokenizer.encode, len(known) + room

    def __missing__(self, token: str) -> int:
        n = len(self.encode(token, add_special_tokens=False).ids)
        if len(self) < self.most and len(token) <= LONGEST_KEPT:
            self[token] = n
        return n


def counter(tokenizer, known: dict[str, int]):
    """A function from text to the number of its tokens."""
    lengths = Lengths(tokenizer, known)
    get, pre_tokens = lengths.__getitem__, regex.compile(PRE_TOKEN).findall
    special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    apart = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(text: str) -> int:
        if apart is None or not apart.search(text):
            return sum(map(get, pre_tokens(text)))
        return len(apart.findall(text)) + sum(sum(map(get, pre_tokens(x))) for x in apart.split(text))

    return count


def frequent_pre_tokens(df: DataFrame, text: str, most: int = TIER_ONE) -> list[str]:
    """About the most frequent pre-tokens of all rows; at most `most` strings reach the driver."""
    tokens = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PRE_TOKEN_JAVA), F.lit(0))).alias("t"))
    parts = tokens.where(F.length("t") <= LONGEST_KEPT).groupBy((F.spark_partition_id() % MERGE_WAYS).alias("way")).agg(F.expr(f"approx_top_k_accumulate(t, {2 * most})").alias("s"))
    # Grouped by a constant: an ungrouped merge begins with an empty sketch in each empty partition, which Spark cannot write.
    whole = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {2 * most})").alias("s"))
    top = whole.select(F.expr(f"approx_top_k_estimate(s, {most})").alias("top")).first()
    return [x.item for x in top.top] if top else []


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "n_tokens", tier_one: int = TIER_ONE, keep_text: bool = True) -> DataFrame:
    """df with the column `out` (replaced if there): the token count of each whole text."""
    spark = df.sparkSession
    tokenizer = load(tokenizer_path)
    known = {x: len(tokenizer.encode(x, add_special_tokens=False).ids) for x in frequent_pre_tokens(df, text, tier_one)}
    shared = spark.sparkContext.broadcast(known)
    df = df.drop(out)
    kept = [x for x in df.columns if keep_text or x != text]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(load(tokenizer_path), shared.value)
        for batch in batches:
            for part in slices(batch, text):
                n = pa.array([count(x) for x in text_array(part, text).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in kept), n], names=[*kept, out])

    return df.mapInArrow(counted, T.StructType([*(df.schema[x] for x in kept), T.StructField(out, T.LongType())]))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES = {"op7_token_counts": op7_token_counts}
