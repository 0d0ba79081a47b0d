"""Packing along a space-filling curve.

Each document becomes token ids plus an end id and a vector: the hashed sum of
its tokens, projected to a few dimensions by seeded integer signs. A Hilbert
curve through the projected space gives one key a document; documents are
range-sorted by that key, laid end to end, and cut every `window` tokens, so
neighbours on the curve share sequences and only the very last sequence can
need padding (to the next power of two).

Running totals over the curve need no single task: rows are range-sorted once,
each range sums its own tokens, and the few range totals are offset. Equal keys
(copies) are told apart by doc_id and a row key, so one huge group of copies
spreads over ranges as any other rows do.

Ids are the library's own for any tokenizer file. Where its normalizer and
pre-tokens let words be encoded apart (`words_apart` reads that from the file),
each worker asks the library once for each word; else it gets whole texts.

Null text is the empty text: its document is the end id alone. A repeated
doc_id is packed once for each row; a null doc_id stays null. An empty table
gives no pieces. A text longer than a sequence is cut into consecutive pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import materialize, ragged, run_sums, shuffle_partitions, slices, table, text_array

WINDOW = 2048
END_ID = 1
DIMENSIONS, BITS = 4, 12
SEED = 20_240_101
#: Words that a generation of a worker's memory holds, before the next one begins.
CACHED = 200_000
#: Bytes of text that are split at once.
SLICE = 4 << 20

# The normalizer and pre-token pattern of tokenizers whose words can be encoded apart (lower case, white space dropped),
# what they part letters from, and the texts whose pre-tokens are found with it (as RE2 patterns).
APART_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
APART_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^\t-\r \pL\pN]+)"
PLAIN = "^[\t-\r -~\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0-\u00b3\u00b6\u00b7\u00b9-\u00ff]*$"


class Ids:
    """Ids of words without white space, as the library gives them, as little-endian bytes.

    The memory is bounded: what was not asked for during a whole generation is forgotten.
    """

    def __init__(self, tokenizer, kind: np.dtype):
        self.tokenizer, self.kind = tokenizer, kind
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, words: list[str], single: bool) -> list[bytes]:
        """Ids of each word; single: each is one pre-token, so many are encoded as one text that parts them again."""
        new, old = self.new.get, self.old.get
        found = [new(w) if w else b"" for w in words]
        missing = []
        for i, x in enumerate(found):
            if x is None:
                found[i] = x = old(words[i])
                if x is None:
                    missing.append(i)
                else:
                    self.new[words[i]] = x
        for a in range(0, len(missing), 4096):
            part = [words[i] for i in missing[a : a + 4096]]
            for i, w, x in zip(missing[a : a + 4096], part, self.joined(part) if single else self.apart(part), strict=True):
                found[i] = self.new[w] = x
        if len(self.new) >= CACHED:
            self.old, self.new = self.new, {}
        return found

    def apart(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def joined(self, words: list[str]) -> list[bytes]:
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        raw, size = np.array(e.ids, self.kind).tobytes(), self.kind.itemsize
        bounds = (np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(words) + 1)) * size).tolist() if e.ids else [0] * (len(words) + 1)
        return [raw[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def words_apart(tokenizer) -> bool:
    """Whether the tokenizer gives a text the ids of its words one by one; others encode whole texts."""
    told = json.loads(tokenizer.to_str())
    normal, before = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    steps = [x["type"] for x in normal.get("normalizers", [])]
    splits = [x.get("pattern", {}).get("Regex") for x in before.get("pretokenizers", []) if x["type"] == "Split"]
    return steps == APART_NORMALIZERS and splits == [APART_PATTERN]


def coded(texts: pa.Array, ids: Ids, plain: bool | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The ids of each distinct word, each word's place among those, and where each text's words begin and end.

    Plain texts are parted at the tokenizer's own pre-token boundaries, others at white space alone; with plain None a text is one word.
    """
    if plain is None:
        return ids.apart(texts.to_pylist()), np.arange(len(texts)), np.arange(len(texts) + 1)
    if plain:
        texts = pc.replace_substring_regex(pc.utf8_lower(texts), PIECE, r" \1 ")
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten().dictionary_encode()
    bounds = split.offsets.to_numpy().astype(np.int64)
    return ids(flat.dictionary.to_pylist(), plain), flat.indices.to_numpy(), bounds - bounds[0]


def alike(batch: pa.RecordBatch, text: str, apart: bool) -> list[tuple[pa.RecordBatch, bool | None]]:
    """The batch's rows with plain texts, and the others; all as whole texts where words cannot be encoded apart."""
    if not apart:
        return [(batch, None)] if batch.num_rows else []
    texts = text_array(batch, text)
    plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, "<|")))
    return [x for x in ((batch.filter(plain), True), (batch.filter(pc.invert(plain)), False)) if x[0].num_rows]


def signs(vocabulary: int) -> np.ndarray:
    """The projection: a row of small integers for each token id, the same everywhere."""
    return np.random.default_rng(SEED).integers(-64, 64, (vocabulary, DIMENSIONS), dtype=np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of unsigned coordinates below 2**bits (bit-plane transform)."""
    x = points.astype(np.uint64).T.copy()
    one, n = np.uint64(1), len(x)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(hit, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - one), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def place(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Coordinates on the grid of summed projections of so many tokens."""
    scaled = sums / (np.sqrt(np.maximum(counts, 1))[:, None] * 37.0)
    return np.minimum((1 / (1 + np.exp(-np.clip(scaled / 4, -30, 30))) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def tokenised(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, row_key, curve, n, ids): each document's ids as little-endian bytes, two a token if they fit."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        size = max(tokenizer.get_vocab_size(), end_id + 1)
        kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        words, axes, apart = Ids(tokenizer, kind), signs(size), words_apart(tokenizer)
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, plain in (y for x in slices(batch, text, SLICE) for y in alike(x, text, apart)):
                each, codes, bounds = coded(text_array(part, text), words, plain)
                length = np.fromiter(map(len, each), np.int64, len(each)) // kind.itemsize
                flat = np.frombuffer(b"".join(each), kind)
                starts = np.cumsum(length) - length
                spread = run_sums(axes[flat], np.append(starts, len(flat)))
                counts = run_sums(length[codes], bounds)
                ids = flat[ragged(starts[codes], length[codes])]
                curve = hilbert(place(run_sums(spread[codes], bounds), counts))
                ends = np.cumsum(counts)
                end = np.array([end_id], kind).tobytes()
                rows = [ids[e - n : e].tobytes() + end for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).cast(pa.int64()), pa.array(np.arange(at, at + len(rows))), pa.array(curve), pa.array(counts + 1), pa.array(rows, pa.binary())],
                    names=["doc_id", "row_key", "curve", "n", "ids"],
                )
                at += len(rows)

    return df.select(key, text).mapInArrow(encode, "doc_id long, row_key long, curve long, n long, ids binary")


def along_curve(tokens: DataFrame) -> DataFrame:
    """(row_key, first): where each document begins once all lie end to end in curve order."""
    spark = tokens.sparkSession
    light = tokens.select("doc_id", "row_key", "curve", "n")
    ranged = light.repartitionByRange(shuffle_partitions(spark), "curve", "doc_id", "row_key")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()))
    before = F.sum("part_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = ranged.groupBy("part").agg(F.sum("n").alias("part_n")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("curve", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return running.join(F.broadcast(parts), "part").select("row_key", (F.col("base") + F.col("inside")).alias("first"))  # a row for each range


def pack(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (bytes, little-endian uint32)."""
    tokens = materialize(tokenised(df, tokenizer_path, key, text, end_id))
    laid = tokens.select("doc_id", "row_key", "n", "ids").join(along_curve(tokens), "row_key").select("doc_id", "n", "first", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, ns = batch.column("first").to_numpy(), batch.column("n").to_numpy()
            rows: list[tuple] = []
            for doc, n, first, raw in zip(batch.column("doc_id").to_pylist(), ns.tolist(), firsts.tolist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), "<u2" if len(raw.as_buffer()) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    room = window - (first + start) % window
                    length = min(room, n - start)
                    piece = ids[start : start + length].tobytes()
                    rows.append((doc, start, length, zlib.crc32(piece), n, (first + start) // window, window - room, piece))
                    start += length
                    if len(rows) >= 512:
                        yield pieces(rows)
                        rows = []
            if rows:
                yield pieces(rows)

    return laid.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op1_hilbert_packing": op1_hilbert_packing}
