"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals score documents.

Training reads a bounded sample of labelled rows (SAMPLE of them, lowest hash of
the id first, none of the held-out quarter), in two halves. One half labels
tokens: how often a word or one of its beginnings stands in toxic and in other
documents gives the lower confidence bound of its log odds, and a token of a
toxic document is labelled toxic where that bound reaches TOXIC_ODDS, else
clean. The other half, labelled so, fits the chain: its features are hashed and
its own (a token's word, beginnings, ending and shape, and the words on either
side), its weights and the transitions are learned by the gradient that
forward-backward gives, and a few weights more turn a document's marginals into
a score. The field does not see the word counts: what it knows it has from its
features, so it tags words that the counts never saw, and leaves words alone
that stand among clean ones. One task fits it, on all tokens of CHAIN_ROWS rows
at most; it holds about 200 bytes a token of these rows.

Scoring is map-side only: every token of every whole text gets its weight from
the broadcast model (a float for each hash bucket and role), the chain runs
over all tokens in segments of SEGMENT, forward-backward gives each token's
marginal, and a document is scored from its largest marginal, their sum, and
their sum against its length. `spans` are the offending offsets in code points.

Null and empty texts are scored as texts without tokens. Labels that are null
are not used. A word counts that five toxic rows of the sample hold, or as many
as the commonest telling word has, where there are fewer; with no toxic label,
or no word that tells toxic rows from others, every score is 0. Null and repeated
ids and equal rows are scored row by row; other columns pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import math
import zlib
from base64 import b64decode, b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import run_sums, slices, table, text_array

#: Labelled rows that training reads at most, and of these the rows that the chain is fitted on.
SAMPLE, CHAIN_ROWS = 8_000, 2_000
#: Toxic documents of the sample that must hold a word before it counts, or as many as any word that tells them apart has, if none has so many.
LEAST_DOCS = 5
#: Lower bound of the log odds from which a token of a toxic document is labelled toxic.
TOXIC_ODDS = 1.0
#: Hash buckets of the features.
BUCKETS = 1 << 15
SEGMENT = 64
ROUNDS, RATE, RIDGE = 40, 0.3, 0.5
#: A token whose marginal reaches this is an offending one.
SPAN_AT = 0.5
CACHED_WORDS = 150_000

WORD = regex.compile(r"[\p{L}\p{N}]+")


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [f"={word}", *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]


def words_in(chunk: str) -> list[str]:
    low = chunk.lower()
    return [low] if low.isalpha() else WORD.findall(low)


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def shape(word: str) -> str:
    """A word's letters, digits and marks as classes, each run once."""
    if word.isalpha():
        return "a" if word.islower() else "A" if word.isupper() else "Aa" if word.istitle() else "aA"
    out = ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else "."
        out += kind if not out.endswith(kind) else ""
    return out


def own_features(chunk: str, words: list[str]) -> list[int]:
    """Buckets of what a token tells of itself: its words with their beginnings and endings, and its shape."""
    each = [f for w in words for f in (*features(w), f"*{w[-3:]}")]
    return [bucket(f) for f in (*each, f"~{shape(chunk)}")]


def beside(words: list[str]) -> tuple[int, int]:
    """Buckets of what a token's first word tells of the token after it, and of the one before it."""
    word = words[0] if words else ""
    return bucket(f"<{word}"), bucket(f">{word}")


class Weights:
    """What each distinct token adds to its own score and to its neighbours', remembered within bounds."""

    def __init__(self, weights: np.ndarray):
        self.weights: list[float] = weights.tolist()
        self.known: dict[str, tuple[float, float, float]] = {}

    def __call__(self, chunks: list[str]) -> np.ndarray:
        w, known, out = self.weights, self.known, []
        if len(known) > CACHED_WORDS:
            known.clear()
        for c in chunks:
            x = known.get(c)
            if x is None:
                words = words_in(c)
                after, before = beside(words)
                x = (sum([w[i] for i in own_features(c, words)]), w[after], w[before])
                if len(c) <= 64:
                    known[c] = x
            out.append(x)
        return np.array(out, np.float32).reshape(-1, 3)


def tokens_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct tokens, each token's place among them, and where each text's tokens begin and end."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten().dictionary_encode()
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    names, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    if "" in names:  # white space at either end of a text
        word = codes != names.index("")
        bounds = np.append(0, np.cumsum(word))[bounds]
        codes = codes[word]
    return names, codes, bounds


def spread(each: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each token's score for the toxic state: its own, and what its neighbours in the same text add."""
    own = each[codes, 0].astype(np.float64)
    if len(codes) > 1:
        inner = np.ones(len(codes), bool)
        inner[bounds[:-1][bounds[:-1] < len(codes)]] = False  # a text's first token has none before it
        own[1:] += np.where(inner[1:], each[codes[:-1], 1], 0)
        own[:-1] += np.where(inner[1:], each[codes[1:], 2], 0)
    return own


def segments(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of each segment."""
    n = np.diff(bounds)
    per = -(-n // SEGMENT)
    doc = np.repeat(np.arange(len(n)), per)
    inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = bounds[:-1][doc] + inner * SEGMENT
    return start, np.minimum(SEGMENT, bounds[1:][doc] - start), doc


def chain(score: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over rows of scores for state 1 (state 0 scores 0): marginals of state 1, transition marginals summed, log partition."""
    rows, steps = score.shape
    phi = np.exp(np.clip(score, -30, 30)).T.copy()
    on = mask.T.copy()
    a = np.exp(move)
    zero, one = np.empty((steps, rows)), np.empty((steps, rows))  # forward, scaled to sum 1
    scale = np.ones((steps, rows))
    f0, f1 = np.ones(rows), np.ones(rows)
    for t in range(steps):
        x0, x1 = (f0 * a[0, 0] + f1 * a[1, 0], (f0 * a[0, 1] + f1 * a[1, 1]) * phi[t]) if t else (f0, phi[t])
        s = x0 + x1
        f0, f1 = np.where(on[t], x0 / s, f0), np.where(on[t], x1 / s, f1)
        scale[t] = np.where(on[t], s, 1.0)
        zero[t], one[t] = f0, f1
    b0, b1 = np.ones(rows), np.ones(rows)
    gamma, moved = np.zeros((steps, rows)), np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        g1 = one[t] * b1
        gamma[t] = np.where(on[t], g1 / (zero[t] * b0 + g1), 0.0)
        if t:
            r0, r1 = b0 / scale[t], phi[t] * b1 / scale[t]
            live = on[t]
            z, o = zero[t - 1][live], one[t - 1][live]
            moved += a * np.array([[z @ r0[live], z @ r1[live]], [o @ r0[live], o @ r1[live]]])
            b0, b1 = np.where(live, a[0, 0] * r0 + a[0, 1] * r1, b0), np.where(live, a[1, 0] * r0 + a[1, 1] * r1, b1)
    return gamma.T, moved, np.log(scale).sum()


def padded(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(SEGMENT)
    mask = at[None] < length[:, None]
    return np.where(mask, np.append(values, 0)[np.minimum(start[:, None] + at[None], len(values))], 0), mask


def evidence(scores: np.ndarray, bounds: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document the largest marginal and their sum, and each token's marginal."""
    start, length, doc = segments(bounds)
    marginal = np.zeros(len(scores))
    top, total = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for at in range(0, len(start), 4096):
        pick = slice(at, at + 4096)
        values, mask = padded(scores, start[pick], length[pick])
        gamma = chain(values, move, mask)[0]
        marginal[(start[pick][:, None] + np.arange(SEGMENT))[mask]] = gamma[mask]
        np.maximum.at(top, doc[pick], gamma.max(axis=1))
        np.add.at(total, doc[pick], gamma.sum(axis=1))
    return top, total, marginal


def fit_chain(chunks: list[str], codes: np.ndarray, bounds: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the buckets and transitions that raise the likelihood of the labelled tokens (Adam, ridge)."""
    own = [own_features(c, words_in(c)) for c in chunks]
    sizes = np.array([len(x) for x in own])
    flat, owner = np.array([f for x in own for f in x]), np.repeat(np.arange(len(own)), sizes)
    sides = np.array([beside(words_in(c)) for c in chunks]).reshape(-1, 2)
    start, length, _ = segments(bounds)
    states, mask = padded(state, start, length)
    spots = (start[:, None] + np.arange(SEGMENT))[mask]
    inner = np.ones(len(codes), bool)
    inner[bounds[:-1][bounds[:-1] < len(codes)]] = False
    both = mask[:, 1:] & mask[:, :-1]
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (states[:, :-1][both], states[:, 1:][both]), 1)
    weights, move = np.zeros(BUCKETS), np.zeros((2, 2))
    m, v = np.zeros(BUCKETS + 4), np.zeros(BUCKETS + 4)
    n = len(chunks)

    def by_bucket(error: np.ndarray) -> np.ndarray:
        """Gradient of the buckets: each token's error goes to its own features and to its neighbours'."""
        of_own = np.bincount(codes, error, n)
        of_after = np.bincount(codes[:-1], np.where(inner[1:], error[1:], 0), n)
        of_before = np.bincount(codes[1:], np.where(inner[1:], error[:-1], 0), n)
        return np.bincount(flat, of_own[owner], BUCKETS) + np.bincount(sides[:, 0], of_after, BUCKETS) + np.bincount(sides[:, 1], of_before, BUCKETS)

    for k in range(1, ROUNDS + 1):
        each = np.stack([np.bincount(owner, weights[flat], n), weights[sides[:, 0]], weights[sides[:, 1]]], axis=1)
        values, _ = padded(spread(each, codes, bounds), start, length)
        gamma, moved, _ = chain(values, move, mask)
        error = state.astype(np.float64)
        error[spots] -= gamma[mask]
        g = np.concatenate([by_bucket(error) - RIDGE * weights, (seen_move - moved - RIDGE * move).ravel()]) * (100 / len(codes))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-5)
        weights, move = weights + step[:BUCKETS], move + step[BUCKETS:].reshape(2, 2)
    return weights.astype(np.float32), move


def inputs(top: np.ndarray, total: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """What a document's score is made of: its largest marginal, their sum, and their sum against its length."""
    return np.stack([np.ones_like(top), top, np.log1p(total), np.log((total + 0.05) / (tokens + 5))], axis=1)


def fit_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge, each halved until it lowers the loss."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.025 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step, at = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w), loss(w)
        while np.abs(step).max() > 1e-6 and loss(w + step) > at:
            step = step / 2
        w = w + step
    return w


def sample_of(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, half) of at most `most` labelled documents outside the held-out quarter."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    hashed = F.md5(F.col("doc_id").cast("string"))
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", hashed).orderBy("h").limit(most)
    half = F.substring("h", -1, 1).isin(*"02468ace")
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), half.alias("counted"), "h")  # at most `most` rows


def lexicon_of(sample: DataFrame) -> set[str]:
    """The words and beginnings that label a token of a toxic document toxic: some of those of at most SAMPLE labelled rows."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = sorted({f for w in set(words_in(text)) for f in features(w)})
                found.append("")  # the document itself
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([toxic] * len(found), pa.int32())], names=["feature", "toxic"])

    counts = sample.where("counted").select("text", "toxic").mapInArrow(held, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    whole = counts.where(F.col("feature") == "").first()
    if not whole or not whole.p or not whole.n:
        return set()
    p, n = F.col("p") + 0.5, F.col("n") + 0.5
    odds = F.log(p / n) - math.log((whole.p + 1) / (whole.n + 1))
    bound = odds - 1.3 * F.sqrt(1 / p + 1 / n)
    told = counts.where((F.col("feature") != "") & (F.col("p") > 0)).withColumn("bound", bound).where(F.col("bound") >= TOXIC_ODDS)
    least = F.least(F.lit(LEAST_DOCS), F.max("p").over(Window.partitionBy()))  # over the sample's words
    rows = told.select("feature", "p", least.alias("least")).where(F.col("p") >= F.col("least"))
    return {r.feature for r in rows.select("feature").collect()}  # words of the sample


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, rows: int = CHAIN_ROWS) -> dict:
    """The model: weights of the buckets and transitions, and the score's weights; about 130 kilobytes."""
    spark = docs.sparkSession
    sample = sample_of(docs, labels, most)
    lexicon = lexicon_of(sample)
    nothing = {"weights": np.zeros(BUCKETS, np.float32), "move": np.zeros((2, 2)), "score": None}
    if not lexicon:
        return nothing
    shared = spark.sparkContext.broadcast(lexicon)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += text_array(batch, "text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        y = np.array(toxic)
        if len(set(toxic)) < 2:
            return
        chunks, codes, bounds = tokens_of(pa.array(texts, pa.string()))
        told = np.array([any(f in shared.value for w in words_in(c) for f in features(w)) for c in chunks], bool)
        state = (told[codes] & np.repeat(y == 1, np.diff(bounds))).astype(np.int64)
        weights, move = fit_chain(chunks, codes, bounds, state)
        top, total, _ = evidence(spread(Weights(weights)(chunks), codes, bounds), bounds, move)
        fitted = fit_score(inputs(top, total, np.diff(bounds)), y)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps({"weights": b64encode(weights.tobytes()).decode(), "move": move.tolist(), "score": fitted.tolist()})])], names=["model"])

    chosen = sample.where(~F.col("counted")).select("text", "toxic", "h").orderBy("h").limit(rows).select("text", "toxic")
    found = chosen.repartition(1).mapInArrow(learn, "model string").first()  # at most `rows` labelled rows
    if not found:
        return nothing
    learned = json.loads(found.model)
    return {"weights": np.frombuffer(b64decode(learned["weights"]), np.float32), "move": np.array(learned["move"]), "score": learned["score"]}


def score(df: DataFrame, model: dict, text: str = "text", keep_text: bool = True, spans: bool = True, out: str = "score") -> DataFrame:
    """df with `out` and, if asked for, `spans` (start and end of each offending token), replaced if there."""
    df = df.drop(out, *(["spans"] if spans else []))
    kept = [x for x in df.columns if keep_text or x != text]
    shared = df.sparkSession.sparkContext.broadcast(model)
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = Weights(m["weights"])
        for batch in batches:
            for part in slices(batch, text):
                texts = text_array(part, text)
                chunks, codes, bounds = tokens_of(texts)
                top, total, marginal = evidence(spread(weights(chunks), codes, bounds), bounds, m["move"])
                s = np.zeros(len(top)) if m["score"] is None else 1 / (1 + np.exp(-np.clip(inputs(top, total, np.diff(bounds)) @ np.array(m["score"]), -30, 30)))
                columns, names = [*(part.column(x) for x in kept), pa.array(s)], [*kept, out]
                if spans:
                    found = [offending(texts[i].as_py(), marginal[bounds[i] : bounds[i + 1]]) if top[i] >= SPAN_AT else [] for i in range(len(top))]
                    columns, names = [*columns, pa.array(found, pair)], [*names, "spans"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    added = [T.StructField(out, T.DoubleType())]
    if spans:
        added.append(T.StructField("spans", T._parse_datatype_string("array<struct<start:bigint,end:bigint>>")))
    return df.mapInArrow(scored, T.StructType([*(df.schema[x] for x in kept), *added]))


def offending(text: str, marginal: np.ndarray) -> list[dict]:
    """Where the tokens with a high marginal stand, in code points."""
    found = zip(regex.finditer(r"[^ \t-\r]+", text), marginal.tolist(), strict=True)
    return [{"start": m.start(), "end": m.end()} for m, p in found if p >= SPAN_AT]


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), keep_text=False)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


QUERIES = {"op5_toxic_spans": op5_toxic_spans}
