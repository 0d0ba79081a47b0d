"""Divergence of sources from each other and from their language, by in-mapper stripes.

A stripe is what one term of one language has: the number of documents it
occurs in and its count in each source. Tasks fold whole documents into a hash
of stripes (Arrow's hash grouping, cell by cell); a hash of more than SPILL
cells is spilled as rows and begun anew, which bounds a task's memory whatever
it reads. Stripes are shuffled and sorted by key and merged in one pass, so a
very common term sends a row for each task and spill, not for each occurrence.
Merged stripes of kept terms are written once and emit the divergences
directly: each becomes the shares of all sources of its language, and their
differences are summed for each pair inside the task.

What travels with the tasks are the totals of at most 2 * BLOCK sources; more
sources than that are taken block against block, each block of stripes in a
scan of its own, so nothing is cut off and nothing unbounded is broadcast.
Every pair of sources of a language is a result row, which is the one place
where rows grow with the square of a (small) number.

Null text, lang and source are ''. A group without terms, and a language
without kept terms, has pairs (of value 0 in the latter case) and no terms. A
language of one source has no pairs. Repeated rows and ids are documents of
their own; ids and other columns are not read. Ties go by the item's UTF-8
bytes. An empty table gives no rows. Texts of any length are folded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import materialize, slices, table, text_array

LEAST_DOCS, RANKS, UNIT = 10, 10, 1_000_000_000
#: Cells (a term's count in a source) that a task's hash holds before it is spilled.
SPILL = 1_000_000
#: Sources whose totals a block holds, and cells of a dense block of stripes.
BLOCK, DENSE = 500, 1 << 20
#: Counts above this are computed with numbers of any size.
WIDE = 9_000_000_000

# What parts terms (all ASCII but letters), and the columns of stripes.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
STRIPE = "lang string, term string, docs long, sources array<string>, counts array<long>"

CELL = ["lang", "term", "source"]


def summed(cells: pa.Table) -> pa.Table:
    """One row for each cell (lang, term, source), with its count n and the documents that have it."""
    found = cells.group_by(CELL, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.rename_columns([c.removesuffix("_sum") for c in found.column_names]).select([*CELL, "n", "docs"])


def stripes_of(cells: pa.Table, least: int = 0) -> Iterator[pa.RecordBatch]:
    """The stripes of summed cells, those of at least so many documents."""
    if not cells.num_rows:
        return
    found = cells.group_by(["lang", "term"], use_threads=False).aggregate([("docs", "sum"), ("source", "list"), ("n", "list")])
    named = {"docs_sum": "docs", "source_list": "sources", "n_list": "counts"}
    found = found.rename_columns([named.get(c, c) for c in found.column_names]).select(["lang", "term", "docs", "sources", "counts"])
    yield from found.filter(pc.greater_equal(found["docs"], least)).combine_chunks().to_batches(max_chunksize=8192)


def counted(batch: pa.RecordBatch) -> pa.Table:
    """The cells of the batch's whole documents."""
    texts = pc.replace_substring_regex(pc.ascii_lower(text_array(batch, "text")), APART, " ")
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy().astype(np.int64)
    flat = split.flatten().dictionary_encode()
    n_terms = len(flat.dictionary)
    if not n_terms:
        return pa.table({c: pa.array([], pa.string() if c in CELL else pa.int64()) for c in (*CELL, "n", "docs")})
    lang, source = (text_array(batch, c).dictionary_encode() for c in ("lang", "source"))
    n_sources = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
    doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    of_doc, times = np.unique(doc * n_terms + flat.indices.to_numpy(), return_counts=True)
    keys = group[of_doc // n_terms] * n_terms + of_doc % n_terms
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    n, docs = np.add.reduceat(times, first), np.diff(np.append(first, len(keys)))
    keys = keys[first]
    term, whose = flat.dictionary.take(pa.array(keys % n_terms)), keys // n_terms
    cells = pa.table({"lang": lang.dictionary.take(pa.array(whose // n_sources)), "term": term, "source": source.dictionary.take(pa.array(whose % n_sources)), "n": pa.array(n.astype(np.int64)), "docs": pa.array(docs.astype(np.int64))})
    return cells.filter(pc.not_equal(cells["term"], ""))


def folded(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """Stripes of each task's documents; a term has several rows where the hash was spilled."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        cells = fresh = 0
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                held.append(counted(part))
                fresh += held[-1].num_rows
                if fresh < spill / 2 and cells + fresh < 2 * spill:
                    continue
                held, fresh = [summed(pa.concat_tables(held))], 0
                cells = held[0].num_rows
                if cells >= spill:
                    yield from stripes_of(held[0])
                    held, cells = [], 0
        if held:
            yield from stripes_of(summed(pa.concat_tables(held)))

    return docs.select("lang", "source", "text").mapInArrow(fold, STRIPE)


def cells_of(stripes: pa.Table) -> pa.Table:
    """The cells of stripes; a stripe's documents stand with its first cell."""
    stripes = stripes.combine_chunks()
    parts = {c: stripes[c].chunk(0) for c in stripes.column_names}
    owner = pc.list_parent_indices(parts["sources"])
    docs = np.zeros(len(owner), np.int64)
    docs[np.flatnonzero(np.diff(owner.to_numpy(), prepend=-1))] = parts["docs"].to_numpy()
    return pa.table({"lang": parts["lang"].take(owner), "term": parts["term"].take(owner), "source": parts["sources"].flatten(), "n": parts["counts"].flatten(), "docs": pa.array(docs)})


def merged(stripes: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """One stripe for each term that `least` documents of its language have."""
    ordered = stripes.repartition("lang", "term").sortWithinPartitions("lang", "term")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # cells of the key that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = cells_of(pa.Table.from_batches([batch]))
            cells = summed(cells if rest is None else pa.concat_tables([rest, cells]))
            last = pc.and_(pc.equal(cells["lang"], batch.column("lang")[-1]), pc.equal(cells["term"], batch.column("term")[-1]))
            rest = cells.filter(last)
            yield from stripes_of(cells.filter(pc.invert(last)), least)
        if rest is not None:
            yield from stripes_of(rest, least)

    return ordered.mapInArrow(merge, STRIPE)


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / whole), exactly."""
    if counts.size and counts.max() > WIDE:
        return np.array(1 + UNIT * (counts.astype(object) + 2) // whole.astype(object), dtype=object).astype(np.int64)
    return 1 + UNIT * (counts + 2) // whole


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class Emitter:
    """Divergences between two blocks of one language's sources, summed over stripes; and the strongest terms of each."""

    def __init__(self, left: dict[str, int], right: dict[str, int], lang_whole: int, terms: int):
        self.left, self.right, self.names = left, right, list(left) + [s for s in right if s not in left]
        self.column = {s: i for i, s in enumerate(self.names)}
        self.whole = np.array([n + 2 * terms for n in (left | right).values()], np.int64) if terms else np.zeros(0, np.int64)
        self.lang_whole = np.array([lang_whole + 2 * terms], np.int64)
        self.same = left.keys() == right.keys()
        self.sums = np.zeros((len(left), len(right)), np.int64)
        self.best: dict[int, list[tuple[int, bytes, str]]] = {}

    def take(self, terms: pa.Array, sources: pa.Array, counts: pa.Array) -> None:
        step = max(1, DENSE // max(1, len(self.names)))
        for a in range(0, len(terms), step):
            self.block(*(x.slice(a, step) for x in (terms, sources, counts)))

    def block(self, terms: pa.Array, sources: pa.Array, counts: pa.Array) -> None:
        owner, named = pc.list_parent_indices(sources).to_numpy(), sources.flatten().dictionary_encode()
        column = np.array([self.column.get(s, -1) for s in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()]
        times = counts.flatten().to_numpy()
        n = np.zeros((len(terms), len(self.names)), np.int64)
        n[owner[column >= 0], column[column >= 0]] = times[column >= 0]
        p = shares(n, self.whole)
        right = p[:, [self.column[s] for s in self.right]]
        for i, s in enumerate(self.left):
            self.sums[i] += apart(p[:, [self.column[s]]], right).sum(axis=0)
        if self.same:
            total = np.zeros(len(terms), np.int64)
            np.add.at(total, owner, times)
            q = shares(total, self.lang_whole)[:, None]
            value = np.where((n > 0) & (p > q), apart(p, q), -1)
            for c in range(len(self.names)):
                self.rank(c, terms, value[:, c])

    def rank(self, c: int, terms: pa.Array, value: np.ndarray) -> None:
        who = np.flatnonzero(value >= 0)
        if len(who) > RANKS:
            who = who[value[who] >= np.partition(value[who], -RANKS)[-RANKS]]
        new = [(-int(value[i]), t.encode(), t) for i, t in zip(who, terms.take(pa.array(who)).to_pylist(), strict=True)]
        self.best[c] = sorted(self.best.get(c, []) + new)[:RANKS]

    def rows(self, lang: str) -> Iterator[tuple]:
        for i, s in enumerate(self.left):
            for j, t in enumerate(self.right):
                if s != t:
                    yield lang, s, "pair", t, int(self.sums[i, j])
                    if not self.same:
                        yield lang, t, "pair", s, int(self.sums[i, j])
        for c, found in self.best.items():
            for value, _, term in found:
                yield lang, self.names[c], "term", term, -value


Job = tuple[str, dict[str, int], dict[str, int], int, int]


def jobs(groups: DataFrame, langs: DataFrame, block: int) -> Iterator[list[Job]]:
    """Pairs of blocks of one language's sources with their totals, as many at once as 2 * block sources allow."""
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    dealt = materialize(groups.join(langs, "lang").withColumn("block", ((at - 1) / block).cast("int")))
    found = [(r.lang, r.block) for r in dealt.select("lang", "block").distinct().orderBy("lang", "block").collect()]  # a row for each 500 sources

    def totals(lang: str, i: int) -> tuple[dict[str, int], int, int]:
        rows = dealt.where((F.col("lang") == lang) & (F.col("block") == i)).orderBy("source").collect()  # block rows at most
        return {r.source: r.n for r in rows}, rows[0].lang_n, rows[0].terms

    alone = {lang for lang, i in found if (lang, i + 1) not in found and i == 0}
    light: dict[str, list] = {}
    if alone:  # languages of a single block: theirs are read together, a bounded number of rows at a time
        for r in dealt.where(F.col("block") == 0).orderBy("lang", "source").toLocalIterator():
            if r.lang in alone:
                light.setdefault(r.lang, []).append(r)
                if sum(map(len, light.values())) > 2 * block and len(light) > 1:
                    ready = [k for k in light if k != r.lang]
                    yield [single(light.pop(k)) for k in ready]
        if light:
            yield [single(x) for x in light.values()]
    for lang, i in found:
        if lang not in alone:
            left, n, terms = totals(lang, i)
            for _, j in (x for x in found if x[0] == lang and x[1] >= i):
                yield [(lang, left, left if i == j else totals(lang, j)[0], n, terms)]


def single(rows: list) -> Job:
    own = {r.source: r.n for r in rows}
    return rows[0].lang, own, own, rows[0].lang_n, rows[0].terms


def emitted(stripes: DataFrame, some: list[Job]) -> DataFrame:
    """(lang, source, part, item, value): of each task, sums of pairs and its strongest terms."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitters = {lang: Emitter(left, right, n, terms) for lang, left, right, n, terms in some if terms}
        for batch in batches:
            for lang in set(batch.column("lang").unique().to_pylist()) & emitters.keys():
                mine = batch.filter(pc.equal(batch.column("lang"), lang))
                emitters[lang].take(*(mine.column(c) for c in ("term", "sources", "counts")))
        rows = [r for lang, e in emitters.items() for r in e.rows(lang)]
        for a in range(0, len(rows), 8192):
            cut = list(zip(*rows[a : a + 8192], strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in cut[:4]), pa.array(cut[4], pa.int64())], names=["lang", "source", "part", "item", "value"])

    return stripes.mapInArrow(emit, "lang string, source string, part string, item string, value long")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS, block: int = BLOCK, spill: int = SPILL) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources of a language, and each source's strongest terms."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    stripes = materialize(merged(folded(docs, spill), least))
    cells = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", F.col("c.sources").alias("source"), F.col("c.counts").alias("n"))
    some = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(some, ["lang", "source"], "left").na.fill(0, ["n"])
    groups = materialize(groups)
    terms = stripes.groupBy("lang").agg(F.count("*").alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(terms, "lang", "left").na.fill(0, ["terms"])
    parts = [emitted(stripes, some) for some in jobs(groups, langs, block)]
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    if not parts:
        return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"), F.lit(1).alias("rank"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = materialize(found)
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    best = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", place).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", place).union(best)


def op13_source_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_stripes": op13_source_stripes}
ORACLE_SQL = {
    "op13_source_stripes": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
lang_of AS (SELECT lang, count(*) AS v, sum(n) AS whole FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT x.lang, x.source, coalesce(l.v, 0) AS v, coalesce(l.whole, 0) AS lang_n, coalesce(y.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN lang_of l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) y USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p, 1 + ({UNIT}::HUGEINT * (k.n + 2)) // (g.lang_n + 2 * g.v) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
two AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(two.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}"""
}
