"""MinHash near-duplicates by an LSH forest.

A document's set holds the 64-bit hashes of its distinct shingles; equal sets
become one class, so copies are never paired. Each class has MinHash values:
TREES sorted orders of DEPTH values each, and a sketch of all HASHES values at
four bits each, from which a pair's similarity is estimated.

Every order is read run by run, a run being the classes whose common prefix has
SHALLOW values or more. Two rounds find the candidates:

1. Each class proposes its most similar neighbour, and the hub of its run.
   Where a run is dense the prefix is taken deeper, value by value, until the
   region is at most DENSE long (adaptive depth), and neighbours in the sorted
   order are compared where no depth helps. Proposals are confirmed on the full
   sets, and confirmed links give components.
2. All runs of more than one component are read again with a longer sketch of
   LONG_HASHES values, which only classes get that have some likely partner, lie
   in a run of more than DENSE, or lie in a run that a range may have cut. Runs
   of more than BLOCK are cut into salted blocks, and each block that is not of
   the run's largest component meets every block. In a first pass each class
   takes its nearest likely partner of another component, which joins what is
   left of a large group of near copies. In a second one every pair that the
   sketches cannot rule out and whose components still differ is confirmed as
   well, so no depth, hub, nearest choice or range loses a link.

Nothing is paired inside a component, so a group of thousands of near copies
costs about two pairs a member instead of all its pairs, and a run is spread
over tasks by the range sort of round 1 and the blocks of round 2. Classes of a
run that belong to no common component are compared in full, by sketches of 64
bytes, so a passage that very many unlike documents share costs a square of
their number in such comparisons; pairs leave them only where they are likely.
Components come from minimum labels with pointer jumping, each round written to
the shared folder. Candidates are confirmed on the full sets of 64-bit hashes.

Defined cases: null or wordless text has an empty set and links with nothing by
its words. A null doc_id takes no part: its component is null and it is kept.
Rows that repeat a doc_id are one document, whatever their texts: they link, and
stay or go together. Equal rows are one set. Fewer words than a shingle: the
whole sequence is the one shingle. Very long texts are sets like others. Extra
columns are ignored. Empty tables give empty results.

A pair at the threshold shares a run in some order with probability
1 - (1 - 0.75^2)^12 > 0.9999, and passes each of the two sketches with about
0.9998: a link at 0.75 is found with about 0.9995, a closer one more surely.
Tests measure it on sets that share much boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize, shuffle_partitions, slices, table, text_array

SHINGLE = 5
PERCENT = 75
TREES, DEPTH, SHALLOW = 12, 4, 2
HASHES = 128
#: Equal sketch values of a pair that is worth confirming: 3.5 deviations below what the threshold gives.
LEAST_EQUAL = 81
#: The same for round 2, where only classes with some likely partner remain and a longer sketch tells non-links apart.
LONG_HASHES, LEAST_LONG = 1024, 736
#: The longest region in which each class is compared with each other in round 1.
DENSE = 128
#: Rows of a run that meet as many others in one piece of work of round 2.
BLOCK = 1024

_SEEDS = np.random.default_rng(5).integers(0, 1 << 63, (2, LONG_HASHES), dtype=np.uint64)
FACTORS, OFFSETS = _SEEDS[0] | np.uint64(1), _SEEDS[1]
#: Equal half bytes of two bytes, by their exclusive or.
EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    codes, bounds = flat.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    if "" in names:  # white space at either end of a text
        word = codes != names.index("")
        bounds = np.append(0, np.cumsum(word))[bounds]
        codes = codes[word]
    h = each[codes]
    rolled = h.copy()
    for k in range(1, min(shingle, len(h))):
        rolled[: len(h) - k] = rolled[: len(h) - k] * np.uint64(0x5851F42D4C957F2D) + h[k:]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(rolled[a : b - shingle + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())] if b > a else [], np.uint64))
    return out


def identity(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def min_hashes(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """Sixteen bits of each MinHash value of each non-empty set, row by row."""
    out = np.empty((len(sets), hashes), np.uint16)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    for k in range(hashes):
        out[:, k] = mixed(np.minimum.reduceat(flat * FACTORS[k] + OFFSETS[k], starts)) >> np.uint64(48)
    return out


def sketches(values: np.ndarray) -> np.ndarray:
    """Four bits of each value, two values a byte."""
    return ((values[:, 0::2] & 15) << 4 | values[:, 1::2] & 15).astype(np.uint8)


def shingled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n, set_key, orders, sketch): of each row the set's size and identity, and its MinHash values; null where it has no set."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                sets = shingle_sets(text_array(part, text))
                full = [i for i, s in enumerate(sets) if len(s)]
                values = min_hashes([sets[i] for i in full])
                orders = values[:, : TREES * DEPTH].astype(">u2")
                sketch = sketches(values)
                columns: list[list] = [[None] * len(sets) for _ in range(3)]
                for j, i in enumerate(full):
                    columns[0][i], columns[1][i], columns[2][i] = identity(sets[i]), orders[j].tobytes(), sketch[j].tobytes()
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["doc_id", "n", "set_key", "orders", "sketch"])

    return df.select(key, text).mapInArrow(hashed, "doc_id long, n long, set_key binary, orders binary, sketch binary")


def forest(classes: DataFrame) -> DataFrame:
    """A row for each class and order, range-sorted by order and prefix."""
    spark = classes.sparkSession
    prefix = F.conv(F.hex(F.substring("orders", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH))), 16, -10).cast("long")
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn("prefix", prefix).withColumn("top", F.shiftright("prefix", 16 * (DEPTH - SHALLOW))).drop("orders")
    return rows.repartitionByRange(shuffle_partitions(spark), "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Runs of rows with equal keys, and whether a run is the first or the last of its partition; a run is at most its partition."""
    held: dict[str, np.ndarray] | None = None
    first = True

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n != "sketch"}
        sketch = batch.column("sketch")
        out["sketch"] = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(len(sketch), -1)
        return out

    def cut(x: dict[str, np.ndarray], last: bool) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
        nonlocal held, first
        new = np.flatnonzero(np.any([x[k][1:] != x[k][:-1] for k in keys], axis=0)) + 1
        bounds = np.concatenate([[0], new, [len(x["node"])]])
        whole = len(bounds) - 1 if last else len(bounds) - 2
        sizes = np.diff(bounds)
        edge = np.zeros(whole, bool)
        if whole:
            edge[-1] = last
            edge[0] |= first
            first = False
        for i in np.flatnonzero((sizes[:whole] > 1) | edge):
            yield {n: v[bounds[i] : bounds[i + 1]] for n, v in x.items()}, bool(edge[i])
        held = None if last else {n: v[bounds[whole] :] for n, v in x.items()}

    for batch in batches:
        if batch.num_rows:
            x = columns(batch)
            if held is not None:
                x = {n: np.concatenate([held[n], v]) for n, v in x.items()}
            yield from cut(x, False)
    if held is not None:
        yield from cut(held, True)


def equal_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return EQUAL[a[:, None, :] ^ b[None, :, :]].sum(axis=2, dtype=np.uint16)


def likely(run: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, least: int = LEAST_EQUAL) -> tuple[np.ndarray, np.ndarray]:
    """Equal values of each pair of rows a and rows b, and whether the pair may be a link by sketch and size."""
    equal = equal_values(run["sketch"][a], run["sketch"][b])
    na, nb = run["n"][a][:, None], run["n"][b][None, :]
    fits = (equal >= least) & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & (run["node"][a][:, None] != run["node"][b][None, :])
    return equal, fits


def regions(run: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """The run's rows in regions of at most DENSE, by deeper prefixes while these part it, then by sorted neighbours."""
    stack = [(np.arange(len(run["node"])), SHALLOW)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= DENSE:
            yield rows
        elif depth < DEPTH:
            top = run["prefix"][rows] >> (16 * (DEPTH - depth - 1))
            stack += [(x, depth + 1) for x in np.split(rows, np.flatnonzero(top[1:] != top[:-1]) + 1)]
        else:
            for at in range(0, len(rows), DENSE // 2):
                yield rows[at : at + DENSE]


def proposals(classes: DataFrame) -> DataFrame:
    """Round 1: (x, nx, y, ny, equal, hub), what each class proposes in each order; a class proposes itself where its run was not compared in full."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        for run, edge in runs(batches, ("tree", "top")):
            node, n = run["node"], run["n"]
            if edge or len(node) > DENSE:
                out.append((node, n, node, n, np.full(len(node), -1, np.int32), np.zeros(len(node), bool)))
                held += len(node)
            for rows in regions(run):
                if len(rows) > 1:
                    equal, fits = likely(run, rows, rows)
                    best = np.where(fits, equal, 0).argmax(axis=1)
                    ok = np.flatnonzero(fits.any(axis=1))
                    x, y = rows[ok], rows[best[ok]]
                    out.append((node[x], n[x], node[y], n[y], equal[ok, best[ok]].astype(np.int32), np.zeros(len(x), bool)))
                    held += len(x)
            if len(node) > 2:
                half = run["sketch"]
                modes = np.stack([np.bincount(c, minlength=256).argmax() for c in half.T]).astype(np.uint8)
                hub = EQUAL[half ^ modes].sum(axis=1).argmax()
                every = np.arange(len(node))
                equal, fits = likely(run, every, np.array([hub]))
                x = every[fits[:, 0]]
                out.append((node[x], n[x], np.repeat(node[hub], len(x)), np.repeat(n[hub], len(x)), equal[fits[:, 0], 0].astype(np.int32), np.ones(len(x), bool)))
                held += len(x)
            if held >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["x", "nx", "y", "ny", "equal", "hub"])
                out, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["x", "nx", "y", "ny", "equal", "hub"])

    return forest(classes).select("tree", "top", "prefix", "node", "n", "sketch").mapInArrow(propose, "x long, nx long, y long, ny long, equal int, hub boolean")


def tops_of(orders: str) -> list[Column]:
    """The prefix in each order, as bytes."""
    return [F.substring(orders, t * (2 * DEPTH) + 1, 2 * SHALLOW) for t in range(TREES)]


def cells(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tree, top, p, q, part, node, n, label, sketch): the rows of runs of several components, once for each piece of work that they are in.

    After its sketch, a row's prefixes in all orders follow: they tell in which order a pair meets first.
    A run of at most `block` rows is one piece. Else its rows outside its largest component (the rest) and those inside
    are cut into blocks by a hash; blocks p and q meet in a piece where p, at least, is of the rest.
    """
    spark = classes.sparkSession
    tops = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring(F.col("orders"), t * (2 * DEPTH) + 1, F.lit(2 * SHALLOW)).alias("top")))
    light = classes.select("node", "n", "label", F.inline(tops))
    by_label = light.groupBy("tree", "top", "label").agg(F.count("*").alias("c"))
    met = by_label.groupBy("tree", "top").agg(F.sum("c").alias("rows"), F.max(F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda c: F.ceil(c / block).cast("int")
    held = light.join(met, ["tree", "top"]).withColumns({"inside": F.col("label") == F.col("main.label"), "kr": blocks(F.col("rows") - F.col("main.c")), "km": blocks(F.col("main.c"))})
    salted = held.withColumn("b", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("inside"), F.col("km")).otherwise(F.col("kr"))).cast("int"))
    cell = lambda p, q, part: F.struct(p.alias("p"), q.alias("q"), part.alias("part"))
    b, kr, zero = F.col("b"), F.col("kr"), F.lit(0)
    each = lambda k, f: F.transform(F.sequence(zero, k - 1), f)
    of_rest = F.concat(each(kr, lambda j: cell(F.least(b, j), F.greatest(b, j), b)), each(F.col("km"), lambda j: cell(b, kr + j, b)))
    places = F.when(F.col("rows") <= block, F.array(cell(zero, zero, zero))).when(F.col("inside"), each(kr, lambda i: cell(i, kr + b, kr + b))).otherwise(of_rest)
    placed = salted.select("tree", "top", "node", "n", "label", F.inline(places)).join(classes.select("node", "n", F.concat("sketch", *tops_of("orders")).alias("sketch")), ["node", "n"])
    return placed.select("tree", "top", "p", "q", "part", "node", "n", "label", "sketch").repartition(shuffle_partitions(spark), "tree", "top", "p", "q").sortWithinPartitions("tree", "top", "p", "q", "part", "node")


def remainder(classes: DataFrame, block: int = BLOCK, nearest: bool = False) -> DataFrame:
    """Round 2: (x, nx, y, ny), every likely pair of a run whose components differ, or of each row in a piece the nearest one alone."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, _ in runs(batches, ("tree", "top", "p", "q")):
            node, n, label, part = run["node"], run["n"], run["label"], run["part"]
            tops = np.ascontiguousarray(run["sketch"][:, LONG_HASHES // 2 :]).view(np.uint32)
            short = {**run, "sketch": np.ascontiguousarray(run["sketch"][:, : HASHES // 2])}
            met_here = lambda x, y: (tops[x] == tops[y]).argmax(axis=1) == run["tree"][0]  # noqa: B023, E731  and in no order before
            groups, group = np.unique(label, return_inverse=True)
            if len(groups) == 1:
                continue
            split = run["p"][0] != run["q"][0]
            if split:
                outer, every = np.flatnonzero(part == run["p"][0]), np.flatnonzero(part == run["q"][0])
                rank = None
            else:
                sizes = np.bincount(group)
                rank = np.argsort(np.argsort(-sizes, kind="stable"))[group]  # the largest component has rank 0
                outer, every = np.flatnonzero(rank > 0), np.arange(len(node))
            if not len(every):
                continue
            step = max(1, (1 << 22) // (len(every) * HASHES // 2))
            for at in range(0, len(outer), step):
                rows = outer[at : at + step]
                _, fits = likely(short, rows, every)
                # each pair once: in a piece of one block from the smaller component
                once = label[rows][:, None] != label[every][None, :] if rank is None else rank[every][None, :] < rank[rows][:, None]
                i, j = np.nonzero(fits & once)
                x, y = rows[i], every[j]
                if not nearest:
                    here = met_here(x, y)
                    x, y = x[here], y[here]
                long = np.concatenate([EQUAL[run["sketch"][x[k : k + 8192], : LONG_HASHES // 2] ^ run["sketch"][y[k : k + 8192], : LONG_HASHES // 2]].sum(axis=1, dtype=np.uint16) for k in range(0, len(x), 8192)] or [np.zeros(0, np.uint16)])
                x, y, long = (v[long >= LEAST_LONG] for v in (x, y, long))
                if nearest and len(x):
                    order = np.lexsort((node[y], -long.astype(np.int64), x))
                    best = order[np.append(True, x[order][1:] != x[order][:-1])]
                    x, y = x[best], y[best]
                    here = met_here(x, y)  # else another row is as near in an order before
                    x, y = x[here], y[here]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[x], n[x], node[y], n[y])], names=["x", "nx", "y", "ny"])

    return cells(classes, block).mapInArrow(across, "x long, nx long, y long, ny long")


def smaller_first(pairs: DataFrame) -> DataFrame:
    """Distinct (x, nx, y, ny) with the smaller set as x."""
    swap = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y")))
    names = {"x": "y", "nx": "ny", "y": "x", "ny": "nx"}
    return pairs.select(*(F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in names.items())).distinct()


def full_sets(df: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(node, hashes, sketch): the full sets of the wanted classes (node, set_key, rep, again), eight bytes a shingle, and their long sketches."""
    texts = df.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(wanted, "rep")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(text_array(part, "text"))
                own = part.column("set_key").to_pylist()
                full = [i for i, s in enumerate(sets) if len(s) and identity(s) == own[i]]  # an id may have texts of other classes
                long = [x.tobytes() for x in sketches(min_hashes([sets[i] for i in full], LONG_HASHES))]
                take = pa.array(full, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("node").take(take), part.column("again").take(take), pa.array([sets[i].tobytes() for i in full], pa.binary()), pa.array(long, pa.binary())], names=["node", "again", "hashes", "sketch"])

    return texts.mapInArrow(build, "node long, again boolean, hashes binary, sketch binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(x, y) of the pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("x"), F.col("hashes").alias("hx"))
    right = sets.select(F.col("node").alias("y"), F.col("hashes").alias("hy"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("hx"), batch.column("hy"), strict=True):
                s, t = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "hx", "hy").mapInArrow(confirm, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: the smallest node that it reaches."""
    both = materialize(links.select("x", "y").union(links.select("y", "x")).distinct())
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        fresh = materialize(lower.join(jump, "low", "left").select("node", F.least("low", "far").alias("label"), "old"))
        moved = not fresh.where(F.col("label") < F.col("old")).isEmpty()
        discard(labels)
        labels = fresh
        if not moved:
            discard(both)
            return labels.select("node", "label")


def joined_up(classes: DataFrame, labels: DataFrame, sets: DataFrame, tried: DataFrame, nearest: bool) -> tuple[DataFrame, DataFrame]:
    """A pass of round 2: labels after the links between components that `remainder` finds, and the pairs that were tried."""
    open_ = materialize(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    pairs = materialize(smaller_first(remainder(open_, nearest=nearest)).join(tried, ["x", "nx", "y", "ny"], "left_anti"))
    more = materialize(confirmed(pairs, sets))
    discard(open_)
    to_label = lambda side: more.join(labels.withColumnRenamed("node", side), side, "left").select("x", "y", F.coalesce("label", side).alias(f"l{side}"))
    lifted = to_label("x").join(to_label("y"), ["x", "y"]).select(F.col("lx").alias("x"), F.col("ly").alias("y"))
    upper = components(lifted)
    once = labels.join(upper.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    alone = upper.join(labels, "node", "left_anti").select("node", "label")
    return materialize(once.union(alone)), pairs


def same_document(known: DataFrame, repeated: DataFrame, names: DataFrame) -> DataFrame:
    """(x, y): links between the classes of the texts of one id."""
    several = repeated.where("least <> greatest").select("doc_id")
    owned = known.join(several, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(names.select("set_key", "node"), "set_key")
    hubs = owned.groupBy("doc_id").agg(F.min("node").alias("x"))
    return owned.join(hubs, "doc_id").where("x <> node").select("x", F.col("node").alias("y"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of df."""
    rows = materialize(shingled(df, key, text))
    known = rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("orders").alias("orders"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers are drawn once
    names, nodes = classes.select("node", "set_key", "rep"), classes.select("node", "n", "orders", "sketch")
    repeated = materialize(known.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("set_key").alias("least"), F.max("set_key").alias("greatest")).where("rows > 1"))

    proposed = proposals(nodes)
    best = proposed.groupBy("x", "nx", "hub").agg(F.max_by(F.struct("y", "ny"), F.struct("equal", "y")).alias("b")).select("x", "nx", F.col("b.y").alias("y"), F.col("b.ny").alias("ny"))
    tried = materialize(smaller_first(best))
    first = tried.where("x <> y")
    again = repeated.select(F.col("doc_id").alias("rep"), F.lit(True).alias("again"))
    wanted = names.join(tried.select(F.col("x").alias("node")).union(tried.select("y")).distinct(), "node", "left_semi").join(again, "rep", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    built = materialize(full_sets(df, wanted, key, text))
    # Equal rows of one id gave equal sets: only those are looked through for repeats.
    sets = built.where(~F.col("again")).union(built.where("again").dropDuplicates(["node"])).drop("again")
    links = materialize(confirmed(first, sets).union(same_document(known, repeated, names)))
    labels = components(links)

    # Only classes with some likely partner, or of runs not compared in full, are in `sets`; the second round needs no others.
    partnered = materialize(nodes.drop("sketch").join(sets.select("node", "sketch"), "node"))
    labels, tried_too = joined_up(partnered, labels, sets, first, nearest=True)
    labels, _ = joined_up(partnered, labels, sets, first.union(tried_too), nearest=False)
    for done in (built, partnered, tried):
        discard(done)

    member = names.join(labels, "node").select("set_key", "rep", "label")
    smallest = member.groupBy("label").agg(F.min("rep").alias("component"))
    found = member.join(smallest, "label").select("set_key", "component")
    final = names.select("set_key", "rep").join(found, "set_key", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    worded = rows.where(F.col("set_key").isNotNull()).select("doc_id", "n", "set_key").join(final, "set_key", "left").select("doc_id", "n", "component")
    # A row without words has no class: it goes with the other rows of its id, if there are any.
    wordless = rows.where(F.col("set_key").isNull()).select("doc_id", "n")
    owned = known.join(wordless.select("doc_id").distinct(), "doc_id", "left_semi").join(final, "set_key").groupBy("doc_id").agg(F.min("component").alias("component"))
    joined = worded.union(wordless.join(owned, "doc_id", "left").select("doc_id", "n", "component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_lsh_forest": op2_lsh_forest}
