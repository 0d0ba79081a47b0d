"""Near-duplicates, mixing, toxicity and top-k search against brute force and held-out rows; the registered queries and the pipeline."""

from __future__ import annotations

import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import hamming, mixing, near_dups, queries, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 40)) for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 10**6))
    return " ".join(w)


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    base = [words(rng, rng.randint(3, 90)) for _ in range(25)]
    texts = base + [edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(60)] + [base[0]] * 10
    hot = words(rng, 120)
    texts += [edited(rng, hot, rng.randint(1, 4)) for _ in range(60)] + ["", "   ", "one two", "One TWO", "a b c d e"]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [(1, texts[5]), (1, texts[5])]  # an id with two texts, one of them twice
    df = spark.createDataFrame([*((i, t, 7) for i, t in rows), (None, texts[0], 7), (9999, None, 7)], "doc_id long, text string, kept int")
    got = near_dups.near_duplicates(df).collect()
    want = brute_components([*rows, (9999, None)])
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    assert {r.doc_id: r.n_shingles for r in got}[9999] == 0
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id_join_their_classes(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (9, b, "x"), (5, a, "x"), (9, "", "x"), (12, "one two", "x")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (9, 3, False), (9, 3, False), (12, 12, True)]


def test_recall_at_the_threshold_with_boilerplate(spark):
    rng = random.Random(21)
    passages = [words(rng, 70) for _ in range(3)]
    rows, planted, i = [], {}, 0
    while len(planted) < 900:
        tail = words(rng, 110).split()
        text = f"{rng.choice(passages)} {' '.join(tail)}"
        near = f"{text.rsplit(' ', 25)[0]} {words(rng, rng.randint(21, 25))}"
        s, t = shingles(text), shingles(near)
        rows.append((i, text))
        if 0.75 <= len(s & t) / len(s | t) < 0.79:
            rows.append((i + 1_000_000, near))
            planted[i + 1_000_000] = i
        i += 1
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == b for a, b in planted.items()) / len(planted) >= 0.99
    assert all(v in (k, planted.get(k)) for k, v in got.items())


@pytest.mark.parametrize("n", range(7))
def test_a_slice_of_few_words(n):
    import pyarrow as pa

    (got,) = near_dups.shingle_sets(pa.array([" ".join("abcdefg"[:n])]))
    assert len(got) == (0 if n == 0 else max(1, n - 4))
    beside = near_dups.shingle_sets(pa.array(["x " * 20, " ".join("abcdefg"[:n])]))[1]
    assert got.tolist() == beside.tolist()


def test_a_table_of_one_short_row(spark):
    for n in range(5):
        df = spark.createDataFrame([(7, " ".join("abcd"[:n]))], "doc_id long, text string")
        assert [tuple(r) for r in near_dups.near_duplicates(df).collect()] == [(7, min(n, 1), 7, True)]


def test_deep_regions_are_parted():
    run = {"node": np.arange(1000), "prefix": np.repeat(np.arange(10), 100).astype(np.int64) << 16}
    parts = list(near_dups.regions(run))
    assert sorted(len(p) for p in parts) == [100] * 10
    same = {"node": np.arange(1000), "prefix": np.zeros(1000, np.int64)}
    assert max(map(len, near_dups.regions(same))) == near_dups.DENSE


def test_pairs_in_dense_runs_are_found(spark):
    rng = random.Random(14)
    passage, pairs, others = words(rng, 110), 700, 1600
    texts, planted = [], {}
    for i in range(pairs + others):
        tail = words(rng, 90).split()
        texts.append((i, f"{passage} {' '.join(tail)}"))
        if i < pairs:  # 172 of 220 shingles are shared
            texts.append((10_000 + i, f"{passage} {' '.join(tail[:66])} {words(rng, 24)}"))
            planted[10_000 + i] = i
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: planted.get(i, i) for i, _ in texts}


def test_every_class_of_a_dense_run_enters_round_two(spark):
    rng = np.random.default_rng(16)
    rows = [(i, 100, bytes(2 * near_dups.TREES * near_dups.DEPTH), rng.bytes(near_dups.HASHES // 2)) for i in range(400)]
    got = near_dups.proposals(spark.createDataFrame(rows, "node long, n long, orders binary, sketch binary")).collect()
    assert {r.x for r in got} | {r.y for r in got} == set(range(400))


def test_blocks_of_a_run_meet_once(spark):
    rng = random.Random(15)
    sketch = bytes(near_dups.LONG_HASHES // 2)
    rows = [(i, 10, 0 if i < 120 else rng.randrange(60), bytes(2 * near_dups.TREES * near_dups.DEPTH), sketch) for i in range(200)]
    df = spark.createDataFrame(rows, "node long, n long, label long, orders binary, sketch binary")
    label = {r[0]: r[2] for r in rows}
    want = sorted((a, b) for a in label for b in label if a < b and label[a] != label[b])
    for block in (1000, 16):
        got = near_dups.remainder(df, block).collect()
        assert len(got) == len(want)  # each pair in the first order in which it meets
        assert sorted({(min(r.x, r.y), max(r.x, r.y)) for r in got}) == want


def test_mixing_targets_and_bounds(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"]), 1) for i in range(400)]
    rows += [(7, "dup dup", "a", 1), (7, "dup dup", "a", 1), (None, "x y", "b", 1), (500, None, "only", 1), (501, "w " * 30_000, "hot", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    mixed = mixing.mix(df)
    out = mixed.collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    got = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, budget = set(), 1.5 * sum(sizes.values())
    while True:
        left = budget - sum(2 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for r in got:
        assert r.size == sizes[r.source]
        assert r.target == pytest.approx(2 * sizes[r.source] if r.source in capped else level * weight[r.source])
        assert abs(r.taken - r.target) <= mixing.PACKET * 2
    assert sum(r.taken for r in got) == int(budget)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(mixing.mix(df.repartition(3)).collect(), key=key) == sorted(out, key=key)
    assert mixing.mix(df.limit(0)).count() == 0


def test_equal_rows_stay_rows(spark):
    df = spark.createDataFrame([(7, "a b c d", "s"), (7, "a b c d", "s"), (8, "e f", "s"), (1, "g h i j k l", "t")], "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert sorted(r.doc_id for r in out) == [1, 7, 7, 8] and all(r.taken <= 2 * r.size for r in out) and sum(r.taken for r in out) == 24


def test_segments_cover_a_code_and_widen():
    for dims in (1, 7, 64, 100, 384):
        for n in (1, 1000, 10**6, 10**9):
            parts = hamming.segments(dims, n)
            assert [a for a, _ in parts] == [0, *np.cumsum([w for _, w in parts])[:-1]] and sum(w for _, w in parts) == dims
            assert max(w for _, w in parts) <= hamming.WIDE
    assert len(hamming.segments(64, 10**6)) < len(hamming.segments(64, 1000))


def test_the_order_decides_what_is_taken(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 90), f"s{i % 4}") for i in range(600)], "doc_id long, text string, source string")
    taken = lambda order: {r.doc_id: r.taken for r in mixing.mix(df, order=order).collect()}
    fair, other = taken(mixing.ORDER), taken(("shuffled", "row", "finish"))
    assert sum(fair.values()) == sum(other.values()) and sum(fair[i] != other[i] for i in fair) > 50


def test_mix_runs_without_python(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(13)
    bad = ["grumble", "snarl", "vexifoo", "vexibar", "vexibaz"]
    rows = []
    for i in range(1200):
        w = words(rng, rng.randint(5, 60)).split()
        if i % 4 == 0:
            for _ in range(max(2, len(w) // 10)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", F.when(F.col("doc_id") % 50 != 3, F.col("toxic")).alias("toxic"))
    model = toxicity.fit(df.select("doc_id", "text"), labels)
    got = toxicity.score(df, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200 and sum((r.score >= 0.3) == bool(r.toxic) for r in held) / len(held) > 0.97
    for r in held[:60]:
        for s in r.spans:
            assert r.text[s.start : s.end] in bad
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "grumble " * 5000, "x")], "doc_id long, text string, score string")
    s = {r.text: r.score for r in toxicity.score(odd, model).collect()}
    assert s[None] == s[""] < 0.3 <= s["grumble " * 5000]
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.fit(df.select("doc_id", "text"), labels.withColumn("toxic", F.lit(0)))
    assert [r.score for r in toxicity.score(odd, none).collect()] == [0.0] * 3


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    score, move = rng.normal(size=4), rng.normal(size=(2, 2))
    padded = np.stack([np.append(score, 9.0), np.append(-score, 9.0)])
    mask = np.array([[True] * 4 + [False]] * 2)
    gamma, moved, logz = toxicity.chain(padded, move, mask)
    z = want_moved = 0
    for row, x in enumerate((score, -score)):
        weights = {s: np.exp(sum(x[t] * y for t, y in enumerate(s)) + sum(move[a, b] for a, b in zip(s, s[1:], strict=False))) for s in product((0, 1), repeat=4)}
        total = sum(weights.values())
        z += np.log(total)
        assert np.allclose(gamma[row, :4], [sum(w for s, w in weights.items() if s[t]) / total for t in range(4)]) and gamma[row, 4] == 0
        want_moved += sum(w * sum(a == 1 and b == 0 for a, b in zip(s, s[1:], strict=False)) for s, w in weights.items()) / total
    assert np.isclose(logz, z) and np.isclose(moved[1, 0], want_moved)


def test_gradient_of_the_chain(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["bad", "worse", "fine", "good", "ok"]) for _ in range(rng.randint(1, 150))) for _ in range(40)]
    chunks, codes, bounds = toxicity.tokens_of(pa.array([*texts, "", " bad "]))
    assert len(bounds) == 43 and bounds[-1] == sum(len(t.split()) for t in texts) + 1
    state = np.isin(np.array(chunks)[codes], ["bad", "worse"]).astype(np.int64)
    weights, move = toxicity.fit_chain(chunks, codes, bounds, state)
    marginal = toxicity.evidence(toxicity.spread(toxicity.Weights(weights)(chunks), codes, bounds), bounds, move)[2]
    assert ((marginal >= 0.5) == state).mean() > 0.99


def test_score_against_enumeration(spark):
    from itertools import product

    rng = np.random.default_rng(8)
    model = {"weights": rng.normal(size=toxicity.BUCKETS).astype(np.float32), "move": rng.normal(size=(2, 2)), "score": [0.2, 1.1, -0.7, 0.5]}
    texts = ["a", "bad word", "A-b-c-d-e-f-g-h-toxicword then more", "  one two  three four five six seven ", "Über naïve x1", "", None, "a-b-c-d-e-f-g-h-another then more"]
    got = {r.text: r.score for r in toxicity.score(spark.createDataFrame([(t, 1.0) for t in texts], "text string, score double"), model).collect()}
    for text in texts:
        tokens = (text or "").split()
        w = model["weights"].astype(float)
        words = [toxicity.words_in(t) for t in tokens]
        own = [sum(w[i] for i in toxicity.own_features(t, x)) for t, x in zip(tokens, words, strict=True)]
        for i in range(len(tokens)):
            own[i] += (w[toxicity.beside(words[i - 1])[0]] if i else 0) + (w[toxicity.beside(words[i + 1])[1]] if i + 1 < len(tokens) else 0)
        weight = {s: np.exp(sum(x for x, y in zip(own, s, strict=True) if y) + sum(model["move"][a, b] for a, b in zip(s, s[1:], strict=False))) for s in product((0, 1), repeat=len(tokens))}
        marginal = [sum(x for s, x in weight.items() if s[i]) / sum(weight.values()) for i in range(len(tokens))]
        top, total = max(marginal, default=0), sum(marginal)
        z = np.dot(model["score"], [1, top, np.log1p(total), np.log((total + 0.05) / (len(tokens) + 5))])
        assert got[text] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)
    assert got[texts[2]] != got[texts[7]]  # the ninth part of a token counts


def test_few_toxic_rows_still_teach(spark):
    rows = [(i, words(random.Random(i), 20) + (" vexifoo vexibar" if i in (8, 9, 14) else ""), int(i in (8, 9, 14))) for i in range(60)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    df = spark.createDataFrame([r for r in rows if not held(r[0])], "doc_id long, text string, toxic int")
    assert 0 < len(toxicity.lexicon_of(df.select("text", "toxic", F.lit(True).alias("counted")))) and df.where("toxic = 1").count() < toxicity.LEAST_DOCS


def test_masks_of_wide_segments(spark):
    from math import comb

    for radius, width in ((0, 8), (2, 8), (5, 22)):
        got = spark.range(1).select(hamming.masks(spark, radius, width).alias("m")).first().m
        assert len(set(got)) == comb(width, radius) and all(bin(x).count("1") == radius for x in got[:50])


@pytest.mark.parametrize("dims", [16, 64, 100])
def test_top_k_against_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    v = rng.normal(size=(160, dims)).astype(np.float32)
    v[40:90] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (None, v[0].tolist()), (501, [1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, distance int, rank int")
    got = hamming.top_k(df, df.where("vec_id % 50 = 0"), k=10).collect()
    bits = v > 0
    want = {(q, r + 1, int(i), int(d)) for q in range(0, 160, 50) for r, (d, i) in enumerate(sorted((int((bits[q] != bits[j]).sum()), j) for j in range(160))[:10])}
    assert {(r.query_id, r.rank, r.neighbour_id, r.distance) for r in got} == want
    few = hamming.top_k(df.where("vec_id < 4"), df.where("vec_id = 0"), k=10).collect()
    assert len(few) == 4
    if dims == 16:  # a length of its own, and a query that repeats
        lone = hamming.top_k(df, df.where("vec_id = 501").union(df.where("vec_id = 501"))).collect()
        assert [(r.query_id, r.neighbour_id, r.distance) for r in lone] == [(501, 501, 0)] * 2
    assert hamming.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns)
    a, b = (x.sort_values(order).reset_index(drop=True) for x in (got, want))
    same = lambda x, y: x.astype(str).tolist() == y.astype(str).tolist() if x.dtype == object or y.dtype == object or str(x.dtype).startswith("str") else np.allclose(x.astype(float), y.astype(float))
    assert len(a) == len(b) and all(same(a[c], b[c]) for c in order)


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as c

    from orrery.llm.common import materialize

    assert [n for n, _ in c.STAGES] == ["toxicity", "near_dups", "secrets", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in c.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    before, after = seen["near_dups"]
    want = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({*want.values()})
    before, after = seen["secrets"]
    assert before.count() == after.count() and not after.where("text rlike 'AKIA[A-Z0-9]{14,}'").count()
    before, after = seen["mixing"]
    words_ = lambda df: df.agg(F.sum(mixing.words_of(F.col("text")))).first()[0]
    assert abs(words_(after) / words_(before) - 1.5) < 0.2
    before, after = seen["packing"]
    assert after.where("start = 0").count() == before.count()
    assert after.agg(F.sum("length")).first()[0] == after.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
