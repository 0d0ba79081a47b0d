"""Clusters, bin completion and divergences against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrery.llm import bin_completion, clusters, divergence

# ---------------------------------------------------------------- clusters


def brute_clusters(rows, k=8, rounds=10, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]
    centroids = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        found = [nearest(x)[1] for _, x in kept]
        for c in set(found):
            mine = [x for (_, x), f in zip(kept, found, strict=True) if f == c]
            centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, *nearest(x)) for i, x in kept]
    inertia = sum(d for _, d, _ in out)
    part = Counter()
    for _, d, c in out:
        part[c] += d
    return [(i, c, d, part[c], inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in out]


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).round(3).tolist()) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(5, rows[5][1]), (7, rng.normal(size=64).tolist()), (None, rows[9][1])]
    rows += [(300, None), (301, [1.0] * 63), (302, [float("nan")] + [0.0] * 63), (303, [float("inf")] + [0.0] * 63), (304, [None] + [0.0] * 63), (305, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string")
    got = clusters.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.drop("centroid").collect()), key=key) == sorted(brute_clusters(rows), key=key)
    few = df.where("vec_id < 3")
    assert sorted((r.vec_id, r.distance) for r in clusters.cluster(few).collect()) == [(i, 0) for i in range(3)]
    assert clusters.cluster(df.limit(0)).count() == 0
    assert clusters.cluster(df.where("vec_id >= 300")).count() == 0


def test_the_walk_stops_early_and_heeds_ties():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-500, 500, (40, 4))
    centroids[30:] = centroids[:10]  # equal centroids: the smaller number wins
    x = np.concatenate([rng.integers(-600, 600, (3000, 4)), centroids])
    number, best, asked = clusters.Sorted(centroids).nearest(x)
    far = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (number == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
    assert asked < 0.7 * far.size


def test_huge_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        clusters.cluster(df).collect()


# ---------------------------------------------------------------- bin completion


def fewest(items, cap):
    best = [(99, 0)] * (1 << len(items))
    best[0] = (0, cap)
    for s in range(1 << len(items)):
        n, used = best[s]
        for i, x in enumerate(items):
            if not s >> i & 1:
                best[s | 1 << i] = min(best[s | 1 << i], (n, used + x) if used + x <= cap else (n + 1, x))
    return best[-1][0]


def test_bin_completion_against_all_packings():
    rng = random.Random(1)
    for _ in range(80):
        cap = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, rng.choice([cap, cap // 2, cap // 3 + 1])) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(items, minlength=cap + 1)
        found = bin_completion.bin_completion(counts)
        used = Counter()
        for filling, n in found:
            assert sum(filling) <= cap
            for x in filling:
                used[x] += n
        assert used == Counter(items)
        best = fewest(items, cap)
        assert sum(n for _, n in found) == best >= bin_completion.least_bins(counts)
    hard = np.bincount(np.random.default_rng(200).integers(400, 900, 200), minlength=2049)
    improved = sum(n for _, n in bin_completion.best_fit(hard)) - sum(n for _, n in bin_completion.bin_completion(hard))
    assert improved > 0  # the search decides, not its first incumbent
    assert bin_completion.bin_completion(np.zeros(2049, np.int64)) == []


def test_fillings_are_undominated():
    counts = np.zeros(11, np.int64)
    counts[[2, 3, 5, 7]] = (2, 1, 1, 1)
    found = [f for f in bin_completion.fillings(counts, 10) if f]
    assert found[0] == (7, 3) and (5, 3, 2) not in found  # 5 + 2 would give way to 7
    assert len(found) == len(set(found))


def test_pieces_hold_the_tokenizers_ids(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["tree", "stone", "Über", "naïve", "x1", "don't"]) for _ in range(rng.choice([3, 40, 400, 900, 5000]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "a b"), (77, None), (78, ""), (79, "one"), *((100 + i, texts[2]) for i in range(30))]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, length int, task int").repartition(5)
    got = bin_completion.best_fit_pack(df, path).toPandas()
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            raw = ids[a : a + 2048].tobytes()
            want[(-1 if i is None else i, p, a, len(raw) // 4, zlib.crc32(raw), raw)] += 1
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32, got.ids, strict=True)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    counts = np.bincount(got.length, minlength=2049)
    assert bin_completion.least_bins(counts) <= got.sequence_id.nunique() <= sum(n for _, n in bin_completion.best_fit(counts))
    assert bin_completion.best_fit_pack(df.limit(0), path).count() == 0


# ---------------------------------------------------------------- divergence


def brute_divergence(rows, least=10, ranks=10):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = words(text)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for g, s in groups if g == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in own}
        total = Counter()
        for s in own:
            total.update(counts[lang, s])
        q = share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, x, -v, i + 1) for i, (v, _, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("block", "spill"), [(divergence.BLOCK, divergence.SPILL), (3, 40)])
def test_divergence_against_brute_force(spark, block, spill):
    rng = random.Random(9)
    vocabulary = ["Tree", "stone", "água", "ÜBER", "straße", "x-ray", "don't", "zzz", "日本", "a", "ab_c", "A\x00B"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(260):
        source = rng.choice(["hot", "hot", "hot", "s1", "s2", "s3", "é", None, "s10"])
        lang = rng.choice(["en", "en", None, "de"]) if source != "s10" else "en"
        rows.append((" ".join(rng.choice(vocabulary[: 12 + len(source or "x") * 4]) for _ in range(rng.randint(0, 30))), lang, source))
    rows += [(None, "en", "empty"), ("", "xx", "lone"), ("rare", "yy", "p"), ("rare", "yy", "r"), ("tree " * 60_000, "en", "s1"), ("12 34", "de", "digits"), *[("same text", "en", "hot")] * 12]
    df = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, value int").repartition(4)
    got = sorted(tuple(r) for r in divergence.divergence(df, block=block, spill=spill).collect())
    assert got == brute_divergence(rows)
    if spill > 100:
        assert divergence.divergence(df.limit(0)).count() == 0


def test_large_counts_stay_exact():
    n, whole = np.array([10**15, 3]), np.array([10**16 + 5])
    assert divergence.shares(n, whole).tolist() == [1 + 10**9 * (x + 2) // (10**16 + 5) for x in (10**15, 3)]
