"""What follows points into tracks, and what compares tracks with predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry
from orrery.functions import scalars as fn
from orrery.operators import hypotheses, joins, ordered, permutation, spectra, tracks
from orrery.plans.join_queries import TRACKS, tracks_in_order, whole_seconds
from orrery.plans.join_queries import tracks as day_tracks
from orrery.plans.registry import Tables, query
from orrery.plans.spectral_queries import RESIDUAL, spectrum


GAP8 = "least(abs(k.p - n.p), 500 - abs(k.p - n.p)) <= 60 AND abs(k.v - n.v) <= 20"


@query("w08_claim_clusters", f"""
WITH RECURSIVE n AS (SELECT user_id, event_id % 500 AS p, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT user_id, i, 1 AS c, [{{'p': p, 'v': v}}] AS reps FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.i, CASE WHEN len(list_filter(g.reps, lambda k: {GAP8})) = 0 THEN len(g.reps) + 1 ELSE list_position([{GAP8} for k in g.reps], true) END,
    CASE WHEN len(list_filter(g.reps, lambda k: {GAP8})) = 0 THEN list_append(g.reps, {{'p': n.p, 'v': n.v}}) ELSE g.reps END FROM g JOIN n ON n.user_id = g.user_id AND n.i = g.i + 1)
SELECT user_id AS key, c - 1 AS cluster, count(*) AS points FROM g GROUP BY ALL""")
def w08(t: Tables) -> DataFrame:
    return tracks.clustered(t.events, "user_id", "event_id", "event_id", "value", 500, 60, 20)


@query("w21_track_assembly")
def w21(t: Tables) -> DataFrame:
    s = t.events.withColumn("s", fn.micros(F.col("ts")) / 1e6)
    a = tracks.assembled(s, "user_id", "s", "value", 43_200, 5.0, 0.0005)
    return a.select("key", "track", "points", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), F.round("drift", 9).alias("drift"))


@query("w22_seed_collapse", """
WITH d AS (SELECT user_id, event_id, value, CAST(floor(value / 20) AS BIGINT) AS cell, user_id % 2 = 0 AS dual FROM events), k AS (SELECT * FROM d WHERE dual), g AS (SELECT user_id, cell, count(*) AS seeds, arg_max(event_id, struct_pack(v := value, i := -event_id)) AS best FROM k GROUP BY ALL) SELECT user_id, cell, seeds, best FROM g""")
def w22(t: Tables) -> DataFrame:
    dual = t.events.where("user_id % 2 = 0").withColumn("cell", F.floor(F.col("value") / 20))
    return dual.groupBy("user_id", "cell").agg(F.count("*").alias("seeds"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query("a31_population_rates")
def a31(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.count_if(F.col("l_discount") >= 0.1).alias("n"), (F.sum("l_quantity") / 3600).alias("hours"))
    b = g.withColumn("b", tracks.poisson_bounds(F.col("n")))
    return b.select("l_returnflag", "l_linenumber", "n", F.round(F.col("n") / F.col("hours"), 6).alias("rate"), F.round(F.col("b.low") / F.col("hours"), 6).alias("low"), F.round(F.col("b.high") / F.col("hours"), 6).alias("high"))


@query("a39_cluster_statistic", """
SELECT user_id, min(span) AS span, count(*) AS events FROM (SELECT user_id, lead(epoch_us(ts), 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS span FROM events WHERE value > 60) GROUP BY 1""")
def a39(t: Tables) -> DataFrame:
    us = fn.micros(F.col("ts"))
    span = F.lead("us", 2).over(Window.partitionBy("user_id").orderBy("us", "event_id")) - F.col("us")
    return t.events.where("value > 60").withColumn("us", us).withColumn("span", span).groupBy("user_id").agg(F.min("span").alias("span"), F.count("*").alias("events"))


#: Draws of the permutation test.
DRAWS = 199


@query("a39_cluster_permutation")
def a39p(t: Tables) -> DataFrame:
    """How often event labels exchanged over all times give a span as short: each user keeps its number of events.

    A draw is a seeded permutation of the events' numbers in time; the first numbers bear the hits' labels. p is null
    where no user has three hits.
    """
    times = t.events.select("event_id", fn.micros(F.col("ts")).alias("us"))
    owners = t.events.where("value > 60").groupBy("user_id").agg(F.count("*").alias("labels"))
    seen = a39(t).agg(F.min("span").alias("observed"), F.count("*").alias("users")).first()  # one row
    draws, p = DRAWS if seen.users else 0, None
    if seen.observed is not None:
        p = (1 + len(permutation.as_close(times, "us", "event_id", owners, "user_id", seen.observed, DRAWS))) / (DRAWS + 1)
    return times.sparkSession.createDataFrame([(draws, p)], "draws long, p double")


@query("j26_rate_match", f"""WITH {TRACKS}, c AS (SELECT x.user_id, x.a, y.user_id AS cand, abs(x.m - y.m) AS d FROM tr x JOIN tr y ON x.event_type = 'view' AND y.event_type = 'click' AND x.a <= y.b AND y.a <= x.b AND x.b > x.a),
r AS (SELECT *, lead(d) OVER w AS second, row_number() OVER w AS p FROM c WINDOW w AS (PARTITION BY user_id, a ORDER BY d, cand)) SELECT user_id, a, cand, coalesce(second - d >= 0.15, true) AS decisive FROM r WHERE p = 1""")
def j26(t: Tables) -> DataFrame:
    return rate_matches(t)


def rate_matches(t: Tables) -> DataFrame:
    tr = tracks_in_order(t).withColumn("all", F.lit(1))
    x = tr.where("event_type = 'view' and b > a").select("all", "user_id", "a", "b", "m")
    y = tr.where("event_type = 'click'").select("all", F.col("user_id").alias("cand"), F.col("a").alias("c"), F.col("b").alias("e"), F.col("m").alias("cm"))
    met = joins.overlapping(x, y, ["all"], ("a", "b"), ("c", "e"), 43_200).withColumn("d", F.abs(F.col("m") - F.col("cm")))
    return ordered.margin_gate(met, ["user_id", "a"], "d", "cand", 0.15, float("inf")).select("user_id", "a", "cand", F.col("passed").alias("decisive"))


SERIES = "WITH e AS (SELECT event_id, user_id, event_type, value AS y, epoch_us(ts) // 1000000 / 86400.0::DOUBLE AS t FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)"
NODES = "SELECT user_id, event_type || ' ' || CAST(floor((t + 3) / 10) AS BIGINT) AS pass, min(t) AS t0, max(t) AS t2, first(t ORDER BY y DESC, event_id) AS t1, first(y ORDER BY t, event_id) AS y0, max(y) AS y1, last(y ORDER BY t, event_id) AS y2, max(y) AS elevation FROM e"


def series(t: Tables) -> DataFrame:
    """Events as points (t in days, y)."""
    day = whole_seconds(F.col("ts")) / F.lit(86_400.0)
    return t.events.where("value is not null and ts is not null").select("event_id", "user_id", "event_type", F.col("value").alias("y"), day.alias("t"))


def series_passes(e: DataFrame) -> DataFrame:
    """The points of a user and type over ten days as a pass: first, highest and last point."""
    name = F.concat_ws(" ", "event_type", F.floor((F.col("t") + 3) / 10).cast("string"))
    at = F.struct("t", "event_id")
    return e.groupBy("user_id", name.alias("pass")).agg(
        F.min("t").alias("t0"), F.max_by("t", F.struct("y", -F.col("event_id"))).alias("t1"), F.max("t").alias("t2"),
        F.min_by("y", at).alias("y0"), F.max("y").alias("y1"), F.max_by("y", at).alias("y2"), F.max("y").alias("elevation"),
    )


@query("j25_pass_hypotheses", f"""{SERIES}, p AS (SELECT user_id, CAST(floor(t / 10) AS BIGINT) AS event, t, y FROM e WHERE event_type = 'view'),
s AS ({NODES} WHERE event_type <> 'view' GROUP BY 1, 2),
n AS (SELECT user_id, event, count(*) AS total FROM p GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT p.user_id, event, pass, y, t - t0 AS x, elevation, CASE WHEN t <= t1 AND t1 > t0 THEN y0 + (y1 - y0) * (t - t0) / (t1 - t0) WHEN t2 > t1 THEN y1 + (y2 - y1) * (t - t1) / (t2 - t1) ELSE y1 END AS e FROM p JOIN s ON p.user_id = s.user_id AND t BETWEEN t0 AND t2),
b AS (SELECT *, median(y - e) OVER (PARTITION BY user_id, event, pass) AS bias FROM m),
f AS (SELECT user_id, event, pass, count(*) AS n, max(bias) AS bias, sqrt(avg((y - e - bias) * (y - e - bias))) AS rms, abs(regr_slope(y, x) - regr_slope(e, x)) AS drift, max(elevation) AS elevation FROM b GROUP BY ALL),
c AS (SELECT f.*, n / total::DOUBLE AS overlap, n / total::DOUBLE * (0.5 + 0.5 * least(1.0, elevation / 45)) * exp(-rms / 50) * exp(-coalesce(drift, 0) / 20) AS score FROM f JOIN n USING (user_id, event) WHERE n >= 3 AND n / total::DOUBLE >= 0.25),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM c WINDOW w AS (PARTITION BY user_id, event ORDER BY score DESC, pass)),
k AS (SELECT user_id, event, CASE WHEN score < 0.05 THEN 'unmatched' WHEN score / greatest(second, 1e-12) < 1.5 AND second IS NOT NULL THEN 'ambiguous' ELSE 'ranked' END AS kind FROM r WHERE rank = 1)
SELECT n.user_id, n.event, r.pass, coalesce(r.rank, 0) AS rank, round(r.bias, 6) AS bias, round(r.rms, 6) AS rms, round(r.drift, 6) AS drift_difference, round(r.score, 6) AS score, coalesce(k.kind, 'unmatched') AS kind
FROM n LEFT JOIN k ON n.user_id = k.user_id AND n.event = k.event LEFT JOIN r ON n.user_id = r.user_id AND n.event = r.event AND r.rank <= 10""")
def j25p(t: Tables) -> DataFrame:
    """A user's views of ten days as an event, the series of the user's other types, begun three days earlier, as passes."""
    e = series(t)
    points = e.where("event_type = 'view'").select("user_id", F.floor(F.col("t") / 10).alias("event"), "t", "y")
    passes = series_passes(e.where("event_type <> 'view'"))
    found = hypotheses.pass_hypotheses(points, passes, ["user_id"], "event", 4.0, 50.0, 20.0)
    rank = F.coalesce("rank", F.lit(0)).cast("long").alias("rank")
    return found.select("user_id", "event", "pass", rank, *(F.round(c, 6).alias(c) for c in ("bias", "rms", "drift_difference", "score")), "kind")


@query("j26_pass_rates", f"""{SERIES}, s AS ({NODES} WHERE event_type NOT IN ('view', 'click') GROUP BY 1, 2),
g AS (SELECT user_id, CAST(floor(t / 10) AS BIGINT) AS event, event_type, min(t) AS a, max(t) AS b, regr_slope(y, t - 10 * floor(t / 10)) AS drift FROM e WHERE event_type IN ('view', 'click') GROUP BY ALL HAVING count(*) >= 3),
j AS (SELECT user_id, event, max(a) AS a, min(b) AS b, avg(drift) AS drift FROM g GROUP BY ALL HAVING count(drift) = 2 AND min(b) > max(a)),
o AS (SELECT j.*, s.*, greatest(a, t0) AS f, least(b, t2) AS u FROM j JOIN s ON j.user_id = s.user_id AND least(b, t2) > greatest(a, t0)),
l AS (SELECT *, CASE WHEN f <= t1 AND t1 > t0 THEN y0 + (y1 - y0) * (f - t0) / (t1 - t0) WHEN t2 > t1 THEN y1 + (y2 - y1) * (f - t1) / (t2 - t1) ELSE y1 END AS yf, CASE WHEN u <= t1 AND t1 > t0 THEN y0 + (y1 - y0) * (u - t0) / (t1 - t0) WHEN t2 > t1 THEN y1 + (y2 - y1) * (u - t1) / (t2 - t1) ELSE y1 END AS yu FROM o),
c AS (SELECT user_id, event, pass, abs(drift - (yu - yf) / (u - f)) AS d, (u - f) / (b - a) AS overlap, (u - f) / (b - a) * exp(-abs(drift - (yu - yf) / (u - f)) / 20) AS confidence FROM l),
r AS (SELECT *, row_number() OVER w AS rank, confidence - coalesce(lead(confidence) OVER w, 0) AS ahead, count(*) FILTER (d <= 20) OVER (PARTITION BY user_id, event) AS compatible_passes FROM c WINDOW w AS (PARTITION BY user_id, event ORDER BY confidence DESC, pass))
SELECT user_id, event, pass, rank, round(confidence, 6) AS confidence, d <= 20 AS compatible, compatible_passes, round(CASE WHEN rank = 1 THEN ahead END, 6) AS margin, rank = 1 AND d <= 20 AND ahead >= 0.15 AS qualified FROM r""")
def j26p(t: Tables) -> DataFrame:
    """A user's views and clicks of ten days as two members of a joint track, the series of the other types as passes."""
    e = series(t)
    window = F.floor(F.col("t") / 10)
    members = e.where("event_type in ('view', 'click')").groupBy("user_id", window.alias("event"), "event_type").agg(
        F.min("t").alias("a"), F.max("t").alias("b"), F.regr_slope(F.col("y"), F.col("t") - 10 * window).alias("drift"), F.count("*").alias("n"),
    ).where("n >= 3 and drift is not null")
    joint = members.groupBy("user_id", "event").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.avg("drift").alias("drift"), F.count("*").alias("n")).where("n = 2").drop("n")
    found = hypotheses.rate_matches(joint, series_passes(e.where("event_type not in ('view', 'click')")), ["user_id"], "event", 4.0, 20.0)
    rounded = [F.round(c, 6).alias(c) for c in ("confidence", "margin")]
    return found.select("user_id", "event", "pass", F.col("rank").cast("long").alias("rank"), *rounded, "compatible", "compatible_passes", "qualified")


@query("j27_shape_comparison", """
WITH v AS (SELECT user_id, event_id % 50 AS k, avg(value) AS v FROM events GROUP BY ALL), p AS (SELECT x.user_id, x.v, y.v AS w, z.v AS r FROM v x JOIN v y ON y.user_id = x.user_id + 1 AND y.k = x.k JOIN v z ON z.user_id = x.user_id + 1 AND z.k = 49 - x.k)
SELECT user_id, count(*) AS n, round(sqrt(var_pop(v - w)), 6) AS rms, round(sqrt(var_pop(v - r)), 6) AS reversed FROM p GROUP BY 1 HAVING count(*) >= 3""")
def j27(t: Tables) -> DataFrame:
    v = t.events.groupBy("user_id", (F.col("event_id") % 50).alias("k")).agg(F.avg("value").alias("v"))
    other = lambda name, k: v.select((F.col("user_id") - 1).alias("user_id"), k.alias("k"), F.col("v").alias(name))
    p = v.join(other("w", F.col("k")), ["user_id", "k"]).join(other("r", 49 - F.col("k")), ["user_id", "k"])
    return p.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.var_pop(F.col("v") - F.col("w"))), 6).alias("rms"), F.round(F.sqrt(F.var_pop(F.col("v") - F.col("r"))), 6).alias("reversed")).where("n >= 3")


@query("j29_fragment_gaps", f"""WITH {TRACKS} SELECT user_id, event_type, count(*) AS gaps, round(median(step), 6) AS step FROM (SELECT user_id, event_type, lead(m) OVER w - m AS step, lead(a) OVER w - b AS gap FROM tr WINDOW w AS (PARTITION BY user_id, event_type ORDER BY a)) WHERE gap IS NOT NULL AND gap <= 172800 GROUP BY ALL""")
def j29(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("a")
    g = day_tracks(t).select("user_id", "event_type", (F.lead("m").over(w) - F.col("m")).alias("step"), (F.lead("a").over(w) - F.col("b")).alias("gap"))
    return g.where("gap is not null and gap <= 172800").groupBy("user_id", "event_type").agg(F.count("*").alias("gaps"), F.round(F.median("step"), 6).alias("step"))


@query("s11_payload_by_reference", """
SELECT l.doc_id, d.source || '/' || d.doc_id AS path, length(d.text) AS characters FROM labels l JOIN documents d ON d.source || '/' || d.doc_id = (SELECT source || '/' || doc_id FROM documents e WHERE e.doc_id = l.doc_id) WHERE l.quality = 0""")
def s11(t: Tables) -> DataFrame:
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    refs = t.labels.where("quality = 0").select("doc_id").join(t.documents.select("doc_id", path.alias("path")), "doc_id")
    return refs.join(t.documents.select(path.alias("path"), F.char_length("text").cast("long").alias("characters")), "path").select("doc_id", "path", "characters")


@query("o05_visibility_screen", """
SELECT user_id, max(value) - 60 AS highest FROM events GROUP BY 1 HAVING max(value) - 60 >= -1 ORDER BY highest DESC, user_id LIMIT 40""")
def o05(t: Tables) -> DataFrame:
    return visible(t.events)


def visible(events: DataFrame) -> DataFrame:
    highest = events.groupBy("user_id").agg((F.max("value") - 60).alias("highest"))
    return highest.where("highest >= -1").orderBy(F.desc("highest"), "user_id").limit(40)


@query("o07_pass_tracks", """
WITH p AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 20 AS b FROM orders) SELECT o_orderkey, count(*) AS samples, min(d) AS first, max(d) AS last FROM (SELECT o_orderkey, unnest(list_distinct(list_append(range(a, b, 6), b))) AS d FROM p) GROUP BY 1""")
def o07(t: Tables) -> DataFrame:
    return pass_samples(t)


def pass_samples(t: Tables) -> DataFrame:
    from orrery.plans.join_queries import passes

    p = passes(t)
    grid = F.array_distinct(F.concat(F.sequence("a", F.col("b") - 1, F.lit(6).cast("long")), F.array("b")))
    return p.select("o_orderkey", F.explode(grid).alias("d")).groupBy("o_orderkey").agg(F.count("*").alias("samples"), F.min("d").alias("first"), F.max("d").alias("last"))


@query("o03_look_angles", """
WITH a AS (SELECT event_id, radians(user_id * 2.0 - 150) AS lon, radians(value % 90) AS lat, 100.0 + event_id % 7 AS dx, 50.0 - event_id % 11 AS dy, 400.0 AS dz FROM events)
SELECT event_id, round(degrees(asin((cos(lat) * cos(lon) * dx + cos(lat) * sin(lon) * dy + sin(lat) * dz) / sqrt(dx * dx + dy * dy + dz * dz))), 6) AS elevation, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS range_km FROM a""")
def o03(t: Tables) -> DataFrame:
    dx, dy = 100.0 + F.col("event_id") % 7, 50.0 - F.col("event_id") % 11
    l = geometry.look(F.radians(F.col("value") % 90), F.radians(F.col("user_id") * 2.0 - 150), dx, dy, F.lit(400.0))
    return t.events.select("event_id", F.round(l["elevation"], 6).alias("elevation"), F.round(l["range"], 6).alias("range_km"))


@query("sp06_motion_promotion", f"""WITH {RESIDUAL}, s AS (SELECT a.label, a.rw, d AS lag, corr(a.residual, b.residual) AS r FROM res a, (SELECT unnest([-2, -1, 1, 2]) AS d), res b WHERE b.label = a.label AND b.rw = a.rw + 1 AND b.bin = a.bin + d GROUP BY ALL) SELECT label, count(*) FILTER (r > 0.2) AS moves, count(*) AS tried FROM s GROUP BY 1""")
def sp06(t: Tables) -> DataFrame:
    res = spectra.residual(spectrum(t), "label", "rw")
    shifted = res.withColumn("lag", F.explode(F.array(*map(F.lit, (-2, -1, 1, 2))))).select("label", "rw", (F.col("bin") + F.col("lag")).alias("bin"), "lag", F.col("residual").alias("x"))
    after = res.select("label", (F.col("rw") - 1).alias("rw"), "bin", F.col("residual").alias("y"))
    r = shifted.join(after, ["label", "rw", "bin"]).groupBy("label", "rw", "lag").agg(F.corr("x", "y").alias("r"))
    return r.groupBy("label").agg(F.count_if(F.col("r") > 0.2).alias("moves"), F.count("*").alias("tried"))


@query("sp11_dither_classification", f"""WITH {RESIDUAL}, p AS (SELECT label, bin, avg(residual) FILTER (rw % 2 = 0) AS x, avg(residual) FILTER (rw % 2 = 1) AS y FROM res GROUP BY ALL), c AS (SELECT a.label, corr(a.x, a.y) AS fixed, corr(a.x, b.y) AS shifted FROM p a JOIN p b ON a.label = b.label AND b.bin = a.bin + 3 GROUP BY 1)
SELECT label, CASE WHEN abs(fixed - shifted) < 0.05 THEN 'unclear' WHEN fixed > shifted THEN 'baseband' ELSE 'sky' END AS kind FROM c""")
def sp11(t: Tables) -> DataFrame:
    res = spectra.residual(spectrum(t), "label", "rw")
    half = lambda k: F.avg(F.when(F.col("rw") % 2 == k, F.col("residual")))
    p = res.groupBy("label", "bin").agg(half(0).alias("x"), half(1).alias("y"))
    c = p.join(p.select("label", (F.col("bin") - 3).alias("bin"), F.col("y").alias("z")), ["label", "bin"]).groupBy("label").agg(F.corr("x", "y").alias("fixed"), F.corr("x", "z").alias("shifted"))
    kind = F.when(F.abs(F.col("fixed") - F.col("shifted")) < 0.05, "unclear").when(F.col("fixed") > F.col("shifted"), "baseband").otherwise("sky")
    return c.select("label", kind.alias("kind"))


@query("sp13_dual_features", f"""WITH {RESIDUAL}, h AS (SELECT * FROM res WHERE residual > 0.1) SELECT a.label, count(*) AS pixels, count(DISTINCT a.bin) AS width, round(sum(a.bin * a.residual) / sum(a.residual), 6) AS centre FROM h a WHERE EXISTS (SELECT 1 FROM h b WHERE b.label = (a.label + 1) % 10 AND b.rw = a.rw AND b.bin = a.bin) GROUP BY 1""")
def sp13(t: Tables) -> DataFrame:
    hot = spectra.residual(spectrum(t), "label", "rw").where("residual > 0.1")
    other = hot.select(((F.col("label") + 9) % 10).alias("label"), "rw", "bin")
    both = hot.join(other, ["label", "rw", "bin"], "left_semi")
    return both.groupBy("label").agg(F.count("*").alias("pixels"), F.count_distinct("bin").alias("width"), F.round(F.sum(F.col("bin") * F.col("residual")) / F.sum("residual"), 6).alias("centre"))


@query("sp14_component_candidates")
def sp14(t: Tables) -> DataFrame:
    res = spectra.residual(spectrum(t), "label", "rw").where("residual > 0.15")
    events = spectra.pixel_events(res, "label", "rw", 4096).where("rows >= 2")
    return ordered.newest(events, ["label"], [F.desc("pixels"), "event"], 64, "place")


@query("o09_snapshot_validation", """
SELECT o_custkey, count(*) AS sets, CASE WHEN count(*) < 5 THEN 'too few' WHEN count(*) > 15 THEN 'too many' WHEN count(DISTINCT o_orderpriority || o_orderstatus || CAST(o_totalprice AS VARCHAR)) < count(*) THEN 'repeated numbers' WHEN max(o_orderdate) < TIMESTAMP '1998-01-01' THEN 'stale' END AS refused FROM orders GROUP BY 1""")
def o09(t: Tables) -> DataFrame:
    from orrery.operators.orbit import validated

    numbered = t.orders.withColumn("number", F.concat("o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("string")))
    return validated(numbered, "o_custkey", "number", "o_orderdate", 5, 15, F.expr("timestamp_ntz '1998-01-01 00:00:00'"))
