"""Streaming operators: the same functions serve a stream and, in tests and queries, a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.operators.joins import as_of
from orrery.sources.scratch import written


def late(df: DataFrame, time: str, delay: str) -> DataFrame:
    """With a watermark, if the frame is a stream."""
    return df.withWatermark(time, delay) if df.isStreaming else df


def trailing_activity(events: DataFrame, time: str, keys: Sequence[str], value: str, width: str, step: str, delay: str = "1 hour") -> DataFrame:
    """Counts and sums over sliding windows."""
    g = late(events, time, delay).groupBy(F.window(time, width, step), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("opens"), F.col("window.end").alias("closes"), *keys, "n", "total")


def tumbling_review(events: DataFrame, time: str, keys: Sequence[str], value: str, width: str, delay: str = "1 hour") -> DataFrame:
    """Counts and maxima over windows end to end."""
    g = late(events, time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.max(value).alias("peak"))
    return g.select(F.col("window.start").alias("opens"), *keys, "n", "peak")


def sessions(events: DataFrame, time: str, keys: Sequence[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """Runs of events no further apart than the gap; a gap exactly as long still joins, so a microsecond is added."""
    g = late(events, time, delay).groupBy(F.session_window(time, f"{gap} 1 microsecond"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("opens"), *keys, "n")


def deduplicated(events: DataFrame, time: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Without exact re-deliveries that arrive within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def paired_instants(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, bound: str, delay: str = "1 hour") -> DataFrame:
    """Instants of two streams no further apart than the bound."""
    x, y = late(left, a, delay), late(right, b, delay)
    near = F.expr(f"{b} >= {a} - interval {bound} and {b} <= {a} + interval {bound}")
    joined = x.join(y, [x[k] == y[k] for k in keys] + [near])
    return joined.select(*(x[c] for c in left.columns), *(y[c] for c in right.columns if c not in keys))


CONFIRMED = "key string, at double, previous double, value double, previous_value double"
LAST = "at double, value double"


def confirmations(events: DataFrame, key: str, at: str, value: str, reach: float, tolerance: float) -> DataFrame:
    """Links between consecutive candidates of a key: the state is the last candidate, forgotten after two reaches without one."""

    def link(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for row in pd.concat(list(parts)).sort_values([at, value]).itertuples():
            now = (float(getattr(row, at)), float(getattr(row, value)))
            if last is not None and 0 < now[0] - last[0] <= reach and abs(now[1] - last[1]) <= tolerance:
                out.append((str(k[0]), now[0], float(last[0]), now[1], float(last[1])))
            if last is None or now[0] >= last[0]:
                last = now
        state.update(last)
        state.setTimeoutDuration(max(1, int(2000 * reach)))
        yield pd.DataFrame(out, columns=["key", "at", "previous", "value", "previous_value"])

    return events.select(key, at, value).groupBy(key).applyInPandasWithState(link, CONFIRMED, LAST, "append", GroupStateTimeout.ProcessingTimeTimeout)


def promotions(blocks: DataFrame, key: str, at: str, score: str, warm_up: int, factor: float) -> DataFrame:
    """The first block of each key that exceeds `factor` times the median of its first `warm_up` blocks: once for each key."""
    schema = "warm array<double>, reference double, done boolean"

    def promote(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warm, reference, done = state.get if state.exists else ([], float("nan"), False)
        warm, out = list(warm), []
        for row in pd.concat(list(parts)).sort_values(at).itertuples():
            s = float(getattr(row, score))
            if len(warm) < warm_up:
                warm.append(s)
                if len(warm) == warm_up:
                    reference = float(pd.Series(warm).median())
            elif not done and s > factor * reference:
                out.append((str(k[0]), float(getattr(row, at)), s, reference))
                done = True
        state.update((warm, reference, done))
        yield pd.DataFrame(out, columns=["key", "at", "score", "reference"])

    return blocks.select(key, at, score).groupBy(key).applyInPandasWithState(promote, "key string, at double, score double, reference double", schema, "append", GroupStateTimeout.NoTimeout)


PROMOTED = "key string, at double, score_a double, score_b double"


def two_evidences(events: DataFrame, key: str, kind: str, at: str, score: str, reach: float, least: tuple[float, float], hold: float | None = None) -> DataFrame:
    """The promotion of each key, once over the whole stream and its restarts: evidence a and evidence b, strong enough and no further apart than reach.

    State: the instants of either evidence that may still be joined, and whether the key was promoted. Of one batch the
    earliest pair counts, and what waited takes part, so it does not matter in which order the two arrive. Evidence that
    lies more than `hold` (a hundred reaches, if not given) before the newest of its key is forgotten, which bounds the
    state; the flag stays. Null keys are one key; rows of other kinds, and null scores, are no evidence.
    """

    def promote(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, done = (list(zip(*state.get[:3], strict=True)), state.get[3]) if state.exists else ([], False)
        if done:
            return
        fresh = [(x, float(t), float(s)) for p in parts for x, t, s in p[["kind", "at", "score"]].itertuples(index=False) if x in ("a", "b") and s >= least[x == "b"] and t == t]
        seen = waiting + fresh
        pairs = [(max(x[1], y[1]), x, y) for x in seen if x[0] == "a" for y in seen if y[0] == "b" and abs(x[1] - y[1]) <= reach]
        if pairs:
            when, x, y = min(pairs)
            state.update(([], [], [], True))
            yield pd.DataFrame([(k[0], when, x[2], y[2])], columns=["key", "at", "score_a", "score_b"])
            return
        # No pair yet: of each kind and instant only the strongest can matter.
        strongest = {(x, t): max(s for q, u, s in seen if (q, u) == (x, t)) for x, t, _ in seen}
        newest = max((t for _, t in strongest), default=0.0)
        kept = sorted((x, t, s) for (x, t), s in strongest.items() if newest - t <= (100 * reach if hold is None else hold))
        state.update(([x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept], False))

    named = events.select(F.col(key).cast("string").alias("key"), F.col(kind).alias("kind"), F.col(at).cast("double").alias("at"), F.col(score).cast("double").alias("score"))
    schema = "kinds array<string>, ats array<double>, scores array<double>, done boolean"
    return named.groupBy("key").applyInPandasWithState(promote, PROMOTED, schema, "append", GroupStateTimeout.NoTimeout)


def upsert_days(
    write: Callable[[DataFrame], None], read: Callable[[], DataFrame | None], key: str, day: str, order: str, drop: Callable[[list], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the newest row of each key wins, and only the days that a batch touches are written again.

    Touched are the batch's days and those where its keys were: a key that moves leaves its old day. `read` gives what
    is there (None before the first write; ask the folder, since a restarted stream remembers nothing), `write` replaces
    the days of its rows, and `drop` removes days that have no row left. A batch that is delivered again changes nothing.
    """
    from orrery.operators.ordered import newest

    def sink(batch: DataFrame, _: int) -> None:
        kept = read()
        if kept is None:
            write(newest(batch, [key], [F.desc(order)]))
            return
        before = kept.join(batch.select(key).distinct(), key, "left_semi").select(day)
        touched = written(batch.select(day).union(before).distinct(), "touched")
        left = written(newest(kept.join(touched, day, "left_semi").unionByName(batch), [key], [F.desc(order)]), "days")
        write(left)
        if drop:
            empty = [r[0] for r in touched.join(left.select(day).distinct(), day, "left_anti").collect()]  # days
            if empty:
                drop(empty)

    return sink


def enriched(batch: DataFrame, snapshots: DataFrame, keys: Sequence[str], at: str, since: str, values: Sequence[str]) -> DataFrame:
    """A micro-batch with the newest snapshot of its time; for foreachBatch."""
    return as_of(batch, snapshots, keys, at, since, values)


def stale_producers(beats: DataFrame, key: str, at: str, now: str, limit_s: float) -> DataFrame:
    """Each producer's last heartbeat, its age, and whether the limit is passed."""
    last = beats.groupBy(key).agg(F.max(at).alias("last"))
    age = F.timestamp_diff("MICROSECOND", F.col("last"), F.expr(now)) / 1e6
    return last.select(key, "last", age.alias("age_s"), (age > limit_s).alias("stale"))
