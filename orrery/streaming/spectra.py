"""Stateful streams of spectra: novelty against a frozen reference, and motion from cycle to cycle.

A row is one receiver's spectrum. State is bounded: a key holds its warm-up or
its reference and at most `most` selected blocks, or the frames of the last
cycles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SELECTED = "key string, block long, score double, bin_0 int, bin_1 int"
MOTION = "key string, previous long, cycle long, shift double, shift_0 double, shift_1 double, correlation_0 double, correlation_1 double, score double"


def smoothed(rows: np.ndarray, sigma: float) -> np.ndarray:
    """Each row under a Gaussian that is cut at four sigma; the ends repeat their last value."""
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(rows, ((0, 0), (reach, reach)), mode="edge")
    return np.stack([np.convolve(r, weights / weights.sum(), "valid") for r in padded])


def novelty(pair: np.ndarray, reference: np.ndarray, align: int) -> tuple[float, int, int]:
    """The highest narrow excess over the reference that both receivers show within `align` bins, and its bins."""
    excess = pair - reference
    narrow = smoothed(excess - smoothed(excess, 20), 1)
    best = (float("-inf"), 0, 0)
    for shift in range(-align, align + 1):
        a, b = max(0, -shift), max(0, shift)
        n = narrow.shape[1] - abs(shift)
        if n <= 0:
            continue
        common = np.minimum(narrow[0, a : a + n], narrow[1, b : b + n])
        at = int(common.argmax())
        if common[at] > best[0]:
            best = (float(common[at]), at + a, at + b)
    return best


def novel_blocks(blocks: DataFrame, key: str, block: str, spectra: tuple[str, str], warm_up: int = 16, threshold: float = 0.5, most: int = 4, separation: int = 8, stratum: int | None = None, align: int = 8) -> DataFrame:
    """The strongest novel blocks of each key, at most `most`: all that stand after each batch (update mode).

    The medians of the first `warm_up` blocks are the reference from then on. Of blocks nearer than `separation`, or in
    one stratum, the better stays. Blocks are taken in the order in which they arrive, within a batch by number.
    """
    first, second = spectra
    schema = "warm array<array<double>>, reference array<double>, selected array<struct<score:double,block:bigint,bin_0:int,bin_1:int>>"

    def select(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warm, reference, chosen = state.get if state.exists else ([], [], [])
        warm, reference, chosen = [list(w) for w in warm], list(reference), [tuple(c) for c in chosen]
        for row in pd.concat(list(parts)).sort_values(block).itertuples(index=False):
            at, pair = int(getattr(row, block)), np.array([getattr(row, first), getattr(row, second)], float)
            if not reference:
                warm.append(pair.ravel().tolist())
                if len(warm) == warm_up:
                    reference, warm = np.median(np.array(warm), axis=0).tolist(), []
                continue
            score, *bins = novelty(pair, np.reshape(reference, pair.shape), align)
            if score < threshold:
                continue
            near = [c for c in chosen if (c[1] // stratum == at // stratum if stratum else abs(c[1] - at) < separation)]
            rival = max(near, default=None)
            if rival is None or score > rival[0]:
                chosen = sorted([c for c in chosen if c is not rival] + [(score, at, *bins)], reverse=True)[:most]
        state.update((warm, reference, chosen))
        yield pd.DataFrame([(str(k[0]), c[1], c[0], c[2], c[3]) for c in chosen], columns=["key", "block", "score", "bin_0", "bin_1"])

    rows = blocks.select(key, block, first, second)
    return rows.groupBy(key).applyInPandasWithState(select, SELECTED, schema, "update", GroupStateTimeout.NoTimeout)


def displacement(before: np.ndarray, now: np.ndarray, reach: int) -> tuple[int, float]:
    """The shift in bins, at most `reach`, at which two spectra correlate best, and that correlation."""
    best = (0, -2.0)
    for lag in range(-reach, reach + 1):
        a = before[max(0, -lag) : len(before) - max(0, lag)]
        b = now[max(0, lag) : len(now) - max(0, -lag)]
        a, b = a - a.mean(), b - b.mean()
        size = float(np.linalg.norm(a) * np.linalg.norm(b))
        value = float(a @ b) / size if size else -1.0
        if value > best[1]:
            best = (lag, value)
    return best


def motions(frames: DataFrame, key: str, cycle: str, receiver: str, spectrum: str, bin_width: float, least: float = 30_000.0, most: float = 600_000.0, correlation: float = 0.55, tolerance: float = 45_000.0, lag: int = 1) -> DataFrame:
    """Displacements between two cycles of a key that receivers 0 and 1 both measure and agree on.

    A cycle is compared once both of its frames are there, in whatever batch, with each whole cycle at most `lag` away.
    Frames more than `lag` cycles behind the newest are forgotten or come too late; a repeated frame counts once.
    """
    schema = "cycle array<bigint>, receiver array<int>, spectrum array<array<double>>"

    def compare(k: tuple, before: int, now: int, held: dict) -> tuple | None:
        pairs = [(np.array(held[before, r]), np.array(held[now, r])) for r in (0, 1)]
        reach = min(int(most // bin_width), len(pairs[0][0]) // 4)
        (s0, c0), (s1, c1) = (displacement(a, b, reach) for a, b in pairs)
        s0, s1 = s0 * bin_width, s1 * bin_width
        apart = abs(s0 - s1)
        if min(abs(s0), abs(s1)) < least or min(c0, c1) < correlation or apart > tolerance:
            return None
        return (str(k[0]), before, now, (s0 + s1) / 2, s0, s1, c0, c1, min(c0, c1) - apart / max(tolerance, 1))

    def follow(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(c, r): list(s) for c, r, s in zip(*state.get)} if state.exists else {}
        found = []
        for c, r, s in pd.concat(list(parts))[[cycle, receiver, spectrum]].sort_values([cycle, receiver]).itertuples(index=False):
            newest = max((h[0] for h in held), default=c)
            if (c, r) in held or c < newest - lag:
                continue
            held[int(c), int(r)] = [float(x) for x in s]
            held = {h: v for h, v in held.items() if h[0] >= max(newest, c) - lag}
            whole = sorted({h[0] for h in held if (h[0], 0) in held and (h[0], 1) in held})
            if c in whole:
                found += [compare(k, min(c, o), max(c, o), held) for o in whole if o != c]
        state.update(([h[0] for h in held], [h[1] for h in held], list(held.values())))
        yield pd.DataFrame([f for f in found if f], columns=[c.split()[0] for c in MOTION.split(", ")])

    rows = frames.where(frames[receiver].isin(0, 1)).select(key, cycle, receiver, spectrum)
    return rows.groupBy(key).applyInPandasWithState(follow, MOTION, schema, "append", GroupStateTimeout.NoTimeout)
