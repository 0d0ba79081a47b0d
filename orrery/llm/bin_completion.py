"""Best-fit packing by bin completion.

Documents become token ids plus an end id; only what is longer than a sequence
is cut. What matters for packing is how many pieces there are of each length,
so Spark counts lengths, and a branch-and-bound search fills sequences with
lengths: a table of at most `window` rows, however many documents there are.

The search takes the largest length left and enumerates the undominated
fillings of the room beside it: those where no single length left could take
the place of one, two or three chosen ones and fit. A filling is taken as often
as the counts allow, or once, and the rest is filled in the same way. A branch is
cut where the waste so far and the least waste of the rest (a bound by lengths
above and below half a sequence) exceed what the incumbent allows. The first
incumbent is best-fit decreasing; each better solution becomes the incumbent,
and the search ends at the lower bound, when all branches are done, or after
`nodes` looks (packing is NP-hard; all pieces are packed in any case).

A solution is a list of fillings with multiplicities. A filling taken as often
as possible leaves one of its lengths too rare for it, so a dive has at most
sum(window / length) = window * ln(window) of them, which bounds what travels
with the tasks. Pieces of one length are interchangeable: each is numbered
within its task when it is written, the counts of tasks give each task's first
number, and a piece's number gives its sequence and place. No ids are shuffled
unless they are asked for, and a length that a third of all documents share is
spread like any other.

Null text is the empty text: its document is the end id alone. A repeated
doc_id is packed once for each row; a null doc_id stays null. An empty table
gives no pieces. Columns other than doc_id and text are not read. Equal texts
may lie in different sequences; which ones is fixed by the input's order.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import materialize, ragged, run_sums, slices, table, text_array
from orrery.llm.packing import SLICE, Ids, alike, coded, words_apart

WINDOW, END_ID = 2048, 0
#: Branches and fillings that the search looks at before it returns its incumbent.
NODES = 50_000
#: Closings of a filling that are compared.
CLOSINGS = 4

Filling = tuple[int, ...]
Solution = list[tuple[Filling, int]]


def least_bins(counts: np.ndarray) -> int:
    """Martello and Toth's bound: sequences that pieces above half a sequence need, and what smaller ones do not fit beside them."""
    cap = len(counts) - 1
    lengths = np.arange(cap + 1)
    number, size = np.cumsum(counts), np.cumsum(counts * lengths)
    half = cap // 2
    k = np.arange(half + 1)
    alone = number[cap] - number[cap - k]
    beside = number[cap - k] - number[half]
    room = beside * cap - (size[cap - k] - size[half])
    small = size[half] - np.where(k > 0, size[np.maximum(k - 1, 0)], 0)
    return int((alone + beside + np.maximum(0, -((room - small) // cap))).max())


def best_fit(counts: np.ndarray) -> Solution:
    """Best-fit decreasing over counts: lengths from large to small, each into the fullest open sequence that has room."""
    cap = len(counts) - 1
    open_: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(filling: Filling, n: int, room: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((filling, n))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fits = cap // length
                if left >= fits:
                    put((length,) * fits, left // fits, cap - fits * length)
                if left % fits:
                    put((length,) * (left % fits), 1, cap - left % fits * length)
                break
            room = rooms[at]
            filling, n = open_[room].pop()
            fits = min(room // length, left)
            taken = min(n, left // fits)
            if n > taken:
                open_[room].append((filling, n - taken))
            elif not open_[room]:
                del open_[room], rooms[at]
            put(filling + (length,) * fits, taken, room - fits * length)
            left -= fits * taken
    return [x for found in open_.values() for x in found]


def largest_below(counts: np.ndarray) -> np.ndarray:
    """The largest length left that is at most i, for each i; 0 where there is none."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def better(filling: Filling, waste: int, counts: np.ndarray, below: np.ndarray) -> Filling | None:
    """A filling that dominates this one: a length left in place of up to three chosen ones, or beside them."""
    if waste and below[waste]:
        return (*filling, int(below[waste]))
    kinds = sorted(set(filling))
    for x in kinds:
        if below[x + waste] > x:
            return swapped(filling, (x,), int(below[x + waste]))
    has = Counter(filling)
    for i, x in enumerate(kinds):
        for y in kinds[i:]:
            if (x != y or has[x] > 1) and x + y < len(counts) and below[min(x + y + waste, len(counts) - 1)] >= x + y:
                return swapped(filling, (x, y), int(below[min(x + y + waste, len(counts) - 1)]))
            for z in kinds[kinds.index(y) :] if len(filling) <= 12 else ():
                s = x + y + z
                if not Counter((x, y, z)) - has and s < len(counts) and below[min(s + waste, len(counts) - 1)] >= s:
                    return swapped(filling, (x, y, z), int(below[min(s + waste, len(counts) - 1)]))
    return None


def swapped(filling: Filling, out: Filling, in_: int) -> Filling:
    left = list(filling)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, in_], reverse=True))


def without(counts: np.ndarray, filling: Filling) -> np.ndarray:
    left = counts.copy()
    for x in filling:
        left[x] -= 1
    return left


def closings(counts: np.ndarray, room: int) -> list[Filling]:
    """The fullest ways to end a filling with one or two lengths."""
    below = largest_below(counts[: room + 1])
    one = int(below[room])
    found: list[Filling] = [(one,)] if one else []
    a = np.flatnonzero(counts[: room + 1])[::-1]
    b = below[np.minimum(room - a, a)]
    again = (b == a) & (counts[a] < 2)
    b = np.where(again, below[np.maximum(np.minimum(room - a, a - 1), 0)], b)
    best = np.argsort(-(a + b), kind="stable")[:CLOSINGS]
    found += [(x, y) for x, y in zip(a[best].tolist(), b[best].tolist(), strict=True) if y]
    return sorted(found, key=lambda f: (-sum(f), len(f)))[:CLOSINGS]


def fillings(counts: np.ndarray, room: int) -> Iterator[Filling | None]:
    """All undominated fillings of the room from the lengths left, the likeliest first; None for each one that is dominated."""
    seen: set[Filling] = set()

    def settle(filling: Filling) -> Filling:
        while True:
            left = without(counts, filling)
            more = better(filling, room - sum(filling), left, largest_below(left))
            if more is None:
                return filling
            filling = more

    first: list[Filling] = []
    start: Filling = ()
    left, rest = counts.copy(), room
    while rest:  # the largest that fit, closed as well as can be by one or two
        top = int(largest_below(left[: rest + 1])[rest])
        if not top:
            break
        if rest <= 3 * top:
            first += [start + f for f in closings(left, rest)]
            if sum(first[-CLOSINGS if len(first) > CLOSINGS else 0]) == room or any(sum(f) == room for f in first):
                break
        n = max(1, min(int(left[top]), rest // top - 2))
        start += (top,) * n
        left[top] -= n
        rest -= n * top
    first.append(start)
    for filling in sorted((settle(tuple(sorted(f, reverse=True))) for f in first), key=lambda f: (-sum(f), len(f))):
        if filling not in seen:
            seen.add(filling)
            yield filling
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()

    def rest_of(i: int, rest: int, chosen: Filling) -> Iterator[Filling]:
        ended = True
        for j in range(i, len(lengths)):
            x = lengths[j]
            if x <= rest:
                ended = False
                for n in range(min(int(counts[x]), rest // x), 0, -1):
                    yield from rest_of(j + 1, rest - n * x, chosen + (x,) * n)
        if ended:
            yield chosen

    for filling in rest_of(0, room, ()):
        if filling not in seen:
            seen.add(filling)
            left = without(counts, filling)
            yield filling if better(filling, room - sum(filling), left, largest_below(left)) is None else None


def choices(counts: np.ndarray) -> Iterator[tuple[Filling, int] | None]:
    """Sequences around the largest length left: each filling as often as the counts allow, then once; None for a look in vain."""
    top = int(np.flatnonzero(counts)[-1])
    left = counts.copy()
    left[top] -= 1
    for filling in fillings(left, len(counts) - 1 - top):
        if filling is None:
            yield None
            continue
        whole = (top, *filling)
        most = min(int(counts[x]) // n for x, n in Counter(whole).items())
        yield whole, most
        if most > 1:
            yield whole, 1


def bin_completion(counts: np.ndarray, nodes: int = NODES) -> Solution:
    """Fillings with multiplicities that use up the counts (by length, 0 to the window) in as few sequences as found."""
    cap = len(counts) - 1
    counts = counts.astype(np.int64).copy()
    total = int((counts * np.arange(cap + 1)).sum())
    least = least_bins(counts)
    incumbent = best_fit(counts)
    most = sum(n for _, n in incumbent)
    if not total:
        return []
    path: list[tuple[Filling, int]] = []
    waste, allowed = 0, most * cap - total  # the first solution as good as best fit is taken, then only better ones
    stack = [choices(counts)]
    while stack and nodes:
        nodes -= 1
        step = next(stack[-1], ())
        if step is None:
            continue
        if not step:
            stack.pop()
            if path:
                filling, n = path.pop()
                waste -= n * (cap - sum(filling))
                for x in filling:
                    counts[x] += n
            continue
        filling, n = step
        more = waste + n * (cap - sum(filling))
        for x in filling:
            counts[x] -= n
        left = int((counts * np.arange(cap + 1)).sum())
        if more + least_bins(counts) * cap - left > allowed:
            for x in filling:
                counts[x] += n
            continue
        path.append(step)
        waste = more
        if left:
            stack.append(choices(counts))
            continue
        incumbent, most = list(path), sum(n for _, n in path)
        if most == least:
            break
        allowed = (most - 1) * cap - total
        filling, n = path.pop()
        waste -= n * (cap - sum(filling))
        for x in filling:
            counts[x] += n
    return incumbent


def cut(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids_crc32, ids (little-endian uint32), task and number (of that length in the task)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        size = max(tokenizer.get_vocab_size(), end_id + 1)
        kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        words, apart = Ids(tokenizer, kind), words_apart(tokenizer)
        task, met = TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            for part, plain in (y for x in slices(batch, text, SLICE) for y in alike(x, text, apart)):
                each, codes, bounds = coded(text_array(part, text), words, plain)
                length = np.fromiter(map(len, each), np.int64, len(each)) // kind.itemsize
                flat = np.frombuffer(b"".join(each), kind)
                starts = np.cumsum(length) - length
                counts = run_sums(length[codes], bounds)
                ids = flat[ragged(starts[codes], length[codes])]
                rows: list[tuple] = []
                for doc, e, n in zip(part.column(key).to_pylist(), np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                    own = np.append(ids[e - n : e], kind.type(end_id)).astype("<u4")
                    for i, start in enumerate(range(0, n + 1, window)):
                        piece = own[start : start + window]
                        raw = piece.tobytes()
                        rows.append((doc, i, start, len(piece), zlib.crc32(raw), raw, task, met[len(piece)]))
                        met[len(piece)] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "number"]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return df.select(key, text).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, number long")


def places(solution: Solution) -> dict[str, np.ndarray]:
    """For each filling and length: the numbers of that length that it takes, from `low` on, its first sequence, how many each takes, and where."""
    rows, taken, sequence = [], Counter(), 0
    for filling, n in solution:
        offset = 0
        for length, each in sorted(Counter(filling).items(), reverse=True):
            rows.append((length, taken[length], sequence, each, offset))
            taken[length] += n * each
            offset += length * each
        sequence += n
    cells = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "sequence", "each", "offset"), cells.T, strict=True))


def best_fit_pack(
    df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, nodes: int = NODES, ids: bool = True
) -> DataFrame:
    """The pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where asked for."""
    pieces = materialize(cut(df, tokenizer_path, key, text, window, end_id))
    counts = materialize(pieces.groupBy("length", "task").count())  # a row for each task and length
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    lengths = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # a row for each length, window at most
        lengths[r.length] = r.n
    where = places(bin_completion(lengths, nodes))
    own = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    numbered = pieces.join(bases, ["length", "task"]).select(*own, (F.col("base") + F.col("number")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (where["length"] << 48) + where["low"]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, (length << 48) + number, side="right") - 1
            sequence, slot = np.divmod(number - where["low"][at], where["each"][at])
            found = [pa.array(where["sequence"][at] + sequence), pa.array(where["offset"][at] + slot * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *found], names=[*own, "sequence_id", "offset"])

    kinds = {"piece": "int", "ids": "binary"}
    return numbered.mapInArrow(place, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in [*own, "sequence_id", "offset"]))


def op12_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


QUERIES = {"op12_bin_completion": op12_bin_completion}
