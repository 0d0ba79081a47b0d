"""Secret scans: parts of credentials, linked where complementary parts meet.

Strong spans are found on their own: `assign` (a named password, token or key
and its value), `access` (an access-key identifier) and `hex` (a long hex run).
Weak candidates tell little alone: `key` (a bare base-64 run as long as a secret
key, mixed in letter case with a digit), `short` (a named password, token or key
with a value too short to be strong), `account` (a named user, login or client,
or a mail address) and `endpoint` (a URL, a host name with a port or with an
ending that only hosts have, or an IP address; `os.path`, `self.token` and
`README.md` are none).

Linking is an interval join of the parts of a document with those that complete
them: the scope of a part is its span and SCOPE characters on either side, and
two parts meet where one reaches into the other's scope. A weak candidate is
reported only where it meets a complementary part; MEETS names those of each
kind. Scopes never leave a document, so the join is merged inside its row: its
parts are sorted by start, and the furthest end before a part and the nearest
start after it, among its complementary parts, decide. That costs one pass for
each kind, however many parts meet, and no shuffle.

Only DataFrame functions run. Matches and their places come from splitting the
text at the pattern: pieces and matches alternate, so running lengths are the
places, in code points. Running values are taken in two tiers, so the work
grows with a text's matches and not with their square. Null text is the empty
text; null and repeated ids and equal rows stay rows of their own; other
columns pass through; an empty table gives an empty result. Of overlapping
parts of one kind the leftmost counts; parts of different kinds may overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import table

#: Characters between two parts that still belong together.
SCOPE = 256
#: Entries that running values are taken over at once, and code points of a block of text.
TIER, BLOCK = 64, 1024

# Endings of host names that no attribute or file name has, and host names by ending, with a port, and as addresses.
ENDINGS = "com|org|net|edu|gov|internal|example|de|fr|es|uk|eu"
NAMED_HOST = rf"[A-Za-z0-9][A-Za-z0-9.-]*\.(?:{ENDINGS})(?::\d{{1,5}})?(?![A-Za-z0-9_@(\[-]|\.[A-Za-z0-9])"
PORT_HOST = r"[A-Za-z0-9][A-Za-z0-9-]*\.[A-Za-z0-9.-]*:\d{3,5}(?![A-Za-z0-9_])"
ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d{1,5})?(?![A-Za-z0-9_.-])"

# The kinds in their order, and each pattern with the kinds that its group's least length tells, longest first.
STRONG = ("assign", "access", "hex")
WEAK = ("key", "short", "account", "endpoint")
PATTERNS = (
    (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", (("assign", 12), ("short", 4))),
    (r"(AKIA[A-Z0-9]+)", (("access", 18),)),
    (r"(?<![0-9a-f])([0-9a-f]{16,})", (("hex", 16),)),  # runs of the least length are the same matches, since a run is matched whole
    (r"(?<![A-Za-z0-9+/_.=-])(?=[0-9+/A-Z]*[a-z])(?=[0-9+/a-z]*[A-Z])(?=[+/A-Za-z]*[0-9])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/_.=-])", (("key", 40),)),
    (r"((?i:user(?:name|_?id)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@+-]+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,})", (("account", 3),)),
    (rf"(https?://[^\s\"'<>]+|(?<![A-Za-z0-9_.@-])(?:{NAMED_HOST}|{PORT_HOST}|{ADDRESS}))", (("endpoint", 4),)),
)
#: The parts that complete a weak candidate.
MEETS = {
    "key": ("access", "account", "endpoint"),
    "short": ("access", "account", "endpoint"),
    "account": ("assign", "key", "short"),
    "endpoint": ("assign", "access", "key", "short"),
}
KINDS = (*STRONG, *WEAK)
#: What masking removes: the secrets, not the accounts and endpoints that told them.
MASKED = (*STRONG, "key", "short")
SPAN = "struct<kind:string,start:bigint,end:bigint>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Of each of the non-negative values what `step` (associative, 0 its neutral value) makes of those before it.

    Each tier of TIER values runs on its own and is offset by the tiers before it, as growing one array value by value
    copies it each time.
    """
    zero = F.array(F.lit(0).cast("bigint"))
    grow = lambda xs: F.aggregate(xs, zero, lambda s, x: F.concat(s, F.array(step(F.element_at(s, -1), x))))
    tiers = lambda v: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / TIER).cast("int")), lambda i: grow(F.slice(v, i * TIER + 1, TIER)))

    def offset(inner: Column) -> Column:
        bases = grow(F.transform(inner, lambda t: F.element_at(t, -1)))
        shifted = F.zip_with(inner, F.slice(bases, 1, F.size(inner)), lambda t, b: F.transform(F.slice(t, 1, F.size(t) - 1), lambda x: step(b, x)))
        return F.flatten(shifted)

    return let(let(values, tiers), offset)


def spans_of(text: Column, pattern: str, kinds: tuple[tuple[str, int], ...]) -> Column:
    """All leftmost matches, non-overlapping, whose group is long enough for one of the kinds: an array of (kind, start, end)."""
    sizes = lambda x: F.struct(F.char_length(x["gap"]).cast("bigint").alias("gap"), F.char_length(x["whole"]).cast("bigint").alias("whole"), F.char_length(x["group"]).alias("group"))
    pieces, whole, group = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    parts = F.transform(F.filter(F.arrays_zip(pieces.alias("gap"), whole.alias("whole"), group.alias("group")), lambda x: x["whole"].isNotNull()), sizes)

    def span(x: Column, at: Column) -> Column:
        kind = F.coalesce(*(F.when(x["group"] >= least, name) for name, least in kinds))
        start = at + x["gap"]
        return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), start.alias("start"), (start + x["whole"]).alias("end")))

    placed = let(parts, lambda p: F.zip_with(p, running(F.transform(p, lambda x: x["gap"] + x["whole"]), lambda a, b: a + b), span))
    found = F.filter(placed, lambda x: x.isNotNull())
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


#: Beyond every place in a text.
FAR = 1 << 40


def met(parts: Column, kind: str, scope: int) -> Column:
    """Of each part, in order of start, whether it is a weak candidate of the kind that meets a part that completes it."""
    completes = lambda p: p["kind"].isin(*MEETS[kind])
    ends = F.transform(parts, lambda p: F.when(completes(p), p["end"]).otherwise(0).cast("bigint"))
    starts = F.transform(F.reverse(parts), lambda p: F.when(completes(p), FAR - p["start"]).otherwise(0).cast("bigint"))
    behind, ahead = running(ends, F.greatest), F.reverse(running(starts, F.greatest))
    near = F.zip_with(behind, ahead, lambda b, a: F.struct(b.alias("end"), (FAR - a).alias("start")))
    return F.zip_with(parts, near, lambda p, n: (p["kind"] == kind) & (((n["end"] > 0) & (n["end"] >= p["start"] - scope)) | (n["start"] <= p["end"] + scope)))


def told(parts: Column, scope: int) -> Column:
    """The parts that are reported, of parts in order of start: strong ones, and weak ones that meet their complement."""
    flags = F.transform(parts, lambda p: p["kind"].isin(*STRONG))
    for kind in WEAK:
        flags = F.zip_with(flags, met(parts, kind, scope), lambda a, b: a | b)
    return F.transform(F.filter(F.zip_with(parts, flags, lambda p, f: F.struct(p.alias("p"), f.alias("f"))), lambda x: x["f"]), lambda x: x["p"])


def linked(docs: DataFrame, keep: list[str], text: str = "text", scope: int = SCOPE, out: str = "spans") -> DataFrame:
    """The columns `keep` and `out`: an array of (kind, start, end) of each row, weak candidates only where they are linked."""
    value = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(*keep, F.concat(*(spans_of(value, *p) for p in PATTERNS)).alias("__parts"))
    parts = F.col("__parts")
    # A part alone meets nothing.
    settled = F.filter(parts, lambda p: p["kind"].isin(*STRONG))
    merged = F.when((F.size(parts) < 2) | ~F.exists(parts, lambda p: p["kind"].isin(*WEAK)), in_order(settled)).otherwise(let(in_order(parts), lambda p: told(p, scope)))
    return found.select(*keep, merged.alias(out))


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*STRONG))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def between(blocks: Column, a: Column, b: Column) -> Column:
    """The text from a to b (code points, a <= b), of a text cut into blocks of BLOCK code points."""
    i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
    of = lambda block, start, n: F.substring(F.coalesce(F.get(blocks, block), F.lit("")), (start + 1).cast("int"), n.cast("int"))
    inner = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(i == j, of(i, a % BLOCK, b - a)).otherwise(F.concat(of(i, a % BLOCK, F.lit(BLOCK)), inner, of(j, F.lit(0), b % BLOCK)))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each run of overlapping spans, given by start, replaced by the mask."""
    before = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    gaps = F.zip_with(spans, before, lambda s, b: F.when(s["start"] >= b, F.struct(b.alias("from"), s["start"].alias("to"))))
    last = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("from"), F.char_length(text).cast("bigint").alias("to"))
    kept = F.concat(F.filter(gaps, lambda g: g.isNotNull()), F.array(last))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    pieces = let(blocks, lambda x: F.transform(kept, lambda g: between(x, g["from"], g["to"])))
    return F.when(F.size(spans) > 0, F.array_join(pieces, mask)).otherwise(text)


def without_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the secrets of every text masked; what only tells of them (accounts, endpoints) and rows without any stay as they are."""
    keep = docs.columns
    found = linked(docs, keep, text, out="__spans")
    secret = F.filter("__spans", lambda s: s["kind"].isin(*MASKED))
    return found.withColumn(text, masked(F.col(text), secret)).select(*keep)


def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select(
        "doc_id", *(count_of(F.col("spans"), k).alias(f"n_{k}") for k in STRONG),
        F.sha2(written(base_only(F.col("spans"))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


QUERIES = {"op6_linked_secrets": op6_linked_secrets}
