"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

Host and path are cut in DataFrame functions. The regression is trained on the
driver from the small labelled URL table below (fixed size, whatever the
corpus), and its weights, one float for each hash bucket, are broadcast
(256 KiB). Scoring is map-side only. The table is built from two lists of words,
in the same forms of host and path for both labels, so that words decide; no
word of it shares a stem with a bad host of the test tables, so what is found
there is found by parts of other words (README has the figure by row). A user
with labelled urls passes a table of theirs. Tests hold out a quarter of the
words at a time.

A rule such as `example.net/en/` fits its host and every subdomain where the
path starts with the rule's path; the longest rule wins. Null urls and urls
without `://` have empty host and path, fit no rule and are judged by the
regression on an empty string, which allows them. An empty table gives an empty
result; urls of any length are scored whole, in time linear in their length.
Repeated rows give repeated results; other columns pass through, and columns
named as the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import ascii_lower, run_sums, table

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
ROUNDS, RATE, RIDGE = 2000, 8.0, 1e-5
#: A url whose score reaches this is blocked where no rule fits it.
THRESHOLD = 0.5

#: The rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# Words of hosts to block, by kind (gambling, medicine, adult, mass mail, fraud, piracy), and of others, by subject.
BLOCKED = """
roulette blackjack jackpot slots poker bingo baccarat lottery craps keno wager bookmaker sportsbook parlay gamble croupier
viagra cialis kamagra levitra xanax tramadol valium steroids slimming diet detox keto testosterone enlargement baldness botox
porn hentai escorts nude erotic fetish milf lesbian hookup singles webcams strip nudity voyeur lingerie
bulkmail blackhat backlinks clickbait keywordstuffing popups popunder banners doorway cloaking instafollowers fakelikes robocall autoresponder
payday quickloan forex bitcoin doubler ponzi pyramid phishing malware ransomware keylogger trojan rootkit scam refund inheritance lottoprize
warez keygen serials torrents crack replica counterfeit knockoff fakewatches miracle giveaway sweepstakes coupons getrich makemoney homejob
""".split()
ALLOWED = """
chat forum wiki archive news paper politics encyclopedia library books university research science journal weather report museum health advice school calendar
gardening roses cooking recipes travel france music review film critic python tutorial source project mail server help
bank town branches railway stations astronomy planets bird species chemistry elements geography rivers sports results football chess club
medical animal shelter address harbour tides running routes spring homes kitchen public radio city council minutes philosophy essays
history society letters county parks loan novels reading room catalogue architecture bridges painting gallery
ministry forms linguist orchestra theatre parliament statistics economist hospital insurance theorem mountain national
carpentry joints bicycle repair bakery bread vineyard harvest fishing lakes sailing knots mathematics proofs physics energy biology cells
geology rocks poetry sonnets grammar verbs software releases database manual network compiler errors kernel security
embassy visa customs court rulings election census tables kindergarten songs scouts camps choir concerts orchard apples honey weaving looms
""".split()
# Forms of hosts with a word and another of its label, the same for both labels, so that words decide, and paths that hold the words.
HOSTS = ("{0}.com", "www.{0}.org", "{0}-{1}.net", "the{0}{1}.com", "blog.{1}-{0}.info", "{0}online.co.uk")
PATHS = ("/", "/index.html", "/{0}", "/2019/05/{1}.html", "/p/1234", "/about")


def labelled(words: Sequence[str]) -> list[tuple[str, str]]:
    """The hosts and paths of one label: every word in every form of host, beside the next word."""
    n = len(words)
    return [(host.format(w, words[(i + 1 + k) % n]), PATHS[(i + k) % len(PATHS)].format(w, words[(i + 2) % n])) for i, w in enumerate(words) for k, host in enumerate(HOSTS)]


def grams(text: bytes) -> np.ndarray:
    """Hash buckets of the character n-grams of the text between marks."""
    x = np.frombuffer(b"^" + text + b"$", np.uint8).astype(np.uint64)
    return np.concatenate([_rolled(x, n) for n in GRAMS])


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(0, len(x) - n + 1), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(1_099_511_628_211) + x[k : k + len(h)]
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BUCKETS


def key(host: str, path: str) -> bytes:
    """What the n-grams see: host, a mark, path."""
    return f"{host}|{path}".encode("utf-8", "surrogatepass")


Labelled = list[tuple[tuple[str, str], float]]


def small_table(blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED) -> Labelled:
    """(host, path) and label of each row of the module's own table."""
    return [(url, label) for words, label in ((blocked, 1.0), (allowed, 0.0)) for url in labelled(words)]


def train(urls: Labelled) -> np.ndarray:
    """Weights of the buckets, then the bias, by gradient descent on the ridge-penalised log loss; for a few thousand rows."""
    rows = [(key(*url), label) for url, label in urls]
    each = [grams(url) for url, _ in rows]
    sizes = np.array([len(g) for g in each])
    used, at = np.unique(np.concatenate(each), return_inverse=True)
    dense, y = np.zeros((len(rows), len(used)), np.float32), np.array([label for _, label in rows])
    np.add.at(dense, (np.repeat(np.arange(len(rows)), sizes), at), np.repeat(1.0 / np.sqrt(sizes), sizes))
    # There are fewer rows than buckets: the weights are sums of rows, and each row's share is what is learned.
    alike, share, bias = (dense @ dense.T).astype(np.float64), np.zeros(len(rows)), -1.0
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-(alike @ share + bias))) - y
        share -= RATE * (error / len(rows) + RIDGE * share)
        bias -= RATE * error.mean()
    out = np.zeros(BUCKETS + 1, np.float32)
    out[used], out[-1] = dense.T @ share, bias
    return out


def score(weights: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Probability that each url is one to block."""
    each = [grams(k) for k in keys]
    sizes = np.array([len(g) for g in each], np.int64)
    sums = np.add.reduceat(np.append(weights[np.concatenate(each)], 0), np.cumsum(sizes) - sizes) if len(keys) else np.zeros(0)
    sums = np.where(sizes > 0, sums, 0)
    return 1 / (1 + np.exp(-(sums / np.sqrt(np.maximum(sizes, 1)) + weights[-1])))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], part: int) -> Column:
    """The verdict (part 0) or the text (part 1) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule[1].partition("/")
        out = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}"), F.lit(rule[part])).otherwise(out)
    return out


def judge(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, urls: Labelled | None = None) -> DataFrame:
    """df with host, path, rule, block_score and verdict (replaced if there), learned from labelled urls, else from the small table."""
    df = df.drop("host", "path", "rule", "verdict", "block_score")
    host, path = host_and_path(F.col(url))
    cut = df.withColumns({"host": host, "path": path})
    shared = df.sparkSession.sparkContext.broadcast(train(small_table() if urls is None else urls))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = [key(h, p) for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(shared.value, keys).astype(np.float64))], names=[*part.schema.names, "block_score"])

    out = cut.mapInArrow(scored, T.StructType([*cut.schema.fields, T.StructField("block_score", T.DoubleType())]))
    by_rule = rule_of(F.col("host"), F.col("path"), rules, 0)
    learned = F.when(F.col("block_score") >= THRESHOLD, "block").otherwise("allow")
    return out.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules, 1), "verdict": F.coalesce(by_rule, learned)})


def op10_url_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


QUERIES = {"op10_url_ngrams": op10_url_ngrams}
