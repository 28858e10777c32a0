"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams for the rest.

`add_host_path` and `add_rule` are column expressions. The model is trained from a small table of labelled URLs:
the n-grams of host and path, each in its own name space, are hashed to 2 ** BITS weights, each URL counts its
different n-grams once, and the classes weigh the same. A URL is scored inside an Arrow map that holds the weights,
so the whole job is one scan without a shuffle; the sample for training has a bound of its own.

Host: what stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up
to ``?``, ``#`` or the end. A null URL and one without ``://`` have neither, fit no rule and are judged by the bias alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm.common import fresh, picked, quoted

#: Verdict, host and the start of the path. These rules are fixed values of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words of the hosts in the small table of labelled URLs that the query's model is trained from. Chosen here; not tied to any data.
BLOCKED_WORDS = "casino poker bets betting jackpot slots lottery win pills pharmacy viagra meds adult sex porn xxx escort dating ads adserver track tracker clicks popup spam farm linkfarm seo loans payday replica cheap free warez torrent crack".split()
ALLOWED_WORDS = (
    "news press journal times herald university college school library museum archive science physics history garden kitchen recipes travel city town council forum wiki docs manual guide music film theatre books letters poems "
    "sport club chess health clinic doctor weather maps market bakery studio design craft wood stone river forest island harbour bridge castle church radio signal data code lab stat math bio art note shop house"
).split()
SYLLABLES = "an ber con der en fel gra hin is jor kel lor men nor on per qua rin sh ther tion ul ver whe xen yon zel".split()
#: Labelled URLs of either verdict that train a model, at most.
SAMPLE_URLS = 2_000
BITS = 16
GRAMS = (2, 3, 4, 5)
#: Steps of the descent, and the weight of the penalty on squared weights.
STEPS, PENALTY = 300, 1e-4
#: A URL whose probability of being blocked is this or more is blocked.
BOUND = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rules = tuple[tuple[str, str, str], ...]


def add_host_path(df: DataFrame, url_col: str, host: str = "host", path: str = "path") -> DataFrame:
    """df with the host and the path of its URLs behind its own columns, which must not have these names."""
    url, rest = fresh(df, "_url", "_rest")
    at = F.locate("://", quoted(url))
    after = F.when(at > 0, F.substring(quoted(url), at + 3, F.length(quoted(url)))).otherwise("")
    cut = df.withColumn(url, quoted(url_col).cast("string")).withColumn(rest, after)
    return cut.withColumns(
        {host: F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), path: F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)}
    ).drop(url, rest)


def rule_of(host: Column, path: Column, rules: Rules = RULES) -> Column:
    """The longest rule that fits, as a struct of rule (host and path in one) and verdict, or null.

    A rule fits its host and all hosts below it, if the path starts with the rule's. Of rules of one length the one
    of the longer host counts, then a block.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of the different hashed n-grams of each URL, in order; n-grams are of bytes, ends marked."""
    parts = [b for h, p in zip(hosts, paths, strict=True) for b in (f"\x02{h}\x03".encode(), f"\x02{p}\x03".encode())]
    sizes = np.array([len(b) for b in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    part = np.repeat(np.arange(len(parts)), sizes)
    rows, cells = [], []
    hashed = (part % 2 + 1).astype(np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if n > len(data):
            break
        hashed = hashed[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            inside = part[: len(data) - n + 1] == part[n - 1 :]
            mixed = (hashed[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            rows.append(part[: len(data) - n + 1][inside] // 2)
            cells.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique((np.concatenate(rows) << BITS) + np.concatenate(cells))
    return both >> BITS, both & ((1 << BITS) - 1)


def probabilities(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The probability that each URL is one to block; weights: of the features, then the bias."""
    row, cell = features(hosts, paths)
    count = np.bincount(row, minlength=len(hosts))
    total = np.bincount(row, weights[cell], minlength=len(hosts)) / np.sqrt(np.maximum(count, 1)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(hosts: list[str], paths: list[str], blocked: list[bool]) -> np.ndarray:
    """Weights by gradient descent with momentum over the whole sample; of one class alone or of nothing, only a bias."""
    y = np.asarray(blocked, float)
    weights = np.zeros((1 << BITS) + 1)
    if not 0 < y.sum() < len(y):
        weights[-1] = 4.0 if y.any() else -4.0
        return weights
    row, cell = features(hosts, paths)
    value = 1 / np.sqrt(np.bincount(row, minlength=len(y)))[row]
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    speed = np.zeros_like(weights)
    for _ in range(STEPS):
        ahead = weights + 0.9 * speed
        total = np.bincount(row, ahead[cell] * value, minlength=len(y)) + ahead[-1]
        error = (1 / (1 + np.exp(-total)) - y) * share
        slope = np.bincount(cell, error[row] * value, minlength=1 << BITS)
        speed = 0.9 * speed - 2.0 * (np.append(slope, error.sum()) + PENALTY * ahead)
        weights = weights + speed
    return weights


def train(labelled: DataFrame, url_col: str = "url", verdict_col: str = "verdict", sample: int = SAMPLE_URLS) -> np.ndarray:
    """A model from a table of URLs and verdicts (allow, block), of at most `sample` different URLs of either.

    The sample is that of the smallest hashes of host and path; it is all that comes to the driver. Rows with
    another verdict or none don't count. Without an example of either verdict all is allowed.
    """
    rows = add_host_path(picked(labelled, url=url_col, verdict=verdict_col), "url")
    hosts, paths, blocked = [], [], []
    different = rows.filter(F.col("verdict").isin("allow", "block")).select("verdict", "host", "path").distinct()
    for verdict in ("allow", "block"):
        for r in different.filter(F.col("verdict") == verdict).orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample).collect():
            hosts.append(r.host)
            paths.append(r.path)
            blocked.append(verdict == "block")
    return fit(hosts, paths, blocked)


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = probabilities(weights, batch.column("host").to_pylist(), batch.column("path").to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])


def judge(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", url_col: str = "url", rules: Rules = RULES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict and score, the model's probability of a URL to block.

    The verdict is that of the rule, where one fits, else the model's. Repeated rows, null ids and null, empty or very
    long URLs get a row like any other; an empty table gives none. No column but id and URL is read, so none can clash.
    """
    rows = add_host_path(picked(pages, id=id_col, url=url_col), "url").drop("url")
    kind = pages.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(partial(_score, weights=weights), f"id {kind}, host string, path string, score double")
    found = scored.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("score") >= BOUND, "block").otherwise("allow"))
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small table of labelled URLs: hosts of one or two words of a kind, or of syllables, which are allowed; alike in all the rest."""
    n = len(SYLLABLES)
    made = ["".join(SYLLABLES[(i * k + i // n) % n] for k in (1, 3, 7)[: 2 + i % 2]) for i in range(6 * n)]
    hosts = [(v, h) for v, words in (("block", BLOCKED_WORDS), ("allow", ALLOWED_WORDS)) for i, w in enumerate(words) for h in (w, f"{w}-{words[i - 1]}", f"{words[i - 2]}-{w}", f"{w}{words[i - 3]}")]
    hosts += [("allow", h) for h in made]
    rows = []
    for i, (verdict, host) in enumerate(hosts):
        sub, top, lang = ("", "www.", "m.", "blog.")[i % 4], ("com", "net", "org", "example.com", "example.net")[i % 5], ("en", "de", "fr", "es")[i // 2 % 4]
        rows.append((f"http{'s' * (i % 2)}://{sub}{host}.{top}/{lang}/{i * 7919 % 10**(1 + i % 6)}{('', '/', '.html')[i % 3]}", verdict))
    return spark.createDataFrame(rows, "url string, verdict string")


def op12_urls(spark, sf_dir: str) -> DataFrame:
    """Rules first; URLs that none fits are judged by a model trained from the small table of labelled URLs."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(labelled_urls(spark)))
