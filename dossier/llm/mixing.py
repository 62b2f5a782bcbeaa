"""Mixing sources to target weights by Poisson replication.

Every distinct text of a source is repeated a Poisson number of times with the mean that brings the source to its share of the
total tokens. The number is found by inverting the Poisson distribution, cut off at the source's cap, at a uniform number hashed
from the seed and the text, so it is the same in every run and for every partitioning. The rows are exploded by their counts and
put into one global pseudo-random order.

Defined results: null and blank texts are left out; sources without a target and rows with a null source are left out; targets
without a text are reported with an actual share of zero, and their share is spread over the others in proportion; a text that
several rows or sources hold is used as one text, of its least doc_id; sizes are counted over whole texts; an empty table gives no
rows and zero shares.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.session import bounded, settle

#: A public byte-level vocabulary as ranks; any other file of that form may be named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual split of that vocabulary before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A list of targets is a short table; a longer one is refused.
MOST_TARGETS = 10_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(path: str = VOCABULARY):
    """A vectorised UDF text -> number of tokens of the whole text."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path)
        return pd.Series([0 if t is None else len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return count


def _terms(rate: float, cap: int) -> list[float]:
    """P(number = k) for k below the cap, by logarithms: a great rate makes no term of the row vanish with the first."""
    if rate <= 0:
        return [1.0] + [0.0] * (cap - 1) if cap > 0 else []
    return [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(cap)]


def capped_mean(rate: float, cap: int) -> float:
    """The mean of a Poisson number of this rate, cut off at cap."""
    terms = _terms(rate, cap)
    return math.fsum(k * t for k, t in enumerate(terms)) + cap * max(0.0, 1.0 - math.fsum(terms))


def rate_for(mean: float, cap: int) -> float:
    """The rate at which the capped Poisson has this mean; at the cap itself every text is used cap times."""
    if mean <= 0 or cap <= 0:
        return 0.0
    low, high = 0.0, 60.0 + 4.0 * cap
    if mean >= capped_mean(high, cap):
        return high
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
        if high - low <= 1e-12 * high:
            break
    return (low + high) / 2


def cumulative(rate: float, cap: int) -> list[float]:
    """P(number <= k) for k below the cap; the count of a text is how many of these its uniform number reaches."""
    out, total = [], 0.0
    for term in _terms(rate, cap):
        total += term
        out.append(min(total, 1.0))
    return out


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[tuple[str, float, int, float, list[float]]]:
    """(source, share wanted, cap, mean, cumulative) of each target. total: tokens of the mix; by default the most that keeps every share."""
    present = [(s, w, c) for s, w, c in targets if w > 0 and c > 0 and sizes.get(s, 0) > 0]
    whole = sum(w for _, w, _ in present)
    if not present:
        return [(s, w, c, 0.0, []) for s, w, c in targets]
    if total is None:
        total = min(c * sizes[s] / (w / whole) for s, w, c in present)
    rows = []
    for s, w, c in targets:
        usable = w > 0 and c > 0 and sizes.get(s, 0) > 0
        mean = min(float(c), w / whole * total / sizes[s]) if usable else 0.0
        rows.append((s, w, c, mean, cumulative(rate_for(mean, c), c) if usable else []))
    return rows


def counted(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, text_key, n_tokens) of the least row of every distinct text of the targets' sources; stored."""
    listed = targets.select("source").where("source is not null").distinct()
    rows = documents.select("doc_id", "source", "text").where("text is not null and trim(text) <> ''").join(bounded(listed), "source", "left_semi")
    sized = rows.select("doc_id", "source", F.md5(F.encode("text", "utf-8")).alias("text_key"), token_count(vocabulary)("text").alias("n_tokens"))
    return settle(sized.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("r")).select("r.doc_id", "r.source", "text_key", "r.n_tokens"))


def copies(texts: DataFrame, targets: DataFrame, seed: int = 7, total: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, times): how often each text is used. texts as from counted()."""
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("c")).limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"over {MOST_TARGETS} targets")
    sizes = {r.source: int(r.n) for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a target
    rows = plan(sizes, [(r.source, float(r.w or 0), int(r.c or 0)) for r in wanted], total)
    steps = texts.sparkSession.createDataFrame([(s, f) for s, _, _, _, f in rows], "source string, steps array<double>")
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "text_key"), 11) / F.lit(float(1 << 53))
    times = F.size(F.filter("steps", lambda x: uniform >= x))
    return texts.join(F.broadcast(steps), "source").select("doc_id", "source", "n_tokens", times.alias("times"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens, text) in one global pseudo-random order."""
    used = copies(counted(documents, targets, vocabulary), targets, seed, total).where("times > 0")
    rows = documents.select("doc_id", "text").join(used, "doc_id").select("doc_id", "source", "n_tokens", "text", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"))
    return rows.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"), "doc_id", "copy_no").select("doc_id", "source", "copy_no", "n_tokens", "text")


def shares(documents: DataFrame, targets: DataFrame, seed: int = 7, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, target_share, texts, copies, tokens, actual_share): the share each source really got."""
    used = copies(counted(documents, targets, vocabulary), targets, seed, total)
    got = used.groupBy("source").agg(F.count_if(F.col("times") > 0).alias("texts"), F.sum("times").cast("bigint").alias("copies"), F.sum(F.col("times") * F.col("n_tokens")).alias("tokens"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = {"texts": 0, "copies": 0, "tokens": 0}
    rows = wanted.join(got, "source", "left").fillna(zero)
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row a target
    return rows.select("source", "target_share", "texts", "copies", "tokens", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)).alias("actual_share"))
