"""Evaluation texts leaking into training text: every document that holds a test item wholly or in good part.

A positional inverted index of the corpus (term, doc_id, position) is stored for the terms of the test items, where a term is a run
of a few words, and every run of an item is an anchor. Positions less the item's own are intersected: a document is a candidate if
enough anchors of one item fall at common offsets. Candidates are checked exactly, on whole texts: words of the item count as held
where they stand in a stretch of WINDOW aligned words of which nearly all agree.

No document that the exact check accepts is lost: a stretch with AGREE of WINDOW words equal has at most WINDOW - AGREE changed words,
whichever they are, so its equal words form runs of which some are long enough to be anchors; needs() gives the least number of
anchors at one offset, and the least part of the held words that anchors cover. Texts are read again for candidates only.

Defined results: null and empty texts hold nothing and leak nothing; items without a word are skipped; repeated documents and
repeated items are each reported; a document of any length is searched whole; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.session import bounded, cut, settle

#: An aligned word counts where WINDOW aligned words around it have at least AGREE equal ones.
WINDOW, AGREE = 14, 12
#: The share of an item's words that a document must hold.
SHARE = 0.48
#: Anchors at one offset are kept as bits in up to so many numbers, for items of up to 64 times as many words, and as a set beyond.
MOST_MASKS = 32
#: Test items are a fixed list; beyond this many rows they are joined by shuffle, not by broadcast.
SMALL_TERMS = 200_000


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, whatever stands between them; words broken at a line end are whole again."""
    joined = F.regexp_replace(F.lower(text), r"(?<=\p{L})[\-\u2010\u2011\u00AD][ \t]*\n[ \t]*(?=\p{L})|\u00AD", "")
    return F.filter(F.split(joined, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def needs(m: int) -> tuple[int, int, int, int, int]:
    """Of an item of m words: a stretch's width and its least equal words, the words of an anchor, the anchors that any such stretch has
    at one offset, and the words that anchors cover in any document that holds SHARE of the item, summed over offsets.

    The changed words of a stretch part its equal words into runs; all but one may be a word too short for an anchor. Where stretches
    overlap, any three changed words stand WINDOW apart, so of two neighbouring runs inside only one is short: the least part covered
    is that of runs of 3, 3, 9, 3 and 3 words, 9 of 21."""
    width = min(WINDOW, m)
    need = AGREE if width == WINDOW else max(1, int(width * AGREE / WINDOW))
    runs = width - need + 1
    run = -(-need // runs)
    least = need - runs * (run - 1)
    alone = need - (runs - 1) * (run - 1)  # covered words of a stretch alone
    part = Fraction(alone, need) if m <= WINDOW else Fraction(3, 7)
    return width, need, run, least, max(alone, ceil(Fraction(SHARE).limit_denominator(1000) * m * part))


def runs_of(words: Column, run: int) -> Column:
    """A hash for each word's run of so many words; those past the end are of fewer words and equal no whole run."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, run)]))


def positional_index(corpus: DataFrame, vocabulary: DataFrame, lengths: list[int]) -> DataFrame:
    """(term, run, doc_id, pos) of the corpus for the terms of the vocabulary, stored. corpus: doc_id, words. vocabulary: term, run."""
    wanted = bounded(vocabulary.select("term", "run").distinct(), SMALL_TERMS)
    found = [corpus.select("doc_id", F.posexplode(runs_of(F.col("words"), n)).alias("pos", "term")).join(wanted.where(F.col("run") == n), "term") for n in lengths]
    return settle(reduce(DataFrame.unionByName, found).select("term", "run", "doc_id", "pos"))


@F.udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("run", "least", "cover")]))
def _needs(m):
    return needs(m)[2:]


def anchors(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """(item_id, run, least, cover, term, at) and the lengths of runs: every run of the item's words, and what a stretch and a document need. items: item_id, words."""
    sized = cut(items.select("item_id", "words", _needs(F.size("words")).alias("n")).select("item_id", "words", "n.*"))
    lengths = [r.run for r in sized.select("run").distinct().collect()]  # four values at most
    if not lengths:
        return sized.select("item_id", "run", "least", "cover", F.lit(0).cast("bigint").alias("term"), F.lit(0).alias("at")), lengths
    whole = [sized.where(F.col("run") == n).select("item_id", "run", "least", "cover", F.size("words").alias("m"), F.posexplode(runs_of(F.col("words"), n)).alias("at", "term")).where(F.col("at") <= F.col("m") - n).drop("m") for n in lengths]
    return cut(reduce(DataFrame.unionByName, whole)), lengths


def held(item: list[str], doc: list[str]) -> float:
    """The share of the item's words that the document holds in order, in stretches of nearly equal words."""
    return matches(item, doc)[0]


def matches(item: list[str], doc: list[str]) -> tuple[float, int, int, bool]:
    """(share of the item's words held, place of the first at the offset that holds most, offsets at which stretches stand, whether one
    of them holds every word)."""
    m = len(item)
    if not m or not doc:
        return 0.0, -1, 0, False
    width, need, run, least, _ = needs(m)
    places = defaultdict(list)
    for i in range(m - run + 1):
        places[tuple(item[i : i + run])].append(i)
    starts = {w[0] for w in places}
    votes: Counter = Counter()
    for j, w in enumerate(doc):
        if w in starts:
            for i in places.get(tuple(doc[j : j + run]), ()):
                votes[j - i] += 1
    covered, first, offsets, most = np.zeros(m, bool), -1, 0, 0
    for delta, n in votes.items():  # an offset with a stretch of need equal words has so many whole runs
        if n < least:
            continue
        lo, hi = max(0, -delta), min(m, len(doc) - delta)
        same = np.zeros(m, bool)
        same[lo:hi] = [item[i] == doc[i + delta] for i in range(lo, hi)]
        sums = np.convolve(same, np.ones(width, int), "valid")
        found = np.nonzero(sums >= need)[0]
        for s in found:
            covered[s : s + width] |= same[s : s + width]
        if len(found):
            offsets += 1
            if same.sum() > most:
                most, first = int(same.sum()), int(found[0] + np.argmax(same[found[0] :])) + delta
    return float(covered.sum()) / m, first, offsets, most == m


@F.pandas_udf(T.StructType([T.StructField("share", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("stretches", T.LongType()), T.StructField("whole", T.BooleanType())]))
def _held(items: pd.Series, docs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([matches(list(a), list(b)) for a, b in zip(items, docs, strict=True)], columns=["share", "first_word", "stretches", "whole"])


_ALIGNED = ["item_id", "doc_id", "run", "least", "cover", "offset"]


def _by_sets(hits: DataFrame) -> DataFrame:
    """(item_id, doc_id, cover, n): the words that anchors cover at each offset with enough of them."""
    aligned = hits.groupBy(_ALIGNED).agg(F.collect_set("at").alias("at")).where(F.size("at") >= F.col("least"))  # at most an item's words
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x, x + F.col("run") - 1)))))
    return aligned.select("item_id", "doc_id", "cover", covered.alias("n"))


def _by_masks(hits: DataFrame, masks: int) -> DataFrame:
    """As _by_sets(), with a bit for each place of an item: the aggregate keeps numbers only."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at") % 64)
    ors = [F.bit_or(F.when(F.floor(F.col("at") / 64) == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}") for k in range(masks)]
    aligned = hits.groupBy(_ALIGNED).agg(*ors)
    anchors_there = sum((F.bit_count(f"m{k}") for k in range(masks)), F.lit(0))
    covered = F.lit(0)
    for k in range(masks):
        word = F.col(f"m{k}")
        for j in range(1, 4):  # an anchor of so many words covers the places after its own
            moved = F.shiftleft(f"m{k}", j)
            if k:
                moved = moved.bitwiseOR(F.shiftrightunsigned(f"m{k - 1}", 64 - j))
            word = word.bitwiseOR(F.when(F.col("run") > j, moved).otherwise(F.lit(0).cast("bigint")))
        covered = covered + F.bit_count(word)
    return aligned.where(anchors_there >= F.col("least")).select("item_id", "doc_id", "cover", covered.alias("n"))


def leaks(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, first_word, stretches, kind): the documents that hold an item, the share of its words held, where in the
    document the first of them stands at the offset that holds most, and in how many pieces; kind is phrase if the item stands there word for word, else proximity.
    corpus: doc_id, text; items: item_id, text."""
    worded = corpus.select("doc_id", terms(F.col("text")).alias("words"))
    items = items.select("item_id", terms(F.col("text")).alias("words")).where("size(words) > 0")
    chosen, lengths = anchors(items)
    index = positional_index(worded, chosen, lengths or [1])
    hits = index.join(bounded(chosen, SMALL_TERMS), ["term", "run"]).select("item_id", "doc_id", "run", "least", "cover", "at", (F.col("pos") - F.col("at")).alias("offset"))
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    aligned = _by_masks(hits, max(1, -(-longest // 64))) if longest <= 64 * MOST_MASKS else _by_sets(hits)
    candidates = aligned.groupBy("item_id", "doc_id", "cover").agg(F.sum("n").alias("n")).where(F.col("n") >= F.col("cover"))
    candidates = cut(candidates.select("item_id", "doc_id"))
    texts = corpus.select("doc_id", "text").join(bounded(candidates.select("doc_id").distinct(), SMALL_TERMS), "doc_id", "left_semi")
    share = _held.asNondeterministic()("item_words", "words")  # so that the filter on it does not compute it again
    pairs = candidates.join(bounded(items.select("item_id", F.col("words").alias("item_words"))), "item_id").join(texts.select("doc_id", terms(F.col("text")).alias("words")), "doc_id")
    kind = F.when(F.col("h.whole"), "phrase").otherwise("proximity")
    return pairs.select("doc_id", "item_id", share.alias("h")).where(F.col("h.share") >= SHARE).select("doc_id", "item_id", "h.share", "h.first_word", "h.stretches", kind.alias("kind"))
