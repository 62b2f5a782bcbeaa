"""Pages that are copies of each other apart from small edits, by a token-group matrix.

A page is the set of its words, whatever their order and line breaks. All its words enter its row of the matrix, a bitmap of BITS
hashed tokens, and all its words are drawn from for its BANDS keys of ROWS minima each. The method goes in four steps:

1. Pages with equal word sets are one: the least of them represents the others.
2. Pages are partitioned into similar groups: every page that shares a key with others is compared with the least page of that key's
   bucket, and components of the agreeing pairs are groups. This is linear in pages, however large a bucket is.
3. The matrix stores the union of the tokens of each group, in blocks of about BLOCK pages, so that the union of a large group does
   not fill up. In buckets where several groups meet, each page of the smaller group is held against the blocks of the larger: the
   tokens it shares with a block's union bound its overlap with any member from above. The bound is exact: hashed tokens may only
   raise it. Blocks that cannot reach SIMILAR stay closed.
4. The members of opened blocks are bounded one by one in the same way, and what is left is compared exactly, by the Dice share of
   common words. Linked pages form classes.

No page, word or pair is dropped by frequency, length, or cap: what may be missed is only a pair without a common key. Two pages of
Dice 0.9 have one of all 48 keys in common with a probability of 0.9998, of 0.85 with 0.96, of just 0.8 with 0.71; classes are transitive, so a
copy is lost only if it has no common key with any of its class. Measured against brute force in tests/llm.

Pages that share a key by chance number N * J ** ROWS, where J is the overlap of pages of one form (0.12 on average in the test tables):
0.1 a page and key at 250,000 pages. They are closed by the bound, before texts are read.

Defined results: null texts and pages of under LEAST_WORDS words have no copies; repeated pages are copies; page_id repeated in the
input counts once; an empty table gives an empty result; texts of any length are compared whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.graph import components
from dossier.session import bounded, cut, settle

LEAST_WORDS = 60
#: Two pages are copies from this Dice share of their distinct words.
SIMILAR = 0.8
#: Keys of a page, and the minima over all its words that make up a key.
BANDS, ROWS = 48, 9
#: Bits of a row of the matrix.
BITS = 1024
#: Pages in a block of a group's union, on average.
BLOCK = 16
#: Page ids of candidate pairs are broadcast to the second reading of texts up to this number, and joined by shuffle beyond.
FEW_IDS = 200_000

_BREAK = re.compile(r"(?<=[^\W\d_])[\-\u2010\u2011\u00ad][ \t]*\n[ \t]*(?=[^\W\d_])|\u00ad")
_MARKS = ".,;:()[]{}|'\"`\u2018\u2019\u201c\u201d\u00ab\u00bb-\u2013\u2014_/\\!?*#~<>=+&%$\u20b9"


def words(text: str) -> set[str]:
    """Distinct lower-case words, whole across line ends, without marks around them."""
    found = {w if w.isalnum() else w.strip(_MARKS) for w in set(_whole(text).split())}
    found.discard("")
    return found


def _whole(text: str) -> str:
    """The text in lower case with the words that line ends break put together."""
    text = text.lower()
    if "-\n" in text or "- \n" in text or "\u2010" in text or "\u2011" in text or "\u00ad" in text:
        return _BREAK.sub("", text)
    return text


_ODD = np.random.default_rng(6).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.random.default_rng(7).integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64(0x9E3779B97F4A7C15)


def keys_of(found: np.ndarray) -> np.ndarray:
    """The band keys of a page's word hashes."""
    low, least = found.astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):  # a very long text needs no more memory than others
        np.minimum(least, (low[None, at : at + 4096] * _ODD[:, None]).min(axis=1), out=least)
    keys = (least.astype(np.uint64).reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return ((keys ^ (keys >> np.uint64(29))) * _LAST).view(np.int64)


def bits_of(found: np.ndarray) -> np.ndarray:
    """The page's row of the matrix: one bit for each hashed word."""
    row = np.zeros(BITS, np.uint8)
    row[(found >> np.uint64(40)) % np.uint64(BITS)] = 1
    return np.packbits(row).view(np.int64)


def _long_enough(text: str) -> bool:
    return len(text.split(None, LEAST_WORDS)) >= LEAST_WORDS


def hashed(found: set[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def eligible(pages: DataFrame) -> DataFrame:
    """(page_id, text) of the pages that may have enough words; tasks count them."""
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "text").where(F.col("page_id").isNotNull() & (F.length("text") >= 2 * LEAST_WORDS - 1))


def _lists(rows: list[np.ndarray], width: int) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.array([], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(flat, pa.int64()))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, first, second, keys, bits = [], [], [], [], [], []
        for page_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = hashed(words(text)) if _long_enough(text) else ()
            if not len(found):
                continue
            whole = np.frombuffer(xxhash.xxh3_128_digest(np.sort(found).tobytes()), np.int64)
            ids.append(page_id)
            sizes.append(len(found))
            first.append(int(whole[0]))
            second.append(int(whole[1]))
            keys.append(keys_of(found))
            bits.append(bits_of(found))
        longs = [pa.array(x, pa.int64()) for x in (ids, sizes, first, second)]
        yield pa.RecordBatch.from_arrays([*longs, _lists(keys, BANDS), _lists(bits, BITS // 64)], names=["page_id", "n", "h1", "h2", "keys", "bits"])


def marked(texts: DataFrame) -> DataFrame:
    """(page_id, n, h1, h2, keys, bits) of every page of enough words: its number of words, a digest of the set, its keys and its row; stored."""
    return settle(texts.mapInArrow(_mark, "page_id bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>, bits array<bigint>"))


def _shared(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[k].bitwiseAND(b[k])) for k in range(BITS // 64)), F.lit(0))


def _filled(a: Column) -> Column:
    return sum((F.bit_count(a[k]) for k in range(BITS // 64)), F.lit(0))


def reaching(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) whose rows allow SIMILAR. Words that fall on one bit are added on the side that has fewer of them."""
    a = rows.select(F.col("page_id").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu"))
    b = rows.select(F.col("page_id").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv"))
    most = _shared(F.col("bu"), F.col("bv")) + F.least(F.col("nu") - _filled(F.col("bu")), F.col("nv") - _filled(F.col("bv")))
    return pairs.join(a, "u").join(b, "v").where(2 * most >= SIMILAR * (F.col("nu") + F.col("nv"))).select("u", "v").distinct()


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"page_id": batch["page_id"], "ws": [hashed(words(t)).view(np.int64).tolist() for t in batch["text"]]})


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose pages agree in SIMILAR of their words; only the pages of candidate pairs are read again."""
    ids = cut(pairs.select(F.col("u").alias("page_id")).unionByName(pairs.select(F.col("v").alias("page_id"))).distinct())
    bags = settle(texts.join(bounded(ids, FEW_IDS), "page_id", "left_semi").groupBy("page_id").agg(F.max("text").alias("text")).mapInPandas(_bags, "page_id bigint, ws array<bigint>"))
    both = pairs.join(bags.select(F.col("page_id").alias("u"), F.col("ws").alias("a")), "u").join(bags.select(F.col("page_id").alias("v"), F.col("ws").alias("b")), "v")
    dice = 2 * F.size(F.array_intersect("a", "b")) / (F.size("a") + F.size("b"))
    return both.where(dice >= SIMILAR).select("u", "v")


def buckets(reps: DataFrame) -> DataFrame:
    """(key, page_id, leader, n): the pages of every bucket of two or more, with its least page and its size; stored. One shuffle of (page_id, key)."""
    spread = reps.select("page_id", F.explode("keys").alias("key")).repartition("key")
    several = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("leader")).where("n > 1 and leader is not null")
    return settle(spread.join(several.hint("shuffle_hash"), "key").select("key", "page_id", "leader", "n"))


def opened(met: DataFrame, groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v): pages of buckets in which groups meet, with the pages of the other groups' blocks that the matrix does not close."""
    grouped = met.where("n > 2").join(groups, F.col("page_id") == F.col("id"), "left").select("key", "page_id", F.coalesce("component", "page_id").alias("grp"))
    mixed = grouped.groupBy("key").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).where("a <> b").select("key")
    grouped = cut(grouped.join(mixed, "key"))
    members = grouped.select("page_id", "grp").distinct()
    sizes = members.groupBy("grp").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("page_id"), F.ceil(F.col("size") / BLOCK))
    blocks = cut(members.join(sizes, "grp").select("page_id", "grp", "size", F.xxhash64("grp", part).alias("block")))
    unions = F.array(*[F.bit_or(F.col("bits")[k]) for k in range(BITS // 64)])
    matrix = blocks.join(rows.select("page_id", "n", "bits"), "page_id").groupBy("block").agg(F.min("n").alias("least"), unions.alias("union"))
    placed = grouped.select("key", "page_id").join(blocks, "page_id")
    asked = placed.select("key", F.col("page_id").alias("q"), F.struct("size", "grp").alias("smaller"))
    there = placed.select("key", "block", F.struct("size", "grp").alias("larger")).distinct()
    contacts = asked.join(there, "key").where("smaller < larger").select("q", "block").distinct()
    held = contacts.join(rows.select(F.col("page_id").alias("q"), "n", "bits"), "q").join(matrix, "block")
    bound = _shared(F.col("bits"), F.col("union")) + F.col("n") - _filled(F.col("bits"))
    qualifying = held.where(2 * bound >= SIMILAR * (F.col("n") + F.col("least"))).select("q", "block")
    pairs = qualifying.join(blocks.select("block", "page_id"), "block")
    return pairs.select(F.least("q", "page_id").alias("u"), F.greatest("q", "page_id").alias("v")).distinct()


def classes(pages: DataFrame) -> DataFrame:
    """(page_id, class_id, links): the class of every page that has a copy, and its links to pages of the class that were compared."""
    texts = eligible(pages)
    everyone = marked(texts)
    rows = everyone.select("page_id", "n", "bits")
    same = everyone.select("page_id", "h1", "h2")
    least = same.groupBy("h1", "h2").agg(F.min("page_id").alias("rep"), F.max("page_id").alias("last")).where("rep <> last").select("h1", "h2", "rep")
    twins = cut(same.join(least, ["h1", "h2"]).where("page_id <> rep").select(F.col("rep").alias("u"), F.col("page_id").alias("v")).distinct())
    reps = everyone.select("page_id", "keys").join(bounded(twins.select(F.col("v").alias("page_id")), FEW_IDS), "page_id", "left_anti")
    met = buckets(reps)
    stars = met.where("page_id <> leader").select(F.col("leader").alias("u"), F.col("page_id").alias("v")).distinct()
    first = cut(similar(cut(reaching(stars, rows)), texts))
    found = reaching(opened(met, components(first), rows), rows).join(first, ["u", "v"], "left_anti")
    links = cut(twins.unionByName(first).unionByName(similar(cut(found), texts)).distinct())
    member = components(links)
    degree = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    return member.join(degree, "id").select(F.col("id").alias("page_id"), F.col("component").alias("class_id"), "links")


def with_files(grouped: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, class_id, links, source_file, same_file): whether the page's file is the representative's, small changes of its name aside: letter case, separators, numbers and the ending."""
    files = pages.groupBy("page_id").agg(F.max("source_file").alias("source_file"))
    plain = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"\.\w{1,4}$", "")), r"[^\p{L}]+", "")
    first = files.select(F.col("page_id").alias("class_id"), F.col("source_file").alias("first_file"))
    rows = grouped.join(files, "page_id").join(first, "class_id")
    return rows.select("page_id", "class_id", "links", "source_file", plain(F.col("source_file")).eqNullSafe(plain(F.col("first_file"))).alias("same_file"))


def copy_pairs(grouped: DataFrame) -> DataFrame:
    """(page_id_a, page_id_b): all pairs of pages of one class."""
    a = grouped.select("class_id", F.col("page_id").alias("page_id_a"))
    b = grouped.select("class_id", F.col("page_id").alias("page_id_b"))
    return a.join(b, "class_id").where("page_id_a < page_id_b").select("page_id_a", "page_id_b")
