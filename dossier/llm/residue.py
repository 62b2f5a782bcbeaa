"""Template residue and error-page text: records with unfilled placeholders, filler, or a web page's message in place of content.

Positive-unlabelled naive Bayes. A text is cut into passages (lines and sentences). Passages with one of a few unmistakable marks
(SEEDS) are trusted positives; all others are unlabelled. Expectation-maximisation over every passage of the corpus estimates the
distributions of words, word pairs and shapes (a word between signs, doubled signs, rows of X) in residue and in content: trusted
passages keep probability one, the others are re-scored each round until the expected number of residue passages stands still. So
the model finds the kinds of residue that no seed names, by the sentences, words and shapes that they share with others. Features are
hashed into a fixed number of buckets, so what travels between tasks and driver has one size for any corpus. A record is residue if
any of its passages is.

Estimates are smoothed towards the whole corpus, so that a feature says nothing until it has been seen, whatever its rarity.

Defined results: null and empty texts are content; repeated texts get equal decisions; very long texts are scored passage by
passage; a passage of one word is residue only if it is trusted; an empty table gives an empty result; without any trusted passage
nothing is residue.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.session import settle

BUCKETS = 1 << 19
#: Rounds end when the expected residue passages change by less than this part, or after MOST_ROUNDS.
STILL, MOST_ROUNDS = 1e-3, 12
#: Every class counts so many features of the whole corpus besides its own.
SMOOTHING = 50.0
#: Residue needs this probability.
THRESHOLD = 0.9

#: Ends of passages: line breaks, sentence ends (but not 'Rs.') and the reference number that closes a heading.
_BREAKS = re.compile(r"\n+|(?<=[.!?।])(?<!\bRs\.)(?<!\bNo\.)\s+|(?<=/\d{4}-\d{2})\s+")

# Marks that only residue has, enough to start from; what else there is the model finds.
SEEDS = {
    "slot": [r"\{\{[^{}\n]*\}\}", r"\[(?:insert|enter|your|name of|type|add|fill|put|select|specify)\b[^\]\n]{0,60}\]"],
    "filler": [
        r"\blorem ipsum\b", r"\bx{4,}(?:\s+x{4,}){2,}", r"\b(?:asdf|qwerty)\b\s+\b(?:asdf|qwerty|test)\b", r"\b(?:dummy|filler|placeholder) (?:content|text|copy)\b", r"\breplace this (?:paragraph|text|sentence|section) with\b",
        r"\bblind copy\b.*\bcolumn\b", r"\b(?:your )?text (?:goes )?here\b\W*$", r"^\W*(?:type|enter|write|put) (?:the|your) [\w ]{2,30} here\b",
    ],
    "message": [
        r"\b(?:400|401|403|404|405|408|410|429|500|501|502|503|504)\b\s*[:\-|]?\s*(?:bad request|unauthori[sz]ed|forbidden|not found|page not found|method not allowed|request timeout|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|error)\b",
        r"\byour session (?:has|had|is) (?:been )?(?:expired|timed out|ended|closed|over)\b", r"\b(?:please )?(?:enable|turn on|switch on|activate|allow) (?:javascript|java script|scripts|cookies)\b(?! in the browser and)", r"\bcookies must be (?:switched on|enabled|turned on|allowed)\b",
        r"\bchecking your browser\b", r"\bverifying you are human\b", r"\btraceback\b\s*[:(]", r"\bconnection to (?:the )?database (?:timed out|failed|was lost)\b", r"\bjust a moment\.\.\.", r"\bsomething went wrong while\b",
        r"\bthe (?:site|portal|service|page) is (?:down|closed|offline|unavailable|under maintenance|not available)\b(?: for| till| until|\W*$)", r"जावास्क्रिप्ट\s+(?:चालू|सक्षम)", r"त्रुटि\s*(?:[४५]०|[45]0)", r"(?:सत्र|सेशन)\s+(?:समाप्त|खत्म)",
    ],
}
_WORD = re.compile(r"[^\W\d_]+|\d+|[{}<>\[\]$%@#«»]+|_{2,}", re.UNICODE)
# Each seed in English has one of these words or signs; other passages skip the patterns.
_CUES = frozenset(
    "lorem asdf qwerty dummy filler placeholder replace blind here session javascript java scripts cookies browser verifying traceback database moment wrong down closed offline unavailable maintenance available 400 401 403 404 405 408 410 429 500 501 502 503 504".split()
)
_SIGNS = re.compile(r"\{\{|\[|[xX]{4}")
#: Shapes: signs of programs around a word, by one on each side or more, around capitals; doubled signs; rows of X in place of figures.
_SIGN = r"[{}<>\[\]«»%$@#&\\^~=_]"
_SHAPED = re.compile(r"[{}<>\[\]«»%$@#_&\\^~]|[xX]{2}")
_AROUND = re.compile(rf"({_SIGN}{{1,3}}[;!]?)[ ]?([A-Za-z0-9][\w .;%-]{{0,60}}?)[ ]?({_SIGN}{{1,3}})")
_DOUBLED = re.compile(r"([#$@%])\1+|(?<!_)__(?!_)")
_ROW = re.compile(r"\b[xX]{2,}(?:/[xX]{2,}|/\d*[xX]+)")


def marks(seeds: dict[str, list[str]] = SEEDS) -> re.Pattern:
    """One pattern for all seeds."""
    return re.compile("|".join(f"(?:{m})" for ms in seeds.values() for m in ms) or r"(?!)", re.I)


_MARKS = marks()


def _may_be_trusted(passage: str, words: list[str], shaped: bool) -> bool:
    """Whether a seed may be in the passage: a quick look at its words and signs."""
    return not passage.isascii() or not _CUES.isdisjoint(words) or shaped and _SIGNS.search(passage) is not None


def trusted(passage: str, pattern: re.Pattern = _MARKS) -> bool:
    """Whether the passage has an unmistakable mark of residue."""
    return _may_be_trusted(passage, _WORD.findall(passage.lower()), _SHAPED.search(passage) is not None) and bool(pattern.search(passage))


def shapes(passage: str) -> list[str]:
    """The shapes of a passage with signs, each as a feature."""
    out = []
    for m in _AROUND.finditer(passage):
        out.append("shape around")
        if len(m.group(1)) > 1 and len(m.group(3)) > 1:
            out.append("shape around by several")
        if m.group(2).isupper():
            out.append("shape around capitals")
    if _DOUBLED.search(passage):
        out.append("shape doubled")
    if _ROW.search(passage):
        out.append("shape row")
    return [x for x in out for _ in range(3)]  # a shape weighs as much as a word and its pairs


#: Numbers of the marks that open and close a passage, below those of words.
OPEN, CLOSE = 0, 1


class Numbers(dict):
    """Words to their hashes; all figures are one word. A task's memory, emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = 2 + crc32(b"9" if word[0].isdigit() else word.encode()) % (2**31 - 3)
        return n


def _featurise(pattern: re.Pattern):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers().__getitem__
        for batch in batches:
            ids, flags, flat, ends = [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for passage in _BREAKS.split(text):
                    if not passage or passage.isspace():
                        continue
                    words = _WORD.findall(passage.lower())
                    shaped = _SHAPED.search(passage) is not None
                    ids.append(doc_id)
                    flags.append(_may_be_trusted(passage, words, shaped) and pattern.search(passage) is not None)
                    flat.append(OPEN)  # words between the marks that open and close a passage, then its shapes
                    flat += map(number, words)
                    flat.append(CLOSE)
                    if shaped:
                        flat += map(number, shapes(passage))
                    ends.append(len(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(flags, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "trusted", "w"]
            )

    return read


def passages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", seeds: dict[str, list[str]] = SEEDS) -> DataFrame:
    """(doc_id, trusted, w): the words and shapes of every passage as numbers."""
    return documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_featurise(marks(seeds)), "doc_id bigint, trusted boolean, w array<int>")


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trusted, features in each passage, bucket of every word and word pair, passage of each)."""
    lists = batch.column("w")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    word = flat > CLOSE
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(sizes) - 1] = False  # the closing mark opens no pair
    first = np.nonzero(inner)[0]
    pairs = ((flat[first] * 0x9E3779B1 + flat[first + 1] * 0x85EBCA77) >> 7) & (BUCKETS - 1) if len(first) else np.array([], np.int64)
    buckets = np.concatenate([flat[word] & (BUCKETS - 1), pairs])
    return batch.column("trusted").to_numpy(zero_copy_only=False), 2 * sizes - 3, buckets, np.concatenate([of[word], of[first]])


def _posterior(model: tuple[np.ndarray, float] | None, flags: np.ndarray, sizes: np.ndarray, buckets: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Probability of residue of each passage; without a model only trusted passages have one."""
    if model is None:
        return flags.astype(float)
    ratio, prior = model
    score = np.bincount(of, weights=ratio[buckets], minlength=len(flags)) / np.maximum(1.0, sizes / 40.0) + prior
    score = np.where(sizes <= 3, -60.0, score)  # one word
    return np.where(flags, 1.0, 1.0 / (1.0 + np.exp(-np.clip(score, -60, 60))))


def _counts(table: DataFrame, model: tuple[np.ndarray, float] | None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Expected feature counts of residue and of content, and the expected passages of each; partial sums are made inside tasks."""
    shipped = table.sparkSession.sparkContext.broadcast(model)  # two fixed-size arrays

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no, n = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            flags, sizes, buckets, of = _features(batch)
            p = _posterior(shipped.value, flags, sizes, buckets, of)
            yes += np.bincount(buckets, weights=p[of], minlength=BUCKETS)
            no += np.bincount(buckets, weights=1 - p[of], minlength=BUCKETS)
            n += (p.sum(), (1 - p).sum())
        at = np.nonzero(yes + no)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(yes[at], n[0])), pa.array(np.append(no[at], n[1]))], names=["bucket", "yes", "no"])

    sums = table.mapInArrow(partial, "bucket bigint, yes double, no double").groupBy("bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toPandas()  # at most BUCKETS + 1 rows
    yes, no = np.zeros(BUCKETS), np.zeros(BUCKETS)
    inside = sums[sums.bucket >= 0]
    yes[inside.bucket.to_numpy(int)], no[inside.bucket.to_numpy(int)] = inside.yes, inside.no
    n = sums[sums.bucket < 0]
    return yes, no, float(n.yes.sum()), float(n.no.sum())


def learn(table: DataFrame) -> tuple[np.ndarray, float] | None:
    """(log ratio by bucket, prior log odds), or None without a trusted passage. table as from passages(), settled by the caller."""
    model, before = None, 0.0
    for _ in range(MOST_ROUNDS):
        yes, no, n_yes, n_no = _counts(table, model)
        if n_yes <= 0:
            return None
        whole = (yes + no) / (yes + no).sum()
        p = (yes + SMOOTHING * whole + 1e-12) / (yes.sum() + SMOOTHING)
        q = (no + SMOOTHING * whole + 1e-12) / (no.sum() + SMOOTHING)
        model = ((np.log(p) - np.log(q)).astype(np.float32), float(np.log(n_yes + 1) - np.log(n_no + 1)))
        if abs(n_yes - before) <= STILL * n_yes:
            break
        before = n_yes
    return model


def scored(table: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """(doc_id, p, trusted): the probability of residue of every passage, and whether a mark made it certain."""
    shipped = table.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_posterior(shipped.value, *_features(batch))), batch.column("trusted")], names=["doc_id", "p", "trusted"])

    return table.mapInArrow(score, "doc_id bigint, p double, trusted boolean")


def residue_ids(documents: DataFrame, seeds: dict[str, list[str]] = SEEDS) -> DataFrame:
    """(doc_id, p, trusted): the records with residue, the greatest probability of their passages, and whether any has a trusted mark;
    the others are found by the model alone."""
    table = settle(passages(documents, seeds=seeds))
    return scored(table, learn(table)).groupBy("doc_id").agg(F.max("p").alias("p"), F.bool_or("trusted").alias("trusted")).where(F.col("p") >= THRESHOLD)


def without_residue(documents: DataFrame) -> DataFrame:
    """The corpus without its residue records, all columns kept."""
    return documents.join(residue_ids(documents).select("doc_id"), "doc_id", "left_anti")
