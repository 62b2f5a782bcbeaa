"""Noise in text from scanned pages: furniture, words broken at line ends, misrecognised letters; repaired to paragraphs.

Running lines are learned from the corpus: the masked openings of lines that stand at the edge of nearly every page of the files
they occur in, over several document types. Words are learned from pages with native text, which no recogniser has touched: a
lexicon with page counts, and letter trigrams of capitalised words for names that no lexicon has.

The text without furniture is one stream, line ends included, and is decoded by one lattice a page. From every place in it arcs lead
on: the word as it stands; the word with one or two confusions of like shapes undone; the word split in two, one part misread or
none; the word merged with the next, over a blank or a line end, misread or not; the word joined over a hyphen at a line end, misread
or not; or the hyphen kept as the word's own. Arcs cost the word's rarity, the letter model for names, and their channel; a
confusion costs less on a page that the recogniser was unsure of (ocr_confidence). The cheapest path through all of them is the
reading of the page; lines of kinds hyphen and misread and the repaired words are both taken from it. Where known words stand
between known words the path is plain, so the lattice is only opened around unknown words and line-end hyphens. Paragraph
boundaries are then chosen by dynamic programming over line ends.

The lexicon holds the words in over LEAST_SHARE of native pages, so its size is bounded by words a page / LEAST_SHARE, and the
trigram table by its alphabet; these two are sent to the tasks. Running openings grow with the bidders that have their own: up to
FEW_OPENINGS they are sent along, beyond that the openings of each page are joined with them and travel with the page.

Defined results: null and empty texts give no lines; line numbers count from 1 over text split at line feeds, empty lines included;
a text without native pages in the corpus is decoded with an empty lexicon, and then only furniture and plain hyphen breaks are
found; a null confidence counts as an average one; texts of any length are read whole; repeated pages give equal rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.names import near
from dossier.session import bounded, cut, is_small, settle

#: A lexicon word stands on this share of native pages at least, and on LEAST_PAGES of them.
LEAST_SHARE, LEAST_PAGES = 1e-4, 3
#: A running line stands at the edge of this share of the pages of the files it occurs in, in files of RUN_PAGES pages or more,
#: over RUN_TYPES document types or more.
RUN_SHARE, RUN_PAGES, RUN_TYPES = 0.8, 2, 3
EDGE = 3
#: A task hands on its counts of words when it has so many.
MOST_COUNTED = 500_000
#: Running openings are sent to all tasks up to this number, and joined to pages beyond.
FEW_OPENINGS = 10_000

# Shapes as printed, and as recognisers misread them in running text; with the cost of the confusion.
READ_AS = (
    ("e", "c"), ("t", "f"), ("a", "@"), ("i", "l"), ("s", "5"), ("o", "0"), ("d", "cl"), ("l", "1"), ("i", "1"), ("c", "("), ("u", "ii"), ("g", "9"), ("h", "b"), ("m", "rn"), ("b", "6"), ("w", "vv"), ("f", "l"), ("y", "v"), ("ri", "n"),
    ("cl", "d"), ("rn", "m"), ("l", "i"), ("h", "li"), ("n", "ri"), ("q", "g"), ("b", "8"), ("z", "2"), ("o", "c"),
)
CONFUSION, HYPHEN, SPLIT, MERGE, UNKNOWN = 4.0, 0.5, 9.0, 7.0, 16.0
#: What a confusion costs more on a page of this much more confidence than USUAL; and the least and most of that.
SURE, USUAL, LEAST_SURE, MOST_SURE = 0.1, 80.0, -1.0, 2.0
#: Words that others may be split into or merged to stand on this share of native pages.
COMMON = 0.01
#: A name with a sign in it is misread if a reading by letters only costs at most this a trigram under the letter model.
NAME_COST = 3.5

_HYPHENS = "-‐‑­"
_LINE_HYPHEN = re.compile(rf"([^\W\d_][\w@(]*(?:-[^\W\d_]+)*)([{_HYPHENS}])\s*$")
_DIGIT = re.compile(r"\d")
_GAP = re.compile(r"\s{3,}")
_PAGE_NUMBER = re.compile(
    r"^\s*(?:\W{0,2}(?:page|pg|p|पृष्ठ|sheet)\W{0,2}\s*(?:no\W{0,2})?\s*[\dOlI]{1,4}\s*(?:(?:of|/|\|)\s*[\dOlI]{1,4})?\W{0,2}|\d{1,3}|[-–—]{1,2}\s*[\dOl]{1,4}\s*[-–—]{1,2}|[\[(|{]\s*[\dOl]{1,4}\s*[\])|}]|[\dOl]{1,4}\s*[|/]\s*[\dOl]{1,4})\s*$", re.I
)
_REFERENCE = re.compile(r"\b[A-Za-z]{2,4}/\d+/\d+-\d+")
_CORE = re.compile(r"^[\"'‘“\[{]*(.*?)[.,;:!?\"'’”\]})]*$")
_WORDY = re.compile(r"^[A-Za-z0-9@(|]*[A-Za-z][A-Za-z0-9@(|]*$")
_TRAIN = re.compile(r"[^\W\d_]+")


def opening(line: str) -> str:
    """The masked opening of a line: three words, references and numbers each as one sign; what follows a wide gap is left out."""
    head = _GAP.split(line.strip(), maxsplit=1)[0]
    masked = re.sub(r"\d+", "9", _REFERENCE.sub("§", head)).lower()
    return " ".join(masked.split()[:3]) if not masked.startswith("§ /") else "§ /"


# ---- what is learned -----------------------------------------------------------------------------------------------------------


def openings_at_edges(pages: DataFrame) -> DataFrame:
    """(page_id, file, o): the openings of the first and last EDGE lines of every page; stored."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, file, text in zip(batch["page_id"], batch["file"], batch["text"], strict=True):
                lines = [x for x in text.split("\n") if x.strip()]
                rows += [(page, file, o) for o in {opening(x) for x in lines[:EDGE] + lines[-EDGE:]} if o]
            yield pd.DataFrame(rows, columns=["page_id", "file", "o"])

    texts = pages.where("text is not null").select("page_id", F.xxhash64("tender_id", "bidder_name", "source_file").alias("file"), "text")
    return settle(texts.mapInPandas(edges, "page_id bigint, file bigint, o string"))


def running_lines(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(o): the openings of running headers and footers, which fill RUN_SHARE of the pages of their files and stand on RUN_TYPES types."""
    found = openings_at_edges(pages)
    kinds = documents.groupBy("page_id").agg(F.min("doc_type").alias("doc_type"))
    sizes = pages.where("text is not null").groupBy(F.xxhash64("tender_id", "bidder_name", "source_file").alias("file")).agg(F.count("*").alias("pages")).where(F.col("pages") >= RUN_PAGES)
    per_file = found.groupBy("file", "o").agg(F.count_distinct("page_id").alias("n")).join(sizes, "file").groupBy("o").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"), F.count("*").alias("files"))
    runs = cut(per_file.where((F.col("n") >= RUN_SHARE * F.col("pages")) & (F.col("files") >= 3)).select("o"))
    return cut(found.join(bounded(runs), "o", "left_semi").join(kinds, "page_id", "left").groupBy("o").agg(F.count_distinct(F.coalesce("doc_type", F.lit("none"))).alias("t")).where(F.col("t") >= RUN_TYPES).select("o"))


def _keys(o: str) -> list[str]:
    """The opening, and it with each of its words left open: openings of one word misread share a key."""
    ws = o.split()
    return [o] + [" ".join([*ws[:k], "*", *ws[k + 1 :]]) for k in range(len(ws)) if len(ws) > 1]


def _alike(o: str, other: str) -> bool:
    """Openings of which all words but one agree, and that one within one letter or two."""
    ws, vs = o.split(), other.split()
    if len(vs) != len(ws) or len(ws) < 2:
        return False
    wrong = [(a, b) for a, b in zip(ws, vs, strict=True) if a != b]
    return len(wrong) == 1 and (len(wrong[0][1]) > 3 or len(ws) > 2 and len(wrong[0][1]) > 1) and near(*wrong[0], 2) <= (2 if len(wrong[0][1]) > 3 else 1)


def runs_of_pages(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """(page_id, runs): the running openings that are those of lines of the page, one word misread or none. Each different opening of the
    corpus is compared once, with the running openings that share a key."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page, o) for page, text in zip(batch["page_id"], batch["text"], strict=True) for o in {opening(part) for x in text.split("\n") for part in _GAP.split(x.strip()) if part}]
            yield pd.DataFrame(rows, columns=["page_id", "o"])

    @F.pandas_udf("array<string>")
    def keys(os: pd.Series) -> pd.Series:
        return os.map(_keys)

    @F.pandas_udf("boolean")
    def alike(os: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([a == b or _alike(a, b) for a, b in zip(os, others, strict=True)], dtype="bool")

    here = settle(pages.where("text is not null").select("page_id", "text").mapInPandas(lines, "page_id bigint, o string"))
    different = here.select("o").distinct().select("o", F.explode(keys("o")).alias("k"))
    known = runs.select(F.col("o").alias("run"), F.explode(keys("o")).alias("k"))
    met = different.join(known, "k").select("o", "run").distinct().where(alike("o", "run"))
    return here.join(met, "o").groupBy("page_id").agg(F.collect_set("run").alias("runs"))  # the running lines of one page


def language(pages: DataFrame) -> tuple[dict[str, int], dict[str, int], int]:
    """(word -> native pages that have it, trigram -> count in capitalised words, native pages)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        names: Counter = Counter()

        def counted() -> pd.DataFrame:
            grams: Counter = Counter()
            for w, k in names.items():
                for g in _grams(w):
                    grams[g] += k
            rows = [("w", w, k) for w, k in words.items()] + [("g", g, k) for g, k in grams.items()]
            words.clear()
            names.clear()
            return pd.DataFrame(rows, columns=["kind", "key", "n"])

        n = 0
        for batch in batches:
            for text in batch["text"]:
                found = set(_TRAIN.findall(_join(text)))
                words.update({w.lower() for w in found})
                words.update({w.lower() for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)+", text)})
                names.update(w.lower() for w in found if w[0].isupper() and len(w) > 3)
            n += len(batch)
            if len(words) > MOST_COUNTED:  # the shuffle adds them up
                yield counted()
        yield counted()
        yield pd.DataFrame([("n", "", n)], columns=["kind", "key", "n"])

    native = pages.where("source = 'native' and text is not null").select("text")
    sums = cut(native.mapInPandas(count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = sums.where("kind = 'n'").agg(F.sum("n")).first()[0] or 0
    words = {r.key: r.n for r in sums.where((F.col("kind") == "w") & (F.col("n") >= max(LEAST_PAGES, LEAST_SHARE * total))).collect()}
    grams = {r.key: r.n for r in sums.where("kind = 'g' and length(key) = 3").where(F.col("key").rlike("^[a-z^$]{3}$")).collect()}
    return words, grams, total


def _join(text: str) -> str:
    return re.sub(rf"(?<=[^\W\d_])[{_HYPHENS}]\s*\n\s*(?=[^\W\d_])", "", text)


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


# ---- decoding ------------------------------------------------------------------------------------------------------------------


class Furniture:
    """Tells running lines and page numbers. running: the openings of running lines."""

    def __init__(self, running: list[str]):
        self.running = set(running)
        self.by_word: dict[tuple[int, str], list[str]] = {}
        for o in running:
            for k, w in enumerate(o.split()):
                self.by_word.setdefault((k, w), []).append(o)
        self.lines: dict[str, bool] = {}
        self.places = [{o.split()[k] for o in running if len(o.split()) > k} for k in range(3)]

    def __call__(self, line: str) -> bool:
        if len(line) > 16 or not _DIGIT.search(line):
            # two of the first three words of a running line are as learned, or its reference stands in its place
            ws = line.split(None, 3)
            if len(ws) < 2:
                return False
            w = ws[1]
            hits = (ws[0].lower() in self.places[0]) + (w.lower() in self.places[1] or "/" in w) + (len(ws) > 2 and ws[2].lower() in self.places[2])
            if hits < 2 and not ("/" in w and hits):
                return False
        parts = [p for p in _GAP.split(line.strip()) if p]
        return bool(parts) and all(_PAGE_NUMBER.match(p) or self._runs(p) for p in parts)

    def _runs(self, part: str) -> bool:
        o = opening(part)
        known = self.lines.get(o)
        if known is None:
            if len(self.lines) > 200_000:
                self.lines.clear()
            known = self.lines[o] = o in self.running or self._nearly(o)
        return known

    def _nearly(self, o: str) -> bool:
        """An opening with one letter or two misread: all words but one agree, and that one nearly."""
        return any(_alike(o, other) for k, w in enumerate(o.split()) for other in self.by_word.get((k, w), ()))


#: An arc of the lattice: what it costs, how many words of the stream it covers, what it reads, how many confusions it undoes.
Arc = tuple[float, int, tuple[str, ...], int]


class Decoder:
    """Reads pages with what was learned. One is made per task; its memory of words is emptied when it grows large."""

    def __init__(self, words: dict[str, int], grams: dict[str, int], pages: int):
        self.words, self.grams, self.pages = words, grams, max(pages, 1)
        pairs: Counter = Counter()
        for g, n in grams.items():
            pairs[g[:2]] += n
        self.pairs = pairs
        #: lexicon words by their skeleton, which no confusion changes: as large as the lexicon
        self.by_skeleton: dict[str, list[str]] = {}
        for word in words:
            if len(word) > 3 and word.isalpha():
                self.by_skeleton.setdefault(word.translate(_SKELETON), []).append(word)
        self.memory: dict[str, tuple[Arc, ...] | None] = {}

    # -- words

    def cost(self, word: str) -> float | None:
        n = self.words.get(word)
        return None if n is None else -math.log(n / (self.pages + 1))

    def common(self, word: str) -> bool:
        return self.words.get(word, 0) > COMMON * self.pages

    def name_cost(self, word: str) -> float:
        total = 0.0
        for g in _grams(word):
            total -= math.log((self.grams.get(g, 0) + 0.05) / (self.pairs.get(g[:2], 0) + 0.05 * 28))
        return total

    def readings(self, word: str) -> dict[str, float]:
        """What may have been printed where this word was read, by one confusion, with its cost."""
        out = {}
        for true, read in READ_AS:
            at = word.find(read)
            while at >= 0:
                out.setdefault(word[:at] + true + word[at + len(read) :], CONFUSION)
                at = word.find(read, at + 1)
        return out

    def printed(self, word: str, edits: int = 2) -> tuple[str, float, int] | None:
        """The cheapest lexicon word that so many confusions turn into this, with the cost of both and the number of confusions. A word
        misread once is taken before one misread twice."""
        best = None
        for true in self.by_skeleton.get(word.translate(_SKELETON), ()):
            n = confusions(true, word, edits)
            if 0 < n <= edits:
                found = (n, n * CONFUSION + self.cost(true), true)
                if best is None or found < best:
                    best = found
        return None if best is None else (best[2], best[1], best[0])

    def arcs(self, token: str) -> tuple[Arc, ...] | None:
        """The arcs of one token of the stream; None if it is plain: only itself, at no cost."""
        known = self.memory.get(token, 0)
        if known == 0:
            if len(self.memory) > 300_000:
                self.memory.clear()
            known = self.memory[token] = self._arcs(token)
        return known

    def _arcs(self, token: str) -> tuple[Arc, ...] | None:
        core = _core(token, self.words)
        if len(core) < 3 or core.lower() in self.words:
            return None
        read = self.read(core)
        low = core.lower()
        if read is None and not (low.isalpha() and len(low) > 3):
            return None
        out: list[Arc] = [(UNKNOWN + CONFUSION, 1, (token,), 0)]
        if read is not None:
            out.append((read[1], 1, (token.replace(core, _cased(read[0], core), 1),), read[2]))
        if low.isalnum():
            for k in range(2, len(low) - 1):  # a lost blank
                a, b = low[:k], low[k:]
                if self.common(a) and self.common(b):
                    out.append((SPLIT + self.cost(a) + self.cost(b), 1, _halves(token, core, k, None), 0))
                elif self.common(a) and len(b) > 4 and (p := self.printed(b, 1)) and self.common(p[0]) and len(a) > 2:
                    out.append((SPLIT + self.cost(a) + p[1], 1, _halves(token, core, k, (None, p[0])), 1))
                elif self.common(b) and len(a) > 4 and (p := self.printed(a, 1)) and self.common(p[0]) and len(b) > 2:
                    out.append((SPLIT + p[1] + self.cost(b), 1, _halves(token, core, k, (p[0], None)), 1))
        return tuple(out)

    def read(self, core: str) -> tuple[str, float, int] | None:
        """(what the word says, cost, confusions) if that differs from its letters by confusions; None if it has no such reading."""
        if "-" in core or "/" in core:
            parts = re.split(r"([-/])", core)
            if any(p.isdigit() for p in parts) or core.lower() in self.words:
                return None
            fixed = [self.read(p) if len(p) > 2 else None for p in parts]
            if not any(fixed):
                return None
            return "".join(f[0] if f else p for f, p in zip(fixed, parts, strict=True)), max(f[1] for f in fixed if f), sum(f[2] for f in fixed if f)
        if len(core) < 3 or not _WORDY.match(core):
            return None
        low = core.lower()
        digits = sum(c.isdigit() for c in core)
        if low in self.words or digits > 2 or digits and core.isupper() or not any(c.islower() for c in core) and not core[1:].isalpha():
            return None
        if len(core) - digits < 3:
            return None
        capital = core[0].isupper() and core[1:].isalpha()
        found = self.printed(low, 1 if capital else 2)
        if found is not None and capital and not self.common(found[0]):
            found = None  # a name is not read as another name
        if found is not None and found[1] < UNKNOWN + CONFUSION:
            return found
        if core[0].isupper() and not low.isalpha() and self.grams:  # a name with a sign no name has: the letter model chooses
            other = {w: p + self.name_cost(w) for w, p in self.readings(low).items() if w.isalpha()}
            if other:
                w = min(other, key=other.get)
                if other[w] / (len(w) + 1) < NAME_COST:
                    return w, UNKNOWN, 1
        return None

    def merged(self, a: str, b: str) -> Arc | None:
        """Two neighbours of the stream as one word, misread or not."""
        if not (a.isalpha() and b[:1].islower()):
            return None
        core = b.rstrip(".,;:()")
        whole = (a + core).lower()
        cost = self.cost(whole)
        if cost is not None:
            return MERGE + cost, 2, (a + b,), 0
        found = self.printed(whole, 1) if len(whole) > 6 and core else None
        if found is not None and self.common(found[0]):
            return MERGE + found[1], 2, (_cased(found[0], a) + b[len(core) :],), 1
        return None

    def hyphened(self, head: str, hyphen: str, tail: str, scanned: bool) -> list[tuple[float, str, str | None, int]]:
        """(cost, 'join', 'own' or 'apart', reading, confusions) of a word with a hyphen at its line's end."""
        a, b = head.lower(), tail.lower()
        first = a.rsplit("-", 1)[-1]
        joined, own = self.cost(first + b), self.cost(f"{a}-{b}")
        whole = self.cost(first) is not None and self.cost(b) is not None and len(first) > 2 and len(b) > 2
        out: list[tuple[float, str, str | None, int]] = [(HYPHEN + (UNKNOWN - 1 if whole and hyphen == "-" else 4 * UNKNOWN), "apart", None, 0)]
        if own is not None:
            out.append((HYPHEN + own - 1e-6, "own", None, 0))
        if joined is not None:
            out.append((HYPHEN + joined, "join", None, 0))
        else:
            out.append((HYPHEN + UNKNOWN, "join", None, 0))
            text = head.rsplit("-", 1)[-1] + tail
            read = self.read(text) if scanned else None
            if read is None and (found := self.printed(first + b, 1)) is not None:
                read = (found[0], found[1], 0)  # a broken word for certain, but what it says is left as it stands
                out.append((HYPHEN + min(found[1], UNKNOWN - 2), "join", None, 0))
            elif read is not None:
                out.append((HYPHEN + min(read[1], UNKNOWN - 2), "join", read[0], read[2]))
        return out

    # -- pages

    def page(self, text: str, scanned: bool, furniture: Furniture, confidence: float | None = None) -> Page:
        """The reading of a page: the cheapest path through the lattice of its stream."""
        page = Page(text, furniture)
        sure = 0.0 if confidence is None or confidence != confidence else min(max(SURE * (confidence - USUAL), LEAST_SURE), MOST_SURE)
        tokens, n = page.tokens, len(page.tokens)
        known: list[tuple[Arc, ...] | None] = [None] * n
        if scanned:
            memory = self.memory
            for i, token in enumerate(tokens):
                found = memory.get(token, 0)
                if found == 0:
                    found = self.arcs(token)
                if found is not None and not (("@" in token or page.mailed) and page.address_like(i)):
                    known[i] = found
        breaks = page.breaks
        open_at = sorted({i for i in range(n) if known[i] is not None} | set(breaks))
        at = 0
        while at < len(open_at):
            first = max(open_at[at] - 1, 0)
            last = open_at[at]
            while at < len(open_at) and open_at[at] <= last + 2:  # the words between are in reach of both
                last = open_at[at]
                at += 1
            self._decode(page, known, first, min(last + 2, n), scanned, sure)
        return page

    def _decode(self, page: Page, known: list[tuple[Arc, ...] | None], first: int, end: int, scanned: bool, sure: float) -> None:
        """The cheapest path over the tokens first to end - 1, added to the page's reading."""
        tokens, size = page.tokens, end - first
        best: list[float] = [0.0] + [math.inf] * size
        back: list[tuple | None] = [None] * (size + 1)
        for i in range(size):
            price, t = best[i], first + i
            if price == math.inf:
                continue
            if t in page.breaks and t + 1 < end:
                for cost, how, reading, wrong in self.hyphened(*page.breaks[t], scanned):
                    step, total = (1 if how == "apart" else 2), price + cost + wrong * sure
                    if total < best[i + step]:
                        best[i + step], back[i + step] = total, (i, "plain" if how == "apart" else how, (reading,), wrong)
                continue
            for cost, step, words, wrong in known[t] or ((0.0, 1, (tokens[t],), 0),):
                total = price + cost + wrong * sure
                if total < best[i + step]:
                    best[i + step], back[i + step] = total, (i, "plain" if not wrong and len(words) == 1 else "read", words, wrong)
            if scanned and i + 1 < size and (known[t] is not None or known[t + 1] is not None):
                arc = self.merged(tokens[t], tokens[t + 1])
                if arc is not None and price + arc[0] + arc[3] * sure < best[i + 2]:
                    best[i + 2], back[i + 2] = price + arc[0] + arc[3] * sure, (i, "read", arc[2], arc[3])
        i = size
        while i:
            before, how, words, wrong = back[i]
            if how != "plain":
                page.path[first + before] = (i - before, how, words, wrong)
            i = before

    def noise(self, page: Page) -> tuple[set[int], set[int]]:
        """(lines that end in a broken word, lines with a misread word) of a page's reading."""
        hyphens, misread = set(), set()
        for t, (_, how, words, wrong) in page.path.items():
            line = page.line_of[t]
            if how == "join":
                hyphens.add(line)
                if wrong:
                    head, _, tail = page.breaks[t]
                    joined, right, same = head.rsplit("-", 1)[-1] + tail, words[0], 0
                    while same < min(len(joined), len(right)) and joined[same].lower() == right[same]:
                        same += 1
                    misread.add(line if same < len(joined) - len(tail) else page.line_of[t + 1])
            elif wrong:
                misread.add(line)
        return hyphens, misread

    def paragraphs(self, page: Page) -> list[str]:
        """The page's running text as repaired paragraphs, from its reading."""
        shown: dict[int, list[str]] = {k: [] for k in page.body}
        t, n = 0, len(page.tokens)
        while t < n:
            step, how, words, _ = page.path.get(t, (1, "plain", (page.tokens[t],), 0))
            if how in ("join", "own"):
                token, (head, _, tail) = page.tokens[t].rstrip(), page.breaks[t]
                last = head.rsplit("-", 1)[-1]
                prefix = token[: len(token) - 1 - len(last)]
                middle = (_cased(words[0], last) if words[0] else last + tail) if how == "join" else last + "-" + tail
                words = (prefix + middle + page.tokens[t + 1][len(tail) :],)
            shown[page.line_of[t]] += words
            t += step
        body = [k for k in page.body if shown[k]]
        if not body:
            return []
        hyphens = {i for i, k in enumerate(page.body) if any(page.line_of[x] == k and page.path.get(x, (0, ""))[1] in ("join", "own") for x in page.ends.get(k, ()))}
        starts = _boundaries([page.lines[k] for k in page.body], [k + 1 < len(page.lines) and not page.lines[k + 1].strip() for k in page.body], hyphens)
        out: list[list[str]] = []
        for i, k in enumerate(page.body):
            if i in starts or not out:
                out.append([])
            ws = shown[k]
            if out[-1] and ws and out[-1][-1][-1:] in _HYPHENS and out[-1][-1][-2:-1].isalpha() and ws[0][:1].islower():
                out[-1][-1] += ws[0]  # two known words with a hyphen of their own at the line end
                ws = ws[1:]
            out[-1] += ws
        return [" ".join(p) for p in out if p]


class Page:
    """The stream of a page: its tokens without furniture, the line of each, and the words that a line end may break; and its reading, as
    the arcs of the path that are not plain: first token -> (tokens, kind, words, confusions)."""

    def __init__(self, text: str, furniture: Furniture):
        self.lines = text.split("\n")
        self.furniture = [furniture(x) for x in self.lines]
        self.body = [k for k, x in enumerate(self.lines) if x.strip() and not self.furniture[k]]
        self.tokens: list[str] = []
        self.line_of: list[int] = []
        self.breaks: dict[int, tuple[str, str, str]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.path: dict[int, tuple[int, str, tuple, int]] = {}
        self.mailed = "@" in text or "(at)" in text or "[at]" in text or "[dot]" in text
        for at, k in enumerate(self.body):
            found = self.lines[k].split()
            self.tokens += found
            self.line_of += [k] * len(found)
            end = self.lines[k].rstrip()
            if end[-1] in _HYPHENS and at + 1 < len(self.body):
                m = _LINE_HYPHEN.search(self.lines[k])
                tail = re.match(r"[^\W\d_][\w@(]*", self.lines[self.body[at + 1]].lstrip())
                if m and tail and (tail.group()[0].islower() or m.group(1).isupper()):
                    head = re.search(r"[^\W\d_][\w@(]*(?:-[^\W\d_]+)*$|[@(][\w@(]*(?:-[^\W\d_]+)*$", m.group(1)).group()
                    self.breaks[len(self.tokens) - 1] = (head, m.group(2), tail.group())
                    self.ends[k] = (len(self.tokens) - 1,)

    def address_like(self, i: int) -> bool:
        """Parts of electronic addresses are no words."""
        first = i
        while first and self.line_of[first - 1] == self.line_of[i] and i - first < 2:
            first -= 1
        last = i + 1
        while last < len(self.tokens) and self.line_of[last] == self.line_of[i] and last - i < 3:
            last += 1
        return _address_like(self.tokens[first:last], i - first)


_SKELETON = str.maketrans({
    "l": "i", "1": "i", "t": "i", "f": "i", "e": "c", "(": "c", "o": "c", "0": "c", "d": "ci", "n": "ri", "m": "rri", "u": "ii", "h": "ii", "b": "ii", "6": "ii", "8": "ii", "y": "v", "w": "vv", "q": "g", "9": "g", "@": "a", "5": "s", "2": "z",
})
_BY_TRUE: dict[str, list[tuple[str, str]]] = {}
for _true, _read in READ_AS:
    _BY_TRUE.setdefault(_true[0], []).append((_true, _read))


def confusions(true: str, read: str, most: int) -> int:
    """How many confusions turn true into read, or most + 1 beyond that."""
    i = 0
    while i < len(true) and i < len(read) and true[i] == read[i]:
        i += 1
    if i == len(true) and i == len(read):
        return 0
    if not most:
        return 1
    best = most + 1
    for start in range(max(0, i - 1), i + 1):  # a shape of two letters may begin one letter before the first difference
        for a, b in _BY_TRUE.get(true[start : start + 1], ()):
            if true.startswith(a, start) and read.startswith(b, start):
                best = min(best, 1 + confusions(true[start + len(a) :], read[start + len(b) :], min(most, best) - 1))
    return min(best, most + 1)


def _core(token: str, words: dict[str, int]) -> str:
    core = _CORE.match(token).group(1)
    if core[:1] == "(" and (core[1:].lower() in words or not core[1:2].islower()):
        core = core[1:]
    return core.split("'")[0].split("’")[0]


def _halves(token: str, core: str, k: int, read: tuple[str | None, str | None] | None) -> tuple[str, ...]:
    before, after = token.split(core, 1) if core in token else ("", "")
    a, b = core[:k], core[k:]
    if read:
        a, b = _cased(read[0], a) if read[0] else a, read[1] or b
    return before + a, b + after


def _cased(word: str, like: str) -> str:
    return word.capitalize() if like[:1].isupper() else word


def _address_like(tokens: list[str], j: int) -> bool:
    """Parts of electronic addresses are no words."""
    token = tokens[j]
    if "@" in token and ("." in token.rstrip(".,;") or token.startswith("@")) or "(at)" in token or "[at]" in token:
        return True
    near_by = tokens[max(0, j - 2) : j] + tokens[j + 1 : j + 3]
    return any(x in ("@", "[at]", "(at)", "[dot]") for x in near_by) or bool(re.search(r"\w\.\w{2,}", token) and "@" in token)


def _boundaries(lines: list[str], gaps: list[bool], hyphens: set[int]) -> set[int]:
    """Lines that open a paragraph, by dynamic programming: each line either goes on or opens one; the costs weigh blank lines, line
    width, sentence ends, capitals and broken words, and paragraphs of one short line."""
    n = len(lines)
    width = max(len(x) for x in lines)
    go, new = [0.0] * n, [0.0] * n
    back: list[tuple[int, int]] = [(0, 0)] * n
    go[0], new[0] = 50.0, 0.0
    for i in range(1, n):
        before, here = lines[i - 1].rstrip(), lines[i].lstrip()
        cost_go = cost_new = 0.0
        if gaps[i - 1]:
            cost_go += 4
        full = len(before) + len(here.split(" ", 1)[0]) + 1 > width
        if full:
            cost_new += 2
        else:
            cost_go += 3
        if before[-1:] in ".:;!?।":
            cost_go += 0.5
        else:
            cost_new += 1
        if here[:1].islower():
            cost_new += 3
        if i - 1 in hyphens:
            cost_new += 50
        short = 0.3 if len(here) < width / 2 else 0.0
        a, b = go[i - 1], new[i - 1]
        go[i], new[i] = min(a, b) + cost_go, min(a, b + short) + cost_new
        back[i] = (0 if a <= b else 1, 0 if a <= b + short else 1)
    starts, state = set(), 0 if go[-1] <= new[-1] else 1
    for i in range(n - 1, -1, -1):
        if state:
            starts.add(i)
        state = back[i][state]
    return starts | {0}


# ---- jobs ----------------------------------------------------------------------------------------------------------------------


def _read(pages: DataFrame, documents: DataFrame, few: int, rows_of, schema: str) -> DataFrame:
    """rows_of(decoder, page_id, page) of every page."""
    words, grams, total = language(pages)
    runs = running_lines(pages, documents)
    texts = pages.where("page_id is not null and text is not null").select(F.col("page_id").cast("bigint").alias("page_id"), "text", "source", F.col("ocr_confidence").cast("double").alias("confidence") if "ocr_confidence" in pages.columns else F.lit(None).cast("double").alias("confidence"))
    sent = None
    if is_small(runs, few):
        sent = sorted(r.o for r in runs.collect())
        texts = texts.withColumn("runs", F.lit(None).cast("array<string>"))
    else:
        texts = texts.join(runs_of_pages(texts, runs), "page_id", "left")
    shipped = pages.sparkSession.sparkContext.broadcast((words, grams, total, sent))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *learned, everywhere = shipped.value
        decoder = Decoder(*learned)
        common = None if everywhere is None else Furniture(everywhere)
        for batch in batches:
            rows = []
            for page_id, text, source, confidence, own in zip(batch["page_id"], batch["text"], batch["source"], batch["confidence"], batch["runs"], strict=True):
                furniture = common or Furniture([] if own is None else list(own))
                rows += rows_of(decoder, page_id, decoder.page(text, source != "native", furniture, confidence))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return texts.mapInPandas(read, schema)


def _noise_rows(decoder: Decoder, page_id: int, page: Page) -> list[tuple]:
    hyphens, misread = decoder.noise(page)
    return [(page_id, k + 1, "furniture") for k, f in enumerate(page.furniture) if f] + [(page_id, k + 1, "hyphen") for k in sorted(hyphens)] + [(page_id, k + 1, "misread") for k in sorted(misread)]


def _paragraph_rows(decoder: Decoder, page_id: int, page: Page) -> list[tuple]:
    return [(page_id, k + 1, p) for k, p in enumerate(decoder.paragraphs(page))]


def noisy_lines(pages: DataFrame, documents: DataFrame, few: int = FEW_OPENINGS) -> DataFrame:
    """(page_id, line_no, kind): furniture, hyphen and misread lines."""
    return _read(pages, documents, few, _noise_rows, "page_id bigint, line_no bigint, kind string")


def repaired(pages: DataFrame, documents: DataFrame, few: int = FEW_OPENINGS) -> DataFrame:
    """(page_id, paragraph_no, paragraph): the running text of every page as continuous paragraphs."""
    return _read(pages, documents, few, _paragraph_rows, "page_id bigint, paragraph_no bigint, paragraph string")
