"""Personal information inside free text: spans found by weak supervision, replaced by typed placeholders.

Spans are proposed widely: by patterns of addresses, numbers and electronic addresses, by any run of digits of a telephone number's
length, by given names and initials, and by any sequence of capitalised words. For each span labelers (pattern, gazetteer, left and
right context, place on the line, words of firms and offices) vote for, against, or abstain. The votes of all spans of the corpus,
also of those no labeler votes for, are counted by vote pattern; expectation-maximisation on these counts estimates how reliable
each labeler is for each kind.

A logistic classifier is then trained on the estimated labels of a sample of SAMPLE spans a kind. It sees the votes, and besides
them the words around the span, its own words if they are common in lower case, and its shape, all hashed into DIMENSIONS numbers.
Every sampled person is shown twice, the second time without the gazetteer's votes and its common words, so that the context alone
carries it and names of no list are found too. The classifier decides every span that a labeler votes for; spans without such a vote are none.

What reaches the driver is bounded: the table of vote patterns (3 votes a labeler) and the sample.

Kinds: email, phone, person, address, id_number. Spans may run over a line end; words broken there are read as one.

Defined results: null and empty texts have no spans and stay as they are; a text of any length is searched whole; spans that
overlap are reported by kind, and in replaced text the longer one wins; repeated rows are equal; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.confusions import variants
from dossier.llm.names import MIDDLES, NICKNAMES, OPENERS, TITLES, TRADE_TAILS, TRADES
from dossier.session import settle

KINDS = ("email", "phone", "person", "address", "id_number")
#: Fields of extracted_fields that hold free text.
FREE_TEXT = ("consignee", "penalty", "workcompleted", "performance", "undertakingtype", "compliancenote")
#: Vote patterns are few; more than this would mean that labelers were added without need.
MOST_PATTERNS = 100_000
#: Spans of a kind that the classifier is trained on, and the numbers of its features; those below FIRST_WORD are votes.
SAMPLE, DIMENSIONS, FIRST_WORD = 20_000, 1 << 14, 64
#: A common word stands in lower case in this share of all texts, and in so many.
COMMON_SHARE, COMMON_LEAST = 1e-3, 3
#: Features of the words around a span; and a person's first labelers, which know listed names.
CONTEXT, GAZETTEER = 4, 3
#: A feature has a weight if the sample has it so often.
LEAST_SEEN = 10
#: One in so many of the spans without a vote for them is kept for the sample.
KEPT = 16

J = "⁠"  # stands for the hyphen and the line end of a broken word, so that places stay the same
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐‑­]\n(?=[^\W\d_])")
_W = rf"[\w{J}]"

_EMAIL = re.compile(rf"[\w.+\-{J}]+\s?(?:@|\(at\)|\[at\])\s?[\w\-{J}]+(?:(?:\.|\s?(?:\[dot\]|\(dot\))\s?)[\w\-{J}]+)+", re.I)
_PHONE = re.compile(r"(?<![\w/.,₹\-])(?:\+91[ \n-]?)?(?:\(\d{3,5}\)[ \n-]?\d{6,8}|\d{3}-\d{3}-\d{4}|\d{5}[ \n]\d{5}|0\d{5}-\d{5}|\d{10}|91\d{10})(?![\w\-]|[/,.]\d)")
_ID = re.compile(r"(?<![\w\-])(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{3}\d{7}|[A-Z]\d{7}|[A-Z]{2}[- ]?\d{13}|\d{4}([ \n-])\d{4}[ \n-]\d{4}|\d{12})(?![\w\-])")
_ADDRESS = re.compile(
    rf"[HFPSV0-9](?<![\w/].)(?:(?<=H)\.?\s?No\.?\s\d+|(?<=F)[l1i]at\s(?:No\.?\s)?\d+|(?<=P)[l1i]ot\s(?:No\.?\s)?\d+|(?<=[S5])hop\s(?:No\.?\s)?\d+|(?<=H)ouse\s(?:No\.?\s)?\d+|(?<=\d)\d{{0,3}}/\d{{1,4}},|(?<=V)[i1l][l1i]{{2}}age\s{_W}+,)"
)
_ADDRESS_TAIL = re.compile(rf"\s*[\w\-]*,?\s{_W}+(?:\s{_W}+)?\s(?:Street|Marg|Road|Lane|Apartments|Nagar|Colony|Enclave|Bazar)|[\w\-]*,\sSector\s\d+|\s?P\.?\s?O\.?\s{_W}+|[^\n]{{0,40}}\b\d{{6}}\b")
_ADDRESS_END = re.compile(rf"(?:,\s?(?:(?:near|opp\.?|behind)(?:\s{_W}+){{1,3}}|PIN\s\d{{6}}|P\.?\s?O\.?\s{_W}+|[A-Z]{_W}+(?:\s(?:Road|Street|Marg|Apartments))?)|\s?-\s?\d{{6}}|\s\d{{6}})*")
_CAPITAL = re.compile(rf"[A-Z](?<![\w@].)(?:[\w@{J}]+|\.)")
#: Where telephone and identity numbers can be: the patterns above begin with what does not stand before them, which is slow to look for everywhere.
_REGION = re.compile(r"\d[\d ()\-\n]{6,}\d")
_FOUR = re.compile(r"\d{4,}")
_NEXT_INITIAL = re.compile(rf"\s?([A-Z])\.")

_GIVEN = variants(tuple(NICKNAMES))
_NICK = frozenset(n for ns in NICKNAMES.values() for n in ns)
_MIDDLE = variants(tuple(MIDDLES))
# Capitalised words that are no surname.
_NO_SURNAME = frozenset(
    "director partner proprietor manager works deputy stores keeper site supervisor quality inspector accounts officer executive village flat plot shop house name date performance father's signature membership chartered authorised for the office tender contract service total "
    "form registration permanent gst pan udyam tel mob ph email we our this seal place and no note".split()
)
_FIRM = frozenset({*TRADES, *TRADE_TAILS, *OPENERS, "co", "company", "bros", "limited", "ltd", "llp"})
_HONORIFIC = re.compile(r"(?:\b(?:shri|sri|smt|mrs|mr|ms|dr|kum|prop|ca)\.?|\()\s*$", re.I)
_PERSON_LEFT = re.compile(r"(?:contact|undersigned,?|supervisor|recorded from|needed\s?for|name\s?:|provider\s?:|\bfor|unit\s?:|enterprise\s?:?|\band|proprietor,?|signed by|details)\s*(?:(?:shri|sri|smt|mrs|mr|ms|dr|ca)\.?\s*)?$", re.I)
_PERSON_RIGHT = re.compile(r"\s*[,)]?\s*(?:on\s\+?\(?\d|holding\b|residing\b|membership\b|in\s?presence\b|signs\b|from\snext\b|and\s(?:[A-Z]\.|Shri|Smt|[A-Z])|will\b|\+?\(?\d{4,})", re.I)
_PHONE_LEFT = re.compile(r"(?:tel|ph|phone|mob|mobile|\bm|cell|call|contact|charge|alternate|\bon|fax|,)\.?\s*:?\s*(?:no\.?\s*)?$", re.I)
_NOT_PHONE = re.compile(r"(?:no\.?|folio|udin|frn|rs\.?|inr|₹|gstin|paper|holding|licence|card|account|gemc-?|\bde|tag|bond|slip|book)\s*:?\s*\(?$", re.I)
_ID_LEFT = re.compile(r"(?:paper|holding|licen[cs]e|card|passport|aadhaar|uid|pan|account number(?: card)?|identity)\s*(?:no\.?|number)?\s*:?\s*\(?\s*$", re.I)
_NOT_ID = re.compile(r"(?:gstin|udin|udyam|membership|frn|enlistment|tender|contract|bid|tel|ph|mob|charge:?|alternate|call)\b[^\n]{0,12}$", re.I)
_EMAIL_LEFT = re.compile(r"(?:e-?mail(?: id)?|write|sent\s?to|mail|contact)\s*:?\s*$", re.I)
#: Digits and what stands between them in telephone numbers, for runs that no pattern above has.
_DIGITS = re.compile(r"(?<![\w/.,₹\-])\+?\(?\d[\d ()\-]{6,16}\d(?![\w\-]|[/,.]\d)")
_DATE = re.compile(r"\d{1,2}-\d{1,2}-\d{2,4}|\d{4}-\d{1,2}-\d{1,2}|\d{4}-\d{2,4}")
_OFFICER = re.compile(r"\s*,?\s*\(?(?:director|partner|proprietor|manager|secretary|authori[sz]ed signatory|chartered accountant|engineer|president|chairman|executive officer)\b", re.I)
# Capitalised words that open a sentence or a field before a name.
_NO_GIVEN = frozenset({*TITLES, *"contact signed name provider unit details undersigned and from with recorded enterprise date to by in on at as of this that all any please witness father mother son daughter wife".split()})
_ADDRESS_LEFT = re.compile(r"(?:posted\s?to|residing\s?at|business|address|resident\s?of|located\s?at|at)\s*:?\s*$", re.I)


def _sign(yes, no=False) -> int:
    return 1 if yes else -1 if no else 0


def _inside(pattern: re.Pattern, flat: str, regions: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The matches of the pattern in regions that hold all of them, from left to right."""
    last = -1
    for start, end in regions:
        for m in pattern.finditer(flat, start, end):
            if m.start() >= last:
                last = m.end()
                yield m


def spans(text: str, given_names: frozenset[str] = _GIVEN) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) of every proposed span of a text. given_names: the gazetteer."""
    if not text:
        return
    flat = _BREAK.sub(J + J, text)
    left = lambda at, n=32: flat[max(0, at - n) : at].replace("\n", " ")
    if "@" in flat or "(at)" in flat or "[at]" in flat:
        for m in _EMAIL.finditer(flat):
            got = m.group()
            yield "email", m.start(), m.end(), (_sign(_EMAIL_LEFT.search(left(m.start()))), _sign("@" in got and " " not in got), _sign(len(re.split(r"\.|dot", got)[-1].strip("] )")) >= 2, True))
    taken = set()
    regions = [(max(0, m.start() - 8), m.end() + 4) for m in _REGION.finditer(flat)]
    for m in _inside(_PHONE, flat, regions):
        before, digits = left(m.start()), re.sub(r"\D", "", m.group())
        taken.add(m.start())
        yield "phone", m.start(), m.end(), (_sign(_PHONE_LEFT.search(before), _NOT_PHONE.search(before)), _sign(len(digits) in (10, 11, 12), True), _sign(len(m.group()) > len(digits) or digits[0] in "56789" and len(digits) == 10 or digits.startswith("91")), 0)
    for m in _inside(_DIGITS, flat, regions):
        if m.start() in taken:
            continue
        before, digits = left(m.start()), re.sub(r"\D", "", m.group())
        date = bool(_DATE.search(m.group()))
        yield "phone", m.start(), m.end(), (_sign(not date and _PHONE_LEFT.search(before), _NOT_PHONE.search(before)), _sign(False, not 8 <= len(digits) <= 12), _sign(False, date), -1)
    for m in _inside(_ID, flat, [(max(0, m.start() - 8), m.end() + 14) for m in _FOUR.finditer(flat)]):
        before, got = left(m.start()), m.group()
        long = got.isdigit()
        yield "id_number", m.start(), m.end(), (_sign(_ID_LEFT.search(before), _NOT_ID.search(before)), _sign(not long, long and got.startswith("91")), _sign(got[:5].isalpha() or "licence" in before.lower() or bool(m.group(1))))
    for m in _ADDRESS.finditer(flat):
        tail = _ADDRESS_TAIL.match(flat, m.end())
        sentence = flat.find(".", m.end())
        rest = flat[m.end() : sentence + 1 if sentence >= 0 else len(flat)].replace("\n", " ")
        end = tail.end() if tail else m.end()
        end = _ADDRESS_END.match(flat, end).end()
        alone = not flat[flat.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
        yield "address", m.start(), end, (_sign(tail, True), _sign(_ADDRESS_LEFT.search(left(m.start())) or alone), _sign(re.match(r"[^.]*?\b\d{6}\b|[^.]*,\s[A-Z]\w+", rest), True))
    yield from _persons(flat, left, given_names)


_TITLE_ENDS = ("shri", "sri", "smt", "mrs", "mr", "ms", "dr", "kum", "prop", "ca", "(")


def _titled(flat: str, start: int) -> bool:
    """Whether a title may stand before this place: a quick look before the pattern is tried."""
    return flat[max(0, start - 7) : start].rstrip(" .\n").lower().endswith(_TITLE_ENDS)


def _persons(flat: str, left, given_names: frozenset[str]) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    tokens = [(m.group(), m.start(), m.end()) for m in _CAPITAL.finditer(flat)]
    taken = -1
    for k, (word, start, end) in enumerate(tokens):
        if start < taken:
            continue
        plain = word.replace(J, "").lower()
        given = plain in given_names
        initial = word[1:] == "."
        listed = given or initial or plain in _NICK and given_names is _GIVEN
        if not listed and (len(plain) < 3 or not plain.isalpha() or plain in _NO_SURNAME or plain in _NO_GIVEN or plain in _FIRM):
            continue
        if not listed and not (k + 1 < len(tokens) and tokens[k + 1][1] - end <= 2) and not _titled(flat, start):
            continue
        if initial and (start and flat[start - 1] in "./" or flat[end : end + 1] not in (" ", "\n")):
            continue
        parts, stop, middle = [], end, False
        for nxt, a, b in tokens[k + 1 : k + 5]:  # a middle name, and what may break up in between
            gap = flat[stop:a]
            if gap not in (" ", "\n", " \n", "\n ") or len(parts) == 2 and not initial:
                break
            low = nxt.replace(J, "").lower()
            if low.rstrip(".") in _NO_SURNAME:
                break
            if low in _MIDDLE and not middle:
                middle, stop = True, b
                continue
            if nxt[1:] == ".":
                if middle or parts:
                    break
                middle, stop = True, b
                continue
            if len(nxt) < 3 and not nxt.isupper():
                break
            if not listed and low in given_names:
                break
            parts.append(low)
            stop = b
            break
        before = left(start)
        honorific = _titled(flat, start) and _HONORIFIC.search(before)
        if not parts and (initial or not listed and not honorific):
            continue
        after = re.match(r"[ \n]?([A-Za-z]+)", flat[stop : stop + 16])
        firm = bool(parts and parts[-1] in _FIRM or after and after.group(1).lower() in _FIRM and after.group(1)[0].isupper())
        line_start, line_end = flat.rfind("\n", 0, start) + 1, flat.find("\n", stop)
        whole = given and not flat[line_start:start].strip(" (") and not flat[stop : line_end if line_end >= 0 else len(flat)].strip(" ),")
        yield "person", start, stop, (
            _sign(given, initial), _sign(parts and listed, not parts), _sign(middle and not initial), _sign(honorific), _sign(_PERSON_LEFT.search(before)),
            _sign(_PERSON_RIGHT.match(flat, stop)), _sign(whole), _sign(False, firm), _sign(_OFFICER.match(flat, stop)),
        )
        if listed:  # a sequence of no listed name may overlap the next one: both are judged
            taken = stop


_NEAR_WORD = re.compile(r"[^\W_]+")


def features(text: str, kind: str, start: int, end: int, votes: tuple[int, ...], common: frozenset[str]) -> list[int]:
    """The numbers of a span's features: CONTEXT of the words around it and its shape, its votes but abstentions, and its own words: those
    that are common in lower case by themselves, all others as one."""
    before = _NEAR_WORD.findall(text[max(0, start - 40) : start])[-2:]
    after = _NEAR_WORD.match(text[end : end + 24].lstrip(" \n.,:;()-"))
    own = text[start:end]
    shape = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]+", "a", re.sub(r"\d", "9", own[:40])))
    words = [f"l0:{before[-1].lower() if before else ''}", f"l1:{before[0].lower() if len(before) > 1 else ''}", f"r:{after.group().lower() if after else ''}", f"s:{shape if kind != 'person' else re.sub(r'A+', 'A', shape)}"]
    if kind == "person":
        words += [f"i:{w}" if w in common else "i" for w in (x.lower() for x in _NEAR_WORD.findall(own.replace("-\n", "")))]
    numbers = [FIRST_WORD + crc32(w.encode()) % (DIMENSIONS - FIRST_WORD) for w in words]
    return numbers[:CONTEXT] + [3 * j + v + 1 for j, v in enumerate(votes) if v] + numbers[CONTEXT:]


_RARE_WORD = FIRST_WORD + crc32(b"i") % (DIMENSIONS - FIRST_WORD)


def context_of(x: list[int]) -> list[int]:
    """A person's features without the gazetteer's votes for it."""
    return x[:CONTEXT] + [f for f in x[CONTEXT:] if (f < FIRST_WORD or f == _RARE_WORD) and not (f < 3 * GAZETTEER and f % 3 == 2)]


def line_numbers(text: str) -> list[int]:
    return [k for k, ch in enumerate(text) if ch == "\n"]


def _label(kind: str, votes: tuple[int, ...]) -> str:
    return kind + ":" + "".join("-0+"[v + 1] for v in votes)


def common_words(texts: DataFrame) -> frozenset[str]:
    """The words that stand in lower case in at least COMMON_SHARE of all texts: at most words a text / COMMON_SHARE."""
    rows = texts.where("text is not null and text <> ''").select(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z])[a-z]{3,}(?![A-Za-z])"), F.lit(0))).alias("ws"))
    counts = rows.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return frozenset(r.w for r in counts.where(F.col("n") >= max(COMMON_LEAST, COMMON_SHARE * rows.count())).select("w").collect())


def _find(shipped):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unwanted: Counter = Counter()
        for batch in batches:
            rows = []
            for src, row_id, text in zip(batch["src"], batch["row_id"], batch["text"], strict=True):
                ends = None
                for kind, start, end, votes in spans(text):
                    pattern = _label(kind, votes)
                    voted = 1 in votes
                    if not voted:
                        unwanted[pattern] += 1
                        if crc32(f"{row_id}/{start}".encode()) % KEPT:
                            continue
                    if ends is None:
                        ends = [m.start() for m in re.finditer("\n", text)]
                    line = bisect_right(ends, start - 1) + 1 if start else 1
                    rows.append((src, row_id, kind, line, pattern, 1 if voted else 0, features(text, kind, start, end, votes, shipped.value)))
            yield pd.DataFrame(rows, columns=["src", "row_id", "kind", "line_no", "pattern", "n", "x"])
        yield pd.DataFrame([(None, None, p.split(":")[0], None, p, n, None) for p, n in unwanted.items()], columns=["src", "row_id", "kind", "line_no", "pattern", "n", "x"])

    return find


def proposals(texts: DataFrame, common: frozenset[str] | None = None) -> DataFrame:
    """(src, row_id, kind, line_no, pattern, n, x), stored: every proposed span that a labeler votes for (n is 1), a part of the
    others (n is 0), and the number of all others by vote pattern (src is null). texts: src, row_id, text."""
    shipped = texts.sparkSession.sparkContext.broadcast(common_words(texts) if common is None else common)
    rows = texts.where("text is not null and text <> ''").select("src", F.col("row_id").cast("bigint").alias("row_id"), "text")
    return settle(rows.mapInPandas(_find(shipped), "src string, row_id bigint, kind string, line_no bigint, pattern string, n bigint, x array<int>"))


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 25) -> np.ndarray:
    """The probability that each vote pattern is right, by expectation-maximisation; labelers are independent given the truth.

    Starts from the majority of the votes; the vote probabilities are smoothed towards labelers that are right more often than
    not, which also keeps the two classes from changing places."""
    p = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    for _ in range(rounds):
        prior = np.clip((counts * p).sum() / counts.sum(), 0.02, 0.98)
        log_yes, log_no = np.full(len(votes), np.log(prior)), np.full(len(votes), np.log(1 - prior))
        weight = 2 + 0.01 * counts.sum()
        for j in range(votes.shape[1]):
            for v, (yes, no) in {1: (0.5, 0.1), 0: (0.4, 0.4), -1: (0.1, 0.5)}.items():
                at = votes[:, j] == v
                if at.any():
                    log_yes[at] += np.log(((counts * p)[at].sum() + weight * yes) / ((counts * p).sum() + weight))
                    log_no[at] += np.log(((counts * (1 - p))[at].sum() + weight * no) / ((counts * (1 - p)).sum() + weight))
        p = 1 / (1 + np.exp(np.clip(log_no - log_yes, -50, 50)))
    return p


def classifier(spans_: list[list[int]], labels: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Logistic weights of the features, the last one the bias, fitted to the estimated labels by AdaGrad on the whole sample."""
    sizes = np.array([len(x) for x in spans_])
    flat, of = np.concatenate([np.asarray(x, np.int64) for x in spans_]), np.repeat(np.arange(len(spans_)), sizes)
    w, seen = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    often = np.append(np.bincount(flat, minlength=DIMENSIONS) >= LEAST_SEEN, True)  # rarer ones would only learn single spans by heart
    n = len(labels)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(np.bincount(of, w[flat], n) + w[-1], -30, 30))) - labels) / n
        gradient = (np.append(np.bincount(flat, error[of], DIMENSIONS), error.sum()) + 3e-4 * w) * often
        seen += gradient**2
        w -= 0.3 * gradient / np.sqrt(seen)
    return w


def learn(found: DataFrame) -> dict[str, np.ndarray]:
    """The classifier's weights of each kind."""
    rows = found.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).where("n > 0").limit(MOST_PATTERNS + 1).collect()  # at most 3 ** labelers rows
    if len(rows) > MOST_PATTERNS:
        raise ValueError("too many vote patterns")
    labels: dict[str, float] = {}
    for kind in KINDS:
        own = sorted((r.pattern, r.n) for r in rows if r.kind == kind)
        if own:
            votes = np.array([["-0+".index(c) - 1 for c in p.split(":")[1]] for p, _ in own])
            labels |= dict(zip([p for p, _ in own], reliabilities(votes, np.array([n for _, n in own], float)), strict=True))
    kept = found.where("src is not null").select("kind", "pattern", "x", F.shiftrightunsigned(F.xxhash64("src", "row_id", "line_no", "pattern"), 11).alias("h"))
    counts = {r.kind: r["count"] for r in kept.groupBy("kind").count().collect()}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE / n) * float(1 << 53)))]) if counts else None
    sample = kept.where(F.col("h") < share[F.col("kind")]).limit(2 * SAMPLE * len(KINDS)).collect() if counts else []
    out = {}
    for kind in KINDS:
        own = sorted((r for r in sample if r.kind == kind and r.pattern in labels), key=lambda r: (r.h, r.pattern))
        if own:
            both = [(r.x, labels[r.pattern]) for r in own] + [(context_of(r.x), labels[r.pattern]) for r in own if kind == "person"]
            out[kind] = classifier([x for x, _ in both], np.array([y for _, y in both]))
    return out


def _accepts(weights: dict[str, np.ndarray], kind: str, x) -> bool:
    w = weights.get(kind)
    return w is not None and float(w[np.asarray(x)].sum() + w[-1]) >= 0


def _decided(weights: dict[str, np.ndarray]):
    """A column function (kind, features) -> whether the classifier takes the span for an item."""

    @F.pandas_udf(T.BooleanType())
    def decide(kinds: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([_accepts(weights, k, x) for k, x in zip(kinds, xs, strict=True)], dtype="bool")

    return decide.asNondeterministic()


def decisions(found: DataFrame) -> DataFrame:
    """(kind, spans, taken, overruled): spans with a vote for them, those the classifier takes, and those it decides against the majority of
    their votes. found as from proposals()."""
    yes = F.length(F.regexp_replace("pattern", r"[^+]", "")) > F.length(F.regexp_replace("pattern", r"[^-]", ""))
    rows = found.where("n = 1 and src is not null").select("kind", yes.alias("majority"), _decided(learn(found))("kind", "x").alias("taken"))
    return rows.groupBy("kind").agg(F.count("*").alias("spans"), F.count_if("taken").alias("taken"), F.count_if(F.col("taken") != F.col("majority")).alias("overruled"))


def free_texts(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """(src, row_id, text) of page texts and of the free-text values of extracted fields."""
    from dossier.functions.names import attribute_key

    own = fields.where(attribute_key(F.col("field_name")).isin(*FREE_TEXT))
    return pages.select(F.lit("page_results").alias("src"), F.col("page_id").alias("row_id"), "text").unionByName(own.select(F.lit("extracted_fields").alias("src"), F.col("field_id").alias("row_id"), F.col("field_value").alias("text")))


def items(texts: DataFrame) -> DataFrame:
    """(src, row_id, kind, line_no): the lines on which an item of personal information begins."""
    found = proposals(texts)
    rows = found.where("n = 1 and src is not null").withColumn("taken", _decided(learn(found))("kind", "x"))
    return rows.where("taken").select("src", "row_id", "kind", "line_no").distinct()


def replaced(texts: DataFrame) -> DataFrame:
    """(src, row_id, text): the same texts with [EMAIL], [PHONE], [PERSON], [ADDRESS] or [ID_NUMBER] in place of each item."""
    common = common_words(texts)
    weights = learn(proposals(texts, common))
    shipped = texts.sparkSession.sparkContext.broadcast((weights, common))

    @F.pandas_udf(T.StringType())
    def mask(values: pd.Series) -> pd.Series:
        out = []
        weights, common = shipped.value
        for text in values:
            if text:
                kept, last = [], -1
                for kind, start, end, votes in sorted(spans(text), key=lambda s: (s[1], -s[2])):
                    if start >= last and 1 in votes and _accepts(weights, kind, features(text, kind, start, end, votes, common)):
                        kept.append((start, end, kind))
                        last = end
                for start, end, kind in reversed(kept):
                    text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
            out.append(text)
        return pd.Series(out, dtype="object")

    return texts.select("src", "row_id", mask("text").alias("text"))
