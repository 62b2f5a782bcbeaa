"""Quantities recorded in different units: every value in one common unit.

The unit wording around a number is cut into letter runs; each run is segmented by dynamic programming over tries of scale
prefixes (lakh, k, milli), roots (rupee, metre, gram) and exponents ('000, 2, ^3). A run may have several decompositions
('m' is million, milli or metre): each costs -log of the prior of its dimension for the field's own dimension, plus a cost a
piece, and the cheapest wins. Runs that no decomposition covers are words and carry no unit.

Defined results: null, empty and unreadable values give null; zero is a value; a value with several amounts and no scales
gives null; an amount with more words around it is read by the same rules, however long the text; a leading minus makes the
amount negative.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.names import attribute_key
from dossier.session import bounded

# Scale prefixes and their power of ten, by the dimension they are usual for.
PREFIXES = {
    "hundred": (2, "money"), "hundreds": (2, "money"),
    "thousand": (3, "money"), "thousands": (3, "money"), "k": (3, "any"), "हजार": (3, "money"), "हज़ार": (3, "money"),
    "lakh": (5, "money"), "lakhs": (5, "money"), "lac": (5, "money"), "lacs": (5, "money"), "l": (5, "money"), "लाख": (5, "money"),
    "million": (6, "money"), "millions": (6, "money"), "mn": (6, "money"), "mln": (6, "money"), "m": (6, "money"),
    "crore": (7, "money"), "crores": (7, "money"), "cr": (7, "money"), "crs": (7, "money"), "करोड़": (7, "money"), "करोड़": (7, "money"),
    "billion": (9, "money"), "billions": (9, "money"), "bn": (9, "money"),
    "kilo": (3, "physical"), "mega": (6, "physical"), "milli": (-3, "physical"), "centi": (-2, "physical"), "c": (-2, "physical"), "micro": (-6, "physical"), "µ": (-6, "physical"),
}
# Signs that stand for a second prefix as well; the field's dimension decides.
SHORT_PREFIXES = {"m": (-3, "physical"), "d": (-1, "physical")}
# Roots, their dimension and their size in the dimension's common unit (rupee, metre, kilogram, second, per cent).
ROOTS = {
    "rs": ("money", "1"), "re": ("money", "1"), "inr": ("money", "1"), "rupee": ("money", "1"), "rupees": ("money", "1"), "₹": ("money", "1"),
    "रुपये": ("money", "1"), "रुपए": ("money", "1"), "रु": ("money", "1"), "paise": ("money", "0.01"),
    "m": ("length", "1"), "metre": ("length", "1"), "metres": ("length", "1"), "meter": ("length", "1"), "meters": ("length", "1"), "ft": ("length", "0.3048"), "feet": ("length", "0.3048"), "inch": ("length", "0.0254"), "inches": ("length", "0.0254"),
    "g": ("mass", "0.001"), "gram": ("mass", "0.001"), "grams": ("mass", "0.001"), "tonne": ("mass", "1000"), "tonnes": ("mass", "1000"), "quintal": ("mass", "100"), "quintals": ("mass", "100"),
    "s": ("time", "1"), "sec": ("time", "1"), "minute": ("time", "60"), "minutes": ("time", "60"), "hour": ("time", "3600"), "hours": ("time", "3600"), "day": ("time", "86400"), "days": ("time", "86400"), "week": ("time", "604800"), "weeks": ("time", "604800"),
    "per": ("ratio", "1"), "percent": ("ratio", "1"), "%": ("ratio", "1"),
}
# Exponents that may follow a root.
EXPONENTS = {"2": 2, "²": 2, "^2": 2, "3": 3, "³": 3, "^3": 3}
# Number words.
WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}

#: P(dimension of the unit | dimension of the field): what a field of one dimension may hold besides.
PRIORS = {
    "money": {"money": 0.97, "ratio": 0.01, "length": 0.005, "mass": 0.005, "time": 0.01},
    "length": {"money": 0.01, "ratio": 0.01, "length": 0.96, "mass": 0.01, "time": 0.01},
    "mass": {"money": 0.01, "ratio": 0.01, "length": 0.01, "mass": 0.96, "time": 0.01},
    "time": {"money": 0.01, "ratio": 0.01, "length": 0.01, "mass": 0.01, "time": 0.96},
    "ratio": {"money": 0.01, "ratio": 0.96, "length": 0.01, "mass": 0.01, "time": 0.01},
}
PIECE_COST = 0.7
#: Wordings up to this length are remembered; an amount has at most so many digits.
REMEMBERED, MOST_DIGITS = 400, 40

_NUMBER = re.compile(r"(?<![\d'’‘])\d[\d,]*(?:\.\d+)?|(?<![\w.])\.\d+")
#: A minus before an amount, or between its currency and its figures.
_NEGATIVE = re.compile(r"^(\s*(?:(?:rs|inr)\.?|₹)?\s*)[-−]\s?(?=(?:(?:rs|inr)\.?|₹)?\s*[\d.])", re.I)
_THOUSANDS = re.compile(r"['’‘`]\s*0{3}\b")
_RUN = re.compile(r"[^\W\d_]+(?:[ऀ-ॿ]+)?|[₹%#]|/-|[ऀ-ॿ]+")


def _trie(entries: Iterable[tuple[str, object]]) -> dict:
    root: dict = {}
    for word, meaning in entries:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append(meaning)
    return root


_TRIES = {
    "prefix": _trie([*PREFIXES.items(), *SHORT_PREFIXES.items()]),
    "root": _trie(ROOTS.items()),
    "exponent": _trie(EXPONENTS.items()),
}


def _matches(trie: dict, text: str, at: int) -> Iterator[tuple[int, object]]:
    node = trie
    for k in range(at, len(text)):
        node = node.get(text[k])
        if node is None:
            return
        for meaning in node.get("", ()):
            yield k + 1, meaning


@lru_cache(maxsize=65_536)
def segment(run: str, dimension: str) -> tuple | None:
    """The cheapest reading of one run as (cost, power of ten, root dimension or None, factor); None if it is a plain word."""
    prior = PRIORS[dimension]
    cost_of = lambda kind: -math.log(prior.get(kind, 0.02) if kind not in ("any", "physical") else 0.5)
    best: list[dict] = [{} for _ in range(len(run) + 1)]  # state -> (cost, power, root, factor); states: start, prefix, root, exponent
    best[0]["start"] = (0.0, 0, None, Decimal(1))
    for at in range(len(run)):
        for state, (cost, power, root, factor) in list(best[at].items()):
            moves: list[tuple[int, str, tuple]] = []
            if state in ("start", "root") and not (state == "root" and root != "money"):
                for end, (p, kind) in _matches(_TRIES["prefix"], run, at):
                    if kind == "physical" and end == len(run):
                        continue
                    moves.append((end, "prefix", (cost + PIECE_COST + cost_of(kind), power + p, root, factor)))
            if state in ("start", "prefix"):
                for end, (kind, size) in _matches(_TRIES["root"], run, at):
                    moves.append((end, "root", (cost + PIECE_COST + cost_of(kind), power, kind, factor * Decimal(size))))
            if state == "root" and root == "length":
                for end, e in _matches(_TRIES["exponent"], run, at):
                    moves.append((end, "exponent", (cost + PIECE_COST, power * e, f"{root}{e}", factor**e)))
            for end, to, reading in moves:
                if to not in best[end] or reading[0] < best[end][to][0]:
                    best[end][to] = reading
    return min(best[len(run)].values(), key=lambda r: r[0], default=None)


@lru_cache(maxsize=65_536)
def _program(shape: str, dimension: str) -> tuple:
    """The pieces of a text whose numbers are masked as '#': ('n',), ('w', number word), ('s', power), ('c', dimension, factor)."""
    out: list[tuple] = []
    for run in _RUN.findall(shape):
        if run == "#":
            out.append(("n",))
        elif run == "\u0001":
            out.append(("s", 3))
        elif run == "/-":
            out.append(("c", "money", Decimal(1)))
        elif run in WORDS:
            out.append(("w", WORDS[run]))
        elif run != "s" and (reading := segment(run, dimension)):
            _, power, root, factor = reading
            if root:
                out.append(("c", root, factor))
            if power and (power > 0 or root is not None and root.startswith(dimension)):  # a small prefix goes with its own root
                out.append(("s", power))
    return tuple(out)


def _pieces(text: str, dimension: str) -> tuple[list[str], list[tuple]]:
    low = text.lower()
    low = _THOUSANDS.sub(" thousand ", low)
    numbers = _NUMBER.findall(low)
    shape = _NUMBER.sub(" # ", low)
    return numbers, list((_program if len(shape) <= REMEMBERED else _program.__wrapped__)(shape, dimension))


def unit_of(text: str | None, dimension: str = "money") -> Decimal | None:
    """The size of the unit that a wording states ('Rs. in lakhs' is 100000, 'in rupees' is 1); None if it states none."""
    if not text:
        return None
    _, pieces = _pieces(text, dimension)
    scales = [p[1] for p in pieces if p[0] == "s"]
    roots = [p for p in pieces if p[0] == "c" and p[1] == dimension]
    if scales:
        return Decimal(10) ** scales[0] * (roots[0][2] if roots else 1)
    return roots[0][2] if roots else None


def read_quantity(text: str | None, dimension: str = "money") -> tuple[Decimal, bool] | None:
    """(amount, whether the text itself states the unit); None if no single amount can be read."""
    if not text:
        return None
    if _NEGATIVE.match(text):
        found = read_quantity(_NEGATIVE.sub(r"\1", text, count=1), dimension)
        return found and (-found[0], found[1])
    numbers, pieces = _pieces(text, dimension)
    if any(p[0] == "c" and p[1] != dimension for p in pieces):
        pieces = [p for p in pieces if p[0] != "c" or p[1] == dimension]
    if any(len(n) > MOST_DIGITS for n in numbers):
        return None
    try:
        values = [Decimal(n.replace(",", "")) for n in numbers]
    except InvalidOperation:
        return None
    count, words = sum(p[0] == "n" for p in pieces), sum(p[0] == "w" for p in pieces)
    if count and words and "(" in text[1:]:  # figures first, the same amount in words in brackets
        return read_quantity(text[: text.index("(", 1)], dimension)
    if count != len(values) or not (count or words) or (count and words):
        return None
    scales = [p[1] for p in pieces if p[0] == "s"]
    factor = next((p[2] for p in pieces if p[0] == "c"), None)
    if count == 1:
        if len(scales) > 2:
            return None
        amount = values[0] * Decimal(10) ** sum(scales[:1] if len(set(scales)) == 1 else scales)
        return amount * (factor or 1), bool(scales) or factor is not None
    # several numbers or words: each group is closed by its scale; hundreds multiply inside a group
    total, group, any_number = Decimal(0), None, False
    queue = iter(values)
    for piece in pieces:
        if piece[0] in "nw":
            number = next(queue) if piece[0] == "n" else Decimal(piece[1])
            if piece[0] == "n" and group is not None:
                return None
            group, any_number = (group or 0) + number, True
        elif piece[0] == "s":
            if group is None:
                continue
            if piece[1] == 2:
                group *= 100
            else:
                total, group = total + group * Decimal(10) ** piece[1], None
    if not any_number:
        return None
    total += group or 0
    return total * (factor or 1), bool(scales) or factor is not None


def _whole(amount: Decimal | None) -> int | None:
    if amount is None:
        return None
    whole = int(amount.to_integral_value(ROUND_HALF_UP))
    return whole if abs(whole) < 2**63 else None


def quantity_reader(dimension: str = "money"):
    """A vectorised UDF (value, context wording, default unit's name, number) -> bigint in the dimension's common unit.

    The number, where given, is the amount (a numeric column) and value is ignored. Order of units: in the value, else in the
    context wording, else the default, else the common unit itself."""

    def read(values: pd.Series, contexts: pd.Series, defaults: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for value, context, default, number in zip(values, contexts, defaults, numbers, strict=True):
            if number is not None and number == number:
                found = (Decimal(repr(float(number))), False)
            else:
                found = read_quantity(value if isinstance(value, str) else None, dimension)
            if found is None:
                out.append(None)
                continue
            amount, stated = found
            if not stated:
                unit = unit_of(context, dimension) if isinstance(context, str) else None
                if unit is None and isinstance(default, str):
                    unit = unit_of(default, dimension)
                amount *= unit if unit is not None else 1
            out.append(_whole(amount))
        return pd.Series(out, dtype="Int64")

    return F.pandas_udf(read, T.LongType()).asNondeterministic()  # so that a filter on it does not compute it again


#: The value holds nothing but a number: only such values look for a unit elsewhere.
BARE = r"^\s*[-−]?[\s\d.,]*\d[\s\d.,]*$"
#: A line that states the unit of a page's amounts.
UNIT_LINE = r"(?im)^[ \t(]*((?:all[ \t]+)?(?:amounts?|figures|values?|राशि)(?=[\s:(])[^\n\d]{0,24}(?:lakhs?|lacs?|crores?|thousands?|millions?|rupees|rs\.?|inr|लाख|करोड़|हजार|रुपये)[^\n\d]{0,20}(?:['’]0{3})?[ \t).]*)$"


def page_units(pages: DataFrame, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """(page_id, unit_line) of the pages that state a unit for their amounts; one row a page."""
    line = F.regexp_extract(F.col(text), UNIT_LINE, 1)
    return pages.select(F.col(page_id).alias("page_id"), line.alias("unit_line")).where("unit_line <> ''").groupBy("page_id").agg(F.min("unit_line").alias("unit_line"))


def field_amounts(fields: DataFrame, documents: DataFrame, catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """(field_id, value_inr) of every readable amount of the catalogue's money fields.

    Only values that are a bare number are joined with the page's statement; the join keys are single documents and pages, and a
    hot one is split by the adaptive skew join, as each key has one row on the other side."""
    money = catalog.where("value_type = 'money'").select("doc_type", attribute_key(F.col("field_name")).alias("attribute"), "default_unit").distinct()
    papers = documents.groupBy("document_id").agg(F.min(F.struct("doc_type", "page_id")).alias("d")).select("document_id", "d.doc_type", "d.page_id")
    names = money.select("attribute").distinct()
    rows = (
        fields.select("field_id", "document_id", attribute_key(F.col("field_name")).alias("attribute"), "field_value")
        .where("field_value is not null and trim(field_value) <> ''")
        .join(bounded(names), "attribute", "left_semi")
        .join(papers, "document_id")
        .join(bounded(money), ["doc_type", "attribute"])
    )
    bare = F.col("field_value").rlike(BARE)
    read = quantity_reader("money")
    nothing, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    stated = rows.where(~bare).select("field_id", read("field_value", nothing, nothing, no_number).alias("value_inr"))
    open_ones = (
        rows.where(bare)
        .join(page_units(pages), "page_id", "left")
        .select("field_id", read("field_value", "unit_line", "default_unit", no_number).alias("value_inr"))
    )
    return stated.unionByName(open_ones).where("value_inr is not null")


def rule_amounts(rules: DataFrame) -> DataFrame:
    """(rule_id, value_inr) of every limit neither null nor zero; the unit is worded in the label's brackets or the note, else rupees."""
    brackets = F.regexp_extract(F.col("label"), r"\(([^()]*(?:\([^()]*\))?[^()]*)\)\s*$", 1)
    wording = F.concat_ws(" ; ", F.col("note"), F.when(brackets != "", brackets))
    amount = quantity_reader("money")(F.lit(None).cast("string"), wording, F.lit("inr"), F.col("min_value_inr"))
    return rules.where("min_value_inr is not null and min_value_inr <> 0 and not isnan(min_value_inr)").select("rule_id", amount.alias("value_inr")).where("value_inr is not null")
