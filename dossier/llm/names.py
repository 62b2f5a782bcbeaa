"""Variant spellings of names typed by people: which strings name the same firm, proprietor or office.

Every distinct string is read to a profile (titles and numbering off, legal forms, trade words and office types by their
abbreviations, nicknames by their given name) and then exploded into its canonical rewritings:

- legal form: the name without it, so that 'Ltd', 'Limited' and nothing meet;
- nickname: the given name in place of each of its nicknames;
- initial: the given name, the middle name, a firm's leading word or all words of a firm or office by their initials;
- token order: given name and surname in both orders, and an office's place before or after its type;
- one letter out, and two where two typing errors are allowed, so that two misspelt names share a form; long names by thirds.

Rewritings are equi-joined. A shared rewriting counts by its rarity, -log of the share of profiles that have it, less the cost of
the rewriting on both sides; what is not rare enough for its cost is no link. What is left is compared part by part. Incomplete
names (an initial, no middle name, no leading word, an acronym) attach only to a party that is unambiguous, in three tiers.

Trade words beyond the known ones are learned: words of LEARNED_SHARE of the distinct names or more that mostly stand beside a legal
form or a known trade.

Defined results: null, empty and missing-value markers are no names; strings that differ only in blanks or case are different
strings of one party; exact repeats are one string; names of any length are read whole; names in which no letter is left after the
rules stand alone; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.graph import components
from dossier.session import cut

#: A rewriting is a link if log((profiles + PRIOR) / profiles with it) reaches its cost; PRIOR lets small tables have links at all.
PRIOR = 1000
#: A word is a trade if at least so many distinct names have it, that share of them, and this share of those are firms by another word.
LEARNED_LEAST, LEARNED_SHARE, LEARNED_FIRMS = 20, 0.005, 0.6
#: Own parts of more letters are rewritten by thirds, not by letters out.
LONG_PART = 24

# Markers of a missing name.
MISSING = {"", "-", "--", "?", "??", "n/a", "na", "n.a.", "nil", "none", "null", "illegible", "(not read)", "not read", "not stated", "to be filled", "see annexure", "as per contract", "unknown"}
# Titles before a name.
TITLES = {"ms", "m/s", "messrs", "shri", "sri", "smt", "mr", "mrs", "miss", "dr", "prop", "proprietor", "the", "kum"}
# Given names and the nicknames used for them.
NICKNAMES = {
    "anuradha": ["anu", "radha"], "balakrishna": ["balu", "bala"], "bhupendra": ["bhupi", "bhupen"], "chandrika": ["chand", "chandu", "chanda"], "dharmesh": ["dharam", "dharma"],
    "elizabeth": ["liza", "liz", "beth"], "farhanuddin": ["farhan"], "gurpreet": ["gurpi", "guri"], "harshvardhan": ["harsh", "harsha"], "indrajit": ["indu", "indra", "inder"],
    "jitendra": ["jitu", "jeetu", "jiten"], "kamaleshwar": ["kamal", "kamlesh"], "krishnadev": ["kishan", "krishna"], "lakshmi": ["laxmi", "lachmi"], "mohammad": ["md", "mohd", "mohammed", "muhammad"],
    "narayani": ["narayan", "naru"], "omkarnath": ["omkar", "onkar"], "prakash": ["pakku", "parkash"], "rajendra": ["raju", "rajen", "rajinder"], "rameshwar": ["ramesh", "ramu"],
    "sanjeevan": ["sanju", "sanjeev", "sanjiv"], "surendra": ["suren", "surinder", "suri"], "tanmayee": ["tanu", "tanmay"], "theodore": ["theo", "ted"], "umashankar": ["uma", "shankar"],
    "venkatesh": ["venky", "venkat"], "vijayendra": ["viju", "vijay"], "wilfred": ["wilf", "will"], "yogendra": ["yogi", "yogesh"], "zubeida": ["zubi", "zuby"],
}
# Further given names and nicknames in common use.
COMMON_NICKNAMES = {
    "abhishek": ["abhi"], "andrew": ["andy", "drew"], "anthony": ["tony"], "benjamin": ["ben", "benny"], "charles": ["charlie", "chuck"], "christopher": ["chris"], "daniel": ["dan", "danny"], "edward": ["eddie", "ned"],
    "james": ["jim", "jimmy"], "john": ["johnny", "jack"], "joseph": ["joe"], "katherine": ["kate", "kathy", "katie", "catherine"], "margaret": ["maggie", "peggy", "meg"], "michael": ["mike", "mick"], "richard": ["dick", "rick"],
    "robert": ["bob", "bobby", "rob"], "samuel": ["sam"], "susan": ["sue", "susie"], "thomas": ["tom", "tommy"], "william": ["bill", "billy"],
}
# Middle names that are no surnames here.
MIDDLES = {"das", "devi", "nath", "chand", "kumar", "singh", "rani", "prasad", "mohan", "lal"}
# Words that open a firm's name.
OPENERS = {"bright", "classic", "coastal", "eastern", "frontier", "global", "golden", "modern", "national", "northern", "pioneer", "prime", "reliant", "royal", "silver", "summit", "supreme", "united", "universal", "vintage", "western", "southern", "central"}
# Trades by their deciding word, its abbreviations, and its words' initials.
TRADES = {
    "associates": ["assoc", "assocs"], "technologies": ["tech", "techs"], "constructions": ["constns", "constn", "constr"], "traders": ["trdrs", "trdr"], "industries": ["inds", "ind"],
    "enterprises": ["ent", "entp"], "electricals": ["elect", "elec"], "supply": ["supp", "sup"], "security": ["sec"], "infra": [], "catering": ["catg"], "engineering": ["engg", "engrg"],
    "transport": ["tpt", "trpt"], "waterproofing": ["wproofing"], "housekeeping": ["hskpg"], "manpower": ["mpwr"], "facility": ["fac"], "printing": ["prtg"],
}
TRADE_INITIALS = {"sa": ["supply", "security"], "ip": ["infra"], "cs": ["catering"], "ew": ["engineering"], "tc": ["transport"], "wc": ["waterproofing"], "hc": ["housekeeping"], "ms": ["manpower"], "fs": ["facility"], "pp": ["printing"]}
# Second words of trades, which decide nothing.
TRADE_TAILS = {"agency": ["agcy"], "services": ["svc", "svcs", "service"], "projects": ["proj", "projs"], "works": ["wks"], "corporation": ["corpn", "corp"], "contractors": ["contrs", "contr"], "solutions": ["soln", "solns"], "press": []}
LEGAL = {"limited": ["ltd"], "private": ["pvt"], "llp": [], "company": ["co"], "sons": [], "brothers": ["bros"]}
JOINERS = {"and", "n", "of", "at", "for"}
# Office types by initials, with the abbreviations of their words.
OFFICES = {
    "au": ["agriculture", "university"], "cb": ["cantonment", "board"], "dh": ["district", "hospital"], "ebo": ["electricity", "board", "office"], "fdo": ["forest", "division", "office"],
    "ge": ["garrison", "engineer"], "ic": ["irrigation", "circle"], "mc": ["municipal", "council"], "ow": ["ordnance", "workshop"], "pwd": ["public", "works", "division"],
    "rtc": ["regional", "training", "centre"], "sd": ["supply", "depot"],
}
OFFICE_WORDS = {
    "agriculture": ["agri"], "university": ["univ"], "cantonment": ["cantt"], "board": ["bd"], "district": ["distt", "dist"], "hospital": ["hosp"], "electricity": ["elec"], "office": ["off"], "forest": [], "division": ["divn", "div"],
    "garrison": ["gar"], "engineer": ["engr"], "irrigation": ["irrgn", "irrg"], "circle": ["cir"], "municipal": ["mun"], "council": [], "ordnance": ["ord"], "workshop": ["wksp"], "public": ["pub"], "works": ["wks"],
    "regional": ["regl"], "training": ["trg"], "centre": ["center", "ctr"], "supply": ["sup"], "depot": [],
}


def fold(word: str) -> str:
    """Sound-alike spellings in one: ee is i, oo is u, doubled letters are single."""
    word = word.replace("ee", "i").replace("oo", "u")
    return re.sub(r"(.)\1+", r"\1", word)


def near(a: str, b: str, most: int = 1) -> int:
    """The number of edits (insert, delete, change, swap of neighbours) between a and b, or most + 1 beyond that."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    over = most + 1
    before: dict[int, int] = {}
    last = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        now = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):  # cells beyond the band cost too much
            y = b[j - 1]
            cost = min(last.get(j, over) + 1, now.get(j - 1, over) + 1, last.get(j - 1, over) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before.get(j - 2, over) + 1)
            now[j] = cost
        if min(now.values(), default=over) > most:
            return over
        before, last = last, now
    return min(last.get(len(b), over), over)


def _lexicon(entries: dict[str, list[str]]) -> dict[str, str]:
    return {form: word for word, forms in entries.items() for form in (word, *forms)}


_GIVEN = {**_lexicon(COMMON_NICKNAMES), **_lexicon(NICKNAMES)}
_TRADE, _TAIL, _LEGAL, _OFFICE = _lexicon(TRADES), _lexicon(TRADE_TAILS), _lexicon(LEGAL), _lexicon(OFFICE_WORDS)


def _fuzzy(word: str, words: tuple[str, ...], least: int = 5) -> str | None:
    """The one word of the list within one edit, for words long enough to tell."""
    if len(word) < least:
        return None
    w = fold(word)
    hits = {x for x in words if len(x) >= least and (fold(x) == w or near(fold(x), w) == 1 or near(x, word) == 1)}
    return hits.pop() if len(hits) == 1 else None


_FUZZY_FIRM = tuple({*TRADES, *TRADE_TAILS, *LEGAL, *OPENERS})
_FUZZY_OFFICE = tuple(OFFICE_WORDS)
_FUZZY_GIVEN = tuple(NICKNAMES)


@lru_cache(maxsize=200_000)
def _firm_word(word: str) -> tuple[str, str] | None:
    for kind, lexicon in (("trade", _TRADE), ("tail", _TAIL), ("legal", _LEGAL)):
        if word in lexicon:
            return kind, lexicon[word]
    if word in OPENERS:
        return "open", word
    if word in JOINERS:
        return "join", word
    hit = _fuzzy(word, _FUZZY_FIRM)
    return None if hit is None else ("open", hit) if hit in OPENERS else _firm_word(hit)


@lru_cache(maxsize=200_000)
def _given(word: str) -> str | None:
    return _GIVEN.get(word) or _fuzzy(word, _FUZZY_GIVEN, 6)


def _tokens(name: str) -> tuple[list[str], int, str]:
    """Lower-case tokens without titles, how many stand before a comma (0 without one), and the text."""
    text = name.lower().replace("_", " ")
    text = re.sub(r"\bm\s*/\s*s\b\.?", " ", text)
    text = re.sub(r"\bw\s*/\s*proofing", "wproofing", text)
    text = re.sub(r"(?:\(\s*p\s*\)|\bp\.)(?=\s*l(?:imite)?t?d)", " private ", text)
    text = re.sub(r"\(\s*prop\.?\s*\)", " ", text)
    text = re.sub(r"^\s*\d+\s*[.)]\s*", " ", text).replace("&", " and ")
    text = re.sub(r"\bl\.?\s?l\.?\s?p\b\.?", " llp ", text)
    found = re.findall(r"(?:[^\W\d_]\.){2,}|[^\W\d_]+|,|[()]", text)
    comma = sum(w not in "(),." for w in found[: found.index(",")]) if "," in found else 0
    words = [w for w in found if w not in (",", "(", ")")]
    while words and words[0].rstrip(".") in TITLES and len(words) > 1:
        words, comma = words[1:], max(0, comma - 1)
    return words, comma, text


def profile_of(kind: str, name: str, trades: frozenset[str] = frozenset()) -> dict | None:
    """The profile of one name: what it is, its first part or initial, its middle part or initial, its own part, its trade, its words'
    initials, and its tier: how complete it is. trades: learned trade words."""
    if name is None or name.strip().lower() in MISSING:
        return None
    return _office(name) if kind == "buyer" else _bidder(name, trades)


def _acronym(words: list[str]) -> str:
    return "".join(w[0] for w in words) if len(words) > 2 else ""


def _bidder(name: str, learned: frozenset[str]) -> dict | None:
    words, comma, text = _tokens(name)
    trades: list[str] = []
    legal: list[str] = []
    opener, rest, initials, named_words = "", [], [], []
    firm = False
    for at, w in enumerate(words):
        if "." in w:
            letters = w.replace(".", "")
            if letters in TRADE_INITIALS and not (comma and re.search(r",\s*" + re.escape(w) + r"\s*$", text)):
                trades += TRADE_INITIALS[letters]
                firm = True
            else:
                initials += list(letters)
            continue
        if len(w) == 1:
            if w != "n" or not firm:
                initials.append(w)
            continue
        if _GIVEN.get(w) or w in MIDDLES:
            rest.append((at, w))
            continue
        known = _firm_word(w) or (("trade", w) if w in learned else None)
        if known is None or known[0] in ("trade", "tail", "open"):
            named_words.append(w)
        if known is None:
            rest.append((at, w))
        elif known[0] == "trade":
            trades.append(known[1])
            firm = True
        elif known[0] == "tail":
            firm = True
        elif known[0] == "legal":
            legal.append(known[1])
            firm = True
        elif known[0] == "open":
            if opener:
                rest.append((at, w))
            opener, firm = known[1] if not opener else opener, True
    if "housekeeping" in trades and "company" in legal:
        legal.remove("company")
    if firm:
        own = fold("".join(w for _, w in rest))
        if not own and len(initials) > 1:  # 'T.C.S. Ltd'
            own, initials = "".join(initials), []
        if not own and (opener or trades):  # nothing but known words: they are the name
            own, opener, trades = fold("".join(named_words)), "", []
        if not own:
            return None
        short = not opener and not trades and len(own) <= 5
        return {
            "cls": "firm", "first": opener, "first_initial": opener[:1] or "".join(initials[:1]), "middle": "", "middle_initial": "", "own": own, "trade": "|".join(sorted(set(trades))), "legal": " ".join(sorted(set(legal))),
            "acronym": "" if short else _acronym(named_words), "tier": "2" if opener else "0" if short else "1",
        }
    given = middle = ""
    own: list[tuple[int, str]] = []
    named = [_given(w) for _, w in rest]
    for k, (at, w) in enumerate(rest):
        if w in MIDDLES and not (w in _GIVEN and not any(g for j, g in enumerate(named) if j != k and rest[j][1] not in MIDDLES)):
            middle = w
        elif named[k] and not given:
            given = named[k]
        else:
            own.append((at, w))
    if not given and not initials and len(own) > 1:  # a given name of no list: the first word, or the first after a comma
        spot = next((k for k, (at, _) in enumerate(own) if comma and at >= comma), 0)
        given = own.pop(spot)[1]
    if middle and not own and given:  # 'Chand' as a surname, or a name of two common words
        own, middle = [(0, middle)], ""
    if not own:
        return None
    first_initial, middle_initial = given[:1], middle[:1]
    spare = list(initials)
    if not given and spare:
        first_initial = spare.pop(0)
    if not middle and spare:
        middle_initial = spare.pop(0)
    return {
        "cls": "person", "first": given, "first_initial": first_initial, "middle": middle, "middle_initial": middle_initial, "own": fold("".join(w for _, w in own)), "trade": "", "legal": "",
        "acronym": "", "tier": "2" if given and middle else "1" if given else "0",
    }


@lru_cache(maxsize=200_000)
def _office_word(word: str) -> str | None:
    return _OFFICE.get(word) or _fuzzy(word, _FUZZY_OFFICE)


def _office(name: str) -> dict | None:
    text = re.sub(r"\bo\s*/\s*o\b\.?", " ", name.lower().replace("_", " "))
    text = re.sub(r"^\s*(?:off(?:ice)?\.?\s+of\s+(?:the\s+)?|the\s+)", " ", text)
    found = [w.replace(".", "") for w in re.findall(r"(?:[^\W\d_]\.){2,}|[^\W\d_]+", text)]
    kinds, place, code = [], [], ""
    for w in found:
        if w in JOINERS or w in ("the", "o"):
            continue
        if w in OFFICES and not code:
            code = w
            continue
        known = _office_word(w)
        if known:
            kinds.append(known)
        else:
            place.append(w)
    if not code:
        scored = sorted(((len(set(kinds) & set(words)) / len(words), c) for c, words in OFFICES.items()), reverse=True)
        if scored[0][0] <= 0.5 or scored[0][0] == scored[1][0]:
            return _other_office(text)
        code = scored[0][1]
    own = fold("".join(place))
    if not own:
        return _other_office(text)
    return _office_profile("office", own, code, "", "2")


def _office_profile(cls: str, own: str, trade: str, first: str, tier: str) -> dict:
    return {"cls": cls, "first": first, "first_initial": "", "middle": "", "middle_initial": "", "own": own, "trade": trade, "legal": "", "acronym": "", "tier": tier}


def _other_office(text: str) -> dict | None:
    """An office of no known type: what stands before a comma, bracket, 'of' or 'at' is its type, by its initials, and the rest its place."""
    if "(" in text:
        text = re.sub(r"\(\s*([^()]*)\)", r", \1", text)
    parts = [re.findall(r"(?:[^\W\d_]\.){2,}|[^\W\d_]+", p) for p in re.split(r",|\s(?:of|at)\s", text)]
    parts = [[w for w in p if w not in JOINERS and w != "the"] for p in parts]
    parts = [p for p in parts if p]
    if len(parts) == 1 and len(parts[0]) > 1 and "." in parts[0][0]:
        parts = [parts[0][:1], parts[0][1:]]  # 'C.E. Pune'
    if not parts:
        return None
    if len(parts) == 1:
        return _office_profile("other", fold("".join(w.replace(".", "") for w in parts[0])), "", "", "2")
    head, tail = parts[0], [w for p in parts[1:] for w in p]
    short = len(head) == 1 and "." in head[0]
    initials = head[0].replace(".", "") if short else "".join(w[0] for w in head)
    return _office_profile("other", fold("".join(w.replace(".", "") for w in tail)), initials, "" if short else fold("".join(head)), "1" if short else "2")


def _out(own: str, both: bool) -> dict[str, float]:
    """The part itself, with each one letter out, and with each two out; strings within two edits share one of them. Long parts by
    thirds: of two strings within two edits one third of either stands unchanged in the other, at most two places away."""
    out = {own: 0.0}
    if len(own) > LONG_PART:
        for length in range(len(own) - 2, len(own) + 3):
            for k in range(3):
                start, end = length * k // 3, length * (k + 1) // 3
                for shift in range(-2, 3):
                    if 0 <= start + shift and end + shift <= len(own):
                        out.setdefault(f"{length}:{k}:{own[start + shift : end + shift]}", 2.0)
        return out
    for k in range(len(own)):
        out.setdefault(own[:k] + own[k + 1 :], 1.0)
    if both:
        for j, k in itertools.combinations(range(len(own)), 2):
            out.setdefault(own[:j] + own[j + 1 : k] + own[k + 1 :], 2.0)
    return out


def forms_of(p: dict) -> list[tuple[str, float]]:
    """All canonical rewritings of a profile with their costs; legal forms and nicknames are rewritten in the profile already."""
    own, cls = p["own"], p["cls"]
    heads = [(f"{cls}/{t}", 0.0) for t in (p["trade"].split("|") if p["trade"] else [""])]
    if cls == "person":
        heads = [(f"person/{p['first_initial']}", 0.0 if p["first"] else 0.5)]
    out: dict[str, float] = {}
    for head, cost in heads:
        for part, price in _out(own, len(own) >= 7 and cls in ("person", "firm")).items():
            out.setdefault(f"{head}/{part}", cost + price)
    if cls == "person" and p["first"]:  # token order
        out.setdefault("person//" + " ".join(sorted((fold(p["first"]), own))), 1.0)
    if cls == "firm" and p["acronym"]:
        out.setdefault(f"firm/~{p['acronym']}", 2.0)
    if cls == "firm" and p["tier"] == "0":
        out.setdefault(f"firm/~{own}", 0.5)
    return list(out.items())


PROFILE = ["cls", "first", "first_initial", "middle", "middle_initial", "own", "trade", "legal", "acronym", "tier"]
PROFILE_TYPE = T.StructType([T.StructField(c, T.StringType()) for c in PROFILE] + [T.StructField("forms", T.ArrayType(T.StructType([T.StructField("form", T.StringType()), T.StructField("cost", T.DoubleType())])))])


def _profiles(trades: frozenset[str]):
    @F.pandas_udf(PROFILE_TYPE)
    def read(kinds: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, name in zip(kinds, names, strict=True):
            p = profile_of(kind, name, trades)
            rows.append({c: None for c in PROFILE} | {"forms": None} if p is None else p | {"forms": [{"form": f, "cost": c} for f, c in forms_of(p)]})
        return pd.DataFrame(rows, columns=[*PROFILE, "forms"])

    return read


def _same_given(x: str, y: str) -> bool:
    """Given names agree if equal, or within one edit where one of them is in no list."""
    return x == y or (min(len(x), len(y)) > 4 and (x not in _GIVEN or y not in _GIVEN) and near(x, y, 1) <= 1)


def agree(a: dict, b: dict) -> float | None:
    """The score of two profiles of one class as one party, or None if a part contradicts: edits cost, agreeing parts add."""
    if a["cls"] != b["cls"]:
        return None
    if a["cls"] == "firm" and (a["tier"] == "0") != (b["tier"] == "0"):  # an acronym for all words
        short, long = (a, b) if a["tier"] == "0" else (b, a)
        if short["own"] == long["acronym"]:
            return None if short["legal"] and long["legal"] and short["legal"] != long["legal"] else 0.5
    if a["cls"] == "person" and a["first"] and b["first"] and fold(a["first"]) == b["own"] and a["own"] == fold(b["first"]) and a["first"] != b["first"]:
        return 0.5 if a["middle"] == b["middle"] else None  # the same two words in the other order
    edits = near(a["own"], b["own"], 2)
    score = -1.0 * edits
    if a["trade"] or b["trade"]:
        shared = set(a["trade"].split("|")) & set(b["trade"].split("|"))
        if not shared:
            return None
        score += 1.0 if a["trade"] == b["trade"] else 0.5
    if a["legal"] and b["legal"] and a["legal"] != b["legal"]:
        return None
    whole = True
    for part in ("first", "middle"):
        x, y, xi, yi = a[part], b[part], a[part + "_initial"], b[part + "_initial"]
        if x and y:
            if not _same_given(x, y):
                return None
            score += 1.0
        elif xi and yi:
            if xi != yi:
                return None
            score += 0.5
            whole = whole and part == "middle"
        else:
            whole = whole and (part == "middle" and bool(a["first"] and b["first"]) or a["cls"] in ("office", "other") or (part == "middle" and a["cls"] == "firm"))
    if a["cls"] == "person" and not (a["first_initial"] and b["first_initial"]):
        return None
    allowed = 1 if a["cls"] in ("office", "other") or not whole or min(len(a["own"]), len(b["own"])) < 7 else 2
    if edits > allowed or (edits and min(len(a["own"]), len(b["own"])) < 4):
        return None
    return score


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    left, right = a.to_dict("records"), b.to_dict("records")
    return pd.Series([agree(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")


def learned_trades(distinct: DataFrame) -> list[str]:
    """Words of at least LEARNED_SHARE of the distinct bidders' names that mostly name firms: at most words a name / LEARNED_SHARE."""
    low = F.lower(F.regexp_replace("name", r"[^\p{L}]+", " "))
    known = list({*_TRADE, *_TAIL, *_LEGAL, *OPENERS, *JOINERS, *TITLES, *_GIVEN, *MIDDLES})
    marks = list({*_TRADE, *_TAIL, *_LEGAL})
    ws = distinct.where("kind = 'bidder'").select(F.array_distinct(F.split(F.trim(low), " +")).alias("ws"))
    total = ws.count()
    firm = F.arrays_overlap("ws", F.array(*[F.lit(m) for m in marks]))
    seen = ws.select(F.explode("ws").alias("w"), firm.cast("int").alias("firm")).where((F.length("w") > 3) & ~F.col("w").isin(known)).groupBy("w").agg(F.count("*").alias("n"), F.avg("firm").alias("firms"))
    return sorted(r.w for r in seen.where((F.col("n") >= max(LEARNED_LEAST, LEARNED_SHARE * total)) & (F.col("firms") >= LEARNED_FIRMS)).select("w").collect())


def profiles_of(names: DataFrame) -> DataFrame:
    """(kind, name, the parts of its profile, forms, pid) of every distinct name; pid is null where the string is no name. Stored."""
    distinct = cut(names.select("kind", "name").where("name is not null").distinct())
    tasks = distinct.sparkSession.sparkContext.defaultParallelism
    read = distinct.repartition(tasks, "name").withColumn("p", _profiles(frozenset(learned_trades(distinct)))("kind", "name"))  # a fixed number of tasks: adaptive execution would make one
    return cut(read.select("kind", "name", *[F.col(f"p.{c}").alias(c) for c in [*PROFILE, "forms"]]).withColumn("pid", F.when(F.col("cls").isNotNull(), F.xxhash64("kind", *PROFILE))))


def links_of(profiles: DataFrame) -> DataFrame:
    """(u, v, pu, pv, score): pairs of profiles that share a rewriting rare enough for its cost and agree part by part."""
    total = profiles.count()
    forms = profiles.select("pid", "kind", F.explode("forms").alias("f")).select("pid", "kind", "f.form", "f.cost")
    rarity = forms.groupBy("kind", "form").agg(F.count("*").alias("n")).where("n > 1").select("kind", "form", F.log((total + F.lit(float(PRIOR))) / F.col("n")).alias("rarity"))
    shared = forms.join(rarity, ["kind", "form"]).where("rarity >= cost")
    a = shared.select("kind", "form", "rarity", F.col("pid").alias("u"), F.col("cost").alias("cu"))
    b = shared.select("kind", "form", F.col("pid").alias("v"), F.col("cost").alias("cv"))
    rare = a.join(b, ["kind", "form"]).where("u < v and rarity >= cu + cv").groupBy("u", "v").agg(F.max(F.col("rarity") - F.col("cu") - F.col("cv")).alias("rarity"))
    parts = profiles.select("pid", F.struct(*PROFILE).alias("p"))
    pairs = rare.join(parts.select(F.col("pid").alias("u"), F.col("p").alias("pu")), "u").join(parts.select(F.col("pid").alias("v"), F.col("p").alias("pv")), "v")
    return cut(pairs.withColumn("score", _agreement.asNondeterministic()("pu", "pv")).where("score is not null").select("u", "v", "pu", "pv", (F.col("score") + F.col("rarity") / 100).alias("score")))


def parties(names: DataFrame) -> DataFrame:
    """(kind, name, party, links): the party of every distinct (kind, name) string, null where the string is no name, and its number of
    links to other spellings.

    Work is on distinct profiles, so spellings that the rules already undo never form pairs. The joins are on rewritings and carry
    ids and costs only; nothing is gathered by party."""
    read = profiles_of(names)
    profiles = cut(read.where("pid is not null").groupBy("pid").agg(F.first("kind").alias("kind"), *[F.first(c).alias(c) for c in [*PROFILE, "forms"]]))
    edges = cut(_unambiguous(links_of(profiles)).distinct())
    member = components(edges)
    degree = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    joined = read.select("kind", "name", "pid").join(member.join(degree, "id"), F.col("pid") == F.col("id"), "left")
    return joined.select("kind", "name", F.coalesce("component", "pid").alias("party"), F.coalesce("links", F.lit(0)).alias("links"))


def _unambiguous(links: DataFrame) -> DataFrame:
    """Links between complete profiles, those of a less complete one to its best ones of higher tiers if these do not contradict each
    other, and those of two incomplete ones of a tier if neither has a link to a higher one."""
    ends = links.withColumn("tu", F.col("pu.tier")).withColumn("tv", F.col("pv.tier"))
    sure = ends.where("tu = '2' and tv = '2'").select("u", "v")
    lower = F.col("tu") < F.col("tv")
    pick = lambda a, b: F.when(lower, F.col(a)).otherwise(F.col(b))
    half = ends.where("tu <> tv").select(pick("u", "v").alias("x"), pick("pu", "pv").alias("px"), pick("v", "u").alias("y"), pick("pv", "pu").alias("py"), F.floor(F.col("score") * 2).alias("level"))
    best = half.groupBy("x").agg(F.max("level").alias("top"))
    own = F.when((F.col("px.cls") == "firm") & (F.col("px.tier") == "0"), F.substring("py.own", 1, 4))
    who = F.concat_ws("/", "py.cls", "py.first", F.when(F.col("py.cls").isin("firm", "other"), F.col("py.trade")), own)
    middle = F.nullif(F.col("py.middle"), F.lit(""))
    at_top = half.join(best, "x").where("level = top").select("x", "y", who.alias("who"), middle.alias("middle"))
    one = at_top.groupBy("x").agg(F.min("who").alias("a"), F.max("who").alias("b"), F.min("middle").alias("ma"), F.max("middle").alias("mb")).where("a = b and (ma is null or ma = mb)").select("x")
    attached = at_top.join(one, "x", "left_semi").select(F.col("x").alias("u"), F.col("y").alias("v"))
    tied = half.select("x").distinct()
    loose = ends.where("tu = tv and tu <> '2'").select("u", "v").join(tied, F.col("u") == F.col("x"), "left_anti").join(tied, F.col("v") == F.col("x"), "left_anti")
    return sure.unionByName(attached).unionByName(loose)


def same_party_pairs(named: DataFrame) -> DataFrame:
    """(kind, name_a, name_b): all pairs of strings of one party, name_a before name_b in byte order."""
    known = named.where("party is not null")
    a = known.select("kind", "party", F.col("name").alias("name_a"))
    b = known.select("kind", "party", F.col("name").alias("name_b"))
    return a.join(b, ["kind", "party"]).where("name_a < name_b").select("kind", "name_a", "name_b")
