import itertools

import pytest

from dossier.llm import names
from dossier.llm.graph import components

PARTIES = {
    "bidder": [
        ["Northern Huteyaza Associates and Sons", "19. Northern Huteyaza Assoc. and Sons", "N. Huteyaza Associates n Sons", "Huteyaza Associates & Sons, Northern", "NORTHERN HUTEYAZA ASSOCIATES AND SONS", "Northern Hutyeaza Associates and Sons"],
        ["Pioneer Lichupache Facility Services Private Limited", "Pioneer Lichupache Fac. Svcs PVT LIMITED", "Pioneer Lichupache F.S. (P) Ltd.", "Pioneer_Lichupache_Facility_Services", "M/s Pioneer Leechupache Facility Services P. Ltd"],
        ["Umashankar Rani Lojurbeto", "Prop. U Rani Lojurbeto", "Lojurbeto, U.R.", "Shri Umashankar R Lojurbeto", "UMASHANKAR LOJURBETO"],
        ["Vijayendra Kumar Thajirdhuke", "Thajirdhuke Viju", "Mr V Thajirdhukke", "Vijayendra Kumar Thajirdhuke (Prop.)"],
        ["Surendra Nath Chejehosa", "Suren Chejehosa"],
        ["Indrajit Das Chejehosa", "Chejehosa, I.D."],
        ["Northern Badotethu Traders Limited"],
        ["Pioneer Badotethu Waterproofing Contractors Limited", "Pioneer BADOTTEHU W/proofing Contrs Ltd."],
    ],
    "buyer": [
        ["Office of the Cantonment Board, Luponnupekhera", "Luponnupekhera Cantt. Bd.", "CB, Luponnupekhera", "The Cantonment Board, Looponnupekhera", "C.B. Luponnupekhera"],
        ["Office of the Municipal Council, Luponnupekhera", "M.C. Luponnupekhera", "Luponnupekhera, Municipal Council", "O/o Mun. Council (Luponnupekhera)"],
        ["Office of the Public Works Division, Rujordhidugarh", "P.W.D. Rujordhidugarh", "Office of Publeec Works Division, Rujordhidugarh"],
    ],
}


def test_parties(spark):
    rows = [(kind, n) for kind, groups in PARTIES.items() for g in groups for n in g]
    frame = spark.createDataFrame(rows * 2 + [("bidder", None), ("buyer", ""), ("buyer", "illegible"), ("bidder", "x" * 9000), ("bidder", "123")], "kind string, name string")
    got = {tuple(r) for r in names.same_party_pairs(names.parties(frame)).collect()}
    want = {(kind, *sorted(p, key=lambda s: s.encode())) for kind, groups in PARTIES.items() for g in groups for p in itertools.combinations(g, 2)}
    assert got == want


#: Names of no list: given names, firms and offices the rules have never seen.
UNLISTED = {
    "bidder": [
        ["Rahul Sharma", "R. Sharma", "Sharma, Rahul", "Sharma Rahul", "Shri Rahul Sharma"], ["Prakash Iyer"], ["William Johnson", "Bill Johnson", "Johnson, Bill"],
        ["Mehta Brothers", "Mehta Bros.", "M/s MEHTA BROS"], ["Tata Consultancy Services Ltd", "TCS Limited", "T.C.S. Ltd"], ["Hudson Bay Trading Company", "Hudson Bay Trading Co."],
    ],
    "buyer": [["Northern Railway", "NORTHERN  RAILWAY", "The Northern Railwey"], ["Ministry of Defence", "The Ministry of Defence", "Ministry of Defense"], ["Chief Engineer, Pune", "C.E. Pune", "Office of the Chief Engineer (Pune)"], ["Chief Engineer, Nashik"]],
}


def test_unlisted_names(spark):
    rows = [(kind, n) for kind, groups in UNLISTED.items() for g in groups for n in g]
    got = {tuple(r) for r in names.same_party_pairs(names.parties(spark.createDataFrame(rows, "kind string, name string"))).collect()}
    want = {(kind, *sorted(p, key=lambda s: s.encode())) for kind, groups in UNLISTED.items() for g in groups for p in itertools.combinations(g, 2)}
    assert got == want


def test_learned_trades_and_rarity(spark):
    rows = [("bidder", f"Own{a}{b}kel Plumbing Works") for a in "abcdefg" for b in "abcde"] + [("bidder", f"Given{a}{b} Verma") for a in "abcdefg" for b in "abcdefg"]
    frame = spark.createDataFrame(rows, "kind string, name string")
    assert names.learned_trades(frame) == ["plumbing"]
    profiles = names.profiles_of(frame)
    assert {r.trade for r in profiles.where("cls = 'firm'").collect()} == {"plumbing"}


def test_a_common_rewriting_is_no_link(spark):
    """A form that most profiles share costs more than its rarity gives."""
    profile = names.profile_of("bidder", "Silver Jogolzupa Traders")
    rows = [(k, "bidder", [("shared", 4.0)], *[profile[c] for c in names.PROFILE]) for k in range(30)] + [(100 + k, "bidder", [("rare", 2.0)], *[profile[c] for c in names.PROFILE]) for k in range(2)]
    schema = "pid bigint, kind string, forms array<struct<form:string,cost:double>>, " + ", ".join(f"{c} string" for c in names.PROFILE)
    assert [(r.u, r.v) for r in names.links_of(spark.createDataFrame(rows, schema)).collect()] == [(100, 101)]


@pytest.mark.parametrize(("a", "b"), [("x" * 300, "x" * 150 + "y" + "x" * 149), ("abcdefghijklmnopqrstuvwxyzabcd", "abcdefghijkmnopqrstuvwxyzacd"), ("abcdefg", "bacdegf"), ("abcdefgh", "abdfgh")])
def test_forms_meet_within_two_edits(a, b):
    assert names.near(a, b, 2) <= 2
    assert set(names._out(a, True)) & set(names._out(b, True))


def test_ambiguous_tiers(spark):
    frame = spark.createDataFrame([("bidder", n) for n in ["Rahul Sharma", "Rakesh Sharma", "R. Sharma", "Tata Consultancy Services Ltd", "Tuna Canning Services Ltd", "TCS Ltd"]], "kind string, name string")
    assert names.same_party_pairs(names.parties(frame)).count() == 0


def test_ambiguous_initial_is_left_alone(spark):
    frame = spark.createDataFrame([("bidder", n) for n in ["Surendra Nath Chejehosa", "Sanjeevan Das Chejehosa", "Mr S Chejehosa"]], "kind string, name string")
    assert names.same_party_pairs(names.parties(frame)).count() == 0


def test_empty(spark):
    assert names.same_party_pairs(names.parties(spark.createDataFrame([], "kind string, name string"))).count() == 0


@pytest.mark.parametrize(("a", "b", "edits"), [("abc", "abc", 0), ("abcd", "abdc", 1), ("abc", "abx", 1), ("abc", "ab", 1), ("abc", "xyz", 2)])
def test_near(a, b, edits):
    assert names.near(a, b, 1) == edits


def test_components_against_union_find(spark):
    import random

    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[max(find(u), find(v))] = min(find(u), find(v))
    linked = {x for u, v in edges if u != v for x in (u, v)}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges * 2 + [(None, 3)], "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in linked}


def test_two_edits_in_different_halves(spark):
    pair = ["Silver Jogolzupa Printing Press Private Limited", "Silver_Jgoolzupa_Printing_Press_Pvt_Ltd"]
    got = names.same_party_pairs(names.parties(spark.createDataFrame([("bidder", n) for n in pair], "kind string, name string"))).collect()
    assert [tuple(r) for r in got] == [("bidder", *pair)]
