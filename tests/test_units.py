from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from dossier.operators import units

CATALOG = "doc_type string, field_name string, value_type string, default_unit string, is_required boolean"
FIELDS = "field_id bigint, document_id bigint, tender_id string, field_name string, field_value string, extracted_at timestamp_ntz"


@pytest.mark.parametrize(
    ("text", "amount", "stated"),
    [
        ("Rs 82029 ('000)", 82_029_000, True), ("10.12 LAC only", 1_012_000, True), ("Rs 10.03799 L", 1_003_799, True), ("9 crore 21 lakh 35 thousand", 92_135_000, True),
        ("Rupees Fifteen Crore Thirty Eight Lakh Nineteen Thousand Three Hundred Sixty Seven only", 153_819_367, True), ("INR 0.519 mn", 519_000, True), ("Rs 0.257M", 257_000, True), ("1,003 K", 1_003_000, True),
        ("Rs.1227.35 lakhs/-", 122_735_000, True), ("32.41 (Rs. in lakhs)", 3_241_000, True), ("amount in crore: 1.60", 16_000_000, True), ("₹2,94,06,000", 29_406_000, True), ("62,10,000", 6_210_000, False),
        ("-500", -500, False), ("Rs. -5 lakh", -500_000, True), ("- Rs 7", -7, True), ("Rs. 5 lakh " + "being the worth of it all " * 40, 500_000, True),
        ("Eighteen Crore Forty Four Lakh Rupees", 184_400_000, True), ("5 crore 20 thousand", 50_020_000, True), ("Rs. 9,86,45,000/- (Rupees Nine Crore only)", 98_645_000, True), ("0", 0, False),
    ],
)
def test_amounts(text, amount, stated):
    assert units.read_quantity(text) == (Decimal(amount), stated)


@pytest.mark.parametrize("text", [None, "", " ", "see annexure", "N.A.", "??", "illegible", "-", "1 and 2", "9" * 5000, "as per contract"])
def test_unreadable(text):
    assert units.read_quantity(text) is None


@pytest.mark.parametrize(("text", "unit"), [("Amounts: Rs. in lacs", 10**5), ("राशि लाख रुपये में", 10**5), ("(Amounts in Rs. crore)", 10**7), ("Amounts in Rs. '000", 1000), ("figure in rupees", 1), ("Average Annual Turnover", None), (None, None)])
def test_units(text, unit):
    assert units.unit_of(text) == unit


def test_priors_decide_between_dimensions():
    assert units.segment("m", "money")[1] == 6
    assert units.segment("m", "length")[2] == "length"
    assert units.unit_of("km", "length") == 1000
    assert units.unit_of("m2", "length") == 1
    assert units.read_quantity("5 km", "length") == (Decimal(5000), True)
    assert units.segment("services", "money") is None


@pytest.mark.parametrize(("run", "dimension", "power"), [("mm", "length", -3), ("mg", "mass", -3), ("ms", "time", -3), ("mm2", "length", -6), ("cm", "length", -2), ("dm", "length", -1), ("m", "money", 6)])
def test_small_prefixes(run, dimension, power):
    assert units.segment(run, dimension)[1] == power


def test_unit_in_a_long_note():
    assert units.unit_of("as told in the notice of this office. " * 90 + "All limits are in crore") == 10**7


@given(st.integers(1, 10**12), st.sampled_from([("lakh", 5), ("crore", 7), ("K", 3), ("mn", 6)]))
def test_round_trip(amount, unit):
    name, power = unit
    value = Decimal(amount) / Decimal(10) ** power
    found = units.read_quantity(f"Rs {value:f} {name}")
    assert found is not None
    assert found[0] == amount


def test_field_amounts(spark):
    fields = spark.createDataFrame(
        [(1, 10, "t", "Total Contract-Value:", "5.5", None), (2, 10, "t", "total_contract_value", "Rs 7", None), (3, 10, "t", "total_contract_value", None, None), (4, 11, "t", "turnover", "3", None), (5, 12, "t", "turnover", "2", None), (6, 10, "t", "other", "2", None), (7, 99, "t", "turnover", "2", None), (8, 10, "t", "total_contract_value", "", None)],
        FIELDS,
    )
    papers = spark.createDataFrame([(10, 100, "EXP"), (11, 101, "TO"), (12, 102, "TO")], "document_id bigint, page_id bigint, doc_type string")
    catalog = spark.createDataFrame([("EXP", "total_contract_value", "money", "inr", True), ("TO", "turnover", "money", "lakh", True)], CATALOG)
    pages = spark.createDataFrame([(100, "x\n(All figures in Rs. lakhs)\ny"), (101, None), (102, "Figures in crores of rupees")], "page_id bigint, text string")
    got = {r.field_id: r.value_inr for r in units.field_amounts(fields, papers, catalog, pages).collect()}
    assert got == {1: 550_000, 2: 7, 4: 300_000, 5: 20_000_000}
    assert units.field_amounts(fields.limit(0), papers, catalog, pages).count() == 0


def test_rule_amounts(spark):
    rules = spark.createDataFrame(
        [(1, "Turnover (Rs. lakh)", None, 7.3), (2, "Turnover", "limit is in crore", 0.25), (3, "Turnover", None, 5e6), (4, "Turnover", None, 0.0), (5, "Turnover", None, None), (6, "Turnover (लाख रुपये में)", None, 9.0)], "rule_id bigint, label string, note string, min_value_inr double"
    )
    assert {r.rule_id: r.value_inr for r in units.rule_amounts(rules).collect()} == {1: 730_000, 2: 2_500_000, 3: 5_000_000, 6: 900_000}
