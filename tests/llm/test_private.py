import random

import numpy as np
import pytest

from dossier.llm import private

CASES = [
    ("write: dakoper @ hokar.invalid.", "email", "dakoper @ hokar.invalid"), ("sent to digorer [at] boror [dot] test with", "email", "digorer [at] boror [dot] test"), ("CALL: CHOHUSHAL@JAMAN.EXAMPLE.", "email", "CHOHUSHAL@JAMAN.EXAMPLE"),
    ("Tel: (0804) 269699", "phone", "(0804) 269699"), ("Call +91-5549673195 or", "phone", "+91-5549673195"), ("alternate 559-017-9708.", "phone", "559-017-9708"), ("M: 55388\n53644", "phone", "55388\n53644"), ("Ph: 915535619596", "phone", "915535619596"),
    ("holding Passport No. Z2771751 will", "id_number", "Z2771751"), ("paper (1647-4545-2718) of", "id_number", "1647-4545-2718"), ("Card\nZYNXG3498G\nName", "id_number", "ZYNXG3498G"), ("Licence XK-5220021620835)", "id_number", "XK-5220021620835"),
    ("posted to H. No. 230, Pusim Street, Hetarkhera - 462239.", "address", "H. No. 230, Pusim Street, Hetarkhera - 462239"), ("Village Yizam, P.O. Lisul, Kaminganj, PIN 961433.", "address", "Village Yizam, P.O. Lisul, Kaminganj, PIN 961433"),
    ("The undersigned, Smt. Venkatesh Sedhepal, residing at", "person", "Venkatesh Sedhepal"), ("needed for T.\nBikubor and", "person", "T.\nBikubor"), ("Name: Chandrika Lal Dezeyol\nFather", "person", "Chandrika Lal Dezeyol"), ("contact Vijayen-\ndra Tamujol on 55", "person", "Vijayen-\ndra Tamujol"),
]


@pytest.mark.parametrize(("text", "kind", "item"), CASES)
def test_spans(text, kind, item):
    assert item in [text[a:b] for k, a, b, _ in private.spans(text) if k == kind]


@pytest.mark.parametrize("text", [None, "", "Contract No: GEMC-314189695482642", "UDIN 24422111AVGUFK1719", "GSTIN 06PXKXN1476Z5ZV", "UDYAM-XA-43-8779925", "Rs. 4,92,48,000 on 16-02-2025", "overh@ul of diesel sets", "Works Manager", "Stores wing, Bagoganj", "D.H. Lojurchothawadi"])
def test_no_spans(text):
    assert [s for s in private.spans(text) if 1 in s[3]] == []


def test_items_and_placeholders(spark):
    filler = [("page_results", 100 + k, text) for k, (text, _, _) in enumerate(CASES * 3)]
    rows = [("page_results", 1, "Tel: (0804) 269699\n\nName: Prakash Das Sasishum\nwrite: a.b@c.test and\nPh: 915535619596"), ("extracted_fields", 1, "good. Call 5543262385 or write: lehijor(at)bosim.example."), ("page_results", 2, None), ("page_results", 3, ""), ("page_results", 4, "plain " * 20_000)]
    texts = spark.createDataFrame(rows + filler, "src string, row_id bigint, text string")
    got = {tuple(r) for r in private.items(texts).where("row_id < 100").collect()}
    assert got == {("page_results", 1, "phone", 1), ("page_results", 1, "person", 3), ("page_results", 1, "email", 4), ("page_results", 1, "phone", 5), ("extracted_fields", 1, "phone", 1), ("extracted_fields", 1, "email", 1)}
    masked = {(r.src, r.row_id): r.text for r in private.replaced(texts).where("row_id < 100").collect()}
    assert masked["page_results", 1] == "Tel: [PHONE]\n\nName: [PERSON]\nwrite: [EMAIL] and\nPh: [PHONE]"
    assert masked["extracted_fields", 1] == "good. Call [PHONE] or write: [EMAIL]."
    assert (masked["page_results", 2], masked["page_results", 3], masked["page_results", 4]) == (None, "", "plain " * 20_000)
    assert private.items(texts.limit(0)).count() == 0


def test_reliabilities_of_planted_labelers():
    """Labelers of known accuracy vote on known truths; the estimated labels and the classifier must find the truths."""
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    votes = np.stack([np.where(rng.random(len(truth)) < p, np.where(truth, 1, -1), np.where(rng.random(len(truth)) < 0.5, 0, np.where(truth, -1, 1))) for p in (0.9, 0.8, 0.7, 0.6)], 1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = private.reliabilities(patterns, counts.astype(float))
    w = private.classifier([[3 * j + v + 1 for j, v in enumerate(row)] for row in patterns], p)
    decided = np.array([w[[3 * j + v + 1 for j, v in enumerate(row)]].sum() + w[-1] >= 0 for row in patterns])[at.ravel()]
    assert (decided == truth).mean() > 0.9


LISTED = ["Prakash", "Rajendra", "Venkatesh", "Lakshmi", "Surendra", "Jitendra", "Elizabeth", "Gurpreet"]
UNLISTED = ["Rahul", "Priya", "Anita", "Deepak", "Sunita", "Arjun", "Kavita", "Nikhil", "Meera", "Farida"]
SURNAMES = ["Sharma", "Verma", "Desai", "Iyer", "Menon", "Tagore", "Bhatt", "Gill"]
FRAMES = ["Signed by Shri {}, Manager.", "For details contact {} on +91-5549673195.", "The undersigned, Smt. {}, residing at Pusim.", "Bill recorded from Mr. {} in presence of two.", "Certificate given to Shri {}, Proprietor of the firm."]
PLAIN = ["Signed by the {} Manager.", "For details contact Works {} on +91-5549673195.", "The {} shall supply Floor Tiles to the Supply Depot.", "Payment is made by {} Works Division.", "All Bills of the {} are kept at Stores Wing.", "Space is needed for Floor Tiles of the {}.", "Space is needed for Pest Control of the {}."]


def test_names_of_no_list(spark):
    """Given names that no gazetteer has are found by their context, and capitalised words in like places are not."""
    rng = random.Random(6)
    rows, unlisted, plain = [], set(), set()
    for k in range(1500):
        row = ("page_results", k)
        if k % 3 == 0:
            rows.append((*row, rng.choice(FRAMES).format(f"{rng.choice(LISTED)} {rng.choice(SURNAMES)}")))
        elif k % 3 == 1:
            rows.append((*row, rng.choice(PLAIN).format(rng.choice(["Site", "Stores", "Depot", "Accounts", "Contract"]))))
            plain.add(k)
        elif k % 9 == 2:
            rows.append((*row, rng.choice(FRAMES).format(f"{rng.choice(UNLISTED)} {rng.choice(SURNAMES)}")))
            unlisted.add(k)
    texts = spark.createDataFrame(rows, "src string, row_id bigint, text string")
    found = {r.row_id for r in private.items(texts).where("kind = 'person'").collect()}
    assert len(unlisted & found) >= 0.9 * len(unlisted)
    assert not plain & found
    report = {r.kind: r for r in private.decisions(private.proposals(texts)).collect()}
    assert report["person"].overruled > 0
    masked = {r.row_id: r.text for r in private.replaced(texts).collect()}
    assert sum("[PERSON]" in masked[k] for k in unlisted) >= 0.9 * len(unlisted)
