import random

import pytest

from dossier.llm import scans
from dossier.llm.confusions import misreadings, variants

BODY = [
    "the contractor shall deploy fifty workers in three shifts for the supply of winter clothing",
    "damage caused during execution shall be repaired by the agency within nine days of notice",
    "each bidder folder must carry a certificate and the declaration of the firm for inspection",
    "a self-declaration that the bidder has not been banned is mandatory and a no-dues slip was issued",
]
PAGES = "page_id bigint, tender_id string, bidder_name string, source_file string, page_number int, text string, source string"


def _corpus(spark, extra):
    random.seed(3)
    rows, papers = [], []
    for k in range(60):
        lines = [f"Tender document for pest control   {k % 4 + 1} | 4", *random.sample(BODY, 3), f"Office of the Depot at place {k}"]
        rows.append((k, "t", "b", f"f{k // 4}", k % 4 + 1, "\n".join(lines), "native"))
        papers.append((k, f"T{k % 5}"))
    rows += [(1000 + k, "t", "b", "g", k, text, source) for k, (text, source) in enumerate(extra)]
    return spark.createDataFrame(rows, PAGES), spark.createDataFrame(papers, "page_id bigint, doc_type string")


def test_lines_and_paragraphs(spark):
    scan = "Tender docum9nt for pest control   2 | 4\nthe contractor shall clcploy fifty vvorkers in three shi-\n3\nfts for the supply of wintcr clothing. A self-\ndeclaration is mandatory.\n\nDamage caused dur­\ning execufion shall be repaired"
    pages, papers = _corpus(spark, [(scan, "ocr"), (None, None), ("", "ocr"), (scan, "native"), ("x " * 30_000, "ocr")])
    got = {tuple(r) for r in scans.noisy_lines(pages, papers).where("page_id >= 1000").collect()}
    lines = {(1000, 1, "furniture"), (1000, 3, "furniture"), (1000, 2, "hyphen"), (1000, 7, "hyphen"), (1000, 2, "misread"), (1000, 4, "misread"), (1000, 8, "misread")}
    assert {g for g in got if g[0] == 1000} == lines
    assert {g[1:] for g in got if g[0] == 1003} == {x[1:] for x in lines if x[2] != "misread"}
    text = [r.paragraph for r in scans.repaired(pages, papers).where("page_id = 1000").orderBy("paragraph_no").collect()]
    assert text == ["the contractor shall deploy fifty workers in three shifts for the supply of winter clothing. A self-declaration is mandatory.", "Damage caused during execution shall be repaired"]


def test_empty(spark):
    pages, papers = _corpus(spark, [])
    assert scans.noisy_lines(pages.limit(0), papers).count() == 0


def test_openings_joined_or_sent(spark):
    """Both ways of bringing running openings to pages give the same lines."""
    scan = "Tender docum9nt for pest control   2 | 4\nthe contractor shall deploy\n3\nfifty workers\nTender document for pest control   2 | 4"
    pages, papers = _corpus(spark, [(scan, "ocr"), (None, None), ("", "ocr")])
    sent = {tuple(r) for r in scans.noisy_lines(pages, papers).collect()}
    assert sent == {tuple(r) for r in scans.noisy_lines(pages, papers, few=0).collect()}
    assert (1000, 1, "furniture") in sent


@pytest.fixture(scope="module")
def decoder():
    words = {w: 50 for line in BODY for w in line.split()}
    return scans.Decoder(words, {}, 100)


FURNITURE = scans.Furniture(["tender document for", "confidential: §", "9 | 9"])


def _said(decoder, text, confidence=None):
    page = decoder.page(text, True, FURNITURE, confidence)
    return " / ".join(decoder.paragraphs(page)), decoder.noise(page)


def test_splits_merges_and_confusions_together(decoder):
    assert _said(decoder, "the contr actor shall deployfifty workers")[0] == "the contractor shall deploy fifty workers"
    assert _said(decoder, "the contrac\ntor shall deploy") == ("the contractor shall deploy", (set(), set()))
    said, (_, misread) = _said(decoder, "the contractor shalldcploy fifty workers")  # a lost blank and a misread letter in one word
    assert (said, misread) == ("the contractor shall deploy fifty workers", {0})
    said, (_, misread) = _said(decoder, "the certif icatc was issued")  # a blank too many and a misread letter
    assert (said, misread) == ("the certificate was issued", {0})
    said, (hyphens, misread) = _said(decoder, "the agcn-\ncy shall exe-\ncutlon of")
    assert (hyphens, misread) == ({0, 1}, {0, 2})
    assert said == "the agency shall execution of"


def test_confidence_is_a_prior(decoder):
    """A doubtful reading is taken on a page the recogniser was unsure of, not on one it was sure of."""
    doubtful = scans.Decoder({**decoder.words, "rivet": 2}, {}, 10**7)
    assert _said(doubtful, "the rlvet of", 45.0) == ("the rivet of", (set(), {0}))
    assert _said(doubtful, "the rlvet of") == ("the rivet of", (set(), {0}))
    assert _said(doubtful, "the rlvet of", 99.0) == ("the rlvet of", (set(), set()))


def test_single_misreadings_are_found(decoder):
    random.seed(1)
    words = [w for w in decoder.words if len(w) > 5 and w.isalpha()]
    made = [(w, w[:at] + read + w[at + len(true) :]) for w in words for true, read in scans.READ_AS for at in range(len(w)) if w.startswith(true, at)]
    missed = [(w, m) for w, m in made if m not in decoder.words and decoder.read(m) is None]
    assert len(made) > 150
    assert not missed
    assert all(decoder.arcs(w) is None for w in words)


def test_skeletons_keep_confusions():
    assert all(true.translate(scans._SKELETON) == read.translate(scans._SKELETON) for true, read in scans.READ_AS)
    assert scans.confusions("deploy", "dcploy", 2) == 1
    assert scans.confusions("deploy", "clcploy", 2) == 2
    assert scans.confusions("deploy", "clcp1oy", 2) == 3
    assert scans.confusions("deploy", "deploy", 2) == 0


def test_furniture():
    for line in ("Page 3 of 9", "- 4 -", "[12]", "7", "पृष्ठ 3", "Pg. 2/5", "Page No. 02", "Confidential: TE/12/2020-21   [3]", "TENDER DOCUMENT FOR PEST CONTROL", "Conf1dential: TE/12/2020-21"):
        assert FURNITURE(line), line
    for line in ("", "9.", "TO WHOM IT MAY CONCERN", "Form GST REG-06", "the tender document for the supply", "paragraph 4.2", "25-11-2017.", "Copy 2"):
        assert not FURNITURE(line), line


def test_variants():
    assert {"prakash", "prak@sh", "pra1"} & variants(("prakash",)) == {"prakash", "prak@sh"}
