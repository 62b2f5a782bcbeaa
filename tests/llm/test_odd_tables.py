"""Every operator on tables with nulls in any column, repeated and very long rows, and extra columns whose names clash with its own."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.llm import leakage, mixing, names, nearcopies, private, residue, scans

CLASHES = ["n", "key", "keys", "bits", "u", "v", "id", "component", "grp", "block", "rep", "o", "file", "runs", "confidence", "pattern", "x", "taken", "term", "run", "pos", "words", "share", "p", "w", "trusted", "forms", "pid", "party", "links", "times", "text_key", "steps"]
WORDS = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]


def _odd(frame):
    """The same rows with extra columns of clashing names."""
    return frame.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES) if c not in frame.columns])


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def _pages(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        body = [rng.choice(WORDS) for _ in range(90)]
        text = "\n".join(["Running header of the office   3 | 9", *(" ".join(body[j : j + 9]) for j in range(0, 90, 9))])
        rows.append((k, f"t{k % 3}", "b", f"f{k // 4}", text, "native" if k % 2 else "ocr", None if k % 5 else 50.0))
    rows += [(100, *rows[3][1:]), rows[3], (101, None, None, None, rows[4][4], None, None), (102, "t", "b", "f", None, None, None), (103, "t", "b", "f", "", "ocr", float("nan")), (None, None, None, None, rows[5][4], "ocr", 3.0), (104, "t", "b", "f", "word " * 60_000, "ocr", 9.0)]
    return spark.createDataFrame(rows, "page_id bigint, tender_id string, bidder_name string, source_file string, text string, source string, ocr_confidence double")


def test_copies(spark):
    pages = _pages(spark)
    plain = _rows(nearcopies.classes(pages))
    assert plain == _rows(nearcopies.classes(_odd(pages)))
    classed = {r[0]: r[1] for r in plain}
    assert classed[100] == classed[3] == 3
    assert classed[101] == classed[4]
    assert None not in classed


def test_scans(spark):
    pages = _pages(spark)
    papers = spark.createDataFrame([(k, f"T{k % 4}") for k in range(60)] + [(None, None), (1, None)], "page_id bigint, doc_type string")
    assert _rows(scans.noisy_lines(pages, papers)) == _rows(scans.noisy_lines(_odd(pages), _odd(papers)))
    assert {r.page_id for r in scans.repaired(_odd(pages), papers).collect()} >= {0, 100, 101, 104}


def test_private(spark):
    texts = spark.createDataFrame([("page_results", 1, "Tel: (0804) 269699"), ("page_results", 1, "Tel: (0804) 269699"), (None, 2, "Tel: (0804) 269699"), ("page_results", None, None), ("page_results", 3, ""), ("page_results", 4, "Tel: (0804) 269699 " + "plain " * 50_000)], "src string, row_id bigint, text string")
    found = _rows(private.items(_odd(texts)))
    assert found == _rows(private.items(texts))
    assert ("page_results", 1, "phone", 1) in found and found.count(("page_results", 1, "phone", 1)) == 1
    assert ("page_results", 4, "phone", 1) in found
    assert private.replaced(_odd(texts)).count() == 6


def test_leaks(spark):
    item = " ".join(WORDS[:60])
    docs = spark.createDataFrame([(1, "x " + item), (2, None), (3, ""), (None, item), (4, "pad " * 90_000 + item)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(_odd(docs), _odd(items)).collect()}
    assert got == {(1, 1), (1, 4), (4, 1), (4, 4)}
    assert leakage.leaks(docs, items.limit(0)).count() == 0


@pytest.mark.skipif(not __import__("os").path.exists(mixing.VOCABULARY), reason="no vocabulary")
def test_mix(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "a" if k % 3 else "b") for k in range(90)] + [(90, None, "a"), (91, "text 1", None), (None, "no id", "a")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 3), (None, 0.4, 2), ("c", None, None), ("a", 0.7, 1)], "source string, target_share double, max_repeats int")
    assert _rows(mixing.mix(docs, targets)) == _rows(mixing.mix(_odd(docs), _odd(targets)))
    assert {r.source for r in mixing.shares(_odd(docs), _odd(targets)).collect()} == {"a", "b", "c"}


def test_residue(spark):
    docs = spark.createDataFrame([(k, "The contractor shall deploy workers for pest control." if k % 4 else "Dear {{name}}, your offer has been registered.") for k in range(40)] + [(50, None), (51, ""), (None, None)], "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residue_ids(_odd(docs)).collect()} == {k for k in range(40) if not k % 4}
    assert residue.without_residue(_odd(docs)).columns == _odd(docs).columns


def test_names(spark):
    frame = spark.createDataFrame([("bidder", "Silver Jogolzupa Traders"), ("bidder", "Silver  Jogolzupa TRADERS"), ("bidder", None), (None, "Silver Jogolzupa Traders"), ("buyer", ""), ("bidder", "ab " * 40_000)], "kind string, name string")
    got = _rows(names.same_party_pairs(names.parties(_odd(frame))))
    assert [r for r in got if r[0] == "bidder"] == [("bidder", "Silver  Jogolzupa TRADERS", "Silver Jogolzupa Traders")]
