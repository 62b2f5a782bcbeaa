import datetime

import pytest
from pyspark.sql import functions as F

from dossier.functions import cells
from dossier.operators import wide

FIELDS = "field_id bigint, document_id bigint, tender_id string, field_name string, field_value string, extracted_at timestamp_ntz, doc_type string"


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(
        [("A", "start", "date", None, True), ("A", "seal", "boolean", None, False), ("A", "number", "integer", None, False), ("A", "value", "money", "lakh", False), ("A", "name", "text", None, False), ("B", "start", "date", None, False)],
        "doc_type string, field_name string, value_type string, default_unit string, is_required boolean",
    )


@pytest.mark.parametrize(
    ("text", "date"),
    [("31/12/2020", "2020-12-31"), ("1-2-21", "2021-02-01"), ("2021.03.04", "2021-03-04"), ("dated 05.06.1999", "1999-06-05"), ("3rd Mar 2018", "2018-03-03"), ("07-Sep-19", "2019-09-07"), ("April 1, 1964", "1964-04-01"), ("1 April 1958", "1958-04-01"),
     ("31/02/2020", None), ("12/13/2020", None), ("00/00/0000", None), ("n/a", None), ("", None), (None, None), ("3 Foo 2018", None)],
)
def test_dates(spark, text, date):
    got = spark.createDataFrame([(text,)], "t string").select(cells.read_date(F.col("t")).cast("string").alias("d")).first().d
    assert got == date


def test_booleans_and_integers(spark):
    rows = spark.createDataFrame([(x,) for x in ["YES", "absent", "1", "0", "maybe", None, "", "Mem. No. 012,345", "No 739796.", " 758601", "12/34", "as per contract"]], "t string")
    got = [tuple(r) for r in rows.select(cells.read_boolean(F.col("t")), cells.read_integer(F.col("t"))).collect()]
    assert [g[0] for g in got[:7]] == [True, False, True, False, None, None, None]
    assert [g[1] for g in got[7:]] == [12345, 739796, 758601, None, None]


def _fields(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def test_wide_and_cells(spark, catalog):
    old, new = datetime.datetime(2020, 1, 1), datetime.datetime(2021, 1, 1)
    fields = _fields(
        spark,
        [(1, 1, "t", "Start:", "01/02/2020", old, "x"), (2, 1, "t", "start", "bad", new, "x"), (3, 1, "t", "SEAL", "yes", None, "x"), (4, 1, "t", "value", "2.5", old, "x"), (5, 1, "t", "name", "first", old, "x"), (6, 1, "t", "name", "second", new, "x"),
         (7, 2, "t", "start", "2.3.21", old, "x"), (8, 2, "t", "seal", "yes", old, "x"), (9, 3, "t", "seal", None, old, "x"), (10, None, "t", "seal", "no", old, "x"), (11, 1, "t", "unknown", "no", old, "x"), (12, 1, "t", "number", "M. No. 007", old, "x")],
    )
    papers = spark.createDataFrame([(1, 5, "A"), (2, 6, "B"), (3, 7, "A")], "document_id bigint, page_id bigint, doc_type string")
    pages = spark.createDataFrame([(5, "Figures in crores of rupees")], "page_id bigint, text string")
    table = wide.wide(fields, papers, catalog, pages)
    assert table.columns == ["document_id", "name", "number", "seal", "start", "value"]
    rows = {r.document_id: r for r in table.collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].name, rows[1].number, rows[1].seal, rows[1].start, rows[1].value) == ("second", 7, True, datetime.date(2020, 2, 1), 25_000_000)
    assert (rows[2].seal, rows[2].start) == (None, datetime.date(2021, 3, 2))
    assert wide.wide(fields, papers, catalog).where("document_id = 1").first().value == 250_000
    got = {tuple(r) for r in wide.cells_of(table, wide.columns_of(catalog), ("date", "boolean", "integer")).collect()}
    assert got == {(1, "number", "7"), (1, "seal", "true"), (1, "start", "2020-02-01"), (2, "start", "2021-03-02")}
    assert wide.wide(fields.limit(0), papers, catalog).count() == 0


def test_one_entity_over_many_batches(spark, catalog):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        papers = spark.range(60).select(F.col("id").alias("document_id"), F.col("id").alias("page_id"), F.lit("A").alias("doc_type"))
        names = [("start", "01/01/2020"), ("seal", "no"), ("number", "5"), ("name", "x")]
        fields = _fields(spark, [(i * 4 + k, i, "t", n, v, None, "x") for i in range(60) for k, (n, v) in enumerate(names)])
        rows = wide.wide(fields, papers, catalog).collect()
        assert len(rows) == 60
        assert all((r.seal, r.number, r.name, str(r.start)) == (False, 5, "x", "2020-01-01") for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_tables(spark, catalog):
    """Extra columns whose names clash with the operator's own, nulls in any column, and repeated rows change nothing."""
    rows = [(1, 1, "t", "start", "01/02/2020", None, "x"), (1, 1, "t", "start", "01/02/2020", None, "x"), (None, 1, None, "seal", "yes", None, None), (3, None, "t", "seal", "no", None, "x"), (4, 1, "t", None, "no", None, "x"), (5, 2, "t", "name", "long " * 50_000, None, "x")]
    papers = spark.createDataFrame([(1, 5, "A"), (2, None, "A"), (None, 7, "A"), (3, 8, None)], "document_id bigint, page_id bigint, doc_type string")
    odd = lambda df: df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(["attribute", "v", "d", "cell", "value_type", "unit_line", "default_unit", "kind"]) if c not in df.columns])
    plain = wide.wide(_fields(spark, rows), papers, catalog)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, wide.wide(odd(_fields(spark, rows)), odd(papers), odd(catalog)).collect()), key=repr)
    assert {r.document_id: (r.seal, str(r.start)) for r in plain.collect()} == {1: (True, "2020-02-01"), 2: (None, "None")}
