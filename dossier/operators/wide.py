"""Attribute-value rows into one typed row per entity.

Rows are read to canonical cells in the JVM and pre-aggregated to one cell per (entity, attribute), so that an entity that holds a
third of all rows reaches the next shuffle as one cell per attribute. Entities are then hash-bucketed and sorted; inside a bucket
each Arrow batch is dictionary-encoded and scattered into one numpy array per type. The last entity of a batch is carried to the
next, so no bucket is ever held whole.

Defined results: null or empty values and unreadable ones fill no cell; entities without a readable cell have no row; attributes
outside the catalogue, or not of the document's type, are left out; of several readable values the latest (extracted_at, then
field_id) is kept; columns named alike in the inputs do not clash, as all are selected by name first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.cells import read_boolean, read_date, read_integer
from dossier.functions.names import attribute_key
from dossier.operators.units import BARE, page_units, quantity_reader
from dossier.session import bounded

ARROW = {"text": pa.string(), "json": pa.string(), "date": pa.date32(), "boolean": pa.bool_(), "integer": pa.int64(), "money": pa.int64()}
SPARK = {"text": T.StringType(), "json": T.StringType(), "date": T.DateType(), "boolean": T.BooleanType(), "integer": T.LongType(), "money": T.LongType()}
#: A catalogue is a fixed list; a larger one is refused, as its columns would not fit a row.
MOST_COLUMNS = 2_000


def columns_of(catalog: DataFrame) -> list[tuple[str, str]]:
    """(field_name, value_type) in name order. A name with two types in the catalogue gets the types as suffixes."""
    rows = catalog.where("field_name is not null and value_type is not null").select("field_name", "value_type").distinct().limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"the catalogue has over {MOST_COLUMNS} columns")
    return sorted((r.field_name, r.value_type) for r in rows if r.value_type in ARROW)


def typed_cells(fields: DataFrame, documents: DataFrame, catalog: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(document_id, field_name, value_type, cell): one readable cell per document and catalogue attribute, as canonical text."""
    known = catalog.select("doc_type", "field_name", attribute_key(F.col("field_name")).alias("attribute"), "value_type", "default_unit").dropDuplicates(["doc_type", "attribute"])
    papers = documents.groupBy("document_id").agg(F.min(F.struct("doc_type", "page_id")).alias("d")).select("document_id", "d.doc_type", "d.page_id")
    rows = (
        fields.select("document_id", "field_id", "extracted_at", attribute_key(F.col("field_name")).alias("attribute"), F.col("field_value").alias("v"))
        .where("v is not null and trim(v) <> ''")
        .join(bounded(known.select("attribute").distinct()), "attribute", "left_semi")
        .join(papers, "document_id")
        .join(bounded(known), ["doc_type", "attribute"])
    )
    v, kind = F.col("v"), F.col("value_type")
    cell = (
        F.when(kind.isin("text", "json"), v)
        .when(kind == "date", read_date(v).cast("string"))
        .when(kind == "boolean", read_boolean(v).cast("string"))
        .when(kind == "integer", read_integer(v).cast("string"))
    )
    nothing, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    keep = ["document_id", "field_name", "value_type", "field_id", "extracted_at", "cell"]
    plain = rows.where(kind != "money").withColumn("cell", cell).select(keep)
    money = rows.where(kind == "money")
    if pages is not None:
        bare = v.rlike(BARE)
        money = money.where(~bare).withColumn("unit_line", nothing).unionByName(money.where(bare).join(page_units(pages), "page_id", "left"), allowMissingColumns=True)
    else:
        money = money.withColumn("unit_line", nothing)
    money = money.withColumn("cell", quantity_reader("money")("v", "unit_line", "default_unit", no_number).cast("string")).select(keep)
    return (
        plain.unionByName(money)
        .where("cell is not null")
        .groupBy("document_id", "field_name", "value_type")
        .agg(F.max_by("cell", F.struct(F.coalesce("extracted_at", F.lit("0001-01-01").cast("timestamp_ntz")), "field_id")).alias("cell"))
    )


def _scatter(columns: list[tuple[str, str]], schema: pa.Schema):
    """A mapInArrow function over sorted buckets of (document_id, field_name, value_type, cell)."""
    place = {c: k for k, c in enumerate(columns)}
    by_type: dict[str, list[int]] = {}
    for k, (_, kind) in enumerate(columns):
        by_type.setdefault(kind, []).append(k)
    slot = {k: (kind, j) for kind, ks in by_type.items() for j, k in enumerate(ks)}

    def table_of(batch: pa.Table) -> pa.RecordBatch:
        entity = batch.column("document_id").combine_chunks().dictionary_encode()
        row = entity.indices.to_numpy(zero_copy_only=False)
        n = len(entity.dictionary)
        attribute = batch.column("field_name").combine_chunks().dictionary_encode()
        kinds = batch.column("value_type").combine_chunks().dictionary_encode()
        lookup = np.full((len(attribute.dictionary), len(kinds.dictionary)), -1)
        for i, a in enumerate(attribute.dictionary.to_pylist()):
            for j, t in enumerate(kinds.dictionary.to_pylist()):
                lookup[i, j] = place.get((a, t), -1)
        col = lookup[attribute.indices.to_numpy(zero_copy_only=False), kinds.indices.to_numpy(zero_copy_only=False)]
        cell = batch.column("cell").to_numpy()
        filled: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for kind, ks in by_type.items():
            at = np.isin(col, ks)
            values = cell[at].astype(str) if at.any() else np.array([], dtype=str)
            if kind == "date":
                grid, typed = np.zeros((n, len(ks)), "datetime64[D]"), values.astype("datetime64[D]")
            elif kind == "boolean":
                grid, typed = np.zeros((n, len(ks)), bool), values == "true"
            elif kind in ("integer", "money"):
                grid, typed = np.zeros((n, len(ks)), np.int64), values.astype(np.int64)
            else:
                grid, typed = np.full((n, len(ks)), None, object), cell[at]
            mask = np.ones((n, len(ks)), bool)
            spot = (row[at], np.searchsorted(ks, col[at]))
            grid[spot], mask[spot] = typed, False
            filled[kind] = (grid, mask)
        arrays = [entity.dictionary]
        for k in range(len(columns)):
            kind, j = slot[k]
            grid, mask = filled[kind]
            arrays.append(pa.array(grid[:, j], type=ARROW[kind], mask=mask[:, j]))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if held is not None:
                now = pa.concat_tables([held, now])
            ids = now.column("document_id").to_numpy()
            start = int(np.searchsorted(ids, ids[-1]))  # the last entity may go on in the next batch
            held = now.slice(start)
            if start:
                yield table_of(now.slice(0, start))
        if held is not None and held.num_rows:
            yield table_of(held)

    return run


def to_wide(cells: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """One row per document_id with one typed column per (name, type); cells as from typed_cells()."""
    twice = {a for a, _ in columns if sum(a == b for b, _ in columns) > 1}
    name = lambda a, t: f"{a}_{t}" if a in twice else a
    fields = [T.StructField("document_id", T.LongType())] + [T.StructField(name(a, t), SPARK[t]) for a, t in columns]
    schema = pa.schema([pa.field("document_id", pa.int64())] + [pa.field(name(a, t), ARROW[t]) for a, t in columns])
    buckets = cells.select(F.col("document_id").cast("bigint"), "field_name", "value_type", "cell").where("document_id is not null").repartition("document_id").sortWithinPartitions("document_id")
    return buckets.mapInArrow(_scatter(columns, schema), T.StructType(fields))


def wide(fields: DataFrame, documents: DataFrame, catalog: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The wide table of extracted_fields; money in whole rupees, with the page's unit where pages are given."""
    return to_wide(typed_cells(fields, documents, catalog, pages), columns_of(catalog))


def cells_of(table: DataFrame, columns: list[tuple[str, str]], kinds: tuple[str, ...]) -> DataFrame:
    """(document_id, field_name, cell): the non-null cells of the wide table's columns of these types, as text."""
    twice = {a for a, _ in columns if sum(a == b for b, _ in columns) > 1}
    pairs = [(a, f"{a}_{t}" if a in twice else a) for a, t in columns if t in kinds]
    if not pairs:
        return table.select("document_id", F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("string").alias("cell")).where("false")
    cells = F.array(*[F.struct(F.lit(a).alias("field_name"), F.col(c).cast("string").alias("cell")) for a, c in pairs])
    return table.select("document_id", F.explode(F.filter(cells, lambda c: c["cell"].isNotNull())).alias("c")).select("document_id", "c.field_name", "c.cell")
