"""Classification of pages by weighted phrases and reading of fields by pattern, as Column expressions inside one scan.

Each rule list compiles to Columns, so a page is scored against all types without a join and without Python. Null texts score
zero and read nothing; ties go to the type listed first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.sources import rules


def type_score(low: Column, phrases: Iterable[tuple[str, int, list[str]]]) -> Column:
    """The sum of the weights of the phrases on the page whose companions all stand there too. low: the lower-case text."""
    total = F.lit(0)
    for phrase, weight, needed in phrases:
        hit = F.contains(low, F.lit(phrase.lower()))
        for other in needed:
            hit = hit & F.contains(low, F.lit(other.lower()))
        total = total + F.when(hit, weight).otherwise(0)
    return total


def scores(pages: DataFrame, text: str = "text", types=rules.DOCUMENT_TYPES) -> DataFrame:
    """The pages with a column low_text and a column all_scores: an array of (doc_type, score, ord, enough) structs."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    one = lambda k, t: F.struct(F.lit(t[0]).alias("doc_type"), type_score(F.col("low_text"), t[3]).alias("score"), F.lit(k).alias("ord"), F.lit(t[2]).alias("least"))
    return pages.withColumn("low_text", low).withColumn("all_scores", F.array(*[one(k, t) for k, t in enumerate(types)]))


def positive(pages: DataFrame, key: str = "page_id", text: str = "text", types=rules.DOCUMENT_TYPES) -> DataFrame:
    """(key, doc_type, score) of every type with a phrase on the page. Zero scores are filtered inside the array: a filter on its
    explosion would be pushed below it, and the rules evaluated once more for each."""
    return scores(pages, text, types).select(key, F.explode(F.filter("all_scores", lambda s: s["score"] > 0)).alias("s")).select(key, "s.doc_type", "s.score")


def classified(pages: DataFrame, text: str = "text", types=rules.DOCUMENT_TYPES) -> DataFrame:
    """The pages with doc_type (null if no type reaches its least score) and score (0 then)."""
    enough = F.filter("all_scores", lambda s: s["score"] >= s["least"])
    best = F.array_max(F.transform(enough, lambda s: F.struct(s["score"].alias("score"), (-s["ord"]).alias("o"), s["doc_type"].alias("doc_type"))))
    return scores(pages, text, types).withColumn("best", best).withColumn("doc_type", F.col("best.doc_type")).withColumn("score", F.coalesce(F.col("best.score"), F.lit(0))).drop("best", "low_text", "all_scores")


def read_pattern(text: Column, pattern: str, label: str | None = None) -> Column:
    """The first match of the pattern, near the label first where one is given; null if there is none."""
    whole = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    if label is None:
        return whole
    at = F.locate(label.lower(), F.lower(text))
    window = F.substring(text, at, F.lit(len(label) + rules.NEAR_LABEL))
    near = F.when(at > 0, F.nullif(F.regexp_extract(window, pattern, 0), F.lit("")))
    return F.coalesce(near, whole)


def pattern_fields(pages: DataFrame, key: str = "page_id", text: str = "text", fields=rules.PATTERN_FIELDS) -> DataFrame:
    """(key, doc_type, field_name, field_value, is_required): the pattern fields of each page's type; missing ones are null.

    pages has doc_type. Only the patterns of a page's own type are evaluated."""
    kinds = list(dict.fromkeys(f[0] for f in fields))
    none = "array<struct<field_name:string,field_value:string,is_required:boolean>>"
    cells = F.lit(None).cast(none)
    for kind in reversed(kinds):
        own = F.array(*[F.struct(F.lit(n).alias("field_name"), read_pattern(F.col(text), rx, label).alias("field_value"), F.lit(need).alias("is_required")) for k, n, rx, label, need in fields if k == kind])
        cells = F.when(F.col("doc_type") == kind, own).otherwise(cells)
    return pages.select(key, "doc_type", F.explode(cells).alias("f")).select(key, "doc_type", "f.field_name", "f.field_value", "f.is_required")


def notes(read: DataFrame) -> DataFrame:
    """The fields with a note on how each value came: regex, or missing where the pattern found nothing."""
    return read.withColumn("note", F.when(F.col("field_value").isNull(), "missing").otherwise("regex"))


def missing_required(read: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, doc_type, missing): the required fields a page lacks, in name order, as one text; pages that lack none are left out."""
    lacking = read.where("is_required and field_value is null")
    return lacking.groupBy(key, "doc_type").agg(F.array_join(F.array_sort(F.collect_set("field_name")), ", ").alias("missing"))


def loose_number(text: Column) -> Column:
    """A number as report code reads it: all but digits and points dropped, times 1e5 with lakh or lac, 1e7 with crore; else null."""
    low = F.lower(text)
    digits = F.regexp_replace(text, r"[^\d.]", "")
    number = F.when(digits.rlike(r"\d"), digits.try_cast("double"))
    scale = F.when(F.contains(low, F.lit("lakh")) | F.contains(low, F.lit("lac")), 1e5).otherwise(1.0) * F.when(F.contains(low, F.lit("crore")), 1e7).otherwise(1.0)
    return number * scale
