"""Queries over pages, papers, fields, verdicts and submissions, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.names import attribute_key
from dossier.operators import pages as ops
from dossier.session import bounded, spread, table
from dossier.sources import rules
from dossier.streaming import pages as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _score_sql(phrases) -> str:
    parts = []
    for phrase, weight, needed in phrases:
        hit = " and ".join(f"contains(t, {_q(p.lower())})" for p in (phrase, *needed))
        parts.append(f"(case when {hit} then {weight} else 0 end)")
    return " + ".join(parts)


_LOW_SQL = "select page_id, lower(coalesce(text, '')) t from page_results"
_SCORES_SQL = " union all ".join(f"select page_id, {_q(n)} doc_type, {k} ord, {least} least, {_score_sql(ps)} score from low" for k, (n, _, least, ps) in enumerate(rules.DOCUMENT_TYPES))
_BEST_SQL = f"""low as ({_LOW_SQL}), s as ({_SCORES_SQL}),
best as (select page_id, arg_max(doc_type, score * 1000 - ord) doc_type, max(score) score from s where score >= least group by page_id),
classified as (select p.page_id, b.doc_type, coalesce(b.score, 0) score, p.text from page_results p left join best b using (page_id))"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "page_results").select("page_id", "text"), "page_id")


@_query(f"with low as ({_LOW_SQL}), s as ({_SCORES_SQL}) select page_id, doc_type, score from s where score > 0")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every page for every type with a phrase on it."""
    return ops.positive(_texts(spark, sf_dir))


@_query(f"with {_BEST_SQL} select page_id, doc_type, score from classified")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of every page by the phrase rules, null where no type has enough."""
    return ops.classified(_texts(spark, sf_dir)).select("page_id", "doc_type", "score")


@_query(f"with {_BEST_SQL} select d.doc_type stored_type, coalesce(c.doc_type, 'none') rule_type, count(*) pages from page_documents d join classified c using (page_id) group by all")
def type_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the rules' types stand against the stored ones."""
    found = ops.classified(_texts(spark, sf_dir)).select("page_id", F.coalesce("doc_type", F.lit("none")).alias("rule_type"))
    stored = table(spark, sf_dir, "page_documents").select("page_id", F.col("doc_type").alias("stored_type"))
    return stored.join(found, "page_id").groupBy("stored_type", "rule_type").agg(F.count("*").alias("pages"))


def _field_sql(kind: str, name: str, pattern: str, label: str | None, need: bool) -> str:
    whole = f"nullif(regexp_extract(text, {_q(pattern)}, 0), '')"
    value = whole
    if label:
        at = f"strpos(lower(text), {_q(label.lower())})"
        value = f"coalesce(case when {at} > 0 then nullif(regexp_extract(substr(text, {at}, {len(label) + rules.NEAR_LABEL}), {_q(pattern)}, 0), '') end, {whole})"
    return f"select page_id, doc_type, {_q(name)} field_name, {value} field_value, {str(need).lower()} is_required from classified where doc_type = {_q(kind)}"


_FIELDS_SQL = " union all ".join(_field_sql(*f) for f in rules.PATTERN_FIELDS)


def _pattern_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pattern_fields(ops.classified(_texts(spark, sf_dir)))


@_query(f"with {_BEST_SQL} select page_id, doc_type, field_name, field_value from ({_FIELDS_SQL})")
def pattern_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern fields of every classified page, null where there is no match."""
    return _pattern_fields(spark, sf_dir).select("page_id", "doc_type", "field_name", "field_value")


@_query(f"with {_BEST_SQL} select doc_type, field_name, case when field_value is null then 'missing' else 'regex' end note, count(*) pages from ({_FIELDS_SQL}) group by all")
def field_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the values of every pattern field came, over all pages of its type."""
    return ops.notes(_pattern_fields(spark, sf_dir)).groupBy("doc_type", "field_name", "note").agg(F.count("*").alias("pages"))


@_query(f"with {_BEST_SQL}, f as ({_FIELDS_SQL}) select page_id, doc_type, string_agg(distinct field_name, ', ' order by field_name) missing from f where is_required and field_value is null group by page_id, doc_type")
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required pattern fields that a page lacks."""
    return ops.missing_required(_pattern_fields(spark, sf_dir))


_KEY_SQL = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


@_query(
    rf"""select field_id, try_cast(regexp_replace(field_value, '[^\d.]', '', 'g') as double)
    * (case when contains(lower(field_value), 'lakh') or contains(lower(field_value), 'lac') then 1e5 else 1.0 end)
    * (case when contains(lower(field_value), 'crore') then 1e7 else 1.0 end) as number
    from extracted_fields where {_KEY_SQL.format("field_name")} in ('totalcontractvalue', 'totalpaymentmade', 'averageannualturnover')"""
)
def loose_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report reading of money fields: digits and points, with lakh and crore. The units operator reads them exactly."""
    rows = table(spark, sf_dir, "extracted_fields").where(attribute_key(F.col("field_name")).isin("totalcontractvalue", "totalpaymentmade", "averageannualturnover"))
    return rows.select("field_id", ops.loose_number(F.col("field_value")).alias("number"))


def search(documents: DataFrame, fields: DataFrame, doc_type: str | None = None, field_name: str | None = None, value_like: str | None = None) -> DataFrame:
    """Papers with their fields, by optional type, field name and part of the value (any letter case); an empty filter is none."""
    if doc_type:
        documents = documents.where(F.col("doc_type") == doc_type)
    if field_name:
        fields = fields.where(F.col("field_name") == field_name)
    if value_like:
        fields = fields.where(F.col("field_value").ilike(f"%{value_like}%"))
    return documents.select("document_id", "tender_id", "source_file", "page_number", "doc_type").join(fields.select("document_id", "field_id", "field_name", "field_value"), "document_id")


@_query("select d.document_id, d.tender_id, d.source_file, d.page_number, d.doc_type, f.field_id, f.field_name, f.field_value from page_documents d join extracted_fields f using (document_id) where d.doc_type = 'EXPERIENCE_CERTIFICATE' and f.field_name = 'performance' and f.field_value ilike '%good%'")
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search join, for one type, one field and a part of the value."""
    return search(table(spark, sf_dir, "page_documents"), table(spark, sf_dir, "extracted_fields"), "EXPERIENCE_CERTIFICATE", "performance", "good")


@_query("select page_id, tender_id, bidder_name, source_file, page_number, read_error from page_results where read_error is not null")
def read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that could not be read, set apart."""
    return table(spark, sf_dir, "page_results").where("read_error is not null").select("page_id", "tender_id", "bidder_name", "source_file", "page_number", "read_error")


@_query(
    r"""select tender_id, count(*) pages, count(*) filter (where source = 'ocr') ocr_pages, count(*) filter (where source = 'native') native_pages,
    count(*) filter (where read_error is not null) unread, count(*) filter (where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 20) short_pages,
    round(avg(ocr_confidence) filter (where ocr_confidence >= 0), 6) mean_confidence from page_results group by tender_id"""
)
def tender_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every tender by source, the unread and the short ones, and the mean confidence of recognised pages."""
    stripped = F.length(F.regexp_replace("text", r"^\s+|\s+$", ""))
    return table(spark, sf_dir, "page_results").groupBy("tender_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("source") == "ocr").alias("ocr_pages"), F.count_if(F.col("source") == "native").alias("native_pages"),
        F.count_if(F.col("read_error").isNotNull()).alias("unread"), F.count_if(stripped < rules.NATIVE_LEAST).alias("short_pages"),
        F.round(F.avg(F.when(F.col("ocr_confidence") >= 0, F.col("ocr_confidence"))), 6).alias("mean_confidence"),
    )


@_query(
    """with f as (select tender_id, bidder_name, source_file, count(distinct page_number) pages_read, max(page_count) page_count from page_results group by all)
    select tender_id, bidder_name, source_file, pages_read, page_count, pages_read < page_count as incomplete from f"""
)
def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read of every file against its page count."""
    files = table(spark, sf_dir, "page_results").groupBy("tender_id", "bidder_name", "source_file").agg(F.count_distinct("page_number").alias("pages_read"), F.max("page_count").alias("page_count"))
    return files.withColumn("incomplete", F.col("pages_read") < F.col("page_count"))


@_query(
    """select tender_id, bidder_name, doc_type, document_id, source_file, page_number from (
    select *, row_number() over (partition by tender_id, bidder_name, doc_type order by source_file, page_number, document_id) k from page_documents) where k = 1"""
)
def first_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paper of every type of every bidder, by file and page; one partial aggregate, no window."""
    place = F.struct("source_file", "page_number", "document_id")
    first = table(spark, sf_dir, "page_documents").groupBy("tender_id", "bidder_name", "doc_type").agg(F.min(place).alias("m"))
    return first.select("tender_id", "bidder_name", "doc_type", "m.document_id", "m.source_file", "m.page_number")


@_query("select tender_id, bidder_name, row_number() over (partition by tender_id order by bidder_name) as number from (select distinct tender_id, bidder_name from submissions)")
def numbered_bidders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bidders of a tender numbered by name."""
    bidders = table(spark, sf_dir, "submissions").select("tender_id", "bidder_name").distinct()
    return bidders.withColumn("number", F.row_number().over(Window.partitionBy("tender_id").orderBy("bidder_name")))


_STEM = r"(_\d+)+$"


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names of folders in order of arrival, family by family: the base name, or with the least free number from 2 on. Only the taken names
    of the family at hand are kept."""
    stem, taken, next_free = None, set(), {}
    for batch in batches:
        names = []
        for base, family in zip(batch["base"], batch["stem"], strict=True):
            if family != stem:
                stem, taken, next_free = family, set(), {}
            name, k = base, next_free.get(base, 2)
            while name in taken:
                name, k = f"{base}_{k}", k + 1
            next_free[base] = k
            taken.add(name)
            names.append(name)
        yield pd.DataFrame({"source_folder": batch["source_folder"], "dest_name": names})


@_query(
    r"""with f as (select source_folder, min(submission_id) first_id, regexp_extract(source_folder, '([^/]*)$', 1) base from submissions group by source_folder),
    families as (select regexp_replace(base, '(_\d+)+$', '') stem, list(source_folder order by first_id) folders, list([base] order by first_id) bases from f group by 1),
    named as (select folders, list_reduce(bases, lambda taken, b: list_append(taken, case when not list_contains(taken, b[1]) then b[1]
      else list_filter(list_transform(range(2, len(taken) + 3), lambda i: b[1] || '_' || i), lambda n: not list_contains(taken, n))[1] end), []::varchar[]) dest from families)
    select unnest(folders) source_folder, unnest(dest) dest_name from named"""
)
def gathered_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One destination name per source folder, in order of arrival: its own, or that with the least number that no earlier folder has taken.
    Names can only meet within one stem; families stream through a task one after the other."""
    folders = table(spark, sf_dir, "submissions").groupBy("source_folder").agg(F.min("submission_id").alias("first_id")).withColumn("base", F.regexp_extract("source_folder", "([^/]*)$", 1))
    families = folders.withColumn("stem", F.regexp_replace("base", _STEM, "")).repartition("stem").sortWithinPartitions("stem", "first_id")
    return families.select("source_folder", "base", "stem").mapInPandas(_placed, "source_folder string, dest_name string")


@_query("select submission_id, tender_id, count(*) over (partition by tender_id order by processed_at, submission_id rows unbounded preceding) done, count(*) over (partition by tender_id) total from submissions")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions done and in all, in order of processing, by tender."""
    w = Window.partitionBy("tender_id")
    done = w.orderBy("processed_at", "submission_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "submissions").select("submission_id", "tender_id", F.count("*").over(done).alias("done"), F.count("*").over(w).alias("total"))


@_query("select tender_id, bidder_name, max(submission_id) submission_id, arg_max(coalesce(overall_status, '(none)'), submission_id) shown_status, count(*) runs from submissions group by tender_id, bidder_name")
def latest_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run of every bidder, as an upsert by key would leave it."""
    return table(spark, sf_dir, "submissions").groupBy("tender_id", "bidder_name").agg(F.max("submission_id").alias("submission_id"), F.max_by(F.coalesce("overall_status", F.lit("(none)")), "submission_id").alias("shown_status"), F.count("*").alias("runs"))


@_query("select submission_id, concat_ws('::', tender_id, bidder_name) composite_key, regexp_extract(source_folder, '([^/]*)$', 1) folder, coalesce(nullif(overall_status, ''), '(not read)') shown, strftime(processed_at, '%Y-%m-%d %H:%M') processed from submissions")
def submission_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, folder, status with its fallback and time of each submission, as shown."""
    shown = F.coalesce(F.nullif(F.col("overall_status"), F.lit("")), F.lit("(not read)"))
    return table(spark, sf_dir, "submissions").select(
        "submission_id", F.concat_ws("::", "tender_id", "bidder_name").alias("composite_key"), F.regexp_extract("source_folder", "([^/]*)$", 1).alias("folder"), shown.alias("shown"), F.date_format("processed_at", "yyyy-MM-dd HH:mm").alias("processed")
    )


@_query("select tender_id, criterion_id, count(*) filter (where status = 'PASS') passed, count(*) - count(*) filter (where status = 'PASS') other, count(*) filter (where reason is null) unexplained from verdicts group by tender_id, criterion_id")
def criterion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict rows of every criterion by outcome."""
    passed = F.count_if(F.col("status") == "PASS")
    return table(spark, sf_dir, "verdicts").groupBy("tender_id", "criterion_id").agg(passed.alias("passed"), (F.count("*") - passed).alias("other"), F.count_if(F.col("reason").isNull()).alias("unexplained"))


@_query(
    """with d as (select distinct tender_id, bidder_name, ord, coalesce(nullif(fail_message, ''), nullif(reason, ''), '(no reason)') message from verdicts where status <> 'PASS')
    select tender_id, bidder_name, count(*) messages, string_agg('- ' || message, chr(10) order by ord, message) listed from d group by tender_id, bidder_name"""
)
def open_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of a bidder's open criteria, one line each in criterion order, repeats of re-runs once."""
    message = F.coalesce(F.nullif(F.col("fail_message"), F.lit("")), F.nullif(F.col("reason"), F.lit("")), F.lit("(no reason)"))
    rows = table(spark, sf_dir, "verdicts").where("status <> 'PASS'").select("tender_id", "bidder_name", "ord", message.alias("message")).distinct()
    lines = F.array_sort(F.collect_list(F.struct("ord", "message")))  # at most one row a criterion and message
    return rows.groupBy("tender_id", "bidder_name").agg(F.count("*").alias("messages"), lines.alias("l")).select("tender_id", "bidder_name", "messages", F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["message"])), "\n").alias("listed"))


@_query("""select verdict_id, e.doc_type, e.page_number from (select verdict_id, unnest(from_json(evidence_json, '[{"doc_type":"VARCHAR","page_number":"INTEGER"}]')) e from verdicts)""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every verdict as rows."""
    read = F.from_json("evidence_json", "array<struct<doc_type:string,page_number:int>>")
    return table(spark, sf_dir, "verdicts").select("verdict_id", F.explode(read).alias("e")).select("verdict_id", "e.doc_type", "e.page_number")


_EVIDENCE_SQL = """select verdict_id, string_agg(coalesce(e.doc_type, 'None') || ' p.' || coalesce(e.page_number::varchar, 'None') || coalesce(' = ' || e.value, ''), '; ' order by k) shown from (
    select verdict_id, generate_subscripts(a, 1) k, unnest(a) e from (select verdict_id, from_json(evidence_json, '[{"doc_type":"VARCHAR","page_number":"INTEGER","value":"VARCHAR"}]') a from verdicts)) group by verdict_id"""


def _evidence_text(evidence: Column) -> Column:
    """'TYPE p.3 = value' of every entry, the value only where there is one."""
    read = F.from_json(evidence, "array<struct<doc_type:string,page_number:int,value:string>>")
    part = lambda e: F.concat(F.coalesce(e["doc_type"], F.lit("None")), F.lit(" p."), F.coalesce(e["page_number"].cast("string"), F.lit("None")), F.coalesce(F.concat(F.lit(" = "), e["value"]), F.lit("")))
    return F.array_join(F.transform(read, part), "; ")


@_query(_EVIDENCE_SQL)
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every verdict as one line."""
    return table(spark, sf_dir, "verdicts").select("verdict_id", _evidence_text(F.col("evidence_json")).alias("shown")).where("shown <> ''")


@_query(
    f"""with e as ({_EVIDENCE_SQL}), v as (select *, row_number() over (partition by tender_id, bidder_name, criterion_id order by verdict_id desc) k from verdicts)
    select v.tender_id, v.bidder_name, v.ord, v.criterion_id, v.label, v.status, v.reason, coalesce(e.shown, '') evidence from v left join e using (verdict_id) where k = 1"""
)
def verdict_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details table: the last verdict on every criterion of every bidder, with its evidence in one line."""
    kept = ["ord", "label", "status", "reason", "evidence_json"]
    rows = table(spark, sf_dir, "verdicts").groupBy("tender_id", "bidder_name", "criterion_id").agg(F.max_by(F.struct(*kept), "verdict_id").alias("v"))
    return rows.select("tender_id", "bidder_name", "v.ord", "criterion_id", "v.label", "v.status", "v.reason", F.coalesce(_evidence_text(F.col("v.evidence_json")), F.lit("")).alias("evidence"))


_FIRST = {"gstin": "gstin", "pan_number": "pannumber", "udin": "udin", "avg_turnover": "averageannualturnover"}


@_query(
    f"""with b as (select tender_id, bidder_name, arg_max(coalesce(overall_status, 'NOT_EVALUATED'), submission_id) result from submissions group by tender_id, bidder_name),
    v as (select d.tender_id, d.bidder_name, {_KEY_SQL.format("f.field_name")} k, f.field_value, row_number() over (partition by d.tender_id, d.bidder_name, {_KEY_SQL.format("f.field_name")} order by d.source_file, d.page_number, d.document_id, f.field_id) n
      from extracted_fields f join page_documents d using (document_id) where f.field_value <> '' and {_KEY_SQL.format("f.field_name")} in ({", ".join(_q(k) for k in _FIRST.values())})),
    x as (select tender_id, bidder_name, count(*) experience_count from page_documents where doc_type = 'EXPERIENCE_CERTIFICATE' group by tender_id, bidder_name)
    select b.tender_id, row_number() over (partition by b.tender_id order by b.bidder_name) as number, b.bidder_name, {", ".join(f"max(v.field_value) filter (where v.k = '{k}') {c}" for c, k in _FIRST.items())},
    coalesce(max(x.experience_count), 0) experience_count, max(b.result) result from b left join v on v.tender_id = b.tender_id and v.bidder_name = b.bidder_name and v.n = 1 left join x on x.tender_id = b.tender_id and x.bidder_name = b.bidder_name
    group by b.tender_id, b.bidder_name"""
)
def bidder_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary table: bidders of a tender numbered by name, with their first identifiers and turnover, papers of experience and result."""
    bidders = table(spark, sf_dir, "submissions").groupBy("tender_id", "bidder_name").agg(F.max_by(F.coalesce("overall_status", F.lit("NOT_EVALUATED")), "submission_id").alias("result"))
    papers = table(spark, sf_dir, "page_documents").select("document_id", "tender_id", "bidder_name", "source_file", "page_number", "doc_type")
    fields = table(spark, sf_dir, "extracted_fields").select("document_id", "field_id", "field_value", attribute_key(F.col("field_name")).alias("k")).where(F.col("k").isin(*_FIRST.values()) & (F.col("field_value") != ""))
    place = F.struct("source_file", "page_number", "document_id", "field_id")
    first = lambda k: F.min_by(F.when(F.col("k") == k, F.col("field_value")), F.when(F.col("k") == k, place))
    values = fields.join(papers.drop("doc_type"), "document_id").groupBy("tender_id", "bidder_name").agg(*[first(k).alias(c) for c, k in _FIRST.items()])
    experience = papers.where("doc_type = 'EXPERIENCE_CERTIFICATE'").groupBy("tender_id", "bidder_name").agg(F.count("*").alias("experience_count"))
    rows = bidders.join(values, ["tender_id", "bidder_name"], "left").join(experience, ["tender_id", "bidder_name"], "left")
    number = F.row_number().over(Window.partitionBy("tender_id").orderBy("bidder_name"))
    return rows.select("tender_id", number.alias("number"), "bidder_name", *_FIRST, F.coalesce("experience_count", F.lit(0)).alias("experience_count"), "result")


_RUN_SQL = """with b as (select tender_id, bidder_name, arg_max(coalesce(overall_status, 'NOT_EVALUATED'), submission_id) result from submissions group by tender_id, bidder_name),
    p as (select tender_id, bidder_name, count(*) pages, date_diff('second', min(read_at), max(read_at)) as seconds from page_results group by tender_id, bidder_name),
    d as (select tender_id, bidder_name, count(*) documents from page_documents group by tender_id, bidder_name),
    r as (select b.tender_id, b.bidder_name, b.result, coalesce(d.documents, 0) documents, coalesce(p.pages, 0) pages, p.seconds from b left join p using (tender_id, bidder_name) left join d using (tender_id, bidder_name))"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["tender_id", "bidder_name"]
    bidders = table(spark, sf_dir, "submissions").groupBy(by).agg(F.max_by(F.coalesce("overall_status", F.lit("NOT_EVALUATED")), "submission_id").alias("result"))
    pages = table(spark, sf_dir, "page_results").groupBy(by).agg(F.count("*").alias("pages"), F.timestamp_diff("SECOND", F.min("read_at"), F.max("read_at")).alias("seconds"))
    papers = table(spark, sf_dir, "page_documents").groupBy(by).agg(F.count("*").alias("documents"))
    return bidders.join(pages, by, "left").join(papers, by, "left").select(*by, "result", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("pages", F.lit(0)).alias("pages"), "seconds")


@_query(
    f"""{_RUN_SQL} select tender_id, count(*) bidders, count(*) filter (where result = 'PASS') qualified, count(*) - count(*) filter (where result = 'PASS') disqualified, cast(sum(documents) as bigint) documents, cast(sum(pages) as bigint) pages, cast(sum(seconds) as bigint) as seconds, round(sum(pages) / nullif(sum(seconds), 0), 6) pages_a_second from r group by tender_id"""
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over a tender came to: bidders, those qualified and all others (also crashed ones), documents, pages, and pages a second of reading."""
    totals = _runs(spark, sf_dir).groupBy("tender_id").agg(F.count("*").alias("bidders"), F.count_if(F.col("result") == "PASS").alias("qualified"), (F.count("*") - F.count_if(F.col("result") == "PASS")).alias("disqualified"), F.sum("documents").alias("documents"), F.sum("pages").alias("pages"), F.sum("seconds").alias("seconds"))
    return totals.withColumn("pages_a_second", F.round(F.try_divide("pages", "seconds"), 6))


@_query(
    f"""{_RUN_SQL} select tender_id, row_number() over (partition by tender_id order by bidder_name) line_no, '[' || bidder_name || '] DONE: ' || documents || ' document(s) found, result = ' || result || ', ' || pages || ' page(s) in ' || coalesce(seconds, 0) || ' s' as line from r"""
)
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a tender's run: one numbered line a bidder, in name order; joined by line_no it is the log's text."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    c = lambda x: F.col(x).cast("string")
    line = text("[", c("bidder_name"), "] DONE: ", c("documents"), " document(s) found, result = ", c("result"), ", ", c("pages"), " page(s) in ", F.coalesce(c("seconds"), F.lit("0")), " s")
    return _runs(spark, sf_dir).select("tender_id", F.row_number().over(Window.partitionBy("tender_id").orderBy("bidder_name")).alias("line_no"), line.alias("line"))


@_query(r"select page_id, case when length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 then 'native' else 'ocr' end way, source from page_results where read_error is null")
def page_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way every readable page goes: enough text of its own, or recognition; beside the way it was stored as."""
    stripped = F.length(F.regexp_replace("text", r"^\s+|\s+$", ""))
    return table(spark, sf_dir, "page_results").where("read_error is null").select("page_id", F.when(stripped >= rules.NATIVE_LEAST, "native").otherwise("ocr").alias("way"), "source")


_EMPTY = {"json": ("[]", "{}", "null", "false", "0", '""'), "boolean": ("false", "0"), "integer": ("0",)}


def truthy(value: Column, value_type: Column) -> Column:
    """Whether a stored value counts as there: neither null nor empty nor its type's own nothing; as a text, '0' and 'null' are there."""
    nothing = F.lit(False)
    for kind, words in _EMPTY.items():
        nothing = nothing | ((value_type == kind) & F.lower(F.trim(value)).isin(*words))
    return value.isNotNull() & (value != "") & ~nothing


_NOTHING_SQL = " or ".join(f"(c.value_type = '{k}' and lower(trim(f.field_value)) in ({', '.join(_q(w) for w in ws)}))" for k, ws in _EMPTY.items())


@_query(
    f"""select d.doc_type, c.field_name, count(*) stored, count(*) filter (where f.field_value is not null and f.field_value <> '' and not ({_NOTHING_SQL})) filled
    from extracted_fields f join page_documents d using (document_id) join field_catalog c on c.doc_type = d.doc_type and {_KEY_SQL.format("c.field_name")} = {_KEY_SQL.format("f.field_name")} group by d.doc_type, c.field_name"""
)
def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stored values of every catalogue field are there."""
    known = table(spark, sf_dir, "field_catalog").select("doc_type", "field_name", "value_type", attribute_key(F.col("field_name")).alias("k"))
    rows = table(spark, sf_dir, "extracted_fields").select("document_id", "field_value", attribute_key(F.col("field_name")).alias("k"))
    typed = rows.join(table(spark, sf_dir, "page_documents").select("document_id", "doc_type"), "document_id").join(bounded(known), ["doc_type", "k"])
    return typed.groupBy("doc_type", "field_name").agg(F.count("*").alias("stored"), F.count_if(truthy(F.col("field_value"), F.col("value_type"))).alias("filled"))


@_query(
    """with e as (select tender_id, bidder_name, source_file, 0 page_number, null::bigint document_id from page_results where read_error is not null
      union all select tender_id, bidder_name, source_file, page_number, document_id from page_documents)
    select tender_id, bidder_name, row_number() over (partition by tender_id, bidder_name order by source_file, page_number, document_id nulls first) as place, source_file, page_number, document_id from e"""
)
def paper_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers of every bidder in reading order, by file and page; what could not be read stands at page 0 of its file."""
    errors = table(spark, sf_dir, "page_results").where("read_error is not null").select("tender_id", "bidder_name", "source_file", F.lit(0).alias("page_number"), F.lit(None).cast("bigint").alias("document_id"))
    rows = errors.unionByName(table(spark, sf_dir, "page_documents").select("tender_id", "bidder_name", "source_file", "page_number", "document_id"))
    w = Window.partitionBy("tender_id", "bidder_name").orderBy("source_file", "page_number", F.col("document_id").asc_nulls_first())
    return rows.select("tender_id", "bidder_name", F.row_number().over(w).alias("place"), "source_file", "page_number", "document_id")


@_query("select rule_id, coalesce(field_used, 'value') || ' vs required minimum ' || format('{:,}', cast(round(min_value_inr) as bigint)) shown from eligibility_rules where min_value_inr is not null")
def limit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated limit in words, with thousands set apart."""
    amount = F.format_number(F.round("min_value_inr").cast("bigint"), 0)
    return table(spark, sf_dir, "eligibility_rules").where("min_value_inr is not null").select("rule_id", F.concat(F.coalesce("field_used", F.lit("value")), F.lit(" vs required minimum "), amount).alias("shown"))


@_query(
    f"""select field_id, t.financial_year, t.turnover_lakhs from (select field_id, unnest(from_json(field_value, '[{{"financial_year":"VARCHAR","turnover_lakhs":"DOUBLE"}}]')) t
    from extracted_fields where {_KEY_SQL.format("field_name")} = 'turnoverbyyear' and field_value like '[%]' and json_valid(field_value))"""
)
def turnover_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly turnovers, one row a year, from the nested field."""
    rows = table(spark, sf_dir, "extracted_fields").where((attribute_key(F.col("field_name")) == "turnoverbyyear") & F.col("field_value").like("[%]"))
    return rows.select("field_id", F.explode(F.from_json("field_value", "array<struct<financial_year:string,turnover_lakhs:double>>")).alias("t")).select("field_id", "t.financial_year", "t.turnover_lakhs")


#: Numbers of field_id in a block of a summary, so that no row gathers more.
BLOCK = 4096


@_query(f"select document_id, field_id // {BLOCK} block, count(*) fields, string_agg(field_name || ': ' || field_value, '; ' order by field_id) shown from extracted_fields where field_value is not null and field_value <> '' group by document_id, field_id // {BLOCK}")
def field_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled fields of every paper in one line a block of field_id, in field order: papers of usual size lie in one block or two."""
    rows = table(spark, sf_dir, "extracted_fields").where("field_value is not null and field_value <> ''")
    parts = F.array_sort(F.collect_list(F.struct("field_id", F.concat(F.col("field_name"), F.lit(": "), F.col("field_value")).alias("t"))))
    grouped = rows.groupBy("document_id", F.floor(F.col("field_id") / BLOCK).alias("block")).agg(F.count("*").alias("fields"), parts.alias("p"))
    return grouped.select("document_id", "block", "fields", F.array_join(F.transform("p", lambda x: x["t"]), "; ").alias("shown"))


@_query(
    f"""with v as (select d.tender_id, d.bidder_name, f.field_id, d.source_file, d.page_number, try_cast(regexp_replace(f.field_value, '[^\\d.]', '', 'g') as double)
    * (case when contains(lower(f.field_value), 'lakh') or contains(lower(f.field_value), 'lac') then 1e5 else 1.0 end) * (case when contains(lower(f.field_value), 'crore') then 1e7 else 1.0 end) value
    from extracted_fields f join page_documents d using (document_id) where d.doc_type = 'EXPERIENCE_CERTIFICATE' and {_KEY_SQL.format("f.field_name")} = 'totalcontractvalue')
    select tender_id, bidder_name, place, field_id, value from (select *, row_number() over (partition by tender_id, bidder_name order by value desc, source_file, page_number, field_id) place from v where value > 0) where place <= 3"""
)
def top_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest contract values of every bidder, ties by file and page: a top-k report."""
    papers = table(spark, sf_dir, "page_documents").where("doc_type = 'EXPERIENCE_CERTIFICATE'").select("document_id", "tender_id", "bidder_name", "source_file", "page_number")
    rows = table(spark, sf_dir, "extracted_fields").where(attribute_key(F.col("field_name")) == "totalcontractvalue").select("document_id", "field_id", ops.loose_number(F.col("field_value")).alias("value")).where("value > 0")
    w = Window.partitionBy("tender_id", "bidder_name").orderBy(F.col("value").desc(), "source_file", "page_number", "field_id")
    return rows.join(papers, "document_id").withColumn("place", F.row_number().over(w)).where("place <= 3").select("tender_id", "bidder_name", "place", "field_id", "value")


#: A contract counts from this value on, and so many of the largest are shown.
COUNTED, SHOWN = 5e6, 3


@_query(
    f"""with v as (select d.tender_id, d.bidder_name, f.field_id, try_cast(regexp_replace(f.field_value, '[^\\d.]', '', 'g') as double)
    * (case when contains(lower(f.field_value), 'lakh') or contains(lower(f.field_value), 'lac') then 1e5 else 1.0 end) * (case when contains(lower(f.field_value), 'crore') then 1e7 else 1.0 end) value
    from extracted_fields f join page_documents d using (document_id) where d.doc_type = 'EXPERIENCE_CERTIFICATE' and {_KEY_SQL.format("f.field_name")} = 'totalcontractvalue'),
    n as (select *, row_number() over (partition by tender_id, bidder_name order by value desc, field_id) k from v where value >= {COUNTED})
    select v.tender_id, v.bidder_name, count(*) contracts, count(*) filter (where v.value >= {COUNTED}) counted, coalesce(max(s.shown), '') shown from v left join
    (select tender_id, bidder_name, string_agg(field_id::varchar, ', ' order by k) shown from n where k <= {SHOWN} group by all) s on s.tender_id = v.tender_id and s.bidder_name = v.bidder_name group by v.tender_id, v.bidder_name"""
)
def contract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts of every bidder, those of COUNTED rupees or more, and the SHOWN largest of these as evidence."""
    papers = table(spark, sf_dir, "page_documents").where("doc_type = 'EXPERIENCE_CERTIFICATE'").select("document_id", "tender_id", "bidder_name")
    rows = table(spark, sf_dir, "extracted_fields").where(attribute_key(F.col("field_name")) == "totalcontractvalue").select("document_id", "field_id", ops.loose_number(F.col("field_value")).alias("value")).join(papers, "document_id")
    by, counted = ["tender_id", "bidder_name"], F.col("value") >= COUNTED
    w = Window.partitionBy(*by).orderBy(F.col("value").desc(), "field_id")
    top = rows.where(counted).withColumn("k", F.row_number().over(w)).where(F.col("k") <= SHOWN).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", "field_id"))).alias("t"))  # SHOWN rows a bidder
    shown = F.array_join(F.transform("t", lambda x: x["field_id"].cast("string")), ", ")
    return rows.groupBy(by).agg(F.count("*").alias("contracts"), F.count_if(counted).alias("counted")).join(top, by, "left").select(*by, "contracts", "counted", F.coalesce(shown, F.lit("")).alias("shown"))


@_query(
    """select tender_id, count(*) pages, date_diff('second', min(read_at), max(read_at)) as seconds,
    round(count(*) / nullif(date_diff('second', min(read_at), max(read_at)), 0), 9) pages_a_second from page_results group by tender_id"""
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages a second of every tender, null where all were read at one time."""
    seconds = F.timestamp_diff("SECOND", F.min("read_at"), F.max("read_at"))
    grouped = table(spark, sf_dir, "page_results").groupBy("tender_id").agg(F.count("*").alias("pages"), seconds.alias("seconds"))
    return grouped.withColumn("pages_a_second", F.round(F.try_divide("pages", "seconds"), 9))


@_query(
    r"""with need as (select doc_type, field_name, lower(regexp_replace(field_name, '[^\p{L}\p{N}]+', '', 'g')) k from field_catalog where is_required),
    have as (select distinct document_id, lower(regexp_replace(field_name, '[^\p{L}\p{N}]+', '', 'g')) k from extracted_fields where field_value is not null and trim(field_value) <> '')
    select d.document_id, d.doc_type, count(*) required, count(*) filter (where h.k is null) lacking from page_documents d join need n using (doc_type) left join have h on h.document_id = d.document_id and h.k = n.k group by all"""
)
def catalogue_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required catalogue fields of every paper, and how many of them it lacks."""
    need = table(spark, sf_dir, "field_catalog").where("is_required").select("doc_type", attribute_key(F.col("field_name")).alias("k"))
    filled = table(spark, sf_dir, "extracted_fields").where("field_value is not null and trim(field_value) <> ''").select("document_id", attribute_key(F.col("field_name")).alias("k")).distinct().withColumn("has", F.lit(1))
    due = table(spark, sf_dir, "page_documents").select("document_id", "doc_type").join(bounded(need), "doc_type")
    return due.join(filled, ["document_id", "k"], "left").groupBy("document_id", "doc_type").agg(F.count("*").alias("required"), F.count_if(F.col("has").isNull()).alias("lacking"))


@_query("select tender_id, sum(n) files, sum(errors) errors from (select tender_id, count(distinct source_file) n, 0 errors from page_results where read_error is null group by tender_id union all select tender_id, 0, count(distinct source_file) from page_results where read_error is not null group by tender_id) group by tender_id")
def read_and_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with read and with unread pages, as the bag union of the two page streams."""
    rows = table(spark, sf_dir, "page_results").select("tender_id", "source_file", "read_error")
    read = rows.where("read_error is null").groupBy("tender_id").agg(F.count_distinct("source_file").alias("files"), F.lit(0).cast("bigint").alias("errors"))
    unread = rows.where("read_error is not null").groupBy("tender_id").agg(F.lit(0).cast("bigint").alias("files"), F.count_distinct("source_file").alias("errors"))
    return read.unionByName(unread).groupBy("tender_id").agg(F.sum("files").alias("files"), F.sum("errors").alias("errors"))


@_query("select s.submission_id, s.tender_id, coalesce(r.criteria, 0) criteria, r.tender_id is null as by_default from submissions s left join (select tender_id, count(*) criteria from eligibility_rules group by tender_id) r using (tender_id)")
def rules_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many criteria a submission's tender has of its own, and whether the default list is used."""
    own = table(spark, sf_dir, "eligibility_rules").groupBy("tender_id").agg(F.count("*").alias("criteria"))
    return table(spark, sf_dir, "submissions").select("submission_id", "tender_id").join(own, "tender_id", "left").select("submission_id", "tender_id", F.coalesce("criteria", F.lit(0)).alias("criteria"), F.col("criteria").isNull().alias("by_default"))


@_query("select date_trunc('hour', read_at)::timestamp as hour, coalesce(source, 'unread') source, count(*) pages from page_results where read_at is not null group by 1, 2")
def hourly_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read in every hour, kept by a stream over the table's files."""
    return streaming.settled(streaming.hourly(streaming.arriving(spark, f"{sf_dir}/page_results.parquet")))
