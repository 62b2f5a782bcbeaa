"""Queries of the general data operators (units, wide rows) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.names import attribute_key
from dossier.operators import units, wide
from dossier.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    fields = units.field_amounts(t("extracted_fields"), t("page_documents"), t("field_catalog"), t("page_results"))
    rules = units.rule_amounts(t("eligibility_rules"))
    return fields.select(F.lit("extracted_fields").alias("src"), F.col("field_id").alias("row_id"), "value_inr").unionByName(
        rules.select(F.lit("eligibility_rules").alias("src"), F.col("rule_id").alias("row_id"), "value_inr")
    )


def p2_amounts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and sum of the amounts of every money field in rupees, a consumer of the units operator."""
    t = lambda n: table(spark, sf_dir, n)
    amounts = units.field_amounts(t("extracted_fields"), t("page_documents"), t("field_catalog"), t("page_results"))
    named = t("extracted_fields").select("field_id", attribute_key(F.col("field_name")).alias("attribute"))
    return amounts.join(named, "field_id").groupBy("attribute").agg(F.count("*").alias("amounts"), F.sum(F.col("value_inr").cast("decimal(38,0)")).alias("total_inr"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    catalog = t("field_catalog").where(F.col("value_type").isin("date", "boolean", "integer"))  # the columns asked for: others are not read into cells
    columns = wide.columns_of(catalog)
    rows = wide.wide(t("extracted_fields"), t("page_documents"), catalog)
    return wide.cells_of(rows, columns, ("date", "boolean", "integer"))


def p5_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole wide table, money in rupees by the value's, page's or field's unit."""
    t = lambda n: table(spark, sf_dir, n)
    return wide.wide(t("extracted_fields"), t("page_documents"), t("field_catalog"), t("page_results"))


P5_SQL = r"""
with m as (
  select e.document_id, c.field_name, c.value_type, e.field_id, e.extracted_at, lower(trim(e.field_value)) v
  from extracted_fields e join page_documents d using (document_id)
  join field_catalog c on c.doc_type = d.doc_type
   and lower(regexp_replace(e.field_name, '[^\p{L}\p{N}]+', '', 'g')) = lower(regexp_replace(c.field_name, '[^\p{L}\p{N}]+', '', 'g'))
  where c.value_type in ('date', 'boolean', 'integer') and trim(e.field_value) <> ''
), t as (
  select *, regexp_replace(v, '^(?:dated|dt\.?|date|on)\s*[:.]?\s*', '') w from m
), parts as (
  select *, case
    when regexp_matches(w, '^\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}$') then
      [regexp_extract(w, '^(\d+)', 1), regexp_extract(w, '^\d+[/.\-](\d+)', 1), regexp_extract(w, '(\d+)$', 1)]
    when regexp_matches(w, '^\d{1,2}[/.\-]\d{1,2}[/.\-](\d{4}|\d{2})$') then
      [regexp_extract(w, '(\d+)$', 1), regexp_extract(w, '^\d+[/.\-](\d+)', 1), regexp_extract(w, '^(\d+)', 1)]
    when regexp_matches(w, '^\d{1,2}(?:st|nd|rd|th)?[\s.\-/]*[a-z]{3,9}\.?[\s,.\-/]*(\d{4}|\d{2})$') then
      [regexp_extract(w, '(\d{4}|\d{2})$', 1), regexp_extract(w, '^\d{1,2}(?:st|nd|rd|th)?[\s.\-/]*([a-z]{3,9})', 1), regexp_extract(w, '^(\d{1,2})', 1)]
    when regexp_matches(w, '^[a-z]{3,9}\.?\s*\d{1,2}(?:st|nd|rd|th)?[\s,.\-]+(\d{4}|\d{2})$') then
      [regexp_extract(w, '(\d{4}|\d{2})$', 1), regexp_extract(w, '^([a-z]{3,9})', 1), regexp_extract(w, '^[a-z]{3,9}\.?\s*(\d{1,2})', 1)]
    end p
  from t
), cells as (
  select document_id, field_name, field_id, extracted_at, case value_type
    when 'date' then cast(try_cast(
        (case when length(p[1]) = 2 then '20' || p[1] else p[1] end) || '-' ||
        lpad(case when regexp_matches(p[2], '^\d+$') then p[2]
             when regexp_matches(p[2], '^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$')
             then cast(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(p[2], 1, 3)) as varchar) end, 2, '0') || '-' ||
        lpad(p[3], 2, '0') as date) as varchar)
    when 'boolean' then case
        when regexp_replace(v, '[.!]+$', '') in ('1','true','t','yes','y','present','available','submitted','enclosed','attached','on','हाँ') then 'true'
        when regexp_replace(v, '[.!]+$', '') in ('0','false','f','no','n','absent','not present','not available','nil','off','नहीं') then 'false' end
    when 'integer' then cast(try_cast(nullif(replace(regexp_extract(v, '^[^\d]*?(-?\d+(?:,\d+)*)(?:\.0*)?[^\d]*$', 1), ',', ''), '') as bigint) as varchar)
    end cell
  from parts
)
select document_id, field_name, arg_max(cell, (coalesce(extracted_at, timestamp '0001-01-01'), field_id)) as cell
from cells where cell is not null group by document_id, field_name
"""

# Number words of the SQL's reading of amounts in words.
_WORDS_SQL = "map {'one':1,'two':2,'three':3,'four':4,'five':5,'six':6,'seven':7,'eight':8,'nine':9,'ten':10,'eleven':11,'twelve':12,'thirteen':13,'fourteen':14,'fifteen':15,'sixteen':16,'seventeen':17,'eighteen':18,'nineteen':19,'twenty':20,'thirty':30,'forty':40,'fifty':50,'sixty':60,'seventy':70,'eighty':80,'ninety':90}"


def _scale_sql(text: str) -> str:
    """The unit that a wording states, by its words."""
    return rf"""case when regexp_matches({text}, '(^|[^a-z])(crores?|crs?)([^a-z]|$)|करोड़') then 10000000
      when regexp_matches({text}, '(^|[^a-z])(lakhs?|lacs?|l)([^a-z]|$)|लाख') then 100000
      when regexp_matches({text}, '(^|[^a-z])(millions?|mn|m)([^a-z]|$)') then 1000000
      when regexp_matches({text}, '(^|[^a-z])(thousands?|k)([^a-z]|$)|[''’]000|हजार') then 1000
      when regexp_matches({text}, '(^|[^a-z])(rs|inr|rupees?)([^a-z]|$)|₹|/-') then 1 end"""


def _words_sql(part: str) -> str:
    """The value of number words, with hundreds."""
    total = lambda t: f"coalesce(list_sum(list_transform(string_split(trim({t}), ' '), lambda x: coalesce({_WORDS_SQL}[x], 0))), 0)"
    return f"(case when contains({part}, 'hundred') then {total(f'split_part({part}, $$hundred$$, 1)')} * 100 + {total(f'split_part({part}, $$hundred$$, 2)')} else {total(part)} end)"


P2_SQL = rf"""
with m as (
  select e.field_id, lower(trim(e.field_value)) v, lower(c.default_unit) du, d.page_id
  from extracted_fields e join page_documents d using (document_id)
  join field_catalog c on c.doc_type = d.doc_type and c.value_type = 'money'
   and lower(regexp_replace(e.field_name, '[^\p{{L}}\p{{N}}]+', '', 'g')) = lower(regexp_replace(c.field_name, '[^\p{{L}}\p{{N}}]+', '', 'g'))
  where trim(e.field_value) <> ''
), unit_lines as (
  select page_id, lower(regexp_extract(text, '(?im)^[ \t(]*((?:all[ \t]+)?(?:amounts?|figures|values?|राशि)[\s:(][^\n\d]{{0,24}}(?:lakhs?|lacs?|crores?|thousands?|millions?|rupees|rs\.?|inr|लाख|करोड़|हजार|रुपये)[^\n\d]{{0,20}}(?:[''’]0{{3}})?[ \t).]*)$', 1)) line
  from page_results where text is not null
), parts as (
  select m.*, u.line, regexp_matches(v, '\d') has_digits, regexp_matches(v, '^[\s\d.,]+$') bare,
    replace(regexp_extract(regexp_replace(v, '[''’]000', ''), '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') num,
    regexp_matches(v, '\d +(crore|lakh) +\d') several, regexp_replace(v, '^rupees +| +(only|rupees)$', '', 'g') w
  from m left join unit_lines u using (page_id)
), words7 as (
  select *, case when contains(w, 'crore') then split_part(w, 'crore', 1) else '' end p7, case when contains(w, 'crore') then split_part(w, 'crore', 2) else w end r7 from parts
), words5 as (
  select *, case when contains(r7, 'lakh') then split_part(r7, 'lakh', 1) else '' end p5, case when contains(r7, 'lakh') then split_part(r7, 'lakh', 2) else r7 end r5 from words7
), words3 as (
  select *, case when contains(r5, 'thousand') then split_part(r5, 'thousand', 1) else '' end p3, case when contains(r5, 'thousand') then split_part(r5, 'thousand', 2) else r5 end p0 from words5
), amounts as (
  select field_id, case
    when has_digits and several then coalesce(try_cast(regexp_extract(v, '(\d+) +crore', 1) as bigint), 0) * 10000000 + coalesce(try_cast(regexp_extract(v, '(\d+) +lakh', 1) as bigint), 0) * 100000 + coalesce(try_cast(regexp_extract(v, '(\d+) +thousand', 1) as bigint), 0) * 1000
    when has_digits then cast(round(try_cast(num as decimal(28, 8)) * coalesce({_scale_sql("v")}, case when bare then {_scale_sql("line")} end, {_scale_sql("du")}, 1)) as bigint)
    when regexp_matches(w, '^([a-z]+ )+(crore|lakh|thousand|hundred)') then {_words_sql("p7")} * 10000000 + {_words_sql("p5")} * 100000 + {_words_sql("p3")} * 1000 + {_words_sql("p0")}
    end value_inr from words3
)
select 'extracted_fields' src, field_id row_id, cast(value_inr as bigint) value_inr from amounts where value_inr is not null
union all
select 'eligibility_rules', rule_id, cast(round(cast(min_value_inr as decimal(28, 8)) * coalesce({_scale_sql("lower(concat_ws(' ; ', note, regexp_extract(label, '[(](.*)[)]', 1)))")}, 1)) as bigint)
from eligibility_rules where min_value_inr is not null and min_value_inr <> 0
"""

# The columns that the catalogue gives the wide table, by type.
WIDE_COLUMNS = {
    "date": "commencement_date contract_date date dob period_from period_to registration_date validity_upto work_extended_upto",
    "boolean": "has_seal has_signature",
    "integer": "membership_number",
    "money": "average_annual_turnover total_contract_value total_payment_made",
    "json": "turnover_by_year",
    "text": "authority_name buyer ca_firm_name ca_name compliance_note consignee contract_name contract_no designation enterprise_name father_name frn gstin legal_name name organisation pan_number penalty performance place registration_number "
    "service_provider signatory state status tender_no trade_name type udin udyam_number undertaking_type work_completed work_order_no",
}
_SQL_TYPES = {"date": "date", "boolean": "boolean", "integer": "bigint", "money": "bigint", "json": "varchar", "text": "varchar"}
_WIDE_SQL = ", ".join(f"cast(max(cell) filter (where field_name = '{c}') as {_SQL_TYPES[t]}) {c}" for t, cs in WIDE_COLUMNS.items() for c in cs.split())
P5_WIDE_SQL = rf"""
with known as (
  select e.document_id, c.field_name, c.value_type, e.field_id, e.extracted_at, e.field_value
  from extracted_fields e join page_documents d using (document_id)
  join field_catalog c on c.doc_type = d.doc_type
   and lower(regexp_replace(e.field_name, '[^\p{{L}}\p{{N}}]+', '', 'g')) = lower(regexp_replace(c.field_name, '[^\p{{L}}\p{{N}}]+', '', 'g'))
  where trim(e.field_value) <> ''
), readable as (
  select document_id, field_name, field_id, extracted_at, field_value cell from known where value_type in ('text', 'json')
  union all
  select k.document_id, k.field_name, k.field_id, k.extracted_at, cast(x.value_inr as varchar) from known k join ({P2_SQL}) x on x.src = 'extracted_fields' and x.row_id = k.field_id where k.value_type = 'money'
), cells as (
  select document_id, field_name, arg_max(cell, (coalesce(extracted_at, timestamp '0001-01-01'), field_id)) cell from readable group by document_id, field_name
  union all
  select document_id, field_name, cell from ({P5_SQL})
)
select document_id, {_WIDE_SQL} from cells group by document_id
"""

QUERIES = {"p2_found": p2_found, "p2_amounts_by_type": p2_amounts_by_type, "p5_found": p5_found, "p5_wide": p5_wide}
_BY_TYPE_SQL = rf"""select lower(regexp_replace(e.field_name, '[^\p{{L}}\p{{N}}]+', '', 'g')) attribute, count(*) amounts, cast(sum(value_inr) as decimal(38, 0)) total_inr
from ({P2_SQL}) x join extracted_fields e on x.row_id = e.field_id where x.src = 'extracted_fields' group by 1"""
SQL = {"p2_found": P2_SQL, "p2_amounts_by_type": _BY_TYPE_SQL, "p5_found": P5_SQL, "p5_wide": P5_WIDE_SQL}
