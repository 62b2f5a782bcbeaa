"""Rules of page classification and field reading, as data."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.sources.folders import tenders

# Document types in order of precedence: name, label, least score, phrases (phrase, weight, phrases that must stand
# on the page too). A phrase counts wherever it stands, whatever its letter case.
DOCUMENT_TYPES = [
    ("PAN", "PAN Card", 4, [("Permanent Account Number Card", 5, []), ("INCOME TAX DEPARTMENT", 2, ["GOVT. OF INDIA", "e-PAN"]), ("Income Tax Department", 1, []), ("Permanent Account Number", 2, []), ("Father", 1, []), ("Date of Birth", 1, [])]),
    ("GST", "GST Registration Certificate", 4, [("Form GST REG", 4, ["Registration"]), ("Registration Certificate", 2, ["Goods and Services Tax", "GSTIN"]), ("GSTIN", 2, []), ("Legal Name", 1, []), ("Trade Name", 1, []), ("Constitution of Business", 1, [])]),
    ("UDYAM", "Udyam Registration Certificate", 4, [("Udyam Registration Certificate", 5, []), ("Udyam", 2, ["Registration", "CERTIFICATE"]), ("NAME OF ENTERPRISE", 2, []), ("Ministry of Micro", 1, [])]),
    ("UDYOG_AADHAR", "Udyog Aadhar Registration", 4, [("Udyog Aadhaar Registration Certificate", 5, []), ("Ministry of Micro, Small and Medium Enterprises", 2, ["Aadhaar"]), ("Memorandum", 1, [])]),
    ("MSME", "MSME / NSIC Registration", 3, [("NATIONAL SMALL INDUSTRIES", 3, ["Government of"]), ("ANNEXURE TO GOVERNMENT PURCHASES ENLISTMENT CERTIFICATE", 5, ["A Government of india Enterprise"]), ("NSIC", 1, [])]),
    ("TURNOVER_CERTIFICATE", "Annual Turnover Certificate (CA issued)", 4, [("ANNUAL TURNOVER CERTIFICATE", 5, []), ("TURNOVER CERTIFICATE", 5, []), ("IT MAY CONCERN", 1, []), ("Financial Year", 1, []), ("Chartered", 1, []), ("Accountants", 1, []), ("Membership", 1, []), ("UDIN", 1, [])]),
    ("EXPERIENCE_CERTIFICATE", "Experience / Work Completion Certificate", 5, [("EXPERIENCE/WORK COMPLETION CERTIFICATE", 6, []), ("WORK COMPLETION CERTIFICATE", 5, []), ("TO WHOM IT MAY CONCERN", 2, ["Tender No", "Contract"]), ("Tender No", 2, []), ("Contract No", 2, []), ("Total Contract value", 2, []), ("Total payment made", 2, []), ("Performance", 1, []), ("Work completed", 1, [])]),
    ("GEM_CONTRACT", "GeM Contract", 5, [("GEMC", 3, []), ("Contract Generated Date", 3, []), ("Contract No", 2, []), ("Organisation Details", 1, []), ("Financial Approval Detail", 1, []), ("Paying Authority Details", 1, []), ("Consignee Details", 1, []), ("Service Provider Details", 1, [])]),
    ("UNDERTAKING", "Undertaking (non-blacklist / eligibility declaration)", 2, [("undertaking", 2, ["banned", "blacklisted"]), ("undertaking", 1, []), ("blacklisted", 2, []), ("debarred", 1, [])]),
    ("UDIN_STANDALONE", "UDIN Reference", 3, [("UDIN:", 3, [])]),
    ("TECHNICAL_SPECIFICATION", "Technical Specification Submission", 3, [("Technical Specification", 3, ["Bid"]), ("Technical Bid", 3, []), ("as per the bid requirement", 1, []), ("Scope of work", 1, []), ("Compliance", 1, [])]),
]

# Fields that are read by pattern: type, field, pattern, label that the value stands near, required.
PATTERN_FIELDS = [
    ("PAN", "pan_number", r"[A-Z]{5}[0-9]{4}[A-Z]{1}", None, True),
    ("PAN", "dob", r"\d{2}[/-]\d{2}[/-]\d{4}", None, False),
    ("GST", "gstin", r"\d{2}[A-Z]{5}\d{4}[A-Z]{1}\d[Z]{1}[A-Z\d]{1}", None, True),
    ("GST", "registration_date", r"\d{2}[/-]\d{2}[/-]\d{4}", None, False),
    ("UDYAM", "udyam_number", r"UDYAM-[A-Z]{2}-\d{2}-\d{7}", None, True),
    ("MSME", "validity_upto", r"\d{2}[/-]\d{2}[/-]\d{4}", None, False),
    ("TURNOVER_CERTIFICATE", "membership_number", r"\b\d{5,6}\b", "Membership No", True),
    ("TURNOVER_CERTIFICATE", "frn", r"\d{6}[A-Z]", None, False),
    ("TURNOVER_CERTIFICATE", "udin", r"[0-9]{2}[A-Z0-9]{12,16}", "UDIN", True),
    ("TURNOVER_CERTIFICATE", "date", r"\d{2}[/-]\d{2}[/-]\d{4}", None, False),
    ("GEM_CONTRACT", "contract_no", r"GEMC-\d{9,15}", None, True),
    ("GEM_CONTRACT", "tender_no", r"GEM/20\d{2}/[A-Z]/\d+", None, True),
    ("GEM_CONTRACT", "contract_date", r"\d{1,2}\s+\w+\s+20\d{2}", None, False),
    ("UDIN_STANDALONE", "udin", r"[0-9]{2}[A-Z0-9]{12,16}", "UDIN", True),
]
#: Characters after a label in which a value is looked for first.
NEAR_LABEL = 40
#: Native text of fewer characters than this goes to recognition.
NATIVE_LEAST = 20

#: A rules file is configuration; a larger one is refused.
MOST_BYTES = 10_000_000
CRITERION = "id string, label string, type string, source_document_type string, field_used string, min_value_inr double, min_value_pct_of_estimate double, fail_message string, note string"
ELIGIBILITY = f"tender_id string, estimated_cost_inr double, criteria array<struct<{', '.join(c.replace(' ', ':') for c in CRITERION.split(', '))}>>"


def _small_file(spark: SparkSession, path: str) -> str:
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES).select("content").limit(2).collect()  # one file
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file of at most {MOST_BYTES} bytes")
    return bytes(rows[0].content).decode("utf-8")


def read_types(spark: SparkSession, path: str) -> tuple[list, list]:
    """(document types, pattern fields) of a JSON rules file, in the file's order, in the form of DOCUMENT_TYPES and PATTERN_FIELDS: types
    can be added without code. Fields without a pattern are left out; an empty file gives no types."""
    found = json.loads(_small_file(spark, path) or "{}").get("document_types") or {}
    types, fields = [], []
    for name, rule in found.items():
        detect = rule.get("detect") or {}
        phrases = [(p["phrase"], int(p["weight"]), list(p.get("requires_with") or [])) for p in (detect.get("any_of_high") or []) + (detect.get("supporting") or [])]
        types.append((name, rule.get("label", name), int(rule.get("min_score", 1)), phrases))
        fields += [(name, f, d["regex"], d.get("context"), bool(d.get("required"))) for f, d in (rule.get("fields") or {}).items() if "regex" in d]
    return types, fields


def read_eligibility(spark: SparkSession, root: str, default: str) -> DataFrame:
    """(tender_id, by_default, estimated_cost_inr, ord, id, label, ...): the criteria of every tender folder under root, from its own
    eligibility_rules.json, or from the default file where it has none. A tender with an empty own list has no rows."""
    own = spark.read.schema(ELIGIBILITY).option("multiLine", True).option("pathGlobFilter", "eligibility_rules.json").option("recursiveFileLookup", "true").json(root)
    base = root.rstrip("/").split("/")[-1]
    place = F.regexp_extract(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), f"/\\Q{base}\\E/([^/]+)/eligibility_rules.json$", 1)
    own = own.select(place.alias("folder"), "estimated_cost_inr", "criteria").where("folder <> ''")
    lacking = tenders(spark, root).select(F.col("tender_id").alias("folder")).join(own.select("folder"), "folder", "left_anti")
    general = F.from_json(F.lit(_small_file(spark, default)), ELIGIBILITY)
    rest = lacking.select("folder", general.alias("g")).select("folder", "g.estimated_cost_inr", "g.criteria", F.lit(True).alias("by_default"))
    rows = own.withColumn("by_default", F.lit(False)).unionByName(rest)
    listed = rows.select(F.col("folder").alias("tender_id"), "by_default", "estimated_cost_inr", F.posexplode("criteria").alias("ord", "c"))
    return listed.select("tender_id", "by_default", "estimated_cost_inr", (F.col("ord") + 1).alias("ord"), "c.*")
