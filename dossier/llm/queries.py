"""Queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.names import attribute_key
from dossier.llm import leakage, mixing, names, nearcopies, private, residue, scans
from dossier.session import table


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    bidders = table(spark, sf_dir, "verdicts").select(F.lit("bidder").alias("kind"), F.col("bidder_name").alias("name"))
    papers = table(spark, sf_dir, "page_documents").where("doc_type = 'EXPERIENCE_CERTIFICATE'").select("document_id")
    buyers = table(spark, sf_dir, "extracted_fields").where(attribute_key(F.col("field_name")) == "buyer").join(papers, "document_id", "left_semi").select(F.lit("buyer").alias("kind"), F.col("field_value").alias("name"))
    return bidders.distinct().unionByName(buyers.distinct())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_party_pairs(names.parties(_typed_names(spark, sf_dir)))


def p1_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spelling: its party, and its links to other spellings."""
    return names.parties(_typed_names(spark, sf_dir)).where("party is not null")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noisy_lines(table(spark, sf_dir, "page_results"), table(spark, sf_dir, "page_documents"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of every page."""
    return scans.repaired(table(spark, sf_dir, "page_results"), table(spark, sf_dir, "page_documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.items(private.free_texts(table(spark, sf_dir, "page_results"), table(spark, sf_dir, "extracted_fields")))


def p4_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts and free-text values with placeholders in place of personal information."""
    return private.replaced(private.free_texts(table(spark, sf_dir, "page_results"), table(spark, sf_dir, "extracted_fields")))


def p4_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind the spans that a labeler votes for, those the classifier takes, and those it decides against the majority of votes."""
    return private.decisions(private.proposals(private.free_texts(table(spark, sf_dir, "page_results"), table(spark, sf_dir, "extracted_fields"))))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.copy_pairs(nearcopies.classes(table(spark, sf_dir, "page_results")))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page that has copies: its class, its links, its file, and whether that is the file of the class's first page."""
    pages = table(spark, sf_dir, "page_results")
    return nearcopies.with_files(nearcopies.classes(pages), pages)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with its place: whole phrases, and what holds most of an item in a piece or a few."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed rows."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the mix's tokens that each source really got."""
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_ids(table(spark, sf_dir, "documents")).select("doc_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of residue have a seed mark, and how many the model finds alone."""
    found = residue.residue_ids(table(spark, sf_dir, "documents"))
    return found.groupBy(F.when(F.col("trusted"), "seed").otherwise("model").alias("found_by")).agg(F.count("*").alias("records"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the residue records."""
    return residue.without_residue(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_parties": p1_parties, "p3_found": p3_found, "p3_paragraphs": p3_paragraphs, "p4_found": p4_found, "p4_replaced": p4_replaced, "p4_decisions": p4_decisions, "p6_found": p6_found, "p6_classes": p6_classes, "p7_found": p7_found, "p7_matches": p7_matches, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_clean": p9_clean, "p9_report": p9_report}
SQL: dict[str, str] = {}
