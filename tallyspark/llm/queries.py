"""Queries of the text and entity problems 3 to 8 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, canonlist, encode, linkage, lookalike, mojibake, packing

_PAIRS = [("article", "article"), ("normalized", "normalized")]


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value that looks like an article of the reference, in the reference's characters."""
    return lookalike.canonical_values(table(spark, sf_dir, "extracted_rows"), table(spark, sf_dir, "articles_ref"), "row_id", _PAIRS).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that look the same as a reference article but consist of other characters."""
    found = lookalike.canonical_values(table(spark, sf_dir, "extracted_rows"), table(spark, sf_dir, "articles_ref"), "row_id", _PAIRS)
    return found.where("value != canonical").select("row_id", "field_name").distinct()


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line or row with its item and the confidence of the match."""
    rows = linkage.row_records(table(spark, sf_dir, "extracted_rows"))
    lines = linkage.line_records(table(spark, sf_dir, "doc_lines"))
    links = linkage.link(rows.unionByName(lines), linkage.item_records(table(spark, sf_dir, "canonical_items")))
    return links.select("item_id", F.when(F.col("kind") == 1, "row").otherwise("line").alias("record_kind"), F.col("rid").alias("record_id"), "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line or row that describes the same lot as an item, with that item."""
    return p4_matches(spark, sf_dir).select("item_id", "record_kind", "record_id")


def _header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "canon_fields").select("field_key", "title_ru", "title_en").collect()  # a fixed table
    titles = [(t, r.field_key) for r in fields for t in (r.title_ru, r.title_en) if t]
    sheets = table(spark, sf_dir, "extracted_sheets")
    return canonlist.map_values(sheets, titles, canonlist.learn_aliases(sheets, titles))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field that each header cell means, or none."""
    return _header_fields(spark, sf_dir).select("sheet_id", "col_no", "field_key").distinct()


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header texts that mean none of the fields, and how many cells have each."""
    return _header_fields(spark, sf_dir).where(F.col("field_key") == canonlist.NONE).groupBy("cell", "how").agg(F.countDistinct("sheet_id", "col_no").alias("cells"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document by byte_bpe_50k, without special tokens."""
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's ids decode to its text again."""
    docs = table(spark, sf_dir, "documents")
    back = encode.decode_corpus(encode.encode_corpus(docs)).withColumnRenamed("text", "decoded")
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's parts and their containers of 2,048 tokens."""
    return packing.pack_corpus(table(spark, sf_dir, "documents"), path=bpe.default_path())


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents, with the text as far as it can be restored."""
    docs = table(spark, sf_dir, "documents")
    return mojibake.repair_corpus(docs, mojibake.fit(docs)).where("garbled").select("doc_id", "restored", "gain")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which the text, wholly or partly, is garbled by a wrong decoding."""
    return p8_restored(spark, sf_dir).select("doc_id").distinct()


def p8_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detector's margin was measured on: clean lines kept out of training, lines garbled from them, and how many came back exactly."""
    measured = mojibake.fit_measured(table(spark, sf_dir, "documents"))[1]
    return spark.createDataFrame([(k, float(v)) for k, v in measured.items()], "figure string, value double")


QUERIES = {f.__name__: f for f in (p3_found, p3_canonical, p4_found, p4_matches, p5_found, p5_unmatched, p6_ids, p6_roundtrip, p7_containers, p8_found, p8_restored, p8_held_out)}
ORACLE: dict[str, str] = {}
