"""Queries p2, p5, p8, p9 and p10 over the tables of TESTDATA.md, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm import bpe, lookalike, matching, packing, sentences
from lodestat.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("source_quote", "legend_quote")
    pairs = F.array(*[F.struct(F.lit(c).alias("quote_field"), F.col(c).alias("quote")) for c in fields])
    rows = table(spark, sf, "claims").select("paper_id", "claim_uid", F.inline(pairs))
    return rows.where(F.col("quote").isNotNull()).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    anchors = table(spark, sf, "findings").select("finding_id", "paper_id", "anchor").where(F.col("anchor").isNotNull()).distinct()
    found = lookalike.same_look(anchors, _quotes(spark, sf), within="paper_id", left_text="anchor", right_text="quote")
    return found.select("finding_id", "claim_uid", "quote_field").distinct()


def p2_forms(spark: SparkSession, sf: str) -> DataFrame:
    claims = table(spark, sf, "claims").select("claim_uid", "source_quote", "legend_quote")
    return lookalike.normalise(claims, ["source_quote", "legend_quote"]).distinct()


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_quantities(table(spark, sf, "claims"), table(spark, sf, "reader_claims"), table(spark, sf, "term_mappings"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).select("claim_uid", "reader_uid")


def p5_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf, "documents"))


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.decode_corpus(bpe.encode_corpus(table(spark, sf, "documents")))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_corpus(table(spark, sf, "documents"), table(spark, sf, "packing_targets"))


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, sf), table(spark, sf, "packing_targets"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_forms, p5_found, p5_confidence, p8_ids, p8_round_trip, p9_containers, p9_fill, p10_found)}

SQL: dict[str, str] = {"p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
