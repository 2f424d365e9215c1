"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalogue import Catalogue
from ..plans.session import table
from . import cooccur, oracle, termcount

LLM = Catalogue()


@LLM.add("p1_found", oracle.P1_FOUND)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .overlap import split_overlap

    return split_overlap(table(spark, d, "records"))


@LLM.add("p1_report")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    from .overlap import split_report

    return split_report(table(spark, d, "records"))


@LLM.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .confusables import found

    return found(table(spark, d, "records"), table(spark, d, "mentions"), table(spark, d, "term_dictionary"))


@LLM.add("p7_found", oracle.P7_FOUND)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .leakage import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("item_id", "doc_id")


@LLM.add("p7_covered")
def p7_covered(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which an item is covered to a half or more by passages of six words or more, in whatever order they stand."""
    from .leakage import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), seed=6, coverage=0.5)


@LLM.add("p7_items")
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    from .leakage import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _code_marks(spark: SparkSession, d: str) -> DataFrame:
    from .termcount import code_marks

    return code_marks(table(spark, d, "records"), table(spark, d, "label_frequency"), longest=1)


@LLM.add("p4_found", termcount.FOUND_SQL)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _code_marks(spark, d).where("mark is not null").select("code", "mark")


@LLM.add("p4_counts", termcount.COUNTS_SQL)
def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _code_marks(spark, d).where("records > 0").select("code", "occurrences", "records")


@LLM.add("p4_sequences", oracle.P4_SEQUENCES)
def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring codes of a record as terms of two."""
    g = termcount.gram_counts(termcount.record_codes(table(spark, d, "records")), "codes", 2).where("n = 2")
    return g.select(F.array_join("gram", " ").alias("codes"), "occurrences", "records")


@LLM.add("p5_found", cooccur.FOUND_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.code_pairs(table(spark, d, "records"))


@LLM.add("p5_scores", cooccur.SCORES_SQL)
def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    s = cooccur.associations(termcount.record_codes(table(spark, d, "records")), "codes")
    return s.select(F.col("a").alias("code_a"), F.col("b").alias("code_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, d, "documents"), table(spark, d, "pack_budgets"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@LLM.add("p6_containers")
def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@LLM.add("p6_fill")
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    from .packing import fill_report

    return fill_report(_packed(spark, d), table(spark, d, "pack_budgets"))


@LLM.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from .residue import residue

    return residue(table(spark, d, "documents")).select("doc_id")


@LLM.add("p8_kinds")
def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    from .residue import residue

    return residue(table(spark, d, "documents"))


@LLM.add("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .identifiers import found

    return found(table(spark, d, "records"))


@LLM.add("p2_redacted")
def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    from .identifiers import redacted

    return redacted(table(spark, d, "records"))
