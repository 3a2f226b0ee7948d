"""A corpus pipeline: language ID, near-duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import decontaminate, language_id, simhash
from tidewrack.llm.common import step_table, table
from tidewrack.llm.queries import language_model, packed


#: Score from which a missing language is filled in.
SURE = 0.5


def packed_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as ``row``, and only the columns that a stage works on beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; where ``lang`` is missing, the classifier's language if its score is `SURE` or more.

    The classifier drops nothing: a text with letters stays, whatever its
    scores and also where there was nothing to learn from.
    """
    found = language_id.identify(packed_rows(docs, "text", "lang"), language_model(docs))
    known = F.col("lang_pred") != language_id.UNKNOWN
    missing = F.trim(F.coalesce("lang", F.lit(""))) == ""
    filled = F.when(missing & known & (F.col("lang_score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    kept = found.filter(known | F.col("text").rlike(r"\p{L}"))
    return kept.select(*[filled.alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, one with an id first.

    Texts are linked at a similarity of 0.8 or more of their five-word
    shingles, whatever ids they have: SimHash fingerprints searched in BK-trees
    and checked by that similarity, then what lies too far apart for them by an
    exact join. An id that stands on two texts, or a null one, links nothing.
    Rows alike in every column are one.
    """
    whole = packed_rows(docs, "doc_id", "text")
    fields = [F.col(f"row.`{c}`") for c in docs.columns]
    mark = F.struct(F.xxhash64(*fields).alias("a"), F.xxhash64(F.lit("row"), *fields).alias("b")).alias("mark")
    own = whole.select("doc_id", F.xxhash64("text").alias("node"), mark)
    grouped = own.join(simhash.copy_groups(docs.select("text")), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))
    kept = grouped.groupBy("component").agg(first.alias("first")).select(F.col("first.mark").alias("mark"))
    return whole.select("row", mark).join(kept, "mark", "left_semi").select("row.*").dropDuplicates()


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words (or whole shorter item) stands; those without text stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents, packed into sequences of 2048 tokens; a null text is its end id alone."""
    return packed(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", near_dedup),
    ("decontamination", without_benchmarks),
    ("packing", into_sequences),
]

#: The stages train, hash and search by means that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = step_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
