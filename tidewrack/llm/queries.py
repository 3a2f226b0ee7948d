"""The queries of this subpackage over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, collocations, dac, decontaminate, language_id, license_scan, lm, packing, simhash, topk, url_filter, whitening
from .common import remainder, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Rules of op10, fixed values: host/path and verdict.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors of every query vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from the documents whose crc32 modulo 3 is not 1."""
    return language_id.train(language_id.training_rows(docs.filter(remainder(F.col("doc_id"), 3) != 1)))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what is read back from the result."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], own.schema)
    done = chat.format_turns(chat.turns_of_table(own.union(extra)))
    read = done.withColumns(
        {"turns": chat.read_turns(F.col("formatted")), "learned": chat.read_loss(F.col("formatted"), F.col("loss"))}
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark that every document repeats."""
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        decontaminate.n_hit().alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("contamination.ranges") > 0).alias("contaminated"),
    )


@query
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of the documents whose crc32 modulo 5 is not 1."""
    found = lm.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) != 1)
    return found.select(
        F.col("key").alias("doc_id"),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """Documents packed into sequences of 2048, under the names the query returns."""
    found = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1)
    return found.withColumnRenamed("key", "doc_id")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packed(table(spark, sf_dir, "documents"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    path = shared_folder(spark)
    dac.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return dac.read_tokens(spark, path).select(
        F.col("key").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs.select("doc_id", "text"), language_model(docs)).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL.

    The classifier learns from the module's small table of labelled URLs.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    known = spark.createDataFrame(url_filter.small_table(), "host string, path string, block boolean")
    judged = url_filter.judge(pages, known, URL_RULES)
    return judged.select(
        "page_id",
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"),
        F.col("url_score").alias("score"),
    )


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level token ids of every document, and what they decode to."""
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = byte_bpe.encoded(docs, path, public_tokenizers.PATTERN, decoded_into="decoded")
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
