"""The queries of this package: name -> function of (spark, folder), and SQL texts where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    archives, contamination, jaccard, language_model, middles, mixing, quality_net, repeats, risk_rules, sharding, spellings, token_codes, toxicity)
from tidemark.session import stored
from tidemark.tables import Tables


LEVELS = ("domain", "lang", "source")
# the stated mixture: English counts as much as the other languages together, domains and sources weigh the same
MIXTURE = {"lang": {"en": 3.0, "fr": 1.0, "de": 1.0, "es": 1.0}}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, path: str) -> DataFrame:
    """All documents, mixed to as many tokens as there are, by domain, language and source, in up to four epochs."""
    docs = Tables(spark, path).documents.withColumn("domain", mixing.domain_of("source"))
    return mixing.mix(docs, LEVELS, share=1.0, weights=MIXTURE).drop("text_hash")


def op2_quality_net(spark: SparkSession, path: str) -> DataFrame:
    """All documents scored by a byte-level convolutional network."""
    t = Tables(spark, path)
    return quality_net.classify(t.documents, t.labels)


def op3_archives(spark: SparkSession, path: str) -> DataFrame:
    """Pages through ARC and WARC files; equal payloads are revisits of the largest page."""
    read = stored(archives.convert(Tables(spark, path).pages, payloads=False), "records")  # the archives are read once for both sides of the join
    records = archives.resolved(read)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date")


def op4_repeats(spark: SparkSession, path: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that occur twice."""
    return repeats.report(Tables(spark, path).documents)


def op5_sharding(spark: SparkSession, path: str) -> DataFrame:
    """All documents, uniformly shuffled into 24 shards of sizes that differ by one row at most."""
    return sharding.document_shards(Tables(spark, path).documents)


def op6_contamination(spark: SparkSession, path: str) -> DataFrame:
    """All documents searched for the benchmark's windows of ten words."""
    t = Tables(spark, path)
    return contamination.report(t.documents, t.benchmark)


def op7_language_model(spark: SparkSession, path: str) -> DataFrame:
    """All documents scored by a hierarchical Pitman-Yor model of the training documents."""
    return language_model.score_documents(Tables(spark, path).documents)


def op8_jaccard(spark: SparkSession, path: str) -> DataFrame:
    """All documents with the component of near duplicates they are in."""
    return jaccard.near_duplicates(Tables(spark, path).documents)


def op9_risk_rules(spark: SparkSession, path: str) -> DataFrame:
    """All documents judged by base rules and by rules whose cutoffs are guaranteed per language."""
    t = Tables(spark, path)
    return risk_rules.apply_rules(t.documents, t.labels)


def op10_token_codes(spark: SparkSession, path: str) -> DataFrame:
    """All documents as token ids in directly addressable codes, read back from the files."""
    return token_codes.write_and_read(Tables(spark, path).documents, tokenizer_file())


def op11_spellings(spark: SparkSession, path: str) -> DataFrame:
    """Words of all documents with the more frequent spelling that each is a variant of."""
    return spellings.variants(Tables(spark, path).documents)


def op12_toxicity(spark: SparkSession, path: str) -> DataFrame:
    """All documents scored by a convolutional network over words, with thresholds by language."""
    t = Tables(spark, path)
    return toxicity.classify(t.documents, t.labels)


def op13_middles(spark: SparkSession, path: str) -> DataFrame:
    """All documents cut for filling in the middle, and rebuilt."""
    return middles.report(Tables(spark, path).documents)


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_quality_net, op3_archives, op4_repeats, op5_sharding, op6_contamination, op7_language_model, op8_jaccard, op9_risk_rules, op10_token_codes,
    op11_spellings, op12_toxicity, op13_middles)}
ORACLE_SQL: dict[str, str] = {"op13_middles": middles.REPORT_SQL}
