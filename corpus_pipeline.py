"""Corpus pipeline: from raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept. All but the last return the columns of ``docs`` as they came,
whatever other columns there are and whatever their names, but for ``text`` and
``n_chars`` where a stage changes the text.

Defined results, beside those of each stage: an empty table stays empty; rows
that repeat a doc_id are judged one by one where a rule looks at a text alone
(language, benchmark), and together where it looks at several documents (lines,
near copies); a row with a null doc_id is never a copy of another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from basalt.llm.common import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null and empty texts, texts without a letter, and texts that no
    learned language explains. Where no document is labelled, all stay. Needs doc_id, text and lang."""
    return language_id.accepted(docs, language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; the document stays, with the rest of its text, which may be empty.
    A text that loses nothing is unchanged, null included; n_chars, where there is one, follows a changed text."""
    kept = line_dedup.dedup(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return kept.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id: five words, a similarity
    of 0.8 or more. Texts without words and null doc_ids stay; all rows of a doc_id stay or go together."""
    return near_dedup.deduplicated(docs, 80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark window go; null texts stay. With an empty benchmark all stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every document that is left; a null text is an empty one."""
    import public_tokenizers as P

    rows = bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near", near), ("leaks", leaks), ("tokens", tokens)]

#: SQL cannot express the first and the last stage; tests compare all with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
