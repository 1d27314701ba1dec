"""A corpus from raw documents: filter, de-duplicate, mask secrets, mix sources, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateweave.llm.bpe import encode_documents
from stateweave.llm.mixing import Mix
from stateweave.llm.probminhash import keep_one_of_each
from stateweave.llm.quality import keep_documents
from stateweave.llm.secret_scan import corpus_forest, mask_documents
from stateweave.llm.store import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the label model reject go; null, empty and very short texts fail the rules.

    Rows that repeat are judged alike.  An empty table stays empty; extra columns are carried along, whatever their names.
    """
    return keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id.

    Rows with a null id all stay; of rows that agree in id and text one stays.  Texts without words are copies.  An empty
    table stays empty; extra columns are carried along.
    """
    return keep_one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a placeholder; every document stays, in the order of the file.

    Null and empty texts stay as they are (``n_chars`` null and 0); repeated rows are masked alike.
    """
    return mask_documents(docs, corpus_forest(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the splitting tree deals to a shard, shard by shard, shuffled inside each.

    Documents that the mix doesn't take go, as do texts without words; at most one document of a source is cut.  Null
    sources are one source.  Ties in a source's order are broken by id, size and text.  An empty table stays empty.
    """
    return Mix(docs).documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids, their digest and that of the text decoded from them, a row for each row.

    A null or empty text has no tokens.
    """
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, digests=True)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("secrets", secret_scan), ("mix", source_mix), ("tokens", tokens)]

#: The label model, near-duplicate classes and the forest can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
