"""A corpus pipeline: each stage applies one text operator to what the previous one kept."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloudmill.llm.common import saved, table
from cloudmill.llm.jaccard_join import keep_one_of_each
from cloudmill.llm.packing import pack_documents
from cloudmill.llm.quality import classify_quality
from cloudmill.llm.secret_scan import redact_secrets
from cloudmill.llm.toxicity import classify_toxicity


def beside(docs: DataFrame, own: set[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` applied while columns of ``docs`` that are called like its ``own`` have other names."""
    aside = {}
    for column in docs.columns:
        if column.lower() in own:
            new = f"{column}_of_input"
            while new in docs.columns:
                new += "_"
            aside[column] = new
    moved = docs.withColumnsRenamed(aside)
    done = stage(moved).select(*[f"`{c}`" for c in moved.columns])
    return done.withColumnsRenamed({new: old for old, new in aside.items()})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (score under 0.5).

    Null and empty texts are scored as empty; without labels every score is 0.5 and all stay;
    repeated rows fare alike; an empty table stays empty; all columns pass as they are.
    """

    def kept(moved: DataFrame) -> DataFrame:
        return classify_quality(moved, table(spark, sf_dir, "labels")).filter("quality_kept")

    return beside(docs, {"quality_score", "quality_kept"}, kept)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity network rejects (score 0.7 or more).

    As above; without labels every score is 0 and all stay.
    """

    def kept(moved: DataFrame) -> DataFrame:
        return classify_toxicity(moved, table(spark, sf_dir, "labels")).filter("not toxic")

    return beside(docs, {"toxic_score", "toxic"}, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of similar shingle sets.

    Texts without words are in no group; rows with one id are one document, of rows without an
    id one of each text stays (see ``keep_one_of_each``); an empty table stays empty; all
    columns pass as they are.
    """
    return keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets that look live; widely copied examples stay.

    Null texts stay null; every row stays; all other columns pass as they are.
    """
    return beside(docs, {"_places", "_redact_row"}, redact_secrets)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens: a row for each piece of a document.

    A null or empty text is the single id 0; a null id stays null; an empty table gives an
    empty one; other columns are left out.
    """
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

ORACLE_SQL = None  # models and tokenizers are not SQL; tests/llm compare with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
