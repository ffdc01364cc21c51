"""From raw documents to token ids: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read again as the next stage's input.
Only the language and quality decisions use a fitted model; each is fitted on what the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisgraph.llm import decontaminate, langid, near, quality, wfst
from trellisgraph.llm.common import materialize, release, table, wrapped

#: Documents whose best language is less probable than this are rejected, as are those without letters.
LEAST_LANGUAGE_SCORE = 0.3

#: The models cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is determined; null, empty and letterless texts go."""
    found = langid.identify(wrapped(docs, "text"), langid.fit(docs), ["doc"])
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("doc.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the rule ensemble predicts to be good; without labels, all."""
    measured = materialize(quality.with_statistics(wrapped(docs, "doc_id", "text"), ["doc", "doc_id"]), "pipeline-quality")
    model = quality.fit(measured, table(spark, sf_dir, "labels"))
    return measured.where(model.score() >= quality.THRESHOLD).select("doc.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return near.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents into which no benchmark item leaks."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids and their number of every document, and the text that they decode to.

    Null and empty texts have no ids; repeated rows each have theirs; other columns are dropped.
    """
    return wfst.encode(docs, ["doc_id", "lang", "source"]).withColumnRenamed("decoded", "text")


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", distinct),
    ("decontamination", decontaminated),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over everything that its predecessor kept; nulls, ties and repeated rows as the stages define them.

    A stage's table is deleted once the next one's is written; the last stage reads the one that stays.
    """
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
