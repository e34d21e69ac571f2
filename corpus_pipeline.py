"""The corpus pipeline: five of the operators in a row, each over all that the one before kept.

Language ID drops texts without a recognised language, SimHash near-dedup keeps one document of
each group, decontamination drops documents that hold benchmark items, sanitisation rewrites
personal data, and the mix takes documents toward the sources' target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise.llm import decontaminate, language, mixing, neardup, pii
from stackwise.llm.common import documents, materialise, remove, scope, sheltered

#: Texts whose best label scores lower are rejected; 0.5 is a label's decision border.  For k labels
#: no score is below 1/k, so with four or fewer it is the coverage that rejects.
MIN_LANGUAGE_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; rejected: null, no letter, a score below
    ``MIN_LANGUAGE_SCORE``, or n-grams that fewer than the model's ``floor`` are known of.  Without
    a labelled row nothing is recognised.  Columns stay as they are, whatever their names; repeated
    rows are judged alike; an empty table gives no rows."""
    inner, back = sheltered(docs, "doc_id", "text", "lang")
    model = language.train(inner)
    found = language.identify(inner, model, covered=True)
    kept = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE) & (F.col("coverage") >= (model.floor if model else 0.0))
    return back(found.filter(kept))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group: shingles of five words,
    0.8 or more alike.  Of equal ids, and of null ones, the first read stays; null and empty texts
    are one group.  Columns stay as they are; an empty table gives no rows."""
    return neardup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no item of the table ``benchmark``; null and empty texts hold none.
    Columns stay as they are; repeated rows are judged alike; an empty table of either gives what is
    left of ``docs``."""
    return decontaminate.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and disclosing terms; ``n_chars`` is that of the new text.  Null texts
    stay null; repeated rows count as documents each and are rewritten alike; all other columns
    stay as they are; an empty table gives no rows."""
    inner, back = sheltered(docs, "doc_id", "text", "n_chars")
    clean = pii.sanitise(inner).withColumn("text", F.col("sanitised"))
    return back(clean.withColumn("n_chars", F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each.  Documents without words
    are never taken, null sources are one source, equal ids share a position; columns named like
    the mix's (``size``, ``source_size``, ``target``, ``taken``) are replaced; an empty table gives
    no rows."""
    return mixing.mix(docs).filter("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("pii", sanitise_personal_data),
    ("mix_sources", mix_sources),
]

#: Kernels, fingerprints and tilings are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared scratch folder,
    and what it and the stage before wrote there is removed once its result is."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with scope() as made:
            docs = materialise(stage(spark, docs, sf_dir))
        remove(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
