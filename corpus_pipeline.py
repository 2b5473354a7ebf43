"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the columns of ``documents``, except packing, which returns pieces of
sequences. Rejected documents are gone for all later stages.
"""

from __future__ import annotations

from lodestone.llm import decontaminate, langid, neardup, packing, quality
from lodestone.llm.shared import table, written

#: A text whose best language has less than this share of the evidence is rejected, as is one without letters.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark, docs, sf_dir):
    """Rejects documents whose language can't be told."""
    return langid.accepted(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def quality_classifier(spark, docs, sf_dir):
    """Rejects documents that are not likely of the top grade."""
    return quality.selected(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates (five words, 0.8)."""
    return neardup.deduplicated(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Rejects documents with a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """Pieces of sequences of at most 2048 ids."""
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: No SQL: language ID, the classifier and the packing are models and programs; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
