"""Corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input."""
from pyspark.sql import functions as F

from tideline.llm import decontamination, mixing, neardup, quality, secretscan
from tideline.llm.common import read_table, stored


def quality_classifier(spark, docs, sf_dir):
    """Documents that the co-trained classifier keeps. The model is fitted on labelled rows among these documents."""
    models = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, models).where("verdict = 'keep'").select(docs.columns)


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near duplicates: the one with the smallest doc_id."""
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents of which fewer than one word in twenty stands in a benchmark passage."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark, docs, sf_dir):
    """All documents, with secrets in their texts replaced by a mark."""
    return secretscan.redact(docs, secretscan.fit(docs))


def source_mix(spark, docs, sf_dir):
    """Documents that the mix takes, with how many of their words it takes (repeats counted)."""
    return mixing.mix(docs, F.array("source")).where("taken > 0")


STAGES = [("quality", quality_classifier), ("near_dedup", near_dedup), ("decontamination", benchmark_decontamination), ("secrets", secret_scans),
          ("mixing", source_mix)]

#: Signatures, fitted models and seeded hashes have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over ``documents``; every stage before it is stored in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
