"""A corpus pipeline of five stages: quality, lines, near duplicates, benchmark passages, encoding."""

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Scratch, documents
from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard import near_duplicate_filter
from tessera.llm.line_dedup import line_filter
from tessera.llm.quality import quality_filter
from tessera.llm.sentencepiece_codec import encode_stage

#: (name, function of the session, the documents and the folder of the other tables); all but the last keep the columns
STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_filter),
    ("ngram_jaccard_join", near_duplicate_filter),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece_encoding", encode_stage),
]

#: no stage but the decontamination could be put into SQL; a test holds the rows of run() against the stages by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet and read again for the next one; then what it read is deleted."""
    scratch, docs, last = Scratch(spark, "pipeline"), documents(spark, sf_dir), None
    for name, stage in STAGES:
        made = len(Scratch.made)
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        Scratch.release(made)
        if last:
            scratch.drop(last)
        last = name
    return docs
