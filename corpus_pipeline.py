"""The corpus pipeline: documents -> a decontaminated, deduplicated mix.

STAGES are (name, function(spark, docs, sf_dir) -> DataFrame). All but the last return the columns of documents. Each stage is
written as Parquet and reread as the next one's docs: by run() under spark.checkpoint.dir, by a driver wherever it likes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontam, mixing, simhash, substring, toxicity
from eventloom.llm.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts toxic go. It learns from all labelled folds but the held-out one."""
    return toxicity.classify(docs, _table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document of smallest doc_id stays."""
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that a smaller document has are cut; texts that lose none stay as they are. n_chars follows."""
    found = substring.dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[{"text": text, "n_chars": n_chars}.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark phrases are a twentieth or more go."""
    return decontam.contamination(docs, _table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken; sources weigh 1, 2, 3, repeating, by code point."""
    return mixing.mix(docs, F.array("source"), lambda names: [k % 3 + 1 for k in range(len(names))]).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: A trained classifier decides the first stage, so SQL cannot express the rows. The SimHash stage is tested against all pairs
#: by brute force; of the others, the operators are tested against brute force and the stages against the operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
