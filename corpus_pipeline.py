"""Five-stage corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes each stage's rows
as Parquet in the shared folder and rereads them. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import common, decontaminate, minhash_dedup, packing, quality, substring_dedup


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(docs, names) with all columns but doc_id and text renamed by their places, so that no name clashes with an operator's; `_named` undoes it."""
    names = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def _named(docs: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    return docs.select(*names).toDF(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality reaches the threshold; each row, repeated or not, is judged by its own text. A null id is judged too."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    plain, names = _apart(docs)
    scored = quality.score(plain, model, tuple(names), "score")
    return _named(scored.where(F.col("score") >= quality.THRESHOLD), names, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. Of rows that are equal in all columns one stays; rows that share an id but
    differ are one document to the operator and stay or go together. Rows with a null id stay, as do documents without words."""
    found = common.staged(minhash_dedup.near_duplicates(docs).where("doc_id is not null").select("doc_id", "kept"), "near-duplicates")
    again = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    dropped = found.where("not kept").select("doc_id").distinct()
    plain, names = _apart(docs)
    once = plain.join(dropped.union(again), "doc_id", "left_anti").select(*names)
    more = plain.join(again, "doc_id", "left_semi").select(*names).distinct()
    return _named(once.union(more), names, docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier document has. A document that keeps no word goes; texts that
    lose nothing stay as they are (null and empty ones too), and n_chars follows the text. Rows with a null id lose nothing; rows that share an id are
    one document, so none of them loses a passage to another."""
    plain, names = _apart(docs)
    also = tuple(c for c in names if c not in ("doc_id", "text"))
    done = substring_dedup.remove_repeats(plain, with_text=True, also=also)
    left = done.where("n_removed = 0 or n_removed < n_words").withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        own = names[docs.columns.index("n_chars")]
        left = left.withColumn(own, F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own)))
    return _named(left, names, docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark. Rows that share an id go together where one is hit; rows with a null id stay."""
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("contaminated").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents left, packed best-fit."""
    return packing.pack(packing.cut_pieces(docs, packing.default_tokenizer()))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned scores and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
