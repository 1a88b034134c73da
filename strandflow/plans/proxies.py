"""Genomic views over the driver's tables, which hold no DNA: each defined once in Spark and once in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CODES = "ACGTACGTACGTACGTNCGTACGTAN" * 2
CHROM_SIZE = 150_000
SLICE = 512  # documents translated at once


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a file of one row group is read by one task, and what follows is dear."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def genome(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, seq, len)"""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), bases("text").alias("seq")).withColumn("len", F.length("seq").cast("bigint"))


def genome_written(spark: SparkSession, d: str) -> DataFrame:
    """genome() as a table in the shared folder, for queries that read it more than once: letters are translated once, and lengths are read without bases."""
    from strandflow.functions import stages

    return stages.written(genome(spark, d), "genome")


_CODE = bytes.maketrans(LETTERS.encode(), CODES.encode())
_OTHER = bytes(set(range(256)) - set(LETTERS.encode()))


@F.pandas_udf(StringType())
def bases(texts: pd.Series) -> pd.Series:
    """The letters of each text as bases, all else left out."""
    return pd.Series([None if t is None else t.encode().translate(_CODE, _OTHER).decode("ascii") for t in texts], dtype=object)


def tiles(spark: SparkSession, d: str, width: int = 256) -> DataFrame:
    """(chrom, tile_idx, seq, len): the genome cut into tiles, its letters translated in the same Arrow pass"""
    from strandflow.operators import intervals

    def translated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                seqs = [t.as_buffer().to_pybytes().translate(_CODE, _OTHER) if t.is_valid else b"" for t in b.column(1)]
                has = pa.array([len(s) > 0 for s in seqs])
                given = [s for s in seqs if s]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(has), pa.array([len(s) for s in given], pa.int64()), pa.array(given, pa.binary()).cast(pa.string())], names=["chrom", "len", "seq"])

    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), "text")
    return docs.mapInArrow(lambda batches: intervals.cut(translated(batches), width), "chrom string, tile_idx long, seq string, len long")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, len) of the 24 chromosomes that peaks lie on, and one that has none"""
    return spark.range(1, 26).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), (F.lit(CHROM_SIZE) + F.col("id") * 1000).alias("len"))


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, start, end, name, strand)"""
    return table(spark, d, "lineitem").select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 24 + 1).cast("string")).alias("chrom"), (F.col("l_partkey") % 2000 * 50).alias("start"), (F.col("l_partkey") % 2000 * 50 + (F.col("l_quantity") * 4).cast("bigint")).alias("end"), F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"))


def promoters(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, start, end, name, strand)"""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.concat(F.lit("chr"), (k % 24 + 1).cast("string")).alias("chrom"), (k * 61 % 90000).alias("start"), (k * 61 % 90000 + 200).alias("end"), F.concat(F.lit("g"), k.cast("string")).alias("name"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


def variants(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, pos, ref, alt, id, sig, status); pos is 1-based"""
    e, u = F.col("event_id"), F.col("user_id")
    base = lambda n: F.substring(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))
    return table(spark, d, "events").select(F.concat(F.lit("chr"), (u % 24 + 1).cast("string")).alias("chrom"), (e * 37 % 90000 + 1).alias("pos"), F.when(e % 17 == 0, F.concat(base(u), base(u + 1))).otherwise(base(u)).alias("ref"), base(u + 1 + e % 3).alias("alt"), e.alias("id"), F.col("event_type").alias("sig"), F.when(e % 5 == 0, "no_assertion_criteria_provided").when(e % 5 == 1, "criteria_provided|single_submitter").when(e % 7 == 0, None).otherwise("reviewed_by_expert_panel").alias("status"))


def signal(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, start, end, value): runs of 25 on each chromosome"""
    e = F.col("event_id")
    return table(spark, d, "events").select(F.concat(F.lit("chr"), (e % 24 + 1).cast("string")).alias("chrom"), (F.floor(e / 24) * 25).alias("start"), (F.floor(e / 24) * 25 + 25).alias("end"), F.col("value").cast("double").alias("value"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(id, y, s, grp): a label and a score with ties"""
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars", "lang"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"), (F.col("n_chars") % 97).cast("double").alias("s"), F.col("lang").alias("grp"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(grp, x, y): two numbers of each row of a channel"""
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("y"))


SQL = {
    "genome": f"genome AS (SELECT 'd' || doc_id AS chrom, seq, length(seq)::BIGINT AS len FROM (SELECT doc_id, regexp_replace(translate(text, '{LETTERS}', '{CODES}'), '[^ACGTN]', '', 'g') AS seq FROM documents))",
    "tiles": "tiles AS (SELECT chrom, i AS tile_idx, substr(seq, 256 * i + 1, 256) AS seq, len FROM (SELECT *, unnest(range(0, (len + 255) // 256)) AS i FROM genome WHERE len > 0))",
    "sizes": f"sizes AS (SELECT 'chr' || i AS chrom, ({CHROM_SIZE} + i * 1000)::BIGINT AS len FROM range(1, 26) t(i))",
    "peaks": "peaks AS (SELECT 'chr' || (l_suppkey % 24 + 1) AS chrom, l_partkey % 2000 * 50 AS \"start\", l_partkey % 2000 * 50 + (l_quantity * 4)::BIGINT AS \"end\", l_orderkey || '_' || l_linenumber AS name, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem)",
    "promoters": "promoters AS (SELECT 'chr' || (p_partkey % 24 + 1) AS chrom, p_partkey * 61 % 90000 AS \"start\", p_partkey * 61 % 90000 + 200 AS \"end\", 'g' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)",
    "variants": "variants AS (SELECT 'chr' || (user_id % 24 + 1) AS chrom, event_id * 37 % 90000 + 1 AS pos, CASE WHEN event_id % 17 = 0 THEN substr('ACGT', user_id % 4 + 1, 1) || substr('ACGT', (user_id + 1) % 4 + 1, 1) ELSE substr('ACGT', user_id % 4 + 1, 1) END AS ref, substr('ACGT', (user_id + 1 + event_id % 3) % 4 + 1, 1) AS alt, event_id AS id, event_type AS sig, CASE WHEN event_id % 5 = 0 THEN 'no_assertion_criteria_provided' WHEN event_id % 5 = 1 THEN 'criteria_provided|single_submitter' WHEN event_id % 7 = 0 THEN NULL ELSE 'reviewed_by_expert_panel' END AS status FROM events)",
    "signal": "signal AS (SELECT 'chr' || (event_id % 24 + 1) AS chrom, event_id // 24 * 25 AS \"start\", event_id // 24 * 25 + 25 AS \"end\", value::DOUBLE AS value FROM events)",
    "scores": "scores AS (SELECT doc_id AS id, quality::INT AS y, (n_chars % 97)::DOUBLE AS s, lang AS grp FROM documents JOIN labels USING (doc_id))",
    "pairs": "pairs AS (SELECT l_suppkey % 50 AS grp, l_quantity AS x, l_extendedprice * (1.0::DOUBLE - l_discount) AS y FROM lineitem)",
}
_NEEDS = {"tiles": ("genome",)}


def with_views(names: str, body: str) -> str:
    """SQL with the named views before it; body may start with further `x AS (...),` definitions ended by a SELECT."""
    want: list[str] = []
    for n in names.split():
        for x in (*_NEEDS.get(n, ()), n):
            if x not in want:
                want.append(x)
    body = body.strip()
    views = ", ".join(SQL[n] for n in want)
    if body.upper().startswith("SELECT"):
        return f"WITH {views} {body}" if views else body
    return f"WITH RECURSIVE {views}, {body}" if views else f"WITH RECURSIVE {body}"


def hash_sql(*keys: str) -> str:
    """The SQL of rng.u(keys)."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::BIGINT"
