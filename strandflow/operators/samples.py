"""Deterministic shuffles, splits and samples by hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import rng

from . import intervals
from .tokens import held


def shuffle(df: DataFrame, seed: str, *keys: Column) -> DataFrame:
    """df with `draw`, sorted by it: a permutation that depends on the seed and keys only."""
    return df.withColumn("draw", rng.u(seed, *keys)).orderBy("draw", *keys)


def cap(df: DataFrame, by: str, k: int, seed: str, key: str) -> DataFrame:
    """k rows of each group at most, by hash order."""
    w = Window.partitionBy(by).orderBy(rng.u(seed, F.col(key)), F.col(key))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def ratio_split(df: DataFrame, ratio: float, seed: str, key: str) -> DataFrame:
    """df with `part`: floor(n * ratio) rows of smallest draws are valid, the others train.

    Counts of draws in 4096 ranges find the range the border falls in; only its rows are ranked."""
    d = df.withColumn("_u", rng.u(seed, F.col(key))).withColumn("_b", F.shiftright("_u", 20))
    b = d.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 4096 rows
    w = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_upto", F.sum("_n").over(w))
    want = F.floor(F.max("_upto").over(Window.partitionBy(F.lit(1))) * ratio)
    b = b.withColumn("_want", want).select("_b", (F.col("_upto") <= F.col("_want")).alias("_in"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"))
    j = d.join(F.broadcast(b), "_b")
    edge = (~F.col("_in")) & (F.col("_left") > 0)
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_u", key))
    whole = j.where(~edge).withColumn("part", F.when(F.col("_in"), "valid").otherwise("train"))
    cut = j.where(edge).withColumn("_r", rank).withColumn("part", F.when(F.col("_r") <= F.col("_left"), "valid").otherwise("train")).drop("_r")
    return whole.unionByName(cut).drop("_u", "_b", "_in", "_left")


def by_chromosome(df: DataFrame, valid: tuple[str, ...], test: tuple[str, ...]) -> DataFrame:
    return df.withColumn("split", F.when(F.col("chrom").isin(*test), "test").when(F.col("chrom").isin(*valid), "valid").otherwise("train"))


def weighted_contigs(sizes: DataFrame, draws: int, seed: str) -> DataFrame:
    """(draw, chrom) of `draws` contigs chosen with probability proportional to their length."""
    total, n = sizes.agg(F.coalesce(F.sum("len"), F.lit(0)), F.count("*")).first()
    width = max(1, total // (4 * max(n, 1)))  # draws and contigs meet in bins of this length, about five a contig
    w = Window.partitionBy(F.lit(1)).orderBy("chrom").rowsBetween(Window.unboundedPreceding, 0)  # a row for each contig
    c = sizes.where("len > 0").withColumn("upto", F.sum("len").over(w)).withColumn("low", F.col("upto") - F.col("len"))
    ranges = c.select("chrom", "low", "upto", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(upto - 1) div {width}"))).alias("_bin"))
    d = sizes.sparkSession.range(draws).select(F.col("id").alias("draw"), F.floor(rng.u(seed, F.col("id").cast("string")).cast("double") / F.lit(4294967296.0) * F.lit(total)).alias("at"))
    return d.withColumn("_bin", F.expr(f"at div {width}")).join(ranges, "_bin").where("at >= low and at < upto").select("draw", "chrom")


def uniform_chunks(genome: DataFrame, per_contig: int, length: int, seed: str) -> DataFrame:
    """(chrom, try, start, chunk): per_contig hash-drawn windows of each contig long enough, cut from its tiles."""
    t = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(per_contig - 1).cast("bigint"))).alias("try")
    g = genome.where(F.col("len") >= length).select("chrom", "len", t)
    start = rng.between(F.lit(0).cast("bigint"), F.col("len") - length, seed, F.col("chrom"), F.col("try").cast("string"))
    g = g.select("chrom", "try", start.alias("start")).withColumn("end", F.col("start") + length)
    return intervals.get_fasta(g, intervals.tile(genome)).select("chrom", "try", "start", F.col("sequence").alias("chunk"))


def clean_chunks(genome: DataFrame, per_contig: int, tries: int, length: int, seed: str) -> DataFrame:
    """The first per_contig different N-free windows of each contig among `tries` draws; fewer where those run out."""
    c = uniform_chunks(genome, tries, length, seed).where(F.instr("chunk", "N") == 0)
    c = c.groupBy("chrom", "start").agg(F.min("try").alias("try"), F.first("chunk").alias("chunk"))
    return c.withColumn("_k", F.row_number().over(Window.partitionBy("chrom").orderBy("try"))).where(F.col("_k") <= per_contig).drop("_k")


def shard_of(index: Column, shards: int) -> Column:
    """Rank r takes rows r, r + shards, ..."""
    return F.pmod(index, F.lit(shards))


def block_shuffle(s: Column, key: Column, seed: str, blocks: int = 20, moved: int = 12) -> Column:
    """s in `blocks` equal blocks, of which `moved` hash-chosen ones are permuted among their own places.

    s must divide into the blocks; a remainder raises."""
    ok = F.when(F.length(s) % blocks != 0, F.raise_error(F.lit("the length must divide into the blocks")).cast("string")).otherwise(s)
    draws = F.array(*(F.struct(rng.u(seed, "pick", key, k).alias("u"), F.lit(k).alias("k")) for k in range(blocks)))
    picked = F.transform(F.slice(F.array_sort(draws), 1, moved), lambda x: x["k"])

    def order(x: Column) -> Column:
        # the places in order take the chosen blocks in the order of their draws
        source = lambda k, p: F.when(p > 0, F.element_at(x, F.greatest(p, F.lit(1)).cast("int"))).otherwise(k)
        return held(F.array_sort(x), lambda places: F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: held(F.array_position(places, k), lambda p: source(k, p))))

    whole = F.struct(ok.alias("s"), (F.length(s) / blocks).cast("int").alias("width"), held(picked, order).alias("order"))
    return held(whole, lambda x: F.array_join(F.transform(x["order"], lambda k: F.substring(x["s"], k * x["width"] + 1, x["width"])), ""))
