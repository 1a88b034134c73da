"""Readers of genomic text formats as DataFrames. All coordinates become 0-based and half-open.

FASTA and VCF are split by Spark's text reader, so large files are read in parallel wherever their compression allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVAL = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, description, seq): one row a record, any line width, either line end; `.gz` is decompressed by its suffix.

    Text before the first `>` and records without a header are left out; an empty sequence is an empty string."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head = F.split_part(text, F.lit("\n"), F.lit(1))
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.substring(text, F.instr(text, "\n") + 1, F.length(text)), r"\s+", "")).otherwise("")
    first = F.col("_first")
    rows = raw.select(head.alias("description"), body.alias("seq"), F.startswith("value", F.lit(";")).alias("_first"))
    return rows.where((F.trim("description") != "") & ~first).select(F.split_part("description", F.lit(" "), F.lit(1)).alias("id"), "description", "seq")


def fasta_two_line(spark: SparkSession, path: str) -> DataFrame:
    """(row, header, seq) of a strict header-line, sequence-line file up to its first blank line; row is the record's place.

    The format has meaning only in file order, so one task reads one file."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("l"))
    cut = F.when(F.array_position("l", "") > 0, F.slice("l", 1, (F.array_position("l", "") - 1).cast("int"))).otherwise(F.col("l"))
    n = F.floor(F.size("l") / 2).cast("int")
    pairs = lines.select(cut.alias("l")).where(F.size("l") >= 2).select(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("l", i * 2).alias("h"), F.get("l", i * 2 + 1).alias("s"))).alias("p"))
    return pairs.select(F.posexplode("p").alias("row", "p")).select("row", F.regexp_replace("p.h", "^>", "").alias("header"), F.col("p.s").alias("seq"))


def raw_fasta_text(spark: SparkSession, path: str, lines: int) -> str:
    """The sequence lines among the first `lines` lines of a file, joined: a bounded preview, so it comes to the driver."""
    rows = spark.read.text(path).limit(lines).collect()
    return "".join(r[0].strip() for r in rows if not r[0].startswith(">"))


def _columns(spark: SparkSession, path, comment: str = "#") -> DataFrame:
    rows = spark.read.text(path).where(~F.startswith("value", F.lit(comment)) & (F.trim("value") != ""))
    return rows.select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("c"))


def bed(spark: SparkSession, path, header: bool = False) -> DataFrame:
    """(chrom, start, end, name, strand, summit): blank lines, comments and rows of under three fields are skipped.

    summit is the tenth column where it is a number, else null; rows whose bounds are no numbers are skipped, headers so too."""
    c = _columns(spark, path).where(F.size("c") >= 3)
    number = lambda k: F.expr(f"try_cast(get(c, {k}) as bigint)")
    out = c.select(F.get("c", F.lit(0)).alias("chrom"), number(1).alias("start"), number(2).alias("end"), F.get("c", F.lit(3)).alias("name"), F.get("c", F.lit(5)).alias("strand"), number(9).alias("summit"))
    return out.where("start is not null and end is not null")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row of a dataset's JSON metadata (statistics.json: num_targets, seq_length, pool_width, crop_bp, target_length, <split>_seqs), its keys as columns."""
    return spark.read.option("multiLine", True).json(path)


def split_bed(spark: SparkSession, path) -> DataFrame:
    """(chrom, start, end, subset)"""
    return bed(spark, path).withColumnRenamed("name", "subset").select("chrom", "start", "end", "subset")


def gtf(spark: SparkSession, path) -> DataFrame:
    """(chrom, source, feature, start, end, score, strand, frame, attributes); start becomes 0-based."""
    c = _columns(spark, path).where(F.size("c") >= 9)
    g = lambda k: F.get("c", F.lit(k))
    return c.select(g(0).alias("chrom"), g(1).alias("source"), g(2).alias("feature"), (F.expr("try_cast(get(c, 3) as bigint)") - 1).alias("start"), F.expr("try_cast(get(c, 4) as bigint)").alias("end"), g(5).alias("score"), g(6).alias("strand"), g(7).alias("frame"), g(8).alias("attributes"))


def vcf(spark: SparkSession, path, samples: list[str] | None = None, region: tuple[str, int, int] | None = None) -> DataFrame:
    """(chrom, pos, id, ref, alts, info, gts): pos as in the file (1-based); info a map, flags with the value `true`.

    gts has (sample, a1, a2, phased) for the asked samples (all if None), missing alleles -1; region keeps variants whose base
    lies in the 0-based half-open interval. Sample names come from the #CHROM line; files read together must share it."""
    head = spark.read.text(path).where(F.startswith("value", F.lit("#CHROM"))).limit(1).collect()
    names = head[0][0].rstrip("\r").split("\t")[9:] if head else []
    wanted = names if samples is None else samples
    if unknown := [x for x in wanted if x not in names]:
        raise ValueError(f"no such samples: {unknown}")
    c = _columns(spark, path).where(F.size("c") >= 8)
    g = lambda k: F.get("c", F.lit(k))
    pairs = F.transform(F.filter(F.split(g(7), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.when(F.instr(x, "=") > 0, F.regexp_extract(x, "^[^=]*=(.*)$", 1)).otherwise("true").alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    last = F.filter(pairs, lambda p, i: F.array_position(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), p["k"]) == 0)

    def call(name: str):
        text = F.split_part(g(9 + names.index(name)), F.lit(":"), F.lit(1))
        one = lambda k: F.coalesce(F.regexp_extract(text, r"^([0-9.]+)[/|]?([0-9.]*)$", k).try_cast("int"), F.lit(-1))
        return F.struct(F.lit(name).alias("sample"), one(1).alias("a1"), one(2).alias("a2"), F.contains(text, F.lit("|")).alias("phased"))

    gts = F.array(*map(call, wanted)) if wanted else F.array().cast("array<struct<sample:string,a1:int,a2:int,phased:boolean>>")
    out = c.select(g(0).alias("chrom"), g(1).cast("bigint").alias("pos"), g(2).alias("id"), g(3).alias("ref"), F.split(g(4), ",").alias("alts"), F.map_from_entries(last).alias("info"), gts.alias("gts"))
    if region:
        chrom, start, end = region
        out = out.where((F.col("chrom") == chrom) & (F.col("pos") > start) & (F.col("pos") <= end))
    return out


def wide_csv(spark: SparkSession, path, kind: str = "tinyint") -> DataFrame:
    """(seq, targets) of a headerless file whose first column is a sequence and whose others are numbers, without a wide schema."""
    c = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.regexp_replace("value", "\r$", ""), ",").alias("c"))
    return c.select(F.get("c", F.lit(0)).alias("seq"), F.transform(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda x: F.trim(x).cast("double").cast(kind)).alias("targets"))


def csv_union(spark: SparkSession, paths: str | list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of files, lists of files or folders with a header; missing required columns raise before anything is read."""
    df = spark.read.option("header", True).csv(paths)
    require(df, required)
    return df


def require(df: DataFrame, columns: tuple[str, ...]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def contig_breaks(spark: SparkSession, path) -> DataFrame:
    """(name, start, end) of a CSV with a column of literal pair lists; an empty list gives no row."""
    df = spark.read.option("header", True).option("quote", '"').csv(path)
    lists = F.from_json(F.translate("intervals", "()", "[]"), "array<array<bigint>>")
    return df.select("name", F.explode(lists).alias("p")).select("name", F.get("p", F.lit(0)).alias("start"), F.get("p", F.lit(1)).alias("end"))


def mapping(spark: SparkSession, path) -> DataFrame:
    """(sig, cls) of lines `key;value`, split at the last semicolon."""
    m = spark.read.text(path).where(F.contains("value", F.lit(";")))
    return m.select(F.regexp_extract("value", "^(.*);([^;]*)$", 1).alias("sig"), F.regexp_extract("value", "^(.*);([^;]*)$", 2).alias("cls"))


def line_set(spark: SparkSession, path, name: str = "value") -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "").distinct()


def aligner_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(row, hits) of `SQ ... / EM ... //` blocks in file order: the EM line's fields, or null where the block has none."""
    text = spark.read.text(path, wholetext=True).select(F.filter(F.split(F.regexp_replace("value", "\r", ""), "//\n?"), lambda b: F.contains(b, F.lit("SQ"))).alias("b"))
    rows = text.select(F.posexplode("b").alias("row", "block"))
    return rows.select("row", F.nullif(F.trim(F.regexp_extract("block", r"(?m)^EM\s+(.*)$", 1)), F.lit("")).alias("hits"))


def species_files(spark: SparkSession, metadata: DataFrame, folder: str, reader=fasta) -> DataFrame:
    """Records of all species of metadata (name, file): basenames of their urls under folder, with the species' name."""
    files = metadata.select(F.regexp_replace("name", "/$", "").alias("species"), F.substring_index("file", "/", -1).alias("_base"))
    paths = [f"{folder}/{r[0]}" for r in files.select("_base").distinct().collect()]  # one row a species
    base = F.substring_index(F.input_file_name(), "/", -1)
    return reader(spark, paths).withColumn("_base", base).join(F.broadcast(files), "_base").drop("_base")


def numeric_suffix(path_column: str):
    """Sort key of names such as part-12.tfr."""
    return F.regexp_extract(path_column, r"([0-9]+)(\.[A-Za-z]+)*$", 1).try_cast("bigint")


def zip_rows(a: DataFrame, b: DataFrame, row: str = "row") -> DataFrame:
    """Rows of a and b paired by their row number; different counts raise."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} and {m} rows")
    return a.join(b, row)
