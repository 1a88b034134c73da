"""FASTA files read by byte ranges: partitions lie inside contigs, so a contig of any length is many tasks and no cell is longer than a tile.

Two data sources. `fasta_fragments` scans a plain FASTA file by byte ranges and gives what each range knows of each record; `index` turns that into the rows of a `.fai`
file (name, length, offset, bases and bytes a line). `fasta_tiles` cuts contigs into tiles by that arithmetic. Compressed files have no byte ranges: `readers.fasta` reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

CHUNK = 1 << 25  # bytes of a task
_HEADER = 1 << 20  # bytes that a header line may have beyond its range


@dataclass
class Range(InputPartition):
    start: int
    end: int


class FragmentReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))

    def partitions(self) -> list[Range]:
        size = files.size_of(self.path)
        return [Range(a, min(a + self.chunk, size)) for a in range(0, size, self.chunk)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        """A row for the record that the range starts in (no name) and one for each header that starts in it."""
        if part is None:  # an empty file
            return
        before = max(part.start - 1, 0)
        raw = files.read_range(self.path, before, part.end)
        fresh = part.start == 0 or raw[0] == 10  # the range starts a line
        data = np.frombuffer(raw, np.uint8)[part.start - before :]
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([np.zeros(int(fresh), np.int64), ends + 1])
        heads = starts[starts < len(data)]
        heads = heads[data[heads] == ord(">")]
        rows = []
        carried = 0  # where sequence of the record before goes on: past a header line that starts in an earlier range
        if part.start and not fresh:
            carried = self._past_header(part, data)
        for k, (at, to) in enumerate(zip([-1, *heads.tolist()], [*heads.tolist(), len(data)], strict=True)):
            if at < 0:
                if part.start == 0 or carried >= to:
                    continue
                name, seq = None, carried
            else:
                line_end = int(ends[np.searchsorted(ends, at)]) if len(ends) and ends[-1] >= at else len(data)
                head = data[at + 1 : line_end].tobytes() if line_end < len(data) else data[at + 1 :].tobytes() + files.read_range(self.path, part.end, part.end + _HEADER).split(b"\n")[0]
                name, seq = head.decode(errors="replace").rstrip("\r").split(" ")[0].split("\t")[0], line_end + 1
            own = data[seq:to]
            lines = np.flatnonzero(own == 10)
            gaps = np.diff(lines)
            inner = gaps[:-1] if k < len(heads) or part.end == files.size_of(self.path) else gaps  # a record's last line may be shorter
            offset = part.start + seq if at >= 0 else None
            if at >= 0 and line_end >= len(data):
                offset = part.end + len(files.read_range(self.path, part.end, part.end + _HEADER).split(b"\n")[0]) + 1
            rows.append({"at": part.start + max(at, 0), "name": name, "offset": offset, "bases": int(len(own) - len(lines) - (own == 13).sum()), "lines": len(lines), "cr": int((own == 13).sum()), "first_line": part.start + seq + int(lines[0]) if len(lines) else None, "shortest": int(inner.min()) if len(inner) else None, "longest": int(inner.max()) if len(inner) else None})
        yield pa.RecordBatch.from_pylist(rows, _FRAGMENT)

    def _past_header(self, part: Range, data: np.ndarray) -> int:
        """Where the range's first line ends if that line is a header, else 0."""
        at = part.start
        while at:
            back = max(0, at - 4096)
            raw = files.read_range(self.path, back, at)
            k = raw.rfind(b"\n")
            if k >= 0 or back == 0:
                if (raw[k + 1 : k + 2] or b"") != b">":
                    return 0
                end = np.flatnonzero(data == 10)
                return int(end[0]) + 1 if len(end) else len(data)
            at = back
            if part.start - at > _HEADER:
                return 0  # longer than any header line
        return 0


_FRAGMENT = pa.schema([("at", pa.int64()), ("name", pa.string()), ("offset", pa.int64()), ("bases", pa.int64()), ("lines", pa.int64()), ("cr", pa.int64()), ("first_line", pa.int64()), ("shortest", pa.int64()), ("longest", pa.int64())])


class FastaFragments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_fragments"

    def schema(self) -> str:
        return "at long, name string, offset long, bases long, lines long, cr long, first_line long, shortest long, longest long"

    def reader(self, schema) -> DataSourceReader:
        return FragmentReader(self.options)


@dataclass
class Tiles(InputPartition):
    chrom: str
    length: int
    offset: int
    bases: int
    width: int
    start: int
    end: int


class TileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.tile, self.chunk = options["path"], int(options.get("tile", 1024)), int(options.get("chunk", CHUNK))
        self.fai = options.get("fai", f"{self.path}.fai")
        self.only = set(options["contigs"].split(",")) if options.get("contigs") else None

    def partitions(self) -> list[Tiles]:
        step = max(self.tile, self.chunk // self.tile * self.tile)
        out = []
        for line in files.read_all(self.fai).decode().splitlines():
            name, *numbers = line.split("\t")
            length, offset, bases, width = map(int, numbers[:4])
            if self.only is None or name in self.only:
                out += [Tiles(name, length, offset, bases, width, a, min(a + step, length)) for a in range(0, length, step)]
        return out

    def read(self, p: Tiles | None) -> Iterator[pa.RecordBatch]:
        if p is None:  # no contigs
            return
        byte = lambda base: p.offset + base // p.bases * p.width + base % p.bases
        raw = files.read_range(self.path, byte(p.start), byte(p.end - 1) + 1)
        seq = raw.translate(None, b"\r\n").decode("ascii")
        ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        due = p.width - 1 - p.start % p.bases + p.width * np.arange(len(ends))
        if len(seq) != p.end - p.start or not np.array_equal(ends, due):
            raise ValueError(f"{self.path} does not have the lines that its index tells of {p.chrom}")
        pieces = [seq[k : k + self.tile] for k in range(0, len(seq), self.tile)]
        first = p.start // self.tile
        for a in range(0, len(pieces), 4096):
            own = pieces[a : a + 4096]
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([p.chrom] * n), pa.array(range(first + a, first + a + n), pa.int64()), pa.array(own), pa.array([p.length] * n, pa.int64())], names=["chrom", "tile_idx", "seq", "len"])


class FastaTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_tiles"

    def schema(self) -> str:
        return "chrom string, tile_idx long, seq string, len long"

    def reader(self, schema) -> DataSourceReader:
        return TileReader(self.options)


def index(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(name, length, offset, bases, width) of each record of a plain FASTA file, as in a `.fai` file; records whose lines differ in length raise.

    Ranges of the file are scanned apart. A range's part of the record that started before it belongs to the last header before, found by a scan over the few rows that there are."""
    from strandflow.operators import scan

    spark.dataSource.register(FastaFragments)
    rows = spark.read.format("fasta_fragments").option("path", path).option("chunk", chunk).load()
    owner = scan.prefix(rows, {"record": ("max", F.when(F.col("name").isNotNull(), F.col("at")))}, F.floor(F.col("at") / chunk), (F.col("at"),)).where("record is not null")
    r = owner.groupBy("record").agg(F.max("name").alias("name"), F.sum("bases").alias("length"), F.max("offset").alias("offset"), F.sum("lines").alias("lines"), F.sum("cr").alias("cr"), F.min(F.when(F.col("first_line") >= 0, F.col("first_line"))).alias("first"), F.min("shortest").alias("low"), F.max("longest").alias("high"))
    ending = F.when(F.col("cr") > 0, 2).otherwise(1)
    bases = F.coalesce(F.col("first") - F.col("offset") - ending + 1, F.col("length"))
    full = F.when(bases > 0, F.ceil(F.col("length") / bases)).otherwise(0)
    same = (F.coalesce(F.col("low"), bases + ending) == bases + ending) & (F.coalesce(F.col("high"), bases + ending) == bases + ending)
    regular = (same & F.col("lines").between(full - 1, full)) | (F.col("length") == 0)
    checked = F.when(regular, bases).otherwise(F.raise_error(F.concat(F.lit("lines of different lengths in record "), "name")).cast("bigint"))
    return r.select("name", "length", "offset", F.greatest(checked, F.lit(0)).alias("bases"), (F.greatest(bases, F.lit(0)) + ending).cast("bigint").alias("width"))


def write_index(spark: SparkSession, path: str, chunk: int = CHUNK) -> str:
    """Writes `path`.fai and returns its name. The index has a row a record, which a driver holds."""
    rows = index(spark, path, chunk).orderBy("offset").collect()
    store, own = files.opened(f"{path}.fai")
    with store.open_output_stream(own) as out:
        out.write("".join(f"{r.name}\t{r.length}\t{r.offset}\t{max(r.bases, 1)}\t{r.width}\n" for r in rows).encode())
    return f"{path}.fai"


def tiles(spark: SparkSession, path: str, width: int = 1024, chunk: int = CHUNK, contigs: list[str] | None = None) -> DataFrame:
    """(chrom, tile_idx, seq, len) of a plain FASTA file, a task for each `chunk` bases of a contig; the index is read, or written first where there is none."""
    if not files.exists(f"{path}.fai"):
        write_index(spark, path, chunk)
    spark.dataSource.register(FastaTiles)
    reader = spark.read.format("fasta_tiles").option("path", path).option("tile", width).option("chunk", chunk)
    return (reader.option("contigs", ",".join(contigs)) if contigs else reader).load()


def contigs(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(chrom, len) from the index."""
    if not files.exists(f"{path}.fai"):
        write_index(spark, path, chunk)
    rows = [x.split("\t") for x in files.read_all(f"{path}.fai").decode().splitlines()]
    return spark.createDataFrame([(x[0], int(x[1])) for x in rows], "chrom string, len long")
