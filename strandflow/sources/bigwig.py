"""bigWig files: the chromosome tree and the block tree plan the read, so a range touches the blocks that overlap it only and a whole file is many tasks.

Rows are runs (chrom, start, end, value), 0-based and half-open, as a run-length table has them. Conditions on chrom, start and end reach the source
(`spark.sql.python.filterPushdown.enabled`); Spark repeats those on start and end, which choose blocks here.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import files

CHUNK = 1 << 22  # bytes of blocks a task
# fixed values: the format's marks of a file, its chromosome tree and its block tree
MAGIC, CHROMS, BLOCKS = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
_SCHEMA = pa.schema([("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.float32())])


class File:
    """The trees of a file; numbers are in the byte order that its first word tells."""

    def __init__(self, path: str) -> None:
        self.path = path
        head = files.read_range(path, 0, 64)
        self.order = next((o for o in "<>" if len(head) == 64 and struct.unpack(o + "I", head[:4])[0] == MAGIC), "")
        if not self.order:
            raise ValueError(f"{path} is not a bigWig file")
        _, _, chroms, _, self.index, _, _, _, _, size, _ = struct.unpack(self.order + "HHQQQHHQQIQ", head[4:])
        self.packed = size > 0
        self.chroms = dict(self._chroms(chroms))
        self.names = {number: name for name, (number, _) in self.chroms.items()}

    def _read(self, kind: str, at: int) -> tuple:
        kind = self.order + kind
        return struct.unpack(kind, files.read_range(self.path, at, at + struct.calcsize(kind)))

    def _chroms(self, at: int) -> Iterator[tuple[str, tuple[int, int]]]:
        magic, _, key, value, _, _ = self._read("IIIIQQ", at)
        if magic != CHROMS or value != 8:
            raise ValueError("no chromosome tree")
        nodes = [at + 32]
        while nodes:
            at = nodes.pop()
            leaf, _, n = self._read("BBH", at)
            raw = files.read_range(self.path, at + 4, at + 4 + n * (key + 8))
            for k in range(0, len(raw), key + 8):
                if leaf:
                    yield raw[k : k + key].rstrip(b"\0").decode(), struct.unpack_from(self.order + "II", raw, k + key)
                else:
                    nodes.append(struct.unpack_from(self.order + "Q", raw, k + key)[0])

    def blocks(self, chrom: int | None, start: int, end: int) -> list[tuple[int, int]]:
        """(place, size) of the blocks that may hold runs of [start, end) of a chromosome, or of any."""
        if self._read("I", self.index)[0] != BLOCKS:
            raise ValueError("no block tree")
        out, nodes = [], [self.index + 48]
        while nodes:
            at = nodes.pop()
            leaf, _, n = self._read("BBH", at)
            width = 32 if leaf else 24
            raw = files.read_range(self.path, at + 4, at + 4 + n * width)
            for k in range(0, len(raw), width):
                c0, s, c1, e, place = struct.unpack_from(self.order + "IIIIQ", raw, k)
                if chrom is None or (c0, s) < (chrom, end) and (c1, e) > (chrom, start):
                    if leaf:
                        out.append((place, struct.unpack_from(self.order + "Q", raw, k + 24)[0]))
                    else:
                        nodes.append(place)
        return sorted(out)

    def runs(self, raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(chromosome, starts, ends, values) of a block."""
        data = zlib.decompress(raw) if self.packed else raw
        chrom, first, _, step, span, kind, _, n = struct.unpack_from(self.order + "IIIIIBBH", data)
        number, real = self.order + "u4", self.order + "f4"
        if kind == 1:
            x = np.frombuffer(data, [("s", number), ("e", number), ("v", real)], n, 24)
            return chrom, x["s"].astype(np.int64), x["e"].astype(np.int64), x["v"]
        if kind == 2:
            x = np.frombuffer(data, [("s", number), ("v", real)], n, 24)
            return chrom, x["s"].astype(np.int64), x["s"].astype(np.int64) + span, x["v"]
        if kind == 3:
            at = first + step * np.arange(n, dtype=np.int64)
            return chrom, at, at + span, np.frombuffer(data, real, n, 24)
        raise ValueError(f"a block of type {kind}")


@dataclass
class Part(InputPartition):
    blocks: list[tuple[int, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.chrom, self.start, self.end = options.get("chrom"), int(options.get("start", 0)), int(options.get("end", 1 << 32))
        self.empty = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if isinstance(f, EqualTo) and name == ("chrom",):
                self.empty |= self.chrom not in (None, value)
                self.chrom = value
                continue
            if name == ("start",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(self.end, value + isinstance(f, LessThanOrEqual))
            elif name == ("end",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, value - isinstance(f, GreaterThanOrEqual))
            yield f

    def partitions(self) -> list[Part]:
        f = File(self.path)
        if self.empty or self.chrom is not None and self.chrom not in f.chroms or self.start >= self.end:
            return []
        out, size = [], self.chunk
        for place, n in f.blocks(None if self.chrom is None else f.chroms[self.chrom][0], self.start, self.end):
            if size >= self.chunk:
                out.append(Part([]))
                size = 0
            out[-1].blocks.append((place, n))
            size += n
        return out

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        f = File(self.path)
        wanted = None if self.chrom is None else f.chroms[self.chrom][0]
        for place, n in part.blocks:
            chrom, s, e, v = f.runs(files.read_range(self.path, place, place + n))
            keep = (s < self.end) & (e > self.start) if wanted in (None, chrom) else np.zeros(len(s), bool)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array([f.names[chrom]] * int(keep.sum())), pa.array(s[keep]), pa.array(e[keep]), pa.array(np.nan_to_num(v[keep].astype(np.float32), nan=0.0, posinf=np.inf, neginf=-np.inf))], schema=_SCHEMA)


class BigWig(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chrom string, start long, end long, value float"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def runs(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(chrom, start, end, value): runs of a file, or those that overlap a region; NaN is 0."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigWig)
    reader = spark.read.format("bigwig").option("path", path).option("chunk", chunk)
    if region:
        reader = reader.option("chrom", region[0]).option("start", region[1]).option("end", region[2])
    return reader.load()
