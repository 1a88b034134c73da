"""VCF files in BGZF blocks with a tabix index, read by region and sample: only the blocks that a region's chunks touch are fetched and decompressed, and only the
asked samples' columns are decoded.

Conditions on chrom and pos reach the source (`spark.sql.python.filterPushdown.enabled`); `region` is the same as options. Without either, the whole file is split by
compressed bytes at block borders. Genotypes are arrays built in the source, so thousands of samples are not thousands of expressions in a plan.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import files

CHUNK = 1 << 24  # compressed bytes of a task
_LARGEST_BLOCK = 1 << 16
_GT = pa.list_(pa.struct([("sample", pa.string()), ("a1", pa.int32()), ("a2", pa.int32()), ("phased", pa.bool_())]))
_SCHEMA = pa.schema([("chrom", pa.string()), ("pos", pa.int64()), ("id", pa.string()), ("ref", pa.string()), ("alts", pa.list_(pa.string())), ("info", pa.map_(pa.string(), pa.string())), ("gts", _GT)])


def blocks(raw: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(place in raw, compressed size, content) of the whole BGZF blocks in raw from `at` on."""
    while at + 18 <= len(raw):
        if raw[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no BGZF block at byte {at}")
        extra = struct.unpack_from("<H", raw, at + 10)[0]
        field, size = at + 12, 0
        while field < at + 12 + extra:
            tag, n = raw[field : field + 2], struct.unpack_from("<H", raw, field + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", raw, field + 4)[0] + 1
            field += 4 + n
        if not size or at + size > len(raw):
            return
        yield at, size, zlib.decompress(raw[at + 12 + extra : at + size - 8], -15)
        at += size


def is_block(raw: bytes, at: int) -> bool:
    return raw[at : at + 4] == b"\x1f\x8b\x08\x04" and raw[at + 12 : at + 14] == b"BC" and raw[at + 14 : at + 16] == b"\x02\x00"


class Tabix:
    """The index of a file: bins of chunks (pairs of virtual offsets) and the linear index of each sequence."""

    def __init__(self, raw: bytes) -> None:
        data = b"".join(x for *_, x in blocks(raw))
        if data[:4] != b"TBI\x01":
            raise ValueError("not a tabix index")
        n, *_, size = struct.unpack_from("<8i", data, 4)
        names = data[36 : 36 + size].split(b"\0")[:n]
        at, self.sequences = 36 + size, {}
        for name in names:
            bins, (number,) = {}, struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(number):
                number_of, chunks = struct.unpack_from("<Ii", data, at)
                at += 8
                bins[number_of] = [struct.unpack_from("<QQ", data, at + 16 * k) for k in range(chunks)]
                at += 16 * chunks
            (intervals,) = struct.unpack_from("<i", data, at)
            linear = struct.unpack_from(f"<{intervals}Q", data, at + 4)
            at += 4 + 8 * intervals
            self.sequences[name.decode()] = bins, linear

    def chunks(self, chrom: str, start: int, end: int) -> list[tuple[int, int]]:
        """Merged chunks that may hold records overlapping [start, end)."""
        bins, linear = self.sequences.get(chrom, ({}, ()))
        last = min(end, 1 << 29) - 1
        wanted = [0]
        for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
            wanted += range(first + (start >> shift), first + (last >> shift) + 1)
        least = linear[min(start >> 14, len(linear) - 1)] if linear else 0
        found = sorted((a, b) for k in (wanted if len(wanted) < len(bins) else [k for k in bins if k in set(wanted)]) for a, b in bins.get(k, ()) if b > least)
        out: list[tuple[int, int]] = []
        for a, b in found:
            a = max(a, least)
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out


@dataclass
class Chunk(InputPartition):
    """Lines that start from one virtual offset up to another; where `search` is set the offsets are plain bytes and blocks are looked for."""

    start: int
    end: int
    search: bool


def header(path: str) -> list[str]:
    """Sample names, from the leading blocks."""
    size, text, at = files.size_of(path), b"", 0
    while at < size:
        raw = files.read_range(path, at, at + 4 * _LARGEST_BLOCK)
        for _, n, content in blocks(raw):
            text += content
            at += n
        line = text.find(b"\n#CHROM") + 1 if not text.startswith(b"#CHROM") else 0
        if (line or text.startswith(b"#CHROM")) and text.find(b"\n", line) > 0:
            return text[line : text.find(b"\n", line)].decode().rstrip("\r").split("\t")[9:]
        if not raw:
            break
    return []


class VcfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.index = options.get("index", f"{self.path}.tbi")
        self.chrom, self.low, self.high = options.get("chrom"), int(options.get("start", 0)), int(options.get("end", 1 << 40))  # 0-based, half-open, of pos - 1
        names = header(self.path)
        self.samples = names if options.get("samples") is None else [x for x in options["samples"].split(",") if x]
        if unknown := [x for x in self.samples if x not in names]:
            raise ValueError(f"no such samples: {unknown}")
        self.columns = [9 + names.index(x) for x in self.samples]
        self.empty = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on chrom and pos; they are exact here, so Spark need not repeat them."""
        for f in filters:
            name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if isinstance(f, EqualTo) and name == ("chrom",):
                self.empty |= self.chrom not in (None, value)
                self.chrom = value
            elif name == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, value if isinstance(f, GreaterThan) else value - 1)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, value - 1 if isinstance(f, LessThan) else value)
            else:
                yield f

    def partitions(self) -> list[Chunk]:
        if self.empty or self.low >= self.high:
            return []
        if self.chrom is not None and files.exists(self.index):
            return [Chunk(a, b, False) for a, b in self._cut(Tabix(files.read_all(self.index)).chunks(self.chrom, max(self.low, 0), self.high))]
        size = files.size_of(self.path)
        return [Chunk(a, min(a + self.chunk, size), True) for a in range(0, size, self.chunk)]

    def _cut(self, chunks: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Long chunks in parts at the first line of a block; block places come from the blocks' own sizes."""
        for a, b in chunks:
            if (b >> 16) - (a >> 16) <= self.chunk:
                yield a, b
                continue
            at, begin = a >> 16, a
            while at < b >> 16:
                head = files.read_range(self.path, at, at + 18)
                at += struct.unpack_from("<H", head, 16)[0] + 1
                if at - (begin >> 16) >= self.chunk and at < b >> 16:
                    yield begin, at << 16
                    begin = at << 16
            yield begin, b

    def read(self, part: Chunk | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partitions
            return
        rows = []
        for line in self._lines(part):
            row = self._row(line)
            if row:
                rows.append(row)
                if len(rows) == 1024:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    def _content(self, at: int) -> Iterator[tuple[int, int, bytes]]:
        """(place, compressed size, content) of the file's blocks from `at` on, fetched a megabyte at a time."""
        size = files.size_of(self.path)
        while at < size:
            raw = files.read_range(self.path, at, at + (1 << 20))
            seen = at
            for place, n, content in blocks(raw):
                yield at + place, n, content
                seen = at + place + n
            if seen == at:
                return
            at = seen

    def _lines(self, part: Chunk) -> Iterator[bytes]:
        """Whole lines that start in the part. A part that starts within a line leaves it to the part before, unless an index says that a line starts there."""
        at, inside, end, within = part.start >> 16, part.start & 0xFFFF, part.end >> 16, part.end & 0xFFFF
        known = not part.search and inside > 0
        if part.search:
            at, inside, end, within = part.start, 0, part.end, 0
            raw = files.read_range(self.path, at, at + 2 * _LARGEST_BLOCK)
            skip = next((k for k in range(len(raw) - 17) if is_block(raw, k)), None)
            if skip is None or at + skip >= end:
                return
            at += skip
        if at and not known:
            known = self._line_starts(at)
        left, first = b"", not (known or at == 0)
        for place, _, content in self._content(at):
            past = place > end or place == end and within == 0
            if past and not left and not first:
                return
            if place == at:
                content = content[inside:]
            stop = within - (inside if place == at else 0) if place == end and within else None
            pieces = content.split(b"\n")
            offset = 0
            for k, piece in enumerate(pieces):
                whole = k < len(pieces) - 1
                fresh = k > 0
                if fresh and (past or stop is not None and offset >= stop):
                    return  # this line starts after the part
                if whole:
                    if first:
                        first = False
                    else:
                        yield left + piece
                    left = b""
                else:
                    left += piece
                offset += len(piece) + 1
            if past and not left:
                return
        if left and not first:
            yield left

    def _line_starts(self, at: int) -> bool:
        """Whether the block at byte `at` starts with a line: the block before it ends with a line's end."""
        back = max(0, at - 2 * _LARGEST_BLOCK)
        raw = files.read_range(self.path, back, at)
        for k in (k for k in range(len(raw) - 18, -1, -1) if is_block(raw, k)):
            size = struct.unpack_from("<H", raw, k + 16)[0] + 1
            if k + size == len(raw):
                content = next(blocks(raw, k))[2]
                return content.endswith(b"\n") if content else False
        return False

    def _row(self, line: bytes) -> dict | None:
        if not line or line.startswith(b"#"):
            return None
        head = line.split(b"\t", 2)
        chrom, pos = head[0].decode(), int(head[1])
        if self.chrom is not None and chrom != self.chrom or not self.low < pos <= self.high:
            return None
        f = line.decode().rstrip("\r").split("\t")
        info = {}
        for x in f[7].split(";"):
            if x not in ("", "."):
                k, eq, v = x.partition("=")
                info[k] = v if eq else "true"
        gts = []
        for name, c in zip(self.samples, self.columns, strict=True):
            call = f[c].split(":", 1)[0] if c < len(f) else ""
            a, _, b = call.replace("|", "/").partition("/")
            gts.append({"sample": name, "a1": int(a) if a.isdigit() else -1, "a2": int(b) if b.isdigit() else -1, "phased": "|" in call})
        return {"chrom": chrom, "pos": pos, "id": f[2], "ref": f[3], "alts": f[4].split(","), "info": list(info.items()), "gts": gts}


class IndexedVcf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf_indexed"

    def schema(self) -> str:
        return "chrom string, pos long, id string, ref string, alts array<string>, info map<string,string>, gts array<struct<sample:string,a1:int,a2:int,phased:boolean>>"

    def reader(self, schema) -> DataSourceReader:
        return VcfReader(self.options)


def vcf(spark: SparkSession, path: str, samples: list[str] | None = None, region: tuple[str, int, int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(chrom, pos, id, ref, alts, info, gts) of a BGZF file, as `readers.vcf` gives them; region is 0-based and half-open and holds a variant's base."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedVcf)
    reader = spark.read.format("vcf_indexed").option("path", path).option("chunk", chunk)
    if samples is not None:
        reader = reader.option("samples", ",".join(samples))
    if region:
        reader = reader.option("chrom", region[0]).option("start", region[1]).option("end", region[2])
    return reader.load()
