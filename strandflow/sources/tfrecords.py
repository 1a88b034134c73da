"""TFRecord files in and out: length-framed records with masked CRC-32C sums, each a protobuf Example of named features; plain or ZLIB files.

A file is one stream, so a task reads one file; files are numbered by the number at the end of their names. A wrong sum, a cut file or a wire type that
Examples do not have raises.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import files

# fixed values: the reflected Castagnoli polynomial and the mask of record sums
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
LANES = 1024
SCHEMA = "file int, row long, features map<string,struct<bytes:array<binary>,floats:array<float>,ints:array<bigint>>>"
_FEATURE = pa.struct([("bytes", pa.list_(pa.binary())), ("floats", pa.list_(pa.float32())), ("ints", pa.list_(pa.int64()))])
_ARROW = pa.schema([("file", pa.int32()), ("row", pa.int64()), ("features", pa.map_(pa.string(), _FEATURE))])


def _bytewise() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


TABLE = _bytewise()
_STEPS = TABLE.tolist()


def _run(register: int, data: bytes) -> int:
    for x in data:
        register = _STEPS[(register ^ x) & 0xFF] ^ (register >> 8)
    return register


@lru_cache(256)
def _over_zeros(n: int) -> tuple[int, ...]:
    """What n zero bytes make of each bit of a register."""
    if n == 1:
        return tuple(_run(1 << k, b"\0") for k in range(32))
    half = _over_zeros(n // 2)
    both = tuple(_apply(half, x) for x in half)
    return tuple(_run(x, b"\0") for x in both) if n % 2 else both


def _apply(bits: tuple[int, ...], register: int) -> int:
    out, k = 0, 0
    while register:
        if register & 1:
            out ^= bits[k]
        register >>= 1
        k += 1
    return out


def crc32c(data: bytes) -> int:
    """CRC-32C. Long data run in lanes side by side, whose registers are joined by what the bytes after a lane make of it."""
    register, width = 0xFFFFFFFF, len(data) // LANES
    if width >= 8:
        lanes = np.ascontiguousarray(np.frombuffer(data, np.uint8, LANES * width).reshape(LANES, width).T)
        state = np.zeros(LANES, np.uint32)
        state[0] = register
        for column in lanes:
            state = TABLE[(state ^ column) & 0xFF] ^ (state >> 8)
        shift, register = _over_zeros(width), 0
        for x in state.tolist():
            register = _apply(shift, register) ^ x
        data = data[LANES * width :]
    return _run(register, data) ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    c = crc32c(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(size)) + data + struct.pack("<I", masked(data))


def records(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        if at + 12 > len(raw):
            raise ValueError("the file ends within a record")
        size, own = raw[at : at + 8], struct.unpack_from("<I", raw, at + 8)[0]
        if masked(size) != own:
            raise ValueError("wrong sum of a record's length")
        n = struct.unpack("<Q", size)[0]
        data = raw[at + 12 : at + 12 + n]
        if at + 16 + n > len(raw):
            raise ValueError("the file ends within a record")
        if masked(data) != struct.unpack_from("<I", raw, at + 12 + n)[0]:
            raise ValueError("wrong sum of a record")
        yield data
        at += 16 + n


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = raw[at]
        out |= (x & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if x < 0x80:
            return out, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers and byte strings, also those of fixed width."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        elif key & 7 == 2:
            n, at = _varint(raw, at)
            if at + n > len(raw):
                raise ValueError("a field ends after its message")
            value, at = raw[at : at + n], at + n
        elif key & 7 in (1, 5):
            n = 8 if key & 7 == 1 else 4
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError(f"wire type {key & 7}")
        yield key >> 3, value


def decode_example(raw: bytes) -> dict[str, dict]:
    """Features of an Example: each has one of bytes, floats and ints, packed or not; of equal names the last counts."""
    out = {}
    for number, features in _fields(raw):
        for k, entry in _fields(features) if number == 1 else ():
            if k != 1:
                continue
            parts = dict(_fields(entry))
            kinds: dict[str, list | None] = {"bytes": None, "floats": None, "ints": None}
            for kind, values in _fields(parts.get(2, b"")):
                own = list(_fields(values))
                if kind == 1:
                    kinds["bytes"] = [v for _, v in own]
                elif kind == 2:
                    kinds["floats"] = [x for _, v in own for x in np.frombuffer(v, "<f4").tolist()]
                elif kind == 3:
                    ints: list[int] = []
                    for _, v in own:
                        if isinstance(v, int):
                            ints.append(v)
                        else:
                            at = 0
                            while at < len(v):
                                x, at = _varint(v, at)
                                ints.append(x)
                    kinds["ints"] = [x - (1 << 64) if x >> 63 else x for x in ints]
            out[parts.get(1, b"").decode()] = kinds
    return out


def _to_varint(x: int) -> bytes:
    x &= (1 << 64) - 1
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def _field(number: int, raw: bytes) -> bytes:
    return _to_varint(number << 3 | 2) + _to_varint(len(raw)) + raw


def encode_example(features: dict[str, dict]) -> bytes:
    entries = b""
    for name in sorted(features):
        kinds = features[name]
        if kinds["bytes"] is not None:
            value = _field(1, b"".join(_field(1, bytes(x)) for x in kinds["bytes"]))
        elif kinds["floats"] is not None:
            value = _field(2, _field(1, np.array(kinds["floats"], "<f4").tobytes()) if kinds["floats"] else b"")
        else:
            value = _field(3, _field(1, b"".join(map(_to_varint, kinds["ints"]))) if kinds["ints"] else b"")
        entries += _field(1, _field(1, name.encode()) + _field(2, value))
    return _field(1, entries)


@dataclass
class OneFile(InputPartition):
    number: int
    path: str


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.zlib = options["path"], options.get("compression", "").upper() == "ZLIB"

    def partitions(self) -> list[OneFile]:
        store, own = files.opened(self.path)
        info = store.get_file_info(own)
        if info.type == fs.FileType.File:
            return [OneFile(0, self.path)]
        found = [f.path for f in store.get_file_info(fs.FileSelector(own)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        number = lambda p: int((re.search(r"([0-9]+)(\.[A-Za-z]+)*$", p) or ["", "0"])[1])
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        return [OneFile(k, scheme + p) for k, p in enumerate(sorted(found, key=lambda p: (number(p), p)))]

    def read(self, part: OneFile | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        raw = files.read_all(part.path)
        rows, size = [], 0
        for k, x in enumerate(records(zlib.decompress(raw) if self.zlib and raw else raw)):
            rows.append({"file": part.number, "row": k, "features": list(decode_example(x).items())})
            size += len(x)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class Written(WriterCommitMessage):
    own: str
    name: str


class Writer(DataSourceWriter):
    """A file a task, part-<number>.tfr; it gets its name only when all tasks are done, so attempts that failed leave nothing behind."""

    def __init__(self, options: dict) -> None:
        self.path, self.zlib = options["path"], options.get("compression", "").upper() == "ZLIB"

    def write(self, rows: Iterator) -> Written:
        store, own = files.opened(self.path)
        store.create_dir(own)
        number = TaskContext.get().partitionId()
        path = f"{own}/_{uuid.uuid4().hex}"
        pack = zlib.compressobj() if self.zlib else None
        with store.open_output_stream(path) as out:
            for row in rows:
                data = frame(encode_example({k: v if isinstance(v, dict) else v.asDict() for k, v in row["features"].items()}))
                out.write(pack.compress(data) if pack else data)
            if pack:
                out.write(pack.flush())
        return Written(path, f"{own}/part-{number}.tfr")

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = files.opened(self.path)
        for m in messages:
            if m:
                store.move(m.own, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = files.opened(self.path)
        for m in messages:
            if m:
                store.delete_file(m.own)


class TfRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecords"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options)


def read(spark: SparkSession, path: str, compression: str = "ZLIB") -> DataFrame:
    """(file, row, features) of a file or a folder's files; (file, row) is the records' order."""
    spark.dataSource.register(TfRecords)
    return spark.read.format("tfrecords").option("path", path).option("compression", compression).load()


def write(df: DataFrame, path: str, compression: str = "ZLIB") -> None:
    """Writes df's `features`, a file for each of its partitions, in the order that these have."""
    df.sparkSession.dataSource.register(TfRecords)
    df.select("features").write.format("tfrecords").option("path", path).option("compression", compression).mode("append").save()


def bytes_feature(value: Column) -> Column:
    """A feature of one byte string, for a map of features."""
    return F.struct(F.array(value).alias("bytes"), F.lit(None).cast("array<float>").alias("floats"), F.lit(None).cast("array<bigint>").alias("ints"))


def arrays(df: DataFrame, seq_length: int, target_length: int, targets: int) -> DataFrame:
    """(file, row, sequence, target) of records with the byte features `sequence` (a byte for each channel of a base) and `target` (half floats): arrays of
    rows, in the shape that a dataset's metadata states; another size raises."""

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nested(parts: list[np.ndarray], width: int, kind: pa.DataType) -> pa.Array:
            flat = np.concatenate(parts) if parts else np.zeros(0, np.float32)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat.astype(np.float32), kind))
            per = [len(p) // width for p in parts]
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), inner)

        for b in batches:
            seq = [np.frombuffer(x, np.uint8) for x in b.column(2).to_pylist()]
            tar = [np.frombuffer(x, "<f2") for x in b.column(3).to_pylist()]
            if any(len(x) != 4 * seq_length for x in seq) or any(len(x) != target_length * targets for x in tar):
                raise ValueError("a record does not have the metadata's shape")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), nested(seq, 4, pa.float32()), nested(tar, targets, pa.float32())], names=["file", "row", "sequence", "target"])

    first = lambda name: F.element_at(F.col("features")[name]["bytes"], 1)
    return df.select("file", "row", first("sequence").alias("s"), first("target").alias("t")).mapInArrow(shape, "file int, row long, sequence array<array<float>>, target array<array<float>>")
