"""TFRecord files: known sums, round trips both ways, order of files, and what must raise."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.sources import tfrecords as T


def test_sums():
    assert T.crc32c(b"123456789") == 0xE3069283 and T.crc32c(b"") == 0 and T.crc32c(bytes(32)) == 0x8A9136AA
    rng = random.Random(1)
    for n in (1, 8191, 8192, 8193, 50_001, 1 << 18):
        data = rng.randbytes(n)
        assert T.crc32c(data) == T._run(0xFFFFFFFF, data) ^ 0xFFFFFFFF


def test_examples_on_the_wire():
    # by hand: features {a: int64 [3, -1], f: float [0.5]}, the numbers once packed and once not
    ints = b"\x1a\x0d\x0a\x0b\x03" + b"\xff" * 9 + b"\x01"
    floats = b"\x12\x05\x0d" + struct.pack("<f", 0.5)
    entry = lambda name, v: b"\x0a" + bytes([len(name) + len(v) + 4]) + b"\x0a" + bytes([len(name)]) + name + b"\x12" + bytes([len(v)]) + v
    body = entry(b"a", ints) + entry(b"f", floats)
    got = T.decode_example(b"\x0a" + bytes([len(body)]) + body)
    assert got["a"]["ints"] == [3, -1] and got["f"]["floats"] == [0.5] and got["a"]["bytes"] is None
    given = {"x": {"bytes": [b"", b"\0\xff" * 300], "floats": None, "ints": None}, "y": {"bytes": None, "floats": [1.5, -2.0], "ints": None}, "z": {"bytes": None, "floats": None, "ints": [0, 1 << 62, -(1 << 63)]}}
    assert T.decode_example(T.encode_example(given)) == given


@pytest.mark.parametrize("compression", ["ZLIB", ""])
def test_round_trip_and_order(spark, tmp_path, compression):
    rng = np.random.default_rng(2)
    data = [(k, rng.integers(0, 2, (8, 4)).astype(np.uint8), rng.random((3, 2)).astype("<f2")) for k in range(40)]
    df = spark.createDataFrame([(k, s.tobytes(), t.tobytes()) for k, s, t in data], "k long, s binary, t binary").repartitionByRange(12, "k").sortWithinPartitions("k")
    T.write(df.select(F.create_map(F.lit("sequence"), T.bytes_feature(F.col("s")), F.lit("target"), T.bytes_feature(F.col("t"))).alias("features")), f"{tmp_path}/r", compression)
    back = T.arrays(T.read(spark, f"{tmp_path}/r", compression), 8, 3, 2).orderBy("file", "row").collect()
    # part-10 comes after part-9, so the order is the one of the rows
    assert [np.array(r.sequence, np.uint8).tolist() for r in back] == [s.tolist() for _, s, _ in data]
    assert all(np.array_equal(np.array(r.target, np.float32), t.astype(np.float32)) for r, (_, _, t) in zip(back, data, strict=True))
    assert len({r.file for r in back}) > 9
    with pytest.raises(Exception, match="shape"):
        T.arrays(T.read(spark, f"{tmp_path}/r", compression), 9, 3, 2).collect()


def test_damage_raises(spark, tmp_path):
    good = T.frame(T.encode_example({"x": {"bytes": [b"abc"], "floats": None, "ints": None}}))
    for name, raw, said in (("a", good[:-1] + b"\0", "sum of a record"), ("b", b"\1" + good[1:], "length"), ("c", good + good[:20], "ends within"), ("d", good[:14] + b"z" + good[15:], "sum of a record")):
        open(tmp_path / name, "wb").write(raw)
        with pytest.raises(Exception, match=said):
            T.read(spark, str(tmp_path / name), "").collect()
    open(tmp_path / "e", "wb").close()
    assert T.read(spark, str(tmp_path / "e"), "").count() == 0
    open(tmp_path / "f", "wb").write(zlib.compress(good * 3))
    assert T.read(spark, str(tmp_path / "f")).count() == 3
