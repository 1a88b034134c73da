"""Models that carry a state from a sequence's segment to its next one: a plug-in stepped over segments in order, many sequences at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from . import inference


def run(df: DataFrame, plugin: str, key: str, order: str, segment: str, kind: str = "bigint", blocks: int = 200, batch: int = 256) -> DataFrame:
    """(key, order, value) of each row: what the plug-in says of the segment after all earlier ones of its key.

    The plug-in is an object with start() -> a state and step(states, segments) -> (states, values), lists of equal lengths. Sequences are dealt to `blocks` by their key's hash; a
    block is read segment number by segment number, so up to `batch` sequences take a step together, and a task holds the states of one block's sequences and no more of their segments than a
    batch. Orders may have gaps; two rows of one key and order raise, as does a null order. A null key is a sequence of its own."""
    schema = StructType([df.schema[key], df.schema[order], StructField("value", _parse_datatype_string(kind))])
    arrow = to_arrow_schema(schema)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = inference.load(plugin)
        states: dict = {}
        last: dict = {}
        block, held = None, []

        def flush() -> pa.RecordBatch:
            keys = [k for k, _, _ in held]
            known = [states[k] if k in states else model.start() for k in keys]
            new, values = model.step(known, [s for _, _, s in held])
            if len(new) != len(held) or len(values) != len(held):
                raise ValueError(f"{plugin} returned {len(new)} states and {len(values)} values for {len(held)} segments")
            states.update(zip(keys, new, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(keys, arrow.field(0).type), pa.array([o for _, o, _ in held], arrow.field(1).type), pa.array(values, arrow.field(2).type)], schema=arrow)
            held.clear()
            return out

        for b in batches:
            for own, at, k, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != block:
                    if held:
                        yield flush()
                    states.clear()
                    last.clear()
                    block = own
                if at is None or last.get(k) == at:
                    raise ValueError(f"sequence {k} has no order or the order {at} twice")
                # a sequence takes a step at a time
                if held and (len(held) == batch or held[-1][1] != at):
                    yield flush()
                last[k] = at
                held.append((k, at, s))
        if held:
            yield flush()

    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), F.col(order).alias("_order"), F.col(key).alias("_key"), F.col(segment).alias("_segment"))
    return dealt.repartition("_block").sortWithinPartitions("_block", "_order", "_key").mapInArrow(steps, schema)


class Rolling:
    """A stand-in model whose state depends on all tokens so far and their order."""

    MODULUS = 1_000_003

    def start(self) -> int:
        return 7

    def step(self, states: list[int], segments: list[list[int]]) -> tuple[list[int], list[int]]:
        new = [(31 * s + sum((k + 1) * t for k, t in enumerate(x or []))) % self.MODULUS for s, x in zip(states, segments, strict=True)]
        return new, new


rolling = Rolling()
