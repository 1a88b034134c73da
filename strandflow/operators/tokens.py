"""Token-array operators: truncation, assembly, labelling and segmentation as array expressions.

Service ids: UNK 0, CLS 1, SEP 2, PAD 3, MASK 4. Labels are null where the consumer wants its ignore value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

UNK, CLS, SEP, PAD, MASK, IGNORE = 0, 1, 2, 3, 4, -100


def ints(*xs: int) -> Column:
    return F.array(*(F.lit(x).cast("int") for x in xs)) if xs else F.array().cast("array<int>")


def part(a: Column, start: Column, end: Column) -> Column:
    """a[start:end), bounds clamped."""
    lo = F.greatest(start, F.lit(0))
    return F.slice(a, lo + 1, F.greatest(end - lo, F.lit(0)))


def held(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once a row; a column that an expression names several times, or inside a lambda, may be computed each time."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def padded(a: Column, length: int, value: int = PAD) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value).cast("int"), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


@F.arrow_udf(ArrayType(LongType()))
def starts(a: pa.Array) -> pa.Array:
    """Where each token of a row starts, if they follow one another with these lengths from 0: running sums within the row."""
    bounds = np.asarray(a.offsets)
    lengths = a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = bounds - bounds[0]
    before = np.concatenate([[0], np.cumsum(lengths)])
    out = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))))
    return pc.if_else(a.is_valid(), out, None) if a.null_count else out


def truncate(a: Column, budget: int, side: str = "right") -> Column:
    """At most `budget` tokens: the first (right), the last (left) or those around the middle (mid)."""
    n = F.size(a)
    if side == "right":
        return part(a, F.lit(0), F.lit(budget))
    if side == "left":
        return part(a, n - budget, n)
    before = budget // 2
    m = F.floor(n / 2).cast("int")
    return part(a, m - before, F.least(m + (budget - before), n))


def encode(a: Column, length: int, side: str = "right") -> Column:
    """CLS, the truncated tokens, SEP, padded to `length`."""
    return padded(F.concat(ints(CLS), truncate(a, length - 2, side), ints(SEP)), length)


def encode_pair(a: Column, b: Column, length: int) -> Column:
    """CLS a SEP b SEP, the longer one shortened first, padded."""
    budget = length - 3
    n, m = F.size(a), F.size(b)
    over = F.greatest(n + m - budget, F.lit(0))
    # cut the longer down to the shorter, then both alike; an odd last token comes off a
    first = F.least(over, F.abs(n - m))
    rest = over - first
    cut_a = F.when(n > m, first).otherwise(0) + F.ceil(rest / 2).cast("int")
    cut_b = F.when(n > m, 0).otherwise(first) + F.floor(rest / 2).cast("int")
    return padded(F.concat(ints(CLS), part(a, F.lit(0), n - cut_a), ints(SEP), part(b, F.lit(0), m - cut_b), ints(SEP)), length)


def balance(left: Column, mid: Column, right: Column, length: int, service: int) -> tuple[Column, Column, Column, Column]:
    """(left, mid, right, pads): context cut evenly around mid so that all and `service` tokens make `length`.

    A mid part over the budget is cut on both sides and loses its context. A side that must vanish does."""
    L, M, R = F.size(left), F.size(mid), F.size(right)
    o = L + M + R + service - length
    alone = M + service >= length
    t = M + service - length
    wide = L >= R
    half = lambda x: F.floor(x / 2).cast("int")
    tr0 = half(F.greatest(F.lit(0), o - (L - R)))
    tl0 = half(F.greatest(F.lit(0), o - (R - L)) + 1)
    tl = F.when(wide, o - tr0).otherwise(tl0)
    tr = F.when(wide, tr0).otherwise(o - tl0)
    none = ints()
    keep = o <= 0
    return (
        F.when(alone, none).when(keep, left).otherwise(part(left, tl, L)),
        F.when(alone, part(mid, half(t), M - (t - half(t)))).otherwise(mid),
        F.when(alone, none).when(keep, right).otherwise(part(right, F.lit(0), R - tr)),
        F.when(~alone & keep, -o).otherwise(0),
    )


def splice_sample(left: Column, mid: Column, right: Column, length: int) -> Column:
    """CLS left SEP mid SEP right SEP. A mid over the budget is cut from its right end; padding stands before the last SEP."""
    budget = length - 4
    l, m, r, pads = balance(left, part(mid, F.lit(0), F.lit(budget)), right, length, 4)
    return F.concat(ints(CLS), l, ints(SEP), m, ints(SEP), r, F.array_repeat(F.lit(PAD).cast("int"), pads), ints(SEP))


def token_labels(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample, pos, label): the largest target class of the positions whose last token start at or before them is this token.

    tokens: (sample, pos, st); targets: (sample, place, cls). Tokens that no target reaches have a null label."""
    t = tokens.select("sample", F.col("st").alias("place"), F.lit(0).alias("kind"), "pos", F.lit(None).cast(targets.schema["cls"].dataType).alias("cls"))
    both = t.unionByName(targets.select("sample", "place", F.lit(1).alias("kind"), F.lit(None).cast(tokens.schema["pos"].dataType).alias("pos"), "cls"))
    # one pass over a sample in order of place: each target belongs to the last token before it
    w = Window.partitionBy("sample").orderBy("place", "kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("pos", F.last("pos", True).over(w)).where("pos is not null").groupBy("sample", "pos").agg(F.max("cls").alias("label"))


def class_rows(first: Column, second: Column) -> Column:
    """Three 0/1 flags: class k where either column says k; all 0 where both are null."""
    return F.array(*(F.coalesce(((first == k) | (second == k)).cast("int"), (first == k).cast("int"), (second == k).cast("int"), F.lit(0)) for k in range(3)))


def chunks(records: DataFrame, bins: int, centre: int) -> DataFrame:
    """records with chunk number, first and end bin of each of its ceil(bins / centre) chunks."""
    n = -(-bins // centre)
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk")
    r = records.select("*", k)
    return r.withColumn("first_bin", F.col("chunk") * centre).withColumn("end_bin", F.least((F.col("chunk") + 1) * centre, F.lit(bins)))


def assemble_bins(bins: Column, budget: int, skip: bool = False) -> Column:
    """CLS bin SEP bin SEP ...: bins while the total stays under the budget; with `skip`, later bins that fit still join."""
    start = F.struct(ints(CLS).alias("ids"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def step(a: Column, b: Column) -> Column:
        fits = (F.size(a["ids"]) + F.size(b) + 1 < budget) & (F.lit(True) if skip else ~a["stop"])
        return F.struct(F.when(fits, F.concat(a["ids"], b, ints(SEP))).otherwise(a["ids"]).alias("ids"), (a["n"] + fits.cast("int")).alias("n"), (a["stop"] | ~fits).alias("stop"))

    return F.aggregate(bins, start, step)


def shifted_centre(seq: Column, pad: int, shift: Column) -> Column:
    """seq without pad + shift symbols on the left and pad - shift on the right."""
    return F.substring(seq, pad + shift + 1, F.greatest(F.length(seq) - 2 * pad, F.lit(0)))


def collate(df: DataFrame, ids: str, batch: str, multiple: int = 64) -> DataFrame:
    """ids padded to the longest of their batch, rounded up to a multiple, with an attention mask."""
    top = F.max(F.size(ids)).over(Window.partitionBy(batch))
    width = (F.ceil(top / F.lit(multiple)) * multiple).cast("int")
    d = df.withColumn("_w", width)
    pad = F.array_repeat(F.lit(PAD).cast("int"), F.col("_w") - F.size(ids))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_w") - F.size(ids)))
    return d.withColumn("attention_mask", mask).withColumn(ids, F.concat(ids, pad)).drop("_w")


def collate_labelled(df: DataFrame, batch: str, multiple: int = 64) -> DataFrame:
    """A batch's rows (input_ids, token_type_ids, attention_mask, bins_mask, labels) brought to one shape, with labels_mask.

    Token columns are padded to the longest of the batch rounded up to `multiple`, ids with PAD and the others with 0 (false); labels, rows of
    numbers of which a batch has one width, with rows of zeros to the most rows of the batch; labels_mask is true for a row's own labels."""
    w = Window.partitionBy(batch)
    width = (F.ceil(F.max(F.size("input_ids")).over(w) / F.lit(multiple)) * multiple).cast("int")
    d = df.withColumns({"_w": width, "_r": F.max(F.size("labels")).over(w), "_c": F.max(F.size(F.get("labels", F.lit(0)))).over(w)})
    fill = {"input_ids": F.lit(PAD), "token_type_ids": F.lit(0), "attention_mask": F.lit(0), "bins_mask": F.lit(0)}
    out = {c: F.concat(c, F.array_repeat(x.cast(df.schema[c].dataType.elementType), F.col("_w") - F.size(c))) for c, x in fill.items()}
    number = df.schema["labels"].dataType.elementType.elementType
    more = F.col("_r") - F.size("labels")
    out["labels"] = F.concat("labels", F.array_repeat(F.array_repeat(F.lit(0).cast(number), F.col("_c")), more))
    out["labels_mask"] = F.concat(F.array_repeat(F.lit(True), F.size("labels")), F.array_repeat(F.lit(False), more))
    return d.withColumns(out).drop("_w", "_r", "_c")


def segment(ids: Column, input_size: int, memory: int, max_segments: int, pad: int = 0) -> Column:
    """Segments of a sequence, each CLS, `memory` places, SEP, piece, SEP and padding; nearly equal pieces, right-aligned
    in max_segments slots. Rows are (slot, ids)."""
    seg = input_size - memory - 3
    fill = F.concat(ints(CLS), F.array_repeat(F.lit(MASK).cast("int"), memory), ints(SEP))

    def cut(body: Column, n: Column, size: Column) -> Column:
        def one(i: Column) -> Column:
            row = F.concat(fill, F.slice(body, i * size + 1, F.greatest(size, F.lit(1))), ints(SEP))
            return F.struct((F.lit(max_segments) - n + i).alias("slot"), padded(row, input_size, pad).alias("ids"))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<struct<slot:int,ids:array<int>>>"))

    kept = F.slice(F.filter(ids, lambda x: ~x.isin(CLS, SEP, PAD)), 1, seg * max_segments)
    return held(kept, lambda body: _pieces(body, seg, lambda n, size: cut(body, n, size)))


def _pieces(body: Column, seg: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of the number of nearly equal pieces of at most `seg` and their size."""
    n = F.ceil(F.size(body) / F.lit(seg)).cast("int")
    return held(F.struct(n.alias("n"), F.ceil(F.size(body) / F.greatest(n, F.lit(1))).cast("int").alias("size")), lambda x: f(x["n"], x["size"]))


def segment_labelled(ids: Column, labels: Column, input_size: int, memory: int, max_segments: int) -> Column:
    """As segment(), with each piece's labels beside it; service and padding places have null labels."""
    seg = input_size - memory - 3
    fill = F.concat(ints(CLS), F.array_repeat(F.lit(MASK).cast("int"), memory), ints(SEP))
    nothing = lambda k: F.array_repeat(F.lit(None).cast("int"), k)

    def cut(body: Column, n: Column, size: Column) -> Column:
        def one(i: Column) -> Column:
            def row(piece: Column) -> Column:
                some = F.concat(fill, F.transform(piece, lambda x: x["i"]), ints(SEP))
                lab = F.concat(nothing(F.lit(memory + 2)), F.transform(piece, lambda x: x["l"]), nothing(F.lit(1)))
                return F.struct((F.lit(max_segments) - n + i).alias("slot"), padded(some, input_size, PAD).alias("ids"), F.concat(lab, nothing(F.greatest(F.lit(input_size) - F.size(lab), F.lit(0)))).alias("labels"))

            return held(F.slice(body, i * size + 1, F.greatest(size, F.lit(1))), row)

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<struct<slot:int,ids:array<int>,labels:array<int>>>"))

    kept = F.slice(F.filter(F.arrays_zip(ids.alias("i"), labels.alias("l")), lambda x: ~x["i"].isin(CLS, SEP, PAD)), 1, seg * max_segments)
    return held(kept, lambda body: _pieces(body, seg, lambda n, size: cut(body, n, size)))


def segment_bins(ids: Column, per_segment: int) -> Column:
    """Bins (runs that SEP ends) grouped per_segment at a time: arrays of tokens that keep their SEPs."""

    def cut(x: Column) -> Column:
        body, stops = x["body"], x["stops"]
        whole = F.size(stops).cast("int")
        n = F.ceil(whole / F.lit(per_segment)).cast("int")
        # a segment ends at each per_segment-th SEP, the last one with the body
        place = lambda k: F.when(k < 1, 0).when(k * per_segment <= whole, F.get(stops, k * per_segment - 1)).otherwise(F.size(body))
        last = F.when(F.coalesce(F.get(stops, n * per_segment - 1), F.size(body)) < F.size(body), n).otherwise(F.greatest(n - 1, F.lit(0)))
        found = F.transform(F.sequence(F.lit(0), F.greatest(last, n - 1, F.lit(0))), lambda k: held(F.struct(place(k).alias("a"), place(k + 1).alias("b")), lambda y: F.slice(body, y["a"] + 1, y["b"] - y["a"])))
        return F.when(F.size(body) > 0, found).when(F.size(body) == 0, F.array().cast("array<array<int>>"))

    kept = F.filter(ids, lambda x: ~x.isin(CLS, PAD))
    stops = lambda body: F.filter(F.transform(body, lambda x, k: F.when(x == SEP, k + 1)), lambda k: k.isNotNull())
    return held(held(kept, lambda body: F.struct(body.alias("body"), stops(body).alias("stops"))), cut)


def special_bounds(ids: Column) -> tuple[Column, Column]:
    """0-based places of the first CLS and the first SEP; -1 where there is none."""
    return (F.array_position(ids, CLS) - 1).cast("int"), (F.array_position(ids, SEP) - 1).cast("int")


def splice_sites(genes: DataFrame) -> DataFrame:
    """(gene, kind, pos) of donors and acceptors from exon start and end lists; roles swap on the minus strand."""
    s = genes.select("gene", "strand", F.explode("splice_starts").alias("pos"), F.lit(True).alias("at_start")).unionByName(genes.select("gene", "strand", F.explode("splice_ends").alias("pos"), F.lit(False).alias("at_start")))
    return s.select("gene", F.when((F.col("strand") == "+") == F.col("at_start"), "donor").otherwise("acceptor").alias("kind"), "pos")
