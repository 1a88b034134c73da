"""Byte-pair encoding of sequences without pre-tokenization, in Arrow batches, and its training in Spark."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import draws, stages

SLICE = 1024  # texts encoded at once
DENSE = 1024  # symbols whose pairs are counted in a table
SPECIAL = ("[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]")


class Bpe:
    """Vocabulary and merges; `encode` takes the best-ranked pair first, leftmost of equals, over a linked list and a heap."""

    def __init__(self, alphabet: list[str], merges: list[tuple[str, str]]) -> None:
        self.vocabulary = {x: k for k, x in enumerate([*SPECIAL, *alphabet])}
        self.ranks = {}
        for k, (a, b) in enumerate(merges):
            self.ranks.setdefault((a, b), k)
            self.vocabulary.setdefault(a + b, len(self.vocabulary))

    def pieces(self, text: str, dropout: float = 0.0, seed: str = "") -> list[str]:
        parts = list(text)
        n = len(parts)
        after, before, live = [*range(1, n), -1] if n else [], list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, str, str]] = []
        draws = 0
        # the number of a draw is hashed after what all draws share, the text among it
        base, limit = hashlib.md5(f"{seed}|".encode()), dropout * 2**32

        def offer(i: int) -> None:
            nonlocal draws
            j = after[i]
            if j >= 0 and (r := self.ranks.get((parts[i], parts[j]))) is not None:
                if dropout:
                    draws += 1
                    drawn = base.copy()
                    drawn.update(b"%d" % draws)
                    if int.from_bytes(drawn.digest()[:4]) < limit:
                        return
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j] = a + b, False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p, ok in zip(parts, live, strict=True) if ok]

    def encode(self, text: str, dropout: float = 0.0, seed: str = "") -> tuple[list[int], list[int], list[int]]:
        """(ids, starts, ends) of the pieces; unknown symbols are UNK."""
        p = self.pieces(text, dropout, seed)
        ends, at = [], 0
        for x in p:
            at += len(x)
            ends.append(at)
        return [self.vocabulary.get(x, 0) for x in p], [e - len(x) for e, x in zip(ends, p, strict=True)], ends

    def in_order(self) -> bool:
        """Whether a pair always ranks after all pairs that make its parts, as training gives them; then merges one after another give the pieces of `pieces`."""
        made: dict[str, int] = {}
        for (a, b), k in self.ranks.items():
            made[a + b] = max(k, made.get(a + b, -1))
        return all(made.get(x, -1) < k for pair, k in self.ranks.items() for x in pair)

    def encode_many(self, texts: pa.Array, dropout: float = 0.0, seed: str = "") -> pa.Array:
        """(ids, starts, ends) of each text of an Arrow array, as `encode` gives them (its seed is followed by the text), all texts of it in one array of symbols."""
        given = texts.to_pylist()
        size = np.array([len(t) if t else 0 for t in given], np.int64)
        points, x = np.unique(np.frombuffer("".join(t for t in given if t).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        names = [chr(p) for p in points]
        number = {c: k for k, c in enumerate(names)}
        pairs = []
        for (a, b), _ in sorted(self.ranks.items(), key=lambda r: r[1]):
            if a in number and b in number:
                if a + b not in number:
                    number[a + b] = len(names)
                    names.append(a + b)
                pairs.append((number[a], number[b], number[a + b]))
        row = np.repeat(np.arange(len(size)), size)
        if len(x):
            last = np.cumsum(size[size > 0]) - 1
            if dropout:
                drawn = draws.Draws([f"{seed}|{t}|".encode() for t in given if t])
                x, last = _merge_drawn(x.astype(np.int32), last, pairs, lambda row, number: drawn(row, number) < dropout * 2**32)
            else:
                x, last = _merge_symbols(x.astype(np.int32), last, pairs)
            row = np.repeat(np.flatnonzero(size), np.diff(last, prepend=-1))
        offsets = pa.array(np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32))
        length = np.array([len(c) for c in names] or [0])[x]
        ends = np.cumsum(length) - np.concatenate([[0], np.cumsum(size)])[row]
        ids = np.array([self.vocabulary.get(c, 0) for c in names] or [0])[x]
        null = pa.array([t is None for t in given], pa.bool_())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32)), mask=null) for v in (ids, ends - length, ends)]
        return pa.StructArray.from_arrays(lists, names=["ids", "starts", "ends"])

    def column(self, text: Column, dropout: float = 0.0, seed: str = "") -> Column:
        """struct(ids, starts, ends) of a text column; null texts give null fields."""
        if self.in_order():

            @F.arrow_udf("ids array<int>, starts array<int>, ends array<int>")
            def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for b in batches:
                    done = [self.encode_many(b.slice(i, SLICE), dropout, seed) for i in range(0, len(b), SLICE)]
                    yield pa.concat_arrays(done or [self.encode_many(b)])

            return whole(text)

        @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in batches:
                rows = [(None, None, None) if x is None else self.encode(x, dropout, f"{seed}|{x}") for x in s]
                yield pd.DataFrame(rows, columns=["ids", "starts", "ends"])

        return run(text)

    def encode_around(self, left: Column, right: Column) -> tuple[Column, Column]:
        """Ids of the two sides of a boundary that no piece crosses."""
        return self.column(left)["ids"], self.column(right)["ids"]


def _every_other(at: np.ndarray) -> np.ndarray:
    """Every other place of a run of overlapping ones."""
    if not len(at):
        return at
    run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
    first = np.flatnonzero(np.diff(run, prepend=-1))
    return at[(np.arange(len(at)) - first[run]) % 2 == 0]


def _merge_drawn(x: np.ndarray, ends: np.ndarray, pairs: list[tuple[int, int, int]], dropped: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """_merge_symbols with dropout: a pair that comes up is drawn for once, dropped(piece, number) in the order in which `pieces` numbers a text's draws, and never merged if it is dropped."""
    last = np.zeros(len(x), bool)
    last[ends] = True
    row = np.cumsum(last) - last
    most = max(int(x.max()), *(c for _, _, c in pairs), 0) + 1
    codes = np.array(sorted(a * most + b for a, b, _ in pairs), np.int64)
    table = np.zeros(most * most, bool) if most <= DENSE else None
    if table is not None:
        table[codes] = True

    def ranked(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        key = np.multiply(a, most, dtype=np.int64) + b
        return np.isin(key, codes) if table is None else table[key]

    at = np.flatnonzero(ranked(x[:-1], x[1:]) & ~last[:-1])
    count = np.bincount(row[at], minlength=len(ends))
    live = np.zeros(len(x), bool)  # the pair that starts here may be merged
    live[at] = ~dropped(row[at], np.arange(1, len(at) + 1) - (np.cumsum(count) - count)[row[at]])
    for a, b, c in pairs:
        at = np.flatnonzero((x[:-1] == a) & (x[1:] == b) & live[:-1])
        if a == b:
            at = _every_other(at)
        if not len(at):
            continue
        own = row[at]
        # places are merged from the left, so a neighbour on the left is merged already and one on the right is not
        beside = np.diff(at, prepend=-2) == 2
        left = (at > 0) & ~last[at - 1]
        beside &= left
        left_new = left & ranked(np.where(beside, c, x[at - 1]), c)
        right_new = ~last[at + 1]
        right_new[right_new] = ranked(c, x[at[right_new] + 2])
        new = left_new.astype(np.int64) + right_new
        before = np.cumsum(new) - new
        number = before - before[np.searchsorted(own, own)] + count[own] + 1
        count += np.bincount(own, new, len(count)).astype(count.dtype)
        gone = dropped(np.concatenate([own[left_new], own[right_new]]), np.concatenate([number[left_new], (number + left_new)[right_new]]))
        left_new[left_new] = ~gone[: left_new.sum()]
        right_new[right_new] = ~gone[len(gone) - right_new.sum() :]
        x[at], live[at], last[at] = c, right_new, last[at + 1]
        apart = left & ~beside
        live[at[apart] - 1] = left_new[apart]
        live[at[np.flatnonzero(beside) - 1]] = left_new[beside]
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        x, last, live, row = x[keep], last[keep], live[keep], row[keep]
    return x, np.flatnonzero(last)


def _merge_symbols(x: np.ndarray, ends: np.ndarray, pairs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols x of pieces (last places in ends) with each pair (a, b) replaced by c in turn, runs of one symbol from the left."""
    last = np.zeros(len(x), bool)
    last[ends] = True
    for a, b, c in pairs:
        at = np.flatnonzero((x[:-1] == a) & (x[1:] == b) & ~last[:-1])
        if a == b:
            at = _every_other(at)
        x = x.copy()
        x[at] = c
        last[at] |= last[at + 1]
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        x, last = x[keep], last[keep]
    return x, np.flatnonzero(last)


def train(sequences: DataFrame, text: str, merges: int, piece: int | None = None, batch: int = 64, rewrite: int = 16) -> Bpe:
    """Merges by the most frequent neighbouring pair over all sequences, ties by text.

    Sequences are whole unless `piece` cuts them, which loses the pairs across cuts: a corpus of sentences needs no cut, contigs of many megabases may. They become symbol numbers once. A job merges what the round before chose and
    counts the pairs left, adding up in each task first; only the most frequent pairs reach the driver. Of these a
    round takes as many as must come next in any case: pairs without a common symbol, each more frequent than every pair that shares a symbol
    with one before it (no new pair can be more frequent than that). Every `rewrite` rounds the merged pieces are written
    to the shared folder, which cuts the lineage. Pairs that occur once are not merged."""
    spark = sequences.sparkSession
    s = sequences.where(F.length(text) > 0).select(F.col(text).alias("s"))
    if piece:
        s = s.select(F.explode(F.regexp_extract_all("s", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))).alias("s"))

    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(t)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["c"])

    # written once: the alphabet and the numbers both read it
    s = stages.written(s, "bpe-texts")
    alphabet = sorted(r[0] for r in s.mapInArrow(symbols, "c string").distinct().collect())
    names = list(alphabet)
    code = np.array(sorted(map(ord, alphabet)), np.uint32)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.searchsorted(code, points(t)).astype(np.int32).tobytes() for t in b.column(0).to_pylist()], pa.binary())], names=["x"])

    def applied(pairs: list[tuple[int, int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                size = pc.binary_length(b.column(0)).to_numpy() // 4
                size = size[size > 0]
                if len(size):
                    yield _merge_symbols(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), np.cumsum(size) - 1, pairs)

        return run

    def counted(pairs: list[tuple[int, int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for x, ends in applied(pairs)(batches):
                inner = np.ones(len(x), bool)
                inner[ends] = False
                at = np.flatnonzero(inner)
                # of a run of one symbol, as many pairs as would be merged, from the left
                same = at[x[at] == x[at + 1]]
                run_of = np.concatenate([[0], np.cumsum((np.diff(same) > 1) | (x[same][1:] != x[same][:-1]))]) if len(same) else same
                first = np.flatnonzero(np.diff(run_of, prepend=-1))
                odd = same[(np.arange(len(same)) - first[run_of]) % 2 == 1] if len(same) else same
                inner[odd] = False
                at = np.flatnonzero(inner)
                most = int(x.max()) + 1
                if most <= DENSE:  # few symbols are counted in a table, without sorting
                    table = np.bincount(x[at].astype(np.int64) * most + x[at + 1], minlength=1)
                    k = np.flatnonzero(table)
                    n, k = table[k], k // most << 32 | k % most
                else:
                    k, n = np.unique(x[at].astype(np.int64) << 32 | x[at + 1], return_counts=True)
                key, which = np.unique(np.concatenate([key, k]), return_inverse=True)
                total = np.bincount(which, np.concatenate([total, n]), len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], names=["pair", "n"])

        return run

    def merged(pairs: list[tuple[int, int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, ends in applied(pairs)(batches):
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in np.split(x, ends[:-1] + 1)], pa.binary())], names=["x"])

        return run

    state = stages.written(s.mapInArrow(numbered, "x binary"), "bpe")
    found, since = [], []
    for round_ in range(merges):
        if len(found) >= merges:
            break
        if round_ % rewrite == rewrite - 1:
            state, since = stages.written(state.mapInArrow(merged(since), "x binary"), "bpe"), []
        top = state.mapInArrow(counted(since), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        rows = [(r["n"], names[r["pair"] >> 32], names[r["pair"] & 0xFFFFFFFF], r["pair"] >> 32, r["pair"] & 0xFFFFFFFF) for r in top.orderBy(F.desc("n")).limit(4 * batch + 1).collect()]
        if not rows:
            break
        floor = rows[-1][0] if len(rows) > 4 * batch else 0  # pairs with this count may be missing
        rows.sort(key=lambda r: (-r[0], r[1], r[2]))
        used: set[int] = set()
        touching = 0
        for k, (count, a, b, i, j) in enumerate(rows):
            if k and (i in used or j in used or count <= touching or count <= floor or len(used) >= 2 * batch or len(found) >= merges):
                break
            if k == 0 and count <= floor:  # ties beyond the limit: the first by text of all pairs with this count
                known = F.broadcast(spark.createDataFrame(list(enumerate(names)), "id long, name string"))  # the vocabulary so far
                left, right = known.toDF("i", "a"), known.toDF("j", "b")
                pairs = top.where(F.col("n") == count).select(F.shiftright("pair", 32).alias("i"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("j"))
                r = pairs.join(left, "i").join(right, "j").orderBy("a", "b").first()
                a, b, i, j = r["a"], r["b"], r["i"], r["j"]
            used |= {i, j}
            touching = max((r[0] for r in rows[k + 1 :] if r[3] in used or r[4] in used), default=0)
            found.append((a, b))
            since.append((i, j, len(names)))
            names.append(a + b)
            if a == b or floor and k == 0 and count <= floor:
                break
    return Bpe(alphabet, found)
