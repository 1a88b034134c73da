"""Best-fit packing of token sequences into sequences of a fixed capacity.

Documents become token ids and pieces of at most `capacity` tokens. Pieces are range-sorted by length; a piece's
place there numbers it.

Packing is bulk-synchronous best-fit. A superstep range-sorts unplaced pieces and gaps and deals them by rank to shares of bounded size, so that no two shares
want one gap; each share is swept for successors (the smallest gap that holds a piece, larger pieces first), gaps are updated, and what no share could place goes on to the
next superstep.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordCache, lean, partitions, slices, split_words, staged, table

CAPACITY, END_ID = 4096, 1
ROWS = 1 << 15  # of a share
TOKENIZER = "word_bpe_49k.json"
_loaded: dict[str, WordTokenizer] = {}


class WordTokenizer(WordCache):
    """Token ids of whole texts by a tokenizer whose pieces never span white space."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # strings of special tokens in a text are ordinary text
        self.kind = np.uint16 if self.model.get_vocab_size() < 1 << 16 else np.uint32
        self.reset()

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        encoded = []
        for at in range(0, len(words), 4096):
            encoded += [e.ids for e in self.model.encode_batch_fast([x.decode() for x in words[at : at + 4096]], add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((x for e in encoded for x in e), self.kind, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids)."""
        return self.encode_split(split_words(texts))


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def cut_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each row's ids followed by end_id, cut at the capacity.

    Null and empty texts are the end_id alone; repeated rows and rows with a null id have their own pieces; other columns are not read."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for b in slices(batch, "text"):
                ids, bounds = t.encode(b.column(1))
                doc, number, start, length, crc, own = [], [], [], [], [], []
                for i in range(b.num_rows):
                    x = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(x), capacity)):
                        part = x[s : s + capacity]
                        doc.append(i)
                        number.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            own.append(part.astype(np.int32))
                cols = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(own, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, schema)


def pair_up(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successors within one stretch of rows sorted by size, largest first: 0 is a gap, 1 a piece. Each piece takes the last gap before it that no
    piece between them takes, which is the smallest free one that holds it. Returns (rows of gaps, rows of their pieces, level of each row).

    A gap's level is the number of free gaps after it, a piece's that before it, both counted from the stretch's start; so a piece belongs
    to the gap before it on its level, also where the two are in different stretches and what came before is added to the levels."""
    level = np.cumsum(np.where(kind == 0, 1, -1)) + (kind == 1)
    order = np.argsort(level, kind="stable")
    hit = np.flatnonzero((level[order][1:] == level[order][:-1]) & (kind[order][1:] == 1) & (kind[order][:-1] == 0))
    return order[hit], order[hit + 1], level


def sweep(size: np.ndarray, gap: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places pieces in gaps and in new sequences: (for each piece the place of its gap or -1, what is left of all gaps, new ones at the end).

    Waves follow one another. A wave sorts the pieces of over half the longest one's size and the gaps together, longest first, and gives pieces their successors; a
    gap that holds the longest piece several times stands there as often. Then gaps are updated. Where no gap holds a piece of the wave, sequences are opened: one for each of over
    half the capacity, and as many at least as the wave's fill. `last` opens one for a rest that fills none, else that rest stays."""
    place, gap = np.full(len(size), -1), gap.astype(np.int64)
    left = np.argsort(-size, kind="stable")
    while len(left):
        s = size[left]
        s = s[: np.searchsorted(-s, -(s[0] // 2))]
        can = np.flatnonzero(gap >= s[-1])
        slot = np.repeat(can, np.maximum(gap[can] // s[0], 1))
        kind = np.repeat([0, 1], [len(slot), len(s)])
        order = np.lexsort((kind, -np.concatenate([gap[slot], s])))
        g, p, _ = pair_up(kind[order])
        if len(p):
            of, piece = slot[order[g]], order[p] - len(slot)
            place[left[piece]] = of
            np.subtract.at(gap, of, s[piece])
            left = np.delete(left, piece)
            continue
        if not last and size[left].sum() < capacity:
            break
        fresh = max(int(s.sum()) // capacity, int((s > capacity // 2).sum()), 1)
        gap = np.concatenate([gap, np.full(fresh, capacity)])
    return place, gap


_MATCH = "kind int, id long, seq long, size long"


def _superstep(capacity: int, step: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Sweeps one share. Kind 2 is a piece with its sequence, 1 one without, 0 what is left of a sequence."""

    def run(t: pa.Table) -> pa.Table:
        share = t.column("share")[0].as_py()
        kind, key, seq, size = (t.column(c).to_numpy() for c in ("kind", "id", "seq", "size"))
        piece, open_ = kind == 1, kind == 0
        place, gap = sweep(size[piece], size[open_], capacity, last)
        own = np.concatenate([seq[open_], (step << 52) + (share << 30) + np.arange(len(gap) - open_.sum())])
        of = np.where(place < 0, -1, own[place] if len(own) else -1)
        some = np.flatnonzero(gap > 0)
        columns = [np.where(place < 0, 1, 2), np.zeros(len(some), np.int64)], [key[piece], np.full(len(some), -1)], [of, own[some]], [size[piece], gap[some]]
        return pa.table([pa.array(np.concatenate(c).astype(x)) for c, x in zip(columns, (np.int32, np.int64, np.int64, np.int64), strict=True)], names=["kind", "id", "seq", "size"])

    return run


def best_fit(pieces: DataFrame, capacity: int, rows: int = ROWS) -> list[DataFrame]:
    """Places pieces (id, size) in sequences of the capacity; returns written tables, one a superstep, whose rows of kind 2 are (id, seq, size). Ids ascend with sizes.

    A superstep range-sorts the pieces left and the gaps that hold one, and deals them by rank, so that every share of about `rows` rows has all sizes
    as often as the whole and no gap is in two shares; each share is swept. What fills no sequence of its own stays and meets all gaps in the second superstep; what then
    stays is packed alone. A share leaves less than a sequence of tokens, so the shares' number falls to one in a few supersteps, and that one opens what it needs."""
    rows = max(rows, 2 * capacity)  # such a share fills a sequence at least, so each superstep places pieces
    full = pieces.where(F.col("size") == capacity).select(F.lit(2).alias("kind"), "id", (-1 - F.col("id")).alias("seq"), "size")
    out = [staged(full, "packing-full")]
    left = pieces.where(F.col("size") < capacity).select(F.lit(1).alias("kind"), "id", F.lit(-1).cast("long").alias("seq"), "size")
    n, step, gaps = left.count(), 0, 0
    while n:
        shares = -(-(n + gaps) // rows)
        rank = F.col("id")
        if step:
            order = ("kind", F.desc("size"), "id", "seq")
            left, rank = left.repartitionByRange(shares, *order).sortWithinPartitions(*order), F.monotonically_increasing_id()
        dealt = left.withColumn("share", F.pmod(rank, F.lit(shares)).cast("int"))
        out.append(staged(dealt.groupBy("share").applyInArrow(lean(_superstep(capacity, step, shares == 1)), _MATCH), "packing-sweep"))
        n, low = out[-1].where("kind = 1").agg(F.count("*"), F.min("size")).first()
        left = out[-1].where("kind = 1")
        if n and not step:
            left = left.union(out[-1].where("kind = 0").where(F.col("size") >= low))
        gaps = left.count() - n if n else 0
        step += 1
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), rows: int = ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `capacity` tokens: the pieces of a sequence lie one after another
    from 0. Shorter or longer pieces raise. An empty table stays empty. Columns that pieces already has keep their values. `rows` is the size of a share."""
    spark = pieces.sparkSession
    columns = pieces.columns
    plain = [f"c{k}" for k in range(len(columns))]
    size, keys = F.col(plain[columns.index(length)]), [plain[columns.index(c)] for c in order if c in columns]
    ok = F.assert_true(F.coalesce(size.between(1, capacity), F.lit(False)), F.lit("a piece's length must be from 1 to the capacity"))
    # range partitioning reads its input twice, so the pieces are written first
    ranged = staged(pieces.toDF(*plain), "pieces").withColumn("ok", ok).where("ok is null").drop("ok").repartitionByRange(partitions(spark), size, *keys).sortWithinPartitions(size, *keys)
    ranged = staged(ranged.withColumn("id", F.monotonically_increasing_id()), "ranged-pieces")
    steps = best_fit(ranged.select("id", size.cast("long").alias("size")), capacity, rows)
    # a sequence has at most `capacity` pieces
    own = Window.partitionBy("seq").orderBy("id")
    found = spark.read.schema(_MATCH).parquet(*[m._staged_path for m in steps])
    places = found.where("kind = 2").select("id", F.col("seq").alias("sequence_id"), (F.sum("size").over(own) - F.col("size")).alias("offset"))
    return ranged.join(places, "id").select(*[F.col(x).alias(c) for x, c in zip(plain, columns, strict=True)], "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(table(spark, sf_dir, "documents"), default_tokenizer()))
