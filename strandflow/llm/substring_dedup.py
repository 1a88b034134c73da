"""Substring dedup: words covered by a window that also starts in an earlier document go, found by sharded FM-indexes.

0. Chunks. Documents are packed as they lie, GROUP_BYTES of text a chunk, and written once. Places and documents never leave their chunk but to meet
   what the chunk is told, so a passage that a third of all documents hold is at most one entry a chunk anywhere else.
1. Anchors. The smallest hash of ANCHOR consecutive words in a window is its anchor; neighbouring windows share anchors, so
   one in five words or so is one. Equal windows have equal anchors: an anchor that one document alone has
   needs no more work. A chunk sends each of its different anchors once and is told which are repeated.
2. Segments. The windows of a repeated anchor form a segment of at most 2 * WINDOW - ANCHOR words. A chunk sends each of its different segments
   once to the shard of its anchor, with the smallest and the largest document that has it. An anchor with more than HEAVY places has its windows sent one by one, each
   to the shard of its own hash.
3. Index. Each shard builds a compressed FM-index of the half of its different segments that start in the earliest documents, and streams all segments through it: backward search
   gives the matching statistics, and for each window that the index holds the smallest document. Later segments with windows that it does not hold are
   indexed next, and streamed once more. A chunk is told those of its segments that have a window of a smaller document than its largest.
4. Removal. The chunk looks its windows up in what it was told, and covered words go.

All hashes are of 64 bits, of words and of runs of words. doc_id names one document; rows with the same id count as one. Rows with a null id and null
or empty texts lose nothing. Ties cannot be: of equal windows the smallest doc_id keeps its words. Columns other than the two, and those asked to
be carried, are not read, and their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, differences, give_back, lean, mix, ngrams, pack_arrays, partitions, runs, slices, split_words, staged, table, unpack_arrays
from .fm_index import NOWHERE, FmIndex

WINDOW, ANCHOR, GROUP_BYTES, SHARD_WORDS = 13, 5, 8 << 20, 400_000
HEAVY = 4096  # places of an anchor, in all chunks, beyond which its windows are dealt one by one
NO_ID = -(1 << 63)
_RUNS = "shard long, kind int, run binary"


def window_runs(h: np.ndarray, row: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor's place, anchor's hash) of each run of windows with one anchor.

    Windows are numbered by their first word. Of equal hashes the leftmost is the anchor, so equal windows have it at the same place."""
    g = ngrams(h, anchor)
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    width = window - anchor + 1
    value, place, reach = g, np.arange(len(g)), 1
    while reach < width:
        step = min(reach, width - reach)
        m = len(value) - step
        left = value[:m] <= value[step:]
        value, place = np.where(left, value[:m], value[step:]), np.where(left, place[:m], place[step:])
        reach += step
    place, value = place[:n], value[:n]
    good = row[window - 1 :] == row[:n]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:n] != row[: n - 1])
    ids = np.cumsum(new) - 1
    number = np.bincount(ids, good)
    first = np.flatnonzero(new)
    # windows of a row that end inside it come first in each run, so a run's good windows are its first ones
    keep = number > 0
    first = first[keep]
    return first, number[keep].astype(np.int64), place[first], value[first]


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of each different key."""
    order = np.argsort(key, kind="stable")
    bounds = np.concatenate([runs(key[order]), [len(key)]])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(key[order[a]]), order[a:b]


def _table(rows: list[tuple[int, int, bytes]], **more: list[int]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "run": pa.array([r[2] for r in rows], pa.binary()), **{k: pa.array(v, pa.int64()) for k, v in more.items()}})


def pack_documents(documents: DataFrame) -> DataFrame:
    """(shard, kind 0, run) of chunks: documents as they lie, compressed; shard is the chunk's number, of its task and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            yield from _table([(number, 0, zstandard.ZstdCompressor(level=1).compress(sink.getvalue()))]).to_batches()
            number, size = number + 1, 0
            held.clear()

        for batch in batches:
            for b in slices(batch, 1):
                held.append(b)
                size += b.column(1).nbytes
                if size >= GROUP_BYTES:
                    yield from send()
        if held:
            yield from send()
        give_back()

    return documents.mapInArrow(run, _RUNS)


def unpack_documents(raw: pa.BinaryScalar) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw.as_buffer()))


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(b.column(0), NO_ID).to_numpy(zero_copy_only=False)


def repeated_anchors(packed: DataFrame, parts: int) -> DataFrame:
    """(shard, kind 1, run, n) by chunk: those of its anchors that two or more documents have."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                held = []
                for b in unpack_documents(raw):
                    w = split_words(b.column(1))
                    ids = _ids(b)
                    _, _, place, g = window_runs(w.hashes(), w.row)
                    ok = ids[w.row[place]] != NO_ID
                    held.append((g[ok], ids[w.row[place]][ok]))
                g, d = (np.concatenate(x) for x in zip(*held, strict=True))
                if not len(g):
                    continue
                order = np.argsort(g, kind="stable")
                first = runs(g[order])
                several = np.minimum.reduceat(d[order], first) < np.maximum.reduceat(d[order], first)
                often = np.diff(np.append(first, len(g)))
                g = g[order][first]
                rows = [(part, 1, pack_arrays(np.array([chunk]), differences(g[at]), several[at], often[at])) for part, at in _split(((g >> U64(20)) % U64(parts)).astype(np.int64))]
                yield from _table(rows).to_batches()
        give_back()

    def meet(t: pa.Table) -> pa.Table:
        found = [unpack_arrays(x.as_py()) for x in t.column("run")]
        g = np.concatenate([np.cumsum(p[1]) for p in found])
        chunk = np.repeat([p[0].astype(np.int64)[0] for p in found], [len(p[1]) for p in found])
        several = np.concatenate([p[2] for p in found]) > 0
        often = np.concatenate([p[3] for p in found]).astype(np.int64)
        order = np.argsort(g, kind="stable")
        first = runs(g[order])
        many = np.logical_or.reduceat(several[order], first) | (np.diff(np.append(first, len(g))) > 1)
        size = np.diff(np.append(first, len(g)))
        at = order[np.repeat(many, size)]
        heavy = np.repeat((np.add.reduceat(often[order], first) > HEAVY)[many], size[many])
        told = []
        for s, i in _split(chunk[at]) if len(at) else ():
            i = i[np.argsort(g[at[i]])]
            told.append((s, g[at[i]], heavy[i]))
        return _table([(s, 1, pack_arrays(differences(x), y)) for s, x, y in told], n=[len(x) for _, x, _ in told])

    return packed.mapInArrow(find, _RUNS).groupBy("shard").applyInArrow(lean(meet), _RUNS + ", n long")


def _segment_keys(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each segment's words, in order."""
    step = np.arange(len(words)) - np.repeat(starts, lengths)
    x = mix(words + (step.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(x, starts) + lengths.astype(U64)) if len(starts) else np.zeros(0, U64)


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(lengths)])
    return np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)


def _told(t: pa.Table) -> tuple[list[pa.BinaryScalar], tuple[np.ndarray, np.ndarray], list[list[np.ndarray]]]:
    """(documents, repeated anchors in order and whether each is heavy, what the index says) of a chunk."""
    by_kind: dict[int, list] = {0: [], 1: [], 3: []}
    for kind, raw in zip(t.column("kind").to_pylist(), t.column("run"), strict=True):
        by_kind[kind].append(raw)
    told = [unpack_arrays(x.as_py()) for x in by_kind[1]]
    anchors, heavy = np.concatenate([np.zeros(0, U64), *(np.cumsum(x) for x, _ in told)]), np.concatenate([np.zeros(0, bool), *(y > 0 for _, y in told)])
    order = np.argsort(anchors)
    return by_kind[0], (anchors[order], heavy[order]), [unpack_arrays(x.as_py()) for x in by_kind[3]]


def _repeated_segments(b: pa.RecordBatch, told: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, document, first word, words, what deals it to a shard, hash) of the segments of a batch whose anchors are among those given, and all words' hashes.

    A segment is dealt by its anchor. Each window of a heavy anchor is a segment of its own, dealt by its own hash, so no shard has all contexts of a frequent run of words."""
    anchors, heavy = told
    w = split_words(b.column(1))
    h, ids = w.hashes(), _ids(b)
    first, number, place, g = window_runs(h, w.row)
    row = w.row[place]
    at = np.minimum(np.searchsorted(anchors, g), max(len(anchors) - 1, 0))
    ok = (anchors[at] == g) & (ids[row] != NO_ID) if len(anchors) else np.zeros(len(g), bool)
    hot = heavy[at[ok]] if len(anchors) else ok[ok]
    times = np.where(hot, number[ok], 1)
    first = _gather(first[ok], times)
    hot = np.repeat(hot, times)
    length = np.where(hot, 1, np.repeat(number[ok], times)) + (WINDOW - 1)
    g, row = np.repeat(g[ok], times), np.repeat(row[ok], times)
    own = h[_gather(first, length)]
    keys = _segment_keys(own, np.cumsum(length) - length, length)
    return row, ids[row], first, length, np.where(hot, keys, g), keys, h


def segments(told: DataFrame, shards: int) -> DataFrame:
    """(shard, kind 2, run) by index shard: a chunk's different segments with the smallest and largest document of each."""

    def cut(t: pa.Table) -> pa.Table:
        documents, anchors, _ = _told(t)
        chunk, kept = t.column("shard")[0].as_py(), []
        if len(anchors[0]):
            for raw in documents:
                for b in unpack_documents(raw):
                    _, doc, first, length, g, key, h = _repeated_segments(b, anchors)
                    kept.append((h[_gather(first, length)], length, g, doc, key))
        rows: list[tuple[int, int, bytes]] = []
        if kept:
            words, length, g, doc, key = (np.concatenate(x) for x in zip(*kept, strict=True))
            starts = np.cumsum(length) - length
            _, one, which = np.unique(key, return_index=True, return_inverse=True)
            low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), NO_ID)
            np.minimum.at(low, which, doc)
            np.maximum.at(high, which, doc)
            if len(one):
                for shard, at in _split((mix(g[one] ^ U64(0x8EBC6AF09C88C6E3)) % U64(shards)).astype(np.int64)):
                    at = at[np.argsort(low[at], kind="stable")]
                    lone = one[at]
                    vocabulary, index = np.unique(words[_gather(starts[lone], length[lone])], return_inverse=True)
                    rows.append((shard, 2, pack_arrays(np.array([chunk]), differences(vocabulary), index, length[lone], differences(low[at].view(U64)), high[at] - low[at])))
        return _table(rows)

    return told.groupBy("shard").applyInArrow(lean(cut), _RUNS)


def earlier_windows(cut: DataFrame) -> DataFrame:
    """(shard, kind 3, run) by chunk: segments (hash, windows) with the smallest document of each of their windows, where that is smaller than
    the chunk's largest document with the segment."""

    def index(t: pa.Table) -> pa.Table:
        words, lengths, lows, highs, chunks = [], [], [], [], []
        for raw in t.column("run"):
            c, v, i, n, low, more = unpack_arrays(raw.as_py())
            words.append(np.cumsum(v)[i.astype(np.int64)])
            lengths.append(n.astype(np.int64))
            lows.append(np.cumsum(low).view(np.int64))
            highs.append(lows[-1] + more.view(np.int64))
            chunks.append(np.full(len(n), c.view(np.int64)[0]))
        words, lengths, lows, highs, chunks = (np.concatenate(x) for x in (words, lengths, lows, highs, chunks))
        begin = np.cumsum(lengths) - lengths
        # equal segments of different chunks are one text of the index, owned by the smallest document
        keys, one, which = np.unique(_segment_keys(words, begin, lengths), return_index=True, return_inverse=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, which, lows)
        size = lengths[one]
        vocabulary, symbols = np.unique(words[_gather(begin[one], size)], return_inverse=True)
        text = np.zeros(int(size.sum()) + len(one), np.int64)
        first = np.cumsum(size + 1) - (size + 1)
        text[_gather(first, size)] = symbols + 1
        windows = size - (WINDOW - 1)
        at = np.cumsum(windows) - windows
        found = np.full(int(windows.sum()), NOWHERE)

        def indexed(some: np.ndarray) -> FmIndex:
            own = text[_gather(first[some], size[some] + 1)]
            return FmIndex(own, len(vocabulary) + 1, np.repeat(least[some], size[some] + 1), WINDOW)

        def stream(index: FmIndex, some: np.ndarray) -> None:
            """Windows of segments that are still open take the least document that the index has for them."""
            place = _gather(at[some], windows[some])
            found[place] = np.minimum(found[place], index.match(text, first[some], size[some]))

        # the earlier half of the segments is indexed and the later half streamed against it: windows that match have their least document there, as no
        # later segment has a smaller one; those that do not match are open, and segments with such windows are indexed themselves
        rank = np.argsort(least, kind="stable")
        early, late = rank[: len(rank) // 2], rank[len(rank) // 2 :]
        if len(early):
            index_ = indexed(early)
            stream(index_, early)
            stream(index_, late)
            del index_
        late = late[np.maximum.reduceat(found, at)[late] == NOWHERE]
        if len(late):
            stream(indexed(late), late)
        tell = np.flatnonzero(np.minimum.reduceat(found, at)[which] < highs)
        rows: list[tuple[int, int, bytes]] = []
        if len(tell):
            for chunk, i in _split(chunks[tell]):
                of = np.sort(which[tell[i]])
                rows.append((chunk, 3, pack_arrays(differences(keys[of]), windows[of], np.diff(found[_gather(at[of], windows[of])].view(U64), prepend=U64(0)))))
        return _table(rows)

    return cut.groupBy("shard").applyInArrow(lean(index), _RUNS)


def _covered(b: pa.RecordBatch, anchors: tuple[np.ndarray, np.ndarray], keys: np.ndarray, begin: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each word of a batch, whether a window that an earlier document has covers it."""
    _, doc, first, length, _, key, h = _repeated_segments(b, anchors)
    change = np.zeros(len(h) + 1, np.int64)
    at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
    hit = np.flatnonzero(keys[at] == key) if len(keys) else np.zeros(0, np.int64)
    number = length[hit] - (WINDOW - 1)
    window = _gather(first[hit], number)
    gone = window[least[_gather(begin[at[hit]], number)] < np.repeat(doc[hit], number)]
    np.add.at(change, gone, 1)
    np.add.at(change, gone + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """(also..., doc_id, n_words, n_removed, kept_sha256, spans[, kept_text]) of each row of documents; also: columns to carry.

    spans: the (first word, end word) ranges removed. kept_text: the kept words joined by a space, or the text as it was
    where nothing goes. Every word of every text counts, a document of fewer than WINDOW words loses nothing."""
    spark = documents.sparkSession
    carried = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(also)))
    packed = staged(pack_documents(carried), "chunks")
    size = documents.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    anchors = staged(repeated_anchors(packed, max(2 * partitions(spark), size // (16 << 20))), "anchors")
    places = anchors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = packed.union(anchors.select("shard", "kind", "run"))
    cut = segments(told, max(2 * partitions(spark), places * (2 * WINDOW - ANCHOR) // SHARD_WORDS))
    windows = staged(earlier_windows(cut), "earlier-windows")

    def remove(t: pa.Table) -> pa.Table:
        documents_, anchors_, parts = _told(t)
        keys = np.concatenate([np.zeros(0, U64), *(np.cumsum(p[0]) for p in parts)])
        number = np.concatenate([np.zeros(0, np.int64), *(p[1].astype(np.int64) for p in parts)])
        least = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(p[2]).view(np.int64) for p in parts)])
        order = np.argsort(keys, kind="stable")
        begin = (np.cumsum(number) - number)[order]
        keys = keys[order]
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text")}
        rest: list[pa.RecordBatch] = []
        for b in (b for raw in documents_ for b in unpack_documents(raw)):
            rest.append(b.select(list(range(2, b.num_columns))))
            gone_words = _covered(b, anchors_, keys, begin, least) if len(keys) else None
            at = 0
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                kept = words = raw.split()  # bytes split at exactly 0x20 and 0x09 to 0x0D
                mask = gone_words[at : at + len(words)] if gone_words is not None else None
                at += len(words)
                gone: list[tuple[int, int]] = []
                if mask is not None and mask.any():
                    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
                    gone = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                    kept = list(compress(words, (~mask).tolist()))
                joined = b" ".join(kept)
                out["doc_id"].append(i)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                out["spans"].append([{"start": a, "stop": z} for a, z in gone])
                out["kept_text"].append((joined.decode() if gone else x.as_py()) if with_text else None)
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), "kept_text": pa.string()}
        found = [pa.array(v, types[k]) for k, v in out.items()]
        columns = [pa.Table.from_batches(rest).column(k) for k in range(len(also))] if also else []
        return pa.table([*columns, *found], names=names)

    from pyspark.sql.types import StructType, _parse_datatype_string

    fields = carried.schema.fields[2:]
    schema = StructType([*fields, *_parse_datatype_string("doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>, kept_text string").fields])
    names = schema.names
    done = told.union(windows).groupBy("shard").applyInArrow(lean(remove), schema)
    results = ["n_words", "n_removed", "kept_sha256", "spans", *(["kept_text"] if with_text else [])]
    return done.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(also)), F.col("doc_id").alias(doc_id), *results)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
m AS (SELECT g, min(doc_id) AS least FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM x JOIN m USING (g) WHERE doc_id > least),
k AS (SELECT doc_id, p, w FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN r USING (doc_id, p)),
t AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept FROM k GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
