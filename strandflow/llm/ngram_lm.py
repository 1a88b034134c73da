"""Interpolated modified Kneser-Ney n-gram model of any order from two: counted in Spark, stored as sorted hash arrays, memory-mapped for scoring.

Counting. A task hashes its training tokens, merges equal n-grams of a run and sends packed runs to shards. A gram's shard follows from
its last context word, so a shard has whole contexts and whole lower levels of its grams. A word whose share of the text is
above a shard's (`Frequent`) is spread over several shards by the word before it; then only its pairs, the lowest level, are
partial, and their sums go to word shards with the continuation counts of words. Shards of about SHARD_BYTES of text are merged one after another
and appended to files of about FILE_BYTES of text, so neither memory nor the number of files grows with a file. The driver sees sums, and
at most COMMON rows of frequent words.

Stored keys. A table's keys are sorted 64-bit hashes: an index by their leading bits and the next 40 bits of each. So about 55 bits
count, and a lookup takes a strange key for a known one with a probability of about 3e-11. Grams that occur once have no counts beside them.

Scoring. Workers map the files and look up a slice's sorted hashes shard by shard.

    p_k(v | u) = max(a(uv) - D_k(a(uv)), 0) / a(u) + (D_k1 n1(u) + D_k2 n2(u) + D_k3 n3+(u)) / a(u) * p_k-1(v | u less its first word)
    p_1(v)     = max(k(v) - E(k(v)), 0) / K + (sum of the E taken) / K * 1 / (V + 1)

with a(uv) the count of an n-gram at the highest level, and below it the number of different words before uv (the count where uv starts a
text, as BEGIN alone comes before it); a(u) the sum of a(uv), n1, n2, n3+ the context's followers with a of one, two or more, k(v) the
number of different words before v, K their sum, and D, E the modified Kneser-Ney discounts of each level. A text starts after
as many BEGIN as a context has words. An unseen context leaves the level below; an unseen token has the uniform share of V tokens and one unknown.

Rows with a null doc_id are not held out and are trained on; repeated rows count each; columns other than those named are not read.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, differences, lean, mix, new_path, pack_arrays, partitions, runs, slices, split_words, staged, table, unpack_arrays
from .labelled import remainder
from .warc import open_fs

ORDER = 3
HELD, SHARD_BYTES, FILE_BYTES, WORD_BYTES, SAMPLE_BYTES = 4_000_000, 4 << 20, 256 << 20, 128 << 20, 16 << 20
COMMON, RARE, FULL = 65_535, 0xFFFF, 255
#: What most rows of a table have, by its number of columns: grams seen once, contexts of one such gram, and words with one of each.
PATTERN = {1: (1,), 4: (1, 1, 0, 0), 6: (1, 1, 0, 0, 1, 1)}
BEGIN, END = U64(0x51A7B05E00000001), U64(0x51A7E0D500000002)
_LOW40 = U64((1 << 40) - 1)


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * U64(0xD1342543DE82EF95) + v)


def token_grams(w: Words, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(context words from the farthest to the last, token, row) of each text's words and then END; before a text is BEGIN."""
    h = w.hashes()
    rows = len(w.first) - 1
    ends = w.first[1:] + np.arange(rows)
    v = np.empty(len(h) + rows, U64)
    v[ends] = END
    inner = np.ones(len(v), bool)
    inner[ends] = False
    v[inner] = h
    starts = np.concatenate([[0], ends[:-1] + 1]) if rows else []
    cols = [v]
    for _ in range(order - 1):
        u = np.empty(len(v), U64)
        u[1:] = cols[0][:-1]
        u[starts] = BEGIN
        cols.insert(0, u)
    return cols[:-1], v, np.repeat(np.arange(rows), w.counts + 1)


def context(words: list[np.ndarray]) -> np.ndarray:
    """A hash of a context's words; a single word stands for itself."""
    c = words[0]
    for x in words[1:]:
        c = pair_hash(c, x)
    return c


def merged(words: list[np.ndarray], v: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(context words, context, token, summed count) of the different grams, in order of context and token."""
    c = context(words)
    order = np.lexsort((v, c))
    c, v, n = c[order], v[order], n[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return [x[order[at]] for x in words], c[at], v[at], np.add.reduceat(n, at) if len(at) else n


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float, float]:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more; where a formula has no support the absolute discount Y serves."""
    y = n1 / (n1 + 2 * n2) if n1 > 0 and n2 > 0 else 0.5
    d = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        x = k - (k + 1) * y * b / a if a > 0 else y
        d.append(x if 0 < x < k else y)
    return tuple(d)


def tally(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def of_context(n: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """(sum, ones, twos, threes and more) of the runs of n that begin at first."""
    return [np.add.reduceat(x, first) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64))]


# --- frequent words: codes of two bytes in packed runs, and the words to spread ------------------


class Frequent:
    """The COMMON most frequent words of a bounded sample of the text. They give packed runs codes of two bytes and say which words are spread
    over how many shards; sizes and balance depend on it, no count does."""

    def __init__(self, hashes: list[int], counts: list[int], total: int, shards: int) -> None:
        self.by_code = np.array(hashes, np.int64).view(U64)
        order = np.argsort(self.by_code)
        self.hashes, self.code, self.shards = self.by_code[order], order.astype(np.uint16), shards
        spread = np.ceil(np.array(counts, float)[order] / max(total, 1) * shards).astype(np.int64)
        self.hot, self.spread = self.hashes[spread > 1], spread[spread > 1]

    def codes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), RARE, np.uint16)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.code[at], np.uint16(RARE))

    def hot_number(self, h: np.ndarray) -> np.ndarray:
        """The number of each spread word, -1 for the others."""
        if not len(self.hot):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return np.where(self.hot[at] == h, at, -1)

    def shard_of(self, last: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Shards by the last context word; of spread words by the word `other` too."""
        shard = (mix(last ^ U64(0xA5A3564E4A1F2C3B)) % U64(self.shards)).astype(np.int64)
        hot = self.hot_number(last)
        at = np.flatnonzero(hot >= 0)
        step = mix(other[at] ^ U64(0x3C6EF372FE94F82B)) % self.spread[hot[at]].astype(U64)
        shard[at] = (shard[at] + step.astype(np.int64)) % self.shards
        return shard


def frequent_words(rows: DataFrame, size: int, shards: int) -> Frequent:
    """rows: (text). Counts a sample of about SAMPLE_BYTES of whole texts, chosen by their hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 0, 8 << 20):
                w = split_words(b.column(0), lower=True)
                h, n = np.unique(np.concatenate([w.hashes(), np.repeat([BEGIN, END], b.num_rows)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    steps = 1 << 24
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(steps)) < int(min(1.0, SAMPLE_BYTES / max(size, 1)) * steps))
    counts = staged(picked.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-frequent")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).collect()
    return Frequent([r["word"] for r in top], [r["n"] for r in top], total, shards)


def pack_grams(frequent: Frequent, words: list[np.ndarray], n: np.ndarray) -> bytes:
    """Grams in order of the codes of their last context word, the words before it and the token; rare words' hashes follow."""
    codes = [frequent.codes(x) for x in words]
    by = np.lexsort((codes[-1], *codes[:-1]))
    codes, words, n = [c[by] for c in codes], [x[by] for x in words], n[by]
    rare = [x[c == RARE] for c, x in zip(codes, words, strict=True)]
    high = n[n >= FULL]
    head = np.array([len(n), len(high), *map(len, rare)], np.int64)
    codes[-2] = np.diff(codes[-2], prepend=np.uint16(0))
    planes = [np.ascontiguousarray(c.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes() for c in codes]
    raw = b"".join([head.tobytes(), *planes, np.minimum(n, FULL).astype(np.uint8).tobytes(), high.astype(np.int64).tobytes(), *(r.tobytes() for r in rare)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_grams(frequent: Frequent, raw: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    m, top, *rare = np.frombuffer(raw, np.int64, 2 + order).tolist()
    at = 8 * (2 + order)
    codes = []
    for k in range(order):
        c = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 2 * m, at).reshape(2, m).T).view("<u2").ravel()
        codes.append(np.cumsum(c, dtype=np.uint16) if k == order - 2 else c)
        at += 2 * m
    n = np.frombuffer(raw, np.uint8, m, at).astype(np.int64)
    at += m
    n[n == FULL] = np.frombuffer(raw, np.int64, top, at)
    at += 8 * top
    words = []
    for c, r in zip(codes, rare, strict=True):
        known = c != RARE
        w = np.empty(m, U64)
        w[known] = frequent.by_code[c[known]]
        w[~known] = np.frombuffer(raw, U64, r, at)
        at += 8 * r
        words.append(w)
    return words, n


# --- files of tables -----------------------------------------------------------------------------


def _bits(n: int) -> int:
    """Leading bits of the index of n keys: about 16 keys each."""
    return min(24, max(0, (n >> 4).bit_length() - 1))


class Writer:
    """A file of named tables: sections, then a JSON index of their places and its length. A retried task replaces the file whole."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = open_fs(folder)
        self.fs.create_dir(root, recursive=True)
        self.tmp, self.path = f"{root}/.{name}.{uuid.uuid4().hex}", f"{root}/{name}"
        self.out, self.at, self.index = self.fs.open_output_stream(self.tmp, compression=None), 0, {}

    def put(self, raw: bytes) -> int:
        """Writes bytes, eight more for reads past the end and the padding to eight; gives their place."""
        at = self.at
        raw += b"\0" * (8 + -len(raw) % 8)
        self.out.write(raw)
        self.at += len(raw)
        return at

    def keys(self, keys: np.ndarray) -> list[int]:
        b = _bits(len(keys))
        bucket = (keys >> U64(64 - b)).astype(np.int64) if b else np.zeros(len(keys), np.int64)
        index = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1 << b))]).astype(np.uint32)
        rest = ((keys << U64(b)) >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        return [len(keys), self.put(index.tobytes()), self.put(rest.tobytes())]

    def counts(self, name: str, keys: np.ndarray, cols: list[np.ndarray]) -> None:
        """Sorted keys with columns: first the keys whose columns are the table's PATTERN, then the others with a byte a column; where that does
        not hold a column, FULL stands in the first one and the row's values lie apart with their places."""
        plain = np.ones(len(keys), bool)
        for c, x in zip(cols, PATTERN[len(cols)], strict=True):
            plain &= c == x
        cols = [c[~plain] for c in cols]
        large = np.zeros(len(cols[0]), bool)
        for c in cols:
            large |= c >= FULL
        high = np.flatnonzero(large)
        more = [self.put(np.where(large, FULL, c).astype(np.uint8).tobytes()) for c in cols]
        self.index[name] = [self.keys(keys[plain]), self.keys(keys[~plain]), more, [len(high), self.put(high.astype(np.int64).tobytes())], [self.put(c[high].astype(np.int64).tobytes()) for c in cols]]

    def close(self) -> None:
        raw = json.dumps(self.index).encode()
        self.out.write(raw + len(raw).to_bytes(8, "little"))
        self.out.close()
        self.fs.move(self.tmp, self.path)


class Reader:
    """Memory-maps a file of a Writer; of a remote store's file, a copy that is gone once it is mapped."""

    def __init__(self, folder: str, name: str) -> None:
        fs, root = open_fs(folder)
        path, copy = f"{root}/{name}", None
        if fs.type_name != "local":
            copy = tempfile.NamedTemporaryFile()
            with fs.open_input_stream(path, compression=None) as f:
                while chunk := f.read(1 << 20):
                    copy.write(chunk)
            copy.flush()
            path = copy.name
        self.raw = np.memmap(path, np.uint8, "r")
        if copy:
            copy.close()
        size = int.from_bytes(self.raw[-8:].tobytes(), "little")
        self.index = json.loads(self.raw[-8 - size : -8].tobytes())

    def _array(self, kind: type, n: int, at: int) -> np.ndarray:
        return self.raw[at : at + n * np.dtype(kind).itemsize].view(kind)

    def _find(self, keys: list[int], h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is not."""
        n, at, rest = keys
        if not n:
            return np.full(len(h), -1)
        b = _bits(n)
        index = self._array(np.uint32, (1 << b) + 1, at)
        bucket = (h >> U64(64 - b)).astype(np.int64) if b else np.zeros(len(h), np.int64)
        lo, end = index[bucket].astype(np.int64), index[bucket + 1].astype(np.int64)
        five = np.ndarray((n,), "<u8", self.raw, rest, (5,))  # eight bytes from each key on, of which five are its own
        want = (h << U64(b)) >> U64(24)
        hi = end.copy()
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            less = (lo < hi) & ((five[np.minimum(mid, n - 1)] & _LOW40) < want)
            hi = np.where(less, hi, mid)
            lo = np.where(less, mid + 1, lo)
            hi = np.maximum(hi, lo)
        ok = (lo < end) & ((five[np.minimum(lo, n - 1)] & _LOW40) == want)
        return np.where(ok, lo, -1)

    def counts(self, name: str, h: np.ndarray, columns: int) -> np.ndarray:
        """The columns of hashes; zeros where a hash is not."""
        out = np.zeros((len(h), columns), np.int64)
        if name not in self.index:
            return out
        one, more, cols, (high, places), values = self.index[name]
        at = self._find(more, h)
        hit = np.flatnonzero(at >= 0)
        for k, c in enumerate(cols):
            out[hit, k] = self._array(np.uint8, more[0], c)[at[hit]]
        if high and len(top := np.flatnonzero(out[hit, 0] == FULL)):
            i = np.searchsorted(self._array(np.int64, high, places), at[hit[top]])
            for k, v in enumerate(values):
                out[hit[top], k] = self._array(np.int64, high, v)[i]
        rest = np.flatnonzero(at < 0)
        out[rest[self._find(one, h[rest]) >= 0]] = PATTERN[columns]
        return out


def word_shard_of(h: np.ndarray, word_shards: int) -> np.ndarray:
    return ((h >> U64(24)) % U64(word_shards)).astype(np.int64)


def by_key(key: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of each different key, places in order of h."""
    order = np.lexsort((h, key))
    bounds = np.concatenate([runs(key[order]), [len(key)]])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(key[order[a]]), order[a:b]


class Model:
    """Where the tables are and the sums that scores need; its size does not depend on the text's, so it travels with a task."""

    def __init__(self, folder: str, order: int, frequent: Frequent, files: int, word_shards: int, hot_stats: np.ndarray, d: dict, e: tuple, tokens: int, kinds: int, pairs: int, freed: float) -> None:
        self.folder, self.order, self.frequent, self.files, self.word_shards, self.hot_stats = folder, order, frequent, files, word_shards, hot_stats
        self.d, self.e, self.tokens, self.kinds, self.pairs, self.freed = {k: np.array(x) for k, x in d.items()}, np.array(e), tokens, kinds, pairs, freed
        self.open: dict[str, Reader] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _reader(self, name: str) -> Reader:
        if name not in self.open:
            if len(self.open) >= 1024:
                self.open.clear()
            self.open[name] = Reader(self.folder, name)
        return self.open[name]

    def _shards(self, shard: np.ndarray, h: np.ndarray) -> Iterator[tuple[Reader, int, np.ndarray]]:
        for s, at in by_key(shard, h):
            yield self._reader(f"grams-{s % self.files}"), s, at

    def grams(self, level: int, c: np.ndarray, last: np.ndarray, other: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts of tokens after contexts, the contexts' (sum, n1, n2, n3+)) of a level above two."""
        h = pair_hash(c, v)
        n, stats = np.zeros(len(h), np.int64), np.zeros((len(h), 4), np.int64)
        for r, s, at in self._shards(self.frequent.shard_of(last, other), h):
            kinds, which = np.unique(c[at], return_inverse=True)
            stats[at] = r.counts(f"c{level}/{s}", kinds, 4)[which]
            known = at[stats[at, 0] > 0]
            n[known] = r.counts(f"g{level}/{s}", h[known], 1)[:, 0]
        return n, stats

    def word_pairs(self, last: np.ndarray, v: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the level two; words: what `words` gives of last."""
        h, hot = pair_hash(last, v), self.frequent.hot_number(last)
        n, stats = np.zeros(len(h), np.int64), words[:, :4].copy()
        spread = np.flatnonzero(hot >= 0)
        stats[spread] = self.hot_stats[hot[spread]]
        for s, at in by_key(word_shard_of(v[spread], self.word_shards), h[spread]):
            n[spread[at]] = self._reader(f"words-{s}").counts("hot", h[spread[at]], 1)[:, 0]
        rest = np.flatnonzero(hot < 0)
        for r, s, at in self._shards(self.frequent.shard_of(last[rest], v[rest]), h[rest]):
            n[rest[at]] = r.counts(f"g2/{s}", h[rest[at]], 1)[:, 0]
        return n, stats

    def words(self, h: np.ndarray) -> np.ndarray:
        """Rows (sum as a context, n1, n2, n3+, continuations, count as a token) of hashes."""
        out = np.zeros((len(h), 6), np.int64)
        for s, at in by_key(word_shard_of(h, self.word_shards), h):
            out[at] = self._reader(f"words-{s}").counts("words", h[at], 6)
        return out


# --- counting ------------------------------------------------------------------------------------


def summed(keys: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different keys in order, with their columns' sums."""
    by = np.argsort(keys, kind="stable")
    first = runs(keys[by]) if len(keys) else np.zeros(0, np.int64)
    return keys[by][first], [np.add.reduceat(c[by], first) if len(first) else c for c in cols]


def merge_shards(frequent: Frequent, folder: str, order: int, word_shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (file, shard, run) in this order: writes each file, gives (to, run, facts): partial sums of words and spread pairs by word
    shard, and with the first of them the tallies of the counts by level."""

    def shard(writer: Writer, number: int, held: list[bytes]) -> tuple[list[int], np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(facts, words, their six columns, spread pairs' (number, token, count))"""
        words, n = zip(*(unpack_grams(frequent, x, order) for x in held), strict=True)
        *u, v = (np.concatenate(x) for x in zip(*words, strict=True))
        u, c, v, n = merged(u, v, np.concatenate(n))
        seen_words, which = np.unique(v, return_inverse=True)
        seen = np.bincount(which, n, len(seen_words)).astype(np.int64)
        facts = []
        for level in range(order, 2, -1):
            h = pair_hash(c, v)
            by = np.argsort(h)
            writer.counts(f"g{level}/{number}", h[by], [n[by]])
            facts += tally(n)
            first = runs(c)
            by = np.argsort(c[first])
            writer.counts(f"c{level}/{number}", c[first][by], [x[by] for x in of_context(n, first)])
            n = np.where(u[1] == BEGIN, n, 1)
            u = u[1:]
            u, c, v, n = merged(u, v, n)
        hot = frequent.hot_number(u[0])
        part = hot >= 0
        pairs = [hot[part], v[part], n[part]]
        u, v, n = u[0][~part], v[~part], n[~part]
        h = pair_hash(u, v)
        by = np.argsort(h)
        writer.counts(f"g2/{number}", h[by], [n[by]])
        facts += tally(n)
        first = runs(u) if len(u) else np.zeros(0, np.int64)
        as_context = of_context(n, first) if len(u) else [np.zeros(0, np.int64)] * 4
        after, times = np.unique(v, return_counts=True)
        keys = np.unique(np.concatenate([u[first], seen_words]))
        cols = [np.zeros(len(keys), np.int64) for _ in range(6)]
        for k, x in enumerate(as_context):
            cols[k][np.searchsorted(keys, u[first])] = x
        cols[4][np.searchsorted(keys, after)] = times
        cols[5][np.searchsorted(keys, seen_words)] = seen
        return facts, keys, cols, pairs

    def send(words: list, pairs: list, facts: list[int]) -> pa.RecordBatch:
        to, blobs = [], []
        keys, cols = summed(np.concatenate([k for k, _ in words]), [np.concatenate(c) for c in zip(*(c for _, c in words), strict=True)])
        number, token, count = (np.concatenate(x) for x in zip(*pairs, strict=True))
        shard_of_pair = word_shard_of(token, word_shards)
        for s, at in by_key(word_shard_of(keys, word_shards), keys):
            mine = np.flatnonzero(shard_of_pair == s)
            mine = mine[np.lexsort((token[mine], number[mine]))]
            to.append(s)
            code = frequent.codes(token[mine])
            blobs.append(zstandard.ZstdCompressor(level=1).compress(pack_arrays(differences(keys[at]), *(c[at] for c in cols), np.diff(number[mine], prepend=0), code, token[mine][code == RARE], count[mine])))
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary()), pa.array([facts, *[None] * (len(to) - 1)], pa.list_(pa.int64()))], names=["to", "run", "facts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, at, held = None, (None, None), []
        words, pairs, facts, size = [], [], np.zeros(4 * (order - 1), np.int64), 0
        rows = ((f, s, r) for b in batches for f, s, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
        for f, s, raw in _with_end(rows):
            if (f, s) != at:
                if held:
                    of_shard, keys, cols, more = shard(writer, at[1], held)
                    held = []
                    facts += np.array(of_shard)
                    words.append((keys, cols))
                    pairs.append(more)
                    size += len(keys) + len(more[0])
                    if size > 1_000_000:
                        yield send(words, pairs, facts.tolist())
                        words, pairs, facts, size = [], [], np.zeros(4 * (order - 1), np.int64), 0
                if f != at[0]:
                    if writer:
                        writer.close()
                    writer = Writer(folder, f"grams-{f}") if f is not None else None
                at = (f, s)
            if raw is not None and raw.is_valid:
                held.append(raw.as_py())
        if words:
            yield send(words, pairs, facts.tolist())

    return run


def _with_end(rows: Iterator) -> Iterator:
    """The rows, then one that ends the last file."""
    yield from rows
    yield None, None, None


def merge_words(frequent: Frequent, folder: str, of_grams: int) -> Callable[[pa.Table], pa.Table]:
    """Writes a word shard; gives its sums and the tallies it was told (facts) and, for each spread word, its share of that word's (sum, n1, n2, n3+)."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpack_arrays(zstandard.ZstdDecompressor().decompress(x.as_py())) for x in t.column("run") if x.is_valid]
        none = np.zeros(0, np.int64)
        keys = np.concatenate([np.zeros(0, U64), *(np.cumsum(p[0]) for p in parts)])
        keys, cols = summed(keys, [np.concatenate([none, *(p[k].astype(np.int64) for p in parts)]) for k in range(1, 7)])
        number = np.concatenate([none, *(np.cumsum(p[7]).astype(np.int64) for p in parts)])
        tokens = []
        for p in parts:
            code = p[8].astype(np.int64)
            token = np.empty(len(code), U64)
            token[code != RARE] = frequent.by_code[code[code != RARE]]
            token[code == RARE] = p[9]
            tokens.append(token)
        token, count = np.concatenate([np.zeros(0, U64), *tokens]), np.concatenate([none, *(p[10].astype(np.int64) for p in parts)])
        by = np.lexsort((token, number))
        number, token, count = number[by], token[by], count[by]
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (token[1:] != token[:-1])
        first = np.flatnonzero(new)
        number, token, n = number[first], token[first], np.add.reduceat(count, first) if len(first) else count
        after, times = np.unique(token, return_counts=True)
        cols[4][np.searchsorted(keys, after)] += times
        h = pair_hash(frequent.hot[number], token)
        by = np.argsort(h)
        w = Writer(folder, f"words-{t.column('to')[0].as_py()}")
        w.counts("words", keys, cols)
        w.counts("hot", h[by], [n[by]])
        w.close()
        told = np.zeros(of_grams, np.int64)
        for x in t.column("facts").to_pylist():
            told += np.array(x or [0] * of_grams)
        told[-4:] += tally(n)
        facts = [int(cols[5].sum()), int(cols[4].sum()), int((cols[4] > 0).sum()), *tally(cols[4]), *told.tolist()]
        first = runs(number) if len(number) else none
        stats = np.column_stack(of_context(n, first)) if len(number) else np.zeros((0, 4), np.int64)
        return pa.table({"hot": pa.array([None, *number[first].tolist()], pa.int32()), "facts": pa.array([facts, *stats.tolist()], pa.list_(pa.int64()))})

    return run


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep=None, order: int = ORDER) -> Model:
    """The model of the rows of documents for which the column `keep` holds (all rows if None). Null texts are empty."""
    if order < 2:
        raise ValueError("an order of two at least")
    spark = documents.sparkSession
    rows = documents if keep is None else documents.where(keep)
    rows = rows.select(F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(2 * partitions(spark), -(-size // SHARD_BYTES))
    files, word_shards = max(partitions(spark), -(-size // FILE_BYTES)), max(partitions(spark), -(-size // WORD_BYTES))
    frequent = frequent_words(rows, size, shards)
    folder = new_path(spark, "lm")
    hold = HELD // order  # as many words whatever the order

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            *u, v = (np.concatenate(x) for x in zip(*grams, strict=True))
            grams.clear()
            u, _, v, n = merged(u, v, np.ones(len(v), np.int64))
            shard = frequent.shard_of(u[-1], u[-2] if order > 2 else v)
            ids, blobs, total = [], [], 0
            for s, at in by_key(shard, v):
                blobs.append(pack_grams(frequent, [*(x[at] for x in u), v[at]], n[at]))
                ids.append(s)
                total += len(blobs[-1])
                if total > 8 << 20:
                    yield batch_of(ids, blobs)
                    ids, blobs, total = [], [], 0
            if ids:
                yield batch_of(ids, blobs)

        for batch in batches:
            for b in slices(batch, 0, 2 << 20):
                u, v, _ = token_grams(split_words(b.column(0), lower=True), order)
                for at in range(0, len(v), hold):  # a very long text too
                    grams.append([x[at : at + hold] for x in (*u, v)])
                    held += len(grams[-1][-1])
                    if held >= hold:
                        yield from send()
                        held = 0
        if grams:
            yield from send()

    def batch_of(ids: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s % files for s in ids], pa.int32()), pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["file", "shard", "run"])

    every = lambda n, *more: spark.range(n).select(F.col("id").cast("int"), *more)  # noqa: E731  # so that a file without a run exists too
    sent = rows.mapInArrow(count, "file int, shard int, run binary").union(every(files, F.lit(-1), F.lit(None).cast("binary")))
    parts = sent.repartition(files, "file").sortWithinPartitions("file", "shard").mapInArrow(merge_shards(frequent, folder, order, word_shards), "to int, run binary, facts array<long>")
    tallies = 4 * (order - 1)
    parts = parts.union(every(word_shards, F.lit(None).cast("binary"), F.lit(None).cast("array<long>")))
    words = staged(parts.groupBy("to").applyInArrow(lean(merge_words(frequent, folder, tallies)), "hot int, facts array<long>"), "lm-words")
    sums = words.where("hot is null").agg(*(F.coalesce(F.sum(F.col("facts")[k]), F.lit(0)) for k in range(7 + tallies))).first()
    tokens, pairs, kinds, *rest = sums
    m, of_grams = rest[:4], rest[4:]
    hot_stats = np.zeros((len(frequent.hot), 4), np.int64)
    for r in words.where("hot is not null").groupBy("hot").agg(*(F.sum(F.col("facts")[k]).alias(f"s{k}") for k in range(4))).collect():  # COMMON rows at most
        hot_stats[r["hot"]] = r[1:]
    d = {level: discounts(*of_grams[4 * k : 4 * k + 4]) for k, level in enumerate(range(order, 1, -1))}
    e = discounts(*m)
    freed = e[1] * m[0] + e[2] * m[1] + e[3] * (kinds - m[0] - m[1])
    return Model(folder, order, frequent, files, word_shards, hot_stats, d, e, tokens, kinds, pairs, freed)


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also..., n_tokens, n_known, base_score, score) of each row: log10 probabilities of its whole text.

    Null and empty texts are one END token. An empty model gives every token the share 1 / (V + 1) = 1."""
    uniform = 1.0 / (model.kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 0, 4 << 20):
                u, v, row = token_grams(split_words(b.column(0), lower=True), model.order)
                last = u[-1]
                keys, inverse = np.unique(np.concatenate([last, v]), return_inverse=True)
                w = model.words(keys)
                iu, iv = inverse[: len(v)], inverse[len(v) :]
                k = w[:, 4]
                back = (np.maximum(k - model.e[np.minimum(k, 3)], 0) + model.freed * uniform) / model.pairs if model.pairs else np.full(len(keys), uniform)
                p = back[iv]
                for level in range(2, model.order + 1):
                    d = model.d[level]
                    n, stats = model.word_pairs(last, v, w[iu]) if level == 2 else model.grams(level, context(u[-(level - 1) :]), last, u[-2], v)
                    cu = stats[:, 0]
                    p = np.where(cu > 0, (np.maximum(n - d[np.minimum(n, 3)], 0) + stats[:, 1:] @ d[1:] * p) / np.maximum(cu, 1), p)
                rows = b.num_rows
                cv = w[iv, 5]
                base = np.bincount(row, np.log10((cv + 1.0) / (model.tokens + model.kinds + 1.0)), rows)
                total = np.bincount(row, np.log10(p), rows)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.bincount(row, minlength=rows)), pa.array(np.bincount(row, cv > 0, rows).astype(np.int64)), pa.array(base), pa.array(total)], names=[*b.schema.names[1:], "n_tokens", "n_known", "base_score", "score"])

    from pyspark.sql.types import DoubleType, LongType, StructType

    given = documents.select(F.col(text).alias("text"), doc_id, *also)
    schema = StructType(given.schema.fields[1:])
    for name, kind in (("n_tokens", LongType()), ("n_known", LongType()), ("base_score", DoubleType()), ("score", DoubleType())):
        schema = schema.add(name, kind)
    return given.mapInArrow(run, schema)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    model = train(docs, keep=~F.col("held_out"))
    return score(docs, model, also=("held_out",)).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
