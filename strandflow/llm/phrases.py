"""Phrase collocation mining: candidates by count-min sketches, exact counts of the survivors, scores, subsumption.

The first pass counts hashed word runs of one to `longest` words into count-min sketches. A hash's top bits choose its shard, a sketch of its own of
DEPTH rows; tasks send the cells that they touched, shards add them up, and as sums only ask whether a count reaches the support, a merged shard is one bit a
cell. The second pass keeps runs whose cells all have their bit: a sketch never counts too little, so every run with the support is among them, and the few
others go when survivors are counted exactly, by their own words. The number of shards grows with the corpus; workers map the shards that they look up.

All counts are per language; a null language is `und`. Null and empty texts have no words. Repeated rows count again; ids are not read, so null or
repeated ones change nothing; an empty table gives no rows; other columns than the text and the language are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.operators import scan

from .common import _LOWER, U64, Words, give_back, lean, mix, new_path, ngrams, slices, staged, table
from .ngram_lm import open_fs

SUPPORT, LONGEST, SUBSUME, TOP = 10, 3, 50, 2000
CELL_BITS, DEPTH = 20, 2  # cells of a sketch's row, rows of a shard
LOAD = 3  # word runs for each cell of a row, at most, unless MAX_SHARDS forbids
MAX_SHARDS = 1 << 15  # 8 GB of bits; beyond, more rare runs survive to be counted exactly
_FLUSH = 1 << 21  # cells that a task gathers before it sends them
_UNIT = 4 << 20  # bytes of text of which survivors are tallied together
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False


@dataclass
class Runs:
    """Runs of `k` words within pieces: the hash of each and its first word."""

    k: int
    hashes: np.ndarray
    first: np.ndarray


def piece_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Lower-case words of each text, and for each word the number of its piece, which differs between texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = _LOWER[np.frombuffer(buf, np.uint8)[off[0] : off[-1]]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True  # a text's first byte
    inside = _INSIDE[data]
    begin = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
    stop = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    return Words(data, start, end, row, first), np.cumsum(_BREAK[data])[start] + row if len(start) else row.astype(np.int64)


def word_runs(words: Words, piece: np.ndarray, langs: np.ndarray, longest: int) -> Iterator[Runs]:
    """All runs of 1 to `longest` words; `langs` has the hash of each row's language."""
    h = words.hashes() ^ langs[words.row]
    for k in range(1, longest + 1):
        first = np.flatnonzero(piece[k - 1 :] == piece[: max(len(piece) - k + 1, 0)]) if k > 1 else np.arange(len(h))
        yield Runs(k, mix(ngrams(h, k)[first] + U64(k)), first)


def lang_hashes(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language; the hash function of words, on the whole value."""
    plain = langs.cast(pa.large_string())
    off = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    buf = plain.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    return mix(Words(data, off[:-1], off[1:], np.arange(len(langs)), np.arange(len(langs) + 1)).hashes() + U64(1))


def cells(h: np.ndarray, shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The shard of each hash and its cell in each row of that shard, rows one after another."""
    bits = shards.bit_length() - 1
    shard = (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    mask = U64((1 << CELL_BITS) - 1)
    return shard, [((h >> U64(k * CELL_BITS)) & mask).astype(np.int64) + (k << CELL_BITS) for k in range(DEPTH)]


def pack_gaps(places: np.ndarray) -> bytes:
    """Ascending places as bytes of their differences; 255 adds 254 and goes on."""
    gap = np.diff(places, prepend=0)
    more = gap // 254
    ends = np.cumsum(more + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gap - more * 254
    return out.tobytes()


def unpack_gaps(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    last = x != 255
    return np.cumsum(np.where(last, x, 254).astype(np.int64))[last]


def plan_shards(bytes_of_text: int, longest: int) -> int:
    """Shards, a power of two, so that a row's cell has LOAD runs on average; about six bytes are a word."""
    wanted = bytes_of_text * longest / 6 / LOAD / (1 << CELL_BITS)
    shards = 1
    while shards < min(wanted, MAX_SHARDS):
        shards *= 2
    return shards


def sketch(rows: DataFrame, shards: int, support: int, longest: int) -> str:
    """Writes the merged sketches of rows (lang, text) to a folder in the shared one, a file of bits a shard, and returns the folder."""
    spark = rows.sparkSession
    folder = new_path(spark, "phrase-sketch")
    top = min(support, 255)
    kind = np.uint32 if shards << (CELL_BITS + DEPTH - 1) <= 1 << 32 else np.uint64

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for b in slices(batch, 1):
                words, piece = piece_words(b.column(1))
                langs = lang_hashes(b.column(0))
                for r in word_runs(words, piece, langs, longest):
                    shard, at = cells(r.hashes, shards)
                    held += [((shard << (CELL_BITS + DEPTH - 1)) + x).astype(kind) for x in at]
                    n += DEPTH * len(shard)
                if n >= _FLUSH:
                    yield send(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield send(np.concatenate(held))
        give_back()

    def send(x: np.ndarray) -> pa.RecordBatch:
        """A row for each shard of a batch of cells: the cells touched and how often, up to `top`."""
        x.sort()
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        count = np.minimum(np.diff(at, append=len(x)), top).astype(np.uint8)
        cell = x[at].astype(np.int64)
        del at
        shard = cell >> (CELL_BITS + DEPTH - 1)
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        ends = [*cut[1:].tolist(), len(cell)]
        inside = cell & ((1 << (CELL_BITS + DEPTH - 1)) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(shard[cut].astype(np.int32)), pa.array([pack_gaps(inside[a:b]) for a, b in zip(cut.tolist(), ends, strict=True)], pa.binary()), pa.array([count[a:b].tobytes() for a, b in zip(cut.tolist(), ends, strict=True)], pa.binary())], names=["shard", "cells", "counts"]
        )

    def merge(t: pa.Table) -> pa.Table:
        shard, total = t.column("shard")[0].as_py(), np.zeros(DEPTH << CELL_BITS, np.int32)
        for raw, count in zip(t.column("cells"), t.column("counts"), strict=True):
            places = unpack_gaps(raw.as_py())
            total[places] = np.minimum(total[places] + np.frombuffer(count.as_py(), np.uint8), top)
        write_bits(folder, shard, total >= top)
        return pa.table({"shard": pa.array([shard], pa.int32())})

    spark.createDataFrame([], "x int").write.parquet(folder)  # makes the folder
    done = rows.mapInArrow(gather, "shard int, cells binary, counts binary").groupBy("shard").applyInArrow(lean(merge), "shard int")
    with cleaned_shuffles(spark):
        done.write.format("noop").mode("overwrite").save()
    return folder


def write_bits(folder: str, shard: int, bits: np.ndarray) -> None:
    """One file a shard; a task that runs again writes the same bits under a name of its own and moves them into place."""
    import uuid

    fs, root = open_fs(folder)
    name = f"{root}/bits-{shard}"
    own = f"{root}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(np.packbits(bits).tobytes())
    fs.move(own, name)


class Bits:
    """Looks hashes up in the merged sketches; a shard's bits are mapped (of a remote store: read) when first asked for, and are absent where no run fell."""

    def __init__(self, folder: str, shards: int) -> None:
        from pyarrow.fs import FileSelector

        self.fs, self.root = open_fs(folder)
        self.shards, self.maps = shards, {}
        self.files = {f.base_name for f in self.fs.get_file_info(FileSelector(self.root)) if f.base_name.startswith("bits-")}

    def _map(self, shard: int) -> np.ndarray | None:
        if shard not in self.maps:
            name = f"bits-{shard}"
            if name not in self.files:
                self.maps[shard] = None
            elif self.fs.type_name == "local":
                self.maps[shard] = np.memmap(f"{self.root}/{name}", np.uint8, "r")
            else:
                with self.fs.open_input_stream(f"{self.root}/{name}", compression=None) as f:
                    self.maps[shard] = np.frombuffer(f.read(), np.uint8)
        return self.maps[shard]

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether all cells of each of the ascending hashes reach the support."""
        out = np.zeros(len(h), bool)
        shard, at = cells(h, self.shards)
        bounds = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            a, b = bounds[s], bounds[s + 1]
            bits = self._map(s)
            if bits is not None:
                ok = np.ones(b - a, bool)
                for x in at:
                    ok &= (bits[x[a:b] >> 3] >> (7 - (x[a:b] & 7)).astype(np.uint8) & 1).astype(bool)
                out[a:b] = ok
        return out


def survivors(rows: DataFrame, folder: str, shards: int, longest: int) -> DataFrame:
    """(lang, phrase, words, n): exact counts of the runs that the sketches let through, and of all words of a language as the phrase of 0 words."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(folder, shards)
        for batch in batches:
            for b in slices(batch, 1, _UNIT):
                words, piece = piece_words(b.column(1))
                langs = b.column(0).to_pylist()
                raw = words.data.tobytes()
                of_row = np.array(words.counts)
                everything = {}
                for lang, n in zip(langs, of_row.tolist(), strict=True):
                    everything[lang] = everything.get(lang, 0) + n
                yield batch_of(list(everything), [""] * len(everything), 0, list(everything.values()))
                for r in word_runs(words, piece, lang_hashes(b.column(0)), longest):
                    uniq, first, count = np.unique(r.hashes, return_index=True, return_counts=True)
                    keep = bits.has(uniq)
                    at = r.first[first[keep]]
                    spans = [(words.start[at + k].tolist(), words.end[at + k].tolist()) for k in range(r.k)]
                    text = [[raw[s:e] for s, e in zip(*span, strict=True)] for span in spans]
                    said = text[0] if r.k == 1 else list(map(b" ".join, zip(*text, strict=True)))
                    yield batch_of([langs[i] for i in words.row[at].tolist()], [x.decode() for x in said], r.k, count[keep])
        give_back()

    def batch_of(lang: list, phrase: list, k: int, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(np.full(len(lang), k, np.int32)), pa.array(n, pa.int64())], names=["lang", "phrase", "words", "n"])

    found = rows.mapInArrow(tally, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of what is written here as soon as it is written, rather than when the driver forgets it: the sketches' need not lie beside the survivors'."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def counted(documents: DataFrame, support: int = SUPPORT, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, words, n) of all runs of 1 to `longest` words with n >= support, exactly; words = 0 has the number of all words of a language."""
    rows = documents.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = plan_shards(size, longest)
    folder = sketch(rows, shards, support, longest)
    return staged(survivors(rows, folder, shards, longest).where((F.col("n") >= support) | (F.col("words") == 0)), "phrase-counts")


def collocations(counts: DataFrame, support: int = SUPPORT, subsume: int = SUBSUME, per_million: int = 1_000_000) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer one subsumes, from exact counts.

    A phrase's score is that of its weakest cut into two parts with counts l and r: floor(per_million * a * a / (l * r)), in whole numbers of up to 38 digits;
    ties go to the earliest cut. A phrase goes where a longer one that holds it has at least `subsume` hundredths of its count."""
    runs = counts.where("words > 0")
    phrases = runs.where(F.col("words") > 1).where(F.col("n") >= support).withColumn("w", F.split("phrase", " "))
    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cut = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of_left = runs.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    of_right = runs.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    whole = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    both = cut.join(of_left, ["lang", "left"]).join(of_right, ["lang", "right"]).withColumns({"num": F.lit(per_million).cast("decimal(7,0)") * whole["a"] * whole["a"], "den": whole["l"] * whole["r"]})
    scored = both.withColumn("score", F.expr("num div den"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"), F.first("a").alias("a"))
    # every run inside a longer candidate, with the largest count of these
    inner = phrases.where("words > 2").select("lang", "w", "words", F.col("n").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "w", "size", "longer", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = inner.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * subsume))
    total = counts.where("words = 0").select("lang", F.col("n").alias("n"))  # a row for each language
    return left.join(total, "lang").select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"))


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language with their rank. Counts of each score (whole numbers up to a million) tell the least score that a language needs, so only
    phrases from there on are ranked."""
    found = staged(found, "phrases")
    scores = found.groupBy("lang", "score").agg(F.count("*").alias("m"))
    scores = scan.prefix(scores, {"before": ("sum", F.col("m"))}, -scan.number_bucket(F.col("score")), (F.desc("score"),), ("lang",), inclusive=False)
    least = scores.where(F.col("before") < top).groupBy("lang").agg(F.min("score").alias("least"))  # a row for each language
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    few = found.join(least, "lang").where(F.col("score") >= F.col("least"))
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(collocations(counted(table(spark, sf_dir, "documents"))))


ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as piece
  from documents where text is not null),
words as (select lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (select lang, array_to_string(w[i : i + k - 1], ' ') as phrase, k
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select unnest([1, 2, 3]) as k))),
f as (select lang, phrase, k, count(*)::bigint as n from grams group by lang, phrase, k having count(*) >= 10),
cand as (select lang, phrase, k, n as a, string_split(phrase, ' ') as w from f where k > 1),
cuts as (select lang, phrase, a, c, array_to_string(w[1 : c], ' ') as lp, array_to_string(w[c + 1 : k], ' ') as rp
  from (select *, unnest(range(1, k)) as c from cand)),
scored as (select cuts.lang, cuts.phrase, a, c, x.n as l, y.n as r, (1000000::hugeint * a * a // (x.n::hugeint * y.n))::bigint as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = lp join f y on y.lang = cuts.lang and y.phrase = rp),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (select lang, phrase, max(longer) as longer
  from (select lang, array_to_string(w[i : i + 1], ' ') as phrase, longer from (select lang, w, a as longer, unnest([1, 2]) as i from cand where k = 3)) group by lang, phrase)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase))::bigint as rank, phrase, a, l, r, n, score
from weakest left join inside using (lang, phrase) join totals using (lang)
where longer is null or 100 * longer < 50 * a
qualify row_number() over (partition by lang order by score desc, a desc, encode(phrase)) <= 2000
"""
