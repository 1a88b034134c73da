"""Tokenizer and model surfaces. SQL encodes too: it writes a letter for each merged pair, in the merges' order, so ids and offsets are compared one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.functions import bpe, inference

from . import proxies as P
from .registry import query

v = P.with_views
C = F.col
#: A small fixed model: every pair of bases, then four of their pairs.
MERGES = [(a, b) for a in "ACGT" for b in "ACGT"] + [("AC", "GT"), ("GG", "AT"), ("TA", "CA"), ("CC", "TG")]


def model() -> bpe.Bpe:
    return bpe.Bpe(list("ACGTN"), MERGES)


def spelled(ids):
    words = {k: w for w, k in model().vocabulary.items()}
    names = F.array(*(F.lit(words[k]) for k in range(len(words))))
    return F.array_join(F.transform(ids, lambda k: F.element_at(names, k + 1)), "")


@query("t01_bpe_train")
def t01(s, d):
    """Over whole sequences; a plain loop in the tests gives the same merges."""
    b = bpe.train(P.genome(s, d), "seq", 12)
    return s.createDataFrame([(k, x[0], x[1]) for x, k in b.ranks.items()], "rank int, first string, second string")


#: Each symbol of the model as a letter, in the order of its ids, which start after the five special tokens.
_LETTERS = "ACGTNabcdefghijklmnopqrst"


def _coded(text: str) -> str:
    """SQL of a text with a letter for each token: merges in order, each from left to right."""
    known = dict(zip("ACGT", "ACGT", strict=True))
    for (a, b), letter in zip(MERGES, _LETTERS[5:], strict=True):
        text = f"replace({text}, '{known[a]}{known[b]}', '{letter}')"
        known[a + b] = letter
    return text


def _ids(coded: str) -> str:
    return f"array_to_string(list_transform(string_split({coded}, ''), lambda c: strpos('{_LETTERS}', c) + 4), ' ')"


@query("t02_bpe_encode", v("tiles", f"SELECT chrom, tile_idx, md5(seq) AS spelled, md5({_ids(_coded('seq'))}) AS ids FROM tiles"))
def t02(s, d):
    e = P.tiles(s, d).select("chrom", "tile_idx", model().column(C("seq"))["ids"].alias("ids"))
    return e.select("chrom", "tile_idx", F.md5(spelled(C("ids"))).alias("spelled"), F.md5(F.array_join("ids", " ")).alias("ids"))


@query("t03_bpe_offsets", v("tiles", f"SELECT chrom, tile_idx, length(seq)::BIGINT AS covered, true AS joined, md5(array_to_string(list_transform(range(1, length(c) + 1), lambda k: list_sum(list_transform(string_split(c[1 : k], ''), lambda x: CASE WHEN strpos('{_LETTERS}', x) <= 5 THEN 1 WHEN strpos('{_LETTERS}', x) <= 21 THEN 2 ELSE 4 END))), ' ')) AS ends FROM (SELECT *, {_coded('seq')} AS c FROM tiles)"))
def t03(s, d):
    e = P.tiles(s, d).select("chrom", "tile_idx", model().column(C("seq")).alias("e"))
    total = F.aggregate(F.zip_with("e.starts", "e.ends", lambda a, b: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    meets = F.slice("e.starts", 2, F.size("e.starts")) == F.slice("e.ends", 1, F.size("e.ends") - 1)
    return e.select("chrom", "tile_idx", total.alias("covered"), meets.alias("joined"), F.md5(F.array_join("e.ends", " ")).alias("ends"))


@query("t04_bpe_dropout", v("tiles", "SELECT chrom, tile_idx, md5(seq) AS spelled FROM tiles"))
def t04(s, d):
    return P.tiles(s, d).select("chrom", "tile_idx", F.md5(spelled(model().column(C("seq"), 0.1, "drop")["ids"])).alias("spelled"))


@query("t11_boundary", v("tiles", "SELECT chrom, tile_idx, substr(seq, 1, length(seq) // 2) AS l, substr(seq, length(seq) // 2 + 1) AS r FROM tiles"))
def t11(s, d):
    half = F.floor(F.length("seq") / 2).cast("int")
    t = P.tiles(s, d).select("chrom", "tile_idx", F.substring("seq", F.lit(1), half).alias("l"), F.substring("seq", half + 1, F.length("seq")).alias("r"))
    left, right = model().encode_around(C("l"), C("r"))
    return t.select("chrom", "tile_idx", left.alias("a"), right.alias("b")).select("chrom", "tile_idx", spelled(C("a")).alias("l"), spelled(C("b")).alias("r"))


@query("n06_embedding", v("genome", "SELECT chrom, round((len - length(replace(seq, 'A', '')))::DOUBLE / greatest(len, 1), 5) AS a, round((len - length(replace(seq, 'T', '')))::DOUBLE / greatest(len, 1), 5) AS t FROM genome"))
def n06(s, d):
    e = inference.apply(P.genome(s, d), "strandflow.functions.inference:composition", "seq", "e", "array<double>")
    return e.select("chrom", F.round(C("e")[0], 5).alias("a"), F.round(C("e")[3], 5).alias("t"))
