"""Token-array queries; arrays are compared as joined text."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.functions import seq
from strandflow.functions import recurrent
from strandflow.operators import tokens as T
from strandflow.operators import variants

from . import proxies as P
from .registry import query

C = F.col
TOK = "tok AS (SELECT doc_id AS id, list_transform(string_split(text, ' '), lambda w: (5 + length(w) % 11)::INT) AS a, list_transform(string_split(text, chr(10)), lambda x: (16 + length(x) % 7)::INT) AS b FROM documents)"
J = "array_to_string({}, ' ')"


def tok(s, d):
    """(id, a, b): a token for each word and one for each line of each document"""
    def arr(by, base, m):
        return F.transform(F.split("text", by), lambda w: (F.lit(base) + F.length(w) % m).cast("int"))

    return P.spread(P.table(s, d, "documents").select("doc_id", "text")).select(C("doc_id").alias("id"), arr(" ", 5, 11).alias("a"), arr("\n", 16, 7).alias("b"))


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def W(body: str) -> str:
    return f"WITH {TOK}{', ' if not body.lstrip().startswith('SELECT') else ' '}{body}"


_PADTO = "list_concat({x}, list_transform(range(0, greatest({n} - len({x}), 0)), lambda i: 3))"


@query("t05_truncate_encode", W(f"x AS (SELECT id, list_concat([1], a[1:38], [2]) AS r, list_concat([1], a[greatest(len(a) - 37, 1):], [2]) AS l, list_concat([1], a[greatest(len(a) // 2 - 19, 0) + 1:least(len(a) // 2 + 19, len(a))], [2]) AS m FROM tok) SELECT id, {J.format(_PADTO.format(x='r', n=40))} AS r, {J.format(_PADTO.format(x='l', n=40))} AS l, {J.format(_PADTO.format(x='m', n=40))} AS m FROM x"))
def t05(s, d):
    return tok(s, d).select("id", *(joined(T.encode(C("a"), 40, side)).alias(n) for n, side in (("r", "right"), ("l", "left"), ("m", "mid"))))


@query("t06_pair_encode", W(f"n AS (SELECT *, greatest(len(a) + len(b) - 45, 0) AS o, least(greatest(len(a) + len(b) - 45, 0), abs(len(a) - len(b))) AS f FROM tok), c AS (SELECT id, list_concat([1], a[1:len(a) - CASE WHEN len(a) > len(b) THEN f ELSE 0 END - (o - f + 1) // 2], [2], b[1:len(b) - CASE WHEN len(a) > len(b) THEN 0 ELSE f END - (o - f) // 2], [2]) AS x FROM n) SELECT id, {J.format(_PADTO.format(x='x', n=48))} AS x FROM c"))
def t06(s, d):
    return tok(s, d).select("id", joined(T.encode_pair(C("a"), C("b"), 48)).alias("x"))


@query("t07_single_encode", W(f"x AS (SELECT id, list_concat([1], a[1:62], [2]) AS x FROM tok) SELECT id, {J.format(_PADTO.format(x='x', n=64))} AS x FROM x"))
def t07(s, d):
    return tok(s, d).select("id", joined(T.encode(C("a"), 64)).alias("x"))


_BAL = """p AS (SELECT id, a[1:len(a) // 2] AS l, b AS m, a[len(a) // 2 + 1:] AS r FROM tok),
n AS (SELECT *, len(l) AS L_, len(m) AS M_, len(r) AS R_, len(l) + len(m) + len(r) + {s} - {n} AS o FROM p),
t AS (SELECT *, CASE WHEN L_ >= R_ THEN o - greatest(0, o - (L_ - R_)) // 2 ELSE (greatest(0, o - (R_ - L_)) + 1) // 2 END AS tl FROM n),
z AS (SELECT id, o, M_ + {s} >= {n} AS alone, CASE WHEN M_ + {s} >= {n} THEN [] WHEN o <= 0 THEN l ELSE l[tl + 1:] END AS l,
CASE WHEN M_ + {s} >= {n} THEN m[(M_ + {s} - {n}) // 2 + 1:M_ - (M_ + {s} - {n} - (M_ + {s} - {n}) // 2)] ELSE m END AS m,
CASE WHEN M_ + {s} >= {n} THEN [] WHEN o <= 0 THEN r ELSE r[1:R_ - (o - tl)] END AS r FROM t)"""


def _lmr(s, d):
    n = F.size("a")
    half = F.floor(n / 2).cast("int")
    return tok(s, d).select("id", T.part(C("a"), F.lit(0), half).alias("l"), C("b").alias("m"), T.part(C("a"), half, n).alias("r"))


@query("t08_balance_context", W(_BAL.format(s=4, n=36) + f" SELECT id, {J.format('l')} AS l, {J.format('m')} AS m, {J.format('r')} AS r, (CASE WHEN NOT alone AND o <= 0 THEN -o ELSE 0 END)::INT AS pads FROM z"))
def t08(s, d):
    l, m, r, p = T.balance(C("l"), C("m"), C("r"), 36, 4)
    return _lmr(s, d).select("id", joined(l).alias("l"), joined(m).alias("m"), joined(r).alias("r"), p.cast("int").alias("pads"))


@query("t09_concat_encodings", W(f"SELECT id, {J.format('list_concat(a, b)')} AS ids, len(a) + len(b) AS n FROM tok"))
def t09(s, d):
    x = F.concat("a", "b")
    return tok(s, d).select("id", joined(x).alias("ids"), F.size(x).cast("bigint").alias("n"))


_TL = """k AS (SELECT id AS sample, unnest(range(0, len(a))) AS pos, unnest(a) AS t FROM tok), q AS (SELECT sample, pos, sum(t) OVER (PARTITION BY sample ORDER BY pos ROWS UNBOUNDED PRECEDING) - t AS st FROM k),
g AS (SELECT id AS sample, unnest(range(0, len(b))) * 17 + 3 AS place, unnest(b) % 3 AS cls FROM tok)"""


def _tokens(s, d):
    k = tok(s, d).select(C("id").alias("sample"), F.posexplode(F.arrays_zip(C("a").alias("t"), T.starts("a").alias("st"))).alias("pos", "x"))
    return k.select("sample", "pos", "x.st", "x.t")


@query("t10_token_labels", W(_TL + ", w AS (SELECT *, lead(st) OVER (PARTITION BY sample ORDER BY st) AS nx FROM q) SELECT w.sample, w.pos::INT AS pos, max(cls)::INT AS label FROM w LEFT JOIN g ON g.sample = w.sample AND place >= st AND (nx IS NULL OR place < nx) GROUP BY 1, 2"))
def t10(s, d):
    g = tok(s, d).select(C("id").alias("sample"), F.posexplode("b").alias("k", "x")).select("sample", (C("k") * 17 + 3).alias("place"), (C("x") % 3).alias("cls"))
    return T.token_labels(_tokens(s, d).select("sample", "pos", "st"), g)


@query("t12_splice_sample", W(_BAL.replace("b AS m", "b[1:32] AS m").format(s=4, n=36) + f" SELECT id, {J.format('list_concat([1], l, [2], m, [2], r, list_transform(range(0, CASE WHEN NOT alone AND o <= 0 THEN -o ELSE 0 END), lambda i: 3), [2])')} AS x FROM z"))
def t12(s, d):
    return _lmr(s, d).select("id", joined(T.splice_sample(C("l"), C("m"), C("r"), 36)).alias("x"))


@query("t13_class_one_hot", W("c AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 3 END AS p, CASE WHEN id % 5 = 0 THEN NULL ELSE id // 3 % 3 END AS q FROM tok) SELECT id, array_to_string([coalesce((p = k OR q = k)::INT, (p = k)::INT, (q = k)::INT, 0) FOR k IN [0, 1, 2]], ' ') AS x FROM c"))
def t13(s, d):
    i = C("id")
    p, q = F.when(i % 7 != 0, i % 3), F.when(i % 5 != 0, F.floor(i / 3) % 3)
    return tok(s, d).select("id", joined(T.class_rows(p, q)).alias("x"))


@query("t14_token_mean_label", W("""k AS (SELECT id, unnest(range(0, len(a))) AS pos, unnest(a) AS t FROM tok), q AS (SELECT id, pos, (sum(t) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) - t)::BIGINT AS lo, (sum(t) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS hi FROM k),
g AS (SELECT id, unnest(range(0, len(b))) * 17 AS s, unnest(b) AS v FROM tok) SELECT q.id, pos::INT AS pos, round(coalesce(sum(v * (least(hi, s + 10) - greatest(lo, s))), 0)::DOUBLE / (hi - lo), 6) AS m FROM q LEFT JOIN g ON g.id = q.id AND lo < s + 10 AND hi > s GROUP BY q.id, pos, lo, hi"""))
def t14(s, d):
    from strandflow.operators import intervals as I

    spans = _tokens(s, d).select(C("sample").cast("string").alias("chrom"), "pos", C("st").cast("bigint").alias("start"), (C("st") + C("t")).cast("bigint").alias("end"))
    sig = tok(s, d).select(C("id").cast("string").alias("chrom"), F.posexplode("b").alias("k", "v")).select("chrom", (C("k") * 17).cast("bigint").alias("start"), (C("k") * 17 + 10).cast("bigint").alias("end"), C("v").cast("double").alias("value"))
    return I.span_mean(spans, sig).select(C("chrom").cast("bigint").alias("id"), "pos", F.round("mean", 6).alias("m"))


@query("t15_record_chunks", "SELECT conv_id, turn, k::INT AS chunk, (k * 100)::INT AS first_bin, least((k + 1) * 100, 896)::INT AS end_bin FROM conversations, range(0, 9) t(k)")
def t15(s, d):
    return T.chunks(P.table(s, d, "conversations").select("conv_id", "turn"), 896, 100)


@query("s14_record_slice", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3")
def s14(s, d):
    return P.table(s, d, "lineitem").where("l_linenumber between 2 and 3").select("l_orderkey", "l_linenumber", "l_quantity")


def _bins(s, d):
    n = F.ceil(F.size("a") / F.lit(7)).cast("int")
    b = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("a", i * 7 + 1, 1 + (i * 3 + 2) % 7))).otherwise(F.array().cast("array<array<int>>"))
    return tok(s, d).select("id", b.alias("bins"))


_BIN = "bins AS (SELECT id, k, a[k * 7 + 1:k * 7 + 1 + (k * 3 + 2) % 7] AS x FROM (SELECT id, a, unnest(range(0, (len(a) + 6) // 7)) AS k FROM tok)), r AS (SELECT *, sum(len(x) + 1) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) + 1 < 40 AS fits FROM bins)"


@query("t16_assemble_bins", W(_BIN + " SELECT tok.id, '1' || coalesce(string_agg(' ' || array_to_string(x, ' ') || ' 2', '' ORDER BY k) FILTER (WHERE fits), '') AS x, count(*) FILTER (WHERE fits) AS n FROM tok LEFT JOIN r USING (id) GROUP BY tok.id"))
def t16(s, d):
    return _bins(s, d).withColumn("z", T.assemble_bins(C("bins"), 40)).select("id", joined(C("z.ids")).alias("x"), C("z.n").cast("bigint").alias("n"))


@query("t17_shift", P.with_views("tiles", "SELECT chrom, tile_idx, substr(seq, (40 + tile_idx % 9 - 4 + 1)::BIGINT, greatest(length(seq) - 80, 0)) AS x FROM tiles"))
def t17(s, d):
    return P.tiles(s, d).select("chrom", "tile_idx", T.shifted_centre(C("seq"), 40, (C("tile_idx") % 9 - 4).cast("int")).alias("x"))


@query("t18_rc_augmentation", P.with_views("tiles", "SELECT chrom, tile_idx, CASE WHEN tile_idx % 2 = 1 THEN reverse(translate(seq, 'ACTGN', 'TGACN')) ELSE seq END AS x, CASE WHEN tile_idx % 2 = 1 THEN 'right' ELSE 'left' END AS context FROM tiles"))
def t18(s, d):
    flip = C("tile_idx") % 2 == 1
    return P.tiles(s, d).select("chrom", "tile_idx", F.when(flip, seq.revcomp(C("seq"))).otherwise(C("seq")).alias("x"), F.when(flip, "right").otherwise("left").alias("context"))


@query("t19_dynamic_padding", W(f"w AS (SELECT id, a, ((max(len(a)) OVER (PARTITION BY id // 8) + 63) // 64 * 64)::BIGINT AS n FROM tok) SELECT id, {J.format(_PADTO.format(x='a', n='n'))} AS ids, len(a) AS attended, n AS width FROM w"))
def t19(s, d):
    c = T.collate(tok(s, d).withColumn("batch", F.floor(C("id") / 8)), "a", "batch")
    return c.select("id", joined(C("a")).alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda x, y: x + y).cast("bigint").alias("attended"), F.size("a").cast("bigint").alias("width"))


_LABELS = "list_concat(list_transform(b, lambda x: (x % 3) || ',' || (x % 5)), list_transform(range(0, r - len(b)), lambda i: '0,0'))"


@query("t20_labelled_padding", W(f"w AS (SELECT id, a, b, ((max(len(a)) OVER (PARTITION BY id // 8) + 63) // 64 * 64)::BIGINT AS n, max(len(b)) OVER (PARTITION BY id // 8) AS r FROM tok) SELECT id, {J.format(_PADTO.format(x='a', n='n'))} AS ids, len(a) AS attended, len(list_filter(a, lambda x: x > 10)) AS binned, {J.format(_LABELS)} AS labels, {J.format('list_concat(list_transform(b, lambda x: 1), list_transform(range(0, r - len(b)), lambda i: 0))')} AS own, n AS width FROM w"))
def t20(s, d):
    t = tok(s, d).withColumn("batch", F.floor(C("id") / 8))
    cols = {"input_ids": C("a"), "token_type_ids": F.transform("a", lambda x: F.lit(0)), "attention_mask": F.transform("a", lambda x: F.lit(1)), "bins_mask": F.transform("a", lambda x: x > 10), "labels": F.transform("b", lambda x: F.array(x % 3, x % 5))}
    c = T.collate_labelled(t.select("id", "batch", *(x.alias(k) for k, x in cols.items())), "batch")
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y.cast("int")).cast("bigint")
    rows = F.array_join(F.transform("labels", lambda x: F.concat_ws(",", F.get(x, F.lit(0)).cast("string"), F.get(x, F.lit(1)).cast("string"))), " ")
    return c.select("id", joined(C("input_ids")).alias("ids"), total("attention_mask").alias("attended"), total("bins_mask").alias("binned"), rows.alias("labels"), joined(F.transform("labels_mask", lambda x: x.cast("int"))).alias("own"), F.size("token_type_ids").cast("bigint").alias("width"))


_SEG = """f AS (SELECT id, a[1:54] AS body FROM tok), n AS (SELECT *, (len(body) + 17) // 18 AS n FROM f), e AS (SELECT id, body, n, (len(body) + n - 1) // n AS size, unnest(range(0, n)) AS i FROM n WHERE n > 0),
z AS (SELECT id, (3 - n + i)::INT AS slot, list_concat([1, 4, 4, 2], body[i * size + 1:(i + 1) * size], [2]) AS x FROM e)"""


@query("t21_segment", W(_SEG + f" SELECT id, slot, {J.format(_PADTO.format(x='x', n=23).replace('lambda i: 3', 'lambda i: 0'))} AS x FROM z"))
def t21(s, d):
    z = tok(s, d).select("id", F.explode(T.segment(C("a"), 23, 2, 3)).alias("z"))
    return z.select("id", C("z.slot").alias("slot"), joined(C("z.ids")).alias("x"))


@query("t22_segment_labelled", W(_SEG.replace("list_concat([1, 4, 4, 2], body[i * size + 1:(i + 1) * size], [2]) AS x", "list_concat([1, 4, 4, 2], body[i * size + 1:(i + 1) * size], [2]) AS x, body[i * size + 1:(i + 1) * size] AS piece") + f" SELECT id, slot, {J.format(_PADTO.format(x='x', n=23))} AS x, array_to_string(list_transform(piece, lambda t: t % 3), ' ') AS labels FROM z"))
def t22(s, d):
    z = tok(s, d).select("id", F.explode(T.segment_labelled(C("a"), F.transform("a", lambda t: t % 3), 23, 2, 3)).alias("z"))
    return z.select("id", C("z.slot").alias("slot"), joined(C("z.ids")).alias("x"), joined(F.filter("z.labels", lambda x: x.isNotNull())).alias("labels"))


@query("t23_segment_bins", W("m AS (SELECT id, list_transform(a, lambda t: CASE WHEN t % 5 = 0 THEN 2 ELSE t END) AS a FROM tok), k AS (SELECT id, unnest(range(0, len(a))) AS p, unnest(a) AS t FROM m), c AS (SELECT *, coalesce(sum(CASE WHEN t = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 3 AS seg FROM k) SELECT id, seg::INT AS seg, string_agg(t, ' ' ORDER BY p) AS x FROM c GROUP BY 1, 2"))
def t23(s, d):
    a = F.transform("a", lambda t: F.when(t % 5 == 0, T.SEP).otherwise(t))
    return tok(s, d).select("id", F.posexplode(T.segment_bins(a, 3)).alias("seg", "x")).select("id", "seg", joined(C("x")).alias("x"))


@query("t24_mutagenesis", P.with_views("tiles", "SELECT chrom, tile_idx, dist, alt, md5(substr(seq, 1, (128 + dist)::BIGINT) || alt || substr(seq, (130 + dist)::BIGINT)) AS x FROM tiles, (SELECT unnest(range(-20, 21)) AS dist), (SELECT unnest(['A', 'C', 'G', 'T']) AS alt) WHERE length(seq) >= 129 + dist AND dist <> 0 AND substr(seq, (129 + dist)::BIGINT, 1) <> alt"))
def t24(s, d):
    """All forty distances around each tile's middle, shorter tiles as far as they reach."""
    x = variants.mutant_digests(P.tiles(s, d).select("chrom", "tile_idx", "seq"), "seq", [128 + k for k in range(-20, 21) if k])
    return x.select("chrom", "tile_idx", (C("place") - 128).alias("dist"), "alt", C("digest").alias("x"))


@query("t25_centre_tokens", W("k AS (SELECT id, unnest(range(0, len(a))) AS pos, unnest(a) AS t FROM tok), q AS (SELECT *, sum(t) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hi FROM k) SELECT id, max(t)::INT AS top FROM q WHERE hi - t <= 101 AND hi > 99 GROUP BY id"))
def t25(s, d):
    return _tokens(s, d).where("st <= 101 and st + t > 99").groupBy(C("sample").alias("id")).agg(F.max("t").alias("top"))


@query("t26_splice_sites", W("SELECT id AS gene, CASE WHEN id % 2 = 0 THEN 'donor' ELSE 'acceptor' END AS kind, unnest(a)::INT AS pos FROM tok UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 'acceptor' ELSE 'donor' END, unnest(b)::INT FROM tok"))
def t26(s, d):
    g = tok(s, d).select(C("id").alias("gene"), F.when(C("id") % 2 == 0, "+").otherwise("-").alias("strand"), C("a").alias("splice_starts"), C("b").alias("splice_ends"))
    return T.splice_sites(g)


@query("t27_token_rows", W("SELECT id, unnest(range(0, least(len(a), len(b))))::INT AS pos, unnest(a[1:least(len(a), len(b))]) AS token, unnest(b[1:least(len(a), len(b))]) AS attr FROM tok"))
def t27(s, d):
    z = tok(s, d).select("id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "z")).where("z.a is not null and z.b is not null")
    return z.select("id", "pos", C("z.a").alias("token"), C("z.b").alias("attr"))


@query("t28_special_bounds", W("SELECT id, (list_position(list_concat(b, [1], a, [2]), 1) - 1)::INT AS c, (list_position(list_concat(b, [1], a, [2]), 2) - 1)::INT AS s FROM tok"))
def t28(s, d):
    c, e = T.special_bounds(F.concat("b", T.ints(T.CLS), "a", T.ints(T.SEP)))
    return tok(s, d).select("id", c.alias("c"), e.alias("s"))


@query("n04_recurrent_state", W(_SEG + """, g AS (SELECT id, slot, list_reduce(list_transform(range(1, len(x) + 1), lambda k: k * x[k]), lambda a, b: a + b) AS s FROM z),
h AS (SELECT id, slot, list(s) OVER (PARTITION BY id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS l FROM g) SELECT id, slot, list_reduce(l, lambda a, b: (31 * a + b) % 1000003, 7::BIGINT)::BIGINT AS value FROM h"""))
def n04(s, d):
    """A stand-in model stepped over the segments of t21, without their padding."""
    z = tok(s, d).select("id", F.explode(T.segment(C("a"), 23, 2, 3)).alias("z")).select("id", C("z.slot").alias("slot"), F.filter("z.ids", lambda x: x != 0).alias("ids"))
    return recurrent.run(z, "strandflow.functions.recurrent:rolling", "id", "slot", "ids")
