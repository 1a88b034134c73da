"""Conversation repair, piece encoding and phrase mining against brute force, the library, and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.llm import conversations as cv
from strandflow.llm import phrases, piece_codec

from ..conftest import rows


def sql(query, folder, table):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return c.sql(query).df()



def clash():
    """columns whose names are the operators' own"""
    return {c: F.lit("own") for c in ("section", "copies", "seen", "code", "n", "words", "phrase", "ids", "shard")}


# --- conversations ---


def cheapest(codes):
    """(cost, audit) by trying all edits, shortest first."""
    import heapq

    heap, closed = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in closed:
            continue
        closed.add((i, s))
        if i == len(codes) and s in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, cv._NEXT[s]))
        if i < len(codes):
            for e, p, t, c in cv._ROW[codes[i]]:
                if p == s:
                    heapq.heappush(heap, (cost + c, audit + e, i + 1, t))


def test_dial_and_tight_arcs_against_search():
    rng = random.Random(4)
    given = [bytes(x) for n in range(4) for x in itertools.product(range(8), repeat=n)] + [bytes(rng.randrange(8) for _ in range(rng.randrange(90))) for _ in range(60)]
    for codes in given:
        total, edits, _ = cv.walk(codes)
        assert (total, "".join(edits)) == cheapest(codes)


def talk(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns(clash())


ODD_TALK = [
    (1, 0, "user", "hi."), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, None, "system", "be."), (1, 9, "user", "hi."), (1, 12, "assistant", " \x0b"),
    (2, None, None, None), (2, None, "", "a."), (2, None, "tool", "b!"), (None, 3, "user", "q?"), (None, 3, "user", "q?"), (None, None, "user", "x" * 200_000),
    (3, 1, "user", "é" * 9000), (3, 2, "user", "then."), (3, -(1 << 40), "assistant", "no."), (4, 5, "assistant", "."), *((5, k % 7, "user", "same.") for k in range(300)), (5, 8, "user", "other."),
]


@pytest.mark.parametrize("limit", [1 << 16, 3, 1])
def test_repair_on_odd_rows_and_in_sections(spark, limit):
    df = talk(spark, ODD_TALK)
    got = {r.conv_id: r for r in cv.report(cv.repair(df, limit=limit)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        mine = sorted((x for x in ODD_TALK if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] if x[2] is not None else " ", x[3] if x[3] is not None else " "))
        s = cv.Section()
        for _, turn, role, text in mine:
            s.add(turn, " " if role is None else role, " " if text is None else text)
        turns = {x[1] for x in mine if x[1] is not None}
        _, _, blank, duplicate, truncated, illegal, cost, audit, out = s.repair()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        told = "\n".join(f"{x['role']}:{x['text']}" for x in out)
        assert tuple(r)[1:] == (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest())
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in out))
    assert got[5].duplicate == 299 and got[5].audit.count("D") == 299 + (got[5].audit[-1] == "D")
    assert cv.report(cv.repair(talk(spark, []))).count() == 0


def test_sections_of_given_conversations(spark, data):
    hurt = cv.damage(spark.read.parquet(f"{data}/conversations.parquet"))
    assert rows(cv.report(cv.repair(hurt, limit=2)).toPandas()) == rows(cv.report(cv.repair(hurt)).toPandas())


def test_query_names_conversations_without_rows(spark, tmp_path):
    n = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    spark.createDataFrame([(n, 0, "user", "a."), (None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = cv.op11_conversations(spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(sql(cv.ORACLE_SQL, tmp_path, 'conversations'))
    gone = got[got.conv_id == n].iloc[0]
    assert (gone.cost, gone.audit, gone.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


# --- pieces ---

STRANGE = ["", None, " ", "  ", " a", "a ", "▁", "▁a b▁", "\x00a", "日本語 テスト", "a\r\nb\tc", "<s>hi</s>", "<0x41>", "�", "😀😀  ‍", "a" * 3000, " " * 5000, "é" * 2000, "\n", "<unk>", "x", "x"]


def test_pieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=piece_codec.default_model())
    rng = random.Random(2)
    texts = STRANGE + ["".join(rng.choice("ab ▁  \n\t<>s/éñ日😀th eion0x4.") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame([(k if k % 50 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns(clash())
    got = piece_codec.encode_documents(df, piece_codec.default_model(), check=False).collect()
    want = [library.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert sorted((r.ids, r.decoded) for r in got) == sorted((w, library.decode(w)) for w in want)
    found = piece_codec.digests(piece_codec.encode_documents(df, piece_codec.default_model())).collect()
    assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == Counter((len(w), hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(w).encode()).hexdigest()) for w in want)
    assert piece_codec.digests(piece_codec.encode_documents(df.limit(0), piece_codec.default_model())).count() == 0


def test_decoding_of_any_ids_equals_the_library():
    c, rng = piece_codec.codec(piece_codec.default_model()), random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 3, 35, 131, 200, 230, 259, 263, 278, 29871, rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert c.decode(ids) == c.library.decode(ids)


def test_a_difference_from_the_library_raises():
    c = piece_codec.codec(piece_codec.default_model())
    ids, bounds = c.encode(pa.array(["a", "b d"]))
    piece_codec.compare(c, ["a", "b d"], ids, bounds, ["a", "b d"])
    for texts, decoded in ((["a", "b c"], ["a", "b c"]), (["a", "b d"], ["a", "b c"])):
        with pytest.raises(RuntimeError):
            piece_codec.compare(c, texts, ids, bounds, decoded)


def test_agendas_together_and_alone_give_the_same():
    c, rng = piece_codec.codec(piece_codec.default_model()), random.Random(5)
    words = ["".join(rng.choice("  thesandoringéñ.,x日😀") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    ids, sizes = c.encode_words([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [c.merge(w) for w in words]


def test_query_pieces(spark, data):
    c = piece_codec.codec(piece_codec.default_model())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = piece_codec.op12_pieces(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = c.library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(c.library.decode(ids).encode()).hexdigest()


# --- phrases ---


def counted(docs, longest):
    out, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                out.update((lang, " ".join(w[i : i + k]), k) for i in range(len(w) - k + 1))
    return out, total


PHRASES = [("en", "New York, new  york\tcity. New York"), ("en", None), (None, "a b c " * 40), ("und", "A b c\n" * 5), ("de", ""), ("de", ".,;"), ("fr", "é\x1cx\x0by É " * 30), ("en", "k" * 30000 + " l m"), ("en", "the " * 300), ("en", "the " * 300), ("", "q r" * 20)]


@pytest.mark.parametrize("support,longest", [(1, 3), (4, 4), (10, 3), (300, 2)])
def test_phrase_counts_are_exact(spark, support, longest):
    df = spark.createDataFrame(PHRASES, "lang string, text string").repartition(3).withColumns(clash())
    out, total = counted(PHRASES, longest)
    got = {(r.lang, r.phrase, r.words): r.n for r in phrases.counted(df, support, longest).collect()}
    assert {k: v for k, v in got.items() if k[2]} == {k: v for k, v in out.items() if v >= support}
    assert {k[0]: v for k, v in got.items() if not k[2]} == {k: v for k, v in total.items() if any(k == ("und" if x is None else x) and t is not None for x, t in PHRASES)}


def test_phrases_on_odd_rows_and_large_numbers(spark, tmp_path):
    df = spark.createDataFrame(PHRASES, "lang string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(phrases.best(phrases.collocations(phrases.counted(df))).toPandas()) == rows(sql(phrases.ORACLE_SQL, tmp_path, 'documents'))
    assert phrases.best(phrases.collocations(phrases.counted(df.limit(0)))).count() == 0
    big = 3_000_000_000_000
    made = spark.createDataFrame([("x", "a", 1, big), ("x", "b", 1, big - 1), ("x", "a b", 2, big - 7), ("x", "", 0, big * 9), ("x", "a b c", 3, big // 3), ("x", "b c", 2, big // 2), ("x", "c", 1, big)], "lang string, phrase string, words int, n long")
    got = {r.phrase: r for r in phrases.collocations(made).collect()}
    assert set(got) == {"a b", "a b c"}  # two thirds of `b c` are inside `a b c`
    assert got["a b"].score == 10**6 * (big - 7) ** 2 // (big * (big - 1)) and phrases.collocations(made, subsume=90).count() == 3


def test_sketches_never_count_too_little():
    rng = np.random.default_rng(1)
    places = np.unique(rng.integers(0, 1 << 21, 5000))
    assert np.array_equal(phrases.unpack_gaps(phrases.pack_gaps(places)), places)
    assert phrases.unpack_gaps(phrases.pack_gaps(np.zeros(0, np.int64))).size == 0
    edge = np.array([0, 253, 507, 508, 508 + 254 * 3, 5000])
    assert np.array_equal(phrases.unpack_gaps(phrases.pack_gaps(edge)), edge)
    words, piece = phrases.piece_words(pa.array(["a b.c", None, "d", "e f"]))
    got = {(r.k, tuple(words.row[r.first])) for r in phrases.word_runs(words, piece, phrases.lang_hashes(pa.array(["x"] * 4)), 3)}
    assert got == {(1, (0, 0, 0, 2, 3, 3)), (2, (0, 3)), (3, ())}
