"""SentencePiece encoding and decoding of whole texts for merge-type (BPE) vocabularies with byte fallback.

The encoder keeps an agenda of adjacent symbol pairs, best score first and leftmost among equals: the best pair is merged, its new neighbours join
the agenda, entries whose symbols have changed are passed over. Texts are cut before a run of white space marks and around characters that no longer piece
holds, where no piece of the vocabulary can reach across, so the cut changes no merge; each different cut-out is encoded once a worker. The agendas of many
short cut-outs advance together, a merge each a round, in arrays; a long one has a heap of its own.

Every Arrow batch is compared with the sentencepiece library (`check`); a difference raises.

Null and empty texts are the begin and end ids alone and decode to the empty text. Repeated rows and rows with a null id are rows like others; an empty
table gives an empty table; other columns than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, groupby
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, Words, slices, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # how the library writes a blank
_SHORT = 48  # symbols of a cut-out that is merged with many others at once
_NEVER = 1 << 30
_loaded: dict[str, PieceCodec] = {}


class PieceCodec(WordCache):
    """The vocabulary of a model file. Inside, a blank stands for the white space mark, and the mark in a text is a blank, as it is to the library."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        self.library = SentencePieceProcessor(model_file=path)
        model.ParseFromString(self.library.serialized_model_proto())
        norm, train, kind = model.normalizer_spec, model.trainer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = not norm.precompiled_charsmap and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not train.treat_whitespace_as_suffix
        if train.model_type != train.BPE or not train.byte_fallback or not plain or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("a merge-type vocabulary with byte fallback, without normalisation, user-defined or unused pieces is needed")
        self.prefix = b" " if norm.add_dummy_prefix else b""
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.ids_of = {p.piece.replace(SPACE, " "): i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        # equal scores have equal ranks
        score = {p.piece.replace(SPACE, " "): -p.score for p in model.pieces if p.type == kind.NORMAL and len(p.piece) > 1}
        order = {x: k for k, x in enumerate(sorted(set(score.values())))}
        self.rank = {p: order[x] for p, x in score.items()}
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.bytes = [byte[k] for k in range(256)]
        # what each id says: a byte, nothing (control), or its text
        self.says = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else b"" if p.type == kind.CONTROL else train.unk_surface.encode() if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.control = frozenset(i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL)
        self.normal = frozenset(self.ids_of.values())
        self.said = np.frombuffer(b"".join(self.says), np.uint8)
        self.said_at = np.concatenate([[0], np.cumsum([len(x) for x in self.says])])
        # no piece reaches over the border before a run of blanks, or over a character that only stands alone
        self.crosses = any(re.search("[^ ] ", p) for p in self.rank)
        joined = "".join(self.rank)
        self.alone = np.array([chr(k) not in joined for k in range(128)] + [False] * 128) & ~(np.arange(256) == 32)
        self.kind = np.uint16 if len(self.says) < 1 << 16 else np.uint32
        self.reset()
        # pairs of ids that merge: (left, right) by number, with the rank and the id of what they become
        pairs = sorted({(self.ids_of[p[:k]], self.ids_of[p[k:]], r, self.ids_of[p]) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.ids_of and p[k:] in self.ids_of})
        self.pairs = np.array([a * len(self.says) + b for a, b, _, _ in pairs] or [-1], np.int64)
        self.ranks, self.become = (np.array([x[k] for x in pairs] or [0], np.int64) for k in (2, 3))
        chars = sorted((ord(p), i) for p, i in self.ids_of.items() if len(p) == 1)
        self.chars, self.char_ids = (np.array([x[k] for x in chars], np.int64) for k in (0, 1))

    def split(self, texts: pa.Array) -> Words:
        """The cut-outs of each text, with the blank that the library puts before a text that is not empty."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), SPACE, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buf = texts.buffers()[2]
        data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        if not self.crosses:
            blank, alone = data == 32, self.alone[data]
            edge[:-1] |= alone
            edge[1:] |= alone
            edge[1:-1] |= blank[1:] & ~blank[:-1]
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        first = np.searchsorted(start, off)
        return Words(data, start, end, np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first)), first)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words]
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        point = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, point), len(self.chars) - 1)
        known = self.chars[at] == point
        word = np.repeat(np.arange(len(texts)), length)
        short = length <= _SHORT
        short[word[~known]] = False
        keep = short[word]
        done = self._merge_short(self.char_ids[at][keep], word[keep])
        rest = np.flatnonzero(~short).tolist()
        more = [self.merge(texts[k]) for k in rest]
        ids = np.concatenate([done[0], np.fromiter(chain.from_iterable(more), np.int64)])
        of = np.concatenate([done[1], np.repeat(rest, [len(x) for x in more]).astype(np.int64)])
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(texts))

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_NEVER where it does not merge) and its place among the pairs."""
        key = a * len(self.says) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NEVER), at

    def _merge_short(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agenda of many cut-outs at once: each round merges the best pair, leftmost of equals, of every one that has a pair left."""
        out, of = [], []
        rank, at = np.full(len(sym), _NEVER), np.zeros(len(sym), np.int64)  # of each symbol and its right neighbour
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], at[inner] = self._look(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(first, append=len(sym))
            best = np.minimum.reduceat(rank, first)
            going = best < _NEVER
            if not going.all():
                stay = np.repeat(going, size)
                out.append(sym[~stay])
                of.append(word[~stay])
                sym, word, rank, at, best, size = sym[stay], word[stay], rank[stay], at[stay], best[going], size[going]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            hit = hit[np.diff(word[hit], prepend=-1) != 0]
            sym[hit] = self.become[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            new = np.zeros(len(sym), bool)
            new[hit] = True
            sym, word, rank, at, new = sym[keep], word[keep], rank[keep], at[keep], new[keep]
            # the merged symbol's pairs on both sides
            here = np.flatnonzero(new)
            touched = np.concatenate([here, here[here > 0] - 1])
            touched = touched[touched < len(sym)]
            inside = touched + 1 < len(sym)
            inside[inside] = word[touched[inside]] == word[touched[inside] + 1]
            rank[touched] = _NEVER
            pair = touched[inside]
            rank[pair], at[pair] = self._look(sym[pair], sym[pair + 1])
        return np.concatenate([*out, np.zeros(0, np.int64)]), np.concatenate([*of, np.zeros(0, np.int64)])

    def merge(self, cut: str) -> list[int]:
        """Ids of a cut-out by the agenda."""
        sym: list[str | None] = list(cut)
        n, rank = len(sym), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(rank[both], k, k + 1, both) for k, both in enumerate(map(add, sym, sym[1:])) if both in rank]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if sym[left] is None or sym[right] is None or after[left] != right or sym[left] + sym[right] != both:
                continue  # an earlier merge took one of them
            sym[left], sym[right] = both, None
            nxt = after[left] = after[right]
            if nxt >= 0:
                before[nxt] = left
                if (both := sym[left] + sym[nxt]) in rank:
                    heapq.heappush(agenda, (rank[both], left, nxt, both))
            prev = before[left]
            if prev >= 0 and (both := sym[prev] + sym[left]) in rank:
                heapq.heappush(agenda, (rank[both], prev, left, both))
        out = []
        for s in sym:
            if s is not None:
                i = self.ids_of.get(s)
                out += [i] if i is not None else [self.bytes[b] for b in s.encode()]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each between the begin and end ids; bounds of each text's ids)."""
        ids, bounds = self.encode_split(self.split(texts))
        size = np.diff(bounds)
        to = np.concatenate([[0], np.cumsum(size + 2)])
        out = np.empty(to[-1], np.uint32)
        out[to[:-1]], out[to[1:] - 1] = self.begin, self.end
        inner = np.ones(len(out), bool)
        inner[to[:-1]] = inner[to[1:] - 1] = False
        out[inner] = ids
        return out, to

    def decode_texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        size = (self.said_at[1:] - self.said_at[:-1])[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.said[np.arange(total[-1]) + np.repeat(self.said_at[ids] - total[:-1], size)].tobytes()
        ends = total[bounds].tolist()
        out = []
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            # ids of whole texts have control ids at both ends only, and start with the blank before the text
            own = ids[bounds[k] : bounds[k + 1]]
            simple = len(own) > 2 and own[0] in self.control and own[-1] in self.control and self.prefix and int(own[1]) in self.normal and raw[a : a + 1] == b" " and not self._inner_control(own)
            out.append(_text(raw[a + 1 : b]) if simple else self.decode(own.tolist()))
        return out

    def _inner_control(self, own: np.ndarray) -> bool:
        return bool(np.isin(own[1:-1], list(self.control)).any())

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one blank that the encoder put before the text goes, bytes that are no UTF-8 are U+FFFD each."""
        own = [i for i in ids if i not in self.control]
        if not own:
            return ""
        if len(own) == len(ids) or own == ids[1:-1]:
            runs = [own]
        else:  # bytes on two sides of a control id are never one character
            runs = [list(r) for inside, r in groupby(ids, self.control.__contains__) if not inside]
        raw = [b"".join(map(self.says.__getitem__, r)) for r in runs]
        if self.prefix and own[0] in self.normal and raw[0][:1] == b" ":
            raw[0] = raw[0][1:]
        return "".join(map(_text, raw))


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return _each_byte(raw)


def _each_byte(raw: bytes) -> str:
    """UTF-8 text in which each byte outside a character is U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


def codec(path: str) -> PieceCodec:
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def encode_documents(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) of every row's whole text: its ids between the begin and end ids, and the text that these ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for b in slices(batch, "text"):
                ids, bounds = c.encode(b.column(1))
                decoded = c.decode_texts(ids, bounds)
                if check:
                    compare(c, [t or "" for t in b.column(1).to_pylist()], ids, bounds, decoded)
                own = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), own, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def compare(c: PieceCodec, texts: list[str], ids: np.ndarray, bounds: np.ndarray, decoded: list[str]) -> None:
    """Raises where the library encodes or decodes anything of a batch in another way."""
    theirs = c.library.encode(texts, out_type=int, num_threads=1, add_bos=True, add_eos=True)
    sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
    same = np.array_equal(np.diff(bounds), sizes) and np.array_equal(np.fromiter(chain.from_iterable(theirs), np.uint32, int(sizes.sum())), ids)
    if not same or c.library.decode(theirs, num_threads=1) != decoded:
        k = next(k for k in range(len(texts)) if theirs[k] != ids[bounds[k] : bounds[k + 1]].tolist() or c.library.decode(theirs[k]) != decoded[k])
        raise RuntimeError(f"the sentencepiece library differs on a text of {len(texts[k])} characters that starts with {texts[k][:60]!r}")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents; ids are hashed as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, decoded = b.column(1), b.column(2)
            bounds = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4", copy=False)
            of_ids = [hashlib.sha256(flat[x:y].tobytes()).hexdigest() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            of_text = [hashlib.sha256(x.encode()).hexdigest() for x in decoded.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), default_model()))
