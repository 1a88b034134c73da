"""Repair of conversation structure: the cheapest edits that make a conversation's roles alternate, found as shortest paths.

A conversation is its rows by (turn, nulls first, then role and text). Faults, of which a row's first counts: `blank` (no character but white space),
`duplicate` (role and text seen earlier), `truncated` (the last other character is none of . ! ?). Edits: keep (K, 0), rerole to the role that must follow
(R, 3), delete (D, 4, required for blank and duplicate rows), insert an empty row of the role that must follow (I, 3); a truncated row that stays costs 3 more.
The initials of the roles left are to read (s?(ua)+)?; of the cheapest ways the one whose edits spell the least string is taken.

Nodes are (rows done, state), states are what the roles so far allow. Costs are small whole numbers, so Dial's circular bucket queue gives all distances
to the end; the audit is then walked from the start along tight arcs, in the order D I K R. Required deletions commute with insertions and D is the least
letter, so they stay out of the graph and come before the insertions at their place.

Conversations of at most `limit` rows and `limit_bytes` of text are one section, streamed through sorted partitions. Longer ones are range-sorted into sections of about that size: a
section's distances from each state to each state are a small matrix, matrices of a conversation are chained from its end, walks from its start, and then every
section is repaired on its own. Equal rows are counted before that, so a row that fills a conversation is one row with a count.

Null roles and texts are one space (a role that no rule knows, a blank text). A null conv_id is a conversation of its own, null turns come first, repeated rows are duplicates, an empty table gives an
empty table, and other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, staged, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LIMIT, LIMIT_BYTES = 1 << 16, 1 << 26
_WHITE = " \t\n\x0b\x0c\r"
_KEY = ["conv_id", "turn", "role", "text"]
_FAR = 1 << 60
# states: nothing yet, after s, after u, after a; the state that the role which must follow leads to
_NEXT = (2, 2, 3, 2)
_NAMES = {2: "user", 3: "assistant"}
_KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_END = (0, _FAR, _FAR, 0)  # distances after the last row


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(edit, from, to, cost) over a row that need not go; a code is the place of its role's initial in `sua`, or 3, and 4 more where it is truncated."""
    more = TRUNCATED if code >= 4 else 0
    initial = "sua-"[code % 4]
    kept = [("K", s, _KEPT[initial, s], KEEP + more) for s in range(4) if (initial, s) in _KEPT]
    return kept + [("R", s, _NEXT[s], REROLE + more) for s in range(4)] + [("D", s, s, DELETE) for s in range(4)]


_ROW = [_arcs(code) for code in range(8)]
_BACK = [[[(p, c) for _, p, t, c in arcs if t == s] for s in range(4)] for arcs in _ROW]
_INSERTED = [[p for p in range(4) if _NEXT[p] == s] for s in range(4)]
_FROM = [[sorted((e, t, c) for e, p, t, c in arcs if p == s) for s in range(4)] for arcs in _ROW]
_LARGEST = max(c for arcs in _ROW for *_, c in arcs)


def distances(codes: bytes, after: tuple[int, ...] = _END) -> list[list[int]]:
    """Distance to the end of each state before each row and after the last, by Dial's buckets; `after` has what follows the last row."""
    n = len(codes)
    dist = [[_FAR] * 4 for _ in range(n + 1)]
    known = [x for x in after if x < _FAR]
    low = min(known)
    size = max(_LARGEST, max(known) - low) + 1
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    waiting = 0
    for s, x in enumerate(after):
        if x < _FAR:
            dist[n][s] = x
            buckets[(x - low) % size].append((n, s))
            waiting += 1
    d = low
    while waiting:
        bucket = buckets[(d - low) % size]
        while bucket:
            i, s = bucket.pop()
            waiting -= 1
            if dist[i][s] != d:
                continue  # found again nearer
            at = dist[i]
            for p in _INSERTED[s]:
                if d + INSERT < at[p]:
                    at[p] = d + INSERT
                    buckets[(d + INSERT - low) % size].append((i, p))
                    waiting += 1
            if i:
                at = dist[i - 1]
                for p, c in _BACK[codes[i - 1]][s]:
                    if d + c < at[p]:
                        at[p] = d + c
                        buckets[(d + c - low) % size].append((i - 1, p))
                        waiting += 1
        d += 1
    return dist


@lru_cache(1 << 14)
def _short_walk(codes: bytes, after: tuple[int, ...], state: int, last: bool) -> tuple[int, tuple[str, ...], int]:
    return _walk(codes, after, state, last)


def _walk(codes: bytes, after: tuple[int, ...], state: int, last: bool) -> tuple[int, tuple[str, ...], int]:
    """(distance, edits up to and with each row and after the last, state at the end): the least string of edits along tight arcs."""
    dist = distances(codes, after)
    total, edits, own, i = dist[0][state], [], "", 0
    while i < len(codes):
        d = dist[i][state]
        options = [(e, t, i + 1) for e, t, c in _FROM[codes[i]][state] if dist[i + 1][t] + c == d]
        if dist[i][_NEXT[state]] + INSERT == d:
            options.append(("I", _NEXT[state], i))
        e, state, to = min(options)
        own += e
        if to > i:
            edits.append(own)
            own = ""
        i = to
    while last and dist[i][state]:
        own, state = own + "I", _NEXT[state]
    return total, (*edits, own), state


def walk(codes: bytes, after: tuple[int, ...] = _END, state: int = 0, last: bool = True) -> tuple[int, tuple[str, ...], int]:
    return (_short_walk if len(codes) <= 64 else _walk)(codes, after, state, last)


def fault(text: str, seen: bool) -> str:
    bare = text.rstrip(_WHITE)
    return "blank" if not bare else "duplicate" if seen else "" if bare[-1] in ".!?" else "truncated"


def code_of(role: str, truncated: bool) -> int:
    return ("sua".find(role[0]) % 4 if role else 3) + 4 * truncated


class Section:
    """Rows of a conversation, in order, and what repairs them."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int, str]] = []  # role, text, copies, fault of the first copy
        self.seen: set[tuple[str, str]] = set()
        self.turns: set[int] = set()

    def add(self, turn: int | None, role: str, text: str, copies: int = 1, seen: bool | None = None) -> None:
        """`seen` says whether an earlier row is equal; without it, this section's own rows decide."""
        if seen is None:
            seen = (role, text) in self.seen
            self.seen.add((role, text))
        if turn is not None:
            self.turns.add(turn)
        self.rows.append((role, text, copies, fault(text, seen)))

    def codes(self) -> bytes:
        return bytes(code_of(role, f == "truncated") for role, _, _, f in self.rows if f in ("", "truncated"))

    def repair(self, after: tuple[int, ...] = _END, state: int = 0, last: bool = True) -> tuple:
        """(first initial, last initial, blank, duplicate, truncated, illegal, cost, audit, repaired roles and texts)."""
        total, edits, end = walk(self.codes(), after, state, last)
        total -= 0 if last else after[end]
        count, illegal, before, audit, out, turn = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, [], [], iter(edits)

        def apply(letters: str, role: str = "", text: str = "") -> None:
            nonlocal state
            audit.append(letters)
            for e in letters:
                if e in "IR":
                    state = _NEXT[state]
                    out.append({"role": _NAMES[state], "text": text if e == "R" else ""})
                elif e == "K":
                    state = _KEPT[role[0], state]
                    out.append({"role": role, "text": text})

        for role, text, copies, f in self.rows:
            initial = role[:1]
            illegal += (before is not None and (before + initial) not in ("su", "ua", "au")) + copies - 1
            before = initial
            forced = copies if f in ("blank", "duplicate") else copies - 1
            if f:
                count[f] += copies if f == "blank" else 1
            if f != "blank":
                count["duplicate"] += copies - 1
            if forced < copies:
                apply(next(turn), role, text)
            total += DELETE * forced
            apply("D" * forced)
        apply(next(turn))
        return self.rows[0][0][:1], before, count["blank"], count["duplicate"], count["truncated"], illegal, total, "".join(audit), out


_SECTION = "conv_id long, section int, gaps long, first string, last string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("section", pa.int32()), ("gaps", pa.int64()), ("first", pa.string()), ("last", pa.string())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs conversations of one section in rows sorted by conversation and order."""
    section, key, done = Section(), None, []

    def finish() -> None:
        gaps = max(section.turns) - min(section.turns) + 1 - len(section.turns) if section.turns else 0
        done.append((key, 0, gaps, *section.repair()))

    for b in batches:
        for conv, turn, role, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if section.rows and conv != key:
                finish()
                section = Section()
            key = conv
            section.add(turn, role, text)
        if done:
            yield _table(done)
            done = []
    if section.rows:
        finish()
        yield _table(done)


def _same(a: DataFrame, b: DataFrame, how: str, *names: str) -> DataFrame:
    """a joined to b on columns that may be null; b's columns of that name go."""
    other = b.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in b.columns])
    meets = F.lit(True)
    for c in names:
        meets &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, meets, how).drop(*[f"_{c}" for c in names])


def _in_sections(rows: DataFrame, size: int) -> DataFrame:
    """(conv_id, section, place, turn, role, text, copies, seen) of long conversations: equal rows counted, range-sorted into `size` sections."""
    one = rows.groupBy(*_KEY).agg(F.count("*").alias("copies"))
    one = staged(one, "conversation-rows")
    # the first turn of each role and text; a null turn is the earliest, and structs order nulls first
    first = one.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("first"))
    marked = _same(one, first, "inner", "conv_id", "role", "text").withColumn("seen", ~F.col("first.turn").eqNullSafe(F.col("turn"))).drop("first")
    marked = staged(marked, "conversation-marked")
    ordered = marked.repartitionByRange(size, *[F.col(c).asc_nulls_first() for c in _KEY]).sortWithinPartitions(*_KEY)
    return staged(ordered.withColumns({"section": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "conversation-sections")


def _codes(t: pd.DataFrame) -> bytes:
    return bytes(t.sort_values("place")["code"].astype(int).tolist())


def _repair_long(rows: DataFrame, size: int) -> DataFrame:
    """Sections of long conversations, repaired; gaps of all of a conversation stand in each of its sections."""
    spread = _in_sections(rows, size)
    bare = F.regexp_replace("text", r"[ \t\n\x0B\f\r]+\z", "")
    open_end = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    # a section without a row of its own in the graph keeps a mark, so that it is chained too
    coded = spread.select("conv_id", "section", "place", F.when((bare == "") | F.col("seen"), -1).otherwise(initial + F.when(open_end, 4).otherwise(0)).alias("code"))

    def matrix(t: pd.DataFrame) -> pd.DataFrame:
        codes = _codes(t[t["code"] >= 0])
        ways = [distances(codes, tuple(0 if x == y else _FAR for y in range(4)))[0] for x in range(4)]
        return pd.DataFrame({"conv_id": t["conv_id"].iloc[:1], "section": t["section"].iloc[:1], "ways": [[ways[x][s] for s in range(4) for x in range(4)]]})

    def chain_back(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("section", ascending=False)
        # insertions after a conversation's last row belong to its last section
        after, out = (0, 2 * INSERT, INSERT, 0), []
        for k, ways in enumerate(t["ways"]):
            out.append(list(after if k else _END))
            after = tuple(int(min(ways[4 * s + x] + after[x] for x in range(4))) for s in range(4))
        return t.assign(after=out, last=[k == 0 for k in range(len(t))])[["conv_id", "section", "after", "last"]]

    def ends(t: pd.DataFrame) -> pd.DataFrame:
        codes, after, last = _codes(t[t["code"] >= 0]), tuple(int(x) for x in t["after"].iloc[0]), bool(t["last"].iloc[0])
        return pd.DataFrame({"conv_id": t["conv_id"].iloc[:1], "section": t["section"].iloc[:1], "leads": [[walk(codes, after, s, last)[2] if distances(codes, after)[0][s] < _FAR else s for s in range(4)]]})

    def chain_on(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("section")
        state, out = 0, []
        for leads in t["leads"]:
            out.append(state)
            state = int(leads[state])
        return t.assign(state=out)[["conv_id", "section", "state"]]

    key = "conv_id long, section int"
    ways = coded.groupBy("conv_id", "section").applyInPandas(matrix, f"{key}, ways array<long>")
    # a few rows for each section: grouped by conversation they are as many as it has sections
    after = staged(ways.groupBy("conv_id").applyInPandas(chain_back, f"{key}, after array<long>, last boolean"), "conversation-after")
    leads = _same(coded, F.broadcast(after), "inner", "conv_id", "section").groupBy("conv_id", "section").applyInPandas(ends, f"{key}, leads array<int>")
    state = leads.groupBy("conv_id").applyInPandas(chain_on, f"{key}, state int")
    border = staged(_same(after, state, "inner", "conv_id", "section"), "conversation-borders")
    gaps = spread.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))

    def repair(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        section, r = Section(), t.slice(0, 1).to_pylist()[0]
        for turn, role, text, copies, seen in zip(*(t.column(c).to_pylist() for c in ("turn", "role", "text", "copies", "seen")), strict=True):
            section.add(turn, role, text, copies, seen)
        return pa.Table.from_batches([_table([(r["conv_id"], r["section"], r["gaps"], *section.repair(tuple(r["after"]), r["state"], r["last"]))])])

    # both tables have a row or two for each section, of which there is one for `limit` rows or so
    whole = _same(_same(spread, F.broadcast(border), "inner", "conv_id", "section"), F.broadcast(gaps), "inner", "conv_id")
    return whole.groupBy("conv_id", "section").applyInArrow(repair, _SECTION)


def repair(conversations: DataFrame, limit: int = LIMIT, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Sections of repaired conversations: (conv_id, section, gaps, first, last, blank, duplicate, truncated, illegal, cost, audit, repaired), where
    repaired has the roles and texts that are left, in order, and a conversation's sections follow one another by number. `first` and `last` are role initials."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    size = F.octet_length("text")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size).alias("b")).where((F.col("n") > limit) | (F.col("b") > limit_bytes))
    long = staged(sizes, "long-conversations")  # fewer than a `limit`-th of all rows
    n, b = long.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    short = _same(rows, F.broadcast(long), "left_anti", "conv_id") if n else rows
    out = short.repartition("conv_id").sortWithinPartitions(*_KEY).mapInArrow(_stream, _SECTION)
    if n:
        out = out.union(_repair_long(_same(rows, F.broadcast(long.select("conv_id")), "left_semi", "conv_id"), 1 + n // limit + b // limit_bytes))
    else:
        discard(long)
    return out


def report(sections: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that has rows; the hash is of the repaired
    `role:text` lines. A conversation of several sections is hashed as a stream, its audit is one cell."""
    sections = staged(sections, "conversation-repairs")
    several = sections.where("section > 0").select("conv_id").union(sections.groupBy("conv_id").count().where("count > 1").select("conv_id")).distinct()
    line = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    one = _same(sections, several, "left_anti", "conv_id").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(line, 256).alias("repaired_sha256"))
    more = _same(sections, several, "left_semi", "conv_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, between, out = None, None, b"", []
        for b in batches:
            for conv, turns in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if h is None or conv != key:
                    if h is not None:
                        out.append((key, h.hexdigest()))
                    key, h, between = conv, hashlib.sha256(), b""
                for x in turns:
                    h.update(between + f"{x['role']}:{x['text']}".encode())
                    between = b"\n"
        if h is not None:
            out.append((key, h.hexdigest()))
        yield pa.RecordBatch.from_pylist([{"conv_id": c, "repaired_sha256": x} for c, x in out], pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    digest = more.select("conv_id", "section", "repaired").repartition("conv_id").sortWithinPartitions("conv_id", "section").mapInArrow(hashed, "conv_id long, repaired_sha256 string")
    w = Window.partitionBy("conv_id").orderBy("section")  # as many rows as a conversation has sections
    joint = F.concat(F.lag("last").over(w), F.col("first"))
    edges = more.withColumn("edge", F.when(joint.isNotNull() & ~joint.isin("su", "ua", "au"), 1).otherwise(0))
    total = edges.groupBy("conv_id").agg(F.first("gaps").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum("edge")).alias("illegal"), F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("section", "audit"))).alias("audits"))
    total = total.withColumn("audit", F.array_join("audits.audit", "")).drop("audits")
    return one.unionByName(_same(total, digest, "inner", "conv_id"))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after a fault that crc32 of `conv_id:turn` chooses: one row in twenty goes, one in twenty each loses its text, its stops
    or its role (user), or is repeated."""
    said: dict[str, Column] = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in _KEY}
    kind = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"])) % 20
    rows = conversations.select("conv_id", "turn", said["role"].alias("role"), said["text"].alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = report(repair(damage(given)))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = _same(given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), found, "left", "conv_id")
    return every.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLE_SQL = r"""
with recursive crc as (
  select list(list_reduce(range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, i::bigint) order by i) as t from range(256) r(i)),
kinds as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: ord(ch)::bigint),
      lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 20 as kind
  from conversations, crc),
hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from kinds where kind <> 0),
lined as (
  select *, dense_rank() over (order by conv_id nulls first) as g, row_number() over (partition by conv_id order by turn nulls first, encode(role), encode(text)) as i, substr(role, 1, 1) as c,
    rtrim(text, E' \t\n\x0B\f\r') as bare
  from hurt),
seen as (select *, row_number() over (partition by g, role, text order by i) > 1 as again, lag(c) over (partition by g order by i) as p from lined),
faults as (
  select *, case when bare = '' then 'blank' when again then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as f,
    p is not null and p || c not in ('su', 'ua', 'au') as bad from seen),
sums as (
  select g, any_value(conv_id) as conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (f = 'blank')::bigint as blank,
    count(*) filter (f = 'duplicate')::bigint as duplicate, count(*) filter (f = 'truncated')::bigint as truncated, count(*) filter (bad)::bigint as illegal, count(*) as n
  from faults group by g),
ins(s, t, price, letters, added) as (
  values (0, 0, 0, '', []::varchar[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
    (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])),
edits(s, e, c, t, price) as (
  values (0, 'D', null, 0, 4), (1, 'D', null, 1, 4), (2, 'D', null, 2, 4), (3, 'D', null, 3, 4),
    (0, 'R', null, 2, 3), (1, 'R', null, 2, 3), (2, 'R', null, 3, 3), (3, 'R', null, 2, 3),
    (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0)),
paths as (
  select g, 0::bigint as i, ins.t as s, ins.price as cost, letters as audit, added as fixed from sums, ins where ins.s = 0
  union all
  select g, i, s, cost, audit, fixed from (
    select p.g, r.i, ins.t as s, p.cost + edits.price + case when e <> 'D' and r.f = 'truncated' then 3 else 0 end + ins.price as cost, p.audit || e || letters as audit,
      p.fixed || case e when 'D' then []::varchar[] when 'K' then [r.role || ':' || r.text] else [case edits.t when 2 then 'user:' else 'assistant:' end || r.text] end || added as fixed
    from paths p join faults r on r.g = p.g and r.i = p.i + 1
      join edits on edits.s = p.s and (edits.c is null or edits.c = r.c) and (e = 'D' or r.f in ('', 'truncated'))
      join ins on ins.s = edits.t)
  qualify row_number() over (partition by g, s order by cost, audit) = 1),
best as (
  select p.* from paths p join sums on sums.g = p.g and p.i = sums.n where p.s in (0, 3) qualify row_number() over (partition by p.g order by cost, audit) = 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(fixed, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join sums on sums.conv_id is not distinct from o.conv_id left join best using (g)
"""
