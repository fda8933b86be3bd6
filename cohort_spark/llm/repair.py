"""Repair of conversation structure as a lightest derivation (Knuth's agenda).

A repaired conversation reads ``(s?(ua)+)?`` in role initials.  The item (i, q)
says that the rows from i on can be finished from state q of that pattern; its
value is the cost and the audit (one initial an edit) of the best way.  The
deductions end at a row or at an insertion:

    Keep, Rerole, Delete   (i + 1, q')  ->  (i, q)
    Insert                 (i, q')      ->  (i, q)

Each puts its letter before the audit and adds its cost, so of two ways to one
item the better stays the better.  The agenda pops items by (cost, rows covered,
audit).  A deduction raises the cost or, if it is free, the rows covered, so the
functions are superior, a popped item is final, and the goal (0, start) ends
the work when it is popped.

Equal rows of one turn are one row with a count.  A conversation of more than
``LONG`` rows is cut into blocks of the sorted table: a block's agenda starts
from each state it may end in, and the blocks' derivations, hyperedges from
(block, q, q') and an item after it, are put together from the last to the first.
A block leaves insertions at its end to the next one, so two audits of one block
are never one the start of the other, and the whole is as exact as in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.tables import tasks_for
from cohort_spark.sources.stages import stage

#: Costs of edits; an undeleted truncated row costs more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation, and about those of a block, that one agenda works on.
LONG = 2000
#: State after the next role's initial; states a conversation may end in, 0 at its start.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
#: The role that an edit writes in each state.
WRITTEN = {0: "user", 1: "user", 2: "assistant", 3: "user"}
_INTO: dict[int, list[tuple[int, str]]] = {}
for (_before, _initial), _after in STEP.items():
    _INTO.setdefault(_after, []).append((_before, _initial))

Value = tuple[int, str]


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    copies: int
    blank: bool
    seen: bool
    cut: bool

    @property
    def deleted(self) -> bool:
        return self.blank or self.seen


def lightest(rows: list[Row], ends: dict[int, Value], goal: int | None = None, after: bool = True) -> dict[int, Value]:
    """Best values of the items (0, q), from the ``ends`` given after the last row.

    Stops at the ``goal`` state if there is one; ``after`` allows insertions after the last row.
    """
    n = len(rows)
    agenda = [(cost, 0, audit, q) for q, (cost, audit) in ends.items()]
    agenda.sort()
    final: set[tuple[int, int]] = set()
    found: dict[int, Value] = {}
    while agenda:
        cost, covered, audit, q = heappop(agenda)
        if (covered, q) in final:
            continue
        final.add((covered, q))
        i = n - covered
        if i == 0:
            found[q] = (cost, audit)
            if q == goal:
                break
        if i < n or after:
            for before, initial in _INTO.get(q, ()):
                if initial != "s" and (covered, before) not in final:
                    heappush(agenda, (cost + INSERT, covered, "I" + audit, before))
        if i == 0:
            continue
        row = rows[i - 1]
        gone = row.copies if row.deleted else row.copies - 1
        cost, audit, covered = cost + DELETE * gone, "D" * gone + audit, covered + 1
        if row.deleted:
            heappush(agenda, (cost, covered, audit, q))
            continue
        heappush(agenda, (cost + DELETE, covered, "D" + audit, q))
        more = TRUNCATED if row.cut else 0
        for before, initial in _INTO.get(q, ()):
            if initial == row.role[:1]:
                heappush(agenda, (cost + more, covered, "K" + audit, before))
            if initial != "s":
                heappush(agenda, (cost + more + REROLE, covered, "R" + audit, before))
    return found


def edits(rows: list[Row], audit: str, state: int = 0) -> Iterator[tuple[str, int | None, str | None, str | None]]:
    """(edit, turn, role, text) for each letter; role and text are those after it, missing if deleted."""
    each = (row for row in rows for _ in range(row.copies))
    for letter in audit:
        if letter == "I":
            row, role, text = None, WRITTEN[state], ""
        else:
            row = next(each)
            role, text = (row.role if letter == "K" else WRITTEN[state]), row.text
        if letter == "D":
            yield letter, row.turn, None, None
            continue
        state = STEP[state, role[:1]]
        yield letter, None if row is None else row.turn, role, text


def faults(rows: list[Row]) -> dict[str, object]:
    """Faults of a run of rows in order; the first and last initial, for what meets between runs."""
    initials = [row.role[:1] for row in rows]
    pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return {"blank": sum(r.copies for r in rows if r.blank),
            "duplicate": sum(r.copies if r.seen else r.copies - 1 for r in rows if not r.blank),
            "truncated": sum(r.cut and not r.deleted for r in rows),
            "illegal": pairs + sum(r.copies - 1 for r in rows),
            "first": initials[0], "last": initials[-1]}


_ROW = "turn long, role string, text string, copies long, blank boolean, seen boolean, cut boolean"
_EDITS = "cid string, place long, edit string, turn long, role string, text string"
_FAULTS = "blank long, duplicate long, truncated long, illegal long"
_REPAIRED = f"{_EDITS}, {_FAULTS}, cost long, audit string"


def _batches(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of some thousand rows or some megabytes of text."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, str))
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[Row]]]:
    """Rows of each run of equal keys, the first columns; the others make up a Row."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for key, run in groupby(rows, key=lambda r: r[:keys]):
        yield key, [Row(*r[keys:]) for r in run]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        for (cid,), rows in _runs(batches, 1):
            cost, audit = lightest(rows, {q: (0, "") for q in ENDS}, goal=0)[0]
            f = faults(rows)
            yield (cid, -1, None, None, None, None, f["blank"], f["duplicate"], f["truncated"], f["illegal"], cost, audit)
            for place, edit in enumerate(edits(rows, audit)):
                yield (cid, place, *edit, *[None] * 6)
    return _batches(out(), _REPAIRED)


_BLOCKS = f"cid string, block long, enter long, leave long, cost long, audit string, {_FAULTS}, first string, last string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's best derivation between any two states."""
    def out():
        for (cid, block), rows in _runs(batches, 2):
            f = faults(rows)
            for leave in range(4):
                for enter, (cost, audit) in lightest(rows, {leave: (0, "")}, after=False).items():
                    yield (cid, block, enter, leave, cost, audit, *f.values())
    return _batches(out(), _BLOCKS)


_PIECES = f"cid string, block long, place long, enter long, piece string, {_FAULTS}, cost long, audit string"


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of a conversation from its blocks, sorted from the last to the first, and each block's piece of it."""
    def out():
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for cid, blocks in groupby(rows, key=lambda r: r[0]):
            best = lightest([], {q: (0, "") for q in ENDS})
            tail, taken, f, after = best, [], [0, 0, 0, 0], None
            for block, ways in groupby(blocks, key=lambda r: r[1]):
                now: dict[int, tuple[Value, int, str]] = {}
                for _, _, enter, leave, cost, audit, *counts in ways:
                    if leave in best:
                        way = ((cost + best[leave][0], audit + best[leave][1]), leave, audit)
                        now[enter] = min(now.get(enter, way), way)
                taken.append((block, now))
                best = {q: way[0] for q, way in now.items()}
                f = [a + b for a, b in zip(f, counts[:4])]
                f[3] += after is not None and counts[5] + after not in ("su", "ua", "au")
                after = counts[4]
            cost, audit = best[0]
            yield (cid, -1, -1, None, None, *f, cost, audit)
            state, place = 0, 0
            for block, now in reversed(taken):
                _, leave, piece = now[state]
                yield (cid, block, place, state, piece, *[None] * 6)
                state, place = leave, place + len(piece)
            # insertions after the last row
            yield (cid, -2, place, state, tail[state][1], *[None] * 6)
    return _batches(out(), _PIECES)


def _edit_block(key: tuple, rows: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    held = [Row(None if pd.isna(r.turn) else int(r.turn), r.role, r.text, int(r.copies), bool(r.blank), bool(r.seen), bool(r.cut))
            for r in rows.sort_values("at").itertuples()] if len(rows) else []
    out = []
    for piece in pieces.itertuples():
        out += [(piece.cid, int(piece.place) + i, *edit) for i, edit in enumerate(edits(held, piece.piece, int(piece.enter)))]
    frame = pd.DataFrame(out, columns=["cid", "place", "edit", "turn", "role", "text"])
    frame["turn"] = frame["turn"].astype("Int64")
    return frame


def _marked(turns: DataFrame) -> DataFrame:
    """Distinct rows with their count and faults."""
    rows = turns.groupBy("cid", "turn", "role", "text").agg(F.count("*").alias("copies"))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    when = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    rows = rows.withColumn("key", key)
    # of role and text found in several turns, the first turn
    often = (rows.groupBy("cid", "key").agg(F.min(when).alias("first"), F.count("*").alias("turns")).where("turns > 1")
             .select("cid", "key", "first"))
    spaces = r"[\x20\x09-\x0D]"
    return (rows.join(often, ["cid", "key"], "left")
            .select("cid", "turn", "role", "text", "copies", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                    F.coalesce(when > F.col("first"), F.lit(False)).alias("seen"),
                    (~F.col("text").rlike(rf"[.!?]{spaces}*\z")).alias("cut")))


def repair(turns: DataFrame, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """Faults, cost and audit of each conversation (conv_id, turn, role, text), and its edits in order.

    Returns (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)
    and (conv_id, place, edit, turn, role, text), role and text being those
    after the edit, null where it deletes.  Rows go by turn, missing ones first,
    then by role and text; a missing role or text is one space, a missing
    conversation one of its own.  A role counts by its first character, an empty
    one fits nowhere.  Other columns take no part; no rows give no conversation.
    """
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType
    cid = F.when(F.col("conv_id").isNull(), " ").otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    turns = turns.select(cid.alias("cid"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                         F.coalesce("text", F.lit(" ")).alias("text"))
    marked = stage(_marked(turns), "marked")
    order = ("cid", F.asc_nulls_first("turn"), "role", "text")
    columns = [f.split()[0] for f in _ROW.split(", ")]
    large = stage(marked.groupBy("cid").agg(F.count("*").alias("n")).where(F.col("n") > long), "large")
    short = (marked.join(large, "cid", "left_anti").repartition(tasks_for(spark), "cid").sortWithinPartitions(*order)
             .select("cid", *columns).mapInArrow(_whole, _REPAIRED))
    parts = [stage(short, "repaired")]
    blocks = large.agg(F.ceil(F.sum("n") / long)).first()[0]
    if blocks:
        cut = stage(marked.join(large, "cid", "left_semi").repartitionByRange(max(blocks, 2), *order).sortWithinPartitions(*order)
                    .withColumn("at", F.monotonically_increasing_id()), "cut").withColumn("block", F.shiftright("at", 33))
        ways = stage(cut.repartition(tasks_for(spark), "cid", "block").sortWithinPartitions("cid", "block", "at")
                     .select("cid", "block", *columns).mapInArrow(_blocks, _BLOCKS), "ways")
        pieces = stage(ways.repartition(tasks_for(spark), "cid").sortWithinPartitions("cid", F.desc("block"))
                       .mapInArrow(_chosen, _PIECES), "pieces")
        done = (cut.groupBy("cid", "block").cogroup(pieces.where("piece is not null").groupBy("cid", "block"))
                .applyInPandas(_edit_block, _EDITS))
        heads = pieces.where("block = -1").drop("block", "enter", "piece")
        parts.append(stage(done.unionByName(heads, allowMissingColumns=True), "repaired"))
    repaired = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    given = F.expr("if(cid = ' ', null, substring(cid, 2))").cast(kind).alias("conv_id")
    per_turn = marked.where("turn is not null").groupBy("cid", "turn").agg(F.lit(1).alias("one"))
    gaps = per_turn.groupBy("cid").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    summary = (repaired.where("place = -1").join(gaps, "cid", "left")
               .select(given, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    return summary, repaired.where("place >= 0").select(given, "place", "edit", "turn", "role", "text")


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the repaired ``role:text`` lines of each conversation, read one at a time."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
            for cid, run in groupby(rows, key=lambda r: r[0]):
                digest = hashlib.sha256()
                for n, (_, role, text) in enumerate(run):
                    digest.update(f"{chr(10) if n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                yield cid, digest.hexdigest()
        return _batches(out(), "cid string, sha256 string")

    spark, kind = lines.sparkSession, lines.schema["conv_id"].dataType
    kept = lines.where("edit <> 'D'").withColumn("cid", F.col("conv_id").cast("string"))
    return (kept.repartition(tasks_for(spark), "cid").sortWithinPartitions("cid", "place").select("cid", "role", "text")
            .mapInArrow(task, "cid string, sha256 string").select(F.col("cid").cast(kind).alias("conv_id"), "sha256"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of conversation and turn; a missing value counts as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return (turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"),
                         F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text")))


def damaged_and_repaired(turns: DataFrame, long: int = LONG) -> DataFrame:
    """One row for each original conversation: faults, cost, audit and digest of its repair after :func:`damage`."""
    summary, lines = repair(damage(turns), long)
    all_ids = turns.select("conv_id").distinct()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    found = (all_ids.join(summary.withColumnRenamed("conv_id", "sid"), same("conv_id", "sid"), "left")
             .join(digests(lines).withColumnRenamed("conv_id", "did"), same("conv_id", "did"), "left"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


REPAIR_SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce([i] || range(8),
           lambda c, j: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))) as step),
spaced as (
  select conv_id, case when conv_id is null then ' ' else 'c' || conv_id end as cid, turn,
         coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations),
kinds as (
  select spaced.*, xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda x: ascii(x)::bigint),
                                   lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
  from spaced, crc),
damaged as (
  select conv_id, cid, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from kinds where kind <> 0),
placed_rows as (
  select *, row_number() over (partition by cid order by turn nulls first, role, text) as i from damaged),
marked as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, left(role, 1) as initial,
         row_number() over (partition by cid, role, text order by i) > 1 as seen,
         not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as cut,
         count(*) over (partition by cid) as n,
         lag(left(role, 1)) over (partition by cid order by i) as earlier
  from placed_rows),
faults as (
  select cid, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
         count(*) filter (seen and not blank) as duplicate, count(*) filter (cut and not seen and not blank) as truncated,
         count(*) filter (earlier is not null and earlier || initial not in ('su', 'ua', 'au')) as illegal
  from marked group by cid),
step(p, initial, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
put(p, q, m) as (
  select unnest([0, 1, 2, 3]), unnest([0, 1, 2, 3]), 0
  union all select p, q, 1 from step where initial <> 's'
  union all select x.p, y.q, 2 from step x join step y on x.q = y.p and x.initial <> 's' and y.initial <> 's'),
edit(p, q, letter, initial, cost) as (
  select p, p, 'D', null, 4 from put where m = 0
  union all select p, q, 'K', initial, 0 from step
  union all select p, q, 'R', null, 3 from step where initial <> 's'),
ways as (
  select put.p, edit.q, repeat('I', put.m) || letter as letters, letter, initial, 3 * put.m + edit.cost as cost
  from put join edit on put.q = edit.p),
value(cid, i, p, best) as (
  select cid, n + 1, p, min(lpad((3 * m)::varchar, 9, '0') || repeat('I', m))
  from (select distinct cid, n from marked), put where q in (0, 3) group by cid, n, p
  union all
  select v.cid, v.i - 1, w.p,
         min(lpad((left(best, 9)::bigint + w.cost + case when w.letter <> 'D' and r.cut then 3 else 0 end)::varchar, 9, '0')
             || letters || substr(best, 10))
  from value v join marked r on r.cid = v.cid and r.i = v.i - 1
  join ways w on w.q = v.p and (w.letter = 'D' or not (r.blank or r.seen)) and (w.initial is null or w.initial = r.initial)
  group by v.cid, v.i, w.p),
audits as (select cid, left(best, 9)::bigint as cost, substr(best, 10) as audit from value where i = 1 and p = 0),
letters as (
  select cid, generate_subscripts(string_split(audit, ''), 1) as pos, unnest(string_split(audit, '')) as letter
  from audits where audit <> ''),
placed as (
  select *, sum((letter <> 'I')::int) over (partition by cid order by pos) as i,
         sum((letter <> 'D')::int) over (partition by cid order by pos) as turn_no
  from letters),
kept as (
  select p.cid, p.pos, p.letter, p.turn_no, r.role, case when p.letter = 'I' then '' else r.text end as text,
         max((p.turn_no = 1 and p.letter = 'K' and r.initial = 's')::int) over (partition by p.cid) as first_s
  from placed p left join marked r on r.cid = p.cid and r.i = p.i and p.letter <> 'I' where p.letter <> 'D'),
hashed as (
  select cid, sha256(string_agg(
           case when letter = 'K' then role when (turn_no - first_s) % 2 = 1 then 'user' else 'assistant' end || ':' || text,
           chr(10) order by pos)) as repaired_sha256
  from kept group by cid)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
       coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id, cid from spaced) c
left join faults using (cid) left join audits using (cid) left join hashed using (cid)
"""
