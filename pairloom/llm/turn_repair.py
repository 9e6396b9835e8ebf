"""Repair of conversation structure by iterative-deepening A*.

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``.  Its rows are kept (K), given another role (R) or deleted (D),
and rows are inserted (I).  Edits are searched depth first in their ASCII order under a cost bound that grows to the least cost any cut-off
path needs; a transposition table holds, for every state (rows read, place in the pattern) that failed, the cost it is now known to need, and
closes it while less is left.  The first accepting path under the least bound that has one is the cheapest, and the first in ASCII order of these.

What remains is estimated from below: 3 for each blank or repeated row, 1 for each truncated one, and 2 for each edit needed at
neighbours that may not follow each other; one edit mends at most two such places, and only two in a row, so a chain of n of them needs n/2.

Defined results: null turns come first; rows of equal turn are ordered by role, then text; a null role or text is one space; rows whose
conv_id is null are one conversation; an empty table gives an empty table; extra columns are ignored.  Codes of one byte a row and the edits
are all that a search holds (by contract a conversation is one row of the result, so one task); time grows with the rows and with the steps from the first estimate to the cost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.common import crc32_sql, table

# What edits cost.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Places in the pattern: nothing yet, after s, after u, after a; where each initial leads, and which role may come next.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ROLE = ("user", "user", "assistant", "user")
_ENDS = (True, False, False, True)
#: One code a row: its initial where the row is sound, upper case where it is truncated, and this where it must go.
GONE = "-"


def _estimates(codes: str) -> tuple[list[int], list[int], list[str]]:
    """For each row: cost of faults from it on; edits needed after the next row that stays, chain parity; that row's initial ('' at the end).

    The second list holds 2 * edits + 1 if the chain of bad neighbours that begins at that row is odd.
    """
    n = len(codes)
    faults, edits, following = [0] * (n + 1), [0] * (n + 1), [""] * (n + 1)
    for i in range(n - 1, -1, -1):
        c = codes[i]
        if c == GONE:
            faults[i], edits[i], following[i] = faults[i + 1] + DELETE, edits[i + 1], following[i + 1]
            continue
        faults[i] = faults[i + 1] + (TRUNCATED if c.isupper() else 0)
        initial = c.lower()
        after = following[i + 1]
        bad = initial != "a" if not after else initial + after not in ("su", "ua", "au")
        need, odd = edits[i + 1] >> 1, edits[i + 1] & 1
        # A chain's edits count one for every two places: a further bad place needs a new one if the chain was even.
        edits[i] = ((need + (not odd)) << 1 | (not odd)) if bad else need << 1
        following[i] = initial
    return faults, edits, following


def repair(codes: str) -> tuple[int, str]:
    """Least cost and the edits' initials, first in ASCII order among the cheapest."""
    n = len(codes)
    faults, edits, following = _estimates(codes)

    def estimate(i: int, s: int) -> int:
        after = following[i]
        bad = after not in _NEXT[s] if after else not _ENDS[s]
        return faults[i] + 2 * ((edits[i] >> 1) + (bad and not edits[i] & 1))

    def moves(i: int, s: int) -> Iterator[tuple[str, int, int, int]]:
        """(edit, cost, rows read, place) in ASCII order of the edits."""
        if i < n:
            yield "D", DELETE, i + 1, s
        to = _NEXT[s][_ROLE[s][0]]
        yield "I", INSERT, i, to
        if i < n and codes[i] != GONE:
            own, extra = codes[i].lower(), TRUNCATED if codes[i].isupper() else 0
            if own in _NEXT[s]:
                yield "K", extra, i + 1, _NEXT[s][own]
            yield "R", REROLE + extra, i + 1, to

    failed: dict[tuple[int, int], int] = {}
    bound = estimate(0, 0)
    while True:
        # A frame: state, cost so far, moves left, least cost that a tried move is known to need, the edit being tried and its cost.
        path = [[0, 0, 0, moves(0, 0), 1 << 60, "", 0]]
        while path:
            frame = path[-1]
            i, s, spent = frame[0], frame[1], frame[2]
            if i == n and _ENDS[s]:
                return spent, "".join(f[5] for f in path[:-1])
            for edit, cost, row, place in frame[3]:
                needs = max(estimate(row, place), failed.get((row, place), 0))
                if spent + cost + needs > bound:
                    frame[4] = min(frame[4], cost + needs)
                else:
                    frame[5], frame[6] = edit, cost
                    path.append([row, place, spent + cost, moves(row, place), 1 << 60, "", 0])
                    break
            else:
                path.pop()
                failed[i, s] = max(frame[4], failed.get((i, s), 0))
                if path:
                    path[-1][4] = min(path[-1][4], path[-1][6] + failed[i, s])
        bound = failed[0, 0]


def repaired_turns(codes: str, audit: str) -> list[tuple[int | None, str | None]]:
    """(row, role) for each turn of the repaired conversation: no row for an inserted one, no role for a row that keeps its own."""
    out, row, s = [], 0, 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        own = edit == "K"
        out.append((None if edit == "I" else row, None if own else _ROLE[s]))
        s = _NEXT[s][codes[row].lower() if own else _ROLE[s][0]]
        row += edit != "I"
    return out


def coded(initials: Sequence[str], faults: Sequence[str]) -> str:
    """One code a row; initials that no role of the pattern has are all the same to it."""
    known = [i if i in ("s", "u", "a") else "x" for i in initials]
    return "".join(GONE if f in ("blank", "duplicate") else c.upper() if f == "truncated" else c for c, f in zip(known, faults, strict=True))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): rows dropped (copy null), emptied, stripped of ends, repeated or given to the user, by their checksum."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    copies = F.when(kind == 0, F.array(F.lit(None).cast("int"))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.explode(copies).alias("copy"))


def judged(turns: DataFrame) -> DataFrame:
    """(conv_id, rows): each conversation's rows in order with their first fault; rows whose copy is null have left their conversation.

    One shuffle, on conv_id, serves the search for repeats and the grouping.
    """
    dealt = turns.repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("copy")]
    seen = F.row_number().over(W.partitionBy("conv_id", F.col("copy").isNull(), "role", "text").orderBy(*order))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("seen") > 1, "duplicate").when(
        ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("sound")
    row = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "text", "copy", "seen", fault.alias("fault"))
    return dealt.withColumn("seen", seen).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("copy").isNotNull(), row))).alias("rows"))


def repaired(conversations: DataFrame) -> DataFrame:
    """Adds cost, audit and turns (row from 0 or null, role or null) to (conv_id, rows with role and fault).  Map only.

    The search sees codes only; the rows pass through unread.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        search = lru_cache(maxsize=10_000)(repair)
        plan = pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())]))
        for batch in batches:
            codes = [coded(i, f) for i, f in zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist(), strict=True)]
            found = [search(c) for c in codes]
            turns = [[{"row": r, "role": x} for r, x in repaired_turns(c, audit)] for c, (_, audit) in zip(codes, found, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column("conv_id"), "rows": batch.column("rows"), "cost": pa.array([f[0] for f in found], pa.int64()),
                "audit": pa.array([f[1] for f in found], pa.string()), "turns": pa.array(turns, plan)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in conversations.select("conv_id", "rows").schema.fields)
    given = conversations.select("conv_id", "rows", F.transform("rows", lambda r: r["role"].substr(1, 1)).alias("initials"),
                                 F.transform("rows", lambda r: r["fault"]).alias("faults"))
    return given.mapInArrow(run, f"{fields}, cost long, audit string, turns array<struct<row:int,role:string>>")


def repaired_rows(conversations: DataFrame) -> Column:
    """The turns of a repaired conversation as (role, text)."""
    return F.transform("turns", lambda t: F.struct(
        F.coalesce(t["role"], F.get("rows", t["row"])["role"]).alias("role"),
        F.when(t["row"].isNull(), "").otherwise(F.get("rows", t["row"])["text"]).alias("text")))


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    mended = repaired(judged(damaged(table(spark, folder, "conversations"))))
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    count = lambda kind: F.size(F.filter("rows", lambda r: r["fault"] == kind)).cast("long").alias(kind)
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0))
    initial = lambda i: F.get("rows", i)["role"].substr(1, 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda i: F.concat(initial(i - 1), initial(i)))
    illegal = F.when(F.size("rows") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    lines = F.transform(repaired_rows(mended), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return mended.select(
        "conv_id", gaps.cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"), illegal.cast("long").alias("illegal"),
        "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


#: The cheapest edits by dynamic programming over the rows, with the least (cost, edits) of each place in the pattern.
OP13_SQL = rf"""
with recursive given as (
    select conv_id, coalesce(conv_id::varchar, ' ') as c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations),
hurt as (
    select c, turn, case k when 4 then 'user' else role end as role,
           case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
           unnest(case k when 3 then [0, 1] else [0] end) as copy from given where k <> 0),
seen as (
    select *, row_number() over (partition by c order by turn nulls first, role, text, copy, nth) as place, nth > 1 as again
    from (select *, row_number() over (partition by c, role, text order by turn nulls first, copy) as nth from hurt)),
faulty as (
    select c, turn, role, text, place, role[1] as ini, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when again then 'duplicate'
           when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else 'sound' end as fault,
           lag(role[1]) over (partition by c order by place) || role[1] as pair from seen),
counted as (
    select c, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank,
           count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
           count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(place) as n from faulty group by c),
-- Place 0: nothing yet, 1: after s, 2: after u, 3: after a.
best as (
    select c, 0 as place, row(0, '') as b0, row(100000000, '') as b1, row(100000000, '') as b2, row(100000000, '') as b3 from counted
    union all
    select c, place + 1, row(x0[1] + 3, x0[2] || 'D'),
           list_sort([row(x1[1] + 3, x1[2] || 'D'), row(x0[1] + kept + (case ini when 's' then 0 else 100000000 end), x0[2] || 'K')])[1],
           list_sort([row(x2[1] + 3, x2[2] || 'D'), row(u[1] + kept + (case ini when 'u' then 0 else 100000000 end), u[2] || 'K'),
                      row(u[1] + kept + 2, u[2] || 'R')])[1],
           list_sort([row(x3[1] + 3, x3[2] || 'D'), row(x2[1] + kept + (case ini when 'a' then 0 else 100000000 end), x2[2] || 'K'),
                      row(x2[1] + kept + 2, x2[2] || 'R')])[1]
    from (select *, list_sort([x0, x1, x3])[1] as u from (
        select c, b.place, ini, case fault when 'sound' then 0 when 'truncated' then 1 else 100000000 end as kept, b0 as x0, b1 as x1,
               list_sort([b2, row(b0[1] + 2, b0[2] || 'I'), row(b1[1] + 2, b1[2] || 'I'), row(b3[1] + 2, b3[2] || 'I')])[1] as x2,
               list_sort([b3, row(b2[1] + 2, b2[2] || 'I'), row(b0[1] + 4, b0[2] || 'II'), row(b1[1] + 4, b1[2] || 'II')])[1] as x3
        from best b join faulty f using (c) where f.place = b.place + 1))),
ended as (
    select c, list_sort([b0, b3, row(b2[1] + 2, b2[2] || 'I'), row(b1[1] + 4, b1[2] || 'II')])[1] as least
    from best join counted using (c) where place = n),
edits as (
    select c, k, edit, count(*) filter (edit <> 'I') over (partition by c order by k) as place,
           count(*) filter (edit <> 'D') over (partition by c order by k) as o
    from (select c, unnest(range(len(least[2]))) as k, unnest(string_split(least[2], '')) as edit from ended where least[2] <> '')),
turns as (
    select e.c, k, edit, o, role, text, max(case when o = 1 and edit = 'K' and ini = 's' then 1 else 0 end) over (partition by e.c) as has_s
    from edits e left join faulty f on e.c = f.c and e.place = f.place where edit <> 'D'),
lines as (
    select c, string_agg(case when edit = 'K' then role when (o - has_s) % 2 = 1 then 'user' else 'assistant' end || ':' ||
                         case when edit = 'I' then '' else text end, chr(10) order by k) as line from turns group by c)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(least[1], 0)::bigint as cost,
       coalesce(least[2], '') as audit, sha256(coalesce(line, '')) as repaired_sha256
from (select distinct conv_id, c from given) left join counted using (c) left join ended using (c) left join lines using (c)"""
