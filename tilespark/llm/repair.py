"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A repaired conversation reads ``system`` at most once, at its head, then pairs of
``user`` and ``assistant``, or is empty.  An item ``(i, state)`` says that the first ``i`` rows
can be edited to a text that leaves the grammar in ``state``; its weight is (cost,
audit), the edits' costs added and their initials in order.  Edits are deductions
from one item to the next, and both parts of the weight only grow, so the agenda
pops items by weight and an item's first pop is final (Knuth 1977).  Items joined
over a longer stretch of rows are deductions with two premises: the weight of a
stretch between two states is the least over all states in its middle.

A conversation may hold a third of all rows.  Rows are range-sorted by
conversation and turn, equal rows of a batch merged first, so it is dealt over
many tasks; each task cuts its rows into pieces of at most ``PIECE_ROWS``.  A
conversation of one piece is finished there.  The pieces of longer ones first learn
which of their texts occurred in an earlier piece (a group-by and a join on
hashes, one entry for each text and piece), then each is solved between all
pairs of states, and the solutions are joined 64 at a time, level by level, by the same agenda.
Only the long conversations' own rows move a second time.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.llm.common import partitions, stored
from tilespark.session import bound_arrow_batches, ship_by_value

PIECE_ROWS, PIECE_CHARS = 512, 1 << 20
FAN = 64
WHITE = " \t\n\v\f\r"
#: States: nothing yet, after system, after user, after assistant; a repaired text ends in ENDS.
HEAD, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (HEAD, ASSISTANT)
NEXT = {(HEAD, "s"): SYSTEM, (HEAD, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, UNREPAIRED = 1, 2, 5, 5
FAULTS = ("", "blank", "duplicate", "truncated")

Weight = tuple[int, str]
#: A stretch of rows: weight for each pair of states that can be reached.
Solved = dict[tuple[int, int], Weight]


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    copies: int  # equal rows behind each other
    fault: int  # of the first of them; the others are duplicates, or blank like it


class Repaired(NamedTuple):
    conversations: DataFrame
    rows: DataFrame


# ------------------------------------------------------------ the agenda

def lightest(start: tuple, deductions: Callable[[tuple, Weight], Iterable[tuple[tuple, Weight]]], goals: Callable[[tuple], bool],
             enough: int) -> dict[tuple, Weight]:
    """Pop items by weight, from ``start`` on; an item's first pop is final.  Ends when ``enough`` goal items are.

    The weight of a consequence must not be below its premise's (a superior function).
    """
    final: dict[tuple, Weight] = {}
    best: dict[tuple, Weight] = {start: (0, "")}
    agenda: list[tuple[Weight, tuple]] = [((0, ""), start)]
    while agenda and enough:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        enough -= goals(item)
        for other, w in deductions(item, weight):
            if other not in final and (other not in best or w < best[other]):
                best[other] = w
                heapq.heappush(agenda, (w, other))
    return final


def row_edits(row: Row, state: int) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, initials) of every edit of a row.  Its further copies are deleted right behind it
    (an insertion is never better between them: D sorts before I)."""
    more, extra = "D" * (row.copies - 1), DELETE * (row.copies - 1)
    yield state, DELETE + extra, "D" + more
    if row.fault in (1, 2):
        return
    stays = UNREPAIRED if row.fault == 3 else 0
    after = NEXT.get((state, row.role[:1]))
    if after is not None:
        yield after, stays + extra, "K" + more
    for initial in ROLES:
        after = NEXT.get((state, initial))
        if after is not None:
            yield after, REROLE + stays + extra, "R" + more


def solve(rows: list[Row], start: int, only_ends: bool = False) -> dict[int, Weight]:
    """Least weight from ``start`` over all rows to each state (``only_ends``: to the cheapest end)."""
    n = len(rows)

    def deductions(item: tuple, weight: Weight) -> Iterator[tuple[tuple, Weight]]:
        i, state = item
        cost, audit = weight
        for initial in ROLES:
            after = NEXT.get((state, initial))
            if after is not None:
                yield (i, after), (cost + INSERT, audit + "I")
        if i < n:
            for after, c, edits in row_edits(rows[i], state):
                yield (i + 1, after), (cost + c, audit + edits)

    if only_ends:
        final = lightest((0, start), deductions, lambda x: x[0] == n and x[1] in ENDS, 1)
        return {x[1]: w for x, w in final.items() if x[0] == n and x[1] in ENDS}
    final = lightest((0, start), deductions, lambda x: x[0] == n, 4)
    return {x[1]: w for x, w in final.items() if x[0] == n}


def solve_all(rows: list[Row]) -> Solved:
    return {(s, e): w for s in range(4) for e, w in solve(rows, s).items()}


def joined(parts: list[Solved]) -> Solved:
    """Neighbouring stretches as one."""
    out: Solved = {}
    for start in range(4):
        def deductions(item: tuple, weight: Weight) -> Iterator[tuple[tuple, Weight]]:
            i, state = item
            if i < len(parts):
                for (s, e), (c, edits) in parts[i].items():
                    if s == state:
                        yield (i + 1, e), (weight[0] + c, weight[1] + edits)

        for (i, state), w in lightest((0, start), deductions, lambda x: x[0] == len(parts), 4).items():
            if i == len(parts):
                out[start, state] = w
    return out


def apply(rows: Iterable[Row], audit: Iterator[str], state: int, last: bool) -> tuple[list[tuple[str, str]], int]:
    """The (role, text) that the edits leave of ``rows``, and the state behind them.  Insertions behind
    the rows belong to the next piece, but for the last one."""
    out: list[tuple[str, str]] = []

    def inserted() -> None:
        nonlocal state
        initial = "a" if state == USER else "u"
        out.append((ROLES[initial], ""))
        state = NEXT[state, initial]

    for row in rows:
        edit = next(audit)
        while edit == "I":
            inserted()
            edit = next(audit)
        for _ in range(row.copies - 1):
            next(audit)
        if edit != "D":
            initial = row.role[:1] if edit == "K" else "a" if state == USER else "u"
            out.append((row.role if edit == "K" else ROLES[initial], row.text))
            state = NEXT[state, initial]
    if last:
        for _ in audit:
            inserted()
    return out, state


# ------------------------------------------------------------ counts

#: What is counted in a stretch of rows, and how two neighbouring stretches add up.
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail")


def own_fault(text: str) -> int:
    """1 blank, 3 truncated, 0 neither."""
    bare = text.rstrip(WHITE)
    return 1 if not bare else 0 if bare[-1] in ".!?" else 3


def counted(rows: list[Row]) -> dict:
    c = dict.fromkeys(COUNTS[:5], 0) | {"low": None, "high": None, "head": rows[0].role[:1], "tail": rows[-1].role[:1]}
    before = None
    for r in rows:
        more = r.copies - 1
        if r.fault == 1:
            c["blank"] += r.copies
        else:
            c["duplicate"] += more + (r.fault == 2)
            c["truncated"] += r.fault == 3
        initial = r.role[:1]
        c["illegal"] += more + (before is not None and before + initial not in LEGAL)
        before = initial
        if r.turn is not None:
            c["turns"] += r.turn != c["high"]
            c["low"] = r.turn if c["low"] is None else c["low"]
            c["high"] = r.turn
    return c


def added(a: dict, b: dict) -> dict:
    c = {k: a[k] + b[k] for k in COUNTS[:5]}
    c["illegal"] += a["tail"] + b["head"] not in LEGAL
    c["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return c | {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"],
                "head": a["head"], "tail": b["tail"]}


def gaps(c: dict) -> int:
    return 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"]


def with_faults(rows: list[tuple], earlier: set[bytes] = frozenset()) -> tuple[list[Row], list[bytes]]:
    """Rows (turn, role, text, copies) with their faults, and the hashes of the texts that are first here."""
    seen, out, fresh = set(earlier), [], []
    for turn, role, text, copies in rows:
        key = text_key(role, text)
        fault = own_fault(text)
        if fault != 1 and key in seen:
            fault = 2
        if key not in seen:
            seen.add(key)
            fresh.append(key)
        out.append(Row(turn, role, text, copies, fault))
    return out, fresh


def text_key(role: str, text: str) -> bytes:
    """128 bits that stand for a role and a text."""
    return blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


# ------------------------------------------------------------ the operator

OWN_COUNTS = ", ".join(f"{k} {'string' if k in ('head', 'tail') else 'long'}" for k in COUNTS)
ROW = "struct<turn:long,role:string,text:string,copies:long>"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "array<struct<role:string,text:string>>"


def _types(schema: str) -> list[T.StructField]:
    return T._parse_datatype_string(schema).fields


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def summary(c: dict, weight: Weight) -> dict:
    return {k: c[k] for k in COUNTS[:4]} | {"gaps": gaps(c), "cost": weight[0], "audit": weight[1]}


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", piece_rows: int = PIECE_ROWS) -> Repaired:
    """``conversations``: one row per id with ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``;
    ``rows``: the repaired rows in pieces (id, ``part``, ``piece``, ``whole``: the only piece, ``repaired``: array of role and text).

    Rows are taken by turn, nulls first, rows of one turn by role, then text.  A null role or text
    counts as one space, ids may be null and of any type, turns are integers.  A
    role is legal by its first character; an empty role never is, so such a row is
    given a role or deleted.  Equal rows are duplicates of the first.  Equal weights go to the
    audit that is least in ASCII.  An empty table gives no rows; further columns are ignored.
    """
    spark = turns.sparkSession
    ship_by_value("tilespark.llm.repair")
    bound_arrow_batches(spark)
    n = partitions(spark)
    id_field = T.StructField("id", turns.schema[id_col].dataType)
    space = F.lit(" ")
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"),
                        F.coalesce(F.col(text_col), space).alias("text"), F.lit(1).cast("long").alias("copies"))
    merged_type = T.StructType([id_field, *_types("turn long, role string, text string, copies long")])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # equal rows of a batch are one, so that a hot row does not go to one task as often as it occurs
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]).group_by(["id", "turn", "role", "text"], use_threads=False).aggregate([("copies", "sum")])
                yield from t.rename_columns({"copies_sum": "copies"}).select(["id", "turn", "role", "text", "copies"]).combine_chunks().to_batches()

    # what is sampled for the ranges is short, whatever the length of a text
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    sorted_rows = (rows.mapInArrow(merge, merged_type).repartitionByRange(n, *order, F.substring("text", 1, 64))
                   .sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id()))
    piece_type = T.StructType([id_field, *_types(f"part int, piece long, whole boolean, rows array<{ROW}>, fresh array<binary>, "
                                                 f"{SUMMARY}, repaired {REPAIRED}")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in order.  What begins or ends a partition may go on in another one, so it is never ``whole``."""
        out_schema: pa.Schema | None = None
        now: list = []  # pieces of the current conversation: lists of [turn, role, text, copies]
        state = {"id": None, "open": False, "first": True, "chars": 0, "part": 0, "number": 0}

        def finish(edge: bool) -> Iterator[dict]:
            for k, piece in enumerate(now):
                found, fresh = with_faults(piece)
                row = {"id": state["id"], "part": state["part"], "piece": state["number"] + k}
                if edge or len(now) > 1 or state["number"]:
                    yield row | {"whole": False, "fresh": fresh,
                                 "rows": [{"turn": r[0], "role": r[1], "text": r[2], "copies": r[3]} for r in piece]}
                else:
                    weight = min(solve(found, HEAD, only_ends=True).values())
                    kept, _ = apply(found, iter(weight[1]), HEAD, True)
                    yield row | {"whole": True, "repaired": [{"role": r, "text": t} for r, t in kept]} | summary(counted(found), weight)

        for b in batches:
            out_schema = out_schema or pa.schema([b.schema.field(0), *arrow_fields])
            done: list[dict] = []
            for i, turn, role, text, copies, part in zip(*(c.to_pylist() for c in b.columns)):
                if not state["open"] or i != state["id"]:
                    if state["open"]:
                        done += finish(state["first"])
                        state["first"] = False
                    state |= {"id": i, "open": True, "chars": 0, "part": part, "number": 0}
                    now = [[]]
                same = now[-1] and now[-1][-1][:3] == [turn, role, text]
                if same:
                    now[-1][-1][3] += copies
                    continue
                if now[-1] and (len(now[-1]) >= piece_rows or state["chars"] + len(text) > PIECE_CHARS):
                    if len(now) > 1:  # all but the last two pieces go out, so a conversation is never held whole
                        whole, now = now, now[:1]
                        done += finish(True)
                        now = whole[1:]
                        state["number"] += 1
                    now.append([])
                    state["chars"] = 0
                now[-1].append([turn, role, text, copies])
                state["chars"] += len(text)
            if done:
                yield _batch(done, out_schema)
        if state["open"]:
            yield _batch(list(finish(True)), out_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow_fields = list(to_arrow_schema(piece_type))[1:]
    pieces = stored(sorted_rows.mapInArrow(cut, piece_type), "conversation-pieces")
    columns = ["id", *(f.name for f in _types(SUMMARY))]
    short = pieces.where("whole")
    long_ = pieces.where("NOT whole").select("id", "part", "piece", "rows", "fresh")
    solved = stored(_solved(long_, id_field), "conversation-solved")
    top = stored(_joined_up(solved, id_field), "conversation-joined")
    texts = _applied(long_, top, id_field, n)
    conversations = short.select(*columns).unionByName(top.select(*columns))
    repaired = short.select("id", "part", "piece", "whole", "repaired").unionByName(texts)
    return Repaired(conversations, repaired)


def _solved(pieces: DataFrame, id_field: T.StructField) -> DataFrame:
    """Counts and weights between all states of every piece of a longer conversation."""
    place = F.struct("part", "piece")
    entries = pieces.select("id", "part", "piece", F.explode("fresh").alias("key"))
    firsts = entries.groupBy("id", "key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("id").alias("id2"), F.col("key").alias("key2"), "first")
    late = (entries.join(firsts, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))).where(place != F.col("first"))
            .groupBy("id", "part", "piece").agg(F.collect_list("key").alias("late"))  # at most the texts of a piece
            .select(F.col("id").alias("id3"), F.col("part").alias("part3"), F.col("piece").alias("piece3"), "late"))
    meet = F.col("id").eqNullSafe(F.col("id3")) & (F.col("part") == F.col("part3")) & (F.col("piece") == F.col("piece3"))
    told = pieces.drop("fresh").join(late, meet, "left").select("id", "part", "piece", "rows", "late")
    schema = T.StructType([id_field, *_types(f"part int, piece long, {OWN_COUNTS}, starts array<int>, ends array<int>, costs array<long>, audits array<string>")])
    from pyspark.sql.pandas.types import to_arrow_schema
    fields = list(to_arrow_schema(schema))[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                found, _ = with_faults([(x["turn"], x["role"], x["text"], x["copies"]) for x in r["rows"]], set(r["late"] or ()))
                out.append({"id": r["id"], "part": r["part"], "piece": r["piece"]} | counted(found) | _flat(solve_all(found)))
            yield _batch(out, pa.schema([b.schema.field(0), *fields]))

    return told.mapInArrow(run, schema)


def _flat(s: Solved) -> dict:
    return {"starts": [k[0] for k in s], "ends": [k[1] for k in s], "costs": [w[0] for w in s.values()], "audits": [w[1] for w in s.values()]}


def _unflat(r: dict) -> Solved:
    return {(s, e): (int(c), a) for s, e, c, a in zip(r["starts"], r["ends"], r["costs"], r["audits"])}


def _joined_up(solved: DataFrame, id_field: T.StructField) -> DataFrame:
    """Joins the pieces of each conversation, FAN at a time: first those of one part, then the parts."""
    schema = solved.schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["part"], r["piece"]))
        c = {k: rows[0][k] for k in COUNTS}
        for r in rows[1:]:
            c = added(c, {k: r[k] for k in COUNTS})
        best = joined([_unflat(r) for r in rows]) if len(rows) > 1 else _unflat(rows[0])
        return pa.Table.from_pylist([{"id": rows[0]["id"], "part": rows[0]["part"], "piece": rows[0]["piece"]} | c | _flat(best)],
                                    pa.schema([t.schema.field("id"), *list(arrow)[1:]]))

    for key, keep in (("piece", "part"), ("part", None)):
        top = solved.agg(F.max(key)).first()[0] or 0
        while top:  # the numbers go down FAN-fold a level, so a group never has more than FAN rows
            by = ["id", F.expr(f"{key} div {FAN}").alias("g")] + ([keep] if keep else [])
            solved = stored(solved.groupBy(*by).applyInArrow(run, schema).withColumn(key, F.expr(f"{key} div {FAN}").cast(schema[key].dataType)),
                            "conversation-level")
            top //= FAN
        if keep:
            solved = solved.withColumn("piece", F.lit(0).cast("long"))

    final = T.StructType([id_field, *_types(SUMMARY)])
    fields = list(to_arrow_schema(final))[1:]

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                weight = min(w for (s, e), w in _unflat(r).items() if s == HEAD and e in ENDS)
                out.append({"id": r["id"]} | summary(r, weight))
            yield _batch(out, pa.schema([b.schema.field(0), *fields]))

    return solved.mapInArrow(end, final)


def _applied(pieces: DataFrame, top: DataFrame, id_field: T.StructField, n: int) -> DataFrame:
    """Repaired rows of the longer conversations: a conversation's edits come first, then its pieces in order, one at a time."""
    schema = T.StructType([id_field, *_types(f"part int, piece long, whole boolean, repaired {REPAIRED}")])
    from pyspark.sql.pandas.types import to_arrow_schema
    fields = list(to_arrow_schema(schema))[1:]
    heads = top.select("id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("piece"), F.lit(None).cast(f"array<{ROW}>").alias("rows"), "audit")
    both = heads.unionByName(pieces.select("id", "part", "piece", "rows", F.lit(None).cast("string").alias("audit")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, state, held, kind = iter(""), HEAD, None, None

        def done(last: bool) -> list[dict]:
            nonlocal state
            if held is None:
                return []
            rows = [Row(x["turn"], x["role"], x["text"], x["copies"], 0) for x in held["rows"]]
            kept, state = apply(rows, audit, state, last)
            return [{"id": held["id"], "part": held["part"], "piece": held["piece"], "whole": False,
                     "repaired": [{"role": r, "text": t} for r, t in kept]}]

        for b in batches:
            kind = b.schema.field(0)
            out: list[dict] = []
            for r in b.to_pylist():
                out += done(r["rows"] is None)
                if r["rows"] is None:
                    audit, state, held = iter(r["audit"]), HEAD, None
                else:
                    held = r
            if out:
                yield _batch(out, pa.schema([kind, *fields]))
        if held is not None:
            yield _batch(done(True), pa.schema([kind, *fields]))

    dealt = both.repartition(n, "id").sortWithinPartitions(F.col("id").asc_nulls_first(), "part", "piece")
    return dealt.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """(id, ``sha256``) of each conversation's repaired ``role:text`` lines, joined by line feeds.

    A conversation of one piece is hashed where it is.  SHA-256 reads its input
    in order, so the pieces of a longer one are streamed through one hash, a piece at a time.
    """
    line = lambda x: F.concat(x["role"], F.lit(":"), x["text"])
    short = rows.where("whole").select("id", F.sha2(F.array_join(F.transform("repaired", line), "\n").cast("binary"), 256).alias("sha256"))
    id_field = rows.schema["id"]
    schema = T.StructType([id_field, T.StructField("sha256", T.StringType())])
    lines = rows.where("NOT whole").select("id", "part", "piece", F.size("repaired").alias("n"),
                                           F.array_join(F.transform("repaired", line), "\n").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        now, hashed, empty, open_, kind = None, sha256(), True, False, None
        for b in batches:
            kind, out = b.schema.field(0), []
            for i, _, _, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if not open_ or i != now:
                    if open_:
                        out.append({"id": now, "sha256": hashed.hexdigest()})
                    now, hashed, empty, open_ = i, sha256(), True, True
                if n:
                    hashed.update(data if empty else b"\n" + data)
                    empty = False
            if out:
                yield _batch(out, pa.schema([kind, pa.field("sha256", pa.string())]))
        if open_:
            yield _batch([{"id": now, "sha256": hashed.hexdigest()}], pa.schema([kind, pa.field("sha256", pa.string())]))

    parts = partitions(rows.sparkSession)
    streamed = lines.repartition(parts, "id").sortWithinPartitions(F.col("id").asc_nulls_first(), "part", "piece").mapInArrow(run, schema)
    return short.unionByName(streamed)
