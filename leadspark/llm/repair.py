r"""Conversation structure repair by bidirectional Dijkstra over an edit lattice.

A node of the lattice is (rows read, state); the state says which role came
last: nothing yet, system, user, assistant. Edges are the edits: Keep (free; the row's role initial
must fit), Rerole (2), Delete (3), Insert (2); an undeleted truncated row adds 1, blank and
duplicate rows can only be deleted. A path from the start to an accepting end is a
repaired conversation ``(s?(ua)+)?``, and its edits' initials are its audit. The state and the
edit determine the next role, so an audit determines its path.

:func:`search` runs a forward heap from the start and a reverse heap from the ends. They stop
only when no path of the least cost can be left undiscovered (top + top > least), so
each node of each cheapest path is settled from one side or the other. Among all cheapest
paths through all crossings the least audit is read off from the start: at each node the least
initial whose edge stays on a cheapest path. Nothing but costs is stored, so it is linear in the rows.

A conversation may hold any share of all rows, so nothing but a block of ``BLOCK`` rows is
ever searched at once, and texts are never gathered:

* rows are numbered by a range exchange (no conversation is sorted in one task), and a row takes
  part as one character (role initial and fault);
* a conversation of one short block is searched directly. Of a longer one each block gives its 4 x 4 costs
  from state to state; folding these from the end gives the cost that remains behind each block; with
  these as the ends' costs each block gives its least audit for each entry state, and folding the
  exits from the start picks one of them. The folds handle a few numbers per block;
* repaired rows are hashed as a stream in order of rows (a SHA-256 can't be split), in sorted partitions.

Rows of a conversation are taken by turn (nulls first), then role, then the SHA-256 of the text. Null
conv_id: a conversation of its own. Null role or text: one space. Repeated rows are rows like any other
(the later ones are duplicates). Texts of any length: only their faults and hashes are shuffled
before the last step. Further columns are left out, so their names can't clash. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.operators.grouping import row_number_per_group

from . import common

BLOCK = 512
#: States: nothing yet, and the last role.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: State behind a row of user or assistant that is put in or rerolled.
NEXT = (USER, USER, ASSISTANT, USER)
#: What closes a conversation that ends in a state.
TAIL = ("", "II", "I", "")
ENDS = tuple(2 * len(t) for t in TAIL)
#: A row's code: its role initial (s, u, a, other) + 4 * (0: sound, 1: only to be deleted, 2: truncated).
CODES = "ABCDEFGHIJKL"
NO_PATH = 1 << 60


def _keeps(initial: int, state: int) -> bool:
    return (initial == 0 and state == NONE) or (initial == 1 and state != USER) or (initial == 2 and state == USER)


def _row_edits(code: int) -> list[list[tuple[str, int, int]]]:
    """Edits of a row by entry state: (initial, cost, exit state), least initial first."""
    initial, fault = code % 4, code // 4
    out = []
    for state in range(4):
        edits = [("D", 3, state)]
        if fault != 1:
            more = fault // 2
            if _keeps(initial, state):
                edits.append(("K", more, SYSTEM if initial == 0 else USER if initial == 1 else ASSISTANT))
            edits.append(("R", 2 + more, NEXT[state]))
        out.append(edits)
    return out


EDITS = {c: _row_edits(i) for i, c in enumerate(CODES)}
#: The same edges by exit state: (cost, entry state).
BACK = {c: [[(cost, a) for a in range(4) for _, cost, z in edits[a] if z == state] for state in range(4)]
        for c, edits in EDITS.items()}
INSERT_BACK = [[a for a in range(4) if NEXT[a] == state] for state in range(4)]


def _out(codes: str, node: int) -> list[tuple[str, int, int]]:
    """Edges from a node (4 * rows read + state), in the order of their initials.
    Nothing is put in behind the last row: ``TAIL`` does that."""
    i, state = node >> 2, node & 3
    if i == len(codes):
        return []
    edits = [(e, cost, 4 * (i + 1) + z) for e, cost, z in EDITS[codes[i]][state]]
    edits.insert(1, ("I", 2, 4 * i + NEXT[state]))
    return edits


def _in(codes: str, node: int) -> list[tuple[int, int]]:
    i, state = node >> 2, node & 3
    found = [(2, 4 * i + a) for a in INSERT_BACK[state]] if i < len(codes) else []
    if i:
        found += [(cost, 4 * (i - 1) + a) for cost, a in BACK[codes[i - 1]][state]]
    return found


def _heaps(codes: str, entry: int, ends: tuple[int, ...]) -> tuple[int, dict[int, int], dict[int, int]]:
    """Least cost, and the exact costs of the nodes settled from either side."""
    n = len(codes)
    ahead, back = {entry: 0}, {4 * n + z: cost for z, cost in enumerate(ends) if cost < NO_PATH}
    # equal costs: forward by rows read, in reverse the other way, as Keep is free
    forward, reverse = [(0, entry)], sorted((cost, -node) for node, cost in back.items())
    from_start: dict[int, int] = {}
    to_end: dict[int, int] = {}
    least = min((ahead[x] + back[x] for x in ahead if x in back), default=NO_PATH)
    while forward and reverse and forward[0][0] + reverse[0][0] <= least:
        if forward[0][0] <= reverse[0][0]:
            cost, node = heapq.heappop(forward)
            if node in from_start:
                continue
            from_start[node] = cost
            for _, more, to in _out(codes, node):
                if cost + more < ahead.get(to, NO_PATH):
                    ahead[to] = cost + more
                    heapq.heappush(forward, (cost + more, to))
                    least = min(least, cost + more + back.get(to, NO_PATH))
        else:
            cost, node = heapq.heappop(reverse)
            node = -node
            if node in to_end:
                continue
            to_end[node] = cost
            for more, to in _in(codes, node):
                if cost + more < back.get(to, NO_PATH):
                    back[to] = cost + more
                    heapq.heappush(reverse, (cost + more, -to))
                    least = min(least, cost + more + ahead.get(to, NO_PATH))
    # no edge leaves the last row's nodes, so their given costs are exact
    return least, from_start, to_end | {4 * n + z: cost for z, cost in enumerate(ends) if cost < NO_PATH}


def least_cost(codes: str, entry: int, ends: tuple[int, ...]) -> int:
    return _heaps(codes, entry, ends)[0]


def search(codes: str, entry: int, ends: tuple[int, ...]) -> tuple[int, str, int]:
    """Least cost from the entry state to the ends (``ends[z]``: cost that remains in exit
    state z), the least audit of that cost, and its exit state."""
    least, from_start, to_end = _heaps(codes, entry, ends)
    n = len(codes)
    # nodes settled from the start that lie on a cheapest path
    good: set[int] = set()
    for node in reversed(from_start):  # latest settled first
        cost = from_start[node]
        if cost + to_end.get(node, NO_PATH) == least or any(
                (to in good and cost + more == from_start[to]) or cost + more + to_end.get(to, NO_PATH) == least
                for _, more, to in _out(codes, node)):
            good.add(node)
    audit, node, cost = [], entry, 0
    while node >> 2 < n:
        for edit, more, to in _out(codes, node):
            if (to in good and cost + more == from_start[to]) or cost + more + to_end.get(to, NO_PATH) == least:
                break
        else:
            raise AssertionError(f"no cheapest edge from {node} of {codes}")
        audit.append(edit)
        node, cost = to, cost + more
    return least, "".join(audit), node & 3


def replay(codes: str, entry: int, audit: str) -> list[str]:
    """Per row what stands in its place: ``u``, ``a`` for an empty row put in, ``k`` for the row, ``U``,
    ``A`` for it under another role. Rows put in at the end go with the last row."""
    out, held, state, i = [], "", entry, 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            held += "u" if state == USER else "a"
            continue
        if edit == "R":
            state = NEXT[state]
            held += "U" if state == USER else "A"
        elif edit == "K":
            state = (SYSTEM, USER, ASSISTANT)[CODES.index(codes[i]) % 4]
            held += "k"
        out.append(held)
        held, i = "", i + 1
    if held and out:
        out[-1] += held
    return out


def illegal_pairs(codes: str) -> int:
    """Adjacent role initials other than su, ua, au."""
    initials = ["suax"[CODES.index(c) % 4] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by ``crc32(conv_id:turn) % 20``: dropped, emptied, without
    sentence marks, repeated, or under the role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text, role = said("text"), said("role")
    copies = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).drop("copy")


_GROUP = ["lone", "conv"]


def _key() -> list[Column]:
    """A conversation's id with nulls set apart."""
    return [F.col("conv_id").isNull().alias("lone"), F.coalesce(F.col("conv_id"), F.lit(0)).alias("conv")]


def _stored_rows(rows: DataFrame) -> DataFrame:
    """The rows as taken, with a number each."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return common.stored(rows.select(*_key(), "turn", said("role"), said("text"),
                                     F.monotonically_increasing_id().alias("rid")), "turns")


def judged(rows: DataFrame) -> DataFrame:
    """Stored rows as ``lone, conv, turn, rid, n, code, fault``: place in the
    conversation, and first fault (``blank``, ``duplicate``, ``truncated`` or null)."""
    role, text = F.col("role"), F.col("text")
    initial = F.substring(role, 1, 1)
    keys = rows.select(
        *_GROUP, "turn", "role", F.sha2(text.cast("binary"), 256).alias("digest"), "rid",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))
    numbered = row_number_per_group(keys, _GROUP, ["turn", "role", "digest", "rid"], "n")
    again = numbered.filter("not blank").groupBy(*_GROUP, "role", "digest").agg(
        F.min("n").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    found = numbered.join(common.stored(again, "turns-again"), [*_GROUP, "role", "digest"], "left")
    fault = (F.when(F.col("blank"), "blank").when(F.col("n") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated"))
    found = found.select(*_GROUP, "turn", "rid", "n", "initial", fault.alias("fault"))
    mode = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 2).otherwise(1)
    return found.select(*_GROUP, "turn", "rid", "n", "fault",
                        F.substring(F.lit(CODES), F.col("initial") + 4 * mode + 1, F.lit(1)).alias("code"))


def _counted(found: DataFrame) -> DataFrame:
    """Gaps and faults of each conversation."""
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    return found.groupBy(*_GROUP).agg(
        F.max("turn").alias("high"), F.min("turn").alias("low"), F.countDistinct("turn").alias("turns"),
        count("blank"), count("duplicate"), count("truncated")).select(
        *_GROUP, F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated")


def _whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Conversations of one block."""
    for batch in batches:
        out = []
        for codes in batch.to_pylist():
            cost, audit, z = search(codes, NONE, ENDS)
            audit += TAIL[z]
            out.append({"cost": cost, "illegal": illegal_pairs(codes), "audit": audit, "put": replay(codes, NONE, audit)})
        yield pa.array(out, pa.struct([("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()),
                                       ("put", pa.list_(pa.string()))]))


def _block_costs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Costs of a block from each entry state (rows) to each exit state."""
    for batch in batches:
        out = []
        for codes in batch.to_pylist():
            costs = [least_cost(codes, a, tuple(0 if z == b else NO_PATH for b in range(4))) for a in range(4) for z in range(4)]
            out.append({"costs": costs, "illegal": illegal_pairs(codes), "first": codes[0], "last": codes[-1]})
        yield pa.array(out, pa.struct([("costs", pa.list_(pa.int64())), ("illegal", pa.int64()), ("first", pa.string()),
                                       ("last", pa.string())]))


def _fold_costs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """From a conversation's blocks in order: the cost that remains behind each."""
    for batch in batches:
        out = []
        for blocks in batch.to_pylist():
            ends, rest = [], list(ENDS)
            for b in reversed(blocks):
                ends.append(rest)
                rest = [min(NO_PATH, *(b["costs"][4 * a + z] + rest[z] for z in range(4))) for a in range(4)]
            illegal = sum(b["illegal"] for b in blocks) + sum(
                illegal_pairs(a["last"] + b["first"]) for a, b in zip(blocks, blocks[1:]))
            out.append({"cost": rest[NONE], "illegal": illegal, "ends": ends[::-1]})
        yield pa.array(out, pa.struct([("cost", pa.int64()), ("illegal", pa.int64()), ("ends", pa.list_(pa.list_(pa.int64())))]))


def _block_audits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A block's least audit and exit for each entry state, its ends' costs given."""
    for codes, ends in batches:
        out = []
        for c, rest in zip(codes.to_pylist(), ends.to_pylist()):
            found = [search(c, a, tuple(rest)) for a in range(4)]
            out.append([{"audit": audit, "exit": z} for _, audit, z in found])
        yield pa.array(out, pa.list_(pa.struct([("audit", pa.string()), ("exit", pa.int32())])))


def _fold_exits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """From a conversation's blocks in order: the state in which each is entered."""
    for batch in batches:
        out = []
        for exits in batch.to_pylist():
            state, entries = NONE, []
            for by_entry in exits:
                entries.append(state)
                state = by_entry[state]
            out.append({"entries": entries, "end": state})
        yield pa.array(out, pa.struct([("entries", pa.list_(pa.int32())), ("end", pa.int32())]))


def _put(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for codes, entry, audit in batches:
        yield pa.array([replay(*x) for x in zip(codes.to_pylist(), entry.to_pylist(), audit.to_pylist())], pa.list_(pa.string()))


#: What the functions on blocks and conversations return.
_RETURNS = {
    "_whole": "struct<cost:bigint,illegal:bigint,audit:string,put:array<string>>",
    "_block_costs": "struct<costs:array<bigint>,illegal:bigint,first:string,last:string>",
    "_fold_costs": "struct<cost:bigint,illegal:bigint,ends:array<array<bigint>>>",
    "_block_audits": "array<struct<audit:string,exit:int>>",
    "_fold_exits": "struct<entries:array<int>,end:int>",
    "_put": "array<string>",
}


def _run(function, *columns: str) -> Column:
    return F.arrow_udf(function, _RETURNS[function.__name__])(*columns)


def _in_order(value: Column) -> Column:
    """A block's or conversation's values in order: groups of bounded rows."""
    return F.transform(F.array_sort(F.collect_list(F.struct("at", value.alias("v")))), lambda x: x["v"])


def solved(found: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(lone, conv, cost, illegal, audit)`` per conversation, and its blocks ``(lone, conv, block, rids,
    put)`` with what stands in the place of each row."""
    at = F.struct("rid", "code")
    blocks = found.withColumn("at", F.col("n")).groupBy(*_GROUP, F.floor((F.col("n") - 1) / block).alias("block")).agg(
        _in_order(at).alias("rows"))
    blocks = common.stored(blocks.select(*_GROUP, "block", F.col("rows.rid").alias("rids"),
                                         F.array_join("rows.code", "").alias("codes")), "turn-blocks")
    is_short = (F.col("block") == 0) & (F.length("codes") < block)
    short = common.stored(blocks.filter(is_short).select(*_GROUP, "block", "rids", _run(_whole, "codes").alias("x"))
                          .select(*_GROUP, "block", "rids", "x.*"), "turn-short")
    results = short.select(*_GROUP, "cost", "illegal", "audit")
    puts = short.select(*_GROUP, "block", "rids", "put")
    long = blocks.filter(~is_short)
    if long.isEmpty():
        return results, puts
    folded = common.stored(
        long.select(*_GROUP, F.col("block").alias("at"), _run(_block_costs, "codes").alias("x")).groupBy(*_GROUP).agg(
            _in_order(F.col("x")).alias("blocks")).select(*_GROUP, _run(_fold_costs, "blocks").alias("x")).select(*_GROUP, "x.*"),
        "turn-costs")
    ends = folded.select(*_GROUP, F.posexplode("ends").alias("block", "ends"))
    audits = common.stored(long.join(ends, [*_GROUP, "block"]).select(
        *_GROUP, "block", "rids", "codes", _run(_block_audits, "codes", "ends").alias("by_entry")), "turn-audits")
    entered = common.stored(
        audits.select(*_GROUP, F.col("block").alias("at"), "by_entry.exit").groupBy(*_GROUP).agg(
            _in_order(F.col("exit")).alias("exits")).select(*_GROUP, _run(_fold_exits, "exits").alias("x")).select(*_GROUP, "x.*"),
        "turn-entries")
    tail = F.element_at(F.array(*[F.lit(t) for t in TAIL]), F.col("end") + 1)
    entries = entered.select(*_GROUP, F.posexplode("entries").alias("block", "entry"),
                             (F.size("entries") - 1).alias("last"), tail.alias("tail"))
    pieces = audits.join(entries, [*_GROUP, "block"]).select(
        *_GROUP, F.col("block").alias("at"), "rids", "codes", "entry",
        F.concat(F.element_at("by_entry", F.col("entry") + 1)["audit"],
                 F.when(F.col("block") == F.col("last"), F.col("tail")).otherwise("")).alias("audit"))
    pieces = common.stored(pieces, "turn-pieces")
    joined = pieces.groupBy(*_GROUP).agg(F.array_join(_in_order(F.col("audit")), "").alias("audit"))
    results = results.unionByName(folded.join(joined, _GROUP).select(*_GROUP, "cost", "illegal", "audit"))
    return results, puts.unionByName(pieces.select(
        *_GROUP, F.col("at").alias("block"), "rids", _run(_put, "codes", "entry", "audit").alias("put")))


def _placed(rows: DataFrame, puts: DataFrame) -> DataFrame:
    """Stored rows with what stands in their place: ``lone, conv, block, pos, put``, role and text."""
    flat = puts.select(*_GROUP, "block", F.posexplode(F.arrays_zip("rids", "put")).alias("pos", "x")).select(
        *_GROUP, "block", "pos", "x.rids", "x.put").filter("put <> ''")
    return flat.join(rows.select("rid", "role", "text"), F.col("rids") == F.col("rid"))


def _lines(placed: DataFrame) -> DataFrame:
    """Each placed row with its repaired rows (role, text) in order."""
    one = lambda c: F.when(c == "u", F.struct(F.lit("user").alias("role"), F.lit("").alias("text"))).when(
        c == "a", F.struct(F.lit("assistant").alias("role"), F.lit("").alias("text"))).otherwise(F.struct(
            F.when(c == "U", "user").when(c == "A", "assistant").otherwise(F.col("role")).alias("role"),
            F.col("text").alias("text")))
    return placed.select(*_GROUP, "block", "pos", F.transform(F.split("put", ""), one).alias("lines"))


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired rows: ``conv_id, block, pos, place, role, text``, in the order of the three."""
    rows = _stored_rows(rows)
    _, puts = solved(judged(rows), block)
    return _lines(_placed(rows, puts)).select(
        F.when(~F.col("lone"), F.col("conv")).alias("conv_id"), "block", "pos", F.posexplode("lines").alias("place", "x")
    ).select("conv_id", "block", "pos", "place", "x.*")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which arrive in order."""
    at, sha = None, None

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lone": pa.array([at[0]], pa.bool_()), "conv": pa.array([at[1]], pa.int64()),
                                           "sha": pa.array([sha.hexdigest()], pa.string())})

    for batch in batches:
        for lone, conv, lines in zip(*(batch.column(c).to_pylist() for c in ("lone", "conv", "lines"))):
            if (lone, conv) != at:
                if at:
                    yield result()
                at, sha = (lone, conv), hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(lines.encode())
    if at:
        yield result()


def digests(rows: DataFrame, original: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``original``: its rows' faults, the cheapest repair
    and the hash of the repaired rows."""
    common.prepare(rows.sparkSession)
    rows = _stored_rows(rows)
    found = common.stored(judged(rows), "turns-judged")
    results, puts = solved(found, block)
    line = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    shas = _lines(_placed(rows, puts)).select(*_GROUP, "block", "pos", line.alias("lines")).repartition(*_GROUP) \
        .sortWithinPartitions(*_GROUP, "block", "pos").select(*_GROUP, "lines").mapInArrow(
        _hashed, "lone boolean, conv long, sha string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (original.select(*_key()).distinct().join(_counted(found), _GROUP, "left").join(results, _GROUP, "left")
            .join(shas, _GROUP, "left").select(
                F.when(~F.col("lone"), F.col("conv")).alias("conv_id"), zero("gaps"), zero("blank"), zero("duplicate"),
                zero("truncated"), zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))
