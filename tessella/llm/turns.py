"""Least repairs of the order of turns by cost layers over a grammar's states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._core import save, tidy

WHITE = " \t\n\x0b\f\r"
#: What an edit of each kind costs, and what a truncated turn that stays adds; fixed values.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Turns of a block; longer conversations are joined from blocks.
BLOCK = 64
#: Blocks and short conversations that a worker remembers.
MEMORY = 50_000
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; in each one role at most can be inserted.
START, S, U, A = range(4)
#: Insertions that lead from each state to an accepting one.
TO_ACCEPT = (0, 2, 1, 0)
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
ROLE = {START: "user", S: "user", A: "user", U: "assistant"}
#: State after inserting the one role that each state can take.
GIVEN = (U, U, A, U)

# Sets of states are bits of an integer; a group of four bits for each state that is to be reached.
_GROUPS = 0x1111


def _before_any(z: int) -> int:
    """States from which one more role, of whatever kind fits, leads into a set."""
    return (z >> U & _GROUPS) * (1 << START | 1 << S | 1 << A) | (z >> A & _GROUPS) << U


def _before(z: int, role: str) -> int:
    """States from which a given role leads into a set."""
    if role == "s":
        return z >> S & _GROUPS
    if role == "u":
        return (z >> U & _GROUPS) * (1 << START | 1 << S | 1 << A)
    return (z >> A & _GROUPS) << U if role == "a" else 0


class Layers:
    """Cost layers of a run of turns.

    ``signs``: one character a turn, ``d`` for one that must go, else the role's
    first letter (``x`` for others), in capitals if it is truncated.
    ``layers[c][i]``: states before turn i from which the end can be reached at
    cost c or less.  ``end[k]``: states that are at the end at cost k or less.
    """

    def __init__(self, signs: str, end: list[int]):
        self.signs, self.end = signs, end
        self.layers: list[list[int]] = []

    def add(self) -> list[int]:
        """The layer of the next cost, from those of lower cost and, within it, from later turns to earlier ones."""
        c, done, n = len(self.layers), self.layers, len(self.signs)
        now = [0] * (n + 1)
        now[n] = self.end[min(c, len(self.end) - 1)]
        less = done[c - 1] if c else None
        inserted = done[c - INSERT] if c >= INSERT else None
        deleted = done[c - DELETE] if c >= DELETE else None
        after = now[n]
        for i in range(n - 1, -1, -1):
            sign = self.signs[i]
            z = less[i] if less else 0
            if inserted:
                z |= _before_any(inserted[i])
            if deleted:
                z |= deleted[i + 1]
            if sign != "d":
                role = sign.lower()
                extra = 0 if role == sign else TRUNCATED
                kept = after if not extra else done[c - extra][i + 1] if c >= extra else 0
                if kept:
                    z |= _before(kept, role)
                if c >= REROLE + extra:
                    z |= _before_any(done[c - REROLE - extra][i + 1])
            now[i] = after = z
        done.append(now)
        return now

    def trace(self, state: int, cost: int, goal: int = 0) -> str:
        """The least of the cheapest audits from a state before the first turn; ``goal``: the group of bits.

        D < I < K < R, and each edit has one outcome, so the first that stays on
        a cheapest way is right; no audit begins with another one.
        """
        out, i, shift = [], 0, 4 * goal
        have = lambda c, i, q: c >= 0 and self.layers[c][i] >> shift + q & 1
        while i < len(self.signs):
            sign = self.signs[i]
            role, extra = sign.lower(), TRUNCATED if sign != sign.lower() else 0
            if have(cost - DELETE, i + 1, state):
                out.append("D")
                cost, i = cost - DELETE, i + 1
            elif have(cost - INSERT, i, GIVEN[state]):
                out.append("I")
                cost, state = cost - INSERT, GIVEN[state]
            elif sign != "d" and (state, role) in NEXT and have(cost - extra, i + 1, NEXT[state, role]):
                out.append("K")
                cost, i, state = cost - extra, i + 1, NEXT[state, role]
            else:
                out.append("R")
                cost, i, state = cost - extra - REROLE, i + 1, GIVEN[state]
        return "".join(out)


#: Cheapest cost and audit from state to state, for those that can be reached.
Block = dict[tuple[int, int], tuple[int, str]]


def block_of(signs: str) -> Block:
    """Of a run of turns whose last edit is of its last turn."""
    layers = Layers(signs, [sum(1 << 4 * x + x for x in range(4))])
    out: Block = {}
    seen = 0
    for cost in range(DELETE * len(signs) + 2 * INSERT + 1):
        new = layers.add()[0] & ~seen
        seen |= new
        for bit in range(16):
            if new >> bit & 1:
                out[bit & 3, bit >> 2] = cost, layers.trace(bit & 3, cost, bit >> 2)
    return out


def joined(blocks: list[Block], end: dict[int, int], state: int) -> tuple[int, list[int]] | None:
    """Cost and states on the cheapest way through blocks, the least audit among equals; ``end``: what each last state costs.

    Only how the audits of a block compare with each other counts, so they may be anything that compares alike.
    """
    ahead = [end]
    for b in reversed(blocks):
        now: dict[int, int] = {}
        for (e, x), (c, _) in b.items():
            if x in ahead[-1] and c + ahead[-1][x] < now.get(e, 1 << 62):
                now[e] = c + ahead[-1][x]
        ahead.append(now)
    ahead.reverse()
    if state not in ahead[0]:
        return None
    states = [state]
    for b, now, then in zip(blocks, ahead, ahead[1:]):
        e = states[-1]
        ways = [(audit, x) for (a, x), (c, audit) in b.items() if a == e and x in then and c + then[x] == now[e]]
        states.append(min(ways)[1])
    return ahead[0][state], states


class Repairer:
    """Cheapest edits of runs of turns; what it remembers is bounded."""

    def __init__(self) -> None:
        self._blocks: dict[str, Block] = {}
        self._whole: dict[str, tuple[int, str]] = {}

    def block(self, signs: str) -> Block:
        found = self._blocks.get(signs)
        if found is None:
            if len(self._blocks) >= MEMORY:
                self._blocks.clear()
            found = self._blocks[signs] = block_of(signs)
        return found

    def _split(self, signs: str) -> list[Block]:
        return [self.block(signs[i : i + BLOCK]) for i in range(0, len(signs), BLOCK)]

    def part(self, signs: str) -> Block:
        """The block of a run of any length."""
        blocks, out = self._split(signs), {}
        for e in range(4):
            for x in range(4):
                found = joined(blocks, {x: 0}, e)
                if found:
                    cost, states = found
                    out[e, x] = cost, "".join(b[a, z][1] for b, a, z in zip(blocks, states, states[1:]))
        return out

    def whole(self, signs: str) -> tuple[int, str]:
        """Cost and audit of a conversation."""
        if len(signs) > BLOCK:
            blocks = self._split(signs)
            cost, states = joined(blocks, {q: INSERT * k for q, k in enumerate(TO_ACCEPT)}, START)
            return cost, "".join(b[a, z][1] for b, a, z in zip(blocks, states, states[1:])) + "I" * TO_ACCEPT[states[-1]]
        found = self._whole.get(signs)
        if found is None:
            if len(self._whole) >= MEMORY:
                self._whole.clear()
            most = INSERT * max(TO_ACCEPT)
            layers = Layers(signs, [sum(1 << q for q, k in enumerate(TO_ACCEPT) if INSERT * k <= c) for c in range(most + 1)])
            cost = 0
            while not layers.add()[0] & 1 << START:  # the first layer that accepts
                cost += 1
            audit = layers.trace(START, cost)
            found = self._whole[signs] = cost, audit + "I" * TO_ACCEPT[state_after(audit, signs, START)]
        return found


def _steps(audit: str, signs: str, state: int) -> Iterator[tuple[str, int, str]]:
    """Edits with the turn each one is at and the role it gives: ``""`` for a turn that keeps its own."""
    i = 0
    for edit in audit:
        role = "" if edit == "K" else ROLE[state] if edit in "IR" else None
        yield edit, i, role
        if edit == "K":
            state = NEXT[state, signs[i].lower()]
        elif edit in "IR":
            state = GIVEN[state]
        i += edit != "I"


def state_after(audit: str, signs: str, state: int) -> int:
    i = 0
    for edit in audit:
        if edit == "K":
            state = NEXT[state, signs[i].lower()]
        elif edit in "IR":
            state = GIVEN[state]
        i += edit != "I"
    return state


def repaired_lines(audit: str, signs: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the turns that edits leave."""
    out = []
    for edit, i, role in _steps(audit, signs, state):
        if edit == "I":
            out.append(role + ":")
        elif edit != "D":
            out.append(f"{role or roles[i]}:{texts[i]}")
    return out


class _Counts:
    """Numbers of a run of turns in order; runs that follow each other can be joined."""

    def __init__(self, turns: list[int | None], faults: list[str], initials: list[str]):
        known = [t for t in turns if t is not None]
        self.least, self.most = (known[0], known[-1]) if known else (None, None)
        self.turns = len(set(known))
        self.faults = {f: faults.count(f) for f in "bdt"}
        self.illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        self.edge = (initials[0], initials[-1]) if initials else None

    def join(self, then: "_Counts") -> None:
        self.turns += then.turns - (then.turns > 0 and self.most == then.least)
        self.least = then.least if self.least is None else self.least
        self.most = self.most if then.most is None else then.most
        self.faults = {f: n + then.faults[f] for f, n in self.faults.items()}
        self.illegal += then.illegal
        if self.edge and then.edge:
            self.illegal += self.edge[1] + then.edge[0] not in ("su", "ua", "au")
            self.edge = self.edge[0], then.edge[1]
        else:
            self.edge = self.edge or then.edge

    def row(self) -> list[int]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return [gaps, *(self.faults[f] for f in "bdt"), self.illegal]


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
_RESULT_FIELDS = [*((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.string())]


def _sign(initial: str, fault: str) -> str:
    if fault in ("b", "d"):
        return "d"
    sign = initial if initial in ("s", "u", "a") else "x"
    return sign.upper() if fault == "t" else sign


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _emit(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows, of bounded number and text."""
    held: list[tuple] = []
    chars = 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or chars >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def damage(convs: DataFrame) -> DataFrame:
    """Turns with faults of five kinds, chosen by a checksum of conversation and turn.

    Returns ``conv_id``, ``turn``, ``role``, ``text``, ``copies``; a turn that is
    dropped has 0 copies, one that is repeated 2.  Nulls count as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(pick == 1, "").when(pick == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return convs.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(pick == 4, "user").otherwise(said("role")).alias("role"),
        text.alias("text"),
        F.when(pick == 0, 0).when(pick == 3, 2).otherwise(1).alias("copies"),
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repair(turns: DataFrame) -> DataFrame:
    """Least repairs of conversations, as pieces of their repaired texts.

    ``turns``: as from :func:`damage`, without nulls in role and text.  Returns
    ``conv_id``, ``part``, ``only``, ``last``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``,
    ``repaired``: one row for a conversation, or several for one that lies across
    partitions, whose audits and repaired lines are put together in the order of
    ``part`` and whose numbers are in the row that is ``last``.  Null ids are one
    conversation.  Turns go by number, nulls first; rows of one number by the
    first 32 characters of role and of text, then by a hash of both.
    Conversations all of whose turns have 0 copies have zeros and empty texts;
    an empty table has no rows; further columns are not looked at.

    Rows are dealt out by ranges of that order, so that no conversation, turn or
    text, however frequent, is one task's.  Conversations within a partition are
    done there; only the first and the last one of each partition may go on in
    another, and those are joined from their parts by what each one costs from
    state to state.
    """
    spark = turns.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = F.rtrim("text", F.lit(WHITE))
    fault = F.when(rest == "", "b").when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 32), F.xxhash64("role", "text"), F.col("salt")]
    rows = turns.select("conv_id", "turn", "role", F.when(F.col("copies") == 0, "").otherwise(F.col("text")).alias("text"), "copies")
    # equal rows are told apart, else they would be one task's
    rows = rows.withColumn("fault", fault).withColumn("salt", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(many, *order).sortWithinPartitions(*order).drop("salt")

    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int32()), ("fault", pa.string()), ("digest", pa.binary()), *_RESULT_FIELDS])
    names = ["conv_id", "turn", "role", "text", "copies", "fault"]

    def within(batches: Iterator[pa.RecordBatch]):
        part, repairer = TaskContext.get().partitionId(), Repairer()

        def numbered(rows: list[tuple]) -> Iterator[tuple]:
            """Rows of a conversation, those seen before marked; ``rows`` may be a stream."""
            seen: set[bytes] = set()
            seq = 0
            for conv, turn, role, text, copies, fault in rows:
                for _ in range(max(copies, 1)):
                    told = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest() if copies and fault != "b" else None
                    if told in seen:
                        fault = "d"
                    elif told:
                        seen.add(told)
                    yield conv, part, seq, turn, role, text, int(copies > 0), fault, told
                    seq += 1

        def results() -> Iterator[tuple]:
            waiting: list[tuple] | None = None
            first = True
            none = (None,) * len(_RESULT_FIELDS)
            for conv, rows in groupby(_rows(batches, names), lambda r: r[0]):
                if first:  # may have begun before
                    first = False
                    for r in numbered(rows):
                        yield *r, *none
                    continue
                if waiting is not None:
                    yield whole(waiting)
                waiting = list(numbered(rows))
            for r in waiting or ():  # may go on after
                yield *r, *none

        def whole(rows: list[tuple]) -> tuple:
            conv = rows[0][0]
            rows = [r for r in rows if r[6]]
            roles, texts, faults = [r[4] for r in rows], [r[5] for r in rows], [r[7] for r in rows]
            initials = [r[:1] for r in roles]
            signs = "".join(map(_sign, initials, faults))
            cost, audit = repairer.whole(signs)
            lines = repaired_lines(audit, signs, START, roles, texts)
            counts = _Counts([r[3] for r in rows], faults, initials).row()
            return conv, None, None, None, None, None, None, None, None, *counts, cost, audit, "\n".join(lines)

        yield from _emit(results(), schema)

    done = save(dealt.mapInArrow(tidy(within), f"conv_id long, part int, seq long, turn long, role string, text string, copies int, fault string, digest binary, {_RESULT}"), "turns")
    one = done.where("part is null").select("conv_id", F.lit(0).alias("part"), F.lit(True).alias("only"), F.lit(True).alias("last"), *[n for n, _ in _RESULT_FIELDS])
    return one.unionByName(_across(done.where("part is not null").select(*schema.names[:9]), many))


def _across(rows: DataFrame, many: int) -> DataFrame:
    """Repairs of conversations that may lie across partitions, from their numbered rows."""
    # of equal turns in several parts, those of later parts are repeats
    ids = rows.where("digest is not null and fault != 'd'").select("conv_id", "digest", "part")
    ids = ids.groupBy("conv_id", "digest").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most")
    ids = ids.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "least")
    rows = rows.join(ids, _same(rows.conv_id, ids.c) & (rows.digest == ids.d), "left")
    rows = rows.withColumn("fault", F.when(F.col("part") > F.col("least"), "d").otherwise(F.col("fault"))).drop("c", "d", "least", "digest")
    rows = save(rows, "turn-parts")
    by_part = ["conv_id", "part"]

    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("ways", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("edge", pa.string())])

    def parts(batches: Iterator[pa.RecordBatch]):
        repairer = Repairer()

        def results() -> Iterator[tuple]:
            for (conv, part), group in groupby(_rows(batches, ["conv_id", "part", "turn", "role", "copies", "fault"]), lambda r: r[:2]):
                kept = [(turn, role[:1], fault) for _, _, turn, role, copies, fault in group if copies]
                turns, initials, faults = ([r[k] for r in kept] for k in range(3))
                found = repairer.part("".join(map(_sign, initials, faults)))
                c = _Counts(turns, faults, initials)
                ranks = {a: k for k, a in enumerate(sorted({a for _, a in found.values()}))}
                ways = [x for (e, q), (cost, audit) in found.items() for x in (e, q, cost, ranks[audit])]
                edge = "".join(i if i in ("s", "u", "a") else "x" for i in c.edge) if c.edge else ""
                yield conv, part, ways, [a for _, a in found.values()], [c.least, c.most, c.turns], [*(c.faults[f] for f in "bdt"), c.illegal], edge

        yield from _emit(results(), schema)

    sorted_rows = rows.repartition(many, *by_part).sortWithinPartitions(*by_part, "seq")
    found = save(sorted_rows.mapInArrow(tidy(parts), "conv_id long, part int, ways array<long>, audits array<string>, turns array<long>, counts array<long>, edge string"), "turn-ways")

    chosen_schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("only", pa.bool_()), ("last", pa.bool_()), ("enter", pa.int32()), ("leave", pa.int32()), *_RESULT_FIELDS[:6]])

    def choose(batches: Iterator[pa.RecordBatch]):
        """States between the parts of a conversation; a part is a few numbers here, and there is at most one for each partition."""

        def results() -> Iterator[tuple]:
            for conv, group in groupby(_rows(batches, ["conv_id", "part", "ways", "turns", "counts", "edge"]), lambda r: r[0]):
                known = list(group)
                blocks = [{(w[i], w[i + 1]): (w[i + 2], w[i + 3]) for i in range(0, len(w), 4)} for _, _, w, *_ in known]
                cost, states = joined(blocks, {q: INSERT * k for q, k in enumerate(TO_ACCEPT)}, START)
                total = _Counts([], [], [])
                for *_, turns, counts, edge in known:
                    c = _Counts([], [], [])
                    (c.least, c.most, c.turns), c.faults, c.illegal = turns, dict(zip("bdt", counts)), counts[3]
                    c.edge = (edge[0], edge[1]) if edge else None
                    total.join(c)
                for k, (_, part, *_) in enumerate(known):
                    last = k == len(known) - 1
                    yield conv, part, len(known) == 1, last, states[k], states[k + 1], *((*total.row(), cost) if last else (None,) * 6)

        yield from _emit(results(), chosen_schema)

    small = found.drop("audits").repartition(many, "conv_id").sortWithinPartitions("conv_id", "part")
    chosen = save(small.mapInArrow(tidy(choose), "conv_id long, part int, only boolean, last boolean, enter int, leave int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"), "turn-ways-chosen")

    # the chosen edits of each part before its rows
    f = found.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "ways", "audits")
    head = chosen.join(f, _same(chosen.conv_id, f.c) & (chosen.part == f.p))
    place = F.filter(F.sequence(F.lit(0), F.size("audits") - 1), lambda i: (F.get("ways", 4 * i) == F.col("enter")) & (F.get("ways", 4 * i + 1) == F.col("leave")))
    head = head.withColumn("audit", F.get("audits", place[0])).select(*chosen.columns, "audit")
    told = F.struct(*[c for c in head.columns if c not in by_part])
    none = F.lit(None).cast(head.select(told.alias("t")).schema["t"].dataType)
    both = head.select(*by_part, F.lit(-1).cast("long").alias("seq"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), F.lit("").alias("fault"), told.alias("head"))
    both = both.unionByName(rows.select(*by_part, "seq", "role", "text", "copies", "fault", none.alias("head")))
    out_schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("only", pa.bool_()), ("last", pa.bool_()), *_RESULT_FIELDS])

    def write(batches: Iterator[pa.RecordBatch]):
        def results() -> Iterator[tuple]:
            for (conv, part), group in groupby(_rows(batches, ["conv_id", "part", "role", "text", "copies", "fault", "head"]), lambda r: r[:2]):
                head = next(group)[-1]
                kept = [r for r in group if r[4]]
                signs = "".join(_sign(r[2][:1], r[5]) for r in kept)
                audit = head["audit"]
                lines = repaired_lines(audit, signs, head["enter"], [r[2] for r in kept], [r[3] for r in kept])
                if head["last"]:
                    state, more = head["leave"], "I" * TO_ACCEPT[head["leave"]]
                    lines += repaired_lines(more, "", state, [], [])
                    audit += more
                yield conv, part, head["only"], head["last"], *(head[c] for c, _ in _RESULT_FIELDS[:6]), audit, "\n".join(lines) if lines else None

        yield from _emit(results(), out_schema)

    both = both.repartition(many, *by_part).sortWithinPartitions(*by_part, "seq")
    return both.mapInArrow(tidy(write), f"conv_id long, part int, only boolean, last boolean, {_RESULT}")


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`repair`, with the SHA-256 of its repaired text.

    A digest needs a text's bytes in order; of conversations in several pieces
    these pass through a task one after the other, and only the digest's state
    and the audit are held.
    """
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    one = pieces.where("only").select("conv_id", *numbers, "audit", F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))
    schema = pa.schema([("conv_id", pa.int64()), *_RESULT_FIELDS[:7], ("repaired_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]):
        def results() -> Iterator[tuple]:
            for conv, group in groupby(_rows(batches, ["conv_id", *numbers, "audit", "repaired"]), lambda r: r[0]):
                told, audit, some, row = hashlib.sha256(), [], False, None
                for row in group:
                    audit.append(row[-2])
                    if row[-1] is not None:
                        told.update((("\n" if some else "") + row[-1]).encode())
                        some = True
                yield conv, *row[1:7], "".join(audit), told.hexdigest()

        yield from _emit(results(), schema)

    more = pieces.where("not only").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return one.unionByName(more.mapInArrow(tidy(join), "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"))
