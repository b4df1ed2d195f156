"""Repair of conversations whose turns were lost, repeated, cut short or given to the wrong role.

A repaired conversation reads ``(s?(ua)+)?``: nothing, or an opening system turn or none and then user and
assistant in turn. Rows are kept, given another role, deleted or inserted at the costs below; of the
cheapest scripts the one whose audit (the initials of its edits) is ASCII-least is taken.

**Method.** Four states say what the repaired part so far ends with: nothing, s, u, a. A *summary* of a stretch of
rows holds for every pair of states the least cost of getting from one to the other and, for every start, the order
of the audits by which the four ends are reached. Cut right behind an edited row (insertions belong to the row
after them), two audits of one stretch with different ends are never prefixes of each other, so their order decides
however they go on; summaries therefore join two by two like products. Hirschberg's scheme
rebuilds the script: forward and backward cost vectors meet mid-way, the crossing on an optimal path
whose audit is least is fixed, and both halves are solved for their now fixed ends. Vectors of four numbers are all
that is kept while a stretch is solved.

**On Spark.** Rows without their texts are sorted by range over (conversation, turn, role, text digest) and so numbered, which
splits a conversation of any length; blocks of ``BLOCK`` rows are summed up in parallel, the summaries of a conversation
meet (one for 4,096 rows) and give each block its ends, and the blocks are solved in parallel. At last rows and
scripts are sorted by conversation and streamed past each other once: a SHA-256 can only be taken in order, so that pass
reads a conversation in one task, but holds one script of a block and one batch of rows, never the conversation.

**Edge cases.** Null roles and texts are one space, as null ids and turns are in the key of the damage. Null ids are one
conversation. Rows of one turn are taken by role, then by the SHA-256 of the text; repeated rows count one by one. An empty
table gives an empty result. Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.session import materialise

#: Rows of a block, as a power of two: 4,096.
BLOCK_BITS = 12
# What the edits cost. A truncated row that stays costs as much as an insertion.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (NOTHING, ASSISTANT)
#: What may follow what, by initial.
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
FULL = {USER: "user", ASSISTANT: "assistant"}
SPACES = " \t\n\x0b\x0c\r"
INFINITE = 1 << 62
#: (cost, order) by start and end; the order ranks the ends of one start by their audits.
Summary = tuple[tuple[int, ...], tuple[int, ...]]
EMPTY: Summary = (tuple(0 if s == t else INFINITE for s in STATES for t in STATES), (0,) * 16)


def turn_into(state: int) -> int | None:
    """The state after a user or assistant turn, whichever may stand here: exactly one may."""
    return next(t for (s, initial), t in STEPS.items() if s == state and initial != "s")


@cache
def row_steps(kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """The best way past one row from state to state: insertions, then one edit of the row.

    ``kind`` is its fault (``-`` none, ``b`` blank, ``d`` duplicate, ``t`` truncated) and its initial.
    """
    fault, initial = kind[0], kind[1:]
    stays = TRUNCATED if fault == "t" else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(start: int, end: int, way: tuple[int, str]) -> None:
        best[start, end] = min(way, best.get((start, end), (INFINITE, "")))

    for start in STATES:
        state, cost, audit = start, 0, ""
        for _ in range(3):  # more insertions come back to a state that was passed
            offer(start, state, (cost + DELETE, audit + "D"))
            if fault not in "bd":
                if (state, initial) in STEPS:
                    offer(start, STEPS[state, initial], (cost + stays, audit + "K"))
                offer(start, turn_into(state), (cost + stays + REROLE, audit + "R"))
            state, cost, audit = turn_into(state), cost + INSERT, audit + "I"
    return best


@cache
def row_summary(kind: str) -> Summary:
    steps = row_steps(kind)
    order = [0] * 16
    for start in STATES:
        ends = sorted((t for t in STATES if (start, t) in steps), key=lambda t: steps[start, t][1])
        for place, t in enumerate(ends):
            order[4 * start + t] = place
    return tuple(steps.get((s, t), (INFINITE, ""))[0] for s in STATES for t in STATES), tuple(order)


def forward(start: int, rows: list[Summary]) -> list[tuple[int, int]]:
    """(cost, order) of reaching each state from ``start``: the vector that walks ahead."""
    at = [(0, 0) if s == start else (INFINITE, 0) for s in STATES]
    for costs, order in rows:
        ways = []
        for t in STATES:
            ways.append(min((at[s][0] + costs[4 * s + t], at[s][1], order[4 * s + t]) for s in STATES))
        reached = sorted((way[1:], t) for t, way in enumerate(ways) if way[0] < INFINITE)
        place = {t: k for k, (_, t) in enumerate(reached)}
        at = [(min(way[0], INFINITE), place.get(t, 0)) for t, way in enumerate(ways)]
    return at


def backward(end: int, rows: list[Summary]) -> list[int]:
    """The cost of reaching ``end`` from each state: the vector that walks back."""
    at = [0 if s == end else INFINITE for s in STATES]
    for costs, _ in reversed(rows):
        at = [min(INFINITE, min(costs[4 * s + t] + at[t] for t in STATES)) for s in STATES]
    return at


def summarise(rows: list[Summary]) -> Summary:
    vectors = [forward(start, rows) for start in STATES]
    return tuple(cost for v in vectors for cost, _ in v), tuple(order for v in vectors for _, order in v)


def crossings(start: int, end: int, rows: list[Summary]) -> list[int]:
    """The state behind each row on the ASCII-least of the cheapest ways from ``start`` to ``end``."""
    out: list[int] = []
    todo = [(start, end, 0, len(rows))]
    while todo:  # a stack instead of recursion, left halves on top
        start, end, lo, hi = todo.pop()
        if hi - lo == 1:
            out.append(end)
        elif hi > lo:
            mid = (lo + hi) // 2
            ahead, back = forward(start, rows[lo:mid]), backward(end, rows[mid:hi])
            cross = min(STATES, key=lambda s: (ahead[s][0] + back[s], ahead[s][1]))
            todo += [(cross, end, mid, hi), (start, cross, lo, mid)]
    return out


def last_state(rows: list[Summary]) -> tuple[int, int]:
    """Where the best script stands behind the last row, and how many turns it then inserts."""
    ways = []
    for state, (cost, order) in enumerate(forward(NOTHING, rows)):
        inserts, at = 0, state
        while at not in ENDS:
            at, inserts = turn_into(at), inserts + 1
        ways.append((cost + inserts * INSERT, order, state, inserts))
    return min(ways)[2:]


def script(kinds: list[str], start: int, end: int) -> list[str]:
    """The edits of each row (insertions before it included) between two given states."""
    states = [start, *crossings(start, end, [row_summary(k) for k in kinds])]
    return [row_steps(kind)[s, t][1] for kind, s, t in zip(kinds, states, states[1:])]


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows after the planned damage: ``conv``, ``turn``, ``role``, ``text`` and ``gone`` (dropped, kept as a mark).

    What happens to a row is decided by the CRC-32 of ``conv:turn``, modulo 20.
    """
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named(conv), F.lit(":"), named(turn)).cast("binary")) % 20
    changed = F.when(fate == 1, "").when(fate == 2, F.translate(named(text), ".!?", "")).otherwise(named(text))
    return (
        rows.select(
            F.col(f"`{conv}`").alias("conv"),
            F.col(f"`{turn}`").cast("long").alias("turn"),
            F.when(fate == 4, "user").otherwise(named(role)).alias("role"),
            changed.alias("text"),
            (fate == 0).alias("gone"),
            F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def _coded(summary: Summary) -> list[int]:
    return [*summary[0], *summary[1]]


def _arrow(run: Callable[..., list], returns: str):
    """A row function over Arrow batches."""

    @F.arrow_udf(returns)
    def batches(*columns: pa.Array) -> pa.Array:
        return pa.array([run(*row) for row in zip(*(c.to_pylist() for c in columns))], batches_type)

    batches_type = {
        "array<long>": pa.list_(pa.int64()),
        "array<struct<block: long, start: int, end: int, tail: int>>": pa.list_(
            pa.struct([("block", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("tail", pa.int32())])
        ),
        "string": pa.string(),
    }[returns]
    return batches


def _block_ends(blocks: list[dict]) -> list[dict]:
    """Start and end state of each block of a conversation, and the turns inserted behind its last row."""
    blocks = sorted(blocks, key=lambda b: b["block"])
    sums = [(tuple(b["summary"][:16]), tuple(b["summary"][16:])) for b in blocks]
    end, tail = last_state(sums)
    states = [NOTHING, *crossings(NOTHING, end, sums)]
    return [
        {"block": b["block"], "start": s, "end": t, "tail": tail if k == len(blocks) - 1 else 0}
        for k, (b, s, t) in enumerate(zip(blocks, states, states[1:]))
    ]


def scripts(rows: DataFrame) -> DataFrame:
    """One row for each block of a conversation: the key of its first row, its kinds and its script.

    ``rows`` are those of ``damaged``. Kinds are joined by spaces, and so are edits; the insertions behind the last row are
    a last edit of their own.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    ending = F.when(trimmed == "", "b").when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    thin = rows.where(~F.col("gone")).select("conv", "turn", "role", digest.alias("digest"), ending.alias("ending"))
    key = ["conv", "turn", "role", "digest"]
    ordered = materialise(
        thin.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("seq", F.monotonically_increasing_id()), "ordered-turns"
    )
    first = ordered.groupBy("conv", "role", "digest").agg(F.min("seq").alias("first"))
    same = ordered.alias("o").join(
        first.alias("f"),
        F.col("o.conv").eqNullSafe(F.col("f.conv")) & (F.col("o.role") == F.col("f.role")) & (F.col("o.digest") == F.col("f.digest")),
    )
    fault = F.when(F.col("ending") == "b", "b").when(F.col("seq") > F.col("first"), "d").otherwise(F.col("ending"))
    initial = F.left(F.col("o.role"), F.lit(1))
    kind = F.concat(fault, F.when(initial.isin("s", "u", "a"), initial).otherwise("x"))
    block = F.shiftright("seq", BLOCK_BITS)
    blocks = materialise(
        same.select("o.conv", block.alias("block"), F.struct("seq", kind.alias("kind"), "o.turn", "o.role", "o.digest").alias("r"))
        .groupBy("conv", "block")
        .agg(
            # At most 4,096 small values: a block is no larger.
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r.seq", "r.kind"))), lambda r: r["kind"]), " ").alias("kinds"),
            F.min("r").alias("head"),
        )
        .select("conv", "block", "kinds", "head.turn", "head.role", "head.digest"),
        "turn-blocks",
    )
    summed = _arrow(lambda kinds: _coded(summarise([row_summary(k) for k in kinds.split(" ")])), "array<long>")
    ends = _arrow(_block_ends, "array<struct<block: long, start: int, end: int, tail: int>>")
    solved = _arrow(
        lambda kinds, start, end, tail: " ".join(script(kinds.split(" "), start, end) + ["I" * tail] * (tail > 0)), "string"
    )
    bounds = (
        blocks.select("conv", F.struct("block", summed("kinds").alias("summary")).alias("b"))
        .groupBy("conv")
        .agg(F.collect_list("b").alias("parts"))
        .select("conv", F.explode(ends("parts")).alias("e"))
    )
    joined = blocks.alias("b").join(
        bounds.alias("e"), F.col("b.conv").eqNullSafe(F.col("e.conv")) & (F.col("b.block") == F.col("e.e.block"))
    )
    return joined.select("b.*", F.col("e.e.start").alias("start"), F.col("e.e.end").alias("end"), F.col("e.e.tail").alias("tail")).select(
        "conv", "block", "turn", "role", "digest", "kinds", solved("kinds", "start", "end", "tail").alias("edits")
    )


class Report:
    """What is known of one conversation while its rows pass by."""

    def __init__(self, conv) -> None:
        self.conv, self.audit, self.hash = conv, [], hashlib.sha256()
        self.counts = {"b": 0, "d": 0, "t": 0, "-": 0}
        self.illegal = self.cost = self.turns = self.lines = 0
        self.first = self.last = self.before = None
        self.state = NOTHING
        self.pending: list[tuple[Iterator[str], Iterator[str]]] = []

    def script(self, kinds: str, edits: str) -> None:
        # Trailing insertions make one edit more than there are kinds.
        self.pending.append((iter(kinds.split(" ")), iter(edits.split(" "))))

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def edit(self, edits: str, row: tuple[str, str] | None) -> None:
        self.audit.append(edits)
        for letter in edits:
            self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter]
            if letter == "K":
                self.state = STEPS[self.state, row[0][:1]]
                self.line(*row)
            elif letter != "D":
                self.state = turn_into(self.state)
                self.line(FULL[self.state], row[1] if letter == "R" else "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        while (kind := next(self.pending[0][0], None)) is None:
            self.pending.pop(0)
        edits = next(self.pending[0][1])
        self.counts[kind[0]] += 1
        self.cost += TRUNCATED * (kind[0] == "t" and not edits.endswith("D"))
        self.edit(edits, (role, text))

    def done(self) -> dict:
        for _, edits in self.pending:
            for rest in edits:
                self.edit(rest, None)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {
            "conv": self.conv, "gaps": min(gaps, 2**63 - 1), "blank": self.counts["b"], "duplicate": self.counts["d"],
            "truncated": self.counts["t"], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit),
            "repaired_sha256": self.hash.hexdigest(),
        }


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FIELDS = [f.split()[0] for f in RESULT.split(", ")]


def reports(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Faults, cost, audit and the digest of the repaired text of every conversation of ``rows``, dropped ones too."""
    digest = F.when(~F.col("gone"), F.sha2(F.col("text").cast("binary"), 256))
    nothing: Column = F.lit(None).cast("string")
    bodies = rows.select(
        "conv", "turn", F.when(~F.col("gone"), F.col("role")).alias("role"), digest.alias("digest"), F.lit(1).alias("part"),
        F.lit(0).cast("long").alias("block"), F.when(~F.col("gone"), F.col("text")).alias("text"), nothing.alias("edits"),
    )
    heads = made.select("conv", "turn", "role", "digest", F.lit(0).alias("part"), "block", F.col("kinds").alias("text"), "edits")
    # A script stands right before the first row of its block.
    stream = bodies.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "part", "block")
    kind = rows.schema["conv"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Report | None = None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "edits", "part")]
            for conv, turn, role, text, edits, part in zip(*columns):
                if now is None or now.conv != conv:
                    done += [now.done()] if now else []
                    now = Report(conv)
                if part == 0:
                    now.script(text, edits)
                elif role is not None:
                    now.row(turn, role, text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_schema(batch))
            last = batch
        if now:
            yield pa.RecordBatch.from_pylist([now.done()], schema=_schema(last))

    def _schema(batch: pa.RecordBatch) -> pa.Schema:
        types = [pa.string() if f in FIELDS[-2:] else pa.int64() for f in FIELDS]
        return pa.schema([("conv", batch.schema.field("conv").type), *zip(FIELDS, types)])

    return stream.mapInArrow(read, f"conv {kind}, {RESULT}")


def repair(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Damage the rows as planned, find the best repair of every conversation and report on it, one row each."""
    hurt = damaged(rows, conv, turn, role, text)
    found = reports(hurt, scripts(hurt))
    return found.select(F.col("conv").alias(conv), *FIELDS)
