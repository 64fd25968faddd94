"""Conversations whose roles are out of order, repaired by error-correcting Earley parsing.

The grammar of roles is S -> empty | B, B -> B user assistant | O user assistant, O -> empty | system. Besides reading a row
as it is (keep) a terminal may read a row of another role (rerole) or nothing at all (insert), and a row may be read
by no terminal (delete); each of these productions has its cost. Chart items retain the least (cost, audit), where the
audit is the initials of the edits so far and ties go to the least in ASCII order. The completed chart's best item is the repair.

The grammar is left-linear, so every item begins at a conversation's first row and a column of the chart has no more
items than the grammar has dots: time and chart are linear in the rows. Audits aren't carried along: all of a
column have read as many rows, so none but for its last insertions is the beginning of another, and their order is
kept as ranks, with a pointer to the rank before.

Scale: rows are sorted by conversation and pass through a task as a stream, which holds a few bytes of chart for each row
of the conversation at hand and no text; edits then meet their rows by (conversation, place), which spreads
a long conversation over tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch

SPACE, STOP = " \t\n\x0b\x0c\r", ".!?"
RULES = (("S", ()), ("S", ("B",)), ("B", ("B", "u", "a")), ("B", ("O", "u", "a")), ("O", ()), ("O", ("s",)))
#: Roles that a row may be given, and a row be inserted with, by initial.
MADE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
CHART = "kind int, conv string, conv_id long, place long, turn long, role string, text string, fault int, edit string, made array<string>, audit string, cost long, faults array<long>, illegal long, gaps long"

ITEMS = [(r, d) for r, (_, right) in enumerate(RULES) for d in range(len(right) + 1)]
NUMBER = {item: i for i, item in enumerate(ITEMS)}
NEXT = [RULES[r][1][d] if d < len(RULES[r][1]) else None for r, d in ITEMS]
READS = [(i, t, NUMBER[r, d + 1]) for i, ((r, d), t) in enumerate(zip(ITEMS, NEXT, strict=True)) if t and t.islower()]
#: For each completed item the items that it carries on: those that begin with its nonterminal.
CARRIES = {i: [NUMBER[r, 1] for r, (_, right) in enumerate(RULES) if right[:1] == (RULES[own][0],)] for i, (own, _) in enumerate(ITEMS) if NEXT[i] is None}
ENDS = [i for i in CARRIES if RULES[ITEMS[i][0]][0] == "S"]
STAYS = [*(i for i, _, _ in READS), *ENDS]


class Chart:
    """One conversation's chart. An item's value is (cost, rank, inserted): the rank, in its column, of the audit up to the last row
    that was read, and the insertions since then."""

    _same: dict[tuple, tuple] = {}

    def __init__(self):
        self.back: list[tuple] = []
        self.column = self._closed({NUMBER[r, 0]: (0, 0, 0) for r in range(len(RULES))})

    @staticmethod
    def _closed(column: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
        """Insertions and completions, until none is better than what is there."""
        wait = list(column)
        while wait:
            i = wait.pop()
            cost, rank, more = column[i]
            found = [(j, (cost, rank, more)) for j in CARRIES.get(i, ())]
            if NEXT[i] in MADE:
                found.append((NUMBER[ITEMS[i][0], ITEMS[i][1] + 1], (cost + INSERT, rank, more + 1)))
            for j, value in found:
                if j not in column or value < column[j]:
                    column[j] = value
                    wait.append(j)
        return column

    def read(self, role: str, fault: int) -> None:
        """The next row, by the initial of its role and its fault."""
        best: dict[int, tuple] = {}

        def offer(item: int, value: tuple, cost: int, letter: str) -> None:
            said = (value[0] + cost, (value[1], "I" * value[2] + letter))
            if item not in best or said < best[item]:
                best[item] = said

        for i in STAYS:
            if i in self.column:
                offer(i, self.column[i], DELETE, "D")
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            for i, t, to in READS:
                if i in self.column:
                    if t == role:
                        offer(to, self.column[i], extra, "K")
                    elif t in MADE:
                        offer(to, self.column[i], REROLE + extra, "R")
        cores = sorted({core for _, core in best.values()})
        rank = {core: n for n, core in enumerate(cores)}
        self.back.append(self._same.setdefault(tuple(cores), tuple(cores)))
        self.column = self._closed({i: (cost, rank[core], 0) for i, (cost, core) in best.items()})

    def repair(self) -> tuple[int, list[str], int]:
        """The least cost, for each row its edit with the insertions before it, and the insertions at the end."""
        cost, rank, last = min(self.column[i] for i in ENDS if i in self.column)
        edits = []
        for cores in reversed(self.back):
            rank, letters = cores[rank]
            edits.append(letters)
        return cost, edits[::-1], last


def damage(rows: DataFrame) -> DataFrame:
    """Rows as a careless export may leave them, by the CRC-32 of ``conv_id:turn`` (null: one space) modulo 20: 0 is dropped, 1 has no
    text, 2 lacks ``.``, ``!`` and ``?``, 3 stands twice, 4 is said by the user. Null roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    times = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(case == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), times.alias("n"))
    return own.where("n > 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("n")).drop("n")


def fault_of(text: Column, again: Column) -> Column:
    """The first fault of a row: blank, said before, or not ended by a stop."""
    last = F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)
    return F.when(last == "", BLANK).when(again, DUPLICATE).when(~last.isin(*STOP), CUT).otherwise(FINE)


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by conversation and place in it, as they are with their places; after a conversation's last one its edits, and
    the conversation itself."""
    schema = pa.schema([("kind", pa.int32()), ("conv", pa.string()), ("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32()), ("edit", pa.string()), ("made", pa.list_(pa.string())), ("audit", pa.string()), ("cost", pa.int64()), ("faults", pa.list_(pa.int64())), ("illegal", pa.int64()), ("gaps", pa.int64())])
    held: dict = {"conv": None}

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        own = lambda x, kind: x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind)
        return pa.RecordBatch.from_arrays([own(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def ended() -> Iterator[pa.RecordBatch]:
        if held["conv"] is None:
            return
        cost, edits, last = held["chart"].repair()
        made, before, letters = [], "", []
        for initial, edit in zip([*held["roles"], ""], [*edits, "I" * last], strict=True):
            own = []
            for x in edit:
                if x in "IR":
                    before = "a" if before == "u" else "u"
                    own.append(MADE[before])
                elif x == "K":
                    before = initial
            made.append(own)
            letters.append(edit)
        for a in range(0, len(letters), 10_000):
            own = range(a, min(a + 10_000, len(letters)))
            some = [i for i in own if letters[i]]
            yield batch_of(len(some), kind=[1] * len(some), conv=[held["conv"]] * len(some), place=some, edit=[letters[i] for i in some], made=[made[i] for i in some])
        gaps = held["last"] - held["first"] + 1 - held["turns"] if held["turns"] else 0
        yield batch_of(1, kind=[2], conv=[held["conv"]], conv_id=[held["conv_id"]], audit=["".join(letters)], cost=[cost], faults=[held["faults"]], illegal=[held["illegal"]], gaps=[gaps])

    for batch in batches:
        places = []
        for conv, conv_id, turn, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "conv_id", "turn", "role", "fault")), strict=True):
            if conv != held["conv"]:
                yield from ended()
                held = {"conv": conv, "conv_id": conv_id, "chart": Chart(), "roles": [], "first": None, "last": None, "turns": 0, "faults": [0, 0, 0], "illegal": 0}
            if turn is not None and turn != held["last"]:
                held["first"], held["last"], held["turns"] = turn if held["turns"] == 0 else held["first"], turn, held["turns"] + 1
            if fault:
                held["faults"][fault - 1] += 1
            initial = role[:1]
            if held["roles"] and held["roles"][-1] + initial not in ("su", "ua", "au"):
                held["illegal"] += 1
            places.append(len(held["roles"]))
            held["roles"].append(initial)
            held["chart"].read(initial, fault)
        yield batch_of(len(batch), kind=[0] * len(batch), place=places, **{c: batch.column(c) for c in ("conv", "conv_id", "turn", "role", "text", "fault")})
    yield from ended()


def repair(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The repaired transcript (conv_id, conv, place, step, edit, turn, role, text, fault) of rows (conv_id, turn, role, text), and for each
    conversation (conv_id, conv, cost, audit, blank, duplicate, truncated, illegal, gaps).

    A conversation's rows stand by turn, null first, then by role and text. ``edit`` is K, R, D or I; deleted rows have theirs and aren't
    part of the repair; inserted rows have no text and no turn, and come before the row of their ``place``. Null conv_ids are
    one conversation, null roles and texts one space. ``conv`` is the conversation as a text. A role without a character fits
    nowhere. Repeated rows are duplicates of each other. Other columns are ignored; an empty table gives empty ones."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(blank("conv_id").alias("conv"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"))
    said = Window.partitionBy("conv", F.md5(F.to_json(F.struct("role", "text")))).orderBy(F.col("turn").asc_nulls_first())
    marked = own.withColumn("fault", fault_of(F.col("text"), F.row_number().over(said) > 1))
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "text", "fault")
    chart = scratch.keep(marked.repartition("conv").sortWithinPartitions(*order).mapInArrow(_parser, CHART), "chart")
    edits = chart.where("kind = 1").select("conv", "place", F.col("edit").alias("edits"), "made")
    read = chart.where("kind = 0").select("conv", "conv_id", "place", "turn", "role", "text", "fault")
    joined = edits.join(read, ["conv", "place"], "left")
    # One row for each letter: insertions, and then the row itself, which a last insertion at the end doesn't have.
    n_made, step = F.size("made"), F.posexplode(F.split("edits", "")).alias("step", "edit")
    steps = joined.select("*", step)
    made = F.when(F.col("step") < n_made, F.get("made", F.col("step")))
    insert, rerole = F.col("edit") == "I", F.col("edit") == "R"
    transcript = steps.select(
        "conv_id", "conv", "place", "step", "edit", F.when(~insert, F.col("turn")).alias("turn"), F.when(insert | rerole, made).otherwise(F.col("role")).alias("role"),
        F.when(insert, "").otherwise(F.col("text")).alias("text"), F.when(~insert, F.col("fault")).alias("fault"),
    )
    found = chart.where("kind = 2").select("conv_id", "conv", "cost", "audit", *(F.get("faults", i).alias(n) for i, n in enumerate(("blank", "duplicate", "truncated"))), "illegal", "gaps")
    return transcript, found


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest = None, None
    done: list[tuple[str, str]] = []
    for batch in batches:
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text")), strict=True):
            if c != conv:
                if digest:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=["conv", "sha256"])
            done = []
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "sha256"])


def transcript_sha256(transcript: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's repaired ``role:text`` lines, hashed as they stream by; those of which nothing is left have none."""
    rows = transcript.where("edit <> 'D'").select("conv", "place", "step", "role", "text")
    return rows.repartition("conv").sortWithinPartitions("conv", "place", "step").select("conv", "role", "text").mapInArrow(_hasher, "conv string, sha256 string")
