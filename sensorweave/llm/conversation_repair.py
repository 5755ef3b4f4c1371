"""Repair of conversations: the cheapest edits that give every one the form ``(system? (user assistant)+)?``.

Turns are kept, given another role, deleted or inserted.  A backward pass over turns and grammar states
gives the least cost to the end; a forward walk then takes, among the steps whose cost is tight, the one
whose initial is least in ASCII.  A state and an initial leave one next state, so the walk finds the
least audit of all cheapest ones.

No conversation has to fit into a task.  Equal turns are counted before they are shuffled.  What the
costs need of a turn (place, role, digest of its text, fault) is cut by range into pieces, in which a
conversation may go on from piece to piece: a piece tells what it costs to cross it from each state to
each, these tables are chained from the end, and each piece then decides its turns for all four states.
Texts are shuffled once, to where their conversation's turns are hashed one after another; that task
holds one turn, the digest so far and the audit, which is a value of the result.

Defined results: rows of one turn stand in order of role, then of the text's SHA-256; repeated rows are
duplicates; a null conversation is one conversation; a null turn comes first and does not count for gaps;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.llm._shared import Tables

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
FAR = 1 << 60
#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after an inserted or reroled turn, the only one that the grammar allows there.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Cost of finishing in each state, and the edits that do it.
FINISH, FINISHING = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: What a turn may be: anything, cut off, or to be deleted.
FINE, CUT, BLANK = range(3)

ORDER = ["conv", "has_turn", "turn", "role", "digest"]


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows after the planted damage, as (conv, turn, role, text, copies); a dropped row has no copies."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    texts = F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.when(kind == 0, F.lit("")).when(kind == 4, F.lit("user")).otherwise(spaced(role)).alias("role"),
        texts.alias("text"), F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("copies"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Keys without nulls, the text's digest and whether it is blank or cut off."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("conv"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(F.coalesce("text", F.lit(" ")), 256)).alias("digest"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.when(F.coalesce(last, F.lit("")) == "", F.lit(BLANK)).when(last.isin(".", "!", "?"), F.lit(FINE)).otherwise(F.lit(CUT)).alias("fault"), "copies",
    )


def _allowed(state: int, initial: str) -> int:
    """The state after a turn of this initial is kept, or -1."""
    if initial == "s":
        return SYSTEM if state == START else -1
    if initial == "u":
        return USER if state != USER else -1
    return ASSISTANT if initial == "a" and state == USER else -1


_AFTER = {i: tuple(_allowed(s, i) for s in STATES) for i in "sua"}
_NONE = (-1, -1, -1, -1)


def _before(role: str, fault: int, first: bool, copies: int, to_end: list[int]) -> tuple[list[int], list[int], int]:
    """Costs to the end from each state before a turn and its copies, given those after; also those of taking the turn at once, and the turn's own surcharge."""
    extra = copies - 1 if first and fault != BLANK else copies
    rest = [c + DELETE * extra for c in to_end]
    if extra == copies:
        return rest, rest, 0
    surcharge, after = TRUNCATED if fault == CUT else 0, _AFTER.get(role[:1], _NONE)
    now = []
    for s in STATES:
        cost = min(rest[s] + DELETE, rest[NEXT[s]] + REROLE + surcharge)
        if after[s] >= 0:
            cost = min(cost, rest[after[s]] + KEEP + surcharge)
        now.append(cost)
    # an inserted turn leads to a user or assistant turn, a second one from one of these to the other
    user, assistant = min(now[USER], now[ASSISTANT] + INSERT), min(now[ASSISTANT], now[USER] + INSERT)
    return [min(now[START], user + INSERT), min(now[SYSTEM], user + INSERT), user, assistant], rest, surcharge


def _decide(role: str, costs: list[int], rest: list[int], surcharge: int) -> str:
    """For each state the inserted turns and the edit of a turn that may stay, in initials, states set apart by a bar."""
    after, out = _AFTER.get(role[:1], _NONE), []
    for state in STATES:
        edits, s = "", state
        while True:
            if costs[s] == rest[s] + DELETE:
                edits += "D"
            elif costs[s] == costs[NEXT[s]] + INSERT:
                edits, s = edits + "I", NEXT[s]
                continue
            elif after[s] >= 0 and costs[s] == rest[after[s]] + KEEP + surcharge:
                edits += "K"
            else:
                edits += "R"
            break
        out.append(edits)
    return "|".join(out)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, list[dict]]]:
    """Rows of one conversation in one piece; whether the run is the first and the last of its piece."""
    held: list[dict] = []
    opens = True
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["piece"] != held[0]["piece"] or row["conv"] != held[0]["conv"]):
                yield opens, row["piece"] != held[0]["piece"], held
                opens, held = row["piece"] != held[0]["piece"], []
            held.append(row)
    if held:
        yield opens, True, held


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, piece, costs from each state to each) of the runs at a piece's ends; only these can go on in another piece."""
    out = []
    for opens, closes, rows in _runs(batches):
        if opens or closes:
            tables = []
            for end in STATES:
                costs = [0 if s == end else FAR for s in STATES]
                for r in reversed(rows):
                    costs = [min(c, FAR) for c in _before(r["role"], r["fault"], r["first"], r["copies"], costs)[0]]
                tables += costs
            out.append((rows[0]["conv"], rows[0]["piece"], tables))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.int32(), pa.list_(pa.int64())))], names=["conv", "piece", "crossing"])


def _chain(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs to the end after each piece of one conversation, from the last piece back."""
    pieces = pieces.sort_values("piece")
    costs, out = list(FINISH), []
    for piece, table in zip(pieces["piece"][::-1], pieces["crossing"][::-1]):
        out.append((piece, costs))
        costs = [min(FAR, *(int(table[4 * end + s]) + costs[end] for end in STATES)) for s in STATES]
    return pd.DataFrame({"conv": pieces["conv"].iloc[0], "piece": [p for p, _ in out], "to_end": [c for _, c in out]})


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn with its edits for every state; a run begins with its costs to the end if it goes on elsewhere."""
    names = [*ORDER, "fault", "copies", "first", "edits"]
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]
    out: list[list] = [[] for _ in names]

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    for _, _, rows in _runs(batches):
        costs = list(FINISH)
        if rows[0]["to_end"] is not None:
            costs = rows[0]["to_end"]
            rows = rows[1:]
        for r in reversed(rows):
            costs, rest, surcharge = _before(r["role"], r["fault"], r["first"], r["copies"], costs)
            stays = r["first"] and r["fault"] != BLANK and r["copies"] > 0
            for held, x in zip(out, [*(r[c] for c in names[:-1]), _decide(r["role"], costs, rest, surcharge) if stays else ""]):
                held.append(x)
        if len(out[0]) > 20_000:
            yield made()
            out = [[] for _ in names]
    if out[0]:
        yield made()


class _Walk:
    """The forward walk over one conversation and the digest of its repaired turns."""

    def __init__(self, conv: str):
        self.conv, self.state, self.audit, self.hash, self.turns = conv, START, [], hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.places = 0
        self.least = self.most = self.initial = self.waiting = None

    def _add(self, role: str, text: bytes) -> None:
        self.hash.update((b"\n" if self.turns else b"") + role.encode("utf-8", "surrogatepass") + b":")
        self.hash.update(text)
        self.turns += 1

    def edit(self, row: dict) -> None:
        """A turn's edits; its text, if it stays, comes next."""
        self.waiting, n = None, row["copies"]
        if n == 0:
            return
        if row["has_turn"] and row["turn"] != self.most:
            self.places += 1
            self.least, self.most = row["turn"] if self.least is None else self.least, row["turn"]
        initial = row["role"][:1]
        self.illegal += n - 1 + (self.initial is not None and (self.initial + initial) not in ("su", "ua", "au"))
        self.initial = initial
        fault, extra = row["fault"], n
        if fault == BLANK:
            self.blank += n
        elif row["first"]:
            self.duplicate += n - 1
            self.truncated += fault == CUT
            extra = n - 1
            edits = row["edits"].split("|")[self.state]
            self.audit.append(edits)
            self._insert(len(edits) - 1)
            surcharge = TRUNCATED if fault == CUT else 0
            if edits[-1] == "D":
                self.cost += DELETE
            elif edits[-1] == "K":
                self.cost += surcharge
                self.state = _allowed(self.state, initial)
                self.waiting = row["role"]
            else:
                self.cost += REROLE + surcharge
                self.state = NEXT[self.state]
                self.waiting = ROLE[self.state]
        else:
            self.duplicate += n
        self.cost += DELETE * extra
        self.audit.append("D" * extra)

    def _insert(self, n: int) -> None:
        for _ in range(n):
            self.state = NEXT[self.state]
            self.cost += INSERT
            self._add(ROLE[self.state], b"")

    def text(self, data: bytes) -> None:
        if self.waiting is not None:
            self._add(self.waiting, data)
            self.waiting = None

    def result(self) -> tuple:
        self.audit.append(FINISHING[self.state])
        self._insert(len(FINISHING[self.state]))
        gaps = self.most - self.least + 1 - self.places if self.places else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


RESULT = [("conv", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk, done, size = None, [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*done), RESULT)], names=[n for n, _ in RESULT])

    for batch in batches:
        for row in batch.to_pylist():
            if walk is None or row["conv"] != walk.conv:
                if walk is not None:
                    done.append(walk.result())
                    size += len(done[-1][7]) + 200
                    if size > 4_000_000:
                        yield made()
                        done, size = [], 0
                walk = _Walk(row["conv"])
            if row["edits"] is not None:
                walk.edit(row)
            else:
                walk.text(row["text"])
    if walk is not None:
        done.append(walk.result())
    if done:
        yield made()


def repair(rows: DataFrame, conv_type: T.DataType) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for rows of (conv, turn, role, text, copies)."""
    spark = rows.sparkSession
    tables = Tables(spark, "repair")
    keyed = _keyed(rows)
    turns = tables.add(keyed.groupBy(*ORDER).agg(F.max("fault").alias("fault"), F.sum("copies").alias("copies")))
    place = F.struct("has_turn", "turn")
    firsts = turns.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min(place).alias("at")).select("conv", "at.has_turn", "at.turn", "role", "digest", F.lit(True).alias("first"))
    flagged = turns.join(firsts, ORDER, "left").withColumn("first", F.coalesce("first", F.lit(False)))
    cut = tables.add(flagged.repartitionByRange(*ORDER).withColumn("piece", F.spark_partition_id()))
    tables.drop(turns)

    def by_piece(df: DataFrame) -> DataFrame:
        return df.repartition("piece").sortWithinPartitions("piece", "conv", *([F.col("to_end").isNull()] if "to_end" in df.columns else []), *ORDER[1:])

    crossing = tables.add(by_piece(cut).select("piece", "conv", "role", "fault", "first", "copies").mapInArrow(_crossing, "conv string, piece int, crossing array<bigint>"))
    several = crossing.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    ends = crossing.join(several, "conv", "left_semi").groupBy("conv").applyInPandas(_chain, "conv string, piece int, to_end array<bigint>")
    begun = cut.withColumn("to_end", F.lit(None).cast("array<bigint>")).unionByName(ends, allowMissingColumns=True)
    decided = by_piece(begun).mapInArrow(_decisions, "conv string, has_turn boolean, turn bigint, role string, digest binary, fault int, copies bigint, first boolean, edits string")
    texts = keyed.where(f"copies > 0 and fault <> {BLANK}").select(*ORDER, F.col("text").cast("binary").alias("text"))
    both = decided.unionByName(texts, allowMissingColumns=True)
    streamed = both.repartition("conv").sortWithinPartitions(*ORDER, F.col("edits").isNull())
    schema = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    found = streamed.mapInArrow(_walks, schema)
    named: Column = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(conv_type)
    return found.withColumn("conv", named)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The planted damage, then the repair, by ``conv_id``."""
    return repair(damage(conversations), conversations.schema["conv_id"].dataType).withColumnRenamed("conv", "conv_id")
