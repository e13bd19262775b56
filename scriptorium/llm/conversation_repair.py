"""Repair of the role structure of conversations, one solution for each distinct structure.

Rows are ordered by turn (nulls first), then role, then MD5 of the text; rows equal in all these
are the same.  A row's first fault counts: blank (nothing but white space), duplicate (role
and text seen earlier in the conversation), truncated (its last character is not one of [.!?]).
A conversation's roles and faults are encoded as a signature, a character a row.  Few signatures
are distinct, and each is solved once: the cheapest edits after which the initials of the roles
match (s?(ua)+)?, by memoised recursion over (row, last role).  The audits, strings of the
initials of the edits, are joined back and replayed over the rows.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows),
Insert an empty row of user or assistant 5; a truncated row that is not deleted costs 5 more.  Of
equal costs the audit that is least in ASCII wins.

Conversations are cut into ranges of rows for their signatures, so a hot one is not gathered for
them: what meets are strings of one byte a row.  Equal rows are counted before they move.
Conversations that share a hot signature get its solution by broadcast.  Only the replay
needs the rows of a conversation in order in one task, which reads them as a stream and holds one batch.

Edge cases: null roles and texts are one space; a role with another initial than s, u, a can
only be re-roled or deleted; a null conversation id is a conversation; null turns come first and do
not count in gaps; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import PARTS

ROLES = "suax"  # x: any other initial
#: Characters of a signature by role: sound, truncated, blank, duplicate.
SOUND, TRUNCATED, BLANK, DUPLICATE = "suax", "SUAX", "0123", "4567"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
_SPACE = " \t\n\x0b\x0c\r"
#: States of the recursion, by what stands last: nothing, s, u, a.  What may follow them is u, u, a, u.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
_KEPT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}, "x": {}}


def solve(signature: str) -> tuple[int, str]:
    """Least cost of a signature, and the audit: the initials D, I, K, R of the edits, in order.

    The memo (row, state) is filled from the last row up, so no depth of recursion grows with the
    conversation; it holds a byte an entry, since a best edit leads to one state.
    """
    none = (1 << 60, "")

    def with_inserts(best: list[tuple[int, str]]) -> list[tuple[int, str]]:
        for _ in range(3):
            best = [min(best[q], (best[_NEXT[q]][0] + INSERT, "I")) for q in range(4)]
        return best

    best = with_inserts([(0, ""), none, none, (0, "")])
    memo = [[b[1] for b in best]]
    for c in reversed(signature):
        cost, role = [b[0] for b in best], None
        if c in SOUND or c in TRUNCATED:
            role, more = c.lower(), CUT if c in TRUNCATED else 0
        best = []
        for q in range(4):
            choices = [(cost[q] + DELETE, "D")]
            if role is not None:
                choices.append((cost[_NEXT[q]] + REROLE + more, "R"))
                if q in _KEPT[role]:
                    choices.append((cost[_KEPT[role][q]] + KEEP + more, "K"))
            best.append(min(choices))
        best = with_inserts(best)
        memo.append("".join(b[1] for b in best))
    total, audit, q, k = best[START][0], [], START, 0
    while edit := memo[len(signature) - k][q]:
        audit.append(edit)
        if edit == "K":
            q = _KEPT[signature[k].lower()][q]
        elif edit != "D":
            q = _NEXT[q]
        k += edit != "I"
    return total, "".join(audit)


def illegal(signature: str) -> int:
    """Adjacent rows whose initials are not su, ua or au."""
    initials = signature.translate(str.maketrans(SOUND + TRUNCATED + BLANK + DUPLICATE, ROLES * 4))
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins by `conv`, null equal to null."""
    right = right.withColumnRenamed("conv", "_conv")
    return left.join(right, left["conv"].eqNullSafe(right["_conv"]), how).drop("_conv")


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults by crc32("conv:turn") % 20: 0 drops a row, 1 empties its
    text, 2 removes its [.!?], 3 repeats it, 4 gives it the role user.  Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), fate.alias("fate")).where("fate <> 0")
    hurt = plain.select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    return hurt.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "copy")


_ORDER = ("conv", "turn", "role", "digest")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _letter(letters: str) -> Column:
    """The character of a signature for the initial of `role`."""
    at = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(4)
    return F.substring(F.lit(letters), at, F.lit(1))


def _pieces(keyed: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, piece): what rows that are equal in all these add to the signature."""
    last = F.right(F.rtrim(F.col("text"), F.lit(_SPACE)), F.lit(1))
    letters = F.when(last == "", _letter(BLANK)).when(last.isin(".", "!", "?"), _letter(SOUND)).otherwise(_letter(TRUNCATED))
    cells = keyed.groupBy(*_ORDER).agg(F.first(letters).alias("letter"), F.count("*").cast("int").alias("n"))
    cells = written(cells, "repair-cells")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = cells.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    seen = seen.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    same = cells["conv"].eqNullSafe(seen["_conv"]) & (cells["role"] == seen["_role"]) & (cells["digest"] == seen["_digest"])
    again = F.coalesce(place > F.col("first"), F.lit(False))
    blank = F.col("letter").isin(*BLANK)
    other = F.repeat(_letter(DUPLICATE), F.col("n") - 1)
    piece = F.when(blank, F.repeat("letter", F.col("n"))).when(again, F.repeat(_letter(DUPLICATE), F.col("n"))).otherwise(F.concat("letter", other))
    return cells.join(seen, same, "left").select(*_ORDER, piece.alias("piece"))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, signature) of the conversations of rows (conv, turn, role, text)."""
    pieces = written(_pieces(_keyed(rows)), "repair-pieces")

    def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_, held = TaskContext.get().partitionId(), None, []
        for batch in batches:
            out = []
            for conv, piece in zip(batch["conv"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                if held and conv != open_:
                    out.append((open_, "".join(held)))
                    held = []
                open_ = conv
                held.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch["conv"].type), pa.array([part] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.string())], ["conv", "part", "chunk"])
            kind = batch["conv"].type
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([open_], kind), pa.array([part], pa.int64()), pa.array(["".join(held)])], ["conv", "part", "chunk"])

    conv = rows.schema["conv"].dataType.simpleString()
    ordered = pieces.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("conv", "piece")
    chunks = ordered.mapInArrow(strung, f"conv {conv}, part long, chunk string")
    in_order = F.array_sort(F.collect_list(F.struct("part", "chunk")))  # a chunk a range that the conversation is in
    return chunks.groupBy("conv").agg(F.array_join(F.transform(in_order, lambda x: x["chunk"]), "").alias("signature"))


def solutions(signed: DataFrame) -> DataFrame:
    """(signature, conversations, blank, duplicate, truncated, illegal, cost, audit): one row a distinct signature of rows (conv, signature)."""
    distinct = signed.groupBy("signature").agg(F.count("*").alias("conversations"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s.count, illegal(s), *solve(s)) for s in batch["signature"].to_pylist()]
            counts = [pa.array([sum(map(f[0], kind)) for f in found], pa.int64()) for kind in (BLANK, DUPLICATE, TRUNCATED)]
            rest = [pa.array([f[k] for f in found], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch["signature"], batch["conversations"], *counts, *rest], names)

    names = ["signature", "conversations", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return distinct.mapInArrow(run, "signature string, conversations long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def audits(rows: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit) of rows (conv, turn, role, text)."""
    signed = written(signatures(rows), "repair-signatures")
    solved = written(solutions(signed), "repair-solutions")
    bound = signed.count() // PARTS
    large = F.broadcast(solved.where(F.col("conversations") > bound))  # fewer than PARTS rows, which rows of the input pay for
    small = solved.where(F.col("conversations") <= bound)
    rest = signed.join(large.select("signature"), "signature", "left_anti").join(small, "signature")
    return signed.join(large, "signature").unionByName(rest).drop("signature", "conversations")


class _Replay:
    """Edits of one conversation, applied to its rows as they come."""

    def __init__(self, audit: str) -> None:
        self.edits, self.state = iter(audit), START

    def _new(self) -> tuple[str, str]:
        self.state = _NEXT[self.state]
        return "user" if self.state == AFTER_U else "assistant", ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        for edit in self.edits:
            if edit == "I":
                yield self._new()
                continue
            if edit == "K":
                self.state = _KEPT[role[0]][self.state]
                yield role, text
            elif edit == "R":
                yield self._new()[0], text
            return

    def end(self) -> Iterator[tuple[str, str]]:
        for _ in self.edits:  # inserts only
            yield self._new()


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For each batch: (conv, role, text) of the repaired rows; (conv, None, None) where a conversation begins."""
    replay, at = None, None
    for batch in batches:
        out = []
        for conv, audit, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "audit", "role", "text")), strict=True):
            if audit is None:
                out += [(conv, *r) for r in replay.row(role, text)]
                continue
            if replay is not None:
                out += [(at, *r) for r in replay.end()]
            replay, at = _Replay(audit), conv
            out.append((conv, None, None))
        yield out
    if replay is not None:
        yield [(at, *r) for r in replay.end()]


def _stream(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, audit, role, text): by conversation its audit, then its rows in order."""
    keyed = _keyed(rows).withColumn("audit", F.lit(None).cast("string"))
    heads = edits.select("conv", "audit")
    both = keyed.unionByName(heads, allowMissingColumns=True).withColumn("_row", F.col("audit").isNull())
    return both.repartition("conv").sortWithinPartitions("conv", "_row", "turn", "role", "digest").select("conv", "audit", "role", "text")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, place, role, text): the repaired conversations, from `rows` (conv, turn, role, text) and their `audits`."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, schema = 0, None
        batches = iter(batches)

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for b in batches:
                schema = pa.schema([("conv", b["conv"].type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
                yield b

        for found in _replayed(noted()):
            out = []
            for conv, role, text in found:
                if role is None:
                    place = 0
                else:
                    out.append({"conv": conv, "place": place, "role": role, "text": text})
                    place += 1
            yield pa.RecordBatch.from_pylist(out, schema)

    return _stream(rows, edits).mapInArrow(run, f"conv {kind}, place long, role string, text string")


def fingerprints(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of the lines `role:text` of each repaired conversation."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, lines, started, schema = None, None, 0, False, None
        batches = iter(batches)

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for b in batches:
                schema = pa.schema([("conv", b["conv"].type), ("repaired_sha256", pa.string())])
                yield b

        for found in _replayed(noted()):
            out = []
            for conv, role, text in found:
                if role is None:
                    if started:
                        out.append({"conv": at, "repaired_sha256": digest.hexdigest()})
                    at, digest, lines, started = conv, hashlib.sha256(), 0, True
                else:
                    digest.update((("\n" if lines else "") + role + ":" + text).encode())
                    lines += 1
            yield pa.RecordBatch.from_pylist(out, schema)
        if started:
            yield pa.RecordBatch.from_pylist([{"conv": at, "repaired_sha256": digest.hexdigest()}], schema)

    return _stream(rows, edits).mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each distinct `conv` of `conversations` (conv): gaps, the counts of faults, illegal,
    cost, audit and repaired_sha256, from the rows (conv, turn, role, text) that there are of it."""
    rows = written(rows, "repair-rows")
    edits = written(audits(rows), "repair-audits")
    gap = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("conv").agg(F.coalesce(gap, F.lit(0)).cast("long").alias("gaps"))
    out = _join(conversations.select("conv").distinct(), gaps, "left")
    out = _join(_join(out, edits, "left"), fingerprints(rows, edits), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
