"""Conversation repair: faults of each row, and the cheapest edits that make roles alternate, by a two-way tight-arc graph."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What an undeleted truncated row adds.
TRUNCATED = 3
#: Rows of a conversation that are gathered, or solved, at once; a power of two.
BLOCK = 4096
ROLES = {"u": "user", "a": "assistant"}
# States of (s?(ua)+)?: nothing yet, after s, after u, after a. A step into 2 adds a user row, into 3 an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ACCEPTS = (START, ASSISTANT)
FAR = 1 << 60
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, turn, role, text of rows with faults put in by the checksum of conv:turn, one row in four; a null is one space.

    By crc32 mod 20: 0 drops a row, 1 empties its text, 2 takes out . ! and ?, 3 repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20).alias("way")).where("way <> 0")
    way = F.col("way")
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(way == 4, "user").otherwise(F.col("role"))
    return x.select(F.col("conv").alias(conv), F.col("turn").alias(turn), role.alias("role"), text.alias("text"), F.explode(F.when(way == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n")).drop("n")


def _arcs(row: str) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of what can be done with a row of a class."""
    arcs = [("D", s, s, DELETE) for s in range(4)]
    if row.isalpha():
        more, initial = (TRUNCATED if row.isupper() else 0), row.lower()
        if initial == "s":
            arcs.append(("K", START, SYSTEM, KEEP + more))
        for s, t in NEXT.items():
            if initial == "ua"[t - USER]:
                arcs.append(("K", s, t, KEEP + more))
            arcs.append(("R", s, t, REROLE + more))
    return arcs


# Classes of rows: the role's initial, a capital if truncated; a digit if the row must go. x is any other initial.
ARCS = {c: _arcs(c) for c in "suaxSUAX0123"}
INITIAL = {c: c.lower() for c in "suaxSUAX"} | dict(zip("0123", "xsua", strict=True))
INSERTS = [("I", s, t, INSERT) for s, t in NEXT.items()]


def _inserted(cost: list[int], back: bool) -> list[int]:
    """Costs within one layer with insertions; a second round reaches what two of them reach, and no more are ever cheapest."""
    for _ in range(2):
        for _, s, t, w in INSERTS:
            if back:
                cost[s] = min(cost[s], cost[t] + w)
            else:
                cost[t] = min(cost[t], cost[s] + w)
    return cost


def _forward(cost: list[int], row: str) -> list[int]:
    out = [FAR] * 4
    for _, s, t, w in ARCS[row]:
        out[t] = min(out[t], cost[s] + w)
    return _inserted(out, False)


def _backward(cost: list[int], row: str) -> list[int]:
    out = [FAR] * 4
    for _, s, t, w in ARCS[row]:
        out[s] = min(out[s], cost[t] + w)
    return _inserted(out, True)


def cheapest(classes: str) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of a conversation's row classes, the least letters among equals.

    Least costs from the start and to the end tell of each arc whether some cheapest way uses it; the walk keeps the set of
    states that the letters so far can be in, and takes the least letter that a tight arc out of them has. Costs to the end are kept at
    the ends of blocks and worked out again inside one, so that room grows with blocks.
    """
    n = len(classes)
    ends = [_inserted([0 if s in ACCEPTS else FAR for s in range(4)], True)]
    for hi in range(n, 0, -BLOCK) if n % BLOCK == 0 else [n, *range(n - n % BLOCK, 0, -BLOCK)]:
        cost = ends[-1]
        for row in reversed(classes[(hi - 1) // BLOCK * BLOCK : hi]):
            cost = _backward(cost, row)
        ends.append(cost)
    ends.reverse()
    best, ahead = ends[0][START], _inserted([0, FAR, FAR, FAR], False)
    letters, frontier = [], {START}
    for k, lo in enumerate(range(0, max(n, 1), BLOCK)):
        block = classes[lo : lo + BLOCK]
        back, front = [ends[k + 1] if n else ends[0]], [ahead]
        for row in reversed(block):
            back.append(_backward(back[-1], row))
        back.reverse()
        for row in block:
            front.append(_forward(front[-1], row))
        ahead = front[-1]
        last = lo + len(block) >= n
        at = 0
        while at < len(block) or last:
            steps: dict[str, set[int]] = {}
            for arcs, to in ((INSERTS, at), (ARCS[block[at]] if at < len(block) else [], at + 1)):
                for letter, s, t, w in arcs:
                    if s in frontier and front[at][s] + w + back[to][t] == best:
                        steps.setdefault(letter, set()).add(t)
            if not steps:  # the end; no arc is free of cost there
                break
            letter = min(steps)
            letters.append(letter)
            frontier = steps[letter]
            at += letter != "I"
    return best, "".join(letters)


@lru_cache(maxsize=100_000)
def _remembered(classes: str) -> tuple[int, str]:
    return cheapest(classes)


def _audit(classes: pd.Series) -> pd.DataFrame:
    out = []
    for c in classes:
        initials = c.translate({ord(k): v for k, v in INITIAL.items()})
        illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(c) - 1))
        out.append((illegal, *(_remembered(c) if len(c) <= 64 else cheapest(c))))
    return pd.DataFrame(out, columns=["illegal", "cost", "audit"])


def _ordered(rows: DataFrame, conv: str, turn: str, scratch: Scratch) -> DataFrame:
    """The rows written in order, at being each one's place; ranges part a long conversation like any other rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space("role").alias("role"), space("text").alias("text"))
    x = x.withColumn("any", F.monotonically_increasing_id())  # parts even equal rows
    order = ["conv", "turn", "role", "text", "any"]
    x = x.repartitionByRange(*order).sortWithinPartitions(*order).drop("any")
    name = F.concat(F.col("conv").isNull().cast("string"), F.coalesce(F.col("conv").cast("string"), F.lit("")), F.lit("\0"), F.length("role").cast("string"), F.lit("\0"), "role", "text")
    return scratch.keep(
        x.select(
            "*",
            F.monotonically_increasing_id().alias("at"),
            (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
            F.unhex(F.sha2(name, 256)).alias("said"),
        ),
        "ordered",
    )


def _classes(ordered: DataFrame) -> DataFrame:
    """conv, classes (a character for each row, in order) and counts of each conversation.

    Blocks of at most BLOCK rows are put together first, so a conversation's rows meet as one byte each: no more than its audit has.
    """
    c = F.col
    first = ordered.where("not blank").groupBy("said").agg(F.min("at").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    x = ordered.select("conv", "turn", "role", "at", "blank", "open", "said").join(first, "said", "left")
    again = ~c("blank") & F.coalesce(c("at") > c("first"), F.lit(False))
    cut = ~c("blank") & ~again & c("open")
    kind = F.instr(F.lit("sua"), F.substring("role", 1, 1)) * (F.length("role") > 0).cast("int")
    which = lambda letters: F.substring(F.lit(letters), kind + 1, F.lit(1))
    one = F.when(c("blank") | again, which("0123")).when(cut, which("XSUA")).otherwise(which("xsua"))
    x = x.select("conv", "turn", "at", F.shiftright("at", BLOCK.bit_length() - 1).alias("block"), one.alias("row"), c("blank").cast("long").alias("blank"), again.cast("long").alias("duplicate"), cut.cast("long").alias("truncated"))
    sums = [F.sum(n).alias(n) for n in FIGURES[1:4]]
    line = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda e: e["row"]), "")
    blocks = x.groupBy("conv", "block").agg(line(F.struct("at", "row")).alias("row"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.size(F.collect_set("turn")).alias("turns"), *sums)
    held = F.array_sort(F.collect_list(F.struct("block", "row", "lo", "hi", "turns")))
    x = blocks.groupBy("conv").agg(held.alias("b"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), *sums)
    # turns are in order, so two blocks share a turn only where they meet
    shared = F.aggregate(F.sequence(F.lit(2), F.size("b")), F.lit(0), lambda n, i: n + F.coalesce((F.get("b", i - 1)["lo"] == F.get("b", i - 2)["hi"]).cast("int"), F.lit(0)))
    turns = F.aggregate("b", F.lit(0), lambda n, e: n + e["turns"]) - F.when(F.size("b") > 1, shared).otherwise(0)
    gaps = F.coalesce(c("hi").cast("long") - c("lo").cast("long") + 1 - turns, F.lit(0))
    return x.select("conv", F.array_join(F.transform("b", lambda e: e["row"]), "").alias("classes"), gaps.cast("long").alias("gaps"), *FIGURES[1:4])


def _edited(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations in order, each after its head: repaired rows, or their digest beside the head."""
    head: dict | None = None
    letters: Iterator[str] = iter("")
    state, place, sha, out, kind = START, 0, hashlib.sha256(), [], None

    def put(edit: str, role: str, text: str) -> None:
        nonlocal place, state
        line = f"{role}:{text}".encode()
        sha.update(b"\n" + line if place else line)
        if not digest:
            out.append((head["conv"], place, edit, role, text))
        place += 1
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    def inserts() -> str | None:
        """Puts the rows that are inserted here; the letter of the row that follows."""
        for letter in letters:
            if letter != "I":
                return letter
            put("I", ROLES["ua"[NEXT[state] - USER]], "")
        return None

    def close() -> None:
        if head is not None:
            inserts()
            if digest:
                out.append((head["conv"], *(head[f] for f in FIGURES), head["audit"], sha.hexdigest()))

    def give() -> pa.RecordBatch:
        names = ["conv", *FIGURES, "audit", "digest"] if digest else ["conv", "place", "edit", "role", "text"]
        kinds = [kind, *[pa.int64()] * len(FIGURES), pa.string(), pa.string()] if digest else [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        out.clear()
        return batch

    for batch in batches:
        kind = batch.schema.field("conv").type
        for row in batch.to_pylist():
            if row["at"] < 0:
                close()
                head, letters, state, place, sha = row, iter(row["audit"]), START, 0, hashlib.sha256()
                continue
            letter = inserts()
            if letter == "K":
                put("K", row["role"], row["text"])
            elif letter == "R":
                put("R", ROLES["ua"[NEXT[state] - USER]], row["text"])
        if out:
            yield give()
    close()
    if out:
        yield give()


def _stream(rows: DataFrame, conversations: DataFrame | None, conv: str, turn: str, digest: bool) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "conversations")
    ordered = _ordered(rows, conv, turn, scratch)
    classes = _classes(ordered)
    named = (rows if conversations is None else conversations).select(F.col(conv).alias("named")).distinct()
    heads = named.join(classes, F.col("named").eqNullSafe(F.col("conv")), "left").select(F.col("named").alias("conv"), F.coalesce("classes", F.lit("")).alias("classes"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in FIGURES[:4]])
    heads = heads.withColumn("a", F.pandas_udf(_audit, "illegal long, cost long, audit string")("classes")).select("conv", F.lit(-1).cast("long").alias("at"), *FIGURES[:4], "a.illegal", "a.cost", "a.audit")
    both = heads.unionByName(ordered.select("conv", "at", "role", "text"), allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions("conv", "at")
    key = T.StructField("conv", both.schema["conv"].dataType)
    more = [*[T.StructField(f, T.LongType()) for f in FIGURES], T.StructField("audit", T.StringType()), T.StructField("digest", T.StringType())]
    if not digest:
        more = [T.StructField("place", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]]
    return both.mapInArrow(lambda batches: _edited(batches, digest), T.StructType([key, *more])).withColumnRenamed("conv", conv)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, place, edit (K, R or I), role and text of the rows of every conversation after its cheapest edits."""
    return _stream(rows, None, conv, turn, False)


def repair(rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    rows are taken by turn, nulls first, equal turns by role and text; conversations, if given, names those that must be there even without
    rows: they have zeros, an empty audit and the digest of an empty string. A row's first fault counts: blank, duplicate (the
    role and text of an earlier row), truncated (its last character is no . ! or ?). audit is the letters of the cheapest edits (keep, rerole, delete,
    insert) after which the initials of roles are (s?(ua)+)?, the least in ASCII among equals; see cheapest.

    Null roles and texts are one space, a null conversation is one like others, null turns make no gaps. Roles with other initials, and empty
    ones, cannot be kept. Repeated rows are duplicates. Other columns are not looked at. An empty table gives no rows.

    Rows are ordered by ranges, so a conversation with a third of all rows is spread; its rows meet in one task only as one byte each, for the
    audit, and as a stream of texts, for the digest, which is a chain by definition and holds nothing but its state.
    """
    return _stream(rows, conversations, conv, turn, True).withColumnRenamed("digest", "repaired_sha256")
