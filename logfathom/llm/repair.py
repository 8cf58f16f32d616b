"""Conversation structure repair: the cheapest edits that give a legal order of roles.

A legal conversation has the role initials ``(s?(ua)+)?``; four grammar states accept it. Per
turn, the reachable states of each cost are four bits of one integer, so that one shift or mask
moves the states of every cost layer at once: an edit of cost ``c`` shifts by ``c`` layers. The
layers are built from the last turn to the first; the first layer that holds the start state is
the cost, and a trace from there reads the least audit off the stored bits.

A state's cost lies at most five above the least of its turn (two insertions reach any later
state, and one deletion takes the place of a kept system turn), so six layers a turn are all
that can matter: a turn takes 24 bits and a number.

Texts move once. Faults are found by Spark on rows without text (a hash of role and text finds
duplicates), the solver sees a byte a row, and the repaired texts are hashed as they stream by
in order. A conversation is solved and hashed in one task because its audit is one value and a
SHA-256 is one sequence; that task holds some bytes a row and no texts, and Spark's sorts spill.

Edge cases: a null conversation id is a conversation; null roles and texts are one space, which
is no legal role, and so is an empty role; null turns come first; rows with equal turns go by
role, then by a hash of role and text, so that repeated rows are neighbours; texts of any length
are judged whole; a conversation without rows after the damage has zeros; an empty table gives
an empty one; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, streamed

GAPS = " \t\n\x0b\f\r"
#: Code of a row: its initial (0 none, 1 s, 2 u, 3 a), and bits for what must go and what ends abruptly.
INITIALS, MUST_GO, CUT_OFF = "_sua", 4, 8
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
HASHES = "conv_id long, repaired_sha256 string"

# States: 1 start, 2 after s, 4 after u, 8 after a. A layer is four bits; BAND layers are kept.
BAND = 6
_ALL = (1 << 4 * BAND) - 1
_START, _AFTER_S, _AFTER_U, _AFTER_A = (sum(b << 4 * k for k in range(BAND + 5)) for b in (1, 2, 4, 8))
ACCEPTING = 1 | 8


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) after the damage; those dropped stay as ``gone``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    act = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    r = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), act.alias("act"))
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("act") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("act") == 3, 2).otherwise(1))
    return r.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("act") == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def _same() -> Column:
    """A hash of role and text; equal for equal pairs only, but for SHA-256 itself."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """Per row, without its text: conv_id, turn, role, same, gone, blank, duplicate, truncated; at most one of the last three."""
    end = F.substring(F.rtrim("text", F.lit(GAPS)), -1, 1)
    slim = rows.select("conv_id", "turn", "role", "gone", _same().alias("same"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open")).repartition("conv_id")
    # the partitioning by conversation serves this window too: no second shuffle
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "same").orderBy(F.col("turn").asc_nulls_first())) > 1
    duplicate = again & ~F.col("blank")
    return slim.withColumn("duplicate", duplicate).withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("duplicate")).drop("open")


def _before_insert(to: int) -> int:
    """States from which a user or assistant turn leads to ``to``, in all layers."""
    u, a = to & _AFTER_U, to & _AFTER_A
    return u >> 2 | u >> 1 | u << 1 | a >> 1


def _before_keep(to: int, initial: int) -> int:
    if initial == 2:
        u = to & _AFTER_U
        return u >> 2 | u >> 1 | u << 1
    return (to & (_AFTER_S if initial == 1 else _AFTER_A)) >> 1 if initial else 0


def _after_insert(states: int) -> int:
    return (4 if states & 11 else 0) | (8 if states & 4 else 0)


def _after_keep(states: int, initial: int) -> int:
    if initial == 2:
        return 4 if states & 11 else 0
    return (states & (1 if initial == 1 else 4)) << 1 if initial else 0


def solve(codes: bytes) -> tuple[int, str]:
    """Cost and least audit of one conversation's rows."""
    n = len(codes)
    layers, base = array("I", bytes(4 * (n + 1))), array("q", bytes(8 * (n + 1)))

    def closed(bits: int) -> int:
        """With insertions before, which cost two layers each; three in a row return to where they began."""
        for _ in range(3):
            bits |= _before_insert(bits) << 8
        return bits

    layers[n] = closed(ACCEPTING) & _ALL
    for j in range(n - 1, -1, -1):
        after, code = layers[j + 1], codes[j]
        bits = after << 12  # delete
        if not code & MUST_GO:
            more = 4 if code & CUT_OFF else 0
            bits |= _before_keep(after, code & 3) << more | _before_insert(after) << 8 + more
        least = ((bits & -bits).bit_length() - 1) // 4  # the first layer with a state
        layers[j], base[j] = closed(bits >> 4 * least) & _ALL, base[j + 1] + least

    def within(j: int, states: int, cost: int) -> int:
        """Those of ``states`` from which turn ``j`` on costs exactly ``cost``."""
        k = cost - base[j]
        return states & layers[j] >> 4 * k & 15 if 0 <= k < BAND else 0

    left = next(base[0] + k for k in range(BAND) if layers[0] >> 4 * k & 1)
    total, states, j, audit = left, 1, 0, bytearray()
    while j < n or left:
        more = 1 if j < n and codes[j] & CUT_OFF else 0
        if j < n and (to := within(j + 1, states, left - 3)):
            letter, cost, j = b"D", 3, j + 1
        elif to := within(j, _after_insert(states), left - 2):
            letter, cost = b"I", 2
        elif to := within(j + 1, _after_keep(states, codes[j] & 3), left - more) if not codes[j] & MUST_GO else 0:
            letter, cost, j = b"K", more, j + 1
        else:
            to = within(j + 1, _after_insert(states), left - 2 - more)
            letter, cost, j = b"R", 2 + more, j + 1
        states, left = to, left - cost
        audit += letter
    return total, audit.decode()


class _Conversation:
    """What is kept of one conversation while its rows stream by in order."""

    def __init__(self, conv: int | None):
        self.conv, self.codes, self.counts = conv, bytearray(), [0, 0, 0]
        self.turns = self.illegal = 0
        self.first = self.last = None

    def add(self, turn: int | None, initial: int, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.codes and (self.codes[-1] & 3, initial) not in ((1, 2), (2, 3), (3, 2)):
            self.illegal += 1
        for k, x in enumerate((blank, duplicate, truncated)):
            self.counts[k] += x
        self.codes.append(initial | (MUST_GO if blank or duplicate else CUT_OFF if truncated else 0))

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.counts, self.illegal, *solve(bytes(self.codes)))


def _solved(rows: Iterator[tuple]) -> Iterator[tuple]:
    now: _Conversation | None = None
    for conv, *row, gone in rows:
        if now is None or conv != now.conv:
            if now is not None:
                yield now.result()
            now = _Conversation(conv)
        if not gone:
            now.add(*row)
    if now is not None:
        yield now.result()


def audits(damaged: DataFrame) -> DataFrame:
    """Per conversation: gaps, counts of faults, illegal neighbours, cost and audit."""
    rows = faults(damaged)
    initial = F.when(F.col("role") == "", 0).otherwise(F.greatest(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1, F.lit(0)))
    ordered = rows.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "same")
    return ordered.select("conv_id", "turn", initial.cast("int").alias("initial"), "blank", "duplicate", "truncated", "gone").mapInArrow(streamed(_solved, RESULT), RESULT)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows, one after the other."""
    before = "a"
    for op in audit:
        role, text = next(rows) if op != "I" else (None, "")
        if op == "D":
            continue
        role = role if op == "K" else "assistant" if before == "u" else "user"
        before = role[0]
        yield role, text


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Conversations in order, each an audit and then its rows, to a digest each."""
    for conv, audit, _, _ in rows:
        total, sep = hashlib.sha256(), ""
        for role, text in edited(audit, ((r, t) for _, _, r, t in rows)):
            total.update(f"{sep}{role}:{text}".encode("utf-8", "surrogatepass"))
            sep = "\n"
        yield conv, total.hexdigest()


def repaired(rows: DataFrame) -> DataFrame:
    """Damaged ``conversations`` and their repair: a row per conv_id with the audit and a digest of the repaired rows."""
    damaged = damage(rows)
    found = staged(audits(damaged))
    texts = damaged.where(~F.col("gone")).select("conv_id", F.lit(True).alias("is_row"), "turn", "role", _same().alias("same"), F.lit(None).cast("string").alias("audit"), "text")
    heads = found.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("same"), "audit", F.lit("").alias("text"))
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", F.col("turn").asc_nulls_first(), "role", "same")
    hashes = both.select("conv_id", "audit", "role", "text").mapInArrow(streamed(_hashed, HASHES), HASHES)
    hashes = hashes.withColumnRenamed("conv_id", "_c")
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
