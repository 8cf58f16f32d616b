"""Chat formatting of reply trees: root-to-leaf paths, ranked, each written as one conversation.

Messages form trees by their parents. Iterative self-joins follow parents in jumps of 1, 2, 4,
... messages, so that a chain of ``n`` takes ``log2(n)`` joins; they give each message its depth
and the score of its path. Leaves are ranked by that score, and the paths of the best are
enumerated by the same jump tables, from the longest jump to the shortest. All of this moves keys
only. Texts move once, to the paths that hold them, and conversations are written as their
sorted turns stream by, in pieces of bounded size.

The template marks a turn by ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a newline. A
control string begins with ``<|``; in texts and roles one backslash is put between any ``<``,
backslashes and ``|`` that follow one another, and taken out when read, so that a text never holds a control string.
In roles, backslashes and newlines are escaped first.

Edge cases: null texts and roles are empty; messages whose parent is missing are roots; messages
on a cycle have no path and are left out; rows with equal ids in a conversation are one message
(``linear`` numbers the rows itself, so that repeated rows are turns of their own); paths of
equal score go by leaf id; a null conversation id is a conversation; an empty table gives an
empty one; very long texts are whole, in a piece of their own; other columns are left out,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, streamed

START, END = "<|im_start|>", "<|im_end|>\n"
#: Pieces of a written conversation have about so many characters, or one turn.
PIECE = 1 << 22
WRITTEN = "conv_id long, path int, piece int, text string, spans array<struct<start: long, end: long>>"
DIGEST = "conv_id long, path int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], _unescaped(role))


def content_key(role: Column, text: Column) -> Column:
    """A hash of role and text: what a message says is known by it within its conversation."""
    parts = [F.coalesce(c, F.lit("")) for c in (role, text)]
    return F.unhex(F.sha2(F.concat(F.length(parts[0]).cast("string"), F.lit(":"), *parts).cast("binary"), 256))


def linear(rows: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as trees: each row answers the one before it."""
    slim = rows.select("conv_id", "turn", "role", content_key(F.col("role"), F.col("text")).alias("key"))
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "key")).cast("long")
    return slim.select("conv_id", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), F.lit(0.0).alias("score"), "key")


def _same(a: str, b: str) -> Column:
    """Equal conversations, null ones too; ``_null`` and ``_conv`` keep the join a plain equality."""
    return (F.col(f"{a}._conv") == F.col(f"{b}._conv")) & (F.col(f"{a}._null") == F.col(f"{b}._null"))


def ancestry(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Staged messages with ``depth`` (from 1) and ``total`` score of their path, and the jump tables of 1, 2, 4, ... parents."""
    known = nodes.select("_conv", "_null", F.col("node").alias("up"))
    now = staged(nodes.alias("a").join(known.alias("b"), _same("a", "b") & (F.col("a.parent") == F.col("b.up")), "left").select("a._conv", "a._null", "node", F.col("b.up").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"), "key"))
    jumps, done, open_before = [], now.where("up is null"), None
    now = now.where("up is not null")
    while (n := now.count()) and n != open_before:
        jumps.append(now.select("_conv", "_null", "node", "up"))
        there = done.unionByName(now).select("_conv", "_null", F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        both = now.alias("a").join(there.alias("b"), _same("a", "b") & (F.col("a.up") == F.col("b._n")))
        further = staged(both.select("a._conv", "a._null", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"), "key"))
        done, open_before, now = done.unionByName(further.where("up is null")), n, further.where("up is not null")
    return done.drop("up"), jumps  # open for ever: on a cycle, or below one


def paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of each conversation: (conv_id, path, depth, key).

    ``tree`` has conv_id, node, parent, score and key (of what the message says); a path ranks by
    the mean score of its messages.
    """
    named = tree.select(F.coalesce("conv_id", F.lit(0)).alias("_conv"), F.col("conv_id").isNull().alias("_null"), "node", "parent", "score", "key")
    nodes = staged(named.groupBy("_conv", "_null", "node").agg(F.min(F.struct("parent", "score", "key")).alias("m")).select("_conv", "_null", "node", "m.*"))
    known, jumps = ancestry(nodes)
    answered = nodes.where("parent is not null").select("_conv", "_null", "parent").distinct()
    leaves = known.alias("a").join(answered.alias("b"), _same("a", "b") & (F.col("a.node") == F.col("b.parent")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("_conv", "_null").orderBy((F.col("total") / F.col("depth")).desc(), "node"))
    chosen = leaves.withColumn("path", rank).where(F.col("path") <= branches).select("_conv", "_null", "path", "node")
    for jump in reversed(jumps):  # every distance is a sum of different jumps
        chosen = staged(chosen)
        up = chosen.alias("a").join(jump.alias("b"), _same("a", "b") & (F.col("a.node") == F.col("b.node"))).select("a._conv", "a._null", "path", F.col("up").alias("node"))
        chosen = chosen.unionByName(up)
    full = chosen.alias("a").join(known.alias("b"), _same("a", "b") & (F.col("a.node") == F.col("b.node")))
    return full.select(F.when(~F.col("a._null"), F.col("a._conv")).alias("conv_id"), "path", "depth", "key")


def _placed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows by conversation and key, what it says first: every place gets its role and text."""
    held: tuple = ()
    for conv, key, path, depth, role, text in rows:
        if path is None:
            held = (conv, key, role, text)
        elif held[:2] == (conv, key):
            yield conv, path, depth, *held[2:]


def _write(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Turns in order (conv_id, path, role, text, learned) to pieces of their conversations."""
    now, piece, parts, spans, at = None, 0, [], [], 0
    for conv, path, role, text, learned in rows:
        turn = f"{START}{role}\n{text}{END}"
        if parts and ((conv, path) != now or at + len(turn) > PIECE):
            yield *now, piece, "".join(parts), spans
            piece, parts, spans, at = piece + 1 if (conv, path) == now else 0, [], [], 0
        now = (conv, path)
        if learned:
            first = at + len(START) + len(role) + 1
            spans.append({"start": first, "end": first + len(text)})
        parts.append(turn)
        at += len(turn)
    if parts:
        yield *now, piece, "".join(parts), spans


def formatted(tree: DataFrame, contents: DataFrame, branches: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The chosen paths of ``tree`` as written conversations: (conv_id, path, piece, text, spans), in order within each partition.

    ``contents`` has conv_id, key, role and text. ``spans`` are the places in the piece's text,
    in code points, of what is learned from: the texts of the roles ``learn``, once each.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    says = contents.select("conv_id", "key", F.lit(None).cast("int").alias("path"), F.lit(None).cast("long").alias("depth"), role.alias("role"), text.alias("text"))
    places = paths(tree, branches).select("conv_id", "key", "path", "depth", F.lit("").alias("role"), F.lit("").alias("text"))
    met = says.unionByName(places).repartition("conv_id").sortWithinPartitions("conv_id", "key", F.col("path").asc_nulls_first(), "depth")
    schema = "conv_id long, path int, depth long, role string, text string"
    turns = met.select("conv_id", "key", "path", "depth", "role", "text").mapInArrow(streamed(_placed, schema, 256), schema).sortWithinPartitions("conv_id", "path", "depth")
    ready = turns.select("conv_id", "path", _role(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), F.col("role").isin(*learn).alias("learned"))
    return ready.mapInArrow(streamed(_write, WRITTEN, 64), WRITTEN)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a written conversation, or of a piece of one."""
    at = 0
    while at < len(text):
        head, end = text.index("\n", at), text.index(END, at)
        yield _unescaped_role(text[at + len(START) : head]), _unescaped(text[head + 1 : end])
        at = end + len(END)


class _Reading:
    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.chars, self.length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, text: str, spans: list[dict]) -> None:
        for role, said in turns_of(text):
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        for s in spans:
            learned = _unescaped(text[s["start"] : s["end"]])
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
            self.chars += len(learned)
        self.length += len(text)

    def result(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.length


def _read(rows: Iterator[tuple]) -> Iterator[tuple]:
    now, reading = None, _Reading()
    for conv, path, _, text, spans in rows:
        if now is not None and (conv, path) != now:
            yield *now, *reading.result()
            reading = _Reading()
        now = (conv, path)
        reading.add(text, spans)
    if now is not None:
        yield *now, *reading.result()


def digest(written: DataFrame) -> DataFrame:
    """What is read back from ``formatted`` conversations, a row for each.

    Pieces of a conversation follow one another in their partition, as ``formatted`` gives them.
    """
    return written.mapInArrow(streamed(_read, DIGEST), DIGEST)


def round_trip(rows: DataFrame) -> DataFrame:
    """``conversations`` rows, formatted and read back."""
    contents = rows.select("conv_id", content_key(F.col("role"), F.col("text")).alias("key"), "role", "text")
    return digest(formatted(linear(rows), contents)).drop("path")
