"""Chat formatting over a prefix tree of conversations.

Conversations in the order of their turns' digests meet in depth-first order of
their prefix tree: a conversation shares with the one before it exactly the
turns of their longest common prefix. So a range-partitioned sort is the tree,
and one pass over a partition writes each shared turn once, with position ids
and the intervals of its ancestors that it may attend to. The pass keeps one
path of digests and offsets, whatever a tree or a conversation holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.shared import materialize

START, STOP = "<|im_start|>", "<|im_end|>"
#: Turns whose digests each row carries; longer conversations are ordered by all of theirs beforehand.
KEY_TURNS = 32
#: Ids of longer conversations that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 250_000
SEGMENT = (
    "conv_id long, seq_id string, node int, parent int, role string, start long, stop long, position long, loss_start long, "
    "loss_stop long, text string, attends array<struct<start:long,stop:long>>, last boolean"
)


def escape(text: str) -> str:
    """No control string is left: every run of | after < grows by one."""
    return re.sub(r"<(\|+)", r"<|\1", text)


def unescape(text: str) -> str:
    return re.sub(r"<\|(\|+)", r"<\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where the loss mask starts and stops in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{STOP}\n", *loss


def _digest(role: str, text: str, before: bytes) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), key=before, digest_size=8).digest()


def whole_paths(chats: DataFrame) -> DataFrame:
    """(conv_id, path): the digests of all turns of each conversation, one after the other."""

    def path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, digest, parts = None, b"", []
        for b in batches:
            out = []
            for c, role, text in zip(b["conv_id"], b["role"], b["text"], strict=True):
                if c != conv:
                    if parts:
                        out.append((conv, b"".join(parts)))
                    conv, digest, parts = c, b"", []
                digest = _digest(role if isinstance(role, str) else "", text if isinstance(text, str) else "", digest)
                parts.append(digest)
            yield pd.DataFrame(out, columns=["conv_id", "path"])
        if parts:
            yield pd.DataFrame([(conv, b"".join(parts))], columns=["conv_id", "path"])

    return chats.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(path, "conv_id long, path binary")


def ranked(chats: DataFrame, key_turns: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``chats`` with ``deep``, the place of a conversation of more than ``key_turns`` turns among all such in path order.

    One row of such a conversation, with eight bytes a turn, is sorted; others
    have 0. A single conversation without an id is not ranked.
    """
    long = materialize(chats.where("conv_id is not null").groupBy(F.col("conv_id").alias("k")).count().where(F.col("count") > key_turns).select("k"))
    n = long.count()
    if not n:
        return chats.withColumn("deep", F.lit(0).cast("long"))
    near = F.broadcast if n <= broadcast_rows else (lambda df: df)
    paths = whole_paths(chats.join(near(long), chats["conv_id"] == long["k"], "left_semi"))
    order = materialize(
        paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select(F.col("conv_id").alias("k"), (F.monotonically_increasing_id() + 1).alias("deep"))
    )
    return chats.join(near(order), chats["conv_id"] == order["k"], "left").drop("k").withColumn("deep", F.coalesce("deep", F.lit(0).cast("long")))


def keyed(chats: DataFrame, key_turns: int = KEY_TURNS) -> DataFrame:
    """Rows with their conversation's tree key and their turn's place, conversation by conversation.

    The key is the path of the first ``key_turns`` turns and, beyond them, the
    conversation's rank. Only so many turns of one conversation wait in memory at a time.
    """

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "conv_id", "place", "role", "text", "deep"]
        held: list[tuple] = []
        conv, digest, path, n, tree = object(), b"", b"", 0, None
        for b in batches:
            out: list[tuple] = []
            for c, role, text, deep in zip(b["conv_id"], b["role"], b["text"], b["deep"], strict=True):
                c = None if c is None else int(c)
                role, text = role if isinstance(role, str) else "", text if isinstance(text, str) else ""
                if c != conv:
                    out += [(path, *x) for x in held]
                    held, conv, digest, path, n, tree = [], c, b"", b"", 0, None
                if tree is None:
                    digest = _digest(role, text, digest)
                    path += digest
                    held.append((c, n, role, text, deep))
                    if len(held) == key_turns:
                        out += [(path, *x) for x in held]
                        held, tree = [], path
                else:
                    out.append((tree, c, n, role, text, deep))
                n += 1
            yield pd.DataFrame(out, columns=names, dtype=object)
        yield pd.DataFrame([(path, *x) for x in held], columns=names, dtype=object)

    rows = ranked(chats.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"), key_turns)
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .withColumn("conv_id", F.col("conv_id").cast("string"))  # pandas would turn whole numbers beside nulls into floats
        .mapInPandas(key, "path binary, conv_id long, place long, role string, text string, deep long")
    )


def format_chats(chats: DataFrame, key_turns: int = KEY_TURNS, max_sequence: int | None = None) -> DataFrame:
    """Segments of depth-first sequences, one a tree node, from ``chats(conv_id, turn, role, text)``.

    ``start`` and ``stop`` are the node's places in its sequence, ``position``
    the position id of its first character (ids go on along a path, so siblings
    repeat them), ``attends`` the intervals of its ancestors, ``loss_*`` the loss
    mask. A row with a null text and role and ``last`` ends a conversation at
    ``parent``. Positions and places count characters: the text goes on to a
    tokenizer of the caller's choice. Rows go by turn, ties by role and text; null text or role is
    empty; a null conv_id is a conversation, streamed by one task; repeated rows
    are turns of their own; conversations and texts have any length; an empty
    table gives no segments; other columns are not read.

    A shared turn is written once in a range partition; a path that goes on over
    its border is written again after it. With ``max_sequence`` a sequence ends
    after the conversation that takes it beyond so many characters, and paths
    that go on are written again as well; there is no such end by default.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in re.sub(r"<.*?>+", "", SEGMENT).split(", ")]
        stack: list[tuple[bytes, int, int, int, int]] = []  # digest, node, start, stop, next position
        conv, depth, node, at, seq, matching, began = object(), 0, 0, 0, "", True, False

        def attends(d: int) -> list[dict[str, int]]:
            out: list[dict[str, int]] = []
            for _, _, a, b, _ in stack[:d]:
                if out and out[-1]["stop"] == a:
                    out[-1]["stop"] = b
                else:
                    out.append({"start": a, "stop": b})
            return out

        def end(d: int) -> tuple:
            del stack[d:]
            return (conv, seq, None, stack[-1][1] if stack else -1, None, None, None, None, None, None, None, None, True)

        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                c = None if c is None else int(c)
                if c != conv or not began:
                    if began:
                        out.append(end(depth))
                    if max_sequence is not None and at > max_sequence:
                        stack.clear()
                    conv, depth, matching, began = c, 0, True, True
                digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                if matching and depth < len(stack) and stack[depth][0] == digest:
                    depth += 1
                    continue
                matching = False
                del stack[depth:]
                if not stack:  # a new root is a new tree
                    seq, node, at = hashlib.blake2b(f"{c}:{digest}".encode(), digest_size=8).hexdigest(), 0, 0
                formatted, lo, hi = turn_text(role, text)
                position = stack[-1][4] if stack else 0
                out.append((c, seq, node, stack[-1][1] if stack else -1, role, at, at + len(formatted), position, lo, hi, formatted, attends(depth), False))
                stack.append((digest, node, at, at + len(formatted), position + len(formatted)))
                at, node, depth = at + len(formatted), node + 1, depth + 1
            yield pd.DataFrame(out, columns=names, dtype=object)
        if began:
            yield pd.DataFrame([end(depth)], columns=names, dtype=object)

    rows = keyed(chats, key_turns).repartitionByRange("path", "deep", "conv_id").sortWithinPartitions("path", "deep", "conv_id", "place").drop("deep")
    return rows.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(emit, SEGMENT)


TURN = re.compile(re.escape(START) + r"((?:(?!<\|[^|]).)*?)\n(.*)" + re.escape(STOP) + "\n", re.S)


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted sequences hold, conversation by conversation, in the order of ``format_chats``.

    Reads the text and the loss mask of the segments only. One digest state a
    node of the current path is kept, so no text is held.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path: dict[int, tuple] = {}
        seq = None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.seq_id != seq:
                    seq, path = r.seq_id, {-1: (0, hashlib.sha256(), 0, hashlib.sha256(), 0, -1)}
                n, turns, loss_n, loss, chars, _ = path[int(r.parent)]
                if r.last:
                    conv = None if r.conv_id is None else int(r.conv_id)
                    out.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))
                    continue
                while path and next(reversed(path)) != int(r.parent):
                    path.popitem()
                m = TURN.fullmatch(r.text)
                turns, loss = turns.copy(), loss.copy()
                turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                learnt = unescape(r.text[int(r.loss_start) : int(r.loss_stop)])
                loss.update(learnt.encode())
                path[int(r.node)] = (n + 1, turns, loss_n + len(learnt), loss, chars + len(r.text), int(r.parent))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], dtype=object)

    return segments.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = f"{STOP}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(chats.unionByName(extra)))
