"""Chat formatting into prefix trees: turns that conversations share at their start are emitted once, as token ids.

Conversations are sorted by the digests of their turns, so those with a common start are neighbours and a walk over
them is a depth-first walk of the prefix tree. Each task walks its range and emits blocks of bounded size. A block
holds the tokens of its nodes in depth-first order, each with its position id (the number of tokens before it on its
path); a node is one formatted turn with its parent, its place in the tokens, the intervals of tokens it attends to
(its ancestors and itself) and the interval under the loss. A conversation is its last node. Where a block or a task
ends within a tree, the next block emits the shared start again, which bounds memory; equal conversations are ranged
by their id as well, so a tree or a conversation that many share is split over tasks.

The template marks turns by control strings, and a backslash inside each control string (and before each backslash)
of a text keeps texts apart from marks; reading back undoes that. Marks, header and text of a turn are encoded one by
one with a byte-level vocabulary, so the loss covers whole tokens, and the tokens give back every byte.

Defined results: a null text or role is empty; rows of a conversation are ordered by turn, nulls first, then role and
text, and repeated rows are repeated turns; a null conv_id is one conversation; no rows give no blocks; further
columns are ignored. A conversation is held whole by one task; its size bounds what a task needs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import narrow_batches

# The marks of this template, and those of other templates that texts should not be able to imitate.
OPEN, CLOSE = "<s>", "</s>"
CONTROL = (OPEN, CLOSE, "[INST]", "[/INST]")
LOSS_ROLES = ("assistant",)
BLOCK_TOKENS = 1 << 18

INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ARROW = pa.schema(
    [
        ("block_id", pa.int64()),
        ("tokens", pa.list_(pa.int32())),
        ("position_ids", pa.list_(pa.int32())),
        ("parents", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("attends", pa.list_(INTERVALS)),
        ("losses", INTERVALS),
        ("conv_ids", pa.list_(pa.int64())),
        ("leaves", pa.list_(pa.int32())),
    ]
)
SCHEMA = (
    "block_id long, tokens array<int>, position_ids array<int>, parents array<int>, starts array<long>, lengths array<long>,"
    " attends array<array<struct<start: long, end: long>>>, losses array<struct<start: long, end: long>>,"
    " conv_ids array<long>, leaves array<int>"
)
READ_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    """A text that holds no control string and from which :func:`unescape` gives the text back."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


class Codec:
    """Token ids of texts and back, by a byte-level vocabulary file of ranks; one per worker process and file."""

    _made: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}
        self.whole = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.whole.encode_ordinary(x) for x in texts]

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode_bytes(ids).decode()


def turn_parts(role: str, text: str) -> list[str]:
    """The formatted turn in three parts: mark and role, text, mark."""
    return [f"{OPEN}{escape_role(role)}\n", escape(text), CLOSE]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        end = formatted.index(CLOSE, at)
        role, _, text = formatted[at + len(OPEN) : end].partition("\n")
        turns.append((unescape_role(role), unescape(text)))
        at = end + len(CLOSE)
    return turns


class Block:
    """A prefix tree under construction, fed with conversations in sorted order."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.tokens: list[int] = []
        self.position_ids: list[int] = []
        self.nodes: list[tuple] = []
        self.convs: list[tuple] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        for (turn, _), new in zip(self.path, turns, strict=False):
            if turn != new:
                break
            shared += 1
        del self.path[shared:]
        own = turns[shared:]
        encoded = self.codec.encode([part for turn in own for part in turn_parts(*turn)])
        for k, (role, text) in enumerate(own):
            head, body, tail = encoded[3 * k : 3 * k + 3]
            start, length = len(self.tokens), len(head) + len(body) + len(tail)
            parent = self.path[-1][1] if self.path else -1
            attends: list[tuple[int, int]] = []
            position = 0
            if parent >= 0:
                attends = list(self.nodes[parent][3])
                position = sum(b - a for a, b in attends)
            if attends and attends[-1][1] == start:
                attends[-1] = (attends[-1][0], start + length)
            else:
                attends.append((start, start + length))
            loss = (start + len(head), start + len(head) + len(body)) if role in LOSS_ROLES else None
            self.nodes.append((parent, start, length, attends, loss))
            self.tokens += head + body + tail
            self.position_ids += range(position, position + length)
            self.path.append(((role, text), len(self.nodes) - 1))
        self.convs.append((conv_id, self.path[-1][1] if self.path else -1))

    def row(self, block_id: int) -> pa.RecordBatch:
        spans = lambda xs: [{"start": a, "end": b} for a, b in xs]
        columns = [*zip(*self.nodes, strict=True)] or [[]] * 5
        losses = [x and {"start": x[0], "end": x[1]} for x in columns[4]]
        ids, leaves = zip(*self.convs, strict=True)
        values = [block_id, self.tokens, self.position_ids, *columns[:3], [spans(x) for x in columns[3]], losses, ids, leaves]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(values, ARROW, strict=True)], schema=ARROW
        )


def format_trees(conversations: DataFrame, vocabulary: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of prefix trees over rows (conv_id, turn, role, text), in the tokens of a byte-level vocabulary file."""
    narrow_batches(conversations.sparkSession, 512)
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    turns = (
        conversations.select("conv_id", "turn", role, text)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .withColumn("path", F.expr("transform(turns, t -> substr(sha2(concat(t.role, '\\n', t.text), 256), 1, 16))"))
        .withColumn("path", F.array_join("path", ""))
        .repartitionByRange("path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
    )

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = Codec.of(vocabulary)
        block, block_id = Block(codec), TaskContext.get().partitionId() << 36
        for batch in batches:
            for conv_id, rows in zip(batch.column("conv_id"), batch.column("turns"), strict=True):
                block.add(conv_id.as_py(), [(t["role"], t["text"]) for t in rows.as_py()])
                if len(block.tokens) >= block_tokens:
                    yield block.row(block_id)
                    block, block_id = Block(codec), block_id + 1
        if block.convs:
            yield block.row(block_id)

    return turns.select("conv_id", F.expr("transform(turns, t -> struct(t.role as role, t.text as text))").alias("turns")).mapInArrow(of_task, SCHEMA)


def read_conversations(blocks: DataFrame, vocabulary: str) -> DataFrame:
    """Every conversation as the blocks hold it: turns and loss text by their digests."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def of_block(block: dict) -> Iterator[tuple]:
        codec, tokens = Codec.of(vocabulary), block["tokens"]
        node = [codec.decode(tokens[a : a + n]) for a, n in zip(block["starts"], block["lengths"], strict=True)]
        masks = [unescape(codec.decode(tokens[m["start"] : m["end"]])) if m else None for m in block["losses"]]
        for conv_id, leaf in zip(block["conv_ids"], block["leaves"], strict=True):
            path = []
            while leaf >= 0:
                path.append(leaf)
                leaf = block["parents"][leaf]
            path.reverse()
            whole = "".join(node[i] for i in path)
            loss = "".join(masks[i] for i in path if masks[i] is not None)
            turns = parse(whole)
            yield conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [*of_block({n: batch.column(n)[i].as_py() for n in batch.schema.names})]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(of_task, READ_SCHEMA)
