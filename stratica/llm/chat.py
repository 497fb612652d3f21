"""Chat formatting at the level of tokens.

Every turn is ``<|im_start|>role newline text<|im_end|> newline``.  Role and text are encoded as separate segments and
the two marks are spliced in as reserved ids above the vocabulary, so no text can produce a mark.  Control strings that
stand in a text are escaped reversibly all the same, because the formatted conversation is also read as plain text.
The loss mask covers the texts of assistants; it is the prefix sum of +1 at each of their starts and -1 at each end.

Turns are dealt by ranges of (conversation, turn), so a conversation with a third of all turns is spread over many tasks.
All turns of a batch are encoded together, whatever conversations they belong to, and spliced afterwards.
A conversation is a sequence of blocks of bounded size, one row each; only its digest (a sequential hash by its nature)
streams the blocks of one conversation through one task, holding one block at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.bpe import Encoder, Vocabulary, load_vocabulary, ship
from stratica.llm.common import code_points, map_rows

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: A block ends after so many turns or tokens (one longer turn is a block by itself).
BLOCK_TURNS = 512
BLOCK_TOKENS = 200_000

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash goes between, and where some stand already, one more."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role as one line: backslashes and newlines are written as two characters first."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


class Assembler:
    """Joins turns into ids and masks, and reads them back."""

    def __init__(self, vocabulary: Vocabulary, loss_role: str = ASSISTANT):
        self.vocabulary, self.loss_role = vocabulary, loss_role
        self.encoder = Encoder(vocabulary, None)
        self.start_id, self.end_id = vocabulary.size, vocabulary.size + 1
        self.start, self.end = (np.array([i], "<i4").tobytes() for i in (self.start_id, self.end_id))
        self.newline = self.encoder.encode(["\n"])[0]
        #: Of every id, the bytes of its output that begin a character.
        self.begins = np.array([code_points(b) for b in (*vocabulary.outputs, START.encode(), END.encode())], dtype=np.int64)

    def segments(self, turns: list[tuple[str, str]]) -> list[bytes]:
        """The ids of every turn's role line and text, two for each turn, as bytes: all that are given are encoded together."""
        return self.encoder.encode([s for role, text in turns for s in (escape_role(role) + "\n", escape(text))])

    def assemble(self, roles: list[str], segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask (0/1) of consecutive turns, from their encoded segments."""
        parts = [p for k in range(len(roles)) for p in (self.start, segments[2 * k], segments[2 * k + 1], self.end, self.newline)]
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4)
        ids = np.frombuffer(b"".join(parts), dtype="<i4")
        learned = np.array([role == self.loss_role for role in roles], dtype=bool)
        steps = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(steps, ends[1::5][learned], 1)  # a text begins where its role line ends
        np.add.at(steps, ends[2::5][learned], -1)
        return ids, np.cumsum(steps)[:-1].astype(np.int8)

    def characters(self, ids: np.ndarray) -> int:
        """Code points of the formatted text: its bytes that do not continue a character."""
        return int(self.begins[ids].sum())

    def turns(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str | None]]:
        """Role, text and the text under the loss mask (None where nothing is) of each turn, unescaped, from the ids alone."""
        out = []
        for a, b in zip(np.flatnonzero(ids == self.start_id).tolist(), np.flatnonzero(ids == self.end_id).tolist(), strict=True):
            line, _, text = self.vocabulary.decode(ids[a + 1 : b].tolist()).partition("\n")
            under = ids[a + 1 : b][mask[a + 1 : b] == 1]
            out.append((unescape_role(line), unescape(text), unescape(self.vocabulary.decode(under.tolist())) if len(under) else None))
        return out


_assemblers: dict[tuple[str, str], Assembler] = {}


def load_assembler(vocabulary_name: str, loss_role: str) -> Assembler:
    key = vocabulary_name, loss_role
    if key not in _assemblers:
        _assemblers[key] = Assembler(load_vocabulary(vocabulary_name), loss_role)
    return _assemblers[key]


def format_chats(turns: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = ASSISTANT, block_turns: int = BLOCK_TURNS, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, str]:
    """Blocks of formatted conversations, and the name of the shipped vocabulary for reading them.

    Columns: conv_id, task and block (their order within the conversation), n_turns, ids, mask.  Turns stand by turn
    number, nulls first; rows of one number stand by role and text, repeated rows each count.  Null roles and texts are
    empty; a null conversation id is a conversation of its own.  Other columns are not read.
    """
    with open(tokenizer, "rb") as f:
        name = ship(turns, f.read(), "vocabulary")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("_tie", F.xxhash64("role", "text"))
    order = ["conv_id", "turn", "role", "_tie", "text"]
    dealt = rows.repartitionByRange("conv_id", "turn", "role", "_tie").sortWithinPartitions(*order).select("conv_id", "role", "text")
    kind = dealt.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("task", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.ByteType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from pyspark.sql.pandas.types import to_arrow_type

        assembler, task, number = load_assembler(name, loss_role), TaskContext.get().partitionId(), 0
        roles: list[str] = []
        held: list[bytes] = []
        size, current = 0, None
        done: list[tuple[object, int, int, np.ndarray, np.ndarray]] = []

        def close() -> None:
            nonlocal number, size
            done.append((current, number, len(roles), *assembler.assemble(roles, held)))
            roles.clear()
            held.clear()
            number, size = number + 1, 0

        def emit() -> pa.RecordBatch:
            convs, numbers, turns, ids, masks = zip(*done, strict=True)
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            rows = pa.RecordBatch.from_arrays(
                [pa.array(convs, to_arrow_type(kind)), pa.array([task] * len(done), pa.int32()), pa.array(numbers, pa.int64()), pa.array(turns, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(masks)))],
                names=schema.names,
            )
            done.clear()
            return rows

        for batch in batches:
            turns = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            segments = assembler.segments(turns)
            for k, (conv, (role, _)) in enumerate(zip(batch.column(0).to_pylist(), turns, strict=True)):
                if roles and (conv != current or len(roles) >= block_turns or size >= block_tokens):
                    close()
                current = conv
                roles.append(role)
                held += segments[2 * k : 2 * k + 2]
                size += (len(held[-2]) + len(held[-1])) // 4
            if done:
                yield emit()
        if roles:
            close()
        if done:
            yield emit()

    return map_rows(dealt, run, schema), name


def chat_digests(blocks: DataFrame, vocabulary_name: str, loss_role: str = ASSISTANT) -> DataFrame:
    """One row per conversation, read back from its blocks: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Null and empty roles and texts read back as empty, repeated turns each count, and rows without a conversation id are one
    conversation; without blocks there are no rows.
    """
    kind = blocks.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        assembler = load_assembler(vocabulary_name, loss_role)
        done: list[tuple] = []
        state: list = []

        def close() -> None:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            kinds = (to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            row = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)
            done.clear()
            return row

        for batch in batches:
            ids, masks = batch.column(1), batch.column(2)
            for k, conv in enumerate(batch.column(0).to_pylist()):
                if not state or conv != state[0]:
                    if state:
                        close()
                    state[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own = ids[k].values.to_numpy()
                for role, text, under in assembler.turns(own, masks[k].values.to_numpy()):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                    if under is not None:
                        state[3] += len(under)
                        state[4].update(under.encode("utf-8", "replace"))
                state[5] += assembler.characters(own)
            if len(done) >= 2000:
                yield emit()
        if state:
            close()
        yield emit()

    dealt = blocks.select("conv_id", "task", "block", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "task", "block").select("conv_id", "ids", "mask")
    return map_rows(dealt, run, schema)
