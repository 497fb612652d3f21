"""Byte-level BPE as a monoid: halves are encoded by themselves, and neighbours are joined at their border.

A text is halved until a part has at most ``LEAF`` characters, which the library encodes.  Joining two parts encodes only a
window at their border anew.  The window grows until the tokens outside of it provably stay:

* between a character and one of another kind the pattern always ends a piece (``is_cut`` has the pairs of kinds for which no
  context can change that), and pieces are encoded one by one, so tokens before a cut on the left and behind one on the right
  are those of the whole;
* inside one long piece there are no cuts.  There the window is ``k`` tokens on either side.  If its new first and last
  tokens are the old ones, the outer tokens stay: a sequence of tokens is the encoding of its bytes if and only if every two
  neighbours are the encoding of theirs.  (Merges never split.  The first merge across a border would have the lowest
  rank also when its two tokens' bytes are encoded alone.)  Otherwise ``k`` doubles.

Decoding halves the ids and concatenates the bytes.  Both work row by row in the tasks; nothing is shuffled.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.bpe import ship
from stratica.llm.common import map_rows, texts

#: Characters of a part that is encoded whole; first size of a window of text; first size of one of tokens.
LEAF = 2048
WINDOW = 32
TOKENS = 8
#: Bytes above which a piece is joined by tokens; longer than any token of a vocabulary.
LONG = 1024
#: Characters of one kind that are looked at on either side of such a border.
FAR = 1 << 16
#: Code points with the property White_Space.
SPACES = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@lru_cache(maxsize=100_000)
def kind(char: str) -> str:
    """L, N, S (white space) or O; ``?`` for characters whose category may differ among versions of Unicode."""
    if char in SPACES:
        return "S"
    old, now = unicodedata.ucd_3_2_0.category(char)[0], unicodedata.category(char)[0]
    if old != now or old in "CZ" and char > "\x7f":
        return "?"
    return old if old in "LN" else "O"


def is_cut(before: str, after: str) -> bool:
    """Whether a piece of the pattern always ends between these two characters, whatever stands around them."""
    a, b = kind(before), kind(after)
    if a == "S" or b == "S":
        return a != "S"
    if a == "?" or b == "?" or a == b:
        return False
    return before != "'" or b == "N"


class Ranks:
    """A rank file of the tiktoken library with its pattern, as encoder of leaves and pieces."""

    def __init__(self, spec: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in spec.splitlines() if line.strip())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.outputs = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.outputs[i] = token

    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), dtype=np.uint32)

    def merged(self, piece: bytes) -> np.ndarray:
        """The ids of bytes inside one piece, without the pattern."""
        return np.array(self.library._encode_single_piece(piece), dtype=np.uint32)

    def tokens_of(self, ids: np.ndarray, size: int, from_end: bool) -> int | None:
        """How many tokens at one end have ``size`` bytes together; None if none does."""
        n = 0
        for i in reversed(ids) if from_end else ids:
            if size <= 0:
                break
            size -= len(self.outputs[i])
            n += 1
        return n if size == 0 else None


def last_cut(text: str, start: int) -> int | None:
    """The last place in ``text`` at ``start`` or later where a piece always ends."""
    for at in range(len(text) - 1, max(start, 1) - 1, -1):
        if is_cut(text[at - 1], text[at]):
            return at
    return None


def first_cut(text: str, end: int) -> int | None:
    """The first such place at ``end`` or before."""
    for at in range(1, min(end, len(text) - 1) + 1):
        if is_cut(text[at - 1], text[at]):
            return at
    return None


def run_at_end(text: str, most: int) -> int:
    """Characters of one kind at the end, as far as ``most``."""
    own, n = kind(text[-1]), 1
    while n < min(len(text), most) and kind(text[-1 - n]) == own:
        n += 1
    return n


def run_at_start(text: str, most: int) -> int:
    own, n = kind(text[0]), 1
    while n < min(len(text), most) and kind(text[n]) == own:
        n += 1
    return n


class Tree:
    """Encodes and decodes whole texts with one rank file."""

    def __init__(self, ranks: Ranks, leaf: int = LEAF):
        self.ranks, self.size = ranks, max(1, leaf)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text, as the library's ``encode_ordinary`` gives them."""
        if len(text) <= self.size:
            return self.ranks.leaf(text)
        half = len(text) // 2
        return self.join(text[:half], self.encode(text[:half]), text[half:], self.encode(text[half:]))

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Ids of ``left + right`` from those of both."""
        window, n_left, n_right = WINDOW, len(left), len(right)
        p = q = None
        while True:
            if p is None:
                p = 0 if window >= n_left and last_cut(left, 1) is None else last_cut(left, n_left - window)
            if q is None:
                q = n_right if window >= n_right and first_cut(right, n_right) is None else first_cut(right, window)
            if p is not None and q is not None:
                return self._between(left, a, p, right, b, q)
            if window >= LONG and (found := self._inside(left, a, right, b)) is not None:
                return found
            window *= 2

    def _between(self, left: str, a: np.ndarray, p: int, right: str, b: np.ndarray, q: int) -> np.ndarray:
        """The window runs from the cut ``p`` of the left part to the cut ``q`` of the right one."""
        before = self.ranks.tokens_of(a, len(left[p:].encode()), from_end=True)
        behind = self.ranks.tokens_of(b, len(right[:q].encode()), from_end=False)
        assert before is not None and behind is not None  # pieces end at cuts, and so do tokens
        return np.concatenate([a[: len(a) - before], self.ranks.leaf(left[p:] + right[:q]), b[behind:]])

    def _inside(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray | None:
        """Both sides of the border lie in one long piece: a window of tokens; None if that is not so or none is found."""
        own = kind(left[-1])
        if own == "?" or kind(right[0]) != own:
            return None
        before, behind = run_at_end(left, FAR), run_at_start(right, FAR) - (own == "S")
        if min(before, behind) <= 4:  # contractions are shorter
            return None
        room_left, room_right = len(left[-before:].encode()), len(right[:behind].encode())
        k = TOKENS
        while True:
            some = [self.ranks.outputs[i] for i in a[-k:]], [self.ranks.outputs[i] for i in b[:k]]
            sizes = [sum(map(len, x)) for x in some]
            if sizes[0] > room_left or sizes[1] > room_right:
                return None
            fresh = self.ranks.merged(b"".join([*some[0], *some[1]]))
            whole = len(some[0]) == len(a), len(some[1]) == len(b)  # no token outside on that side
            if (whole[0] or fresh[0] == a[-len(some[0])]) and (whole[1] or fresh[-1] == b[len(some[1]) - 1]):
                return np.concatenate([a[: len(a) - len(some[0])], fresh, b[len(some[1]) :]])
            k *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; ids outside the vocabulary have none."""
        if len(ids) > self.size:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        outputs, n = self.ranks.outputs, len(self.ranks.outputs)
        return b"".join([outputs[i] for i in ids.tolist() if 0 <= i < n])


@lru_cache(maxsize=2)
def load_tree(name: str, pattern: str, leaf: int) -> Tree:
    with open(SparkFiles.get(name), "rb") as f:
        return Tree(Ranks(f.read(), pattern), leaf)


class TreeCodec:
    """A rank file that the driver can read (``ranks``: its path), shipped to the executors, with the pattern that cuts texts."""

    def __init__(self, docs: DataFrame, ranks: str, pattern: str, leaf: int = LEAF):
        with open(ranks, "rb") as f:
            self.name = ship(docs, f.read(), "ranks")
        self.pattern, self.leaf = pattern, leaf

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Id and ``ids`` (array of int) of every row; a null or empty text has none.

        Special tokens are ordinary text.  Repeated rows are repeated; other columns are not read.
        """
        schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
        spec = self.name, self.pattern, self.leaf

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = load_tree(*spec)
            for rows in batches:
                ids = [tree.encode(t.decode("utf-8", "replace")) for t in texts(rows.column(1))]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).view(np.int32)))], names=schema.names)

        return map_rows(docs.select(id_col, F.col(text_col).cast("string")), run, schema)

    def decode(self, encoded: DataFrame, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
        """``encoded`` with the bytes of its ids in the column ``into``, in place of one of that name; null ids have none."""
        schema = T.StructType([*[f for f in encoded.schema.fields if f.name != into], T.StructField(into, T.BinaryType())])
        spec, carried = (self.name, self.pattern, self.leaf), [c for c in encoded.columns if c != into]
        at = carried.index(ids_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = load_tree(*spec)
            for rows in batches:
                ids = rows.column(at)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([tree.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in ids], pa.binary())], names=schema.names)

        return map_rows(encoded.select(*carried), run, schema)

    def round_trip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Both in one pass: id, ``n_tokens``, ``packed`` (ids as little-endian unsigned 32-bit integers) and ``decoded`` (bytes)."""
        schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("packed", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
        spec = self.name, self.pattern, self.leaf

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = load_tree(*spec)
            for rows in batches:
                ids = [tree.encode(t.decode("utf-8", "replace")) for t in texts(rows.column(1))]
                columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([tree.decode(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=schema.names)

        return map_rows(docs.select(id_col, F.col(text_col).cast("string")), run, schema)
