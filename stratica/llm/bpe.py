"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words are counted over all documents, encoded once, and compiled into a shared-suffix transducer
(``transducer.py``) that is shipped to the executors as a file and memory-mapped by their Python workers.  A text is
cut into pieces by the vocabulary's pattern; pieces in the lexicon get its id outputs, all others are merged exactly
by the ranks of the vocabulary.  So the size of the lexicon changes the speed and never an id.

Encoding and decoding are row-local.  The only shuffle is the word count (partial sums per task, then one sum).
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.common import drop_stored, map_rows, most_frequent, shared_file, stored, texts
from stratica.llm.transducer import Lexicon, compile_lexicon

#: Code points with the Unicode property White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LEXICON_WORDS = 60_000
LONGEST_WORD = 48
#: Encoded chunks that a Python worker keeps; later ones are encoded anew each time they occur.
KEPT_CHUNKS = 150_000
#: Punctuation after letters that is a piece by itself.
PLAIN_ENDS = tuple(".,;:!?")
#: Bits of an id in a packed pair; the rank of a pair that never merges.
PAIR = 32
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte: itself where printable, else 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """The merge ranks as an open-addressed table for lookups of whole arrays of pairs."""

    BITS = 18
    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[int, int], made: list[int], byte_ids: list[int]):
        self.bits = max(self.BITS, (3 * len(ranks)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, self.none, dtype=np.int32)
        self.made, self.byte_ids = np.array(made or [0], dtype=np.int32), np.array(byte_ids, dtype=np.int32)
        waiting = np.fromiter(ranks, dtype=np.int64, count=len(ranks))
        values = np.fromiter(ranks.values(), dtype=np.int32, count=len(ranks))
        slots = self.slots(waiting)
        while len(waiting):  # one key a slot; the others go on to the next
            free = np.flatnonzero(self.keys[slots] < 0)
            taken, first = np.unique(slots[free], return_index=True)
            own = free[first]
            self.keys[taken], self.ranks[taken] = waiting[own], values[own]
            rest = np.ones(len(waiting), dtype=bool)
            rest[own] = False
            waiting, values, slots = waiting[rest], values[rest], (slots[rest] + 1) & (len(self.keys) - 1)

    #: Rank of a pair that never merges.
    none = np.iinfo(np.int32).max

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair of ids."""
        keys = (left.astype(np.int64) << PAIR) | right
        slots = self.slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.ranks[slots], self.none)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.ranks[slots[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out

    def merge(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        """Ids of pieces of 1 to ``width`` bytes, each as bytes."""
        n = len(pieces)
        flat = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(n, width)
        ids = self.byte_ids[flat]
        ranks = np.full((n, width), self.none, dtype=np.int32)  # of each place with the next; the last has none
        inside = np.arange(width - 1)[None, :] < (sizes - 1)[:, None]
        ranks[:, :-1][inside] = self.find(ids[:, :-1][inside], ids[:, 1:][inside])
        size, rows, places = sizes.copy(), np.arange(n), np.arange(width)
        while len(rows):
            at = ranks[rows].argmin(axis=1)
            best = ranks[rows, at]
            going = best < self.none
            rows, at, best = rows[going], at[going], best[going]
            if not len(rows):
                break
            shift = np.minimum(places + (places > at[:, None]), width - 1)
            ids[rows] = np.take_along_axis(ids[rows], shift, axis=1)
            moved = np.take_along_axis(ranks[rows], shift, axis=1)
            moved[:, -1] = self.none
            ids[rows, at] = self.made[best]
            size[rows] -= 1
            last = at >= size[rows] - 1
            moved[np.arange(len(rows)), at] = np.where(last, self.none, self.find(ids[rows, at], ids[rows, np.minimum(at + 1, width - 1)]))
            before = np.flatnonzero(at > 0)
            moved[before, at[before] - 1] = self.find(ids[rows[before], at[before] - 1], ids[rows[before], at[before]])
            ranks[rows] = moved
        tape = ids[places < size[:, None]].astype("<u4").tobytes()
        ends = (np.cumsum(size) * 4).tolist()
        return [tape[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: str):
        import regex

        data = json.loads(spec)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.ids = {as_bytes(t): i for t, i in data["model"]["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.byte_ids = [self.ids.get(bytes([b]), -1) for b in range(256)]
        #: Rank of a pair of ids (packed in one integer), and the id that each rank makes.
        self.ranks = {(self.ids[as_bytes(a)] << PAIR) | self.ids[as_bytes(b)]: r for r, (a, b) in enumerate(pairs)}
        self.made = [self.ids[as_bytes(a) + as_bytes(b)] for a, b in pairs]
        self.pairs = PairTable(self.ranks, self.made, self.byte_ids)
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.outputs = [b""] * self.size
        for token, i in [*self.ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.outputs[i] = token
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+")
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece by its merges: always the pair of lowest rank, the leftmost first."""
        byte_ids, get, made = self.byte_ids, self.ranks.get, self.made
        parts = [byte_ids[b] for b in piece]
        if len(parts) > 96:
            return self._merge_long(parts)
        ranks = [get((a << PAIR) | b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            parts[at : at + 2] = (made[best],)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get((parts[at] << PAIR) | parts[at + 1], NEVER)
            if at:
                ranks[at - 1] = get((parts[at - 1] << PAIR) | parts[at], NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, for pieces of any length."""
        n, get = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i] << PAIR) | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.made[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := get((parts[left] << PAIR) | parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` for many pieces at once, as bytes of unsigned 32-bit integers: one merge in every piece a step."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out: list[bytes] = [b""] * len(pieces)
        low = 0
        for high in (8, 16, 32):  # pieces of like length together
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for at in range(0, len(some), 8192):
                part = some[at : at + 8192]
                for k, ids in zip(part.tolist(), self.pairs.merge([pieces[k] for k in part.tolist()], sizes[part], high), strict=True):
                    out[k] = ids
        for k in np.flatnonzero(sizes > low).tolist():
            out[k] = array.array("I", self.merge(pieces[k])).tobytes()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; ids outside the vocabulary have none, and broken UTF-8 becomes U+FFFD."""
        if ids and (min(ids) < 0 or max(ids) >= self.size):
            ids = [i for i in ids if 0 <= i < self.size]
        return b"".join(map(self.outputs.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Encodes texts with a lexicon for frequent pieces and exact merges for the rest."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.kept: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str]:
        return self.vocabulary.chunks.findall(text)

    def _cut(self, text: str) -> list[tuple[list[str], int | None]]:
        """Runs of ordinary chunks, each followed by a special id or the end."""
        if self.vocabulary.specials is None or not any(s in text for s in self.vocabulary.special):
            return [(self._chunks(text), None)]
        out, at = [], 0
        for hit in self.vocabulary.specials.finditer(text):
            out.append((self._chunks(text[at : hit.start()]), self.vocabulary.special[hit.group()]))
            at = hit.end()
        return [*out, (self._chunks(text[at:]), None)]

    def _pieces(self, chunk: str) -> list[bytes]:
        """The pattern's pieces of a chunk; letters alone, or before one mark of punctuation, need no pattern."""
        start = chunk[:1] == " "
        if chunk[start:].isalpha():
            return [chunk.encode()]
        if chunk[-1:] in PLAIN_ENDS and chunk[start:-1].isalpha():
            return [chunk[:-1].encode(), chunk[-1:].encode()]
        return [p.encode("utf-8", "surrogatepass") for p in self.vocabulary.pieces.findall(chunk)]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of chunks not yet kept, as bytes of unsigned 32-bit integers."""
        order = list(chunks)
        pieces = [self._pieces(c) for c in order]
        distinct = list({p for row in pieces for p in row})
        known = self.lexicon.outputs_of(distinct) if self.lexicon is not None else [None] * len(distinct)
        ids = dict(zip(distinct, known, strict=True))
        unseen = [p for p, k in ids.items() if k is None]
        ids.update(zip(unseen, self.vocabulary.merge_many(unseen), strict=True))
        return {c: ids[row[0]] if len(row) == 1 else b"".join([ids[p] for p in row]) for c, row in zip(order, pieces, strict=True)}

    def encode(self, many: list[str]) -> list[bytes]:
        cut = [self._cut(text) for text in many]
        missing = set().union(*[chunks for runs in cut for chunks, _ in runs]) - self.kept.keys()
        fresh = self._learn(missing)
        room = max(0, KEPT_CHUNKS - len(self.kept))
        self.kept.update(fresh)
        get = self.kept.__getitem__
        out = []
        for runs in cut:
            parts = [b"".join(map(get, chunks)) + (b"" if end is None else np.uint32(end).tobytes()) for chunks, end in runs]
            out.append(parts[0] if len(parts) == 1 else b"".join(parts))
        for chunk in list(fresh)[room:]:
            del self.kept[chunk]
        return out


def frequent_words(docs: DataFrame, text_col: str, size: int, flush: int = 400_000) -> list[bytes]:
    """At most ``size`` words, the most frequent blank-separated ones of all rows; each task sums what it reads first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def sums() -> Iterator[pa.RecordBatch]:
            rows = [(w, n) for w, n in counts.items() if len(w) <= LONGEST_WORD]
            counts.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

        for rows in batches:
            for text in texts(rows.column(0)):
                counts.update(text.split())
                if len(counts) >= flush:
                    yield from sums()
        yield from sums()

    counted = map_rows(docs.select(F.col(text_col).cast("string")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = stored(counted, "word-counts")
    found = [word for word, _ in most_frequent(kept, size)]
    drop_stored(kept)
    return found


def build_lexicon(vocabulary: Vocabulary, words: list[bytes]) -> bytes:
    """The lexicon image of the words' pieces, with and without a blank before the word."""
    pieces = {p.encode("utf-8") for w in words for t in (w.decode("utf-8", "ignore"),) for v in (t, " " + t) for p in vocabulary.pieces.findall(v)}
    return compile_lexicon({p: vocabulary.merge(p) for p in pieces})


@lru_cache(maxsize=2)
def load_vocabulary(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Vocabulary(f.read())


@lru_cache(maxsize=1)
def load_encoder(vocabulary_name: str, lexicon_name: str | None) -> Encoder:
    return Encoder(load_vocabulary(vocabulary_name), Lexicon(SparkFiles.get(lexicon_name)) if lexicon_name else None)


def ship(docs: DataFrame, content: bytes, kind: str) -> str:
    """Send a file to all executors, present and future, under a name made of its content."""
    name = f"{kind}-{hashlib.sha256(content).hexdigest()[:24]}"
    context = docs.sparkSession.sparkContext
    if any(file.rsplit("/", 1)[-1] == name for file in context.listFiles):
        return name
    context.addFile(shared_file(docs.sparkSession, name, content))
    return name


class Codec:
    """A vocabulary and a lexicon, shipped to the executors.

    ``tokenizer`` is the path of a byte-level BPE file (tokenizers library's JSON) that the driver can read.
    """

    def __init__(self, docs: DataFrame, tokenizer: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS):
        with open(tokenizer, "rb") as f:
            spec = f.read()
        vocabulary = Vocabulary(spec.decode("utf-8"))
        words = frequent_words(docs, text_col, lexicon_words) if lexicon_words else []
        self.vocabulary_name = ship(docs, spec, "vocabulary")
        self.lexicon_name = ship(docs, build_lexicon(vocabulary, words), "lexicon")

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Id and ``ids`` (array of int) of every row; a null or empty text has no ids.

        Special tokens' strings inside a text are read as those tokens, as the library does by default.  Repeated
        rows are repeated; other columns are not read.
        """
        return self._encode(docs, id_col, text_col, decoded=False)

    def round_trip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``encode`` and ``decode`` in one pass: id, ``ids`` and ``decoded`` (the text of the ids)."""
        return self._encode(docs, id_col, text_col, decoded=True)

    def _encode(self, docs: DataFrame, id_col: str, text_col: str, decoded: bool) -> DataFrame:
        schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *([T.StructField("decoded", T.StringType())] if decoded else [])])
        names = self.vocabulary_name, self.lexicon_name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = load_encoder(*names)
            for rows in batches:
                ids = encoder.encode([t.decode("utf-8", "replace") for t in texts(rows.column(1))])
                ends = np.cumsum([0, *(len(b) // 4 for b in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                columns = [rows.column(0), pa.ListArray.from_arrays(pa.array(ends), values)]
                if decoded:
                    columns.append(pa.array([encoder.vocabulary.decode(np.frombuffer(b, dtype="<i4").tolist()) for b in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return map_rows(docs.select(id_col, F.col(text_col).cast("string")), run, schema)

    def decode(self, encoded: DataFrame, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
        """``encoded`` with the text of its ids in the column ``into``, in place of one of that name; null ids give the empty text."""
        schema = T.StructType([*[f for f in encoded.schema.fields if f.name != into], T.StructField(into, T.StringType())])
        name, carried = self.vocabulary_name, [c for c in encoded.columns if c != into]
        at = carried.index(ids_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            decode = load_vocabulary(name).decode
            for rows in batches:
                ids = rows.column(at)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([decode(ids[k].values.to_numpy().tolist()) if ids[k].is_valid else "" for k in range(len(ids))], pa.string())], names=schema.names)

        return map_rows(encoded.select(*carried), run, schema)
