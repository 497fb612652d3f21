"""License scans by fuzzy short-notice search.

Each short notice may differ from the text by a bounded number of edits.  A notice with bound k is split into
k + 1 pieces: k edits cannot touch all of them, so one piece occurs exactly (the pigeonhole principle).  One
Aho-Corasick pass over the text finds all pieces of all notices; only the windows around such seeds are verified
with the regex library's bounded-error matching, which also gives the span and the edit counts.

Rows are independent: no shuffle, no state between rows, so any hot source or very long text stays one row's work.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratica.llm.common import ALNUM, arrow_ddl, ascii_lower, batch, map_rows, texts


@dataclass(frozen=True)
class Notice:
    """A phrase of lower-case words, its label, the number of character edits allowed (0: exact), and words that must stand as they are.

    ``exact`` are the words by which one notice differs from another: edits may not turn them into each other.
    """

    label: str
    phrase: str
    edits: int = 0
    exact: tuple[str, ...] = ()


#: The exact phrases of the base scan.
BASE = (
    Notice("cc-by", "cc by"),
    Notice("gpl", "general public license"),
    Notice("reserved", "all rights reserved"),
)

#: Opening sentences of common public notices, with the edits allowed in each and the words that tell them apart.
NOTICES = (
    Notice("agpl", "gnu affero general public license", 3, ("affero",)),
    Notice("apache-2.0", "licensed under the apache license", 3, ("apache",)),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("bsd", "released under the bsd license", 3, ("bsd",)),
    Notice("cc-by", "licensed under cc by", 2, ("cc", "by")),
    Notice("cc-by", "creative commons attribution", 3, ("attribution",)),
    Notice("cc-by-nc", "licensed under cc by nc", 2, ("cc", "by", "nc")),
    Notice("cc-by-nd", "licensed under cc by nd", 2, ("cc", "by", "nd")),
    Notice("cc-by-sa", "licensed under cc by sa", 2, ("cc", "by", "sa")),
    Notice("cc0", "creative commons zero", 2, ("zero",)),
    Notice("copyright", "copyright notice and this permission notice", 4),
    Notice("gpl", "gnu general public license", 3, ("gnu",)),
    Notice("gpl", "released under the gpl license", 3, ("gpl",)),
    Notice("isc", "released under the isc license", 3, ("isc",)),
    Notice("lgpl", "gnu lesser general public license", 3, ("lesser",)),
    Notice("mit", "released under the mit license", 3, ("mit",)),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("mpl-2.0", "mozilla public license", 2, ("mozilla",)),
    Notice("proprietary", "unauthorized copying of this file", 3),
    Notice("reserved", "all rights reserved", 2),
    Notice("spdx", "spdx license identifier", 2, ("spdx",)),
    Notice("unlicense", "released into the public domain", 3),
)

RESULT = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "matches": pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("found", pa.string())])),
}


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """The k + 1 exact seeds of a notice with their offsets; an exact notice is its own seed, bounded by blanks."""
    if notice.edits == 0:
        return [(0, f" {notice.phrase} ")]
    size, parts = len(notice.phrase), notice.edits + 1
    cuts = [size * i // parts for i in range(parts + 1)]
    return [(a, notice.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Seeds of all notices in one automaton, and the verifier of each notice."""

    def __init__(self, notices: Sequence[Notice]):
        import ahocorasick
        import regex

        self.notices = tuple(notices)
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if seeds:
            self.automaton.make_automaton()
        self.verify = [None if n.edits == 0 else regex.compile(rf"(?e)(?<= )(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in self.notices]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int, int, int, str]]]:
        """Number of words, and the verified places: (notice, first word, start, end, edits, found), offsets in the text of blank-joined words."""
        words = ascii_lower(text).translate(ALNUM).split()
        joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
        windows: dict[int, list[tuple[int, int]]] = {}
        found: list[tuple[int, int, int, int, str]] = []
        if len(self.automaton):
            for end, (size, uses) in self.automaton.iter(joined):
                start = end + 1 - size
                for i, offset in uses:
                    notice = self.notices[i]
                    if notice.edits == 0:
                        found.append((i, start, start + len(notice.phrase), 0, notice.phrase))
                    else:
                        windows.setdefault(i, []).append((start - offset - notice.edits - 1, start - offset + len(notice.phrase) + notice.edits + 1))
        for i, spans in windows.items():
            for low, high in merged(spans):
                low = max(low, 0)
                for hit in self.places(i, joined, low, min(high, len(joined))):
                    found.append((i, hit.start() - 1, hit.end() - 1, sum(hit.fuzzy_counts), hit.group()))
        found.sort()
        if not found:
            return len(words), []
        begins = list(accumulate((len(w) + 1 for w in joined[1:-1].split(" ")), initial=0))  # of each word, without the blank in front
        return len(words), [(i, bisect_right(begins, start) - 1, start, end, edits, what) for i, start, end, edits, what in found]

    def places(self, i: int, joined: str, low: int, high: int) -> Iterator:
        """Matches of a notice in a stretch, one after another; where its exact words are not in one, the search goes on behind its start."""
        exact = set(self.notices[i].exact)
        while hit := self.verify[i].search(joined, low, high):
            kept = not exact or exact <= set(hit.group().split(" "))
            if kept:
                yield hit
            low = max(hit.end() if kept else hit.start() + 1, low + 1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Sequence[Notice] = BASE, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: the id and the columns of RESULT.

    ``base`` notices are exact word sequences (each starting place counts); ``notices`` are fuzzy.  ``score`` is
    the best agreement of a place with its notice (1 - edits / length; 1 for an exact phrase, 0 for none).
    A null or empty text has no words, no labels and score 0; repeated rows give repeated results; other columns
    of ``docs`` are not read.
    """
    everything, n_base = (*base, *notices), len(base)
    if any(n.edits for n in base):
        raise ValueError("base notices are exact")
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(everything).scan
        for rows in batches:
            out: dict[str, list] = {k: [] for k in RESULT}
            for text in texts(rows.column(1)):
                n_words, places = scan(text)
                starts = [p[1] for p in places if p[0] < n_base]
                out["n_words"].append(n_words)
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted({everything[p[0]].label for p in places if p[0] < n_base})))
                out["labels"].append(",".join(sorted({everything[p[0]].label for p in places})))
                out["score"].append(max((1 - p[4] / len(everything[p[0]].phrase) for p in places), default=0.0))
                out["matches"].append([{"label": everything[p[0]].label, "start_word": p[1], "start": p[2], "end": p[3], "edits": p[4], "found": p[5]} for p in places])
            yield pa.RecordBatch.from_arrays([rows.column(0), *batch(out, RESULT).columns], names=[id_col, *RESULT])

    schema = arrow_ddl(RESULT)
    schema = type(schema)([type(schema.fields[0])(id_col, id_type), *schema.fields])
    return map_rows(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, schema)
