"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words.

The patterns are all windows of ``m`` consecutive words of the test texts. A block is two words. The shift
table says, for a block that ends at a text position, how far the next position is at which a pattern can
end: pairs of words in no pattern let the search jump ``m - 1`` words, so most of a text is never looked
at. At shift 0 the last block selects a bucket of patterns, the first block narrows it, and comparing all
words confirms an occurrence.

The test set is the stated query set: it is read in blocks of at most ``MAX_WINDOWS`` patterns, each sent to
the tasks and searched in one pass over the documents, so its size is bounded whatever the test set's.

Defined cases: null and short texts match nothing; a test text under m words has no pattern; test texts that
share a passage are all reported; repeated documents with one id give one row; no documents or no items give
an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlens.llm.words import words

#: Patterns searched in one pass.
MAX_WINDOWS = 500_000
MATCHES = "doc_id bigint, item_id bigint, field string, windows bigint, longest_run bigint"


class PatternTables:
    """Shift table and suffix buckets of equally long word patterns; block length 2."""

    def __init__(self, m: int):
        self.m = m
        self.shift: dict[tuple[str, str], int] = {}
        #: last block -> first block -> pattern -> places (text number, offset) it comes from
        self.buckets: dict[tuple[str, str], dict[tuple[str, str], dict[tuple[str, ...], list[tuple[int, int]]]]] = {}
        self.texts: list[tuple[int, str]] = []

    def add(self, item: int, field: str, ws: list[str]) -> int:
        m, number = self.m, len(self.texts)
        self.texts.append((item, field))
        for i in range(len(ws) - m + 1):
            p = tuple(ws[i : i + m])
            self.buckets.setdefault(p[-2:], {}).setdefault(p[:2], {}).setdefault(p, []).append((number, i))
            for j in range(1, m):
                block = p[j - 1 : j + 1]
                self.shift[block] = min(self.shift.get(block, m - 1), m - 1 - j)
        return max(0, len(ws) - m + 1)

    def search(self, ws: list[str]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(position of the first word, places) of every occurrence."""
        m, shift, buckets = self.m, self.shift, self.buckets
        jump, at, n = m - 1, m - 1, len(ws)
        while at < n:
            block = (ws[at - 1], ws[at])
            s = shift.get(block, jump)
            if s:
                at += s
                continue
            start = at - m + 1
            narrowed = buckets[block].get((ws[start], ws[start + 1]))
            if narrowed and (places := narrowed.get(tuple(ws[start : at + 1]))):
                yield start, places
            at += 1


def _runs(found: Iterable[tuple[int, list[tuple[int, int]]]], m: int) -> dict[int, list[int]]:
    """Per text number: windows matched and the longest run of words, over consecutive windows in both."""
    out: dict[int, list[int]] = {}
    ends: dict[tuple[int, int], tuple[int, int]] = {}  # (text, start - offset) -> last start, run
    for start, places in found:
        for number, offset in places:
            last, run = ends.get((number, start - offset), (-2, 0))
            run = run + 1 if last == start - 1 else m
            ends[number, start - offset] = (start, run)
            o = out.setdefault(number, [0, 0])
            o[0] += 1
            o[1] = max(o[1], run)
    return out


def blocks(items: DataFrame, item_id: str, fields: list[str], m: int, max_windows: int) -> Iterator[PatternTables]:
    held, n = PatternTables(m), 0
    for row in items.select(item_id, *fields).distinct().toLocalIterator():
        for f in fields:
            if row[f] is not None and row[item_id] is not None:
                n += held.add(row[item_id], f, words(row[f]))
        if n >= max_windows:
            yield held
            held, n = PatternTables(m), 0
    yield held


def find_leaks(documents: DataFrame, items: DataFrame, m: int, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: tuple[str, ...] = ("prompt", "answer"), max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document, item and field with a common run of m words: MATCHES.

    ``windows`` counts the m-word windows found, ``longest_run`` the words of the longest common run.
    """
    docs = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    parts = []
    for tables in blocks(items, item_id, list(fields), m, max_windows):
        sent = documents.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            t: PatternTables = sent.value
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ws = words(text)
                    if len(ws) >= t.m:
                        rows += [(doc, *t.texts[number], w, longest) for number, (w, longest) in _runs(t.search(ws), t.m).items()]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "field", "windows", "longest_run"])

        parts.append(docs.mapInArrow(run, MATCHES))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # an item's fields can lie in two blocks only if it is repeated; repeated documents count once
    return out.groupBy("doc_id", "item_id", "field").agg(F.max("windows").alias("windows"), F.max("longest_run").alias("longest_run"))
