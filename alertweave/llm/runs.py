"""Maximal periodic runs of words, found by uniting suffix classes in the order of falling common prefixes.

The suffixes of a document that share a prefix of l words are a class; as l falls, classes unite along the suffix array, edge
by edge, the edge between neighbours weighing their longest common prefix (Kruskal's rule for the greatest spanning tree). Each
class keeps its positions in order. Two positions that become neighbours in a class, d apart, d being at most the common prefix
l, start a repetition of l + d words with smallest period d: had it a smaller one, a third position would stand between them.
Of the pairs of one run the leftmost is the one whose preceding words differ.

Runs of at least `least` words have a prefix of `least` // 2 words in common with themselves a period later. So only positions
whose next `least` // 2 words occur again in the document take part, and the suffix array is built for them alone, by
doubling.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import settle

LEAST = 12
#: Documents are taken together up to so many words; a longer one is alone.
WORDS = 1 << 19
#: Bytes of a text split into words at a time.
SLICE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Words:
    """Numbers of words, from 1 on, and the words of numbers."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(count(1).__next__)

    def ids(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        parts, start = [], 0
        while start < len(raw):
            space = SPACE.search(raw, min(start + SLICE, len(raw)))
            stop = space.end() if space else len(raw)
            parts.append(np.array(list(map(self.number.__getitem__, raw[start:stop].split())), np.int32))
            start = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def texts(self, lists: list[np.ndarray]) -> list[bytes]:
        names = [b"", *self.number]
        return [b" ".join(map(names.__getitem__, ids.tolist())) for ids in lists]


def repeated_tail(ids: np.ndarray, doc: int | None) -> np.ndarray:
    """Every tenth document by checksum goes on periodically from one of its words."""
    h, n = zlib.crc32(str(doc).encode()), len(ids)
    if doc is None or h % 10 or n == 0:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return ids[np.where(at < a, at, a + (at - a) % p)]


def _repeated(words: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Positions whose next `width` words occur again in their document, and a few by chance."""
    n = len(words) - width + 1
    random = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (width + 1, 2), np.uint64) | np.uint64(1)
    key = doc[:n].astype(np.uint64) * random[width, 0]
    value = words.astype(np.uint64) * random[width, 1]
    value ^= value >> np.uint64(29)
    for k in range(width):
        key += value[k : k + n] * random[k, 0]
    inside = np.flatnonzero((words[:n] > 0) & (words[width - 1 :] > 0) & (doc[:n] == doc[width - 1 :]))
    order = np.argsort(key[inside])
    same = np.diff(key[inside][order]) == 0
    return np.sort(inside[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]])


def _starts(new: np.ndarray) -> np.ndarray:
    """For each row of a sorted table where its group begins; `new` flags first rows."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def suffix_edges(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, l): neighbours in the suffix arrays of the documents and how many words they have in common, `width` at least."""
    seeds = _repeated(words, doc, width)
    if not len(seeds):
        return seeds, seeds, seeds
    place = np.unique(np.concatenate([seeds, seeds + width]))
    index = np.zeros(len(words) + width, np.int64)
    index[place] = np.arange(len(place))
    padded = np.concatenate([words, np.zeros(2 * width, words.dtype)])
    columns = [doc[place], *[padded[place + k] for k in range(width)]]
    order = np.lexsort(columns[::-1])
    new = np.concatenate([[True], np.any([np.diff(c[order]) != 0 for c in columns], axis=0)])
    rank = np.empty(len(place), np.int64)
    rank[order] = _starts(new)
    levels, h = [], width
    while True:
        levels.append((h, rank))
        active = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
        if not len(active):
            break
        first, second = rank[active], rank[index[place[active] + h]]
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        outer = np.concatenate([[True], a[1:] != a[:-1]])
        inner = outer | np.concatenate([[True], b[1:] != b[:-1]])
        rank = rank.copy()
        rank[active[order]] = a + _starts(inner) - _starts(outer)
        h *= 2
    array = np.argsort(rank)
    shared = np.flatnonzero(levels[0][1][array[1:]] == levels[0][1][array[:-1]])
    x, y = place[array[shared]], place[array[shared + 1]]
    length = np.zeros(len(x), np.int64)
    for h, rank in reversed(levels):
        length += h * (rank[index[x + length]] == rank[index[y + length]])
    alive = np.ones(len(x), bool)
    for _ in range(width):
        alive &= (padded[x + length] == padded[y + length]) & (padded[x + length] > 0)
        length += alive
    return x, y, length


def find_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run; `words` has 0 before, between and after documents, `least` // 2 of them."""
    x, y, length = suffix_edges(words, doc, max(1, least // 2))
    order = np.argsort(-length, kind="stable")
    owner: dict[int, list[int]] = {}
    out = []
    before = words.tolist() if len(order) > len(words) // 20 else words
    for left, right, common in zip(x[order].tolist(), y[order].tolist(), length[order].tolist(), strict=True):
        one = owner.get(left) or [left]
        other = owner.get(right) or [right]
        if len(one) < len(other):
            one, other = other, one
        # The smaller set goes into the larger; only then are neighbours looked at, and only those from either set.
        for position in other:
            insort(one, position)
        for k, position in enumerate(other):
            at = bisect_left(one, position)
            pairs = []
            if at and (k == 0 or one[at - 1] != other[k - 1]):
                pairs.append((one[at - 1], position))
            if at + 1 < len(one) and (k + 1 == len(other) or one[at + 1] != other[k + 1]):
                pairs.append((position, one[at + 1]))
            for start, again in pairs:
                period = again - start
                if period <= common and period + common >= least and before[start - 1] != before[again - 1]:
                    out.append((start, period + common, period))
            owner[position] = one
        owner[left] = owner[right] = one
    return out


def _gathered(docs: list[int | None], lists: list[np.ndarray], words: Words, least: int) -> pa.RecordBatch:
    width = max(1, least // 2)
    gap = np.zeros(width, np.int32)
    sizes = np.array([len(x) for x in lists], np.int64)
    first = width + np.concatenate([[0], np.cumsum(sizes + width)])[:-1]
    flat = np.concatenate([gap, *[part for ids in lists for part in (ids, gap)]])
    doc = np.concatenate([[-1] * width, np.repeat(np.arange(len(lists)), sizes + width)]).astype(np.int32)
    found = sorted((s, p, n) for s, n, p in find_runs(flat, doc, least))
    start, period, length = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ([], [], [])))
    of = doc[start]
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    collapsed = words.texts([ids[kept[at : at + len(ids)]] for ids, at in zip(lists, first.tolist(), strict=True)])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(lists)))])
    rows = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
    columns = [pa.array(docs, pa.int64()), pa.array(sizes), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def detect(documents: DataFrame, least: int = LEAST, planted: bool = False) -> DataFrame:
    """SCHEMA's columns for each document (doc_id, text): its runs by start, then period, and its text without their repetitions.

    Words are what stands between ASCII white space. A run is a stretch of words with smallest period q, of max(least, 2 q)
    words at least, that no neighbouring word extends. `collapsed` joins by one space the words that no run holds after its
    first q. `planted` makes the tails of every tenth document periodic first (repeated_tail).

    A null or empty text has no words, no runs and an empty collapsed text. A null doc_id stays null and nothing is planted
    there. Repeated rows are judged each for itself, an empty table gives no rows, other columns are not read. A document is
    read as a whole, however long, by one task, in some 60 bytes a word and its distinct words; nothing is shuffled.
    """
    settle(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lists, words, held = [], [], Words(), 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = words.ids(text.as_py())
                docs.append(doc)
                lists.append(repeated_tail(ids, doc) if planted else ids)
                held += len(ids)
                if held >= WORDS:
                    yield _gathered(docs, lists, words, least)
                    docs, lists, words, held = [], [], Words(), 0
        if docs:
            yield _gathered(docs, lists, words, least)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """detect()'s rows as the longest run of each document and checksums of all runs and of the collapsed text."""

    def ranked(run: Column) -> Column:
        return F.struct(run["length"].alias("length"), (-run["start"]).alias("start"), (-run["period"]).alias("period"))

    def line(run: Column) -> Column:
        return F.concat_ws(",", run["start"], run["length"], run["period"])

    longest = F.array_max(F.transform("runs", ranked))
    lines = F.array_join(F.transform("runs", lambda run: F.concat(line(run), F.lit("\n"))), "")
    return found.withColumn("_longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.start")).alias("start"),
        F.col("_longest.length").alias("length"),
        (-F.col("_longest.period")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
