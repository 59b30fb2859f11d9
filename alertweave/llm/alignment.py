"""Where the tokens of two vocabularies end together, and which of their ids go together over the whole corpus.

Most groups are one token on either side with the same bytes. For those the partner is read from an array made once from the
two vocabularies, and their number is counted in a vector as long as the vocabulary. Only the other groups' links are pairs,
which are summed per task and then shuffled.

Two tokens that end together are equal or one is a proper suffix of the other. So there are at most as many distinct pairs as
the vocabularies' entries have suffixes that are entries of the other one, however large the corpus is, and the finished
counts can be sent to every task.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import cut, settle

TOKENIZER_A = "byte_bpe_50k.json"
#: The ranks of the same vocabulary; its library encodes four times as fast, with the same ids.
RANKS_A = "byte_bpe_50k.tiktoken"
TOKENIZER_B = "piece_bpe_32k.model"

ENCODED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, regular array<int>, irregular array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Characters encoded and cut into groups at a time; a longer text is one piece.
CHARS = 500_000


class Vocabularies:
    """Both encoders, the bytes of their entries, and `partner`: B's id with the same bytes as each id of A, or -1."""

    def __init__(self, ranks: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            entries = {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=entries, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = entry
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        same = {}
        for i, entry in enumerate(self.bytes_b):  # a piece rather than the byte it may fall back to
            if entry and (entry not in same or self.b.is_byte(same[entry])):
                same[entry] = i
        self.partner = np.array([same.get(entry, -1) if entry else -1 for entry in self.bytes_a], np.int64)
        # What a group's string is made of: an id and the sign that follows it, for A within a group, A at its end, and B likewise.
        number_a = [str(i) for i in range(len(self.bytes_a))]
        number_b = [str(i) for i in range(len(self.bytes_b))]
        self.spelled = [x + "," for x in number_a] + [x + "|" for x in number_a] + [x + "," for x in number_b] + [x + ";" for x in number_b]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @property
    def most_pairs(self) -> int:
        """No more distinct pairs than this can be linked, whatever the corpus."""

        def linked(entries: list[bytes], others: list[bytes], first: int) -> int:
            held: defaultdict[bytes, int] = defaultdict(int)
            for other in others:
                held[other] += 1
            return sum(held.get(entry[k:], 0) for entry in entries for k in range(first, len(entry)))

        return linked(self.bytes_a, self.bytes_b, 0) + linked(self.bytes_b, self.bytes_a, 1)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of space + text by A and of text by B; two empty lists where the bytes of either are not space + text."""
        ids_a = [self.a.encode_ordinary(" " + text) if text else [] for text in texts]
        ids_b = [own if text else [] for text, own in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]
        for k, text in enumerate(texts):
            raw = b" " + text.encode()
            if text and any(b"".join(map(entries.__getitem__, ids[k])) != raw for entries, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
                ids_a[k] = ids_b[k] = []
        return ids_a, ids_b


@lru_cache(maxsize=1)
def vocabularies(ranks: str, pattern: str, pieces: str) -> Vocabularies:
    return Vocabularies(ranks, pattern, pieces)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)


def _parts(flags: np.ndarray, stops: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """The flagged values in one list per document; `stops` is where each document ends among the flags."""
    offsets = np.concatenate([[0], np.cumsum(flags)[stops - 1] if len(flags) else stops])
    offsets[1:][stops == 0] = 0
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[flags]))


def _aligned(v: Vocabularies, docs: list[int | None], texts: list[str]) -> pa.RecordBatch:
    ids_a, ids_b = v.encode(texts)
    n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
    a, b = _flat(ids_a), _flat(ids_b)
    # A document has as many bytes on either side, so all of them can be laid end to end.
    end_a, end_b = np.cumsum(v.length_a[a]), np.cumsum(v.length_b[b])
    last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    cut_a, cut_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
    size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    # Groups up to the end of each document.
    stops = np.concatenate([[0], np.cumsum(last_a)])[np.cumsum(n_a)]
    link_a, link_b = a[cut_a], b[cut_b]
    regular = (size_a == 1) & (size_b == 1) & (v.partner[link_a] == link_b)
    # Each group's tokens of A, then those of B.
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    order = np.empty(len(a) + len(b), np.int64)
    sizes = len(v.bytes_a), len(v.bytes_b)
    order[np.arange(len(a)) + (cut_b + 1 - size_b)[group_a]] = a + sizes[0] * last_a
    order[np.arange(len(b)) + (cut_a + 1)[group_b]] = b + 2 * sizes[0] + sizes[1] * last_b
    spelled = list(map(v.spelled.__getitem__, order.tolist()))
    hashes, start = [], 0
    for count in (n_a + n_b).tolist():
        own = "".join(spelled[start : start + count])
        hashes.append(hashlib.sha256(own[:-1].encode()).hexdigest() if own else "")
        start += count
    pairs = link_a * sizes[1] + link_b
    columns = [
        pa.array(docs, pa.int64()),
        pa.array(n_a),
        pa.array(n_b),
        pa.array(np.diff(stops, prepend=0)),
        pa.array(hashes, pa.string()),
        _parts(regular, stops, link_a.astype(np.int32)),
        _parts(~regular, stops, pairs),
    ]
    return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in ENCODED.split(", ")])


def _encode(paths: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(*paths)
        docs, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                docs.append(doc)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= CHARS:
                    yield _aligned(v, docs, texts)
                    docs, texts, held = [], [], 0
        if docs:
            yield _aligned(v, docs, texts)

    return run


def _count(size_a: int, size_b: int):
    """Links by id of A for regular groups (pair is null) and by pair for the others, summed over what a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(size_a, np.int64)
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            vector += np.bincount(batch.column("regular").flatten().to_numpy(), minlength=size_a)
            fresh, n = np.unique(batch.column("irregular").flatten().to_numpy(), return_counts=True)
            pairs, place = np.unique(np.concatenate([pairs, fresh]), return_inverse=True)
            summed = np.zeros(len(pairs), np.int64)
            np.add.at(summed, place, np.concatenate([counts, n]))
            counts = summed
        ids = np.flatnonzero(vector)
        a = pa.array(np.concatenate([ids, pairs // size_b]))
        regular = pa.array(np.arange(len(ids) + len(pairs)) < len(ids))
        yield pa.RecordBatch.from_arrays([a, pa.array(np.concatenate([0 * ids, pairs % size_b])), pa.array(np.concatenate([vector[ids], counts])), regular], ["a", "b", "n", "regular"])

    return run


def _collected(counts: DataFrame) -> list[np.ndarray]:
    table = counts.toArrow()
    return [table.column(name).to_numpy() for name in table.column_names]


def _scored(counts):
    """Looks up the links of each document: how many are their B id's most frequent, and the sum of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_a, best_a, pairs, of_pair, best_pair = counts.value
        for batch in batches:
            best, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            n_links = batch.column("n_groups")  # no entry is empty, so one token of either side ends at each cut
            for name in ("regular", "irregular"):
                lists = batch.column(name)
                values = lists.flatten().to_numpy()
                if name == "regular":
                    count, first = of_a[values], best_a[values]
                else:
                    place = np.searchsorted(pairs, values)
                    count, first = of_pair[place], best_pair[place]
                offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                for out, each in ((best, first), (total, count)):
                    sums = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
                    out += sums[offsets[1:]] - sums[offsets[:-1]]
            columns = {**{name: batch.column(name) for name in batch.schema.names}, "n_links": n_links, "n_best": pa.array(best), "count_sum": pa.array(total)}
            names = [part.split()[0] for part in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)

    return run


def pair_counts(encoded: DataFrame, v: Vocabularies) -> tuple[DataFrame, DataFrame]:
    """(a, n) of regular links and (a, b, n) of the others over all documents."""
    sizes = len(v.bytes_a), len(v.bytes_b)
    counted = encoded.select("regular", "irregular").mapInArrow(_count(*sizes), "a long, b long, n long, regular boolean")
    counted = cut(counted)
    regular = counted.where("regular").groupBy("a").agg(F.sum("n").alias("n"))
    return regular, counted.where("not regular").groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(documents: DataFrame, ranks: str, pattern: str, pieces: str) -> DataFrame:
    """One row per document (doc_id, text) with RESULT's columns. `ranks`, `pieces`: paths of the vocabulary files; `pattern`: A's splitter.

    A group ends wherever tokens of both sides end; its link is the pair of its last tokens. Null and empty texts, and texts
    whose tokens do not spell space + text on both sides, have zeros and ''. A null doc_id stays null, repeated rows and ids
    are documents of their own and count each time, an empty table gives no rows, other columns are not read. A text is
    encoded as a whole by one task, whatever its length; others are taken together up to half a million characters.
    """
    spark = documents.sparkSession
    settle(spark)
    paths = ranks, pattern, pieces
    v = vocabularies(*paths)
    encoded = cut(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(paths), ENCODED))
    regular, irregular = pair_counts(encoded, v)
    ids, n = _collected(regular)
    a, b, of_pair = _collected(irregular)  # at most v.most_pairs rows
    of_a = np.zeros(len(v.bytes_a), np.int64)
    of_a[ids] = n
    best = np.zeros(len(v.bytes_b), np.int64)
    np.maximum.at(best, v.partner[ids], n)
    np.maximum.at(best, b, of_pair)
    pairs = a * len(v.bytes_b) + b
    order = np.argsort(pairs)
    counts = spark.sparkContext.broadcast((of_a, of_a == best[v.partner], pairs[order], of_pair[order], (of_pair == best[b])[order]))
    return encoded.mapInArrow(_scored(counts), RESULT)
