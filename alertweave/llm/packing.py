"""Packing token ids into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import settle

WINDOW = 2048
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Words, and parts of words, kept with their ids in a Python worker; later ones are encoded each time.
REMEMBERED = 400_000
TEXTS_AT_ONCE = 64
#: A run of letters without case rules that depend on their surroundings, then punctuation. Its ids are those of the two parts.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,:;?#$%&*|!]*)")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts, by way of the distinct words between white space.

    The vocabulary's normaliser turns white space into spaces, on which its splitter always cuts, so a text's ids are those
    of its words in a row. A word of letters and punctuation is looked up in two parts, which the splitter cuts too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if piece.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of words not seen yet, remembered while there is room."""
        parts = {word: m for word in missing if (m := PLAIN.fullmatch(word))}
        stems = [stem for stem in {m[1].lower() for m in parts.values()} if stem not in self.stems]
        fresh: dict[str, bytes] = {}
        if stems:
            ids = self._encode(" ".join(stems))
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()  # a run of letters ends in exactly one word-end piece
            raw, start = ids.tobytes(), 0
            for stem, cut_at in zip(stems, cuts, strict=True):
                fresh[stem] = raw[start:cut_at]
                start = cut_at
        for tail in {m[2] for m in parts.values()}:
            if tail not in self.stems:
                fresh[tail] = self._encode(tail).tobytes()
        if len(self.stems) < REMEMBERED:
            self.stems.update(fresh)
        learned = {}
        for word in missing:
            if m := parts.get(word):
                stem, tail = m[1].lower(), m[2]
                learned[word] = (self.stems.get(stem) or fresh[stem]) + (self.stems.get(tail) or fresh.get(tail, b""))
            else:
                learned[word] = self._encode(word).tobytes()
        if len(self.words) < REMEMBERED:
            self.words.update(learned)
        return learned

    def encode(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """The ids of each text, the end id after them."""
        end = np.array([END], np.uint32).tobytes()
        while some := list(islice(texts, TEXTS_AT_ONCE)):
            words = [_words(text) for text in some]
            found = [list(map(self.words.get, own)) for own in words]
            missing = {word for own, ids in zip(words, found, strict=True) if None in ids for word, got in zip(own, ids, strict=True) if got is None}
            learned = self._learn(missing) if missing else {}
            for own, ids in zip(words, found, strict=True):
                if None in ids:
                    ids = [learned[word] if got is None else got for word, got in zip(own, ids, strict=True)]
                yield np.frombuffer(b"".join(ids) + end, np.uint32)


def _words(text: str) -> list[str]:
    """The text between its white space. str.split() also cuts at four separators that the vocabularies take for characters."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return re.findall(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text)
    return text.split()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


Piece = tuple[int, int, np.ndarray, int]  # doc_id, start, ids, tokens of the document


class Packer:
    """Places pieces online: each goes where the sum over fill levels of (open windows at the level) squared ends up smallest.

    `levels[f]` is the number of open windows filled to f; a new window is one at level 0, a full one leaves the count. Of
    equal choices the fullest window is taken. What is still open at the end is completed from the emptiest windows, cutting
    their pieces, and the last incomplete window is cut at powers of two, so nothing is padded.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]

    def add(self, piece: Piece) -> list[Piece] | None:
        """A window that this piece completes, if it does. Pieces hold at most a window."""
        size = len(piece[2])
        room = self.window - size
        change = 2 * self.levels[size : self.window + 1] + 1  # a window more at the level reached
        change[room] = 0  # a full window is no longer counted
        change[1:] -= 2 * self.levels[1 : room + 1] - 1  # a window less at the level left
        if size == 0:
            raise ValueError("empty piece")
        usable = self.levels[: room + 1] > 0
        usable[0] = True
        cost = np.where(usable, change, np.iinfo(np.int64).max)
        level = room - int(cost[::-1].argmin())
        if level:
            held = self.open[level].pop()
            self.levels[level] -= 1
        else:
            held = []
        held.append(piece)
        if level == room:
            return held
        self.open[level + size].append(held)
        self.levels[level + size] += 1
        return None

    def drain(self) -> Iterator[list[Piece]]:
        """The windows left open, made whole."""
        left = [held for level in self.open for held in level]  # emptiest first
        self.open, self.levels = [[] for _ in range(self.window)], np.zeros(self.window + 1, np.int64)
        spare: list[Piece] = []  # of the emptiest window, taken apart
        first = 0
        while first < len(left):
            held = left.pop()
            room = self.window - sum(len(p[2]) for p in held)
            while room:
                if not spare:
                    if first == len(left):
                        break
                    spare = left[first]
                    first += 1
                doc, start, ids, tokens = spare.pop()
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], tokens))
                    ids = ids[:room]
                held.append((doc, start, ids, tokens))
                room -= len(ids)
            if room:
                spare = held
                break
            yield held
        # Less than a window is left: sequences of the powers of two in its length.
        count = sum(len(p[2]) for p in spare)
        while count:
            room = 1 << (count.bit_length() - 1)
            count -= room
            held = []
            while room:
                doc, start, ids, tokens = spare.pop()
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], tokens))
                    ids = ids[:room]
                held.append((doc, start, ids, tokens))
                room -= len(ids)
            yield held


def _rows(windows: Iterator[list[Piece]], first: int) -> Iterator[tuple]:
    for number, held in enumerate(windows):
        offset = 0
        for doc, start, ids, tokens in held:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, first + number, offset
            offset += len(ids)


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece of the documents (doc_id, text): SCHEMA's columns. `tokenizer` is the path of a vocabulary file.

    A document's ids are those of its whole text, then END; null and empty texts have END only. Each id lies in one piece;
    pieces of at most `window` ids fill sequences from offset 0 on without gaps. A document longer than a window gives whole
    windows, and its rest is placed like a short one. Sequences are full, but for at most one set of powers of two per task,
    so that nothing needs padding.

    Each task packs what it reads, with its own level array, so nothing is shuffled, and a task that is run again packs the
    same rows the same way. Repeated rows and ids are packed as separate documents; a null doc_id stays null; an empty table
    gives no rows; other columns are not read. Memory is that of the open windows, whose number the rule keeps low.
    """

    settle(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        packer = Packer(window)
        base = TaskContext.get().partitionId() << 40
        names = [part.split()[0] for part in SCHEMA.split(",")]

        def windows() -> Iterator[list[Piece]]:
            for batch in batches:
                docs = batch.column("doc_id").to_pylist()
                texts = (text.as_py() or "" for text in batch.column("text"))
                for doc, ids in zip(docs, encode(texts), strict=True):
                    n = len(ids)
                    whole = n - n % window
                    for start in range(0, whole, window):
                        yield [(doc, start, ids[start : start + window], n)]
                    # A copy, so that an open window does not keep its documents' other ids.
                    if whole < n and (full := packer.add((doc, whole, ids[whole:].copy(), n))):
                        yield full
            yield from packer.drain()

        buffer: list[tuple] = []
        for row in _rows(windows(), base):
            buffer.append(row)
            if len(buffer) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*buffer, strict=True)], names)
                buffer.clear()
        if buffer:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*buffer, strict=True)], names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
