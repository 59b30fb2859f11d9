"""Benchmark decontamination by canonical templates: numbers, units and names become typed slots, windows of what is left are joined."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import cut, settle

WINDOW = 8
#: Of an item's template windows, the part that must be found in a document.
SHARE = 0.5
#: Items of fewer tokens are in too many texts by chance, and match nothing.
LEAST = 4
FILTER_BITS = 24
REMEMBERED = 300_000
#: Steps of the search for the mapping with the most windows; a run with so many contradictions counts with the best found by then.
STEPS = 100_000

UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hrs ms day days week weeks month months year years hour hours minute minutes second seconds "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres dollar dollars cent cents euro euros percent degree degrees mph kmh kph hz khz mhz w kw v a kb mb gb tb".split()
)
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(st|nd|rd|th|%)?")
NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,]*)([a-z]{1,4})")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»…–—¿¡"


def _code(form: str) -> int:
    return xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass"), 42) or 1


def kind(token: str) -> tuple[str, bool]:
    """(canonical form, is a slot) of one token stripped of punctuation. A capital letter before small ones marks a name."""
    small = token.lower()
    if small[:1].isdigit() or small[:1] in "+-":  # only so do numbers begin
        if NUMBER.fullmatch(small):
            return "<num>", True
        if (m := NUMBER_UNIT.fullmatch(small)) and m[2] in UNITS:
            return "<num><unit>", True
    if small in UNITS and len(small) > 1:
        return "<unit>", True
    if token[:1].isupper() and token[1:] != token[1:].upper():
        return "<name>", True
    return small, False


class Canon:
    """Tokens of a text as codes and slot flags.

    A capital letter at the start of a sentence does not tell a name from another word, so there a word has two readings: as
    it is written small, and as a name. What is known of a word is kept until there are too many of them.
    """

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.code = np.zeros(1 << 16, np.uint64)
        self.literal = np.zeros(1 << 16, np.uint64)
        self.name = np.zeros(1 << 16, bool)
        self.slot = np.zeros(1 << 16, bool)
        self.ends = np.zeros(1 << 16, bool)

    def _learn(self, word: str) -> int:
        at = len(self.number)
        if at == len(self.code):
            for name in ("code", "literal", "name", "slot", "ends"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        token = word.strip(EDGES)
        if token:
            form, self.slot[at] = kind(token)
            self.code[at] = _code(form)
            self.literal[at] = _code(token.lower()) if self.slot[at] else self.code[at]
            self.name[at] = form == "<name>"
        self.ends[at] = word.rstrip("\"'”’)").endswith((".", "!", "?", ":"))
        self.number[word] = at
        return at

    def tokens(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(words, codes, slot flags, flags of words with two readings); words of punctuation only are left out.

        Codes has three rows: words at the start of a sentence read small, all capital words read as names, literal tokens.
        """
        if len(self.number) > REMEMBERED:
            self._clear()
        words = text.split()
        found = list(map(self.number.get, words))
        if None in found:
            found = [self.number[word] if word in self.number else self._learn(word) for word in words]
        at = np.array(found, np.int64)
        code, literal, slot = self.code[at], self.literal[at], self.slot[at]
        both = np.ones(len(at), bool)
        both[1:] = self.ends[at[:-1]]
        both &= self.name[at]
        codes = np.stack([np.where(both, literal, code), code, literal])
        kept = code != 0
        if kept.all():
            return words, codes, slot, both
        return [word for word, keep in zip(words, kept, strict=True) if keep], codes[:, kept], slot[kept], both[kept]


def window_hashes(codes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """The hash of every window, for each row of codes."""
    n = max(0, codes.shape[1] - width + 1)
    value = np.zeros((len(codes), n), np.uint64)
    for k in range(width if n else 0):
        value = (value ^ codes[:, k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value ^ np.uint64(width)


def heavy(slot: np.ndarray, width: int) -> np.ndarray:
    """Whether a window has more slots than words: its template would fit any list of names or figures, so its literal tokens count."""
    total = np.concatenate([[0], np.cumsum(slot)])
    return 2 * (total[width:] - total[:-width]) > width


#: Keeps hashes of literal windows apart from those of templates.
LITERAL = np.uint64(0x5851F42D4C957F2D)

WINDOWS = "id long, pos int, hash long, literal boolean, windows int, templates int, width int, slots array<string>"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of (id, text) rows in all readings; a text shorter than a window is one window."""
    canon = Canon()
    for batch in batches:
        out = []
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words, codes, slot, both = canon.tokens(text)
            width = min(WINDOW, len(words))
            if width < LEAST:
                continue
            literal = heavy(slot & ~both, width)
            counts = len(literal), int((~literal).sum())
            for at in range(len(literal)):
                part = codes[:, at : at + width]
                if literal[at]:
                    out.append(_described(key, words, slot[:0], at, window_hashes(part[2:], width)[0, 0] ^ LITERAL, True, width, *counts))
                    continue
                unsure = np.flatnonzero(both[at : at + width])
                for names in itertools.product((False, True), repeat=len(unsure)):
                    named = np.zeros(width, bool)
                    named[unsure] = names
                    value = window_hashes(np.where(named, part[1], part[0])[None], width)[0, 0]
                    out.append(_described(key, words, (slot & ~both)[at : at + width] | named, at, value, False, width, *counts))
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _described(key: int, words: list[str], slot: np.ndarray, at: int, value: np.uint64, literal: bool, width: int, windows: int = 0, templates: int = 0) -> dict:
    slots = [words[at + k].strip(EDGES).lower() for k in np.flatnonzero(slot).tolist()]
    return {"id": key, "pos": at, "hash": int(value.view(np.int64)), "literal": literal, "windows": windows, "templates": templates, "width": width, "slots": slots}


_ARROW = pa.schema(
    [("id", pa.int64()), ("pos", pa.int32()), ("hash", pa.int64()), ("literal", pa.bool_()), ("windows", pa.int32()), ("templates", pa.int32()), ("width", pa.int32()), ("slots", pa.list_(pa.string()))]
)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Template hashes to the words of a bitmap: (word, bits)."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        value = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
        bits[(value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    at = np.flatnonzero(bits)
    words, where = np.unique(at >> 6, return_inverse=True)
    packed = np.zeros(len(words), np.uint64)
    np.bitwise_or.at(packed, where, np.uint64(1) << (at & 63).astype(np.uint64))
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(packed.view(np.int64), pa.int64())], ["word", "bits"])


def largest_consistent(windows: list[tuple[int, frozenset]]) -> list[tuple[int, frozenset]]:
    """The most windows (pos, pairs of slot values) under one mapping, in which a value of either side stands for one of the other."""
    best: list[tuple[int, frozenset]] = []
    waiting = [windows]
    for _ in range(STEPS):
        if not waiting:
            break
        left = waiting.pop()
        if len(left) <= len(best):
            continue
        count = Counter(pair for _, pairs in left for pair in pairs)
        ours, theirs = Counter(a for a, _ in count), Counter(b for _, b in count)
        contested = [pair for pair in count if ours[pair[0]] > 1 or theirs[pair[1]] > 1]
        if not contested:
            best = left
            continue
        pick = max(contested, key=lambda pair: (count[pair], pair))
        waiting.append([w for w in left if pick not in w[1]])
        waiting.append([w for w in left if not any((a == pick[0]) != (b == pick[1]) for a, b in w[1])])
    return best


RUNS = "doc_id long, item_id long, windows int, templates int, pos array<int>, template_pos array<int>, exact boolean"
_RUNS = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("windows", pa.int32()), ("templates", pa.int32()), ("pos", pa.list_(pa.int32())), ("template_pos", pa.list_(pa.int32())), ("exact", pa.bool_())]
)


def _consistent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs along a diagonal with their largest consistent part; exact if nothing is left out and every value is the item's own."""
    for batch in batches:
        out = []
        for run in batch.to_pylist():
            met = sorted((w["pos"], frozenset((p["slots"], p["doc_slots"]) for p in w["pairs"])) for w in run["met"])
            held = largest_consistent(met)
            literal = {w["pos"] for w in run["met"] if w["literal"]}
            pos = [at for at, _ in held]
            own = len(held) == len(met) and all(a == b for _, pairs in held for a, b in pairs)
            out.append({k: run[k] for k in ("doc_id", "item_id", "windows", "templates")} | {"pos": pos, "template_pos": [at for at in pos if at not in literal], "exact": own})
        yield pa.RecordBatch.from_pylist(out, schema=_RUNS)


def matches(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, windows, found, exact) for each benchmark item (item_id, text) found in a document (doc_id, text).

    Both are read as whole texts. Tokens are runs between white space without outer punctuation, lower-cased; numbers, units
    and names turn into slots. An item is cut into its windows of 8 tokens; one of 4 to 7 tokens is a single window, a
    shorter one matches nothing. A window with more slots than words is met by its literal tokens. A document holds an item
    if it has at least `share` of these windows, or of those that are met as templates, with consistent slots:
    along aligned windows each of the item's slot values always stands for the same value of the document and the other way
    round; along a diagonal the mapping with the most windows counts, and windows that contradict it are dropped. `exact` tells
    whether none was dropped and all are the item's own values.

    Null and empty texts have no windows and match nothing, nor do rows without an id. Repeated rows count once; an empty
    table on either side gives no rows; other columns are not read. A task sends on the document windows that a bitmap of
    2^24 bits, as large for any benchmark, may hold; Spark joins these exactly.
    """
    spark = documents.sparkSession
    settle(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    cut_items = cut(items.mapInArrow(_item_windows, WINDOWS).distinct())
    marked = cut_items.select("hash").mapInArrow(_mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[marked.word.to_numpy(np.int64)] = marked.bits.to_numpy(np.int64).view(np.uint64)
    widths = sorted(row.width for row in cut_items.select("width").distinct().collect())
    shared = spark.sparkContext.broadcast(bitmap)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        canon = Canon()
        for batch in batches:
            out = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                words, codes, slot, both = canon.tokens(text.as_py())
                small = slot & ~both
                for width in widths:
                    if width > len(words):
                        continue
                    value = window_hashes(codes, width)
                    value[2] ^= LITERAL
                    hit = wanted[(value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                    # Words with two readings may be slots in the item, so they count as slots here.
                    hit[2] &= heavy(slot, width)
                    # Where nothing has two readings the names' row repeats the first.
                    hit[1] &= value[1] != value[0]
                    for row, flags in ((0, small), (1, slot), (2, slot[:0])):
                        for at in np.flatnonzero(hit[row]).tolist():
                            out.append(_described(key, words, flags[at : at + width], at, value[row, at], row == 2, width))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    there = rows.mapInArrow(look, WINDOWS).select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "hash", F.col("slots").alias("doc_slots"))
    wanted = cut_items.select(F.col("id").alias("item_id"), "pos", "hash", "literal", "windows", "templates", "slots")
    met = there.join(wanted, "hash").where(F.size("slots") == F.size("doc_slots"))
    # Of the readings of a window that meet, the one with the fewest slots.
    pairs = F.arrays_zip("slots", "doc_slots")
    once = met.groupBy("doc_id", "item_id", (F.col("doc_pos") - F.col("pos")).alias("shift"), "pos").agg(
        F.max("windows").alias("windows"), F.max("templates").alias("templates"), F.max("literal").alias("literal"), F.min(F.struct(F.size(pairs).alias("n"), pairs.alias("pairs"))).alias("_p")
    )
    # Along a diagonal there is one window for each of the item's, so the sets below are as small as the item.
    runs = once.groupBy("doc_id", "item_id", "shift").agg(
        F.max("windows").alias("windows"),
        F.max("templates").alias("templates"),
        F.collect_list(F.struct("pos", "literal", "_p.pairs")).alias("met"),
    )
    consistent = runs.drop("shift").mapInArrow(_consistent, RUNS).where(F.size("pos") > 0)
    held = consistent.groupBy("doc_id", "item_id").agg(
        F.max("windows").alias("windows"),
        F.max("templates").alias("templates"),
        F.size(F.array_distinct(F.flatten(F.collect_set("pos")))).alias("found"),
        F.size(F.array_distinct(F.flatten(F.collect_set("template_pos")))).alias("found_templates"),
        F.min("exact").alias("exact"),
    )
    enough = lambda found, of: F.col(found) >= F.greatest(F.lit(1), F.ceil(share * F.col(of)))
    return held.where(enough("found", "windows") | enough("found_templates", "templates")).drop("templates", "found_templates")


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents` that hold no benchmark item, all columns kept; rows without doc_id stay."""
    leaked = matches(documents, benchmark).select(F.col("doc_id").alias("id")).distinct()
    # A row as one value, so that its columns may have any names.
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), whole)
    return rows.join(leaked, "id", "left_anti").select("row.*")
