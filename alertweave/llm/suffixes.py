"""Repeated passages by distributed prefix doubling over sampled positions.

A suffix array ranks all positions by what follows, lengthening what its ranks stand for in each round: the rank of h + k
bytes is that of the pair (rank of h bytes here, rank of k bytes at offset h). Here the ranks stand for 16 bytes, then for
25, 33 and 42 bytes either way, then for 25 + 25 bytes; Spark sorts the pairs, and positions whose rank is unique leave, so
the last round holds only those that the earlier ones left open.

The first rounds need few positions. Of the 35 strings of 16 bytes in a window of 50 the one with the least hash is an
anchor; equal windows have equal anchors at the same place. So a window is repeated only if its anchor is, and if two
anchors agree in the 34 bytes before and the 50 after them, so do all windows that hold them there. Of those left, the
anchor's ranks bound how far before and after it a repeated window can reach.

Ranks are names, not ordinals: hashes, equal for equal strings. Windows count as repeated if 84 bits of their names agree.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertweave.llm.common import cut, settle

LENGTH = 50
GRAM = 16
#: Bytes by which the rounds after the first lengthen an anchor.
STEPS = (9, 17, 26)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> _U(29))) * _U(0x94D049BB133111EB)
    return value ^ (value >> _U(32))


class Names:
    """Names of substrings from prefix sums: sum of value(byte) * base^i, brought to i = 0 by the base's inverse."""

    def __init__(self, seed: int = 1):
        random = np.random.Generator(np.random.PCG64(seed))
        self.value = random.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power), 1 << 16)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate([[_U(1)], np.full(n, _BASE)]), dtype=np.uint64)
                self.inverse = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(pow(int(_BASE), -1, 1 << 64)))]), dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.inverse[start])


def anchors(names: Names, sums: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Where each window of `length` bytes has its least-named string of `gram` bytes, the leftmost of equals; each place once."""
    n = len(sums) - 1
    width = length - gram + 1
    key = _mix((sums[gram:] - sums[:-gram]) * names.inverse[: n - gram + 1])
    # Upper half name, lower half place: keys differ, and equal windows order theirs alike.
    least = (key & _U(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & _U(0xFFFFFFFF)).astype(np.int64)
    return place[np.concatenate([[True], place[1:] != place[:-1]])]


def _first_owners(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags the rows whose names (a, b) also occur in this batch under a smaller doc."""
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    out = np.empty(len(a), bool)
    out[order] = doc > least
    return out


#: covered: this batch has the same under a smaller doc, so the row need not be compared any more; its a is spread.
ANCHORS = "a long, b long, doc long, loc long, covered boolean"
WINDOWS = "a long, doc long, loc long, covered boolean"
#: Texts are named and compared in batches of about so many bytes.
BATCH = 4 << 20
#: loc has the place in its lower 32 bits, then 12 bits of the text's checksum, so that repeated ids with different texts stay
#: apart, then 20 bits of a window's second name.
TAG = 0xFFF


def _emit(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    *first, doc, loc = (np.concatenate(x) for x in zip(*parts, strict=True))
    second = first[1] if len(first) > 1 else loc.view(np.uint64) >> _U(44)
    covered = _first_owners(first[0], second, doc)
    first[0] = np.where(covered, _mix(doc.view(np.uint64)), first[0])
    arrays = [pa.array(x.view(np.int64)) for x in (*first, doc, loc)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(covered)], names)


def _gathered(rows: Iterator[tuple[int, tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in schema.split(",")]
    held, parts = 0, []
    for size, part in rows:
        if len(part[0]):
            parts.append(part)
        held += size
        if held >= BATCH and parts:
            yield _emit(parts, names)
            held, parts = 0, []
    if parts:
        yield _emit(parts, names)


def _located(raw: bytes, place: np.ndarray) -> np.ndarray:
    return np.int64((zlib.crc32(raw) & TAG) << 32) | place


def _name_anchors(length: int, gram: int):
    before, after = length - gram, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()

        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("raw"), strict=True):
                    raw = text.as_py()
                    n = len(raw)
                    sums = names.sums(np.frombuffer(raw, np.uint8))
                    place = anchors(names, sums, length, gram)
                    left, right = np.maximum(place - before, 0), np.minimum(place + after, n)
                    a = names.of(sums, place, place + gram)
                    # 34 bits for all around the anchor, then 5 for each of its lengthenings after and before.
                    around = names.of(sums, left, right) ^ _mix((right - left).astype(np.uint64) * _U(128) + (place - left).astype(np.uint64))
                    b = around >> _U(30) << _U(30)
                    for k, step in enumerate(STEPS):
                        ahead = names.of(sums, place, np.minimum(place + gram + step, n))
                        behind = names.of(sums, np.maximum(place - step, 0), place + gram)
                        b |= ahead >> _U(59) << _U(25 - 5 * k) | behind >> _U(59) << _U(10 - 5 * k)
                    yield n, (a, b, np.full(len(place), doc, np.int64), _located(raw, place))

        yield from _gathered(rows(), ANCHORS)

    return run


def _name_windows(length: int, gram: int):
    """(doc, raw, coded anchors) to the names of every window left open around them."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()

        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for doc, text, coded in zip(batch.column("doc").to_pylist(), batch.column("raw"), batch.column("coded"), strict=True):
                    raw = text.as_py()
                    sums = names.sums(np.frombuffer(raw, np.uint8))
                    code = coded.values.to_numpy()
                    place, least, most = code >> 12, code >> 6 & 63, code & 63
                    n = len(raw) - length + 1

                    def starts(first: np.ndarray, last: np.ndarray, n: int = n) -> np.ndarray:
                        change = np.bincount(np.clip(first, 0, n), minlength=n + 1) - np.bincount(np.clip(last + 1, 0, n), minlength=n + 1)
                        return np.cumsum(change[:n]) > 0

                    # What lies around a repeated anchor is repeated, and an earlier document shows it to later ones.
                    done = least > most
                    start = np.flatnonzero(starts((place - most)[~done], (place - least)[~done]) & ~starts(place[done] - before, place[done]))
                    middle = length // 2
                    one, two = names.of(sums, start, start + middle), names.of(sums, start + middle, start + length)
                    a = _mix(one ^ _mix(two + _BASE))
                    second = (_mix(one * _U(0xD6E8FEB86659FD93) + two) >> _U(44) << _U(44)).view(np.int64)
                    yield len(raw), (a, np.full(len(start), doc, np.int64), _located(raw, start) | second)

        yield from _gathered(rows(), WINDOWS)

    return run


def _texts(documents: DataFrame, length: int) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return documents.select(F.col("doc_id").cast("long").alias("doc"), raw.alias("raw")).where(F.col("doc").isNotNull() & (F.octet_length("raw") >= length))


def _place() -> Column:
    return F.col("loc").bitwiseAND(0xFFFFFFFF).alias("place")


def _of_text() -> Column:
    return F.shiftright("loc", 32).bitwiseAND(TAG).alias("tag")


def _tag(raw: str) -> Column:
    return F.crc32(raw).bitwiseAND(TAG).alias("tag")


def removed_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, tag, spans): byte ranges of each document covered by strings of `length` bytes that also start in a document with a smaller id.

    `tag` is of the text's checksum, `spans` an array of (from, to) that may overlap and end behind the text.
    """
    settle(documents.sparkSession)
    texts = _texts(documents, length)
    named = texts.mapInArrow(_name_anchors(length, gram), ANCHORS).repartition("a")
    # The 16 bytes and all around them. One exchange serves these rounds; copies within a batch do not go to its group.
    pair, single = Window.partitionBy("a", "b"), Window.partitionBy("a")
    ranked = (
        named.withColumn("first", F.min("doc").over(pair))
        .withColumn("low", F.min("doc").over(single))
        .withColumn("high", F.max("doc").over(single))
        .where("covered or low < high")
    )
    # Longer strings after and before the anchor, of what no earlier document has with all around it. The further a string
    # is found with other surroundings too, the further a window may reach: at most to the next step.
    bits = lambda shift: F.shiftright("b", shift).bitwiseAND(31)
    sides = ranked.withColumn("covered", F.col("covered") | (F.col("doc") > F.col("first"))).select(
        "a", "b", "doc", "loc", "covered", *[bits(25 - 5 * k).alias(f"x{k}") for k in range(3)], *[bits(10 - 5 * k).alias(f"y{k}") for k in range(3)]
    )

    def reach(side: str) -> Column:
        """The bytes beyond the anchor's 16 that a window may have on this side."""
        out = F.lit(STEPS[0] - 1)
        for k in range(3):
            held = Window.partitionBy("a", *[f"{side}{j}" for j in range(k + 1)])
            out = F.when(F.min("b").over(held) < F.max("b").over(held), STEPS[k + 1] - 1 if k < 2 else length - gram).otherwise(out)
        return out

    reached = sides.withColumn("least", F.lit(length - gram) - reach("x")).withColumn("most", reach("y"))
    # Windows start `least` to `most` bytes before the anchor; a repeated anchor's code has them the wrong way round.
    code = _place() * 4096 + F.when(F.col("covered"), 63 * 64).otherwise(F.col("least") * 64 + F.col("most"))
    anchored = cut(reached.where("covered or least <= most").select("doc", _of_text(), _place(), "covered", code.alias("coded")))
    # 25 + 25 bytes, for the windows left open.
    open_ = anchored.groupBy("doc", "tag").agg(F.collect_list("coded").alias("coded"), F.bool_and("covered").alias("done")).where("not done").drop("done")
    asked = texts.withColumn("tag", _tag("raw")).join(open_, ["doc", "tag"]).select("doc", "raw", "coded")
    windows = asked.mapInArrow(_name_windows(length, gram), WINDOWS).repartition("a")
    same = Window.partitionBy("a", F.shiftrightunsigned("loc", 44))
    repeated = cut(windows.withColumn("first", F.min("doc").over(same)).where("covered or doc > first").select("doc", _of_text(), _place()))
    span = lambda rows, back: rows.select("doc", "tag", F.greatest(F.col("place") - back, F.lit(0)).alias("from"), (F.col("place") + length).alias("to"))
    spans = span(anchored.where("covered"), length - gram).unionByName(span(repeated, 0))
    return spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def _keep(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    """Adds kept (bytes left, or the characters among them), n_bytes, n_removed and n_spans to rows with raw and spans."""
    for batch in batches:
        kept, sizes, removed, runs = [], [], [], []
        spans = batch.column("spans")
        for k, text in enumerate(batch.column("raw")):
            raw = text.as_py()
            own = spans[k]
            if own.is_valid and len(own):
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, own.values.field("from").to_numpy(), 1)
                np.add.at(change, np.minimum(own.values.field("to").to_numpy(), len(raw)), -1)
                out = np.cumsum(change[:-1]) > 0
                runs.append(int(out[0]) + int((out[1:] & ~out[:-1]).sum()))
                removed.append(int(out.sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
            else:
                runs.append(0)
                removed.append(0)
                kept.append(raw)
            sizes.append(len(raw))
        own_columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("raw", "spans")]
        names = [name for name in batch.schema.names if name not in ("raw", "spans")]
        left = pa.array([raw.decode("utf-8", "ignore") for raw in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        new = [left, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())]
        yield pa.RecordBatch.from_arrays([*own_columns, *new], [*names, "kept", "n_bytes", "n_removed", "n_spans"])


def _judged(documents: DataFrame, length: int, as_text: bool) -> DataFrame:
    """The columns of `documents` but text, under names with _in_ before them; kept, n_bytes, n_removed and n_spans."""
    mine = {c: f"_in_{c}" for c in documents.columns if c != "text"}
    spans = removed_spans(documents, length)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    base = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()], raw).withColumn("_tag", _tag("raw"))
    same = (base["_in_doc_id"].cast("long") == spans["doc"]) & (base["_tag"] == spans["tag"])
    joined = base.join(spans, same, "left").select(*mine.values(), "raw", "spans")
    schema = T.StructType(list(joined.drop("raw", "spans").schema.fields))
    for name, kind in (("kept", "string" if as_text else "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(lambda batches: _keep(batches, as_text), schema)


def deduplicated(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """`documents` (doc_id, text, ...) without text, plus kept (binary), n_bytes, n_removed and n_spans.

    Removed is each byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id, judged on
    the input. Texts are UTF-8 bytes as a whole, null ones empty; texts shorter than `length` and rows without doc_id keep
    everything. Rows with the same doc_id are not smaller than each other, so repeated rows take nothing from one another.
    An empty table gives no rows; other columns pass through, but for those named like the new ones.
    """
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    done = _judged(documents, length, as_text=False)
    return done.select(*[F.col(f"_in_{c}").alias(c) for c in documents.columns if c not in ("text", *new)], *new)


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    done = deduplicated(documents.select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def with_repeats_removed(documents: DataFrame) -> DataFrame:
    """`documents` with the kept text, all columns kept; n_chars follows it. Parts of a character left at a cut go too; null texts come back empty."""
    done = _judged(documents, LENGTH, as_text=True)
    own = {"text": F.col("kept")}
    if "n_chars" in documents.columns:
        own["n_chars"] = F.length("kept").cast(documents.schema["n_chars"].dataType)
    return done.select(*[(own[c] if c in own else F.col(f"_in_{c}")).alias(c) for c in documents.columns])


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """report() by a table of all strings, for tests on small tables of distinct ids."""
    raw = {doc: (text or "").encode() for doc, text in rows}
    first: dict[bytes, int] = {}
    for doc in sorted(raw):
        for i in range(len(raw[doc]) - length + 1):
            first.setdefault(raw[doc][i : i + length], doc)
    out = {}
    for doc, data in raw.items():
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[doc] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out
