"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The units are characters as they are, all of Unicode, so the model grows with the corpus and is never held in one place: counts,
continuation counts, discounts and back-off weights are Spark aggregations and joins, dealt out by n-gram or context. Documents
are read in blocks; a block asks for each of its different n-grams once, however many documents hold it, the answers are joined
by n-gram, and come back to the block as one list in the order in which it finds its n-grams again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm.common import cut, settle
from alertweave.session import Scratch

ORDER = 4
#: Every code point, and what stands before a text's start.
SYMBOLS = 0x110001
EDGE = 0x110000
#: Bits of a symbol; a context is the number made of its symbols, the last one lowest.
BITS = 21
#: Characters and documents after which a block ends; a document is never cut.
BLOCK = 8_000_000
BLOCK_ROWS = 20_000
#: So many different symbols give n-grams that fit 64 bits.
DENSE = 65_535
#: A document's perplexity is that of its text and so many further characters of its language's mean.
STEADY = 40
QUANTILE = 0.995
#: The threshold is so many times the quantile: trusted samples of a small language end below its clean texts.
MARGIN = 1.25
BLOCKS = "block long, ids array<long>, langs array<string>, sizes array<long>, n_bytes long, texts binary"


def symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _before(units: np.ndarray, starts: np.ndarray, sizes: np.ndarray, back: int) -> np.ndarray:
    """The symbol so many places back, for texts that lie one after the other; EDGE before a text's start."""
    before = np.concatenate([np.full(min(back, len(units)), EDGE, np.uint32), units[: len(units) - back]]) if back else units
    for k in range(back):
        before[starts[sizes > k] + k] = EDGE
    return before


def _distinct(history: list[np.ndarray], placed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, last symbols, which of these each place has): the n-grams, in an order that depends on the texts only.

    `history` has the symbols, those one before, two before, and so on; the places are told where `placed`.
    """
    seen = np.zeros(SYMBOLS, bool)
    for units in history:
        seen[units] = True
    alphabet = np.flatnonzero(seen)
    if len(alphabet) > DENSE:
        half = len(history[0]) // 2
        (a, b, at), (c, d, more) = _distinct([h[:half] for h in history], placed), _distinct([h[half:] for h in history], placed)
        return np.concatenate([a, c]), np.concatenate([b, d]), np.concatenate([at, more + len(a)])
    number = np.zeros(SYMBOLS, np.uint64)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    size = np.uint64(max(len(alphabet), 1))
    value = np.zeros(len(history[0]), np.uint64)
    while history:
        value *= size
        value += number[history.pop()]
    found = np.unique(value)
    at = np.searchsorted(found, value if placed else value[:0])  # several times as fast as what unique gives
    parts = []
    for _ in range(ORDER):
        parts.append(alphabet[(found % size).astype(np.int64)].astype(np.int64) if len(found) else np.zeros(0, np.int64))
        found = found // size
    context = reduce(lambda sum_, part: (sum_ << BITS) | part, parts[:0:-1], np.zeros(len(parts[0]), np.int64))
    return context, parts[0].astype(np.int32), at


def grams(units: np.ndarray, sizes: np.ndarray, placed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, last symbols, which of these each place has) of texts of these sizes that lie one after the other."""
    starts = np.cumsum(sizes) - sizes
    return _distinct([_before(units, starts, sizes, back) for back in range(ORDER)], placed)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    names = ["block", "ids", "langs", "sizes", "n_bytes", "texts"]
    ids, langs, texts, held, number = [], [], [], 0, TaskContext.get().partitionId() << 32

    def block() -> pa.RecordBatch:
        raw = "".join(texts).encode("utf-8", "surrogatepass")
        row = [number, ids, langs, [len(t) for t in texts], len(raw), pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    for batch in batches:
        for doc, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
            ids.append(doc)
            langs.append(lang)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= BLOCK or len(ids) >= BLOCK_ROWS:
                yield block()
                ids, langs, texts, held, number = [], [], [], 0, number + 1
    if ids:
        yield block()


def blocks_of(documents: DataFrame) -> DataFrame:
    """`documents` (doc_id, text, lang) in blocks (BLOCKS), stored, as their numbers are those of the tasks that read them."""
    settle(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang") if "lang" in documents.columns else F.lit(None).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(_blocked, BLOCKS))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(row["texts"], row["n_bytes"], asbytes=True) if row["n_bytes"] else b""
    return symbols(raw.decode("utf-8", "surrogatepass")), np.array(row["sizes"], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the n-grams of the chosen documents of a block occur."""
    for row in _rows(batches):
        units, sizes = _unpacked(row)
        chosen = np.zeros(len(sizes), bool)
        chosen[row["chosen"]] = True
        context, symbol, at = grams(units[np.repeat(chosen, sizes)], sizes[chosen])
        yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(symbol), pa.array(np.bincount(at, minlength=len(context)))], ["context", "symbol", "n"])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        context, symbol, _ = grams(*_unpacked(row), placed=False)
        columns = [pa.array(np.full(len(context), row["block"])), pa.array(np.arange(len(context), dtype=np.int32)), pa.array(context), pa.array(symbol)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "place", "context", "symbol"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and place to one list a block."""
    now, parts = None, []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["block", "answers"])

    for batch in batches:
        blocks, answers = batch.column("block").to_numpy(), batch.column("log_p").to_numpy()
        ends = [*np.flatnonzero(np.diff(blocks)) + 1, len(blocks)] if len(blocks) else []
        for begin, end in zip([0, *ends], ends, strict=False):
            if blocks[begin] != now:
                if parts:
                    yield told()
                now, parts = blocks[begin], []
            parts.append(answers[begin:end].astype(np.float32))
    if parts:
        yield told()


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        units, sizes = _unpacked(row)
        sums = np.zeros(len(sizes))
        if len(units):
            each = np.frombuffer(row["answers"], np.float32)[grams(units, sizes)[2]]
            some = sizes > 0
            sums[some] = -np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some], dtype=np.float64)
        columns = [pa.array(row["ids"], pa.int64()), pa.array(row["langs"], pa.string()), pa.array(sizes), pa.array(sums)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "n_symbols", "nll"])


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts; halves where a small corpus has none."""
    n = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def _suffix(order: int) -> Column:
    """The last order - 1 symbols of a context."""
    return F.col("context").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1).cast("long"))


@dataclass
class QualityModel:
    """seen: per order, (context, symbol, p) of n-grams seen, less the discount; backs: (context, weight) of their contexts."""

    seen: dict[int, DataFrame]
    backs: dict[int, DataFrame]

    def log_ps(self, asked: DataFrame) -> DataFrame:
        """(context, symbol, log_p) of distinct n-grams (context, symbol), seen or not: joined order after order."""
        below = None
        for order in range(1, ORDER + 1):
            here = asked.select(_suffix(order).alias("context"), "symbol")
            here = here.distinct() if order < ORDER else here
            told = here.join(self.seen[order].hint("merge"), ["context", "symbol"], "left").join(self.backs[order].hint("merge"), "context", "left")
            lower = F.lit(1 / SYMBOLS)
            if below is not None:
                told = told.withColumn("_short", _suffix(order - 1)).join(below.hint("merge"), ["_short", "symbol"])
                lower = F.col("_lower")
            p = F.coalesce("p", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * lower
            below = told.select(F.col("context").alias("_short"), "symbol", p.alias("_lower"))
        return below.select(F.col("_short").alias("context"), "symbol", F.log("_lower").cast("float").alias("log_p"))

    @property
    def log_p(self) -> np.ndarray:
        """Of every symbol at a text's start."""
        start = sum(EDGE << BITS * k for k in range(ORDER - 1))
        spark = self.seen[ORDER].sparkSession
        asked = spark.range(SYMBOLS).select(F.lit(start).cast("long").alias("context"), F.col("id").cast("int").alias("symbol"))
        return self.log_ps(asked).orderBy("symbol").toPandas().log_p.to_numpy()


def fit(blocks: DataFrame, trusted: DataFrame) -> QualityModel:
    """The model of all documents of `blocks` whose id is in `trusted` (doc_id). Without any, every symbol is equally likely."""
    # Ids grow with the corpus, so they are never broadcast, whatever the size of this one.
    ids = trusted.select(F.col("doc_id").cast("long").alias("id")).distinct().hint("merge")
    places = blocks.select("block", F.posexplode("ids").alias("place", "id")).join(ids, "id", "left_semi")
    chosen = places.groupBy("block").agg(F.collect_list("place").alias("chosen")).hint("merge")
    counted = blocks.select("block", "sizes", "n_bytes", "texts").join(chosen, "block").mapInArrow(_count, "context long, symbol int, n long")
    counts = cut(counted.groupBy("context", "symbol").agg(F.sum("n").alias("n")))
    seen, backs = {}, {}
    for order in range(ORDER, 0, -1):
        one, two, more = _discounts(counts)
        less = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        totals = cut(counts.groupBy("context").agg(F.sum("n").alias("total"), F.sum(less).alias("held")))
        backs[order] = totals.select("context", (F.col("held") / F.col("total")).alias("weight"))
        seen[order] = counts.withColumn("less", less).join(totals.hint("merge"), "context").select(
            "context", "symbol", (F.greatest(F.col("n") - F.col("less"), F.lit(0.0)) / F.col("total")).alias("p"))
        if order > 1:
            # Orders below the highest count in how many different contexts an n-gram continues.
            counts = cut(counts.select(_suffix(order - 1).alias("context"), "symbol").groupBy("context", "symbol").agg(F.count(F.lit(1)).alias("n")))
    return QualityModel(seen, backs)


def train(spark: SparkSession, documents: DataFrame, trusted: DataFrame) -> QualityModel:
    """Fit on all documents (doc_id, text) whose id is in `trusted` (doc_id)."""
    return fit(blocks_of(documents), trusted)


def scored(blocks: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, lang, n_symbols, nll) of each document of `blocks`: its characters and the sum of their negative log probabilities."""
    with Scratch() as held:
        asked = cut(blocks.select("block", "sizes", "n_bytes", "texts").mapInArrow(_ask, "block long, place int, context long, symbol int"))
    told = model.log_ps(asked.select("context", "symbol").distinct())
    answers = asked.join(told.hint("merge"), ["context", "symbol"]).select("block", "place", "log_p")
    lists = cut(answers.repartition("block").sortWithinPartitions("block", "place").mapInArrow(_listed, "block long, answers binary"))
    held.drop(blocks.sparkSession)
    return blocks.join(lists.hint("merge"), "block", "left").mapInArrow(_score, "doc_id long, lang string, n_symbols long, nll double")


def classify(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, keep) for every row of `documents` (doc_id, text, lang).

    Trusted are documents that `labels` (doc_id, quality, toxic) calls good (quality 1) and not toxic. Perplexity is per
    symbol of the whole text, steadied by 40 symbols of the language's mean, which matters for texts of a line or less. A
    document is kept if it is not above its language's threshold, `margin` times the `quantile` of its trusted documents; a language without
    any (or null) takes that of all trusted documents, and without those everything with a text is kept. Null and empty texts
    have no perplexity and are not kept. Repeated rows get equal answers; an empty table gives no rows; other columns are not read.

    The quantile is approximate to 1 part in 10 000 of the ranks.
    """
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) <> 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    blocks = blocks_of(documents)
    rows = cut(scored(blocks, fit(blocks, trusted)))
    good = rows.join(trusted, "doc_id", "left_semi").where("n_symbols > 0")
    means = good.groupBy("lang").agg((F.sum("nll") / F.sum("n_symbols")).alias("mean"))
    mean_all = good.agg((F.sum("nll") / F.sum("n_symbols")).alias("mean_all"))
    steadied = F.exp((F.col("nll") + STEADY * F.col("usual")) / (F.col("n_symbols") + STEADY))

    def with_usual(df: DataFrame) -> DataFrame:
        joined = df.withColumn("_lang", F.col("lang")).join(F.broadcast(means.withColumnRenamed("lang", "_of")), F.col("_lang").eqNullSafe(F.col("_of")), "left")
        usual = mean_all.first()["mean_all"]
        return joined.withColumn("usual", F.coalesce("mean", F.lit(usual), F.col("nll") / F.greatest("n_symbols", F.lit(1)))).withColumn("perplexity", F.when(F.col("n_symbols") > 0, steadied))

    at = F.percentile_approx("perplexity", quantile, 10_000)
    judged = with_usual(good)
    bounds = judged.groupBy("lang").agg((margin * at).alias("bound"))
    bound_all = judged.agg((margin * at).alias("b")).first()["b"]
    full = with_usual(rows).join(F.broadcast(bounds.withColumnRenamed("lang", "_have")), F.col("lang").eqNullSafe(F.col("_have")), "left")
    threshold = F.coalesce("bound", F.lit(bound_all).cast("double"))
    keep = (F.col("n_symbols") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return full.withColumn("threshold", threshold).select("doc_id", "lang", "n_symbols", "perplexity", "threshold", keep.alias("keep"))
