"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertweave.llm.common import settle

UNKNOWN = "und"
BITS = 15
ORDERS = (1, 2, 3)
CHUNK = 1 << 18

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def _segments(texts: list[str | None]) -> Iterator[tuple[list[int], str]]:
    """Texts packed into strings of about CHUNK characters, each text between line feeds; a longer text is cut after every CHUNK characters."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), CHUNK):
            part = text[at : at + CHUNK].lower()
            if held and held + len(part) > CHUNK:
                yield rows, "\n".join(parts)
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(part.replace("\n", " "))
            held += len(part) + 1
    if rows:
        yield rows, "\n".join(parts)


def _hashed(text: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the hashed n-gram starting at each character (-1 if it has no letter or crosses a text's end); text number and letter flag of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(codes)
    part = np.cumsum(codes == 10)
    plain = np.where(letter, codes, np.uint32(32))
    grams: list[np.ndarray] = []
    value = np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        shifted = plain[order - 1 :]
        n = len(shifted)
        value = value[:n] * np.uint32(0x01000193) + shifted
        if order in ORDERS:
            bucket = (((value + np.uint32(order)) * np.uint32(2654435769)) >> np.uint32(32 - BITS)).astype(np.int32)
            # One n-gram counts if it holds a letter at either end and lies in one text.
            fits = (letter[:n] | letter[order - 1 :]) & (part[:n] == part[order - 1 :])
            grams.append(np.where(fits, bucket, -1))
    return grams, part, letter


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to (lang, bucket, n): n-grams of what this task has read; bucket -1 counts texts."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in set(langs):
            own = [t for t, have in zip(texts, langs, strict=True) if have == lang]
            sums = totals.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
            sums[-1] += len(own)
            for _, joined in _segments(own):
                for gram in _hashed(joined)[0]:
                    sums[:-1] += np.bincount(gram[gram >= 0], minlength=1 << BITS)
    for lang, sums in totals.items():
        bucket = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(bucket), pa.string()), pa.array(np.where(bucket == 1 << BITS, -1, bucket), pa.int32()), pa.array(sums[bucket])],
            ["lang", "bucket", "n"],
        )


@dataclass
class LanguageModel:
    """log_p has a row for each hashed n-gram and a column for each language; its size is languages x 2^BITS."""

    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Most likely language of each text and its posterior probability; `und` and 0 for null or letterless texts."""
        scores = np.zeros((len(texts), len(self.languages)))
        lettered = np.zeros(len(texts), bool)
        for rows, joined in _segments(texts):
            grams, part, letter = _hashed(joined)
            rows_of = np.asarray(rows)
            starts = np.searchsorted(part, np.arange(len(rows)))
            starts[1:] += 1  # the line feed before a text counts to no text
            lettered[rows_of[np.flatnonzero(np.bincount(part, letter, len(rows)))]] = True
            for gram in grams if self.languages else []:
                # A text's n-grams are summed between its start and the next one's; the zero row stands for what counts nothing.
                at = np.minimum(starts, len(gram))
                sums = np.add.reduceat(self.log_p[np.append(gram, -1)], at, axis=0)
                np.add.at(scores, rows_of, np.where((np.diff(at, append=len(gram)) > 0)[:, None], sums, 0))
        scores += self.prior
        top = scores.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        known = lettered & bool(self.languages)
        if self.languages:
            posterior = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        else:
            posterior = np.zeros(len(texts))
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(top, known, strict=True)], np.where(known, posterior, 0.0)


def train(labelled: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Fit on every row of `labelled` (text, lang), rows without either left out.

    Each task sums its own rows, Spark adds the sums up by (language, bucket); the driver gets one number for each of them,
    which is bounded by languages x 2^15 however large the corpus. An empty table gives a model that knows no language.
    """
    settle(labelled.sparkSession)
    seen = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = seen.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts.lang.unique())
    where = {lang: k for k, lang in enumerate(languages)}
    sums = np.zeros(((1 << BITS) + 1, len(languages)))
    sums[counts.bucket.to_numpy(), counts.lang.map(where).to_numpy(int)] = counts.n.to_numpy()
    texts, grams = sums[-1], sums[:-1] + smoothing
    log_p = np.vstack([np.log(grams / grams.sum(axis=0)), np.zeros((1, len(languages)))]).astype(np.float32)
    return LanguageModel(languages, np.log(texts / max(texts.sum(), 1)), log_p)


def identify(df: DataFrame, model: LanguageModel, keep_text: bool = True) -> DataFrame:
    """`df` (with a text column, returned only if asked for) plus lang_pred and score. The model is broadcast; rows are scored where they are read.

    Only `text` decides. Null, empty and letterless texts are `und` with score 0; with a model that knows no language every
    text is. Equal texts get equal answers, other columns pass through whatever their names.
    """
    settle(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in df.schema.fields if f.name not in ("lang_pred", "score")]
    kept = df.select(*[F.col(f"`{f.name}`") for f in fields])
    names = [f.name for f in fields if keep_text or f.name != "text"]
    schema = T.StructType([f for f in fields if f.name in names]).add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column("text").to_pylist())
            columns = [*map(batch.column, names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    return kept.mapInArrow(score, schema)


def held_out(df: DataFrame, folds: int = 5) -> DataFrame:
    """`df` plus held_out: crc32 of doc_id's text is a multiple of `folds`; false where doc_id is null."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return df.withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))


def predict_documents(documents: DataFrame) -> tuple[DataFrame, LanguageModel]:
    """Learn from the documents that are not held out, predict all of them: (doc_id, held_out, lang_pred, score)."""
    marked = held_out(documents.select("doc_id", "text", "lang"))
    model = train(marked.where("not held_out and doc_id is not null"))
    return identify(marked.select("doc_id", "text", "held_out"), model, keep_text=False), model


def accepted(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `documents` whose language is recognised with at least this probability, all columns kept."""
    model = train(held_out(documents).where("not held_out and doc_id is not null"))
    judged = identify(documents.withColumnsRenamed({c: f"_in_{c}" for c in documents.columns if c != "text"}), model)
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col("text" if c == "text" else f"_in_{c}").alias(c) for c in documents.columns])
