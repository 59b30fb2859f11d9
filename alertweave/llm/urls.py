"""URL filter: rules first, then naive Bayes over host words found by segmentation and path words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import cut, settle

#: (host, path, verdict); a rule's name is host + path.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
#: Host words that mark a page as unwanted when the classifier is trained.
SEEDS = frozenset("ads adult banner bet bets betting casino cheap click free gambling jackpot loan lottery nude pills poker porn promo sex slots spam track tracker viagra win xxx".split())
#: Bounds of the broadcast tables: the most frequent words and tokens of all pages.
LEXICON = 50_000
FEATURES = 100_000
LONGEST = 24

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    pick = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(pick(1), UPPER, LOWER), pick(2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null if none does. A rule covers its host and its subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


@dataclass
class Segmenter:
    """Unigram word model; unknown strings cost as one word with a penalty for every letter."""

    log_p: dict[str, float]
    unknown: float

    def split(self, name: str) -> list[str]:
        """The likeliest cut of a run of letters into words (Viterbi); of equal ones the one with longer last words."""
        best = [0.0] + [-math.inf] * len(name)
        back = [0] * (len(name) + 1)
        get = self.log_p.get
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                cost = get(word)
                score = best[start] + (cost if cost is not None else self.unknown - 3.0 * len(word))
                if score > best[end]:
                    best[end], back[end] = score, start
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


@dataclass
class UrlModel:
    segmenter: Segmenter
    prior: float
    odds: dict[str, float]

    def __post_init__(self):
        self.host_words = lru_cache(20_000)(self._host_words)

    def __getstate__(self):
        return self.segmenter, self.prior, self.odds

    def __setstate__(self, state):
        self.segmenter, self.prior, self.odds = state
        self.__post_init__()

    def _host_words(self, host: str) -> tuple[str, ...]:
        """Words of the host's labels but the last; `www` and the like are words as any."""
        return tuple(w for run in re.findall(r"[^\W\d_]+", host.rpartition(".")[0]) for w in self.segmenter.split(run))

    def tokens(self, host: str, path: str) -> list[str]:
        return [f"h:{w}" for w in self.host_words(host)] + [f"p:{w}" for w in re.findall(r"[^\W\d_]+", path.lower())]

    def log_odds(self, host: str, path: str) -> float:
        """Of block against allow; tokens that were not seen say nothing."""
        return self.prior + sum(self.odds.get(t, 0.0) for t in self.tokens(host, path))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of visible text in small letters, summed for this batch; words of capitals or with digits are left out."""
    from collections import Counter

    tags = re.compile(r"<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>", re.S | re.I)
    for batch in batches:
        count: Counter[str] = Counter()
        for html in batch.column("html"):
            count.update(w for w in re.findall(r"[^\W\d_]+", tags.sub(" ", html.as_py() or "").lower()) if len(w) <= LONGEST)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])


def _frequent(counts: DataFrame, most: int) -> list:
    """The rows with the highest n, at most `most`; of those that are equal where this cuts, none. No task sends more than it has of them."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(most).collect()
    held, least = 0, None
    for row in sizes:
        held += row.k
        if held > most:
            break
        least = row.n
    return counts.where(F.col("n") >= least).collect() if least is not None else []


def learn_words(pages: DataFrame, most: int = LEXICON) -> Segmenter:
    """Word frequencies of all pages' texts, the seeds included; the `most` most frequent words are kept."""
    settle(pages.sparkSession)
    counts = pages.select("html").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = {row.word: row.n for row in _frequent(counts, most)}
    # Host names are made of words that texts may lack.
    for word in SEEDS:
        top[word] = max(top.get(word, 0), 1 + total // 100_000)
    whole = total + len(top) + 1
    return Segmenter({w: math.log((n + 1) / whole) for w, n in top.items()}, -math.log(whole))


def train(pages: DataFrame, most: int = FEATURES, smoothing: float = 0.1) -> UrlModel:
    """Fit on all urls: those with a seed among their host's words are the block class, the others the allow class."""
    model = UrlModel(learn_words(pages), 0.0, {})
    shared = pages.sparkSession.sparkContext.broadcast(model)
    host, path = parts(F.col("url").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            sums: Counter[tuple[bool, str]] = Counter()
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                bad = not SEEDS.isdisjoint(shared.value.host_words(h))
                sums.update((bad, t) for t in ["", *shared.value.tokens(h, p)])
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(sums.values()), pa.int64())], ["bad", "token", "n"])

    rows = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").mapInArrow(count, "bad boolean, token string, n long")
    bad = F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("bad")
    good = F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n"))), F.lit(0)).alias("good")
    counts = cut(rows.groupBy("token").agg(bad, good, F.sum("n").alias("n")))
    sums = counts.where("token <> ''").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("kinds")).first()
    pages_of = counts.where("token = ''").first()
    top = _frequent(counts.where("token <> ''"), most)
    if not top:
        return model
    kinds = smoothing * sums.kinds
    model.odds = {r.token: math.log((r.bad + smoothing) / (sums.bad + kinds)) - math.log((r.good + smoothing) / (sums.good + kinds)) for r in top}
    model.prior = math.log((pages_of.bad + smoothing) / (pages_of.good + smoothing))
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of `pages` (page_id, url, html).

    The longest rule that fits decides; otherwise the classifier, whose log odds of block are `score`: above 0 blocks. Urls that
    are null or have no :// have empty host and path and are allowed, as nothing speaks against them. Repeated rows get equal
    answers, an empty table gives no rows, other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(pages))
    host, path = parts(F.col("url").cast("string"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            odds = [shared.value.log_odds(h, p) if h else None for h, p in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64())], [*batch.schema.names, "score"])

    scored = ruled.mapInArrow(score, "page_id long, host string, path string, rule string, ruled string, score double")
    by_score = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), "score")
