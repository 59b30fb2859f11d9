"""Periodic runs against a search of all periods and stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from alertweave.llm import runs


def all_runs(words, least):
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                stretch = words[i : i + length]
                smaller = any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q))
                if not smaller:
                    found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_force(doc, text, planted=True, least=12):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if planted and doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words, least)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts():
    r = random.Random(11)
    out = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "a " * 400, "a b " * 6, "a b c d e f " * 2, "a b c d e f g " * 2 + "x", "a b a a b a b a a b a a b a b a a b a b"]
    out += ["é ß a " * 9, "z" * 100_000 + " " + "q w " * 20, "one two three four five six seven " * 3 + "eight " + "one two three four five six seven " * 3]
    for k in range(90):  # few letters, so that runs overlap and nest
        letters = "ab" if k % 2 else "abc"
        block = [r.choice(letters) for _ in range(r.randint(1, 14))]
        words = []
        for _ in range(r.randint(1, 12)):
            words += block * r.randint(1, 6) if r.random() < 0.6 else [r.choice(letters) for _ in range(r.randint(1, 9))]
        out.append(" ".join(words))
    for _ in range(120):
        out.append(r.choice([" ", "\n", " \t "]).join(f"w{r.randrange(4000)}" for _ in range(r.randint(1, 150))))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=lambda x: (x[0] is None, str(x)))


def test_runs_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += [(7, rows[20][1]), (7, rows[20][1]), (None, rows[30][1]), (None, None)]
    df = spark.createDataFrame([(d, t, 1, "x", [1]) for d, t in rows], "doc_id long, text string, start long, collapsed string, runs array<int>").repartition(3)
    got = runs.digests(runs.detect(df, planted=True))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_force(*row) for row in rows]
    assert key(got.collect()) == key(want)
    assert sum(w[1] for w in want) > 100 and any(w[1] > 3 for w in want)


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_other_lengths(spark, least):
    rows = list(enumerate(texts()[3:70]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = runs.digests(runs.detect(df, least=least))
    assert key(got.collect()) == key([brute_force(d, t, False, least) for d, t in rows])


def test_spans_and_texts(spark):
    df = spark.createDataFrame([(1, "so we go " + "on and on " * 5 + "then stop")], "doc_id long, text string")
    row = runs.detect(df).first()
    assert row.n_words == 20 and [tuple(r) for r in row.runs] == [(3, 15, 3)]
    assert row.collapsed == "so we go on and on then stop"


def test_slices_split_like_the_whole(monkeypatch):
    text = " ".join(f"w{k % 37}\n" for k in range(5000)) + "é" * 300
    whole = runs.Words().ids(text)
    monkeypatch.setattr(runs, "SLICE", 64)
    assert np.array_equal(runs.Words().ids(text), whole)


def test_one_long_periodic_document(spark):
    words = [f"w{k}" for k in range(40_000)]
    df = spark.createDataFrame([(2, "a " * 200_000), (3, " ".join(words * 4))], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.detect(df).collect()}
    assert [tuple(r) for r in got[2].runs] == [(0, 200_000, 1)] and got[2].collapsed == "a"
    assert [tuple(r) for r in got[3].runs] == [(0, 160_000, 40_000)] and got[3].collapsed == " ".join(words)


def test_runs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert runs.digests(runs.detect(df)).collect() == []
