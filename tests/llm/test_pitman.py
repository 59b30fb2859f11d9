"""The bigram model against a plain sampler that moves one customer at a time, and counts against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from alertweave.llm import pitman

ODD = [None, "", " \n", "Ä Ä ä", "one\x0btwo\x0cthree", "x" * 50_000, "A a"]


def prose(r, n):
    words, out = [f"w{k}" for k in range(60)], []
    at = 0
    for _ in range(n):
        at = (at * 7 + r.choice([1, 1, 1, 2, 3, r.randrange(60)])) % 60
        out.append(words[at] if r.random() < 0.9 else f"rare{r.randrange(400)}")
    return " ".join(out)


def corpus():
    r = random.Random(2)
    return [(k, prose(r, r.randint(1, 80))) for k in range(150)] + [(900 + k, text) for k, text in enumerate(ODD)]


def held_out(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 10 == 0


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


class Plain:
    """Seats one customer after the other, and samples until the average is steady."""

    def __init__(self, texts, discount, parents, seed=1):
        self.r, self.d, self.d0 = random.Random(seed), discount, parents
        self.children, self.parent = {}, {}
        self.known = {w for t in texts for w in t}
        self.customers = [(u, w) for t in texts for u, w in zip([b"\n", *t[:-1]], t, strict=True)]
        for pair in self.customers:
            self.add(*pair)

    def root(self, w):
        tables = sum(map(len, self.parent.values()))
        total = sum(map(sum, self.parent.values()))
        own = self.parent.get(w, [])
        return (sum(own) - self.d0 * len(own) + (1 + self.d0 * tables) / (len(self.known) + 1)) / (1 + total)

    def probability(self, u, w):
        held = self.children.get(u, {})
        own, total = held.get(w, []), sum(map(sum, held.values()))
        tables = sum(map(len, held.values()))
        return (sum(own) - self.d * len(own) + (1 + self.d * tables) * self.root(w)) / (1 + total)

    def sit(self, tables, discount, fresh):
        x = self.r.random() * (fresh + sum(tables) - discount * len(tables))
        for k, size in enumerate(tables):
            x -= size - discount
            if x < 0:
                tables[k] += 1
                return False
        tables.append(1)
        return True

    def leave(self, tables):
        x = self.r.random() * sum(tables)
        for k, size in enumerate(tables):
            x -= size
            if x < 0:
                break
        tables[k] -= 1
        if tables[k] == 0:
            del tables[k]
            return True
        return False

    def add(self, u, w):
        held = self.children.setdefault(u, {})
        fresh = (1 + self.d * sum(map(len, held.values()))) * self.root(w)
        if self.sit(held.setdefault(w, []), self.d, fresh):
            rest = (1 + self.d0 * sum(map(len, self.parent.values()))) / (len(self.known) + 1)
            self.sit(self.parent.setdefault(w, []), self.d0, rest)

    def sweep(self):
        for u, w in self.customers:
            if self.leave(self.children[u][w]):
                self.leave(self.parent[w])
            self.add(u, w)


def test_counts_and_base_equal_brute_force(spark):
    rows = corpus() + [(3, "again w1"), (3, "again w1"), (None, "w1 w2 nowhere")]
    df = spark.createDataFrame([(d, t, "z", 1.0) for d, t in rows], "doc_id long, text string, kind string, score double").repartition(3)
    got = pitman.score(df, burn=1, samples=1)
    assert got.columns == [c.split()[0] for c in pitman.RESULT.split(", ")]
    learnt = Counter(w for d, t in rows if not held_out(d) for w in tokens(t))
    total, known = sum(learnt.values()), len(learnt)
    want = []
    for d, t in rows:
        base = sum(math.log10((learnt[w] + 0.1) / (total + 0.1 * (known + 1))) for w in tokens(t))
        want.append((d, held_out(d), len(tokens(t)), sum(learnt[w] > 0 for w in tokens(t)), total, round(base, 6)))
    have = [(*r[:5], round(r.base_score, 6)) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got.collect())


@pytest.mark.parametrize("shards", [dict(), dict(batch_words=400, shard_pairs=700, shard_words=150)])
def test_scores_follow_the_plain_sampler(spark, monkeypatch, shards):
    rows = [(k, t) for k, t in corpus() if k < 900]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    used = []
    discount = pitman._discount
    monkeypatch.setattr(pitman, "_discount", lambda *few: used.append(discount(*few)) or used[-1])
    got = {r.doc_id: r for r in pitman.score(df, burn=3, samples=4, **shards).collect()}
    model = Plain([tokens(t) for d, t in rows if not held_out(d)], *used)
    sums, samples = Counter(), 30
    pairs = {d: list(zip([b"\n", *tokens(t)[:-1]], tokens(t), strict=True)) for d, t in rows}
    asked = {p for own in pairs.values() for p in own}
    for number in range(10 + samples):
        model.sweep()
        if number >= 10:
            for pair in asked:
                sums[pair] += model.probability(*pair) / samples
    want = {d: sum(math.log10(sums[p]) for p in own) for d, own in pairs.items()}
    held = [d for d, _ in rows if held_out(d)]
    for some in (held, [d for d, _ in rows]):
        mine, plain = sum(got[d].score for d in some), sum(want[d] for d in some)
        assert abs(mine - plain) < 0.01 * abs(plain), (mine, plain)
    assert max(abs(got[d].score - want[d]) / got[d].n_tokens for d, _ in rows) < 0.15
    assert sum(got[d].score for d in held) > sum(got[d].base_score for d in held)


def test_repeated_runs_and_shards_give_the_same_counts(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    one = pitman.score(df, burn=1, samples=2)
    assert sorted(one.collect()) == sorted(pitman.score(df, burn=1, samples=2).collect())
    many = pitman.score(df.repartition(5), batch_words=50, shard_pairs=60, shard_words=40, burn=1, samples=2)
    a, b = ({r.doc_id: r for r in x.collect()} for x in (one, many))
    assert all(a[d][:5] == b[d][:5] and abs(a[d].base_score - b[d].base_score) < 1e-9 for d in a)
    assert all(abs(a[d].score - b[d].score) < 0.6 * a[d].n_tokens for d in a)


def test_reseating_keeps_customers():
    rng = np.random.default_rng(5)
    count_ = np.sort(rng.integers(2, 60, 500))[::-1].copy()
    sizes, tables = count_.copy(), np.ones(500, np.int64)
    context = rng.integers(0, 40, 500)
    held = np.bincount(context, tables, 40).astype(np.int64)
    for _ in range(20):
        sizes, tables = pitman.reseat(rng, sizes, tables, count_, context, held, rng.random(500) / 50, 0.7)
        assert sizes.min() > 0 and tables.min() > 0
        assert np.array_equal(np.add.reduceat(sizes, np.cumsum(tables) - tables), count_)
        assert np.array_equal(held, np.bincount(context, tables, 40))


def test_reseating_samples_the_seating():
    """One pair of three customers in a restaurant of its own: its tables follow the exact distribution."""
    rng, d, base = np.random.default_rng(6), 0.6, 0.3
    n = 4000
    sizes, tables, held = np.full(n, 3), np.ones(n, np.int64), np.ones(n, np.int64)
    for _ in range(12):
        sizes, tables = pitman.reseat(rng, sizes, tables, np.full(n, 3), np.arange(n), held, np.full(n, base), d)
    one, two, three = (1 - d) * (2 - d), 3 * (1 - d) * (1 + d) * base, (1 + d) * (1 + 2 * d) * base**2
    want = np.array([one, two, three]) / (one + two + three)
    assert np.abs(np.bincount(tables, minlength=4)[1:] / n - want).max() < 0.04


@pytest.mark.parametrize("customers", [20, 200])
def test_a_sweep_reseats_every_customer(customers):
    """Pairs start at one table; after some sweeps their tables follow the exact distribution, however many customers they have."""
    rng, d, base = np.random.default_rng(9), 0.6, 0.3
    n = 2000
    sizes, tables, held = np.full(n, customers), np.ones(n, np.int64), np.ones(n, np.int64)
    for _ in range(12):
        sizes, tables = pitman.reseat(rng, sizes, tables, np.full(n, customers), np.arange(n), held, np.full(n, base), d)
    exact = np.zeros(customers + 1)  # of seatings with so many tables, one customer after the other
    exact[1] = 1.0
    k = np.arange(customers + 1)
    for seated in range(1, customers):
        opened = np.concatenate([[0.0], (exact * (1 + d * k) * base)[:-1]])
        exact = exact * np.maximum(seated - d * k, 0) + opened
        exact /= exact.sum()
    mean = (exact * k).sum()
    assert abs(tables.mean() - mean) < 0.05 * mean, (tables.mean(), mean)


def test_parent_seats_everyone_once():
    rng = np.random.default_rng(7)
    customers = np.array([0, 1, 2, 5, 100_000, 3])
    tables = np.mean([pitman.seat(rng, customers, 0.8, 0.5) for _ in range(300)], axis=0)
    assert tables[0] == 0 and tables[1] == 1 and abs(tables[2] - (1 + 0.8 / 1.3)) < 0.1
    assert tables[4] < 100_000 and tables[4] > tables[3]


def test_first_seating_seats_everyone():
    rng = np.random.default_rng(8)
    count_ = np.sort(np.concatenate([rng.integers(2, 300, 700), [50_000]]))[::-1].copy()
    sizes, tables = pitman.first_seating(rng, count_, rng.random(701) * 3, 0.7)
    assert sizes.min() >= 1 and tables.min() >= 1
    assert np.array_equal(np.add.reduceat(sizes, np.cumsum(tables) - tables), count_)
    one, none = pitman.first_seating(rng, np.array([2]), np.array([1e-9]), 0.7), pitman.first_seating(rng, np.zeros(0, int), np.zeros(0), 0.7)
    assert one[0].tolist() == [2] and len(none[0]) == len(none[1]) == 0


def test_scores_of_an_empty_table_and_of_nothing_learnt(spark):
    assert pitman.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    doc = next(d for d in range(100) if held_out(d))
    row = pitman.score(spark.createDataFrame([(doc, "a b")], "doc_id long, text string")).first()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.base_score == 0 and abs(row.score) < 1e-9
