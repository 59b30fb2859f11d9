"""op5: the model counts characters as they are, and equals one computed text by text."""

import random
from collections import Counter

import numpy as np

from alertweave.llm import quality

DOCS = "doc_id long, text string, lang string"
SYLLABLES = {"ru": "на то ре ко ла ми сту пра во де".split(), "zh": "我们 今天 去 公园 看见 小 鸟 唱歌 河水 桥".split(), "en": "Ri ver sto ne 12 wal ks un der BR".split()}


def prose(lang, seed, n=120):
    r, known = random.Random(seed), SYLLABLES[lang]
    return " ".join(r.choice(known) + known[(known.index(r.choice(known)) + 1) % len(known)] for _ in range(n))


def by_hand(trusted, texts):
    """Sums of negative log probabilities under the same model, from dictionaries."""
    def grams(text):
        padded = [quality.EDGE] * (quality.ORDER - 1) + [ord(c) for c in text]
        return [tuple(padded[k : k + quality.ORDER]) for k in range(len(text))]

    counts = Counter(g for text in trusted for g in grams(text))
    levels = []
    for _ in range(quality.ORDER):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        d = (0.5, 0.5, 0.5)
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5)
            d = [min(max(x, 0.05), k + 0.95) for k, x in enumerate(raw)]
        total, held = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3) - 1]
        levels.append((counts, d, total, held))
        counts = Counter(g[1:] for g in counts)

    def p(g, level=0):
        if level == quality.ORDER:
            return 1 / quality.SYMBOLS
        counts, d, total, held = levels[level]
        lower = p(g[1:], level + 1)
        if g[:-1] not in total:
            return lower
        c = counts.get(g, 0)
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * lower

    return [-sum(np.log(p(g)) for g in grams(text)) for text in texts]


def test_scores_equal_a_model_by_hand(spark):
    texts = [prose(lang, k) for lang in SYLLABLES for k in range(8)] + ["", "a", "Ы", "\U0001f600 new", "ab\nab\tAB", prose("zh", 3)]
    rows = [(k, text, "x") for k, text in enumerate(texts)] + [(900, None, "x"), (None, texts[0], None), (3, texts[3], "x")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    trusted = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 8, 9, 10, 16, 17, 18, 24, 25, 777, None, 3)], "doc_id long")
    held = {k for k, in trusted.collect()}
    want = by_hand([t for d, t, _ in rows if d in held and d is not None and t], [t or "" for _, t, _ in rows])
    blocks = quality.blocks_of(df)
    got = quality.scored(blocks, quality.fit(blocks, trusted)).collect()
    pairs = sorted(zip([(d if d is not None else -1, len(t or "")) for d, t, _ in rows], want, strict=True))
    told = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_symbols), r.nll) for r in got)
    assert [k for k, _ in told] == [k for k, _ in pairs]
    assert np.allclose([x for _, x in told], [x for _, x in pairs], rtol=1e-5)


def test_junk_of_other_scripts_goes(spark):
    """Letters of one script, mixed, were as good as prose when all of them were one symbol."""
    clean = [(1000 * n + k, prose(lang, k), lang) for n, lang in enumerate(("ru", "zh", "en")) for k in range(60)]
    def shuffled(text, seed):
        letters = random.Random(seed).sample(text.replace(" ", ""), len(text) - text.count(" "))
        return "".join(c if c == " " else letters.pop() for c in text)

    mixed = [(d + 500, shuffled(text, d), lang) for d, text, lang in clean if d % 1000 < 10]
    capitals = [(5000 + k, "".join(random.Random(k).choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() else c for c in prose("en", k)), "en") for k in range(5)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _, _ in clean if d % 1000 < 50], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(spark.createDataFrame(clean + mixed + capitals, DOCS), labels).collect()}
    assert got == {d: d in {c for c, _, _ in clean} for d, _, _ in clean + mixed + capitals}


def test_any_number_of_symbols(monkeypatch):
    """Where a block's different symbols would not fit, it is looked at in parts: the same n-grams at the same places."""
    units = quality.symbols("".join(chr(0x4E00 + k * 7 % 900) for k in range(3000)) + prose("ru", 1))
    sizes = np.array([0, 5, 1, 0, len(units) - 6, 0])
    context, symbol, at = quality.grams(units, sizes)
    monkeypatch.setattr(quality, "DENSE", 200)
    other, last, place = quality.grams(units, sizes)
    assert (context[at] == other[place]).all() and (symbol[at] == last[place]).all() and (symbol[at] == units).all()
