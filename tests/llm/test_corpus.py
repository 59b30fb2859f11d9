"""Corpus operators against brute force, with odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from alertweave.llm import ann, decontaminate, html, language, packing, quality, simhash, suffixes, urls, warc

WORDS = "river stone walks under bright morning while small birds sing above quiet fields near old harbour towns".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, raw string, kept string, a string, fp long, score string"


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ly", "er"]) for _ in range(n))


def corpus():
    base = [prose(k, 40 + 5 * k) for k in range(12)]
    shared = prose(99, 30)
    texts = [*base, base[3], base[3], base[4].replace("river", "canal", 1), base[5] + " " + shared, shared + " " + base[6], shared, prose(7, 20_000)]
    texts += [None, "", " \n\t ", "one", "x" * 49, "y" * 50, "y" * 120, "123 !!", "été à l'ombre ßtraße " * 20, "été à l'ombre ßtraße " * 20 + "fin"]
    return [(100 - 3 * k, text) for k, text in enumerate(texts)]


def frame(spark, rows, lang="en"):
    return spark.createDataFrame([(d, t, lang, "s", len(t or ""), "r", "k", "z", 5, "q") for d, t in rows], DOCS)


def test_simhash_equals_brute_force(spark):
    rows = corpus()
    rows += [(d, t) for d, t in rows[:2]]
    got = sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()))
    assert got == sorted(map(tuple, simhash.brute_force(rows).itertuples(index=False)))


def test_simhash_fingerprint_rule():
    import re

    import xxhash

    for text in [prose(1), "a B c", "A b  c\x0bd e f", "É é Z z q", "", None]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert simhash.fingerprint(text) & (1 << 64) - 1 == want


def test_vantage_trees_lose_no_link(spark):
    random_ = np.random.default_rng(3)
    centres = random_.integers(0, 1 << 63, 60, np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in random_.choice(64, random_.integers(0, 5), replace=False)) for c in centres for _ in range(30)}
    fps = sorted(fps)
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, rep long")
    pairs = simhash.links(classes, sample=512, leaf=8, cell=4).collect()
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None]) <= 4

    def groups(edges):
        parent = list(range(len(fps)))
        for a, b in edges:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        out = []
        for k in range(len(fps)):
            while parent[k] != k:
                k = parent[k]
            out.append(k)
        return out

    assert all(a != b for a, b in pairs)
    assert groups(pairs) == groups(zip(*np.nonzero(near), strict=True))


def test_similar_texts_equal_brute_force(spark):
    r = random.Random(8)
    rows, common = [], prose(500, 14)
    for k in range(60):
        words = [f"{r.choice(WORDS)}{r.randrange(40)}" for _ in range(r.choice([5, 30, 120]))]
        for copy in range(4):
            rows.append((1000 * copy + k, " ".join([*words, common] if k % 3 else words)))
            words[r.randrange(len(words))] = f"other{r.randrange(9)}"
    rows += [(9000 + k, text) for k, text in enumerate([None, "", "a b", "A  b", prose(1, 3), rows[0][1].upper()])]
    own = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    ids = [d for d, _ in rows]
    least = ids[:]
    for _ in rows:
        before = least[:]
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    docs = frame(spark, rows)
    assert dict(simhash.similar_texts(docs).collect()) == dict(zip(ids, least, strict=True))
    assert sorted(x.doc_id for x in simhash.keep_representatives(docs).collect()) == sorted(set(least))
    assert len({x.component_id for x in simhash.near_duplicates(docs).collect()}) > len(set(least))


def test_suffixes_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.report(frame(spark, rows)).collect()}
    assert got == suffixes.brute_force(rows)
    assert sum(r[1] for r in got.values()) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_suffixes_on_repetitive_bytes(spark, seed):
    r = random.Random(seed)
    rows = [(k, "".join(r.choice("ab") * r.randint(1, 25) for _ in range(r.randint(1, 60)))) for k in range(40)]
    got = {x.doc_id: tuple(x)[1:] for x in suffixes.report(frame(spark, rows)).collect()}
    assert got == suffixes.brute_force(rows)


def test_suffixes_repeated_and_null_ids(spark):
    one, other = prose(1), prose(2)
    rows = [(5, one), (5, other), (5, one), (None, one), (7, other)]
    got = sorted((r.doc_id or 0, r.n_removed, r.n_bytes) for r in suffixes.report(frame(spark, rows)).collect())
    assert got == sorted([(5, 0, len(one)), (5, 0, len(other)), (5, 0, len(one)), (0, 0, len(one)), (7, len(other), len(other))])


def test_suffix_stage_keeps_columns(spark):
    rows = corpus()
    df = frame(spark, rows)
    out = suffixes.with_repeats_removed(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert all(r.n_chars == len(r.text) and r.raw == "r" and r.kept == "k" for r in out.collect())


def test_language_learns_and_refuses(spark):
    french = "le petit chat de la maison dort sous une grande table pendant que nous mangeons".split()
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(french if k % 2 else WORDS) for _ in range(30)), "fr" if k % 2 else "en") for k in range(200)]
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "12 !!", "fr"), (None, "le chat", None), (1003, "le chat dort " * 90_000, None)]
    df = spark.createDataFrame([(d, t, g, "q") for d, t, g in rows], "doc_id long, text string, lang string, score string")
    got = {x.doc_id: x for x in language.predict_documents(df)[0].collect()}
    assert len(got) == len(rows)
    assert all(got[d].lang_pred == g for d, _, g in rows[:200])
    assert [(got[d].lang_pred, got[d].score) for d in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == got[1003].lang_pred == "fr" and not got[None].held_out
    assert all(x.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, x in got.items() if d is not None)
    kept = language.accepted(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(got) - {1000, 1001, 1002}


def test_language_without_training(spark):
    df = frame(spark, [(1, "words"), (2, None)], lang=None)
    assert {(x.lang_pred, x.score) for x in language.predict_documents(df)[0].collect()} == {("und", 0.0)}


ITEM = "Every morning the old keeper of the harbour counts 14 boats and writes Anna Miller a letter of 3 pages about the tide"


def test_decontamination_finds_items_and_variants(spark):
    changed = ITEM.replace("14", "27").replace("Anna Miller", "Peter Brook").replace(" 3 ", " 9 ")
    mixed = ITEM.replace("14", "27") + " and again: " + ITEM
    loose = "Numbers 14 and 15. " + prose(3)
    bench = [(1, ITEM), (2, "too short"), (3, "these five words match whole"), (4, None), (5, ""), (1, ITEM)]
    rows = [(10, prose(1) + ". " + ITEM + ". " + prose(2)), (11, prose(4) + "\n" + changed), (12, mixed), (13, loose), (14, "say these five words match whole now"), (15, None), (16, ""), (17, "too short"), (10, ITEM), (None, ITEM), (18, " ".join(w + "***" for w in ITEM.split()))]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.matches(frame(spark, rows), benchmark).collect()}
    assert got == {(10, 1): True, (11, 1): False, (12, 1): got[12, 1], (14, 3): True, (18, 1): True}
    stays = decontaminate.without_leaks(frame(spark, rows), benchmark)
    assert sorted(r.doc_id or 0 for r in stays.collect()) == [0, 13, 15, 16, 17]


def test_inconsistent_slots_are_no_leak(spark):
    item = "take 5 from 9 and add 5 to 9 then halve 5 of the 9"
    same, other = item.replace("5", "6").replace("9", "8"), "take 1 from 2 and add 3 to 4 then halve 7 of the 8"
    got = decontaminate.matches(frame(spark, [(1, same), (2, other)]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [(r.doc_id, r.exact) for r in got.collect()] == [(1, False)]


def test_slot_heavy_items_and_first_words_are_found(spark):
    figures, names, short = "12 + 7 = 19, 3 + 4 = 7, 8 + 9 = 17", "Anna Bell, Carl Dorn, Emma Falk, Gert Horn and Ida Jung", "Seven birds sing above fields"
    rows = [(k, f"{prose(k)} {item} {prose(k + 50)}") for k, item in enumerate((figures, names, short, figures.replace("7", "6"), names.replace("Carl", "Otto")))]
    bench = spark.createDataFrame([(0, figures), (1, names), (2, short)], "item_id long, text string")
    got = decontaminate.matches(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(0, 0), (1, 1), (2, 2)} and all(r.item_id == r.doc_id for r in got if r.doc_id < 3)
    assert {r.doc_id: r.exact for r in got}[0] and (3, 0) not in {(r.doc_id, r.item_id) for r in got}


def test_one_conflict_drops_its_windows_only(spark):
    item = "Then put 5 stones in a box near the river and walk home over many quiet fields until 5 birds sing"
    tom = "Tom has 5 apples. Tom gives 2 apples to Mary. How many apples does Tom have?"
    both = "take 8 of the green stones from under the bridge near the town and leave 3 birds there"
    rows = [(1, item.replace("until 5", "until 6")), (2, tom.replace("Tom", "Bob")), (3, "so we read: " + tom.replace("Tom", "Bob").replace("5", "7")), (4, both.replace("8", "9").replace("3", "9")), (5, item)]
    bench = spark.createDataFrame([(1, item), (2, tom), (3, both)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.matches(frame(spark, rows), bench).collect()}
    assert got == {(1, 1): False, (2, 2): False, (3, 2): False, (4, 3): False, (5, 1): True}


def test_largest_consistent_equals_brute_force():
    r = random.Random(4)
    for _ in range(60):
        windows = [(k, frozenset((r.choice("abc"), r.choice("xyz")) for _ in range(r.randrange(4)))) for k in range(9)]
        best = 0
        for chosen in range(1 << 9):
            pairs = set().union(*(w for k, w in windows if chosen >> k & 1))
            if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                best = max(best, chosen.bit_count())
        held = decontaminate.largest_consistent(windows)
        pairs = set().union(*(w for _, w in held))
        assert len(held) == best and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def test_packing_is_whole_and_gapless(spark):
    path = public_tokenizers.path(packing.TOKENIZER)
    odd = ["don't \x1c   <|endoftext|> İ ΟΔΟΣ ﬁ 12½!!? ..x", "a'b's 's it's.'ll", None, "", prose(7, 9000)]
    rows = [*corpus(), *[(1000 + k, t) for k, t in enumerate(odd)]]
    tokenizer = Tokenizer.from_file(path)
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows}
    got = packing.pack(frame(spark, rows), path).collect()
    sequences, held = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        held.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts, size in [(p, None) for p in sequences.values()] + [(p, len(ids[d])) for d, p in held.items()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == size if size else at <= 2048 and at & (at - 1) == 0
    assert set(held) == set(ids)


def test_sum_of_squares_rule():
    packer = packing.Packer(10)
    piece = lambda n: (0, 0, np.zeros(n, np.uint32), n)
    assert packer.add(piece(4)) is None and packer.levels[4] == 1
    assert packer.add(piece(3)) is None and packer.levels[7] == 1  # 4 -> 7 keeps one window open; a second one costs more
    assert len(packer.add(piece(3))) == 3 and packer.levels.sum() == 0


PAGES = "page_id long, url string, html string, text string, payload string"


def test_warc_round_trip(spark):
    big = "<p>" + "ä word " * 300
    rows = [(k, f"http://h/{k}\n", t) for k, t in enumerate([big, big, "<p>short", "<p>short", None, "", big + "!", "z" * 400_000, "z" * 400_000])]
    rows += [(None, None, big), (-3, None, big + "!"), (2, "again", "<p>short")]
    df = spark.createDataFrame([(*r, "t", "p") for r in rows], PAGES)
    bundles = warc.write(df)
    got = sorted((r.page_id if r.page_id is not None else -99, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(bundles).collect())

    def told(page_id, html):
        raw = (html or "").encode()
        equal = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = len(raw) >= 100 and page_id != min(equal)
        return (page_id if page_id is not None else -99, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(equal) if again else None)

    assert got == sorted((told(p, h) for p, _, h in rows), key=lambda r: tuple(map(str, r))) or sorted(map(str, got)) == sorted(str(told(p, h)) for p, _, h in rows)
    fetched = {r.page_id: bytes(r.payload) for r in warc.fetch(bundles, df.where("page_id in (0, 7)").select("page_id")).collect()}
    assert fetched == {0: big.encode(), 7: b"z" * 400_000}
    reader = warc.BundleReader(bundles.first().content)
    with pytest.raises(ValueError):
        warc.BundleReader(reader.content[:-1])


def test_neighbours_exact_in_small_tables_and_recall(spark):
    r = np.random.default_rng(1)
    data = r.standard_normal((3000, 24)).astype(np.float32)
    data[500:900] = data[0]
    rows = [(int(k), [float(x) for x in v], "q") for k, v in enumerate(data)]
    odd = [(5000, None, "q"), (5100, [], "q"), (None, rows[1][1], "q"), (5200, [0.0] * 24, "q"), (5300, [float("nan")] + [1.0] * 23, "q"), (5400, [None] + [1.0] * 23, "q"), (5500, [1.0], "q"), rows[100]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    got = ann.nearest(df, shard=1000).toPandas()
    want = ann.brute_force(np.arange(3000), data.astype(float))
    both = want.merge(got, on=["query_id", "vec_id"])
    assert len(got) == len(want) and len(both) / len(want) >= 0.9 and np.allclose(both.score_x, both.score_y)
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(500, 510))
    few = ann.nearest(df.where("vec_id < 5")).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3, 4]


def test_quality_separates_junk(spark):
    rows = [(k, prose(k)) for k in range(80)] + [(100 + k, " ".join(f"{w}$$$ &&&" for w in prose(k).split())) for k in range(20)] + [(200, None), (201, ""), (202, "river")]
    labels = spark.createDataFrame([(k, 1, 0 if k else 1) for k in range(60)] + [(100, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(frame(spark, rows), labels).collect()}
    assert got == {d: d < 100 or d == 202 for d, _ in rows}
    untrained = quality.classify(frame(spark, rows), labels.limit(0)).collect()
    assert {r.doc_id for r in untrained if not r.keep} == {200, 201}


def test_quality_probabilities_sum_to_one(spark):
    df = frame(spark, [(k, prose(k)) for k in range(20)])
    model = quality.train(spark, df, df.select("doc_id"))
    assert np.allclose(np.exp(model.log_p.astype(float)).reshape(-1, quality.SYMBOLS).sum(axis=1), 1, atol=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
<div class="cookie-notice">We use cookies</div>{open}<h2>Title &amp; more</h2><p>First  para with <a href=q>a link</a> and <em>em</em>phasis, long enough.</p>
<div class="ad-box">Buy now!</div><script>var t="</p>";</script><p>Second para.<br>Line two &eacute; &#x41;</p><form>Subscribe <input> now</form><p>Last words of the article, a few more.</p>{close}
<div id="comments"><p>Reader says hello there this is long</p></div><aside><p>Related stories</p></aside><footer>&copy; me</footer></body></html>"""
ARTICLE = "Title & more\nFirst para with a link and emphasis, long enough.\nSecond para. Line two é A\nLast words of the article, a few more."


def test_main_text(spark):
    marked, bare = PAGE.format(open="<article>", close="</article>"), PAGE.format(open="<div>", close="</div>")
    rows = [(1, "u", marked), (2, None, bare), (3, "u", None), (4, "u", ""), (5, "u", "plain words"), (None, "u", marked), (6, "u", "<p>" + "word " * 200_000)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame([(*r, "t", "p") for r in rows], PAGES)).collect()}
    assert got[1].text == got[2].text == got[None].text == ARTICLE and got[1].n_chars == len(ARTICLE)
    assert got[3].text == got[4].text == "" and got[5].text == "plain words" and got[6].n_chars == 999_999
    assert html.main_text(bare, html.Weights()) == ARTICLE


def test_best_region_is_the_best(spark):
    r = random.Random(2)
    for _ in range(200):
        scores = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        start, end = html.best_region(scores)
        assert sum(scores[start:end]) == max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])


def test_url_rules_and_classifier(spark):
    rows = [
        (1, "http://Example.COM/en/x?q#f", "block", "example.com/en/"), (2, "http://www.example.com/en/x", "allow", "www.example.com/en/"),
        (3, "http://a.www.example.com/en/", "allow", "www.example.com/en/"), (4, "http://b.example.com/de/", "allow", "com/"), (5, "http://x.net/es/1", "block", "net/es/"),
        (6, "http://casinobets.example.org/en/1", "block", None), (7, "http://riverstone.example.org/en/1", "allow", None), (8, None, "allow", None),
        (9, "no url", "allow", None), (10, "http://com", "allow", None), (11, "http://xnet/es/", "allow", None), (12, "http://n.net/fr/?", "block", "net/fr/"),
    ]
    body = "<p>" + " ".join(WORDS) * 5
    more = [(100 + k, f"http://{w}{v}.example.org/en/{k}", body) for k, (w, v) in enumerate(zip(WORDS, WORDS[1:], strict=False))]
    df = spark.createDataFrame([(k, u, body, "t", "p") for k, u, *_ in rows] + [(*m, "t", "p") for m in more], PAGES)
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [(k, got[k].verdict, got[k].rule) for k, *_ in rows] == [(k, v, rule) for k, _, v, rule in rows]
    assert (got[1].host, got[1].path, got[8].host, got[9].path, got[10].path) == ("example.com", "/en/x", "", "", "")
    assert all(got[k].verdict == "allow" for k, *_ in more)


def test_viterbi_splits_words():
    split = urls.Segmenter({"river": -2.0, "stone": -2.0, "riv": -2.0}, -9.0).split
    assert split("riverstone") == ["river", "stone"] and split("") == [] and split("qq") == ["qq"]


BODY = "<p>" + "word here and there again " * 20 + "</p>"


@pytest.mark.parametrize("opened", ['<div class="layout has-sidebar">', '<main class="no-sidebar">', '<article class="post share-enabled">', '<div class="search-result-article">', '<div class="sidebar-layout">', '<div class="widget-area"><div class="banner">'])
def test_names_do_not_veto_the_frame_of_the_article(opened):
    page = f"<body><nav>a b c</nav>{opened}{BODY}</div></main></article><div class='sidebar'><p>buy this now</p></div></body>"
    assert html.main_text(page, html.Weights()) == ("word here and there again " * 20).strip()


def test_long_comments_and_marked_comments_stay_out():
    page = f"<body><div>{BODY}</div><div class='comments'>{BODY.replace('word', 'reply') * 5}</div></body>"
    assert html.main_text(page, html.Weights()) == ("word here and there again " * 20).strip()
    page = f"<body><main>{BODY}</main><article class='comment'><p>I think so too</p></article></body>"
    assert "think" not in html.main_text(page, html.Weights())


@pytest.mark.parametrize("part", ["<div>", '<div><a "x>', "<div>x</b>", "<span><li>", "<p><span>", "<div class='sidebar'>", "<a \"x'>", '<a "x>y'])
def test_hostile_pages_take_linear_time(part):
    import time

    def seconds(n):
        started = time.process_time()
        html.scan("<b>" + part * n + BODY)
        return time.process_time() - started

    seconds(1000)
    assert seconds(32_000) < 8


def test_many_contested_values_end(spark):
    """One item whose figures meet two values each: a search by recursion would be as deep as they are many."""
    windows = [(k, frozenset({(f"a{k}", "x"), (f"b{k}", f"y{k}")})) for k in range(1200)]
    held = decontaminate.largest_consistent(windows)
    assert len(held) >= 1
    few = [(0, frozenset({("5", "5")})), (1, frozenset({("5", "6")})), (2, frozenset({("5", "5"), ("7", "8")}))]
    assert [pos for pos, _ in decontaminate.largest_consistent(few)] == [0, 2]


def test_stages_take_columns_of_any_name(spark):
    names = ["_first", "_leaked", "_nth", "id", "row", "nth"]
    rows = [(1, prose(1), *"abcdef"), (2, prose(1), *"abcdef"), (3, prose(2) + ". " + ITEM, *"ghijkl"), (None, prose(3), *"mnopqr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r._first, r.nth) for r in kept.collect()) == [(0, "m", "r"), (1, "a", "f"), (3, "g", "l")]
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns and sorted((r.doc_id or 0, r._leaked) for r in clean.collect()) == [(0, "n"), (1, "b"), (2, "b")]


def test_sketches_bound_what_two_sets_have_apart():
    r = np.random.default_rng(4)
    for n, m, common in ((5, 5, 5), (300, 310, 290), (2000, 150, 100), (40_000, 39_000, 30_000), (0, 3, 0)):
        shared = r.integers(-(1 << 62), 1 << 62, common)
        one, two = (np.unique(np.concatenate([shared, r.integers(-(1 << 62), 1 << 62, k - common)])) for k in (n, m))
        apart = len(np.setxor1d(one, two))
        found = simhash.apart(simhash.sketch(one), simhash.sketch(two))
        assert found <= apart and (2 * min(n, m) < max(n, m) or found > 0.3 * apart - 1)


def test_near_copies_of_one_text_meet_through_it(spark):
    """300 copies of one text, each with words of its own: hardly two of them are similar, all of them to the original."""
    r = random.Random(12)
    base = [f"{r.choice(WORDS)}{r.randrange(500)}" for _ in range(200)]
    rows = [(1000, " ".join(base))]
    for k in range(300):
        words = base[:]
        for at in r.sample(range(0, 200, 6), 4):
            words[at] = f"own{k}x{at}"
        rows.append((2000 + k, " ".join(words)))
    rows += [(5000 + k, prose(900 + k, 80)) for k in range(40)]
    docs = frame(spark, rows).repartition(4)
    meetings = []
    plain = simhash._confirmed

    def counted(pairs, *rest):
        meetings.append(pairs.count())
        return plain(pairs, *rest)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "_confirmed", counted)
        got = dict(simhash.similar_texts(docs).collect())
    assert all(got[2000 + k] == 1000 for k in range(300)) and len({got[5000 + k] for k in range(40)}) == 40
    assert sum(meetings) < 3000


def test_empty_tables(spark):
    docs, pages = frame(spark, []), spark.createDataFrame([], PAGES)
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "decontamination":
            assert stage(spark, docs, "").count() == 0, name
    results = [
        warc.read(warc.write(pages)), suffixes.report(docs), ann.nearest(vectors), simhash.near_duplicates(docs), quality.classify(docs, labels), html.extract(pages),
        urls.judge(pages), language.predict_documents(docs)[0], decontaminate.matches(docs, bench), packing.pack(docs, public_tokenizers.path(packing.TOKENIZER)),
    ]
    assert [r.count() for r in results] == [0] * 10


def test_pipeline_stages(spark, tmp_path):
    filler = [(200 + k, prose(300 + k, 50)) for k in range(20)]
    rows = [*corpus(), *filler, (500, prose(41) + ". " + ITEM), (501, filler[0][1]), (502, filler[1][1])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.cut(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {500, 501, 502, 100 - 3 * 12} and ids >= {d for d, _ in filler}
    want = suffixes.brute_force([(r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, corpus_pipeline.language_id(spark, docs, ""), "").collect()])
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3] for r in kept.collect() if r.text.isascii())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids


def test_rows_beside_pairs(spark, monkeypatch):
    """Pipeline, check_h: each side costs one join of two shuffles and one count, and an id of many pairs is dealt out over copies of its row."""
    monkeypatch.setattr(simhash, "PAIRS_A_COPY", 10)
    links = {(1, b) for b in range(2, 90)} | {(a, 99) for a in range(5, 60)} | {(2, 3)}
    pairs = spark.createDataFrame(sorted(links), "a long, b long")
    table = spark.createDataFrame([(i, f"x{i}") for i in range(120)], "id long, text string")
    told = simhash._beside(pairs, table)
    assert sorted(map(tuple, told.select("a", "b", "a_text", "b_text").collect())) == sorted((a, b, f"x{a}", f"x{b}") for a, b in links)
    plan = simhash._beside(pairs, table)._jdf.queryExecution().executedPlan().toString()
    assert 4 <= plan.count("Exchange hashpartitioning") <= 8 and plan.count("SortMergeJoin") == 2
