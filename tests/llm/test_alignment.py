"""Cross-tokenizer alignment against a plain restatement with the contract's own files."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from alertweave.llm import alignment

PATHS = public_tokenizers.path(alignment.RANKS_A), public_tokenizers.PATTERN, public_tokenizers.path(alignment.TOKENIZER_B)
ODD = [None, "", " ", "  two  spaces ", "a\x85b c", "<|endoftext|> <s></s> [PAD]", "x ▁ y", "\x00\x01", "日本語 ① ﬁ 😀 𐐀", "été\r\n\tßtraße", "x" * 5000, "1234567.89 %"]
WORDS = "unbelievable river tokenization naïve 2024 stone-walled Über don't walks  under\n\n.".split(" ")


def byte_of_character():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(others)}


def brute_force(rows):
    a = Tokenizer.from_file(public_tokenizers.path(alignment.TOKENIZER_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    characters = byte_of_character()
    out, links_of, counts = [], [], Counter()
    for doc, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(characters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if text and not b"".join(raw_a) == b"".join(raw_b) == b" " + text.encode():
            ids_a, ids_b, raw_a, raw_b = [], [], [], []
        ends_a = {sum(map(len, raw_a[: k + 1])): k for k in range(len(raw_a))} if len(raw_a) < 300 else ends(raw_a)
        ends_b = ends(raw_b)
        common = sorted(ends_a.keys() & ends_b.keys())
        links = [(ids_a[ends_a[e]], ids_b[ends_b[e]]) for e in common]
        groups, i, j = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, ids_a[i : ends_a[e] + 1])) + "|" + ",".join(map(str, ids_b[j : ends_b[e] + 1])))
            i, j = ends_a[e] + 1, ends_b[e] + 1
        counts.update(links)
        links_of.append(links)
        out.append([doc, len(ids_a), len(ids_b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    best = defaultdict(int)
    for (_, right), n in counts.items():
        best[right] = max(best[right], n)
    for row, links in zip(out, links_of, strict=True):
        row[5:5] = [sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)]
    return [tuple(row) for row in out]


def ends(raw):
    out, at = {}, 0
    for k, piece in enumerate(raw):
        at += len(piece)
        out[at] = k
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def test_alignment_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(k, text) for k, text in enumerate(ODD)]
    rows += [(100 + k, " ".join(r.choice(WORDS) + r.choice(["", "s", "-x", "7"]) for _ in range(r.randint(1, 400)))) for k in range(60)]
    rows += [rows[20], rows[20], (None, rows[21][1])]
    df = spark.createDataFrame([(d, t, "z", 7, 7) for d, t in rows], "doc_id long, text string, a string, n long, n_links long").repartition(3)
    got = alignment.align(df, *PATHS)
    assert got.columns == [c.split()[0] for c in alignment.RESULT.split(", ")]
    assert key(got.collect()) == key(brute_force(rows))


def test_pieces_do_not_depend_on_how_texts_are_gathered(spark, monkeypatch):
    v = alignment.vocabularies(*PATHS)
    texts = ["one two three", "", "naïve <s> ▁", "tokenization of things"]
    whole = alignment._aligned(v, [1, 2, 3, 4], texts).to_pylist()
    assert whole == [row for k, text in enumerate(texts) for row in alignment._aligned(v, [k + 1], [text]).to_pylist()]


def test_ranks_and_vocabulary_file_agree_on_every_block():
    v = alignment.vocabularies(*PATHS)
    a = Tokenizer.from_file(public_tokenizers.path(alignment.TOKENIZER_A))
    a.encode_special_tokens = True
    texts = [f" a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)} ." for c in range(1, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    assert [x.ids for x in a.encode_batch(texts, add_special_tokens=False)] == v.a.encode_ordinary_batch(texts)


def test_links_stay_below_the_bound_of_the_vocabularies(spark):
    v = alignment.vocabularies(*PATHS)
    assert v.most_pairs < 400_000
    r = random.Random(5)
    df = spark.createDataFrame([(k, "".join(chr(r.choice([32, 65 + r.randrange(60), 224 + r.randrange(900)])) for _ in range(300))) for k in range(50)], "doc_id long, text string")
    encoded = df.mapInArrow(alignment._encode(PATHS), alignment.ENCODED)
    for row in alignment.pair_counts(encoded, v)[1].collect():
        one, other = sorted((v.bytes_a[row.a], v.bytes_b[row.b]), key=len)
        assert other.endswith(one)


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(df, *PATHS).collect() == []
