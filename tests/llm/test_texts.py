"""Quality, rules, token counts and license scans against plain versions."""

import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelearn.llm import licenses, quality, rules, tokens, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a b"), (5, "é" * 50_000), (6, "a " * 40_000), (7, "x y　z \U0001f600")]


# Quality


def test_features_do_not_depend_on_neighbours():
    texts = ["THE!! CAT!!", None, "", "a | b | c\nd", "é # é", "w " * 3000, "one two two"]
    together = quality.statistics(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(together[k], quality.statistics(pa.array([t], pa.string()))[0])
    named = dict(zip(quality.FEATURES, together[0]))
    assert named["shouted"] == 1 and named["exclamation"] == 4 / 11 and named["marked_ends"] == 1
    assert dict(zip(quality.FEATURES, together[6]))["next_equal"] == pytest.approx(1 / 3)


def test_trees_learn_and_flat_arrays_agree_with_a_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.5)).astype(float)
    model = quality.grow(x[:2000], y[:2000])
    score = model.score(x[2000:])
    assert ((score >= 0.5) == y[2000:]).mean() > 0.97
    inner, leaves = 2**model.depth - 1, 2**model.depth
    for i in range(5):
        total = model.base
        for t in range(len(model.feature) // inner):
            node = 0
            while node < inner:
                at = t * inner + node
                node = 2 * node + (2 if x[2000 + i, model.feature[at]] > model.cut[at] else 1)
            total += model.value[t * leaves + node - inner]
        assert score[i] == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.grow(x[:50], np.ones(50)).score(x[:1])[0] > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    held = docs.join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    rows = quality.classify(held, model).select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(np.array(good) > b).mean() + 0.5 * (np.array(good) == b).mean() for b in bad])
    assert len(bad) > 50 and auc > 0.98
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97


def test_quality_edges(make, spark):
    docs = make(EDGES)
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None), (4, 1), (4, 0), (6, 0), (99, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.classify(docs, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.text in (None, "")}) == 1
    assert quality.classify(docs.where("false"), quality.fit(docs.where("false"), labels)).count() == 0
    assert quality.classify(docs, quality.fit(docs, labels.where("false"))).select("score").distinct().collect()[0][0] == 0.5
    assert quality.training_rows(spark.range(100).selectExpr("id as doc_id", "1 as quality"), rows=10).count() == 10


# Rules


def plain_rules(text, bands=rules.Bands()):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    raw, z = text.encode(), zstandard.ZstdCompressor(level=bands.level)
    band = [b for b in bands.whole if b[0] <= len(raw)]
    fine = not band or band[-1][1] <= len(z.compress(raw)) / len(raw) <= band[-1][2]
    parts = [len(z.compress(raw[k : k + bands.chunk])) / bands.chunk for k in range(0, len(raw) - bands.chunk + 1, bands.chunk)]
    bad = sum(not bands.of_chunk[0] <= r <= bands.of_chunk[1] for r in parts)
    fine = fine and (not parts or bad / len(parts) <= bands.most_bad)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed, not failed and fine)


def judged(docs):
    fields = [*rules.FIELDS, "base_failed", "kept"]
    return sorted((r.text or "", *(r.rules[f] for f in fields)) for r in rules.apply_rules(docs).select("text", "rules").collect())


def test_rules_brute_force(documents):
    texts = [r.text for r in documents.select("text").collect()]
    assert judged(documents) == sorted((t or "", *plain_rules(t)) for t in texts)


def test_rules_edges(make):
    rng = np.random.default_rng(2)
    noise = "".join(chr(33 + k) for k in rng.integers(0, 94, 6000))
    prose = " ".join("".join(chr(97 + k) for k in rng.integers(0, 20, 2 + j % 7)) for j in range(900))
    rows = EDGES + [(20, "a\na\n a\nb\r\nb\r\n\n\n"), (21, "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5 z"), (22, noise + " " + prose), (23, noise[:700] * 1), (24, prose), (25, prose + " spam" * 9000)]
    docs = make(rows)
    assert judged(docs) == sorted((t or "", *plain_rules(t)) for _, t, *_ in rows)
    assert judged(docs.where("false")) == []


def test_clean_documents_stay(spark):
    """No labelled good document is rejected by the bands; repetitive ones all are rejected."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    out = rules.apply_rules(docs)
    assert out.where("quality = 1 and not rules.base_failed and not rules.kept").count() == 0


def test_noise_and_templates_are_rejected(make):
    """Base64, random words and templated text of every length go; other scripts and prose stay."""
    import base64
    import random

    rng = random.Random(8)

    def words_of(letters, n, size=8):
        return " ".join("".join(rng.choice(letters) for _ in range(size)) for _ in range(n // (size + 1) + 1))[:n]

    printable, alnum = "".join(map(chr, range(33, 127))), "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123))))
    bad, good = [], []
    for n in (300, 600, 1000, 1500, 3000, 5000, 20_000, 100_000):
        code = base64.b64encode(rng.randbytes(n)).decode()
        bad += [words_of(printable, n), words_of(alnum, n), "\n".join(code[k : k + 20] for k in range(0, n, 20))]
    bad += [words_of(alnum[36:], n) for n in (20_000, 100_000)]
    for n in (1500, 5000, 20_000, 100_000):
        bad.append(" ".join(f"Product {rng.randrange(10**6)} is in stock today and costs {rng.randrange(1000)} dollars, order number {rng.randrange(10**6)} now." for _ in range(n // 80)))
    # Words by Zipf's law, in Latin and in Hangul letters.
    for letters in ("etaoinshrdlucmwfgypbvkxjqz", [chr(0xAC00 + k) for k in rng.sample(range(11_000), 2000)]):
        weights = [1 / (k + 2) for k in range(len(letters))]
        own = ["".join(rng.choices(letters, weights, k=rng.choice((2, 2, 3) if len(letters) > 99 else (2, 3, 4, 5, 7, 9)))) for _ in range(20_000)]
        often = [1 / (k + 3) for k in range(len(own))]
        good += [" ".join(rng.choices(own, often, k=n)) for n in (60, 130, 400, 1500, 6000, 30_000)]
    docs = make([(k, t) for k, t in enumerate(bad + good)])
    kept = {r.doc_id for r in rules.apply_rules(docs).where("rules.kept").select("doc_id").collect()}
    assert kept == set(range(len(bad), len(bad) + len(good)))


def test_stretches_show(make):
    """A bad stretch of two chunks shows wherever it stands and however long the text is, and so does one at the end."""
    import random

    rng = random.Random(9)
    own = ["".join(rng.choices("etaoinshrdlucmwfgypbvk", range(22, 0, -1), k=rng.choice((2, 3, 4, 5, 7, 9)))) for _ in range(20_000)]
    often = [1 / (k + 3) for k in range(len(own))]

    def prose(n):
        return " ".join(rng.choices(own, often, k=n // 4))[:n]

    def noise(n):
        return " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(8)) for _ in range(n // 9 + 1))[:n]

    good = [prose(n) for n in (4096, 4097, 6143, 8191, 8200, 100_000, 1_000_000)] + [prose(20_000) + noise(500) + prose(20_000)]
    bad = [prose(4200) + " " + noise(4000), noise(4000) + " " + prose(4200), prose(4200) + " " + "again and again " * 250]
    for at in (0, 1000, 2047, 2049, 4095, 30_000, 91_809):
        bad += [prose(at) + " " + stretch + " " + prose(100_000 - at) for stretch in (noise(8192), "again and again " * 512)]
    bad += [prose(500_000) + noise(8192) + prose(500_000), prose(350_000) + noise(290_000) + prose(360_000)]
    docs = make([(k, t) for k, t in enumerate(good + bad)])
    got = {r.doc_id for r in rules.apply_rules(docs).where("rules.in_bands").select("doc_id").collect()}
    assert got == set(range(len(good)))


# Tokens


def test_tokens_equal_the_library(documents, make):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)

    def expected(t):
        return len(library.encode(t or "", add_special_tokens=False).ids)

    rows = EDGES + [
        (30, "don't WE'LL 'T it'Re 12½ ²³ a_b __"), (31, "<|endoftext|>x<|ENDOFTEXT|> <|startoftext|>"), (32, "ΑΣ ΣΑΣ İ ǅ ſ K"), (33, "é ẛ̣ 한글 กำ"),
        (34, "a\x1cb\x85c d​e﻿f"), (35, "q" * 70_000), (36, "“quoted” – l’été… €5"),
    ]
    for docs in (make(rows), documents):
        got = tokens.count_tokens(docs, path).select("text", "n_bytes", "n_tokens", "over_limit").collect()
        for r in got:
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), expected(r.text), expected(r.text) > 2048), (r.text or "")[:60]
    assert tokens.count_tokens(make(rows).where("false"), path).count() == 0


def test_every_character_counts_alike():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokens.Counter(path, tokens.whole_tokens(path))
    texts = [f"a{chr(c)}b 1{chr(c)}{chr(c)}'s{chr(c)}" for c in [*range(1, 0x600), *range(0x600, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.count(t) for t in texts] == want


def test_whole_tokens_are_proven():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    whole = sorted(tokens.whole_tokens(path))
    assert len(whole) > 30_000
    for piece in whole[::97]:
        if piece == piece.lower() and len(library.pre_tokenizer.pre_tokenize_str(piece)) == 1:
            assert len(library.encode(piece, add_special_tokens=False).ids) == 1


# Licenses

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(text):
    w = PLAIN_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    first, last = (min(found)[0], max(found)[0]) if found else (None, None)
    return len(w), len(found), first, last, ",".join(sorted({x for _, x in found}))


def distance(notice, text):
    """Fewest edits that turn ``notice`` into some whole-word part of ``text``."""
    w = text.split()
    best = len(notice)
    for a in range(len(w)):
        for b in range(a + 1, len(w) + 1):
            part = " ".join(w[a:b])
            if abs(len(part) - len(notice)) < best:
                row = list(range(len(part) + 1))
                for i, c in enumerate(notice, 1):
                    row2 = [i]
                    for j, d in enumerate(part, 1):
                        row2.append(min(row[j] + 1, row2[-1] + 1, row[j - 1] + (c != d)))
                    row = row2
                best = min(best, row[-1])
    return best


def scanned(docs):
    return {r.text: r.licenses for r in licenses.scan(docs).select("text", "licenses").collect()}


def test_license_base(documents, make):
    rows = EDGES + [(40, "CC-BY cc  by\ncc by cc by"), (41, "xcc by; cc byé"), (42, "General Public License. All Rights\nReserved!"), (43, "cc"), (44, "by cc by"), (45, "all rights all rights reserved")]
    for docs in (make(rows), documents):
        for text, got in scanned(docs).items():
            assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == plain_scan(text), (text or "")[:80]
            assert set(got.base_labels.split(",")) - {""} <= set(got.labels.split(",")) and 0 <= got.score <= 1
    assert scanned(make(rows).where("false")) == {}


def test_fuzzy_notices(make):
    import random

    rng = random.Random(4)
    notices = [(n, label, e) for n, label, e in licenses.NOTICES]
    rows = []
    for k, (notice, label, edits) in enumerate(notices):
        for extra in range(0, edits + 3):
            text = list(notice)
            for _ in range(extra):
                at = rng.randrange(1, len(text) - 1)
                text[at] = rng.choice(["", "q", text[at] + "z"])
            rows.append((len(rows), "lorem ipsum " + "".join(text) + " dolor sit", k))
    got = scanned(make([r[:2] for r in rows]))
    for _, text, k in rows:
        notice, label, edits = notices[k]
        near = {lab for n, lab, e in notices if distance(n, " ".join(PLAIN_WORD.findall(text))) <= e}
        if distance(notice, text) <= edits:
            assert any(distance(n, text) <= s.edits for s in got[text].spans for n, lab, _ in notices if lab == s.label), text
            assert set(got[text].labels.split(",")) <= near | set(got[text].base_labels.split(",")) | {""}, text
        if not near:
            assert got[text].labels == got[text].base_labels, text


def test_many_places_and_notices_in_one_text():
    """Work grows with the text, not with its square."""
    scanner = licenses.Scanner()
    began = time.time()
    found = licenses.scan_text(scanner, "released cc by here " * 100_000)
    assert found["n_base"] == 100_000 and (found["first_word"], found["last_word"]) == (1, 4 * 99_999 + 1)
    spans = scanner.spans((f"{scanner.notices[0][0]} filler words " * 3000).strip().encode())
    assert len(spans) == 3000 and spans == sorted(spans) and time.time() - began < 60


def test_long_words_do_not_collide():
    """Thue-Morse patterns and their complements are equal for every polynomial hash modulo 2^64."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    column = pa.array([a, b, a.upper()])
    data, bounds = words.utf8(column)
    starts, ends, _ = words.spans(data, bounds)
    exact, lower = words.hashes(data, starts, ends), words.hashes(data, starts, ends, words.LOWER)
    assert len(set(exact.tolist())) == 3 and lower[0] == lower[2] != lower[1]
