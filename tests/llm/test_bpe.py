"""Byte-level BPE against tiktoken itself, and back."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tidelearn.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", None, " ", "\n\n  x", "don't  stop  it's\r\n\tNOW 1234567", "日本語テキスト🙂🙃 — ünïcödé ß", "a" * 700, "ab" * 500 + " " * 300 + "z",
    "\x00\x01\x7f\x85 ", "<|endoftext|> </s>", "𝒳𝟘" * 40, "x" + " " * 999, "е́ е" * 50,
]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_equals_the_ranks_own_encoder(spark, sf_dir, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bpe_query(spark, sf_dir)}
    assert sorted(got) == sorted(docs)
    for i, text in docs.items():
        ids = plain.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def bpe_query(spark, sf_dir):
    return bpe.op12_bpe(spark, sf_dir).collect()


def test_odd_texts_offsets_and_clashing_columns(spark, make, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "null id")]
    docs = make(rows).withColumnRenamed("token", "ids")
    out = bpe.decode(bpe.encode(docs, PATH, offsets=True), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        text = (ODD[r.doc_id] if r.doc_id is not None else "null id") or ""
        assert r.ids == plain.encode_ordinary(text) and bytes(r.data).decode() == text
        want = bpe.codec(PATH, P.PATTERN).library.encode(text, add_special_tokens=False)
        assert list(zip(r.char_starts, r.char_ends)) == want.offsets
        assert r.byte_ends == np.cumsum([len(plain.decode_single_token_bytes(t)) for t in r.ids]).tolist()


def test_random_texts_of_all_scripts(plain):
    rng = np.random.default_rng(5)
    own = bpe.codec(PATH, P.PATTERN)
    for _ in range(300):
        points = rng.choice([rng.integers(32, 127, 40), rng.integers(0x80, 0x3000, 40), rng.integers(0x3000, 0xD800, 40), rng.integers(0x10000, 0x110000, 40), np.array([9, 10, 13, 32] * 10)])
        text = "".join(map(chr, rng.permutation(np.concatenate([points, rng.integers(32, 127, 40)]))))
        (ids,) = own.encode([text])
        assert ids.tolist() == plain.encode_ordinary(text)
        assert own.decode(ids).tobytes().decode() == text


def test_long_texts_are_cut_where_the_pattern_cuts(plain):
    rng = np.random.default_rng(6)
    words = ["lo", "don't", "x  y", "1", " ", "\n", "é", "…", "thing"]
    text = " ".join(words[i] for i in rng.integers(0, len(words), 400_000))
    parts = list(bpe.pieces(text))
    assert "".join(parts) == text and len(parts) > 3
    (ids,) = bpe.codec(PATH, P.PATTERN).encode([text])
    assert ids.tolist() == plain.encode_ordinary(text)
    solid = "q" * 300_000  # no cut anywhere
    (ids,) = bpe.codec(PATH, P.PATTERN).encode([solid])
    assert bpe.codec(PATH, P.PATTERN).decode(ids).tobytes().decode() == solid


def test_split_characters_and_wrong_bytes(plain):
    own = bpe.codec(PATH, P.PATTERN)
    (ids,) = own.encode(["🙂 é 𝒳"])
    data, ends = own.decode(ids).tobytes(), own.ends(ids)
    texts = bpe.token_texts(data, ends)
    assert "".join(texts) == "🙂 é 𝒳" and "" in texts
    assert bpe.token_texts(b"\xff", np.array([1])) == ["�"]
    with pytest.raises(ValueError):
        own.decode(np.array([60_000]))


def test_empty_table(make):
    empty = make([(1, "x")]).where("doc_id > 9")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_matches_are_cut_alike():
    """The regex module cuts texts of assigned characters as the library does, so remembered matches give the library's ids."""
    import unicodedata

    import regex
    from tokenizers import Regex, pre_tokenizers

    library, own = pre_tokenizers.Split(Regex(P.PATTERN), "isolated"), regex.compile(P.PATTERN)
    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    for form in ("a{0}a1{0}1", " {0}{0} !{0}!", "{0}", "\n{0}"):
        for a in range(0, len(known), 5000):
            text = "\x00".join(map(form.format, known[a : a + 5000]))
            assert [m for m, _ in library.pre_tokenize_str(text)] == own.findall(text)


def test_remembered_ids_are_the_library_s(monkeypatch):
    codec = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = ["", "it's  \n\n x's 'st 12 345!?  ", "࢏՘ new", "z" * 100 + " é́", "a  　b"] * 2
    want = [codec.library.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (1 << 17, 0):
        monkeypatch.setattr(bpe, "MEMORY", most)
        assert [ids.tolist() for ids in codec.encode(texts)] == want
    assert 0 < len(codec.memory) and max(map(len, codec.memory)) <= bpe.LONGEST
