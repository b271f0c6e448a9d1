"""Chat formatting and archives: round trips."""

import base64
import gzip
import hashlib
import os
import random
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tidelearn.llm import chat, warc
from tidelearn.session import new_path

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TURNS = [
    (1, 0, "user", "hi <s>"), (1, 1, "assistant", "</s>[INST] \\ <\\s> <\\\\/s>[\\INST]"), (1, 2, None, None), (2, 0, "assistant", ""), (3, 0, "user", None), (3, 0, "user", None),
    (4, 1, "assistant", "second é\U0001f600\n"), (4, 0, "assistant", "first "), (None, None, "assistant", "no id"), (5, 0, "<s>role[INST]", "x" * 30_000 + " end " + "é" * 5000), (6, 0, "assistant", "a\x00b"),
]


def plain(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        own = [(t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv]
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{t[1]}\n{t[2]}".encode()).hexdigest()))
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        chars = sum(20 + len(chat.escape(r)) + len(chat.escape(x)) for _, r, x in own)
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def test_read_back(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).withColumn("place", F.lit(2)).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.format_turns(turns, PATH), PATH).collect()}
    assert got == plain(TURNS)
    assert chat.digests(chat.format_turns(turns.where("false"), PATH), PATH).count() == 0


def test_long_conversation(spark):
    turns = [(k % 2, k, "assistant" if k % 3 else "user", f"turn {k} </s>") for k in range(25_000)]
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), PATH), PATH).collect()}
    assert got == plain(turns)


def test_masks_and_reserved_ids():
    own = chat.assembler(PATH)
    ids, mask, bounds = own.assemble(["user", "assistant", "assistant"], ["a b", "", "</s> c"], frozenset(["assistant"]))
    assert bounds.tolist() == [0, *[i + 1 for i, t in enumerate(ids) if t == own.control["</s>"]]]
    for k, (role, text) in enumerate([("user", "a b"), ("assistant", ""), ("assistant", "</s> c")]):
        part, m = ids[bounds[k] : bounds[k + 1]], mask[bounds[k] : bounds[k + 1]]
        assert [own.control[c] for c in chat.CONTROLS] == [t for t in part if t >= own.first]
        assert own.read(part, m) == (role, text, text if role == "assistant" else "", 20 + len(chat.escape(role)) + len(chat.escape(text)))
        assert all(t < own.first for t in part[m == 1])


def test_escape_is_reversible():
    bits = ["<", "s>", "/s>", "[", "INST]", "/INST]", "\\", "x"]
    texts = [a + b + c + d for a in bits for b in bits for c in bits for d in bits]
    assert all(chat.unescape(chat.escape(t)) == t for t in texts) and len({chat.escape(t) for t in texts}) == len(set(texts))
    assert not any(c in chat.escape(t) for t in texts for c in chat.CONTROLS)


def archive(spark, rows, compression="none"):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("x")).withColumn("digest", F.lit("y")).repartition(2)
    warc.write_archives(pages, path, compression=compression)
    return path


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4\r\nX: y", ""), (5, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nfake\r\n\r\n" * 3),
    (6, "u", "é\U0001f600 \x00 \r\n\r\n"), (7, "u", "x" * 300_000), (2, "http://a/2", "<p>one</p>"), (None, "n", "<p>none</p>"), (None, "n", "<p>one</p>"),
]


def test_round_trip(spark):
    for compression in ("none", "gzip"):
        got = warc.read_archives(spark, archive(spark, PAGES, compression)).collect()
        assert all(r.error is None for r in got) and len(got) == len(PAGES)
        payloads = sorted((h or "").encode() for i, _, h in PAGES if i not in (1, 3))
        assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == payloads
        assert [(r.record_id, r.refers_to, r.payload_digest, r.payload_bytes) for r in got if r.record_type == "revisit" and "1" in r.record_id] == [
            ("<urn:page:1>", "<urn:page:2>", sha(b"<p>one</p>"), 10)
        ]
        assert {r.payload_digest for r in got} == {sha((h or "").encode()) for _, _, h in PAGES}
    assert warc.read_archives(spark, archive(spark, PAGES[:0])).count() == 0


def test_empty_payloads_and_least_bytes(spark):
    got = {r.record_id: r.record_type for r in warc.read_archives(spark, archive(spark, [(1, "u", None), (2, "u", ""), (3, "u", "x")])).collect()}
    assert got == {"<urn:page:1>": "revisit", "<urn:page:2>": "response", "<urn:page:3>": "response"}
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "long"), (4, "u", "long")], "page_id long, url string, html string"), path, least=2)
    assert sorted(r.record_type for r in warc.read_archives(spark, path).collect()) == ["response", "response", "response", "revisit"]


def plain_archive(n=6):
    out = []
    for k in range(n):
        payload = f"<p>{k}</p>".encode() * (k + 1)
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:{sha(payload)}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
        out.append(head.encode() + block + b"\r\n\r\n")
    return out


def salvage(data):
    got = list(warc.records(data))
    spans = [(r["at"], r["end"]) for r in got]
    return [r["record_id"] for r in got if not r["error"]], [(r["at"], r["end"]) for r in got if r["error"]], spans


def test_salvage_plain():
    parts = plain_archive()
    whole = b"".join(parts)
    names = [f"<urn:page:{k}>" for k in range(6)]
    assert salvage(whole)[:2] == (names, [])
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    # A flipped payload byte, a wrong length, junk between, a cut-off end.
    flipped = bytearray(whole)
    flipped[starts[2] + len(parts[2]) - 8] ^= 1
    assert salvage(bytes(flipped))[:2] == (names[:2] + names[3:], [(starts[2], starts[3])])
    longer = whole.replace(b"Content-Length: 27\r\n", b"Content-Length: 99\r\n", 1)
    assert len(salvage(longer)[0]) == 5 and len(salvage(longer)[1]) == 1
    junk = parts[0] + b"\x00junk\xff" + b"".join(parts[1:])
    assert salvage(junk)[:2] == (names, [(starts[1], starts[1] + 6)])
    assert salvage(whole[:-3])[:2] == (names[:5], [(starts[5], len(whole) - 3)])
    assert salvage(b"") == ([], [], []) and salvage(b"nothing here")[:2] == ([], [(0, 12)])
    # Gaps and records cover every byte.
    for data in (bytes(flipped), longer, junk, whole[:-3]):
        spans = salvage(data)[2]
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_salvage_members():
    parts = plain_archive()
    members = [gzip.compress(p) for p in parts]
    starts = [sum(map(len, members[:k])) for k in range(7)]
    names = [f"<urn:page:{k}>" for k in range(6)]
    assert salvage(b"".join(members))[:2] == (names, [])
    broken = bytearray(b"".join(members))
    broken[starts[3] - 6] ^= 255
    assert salvage(bytes(broken))[:2] == (names[:2] + names[3:], [(starts[2], starts[3])])
    assert salvage(b"".join(members)[:-4])[:2] == (names[:5], [(starts[5], starts[6] - 4)])
    assert salvage(b"junk" + b"".join(members))[:2] == (names, [(0, 4)])


def test_salvaged_table(spark, tmp_path):
    parts = plain_archive()
    (tmp_path / "part-0.warc").write_bytes(parts[0] + b"damage" + parts[1])
    (tmp_path / "part-1.warc.gz").write_bytes(gzip.compress(parts[2]) + b"\x1f\x8b\x08broken" + gzip.compress(parts[3]))
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted(r.record_id for r in got if r.error is None) == [f"<urn:page:{k}>" for k in range(4)]
    assert sorted(r.end_offset - r.offset for r in got if r.error) == [6, 9]


def test_long_runs_are_encoded_whole():
    own = chat.assembler(PATH)
    rng = random.Random(2)
    address = "https://example.org/" + "".join(rng.choice("abc/.-?=&%09xyz") for _ in range(3200))
    for text in (address, "x" * 1_000_000, "".join(rng.choice("abcdefghij") for _ in range(200_000)), " " * 300_000 + "a", "é" * 100_000):
        ids = own.encode(text)
        assert ids == own.encoding.encode_ordinary(text) and own.decode(np.array(ids)) == text


def test_archives_of_many_members_and_other_digests(spark):
    def record(i, digest, payload=b"hello"):
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\n{digest}Content-Length: {len(payload)}\r\n\r\n"
        return head.encode() + payload + warc.RECORD_END.encode()

    started = time.time()
    many = b"".join(gzip.compress(record(i, "", b"%d " % i * 20)) for i in range(50_000))
    made, began = time.time() - started, time.time()
    got = [r["record_id"] for r in warc.records(many)]
    assert got == [f"<urn:page:{i}>" for i in range(50_000)] and time.time() - began < 30 + made
    # Damage in one member hides that member only.
    broken = bytearray(many[: 40 * len(gzip.compress(record(0, "")))])
    broken[len(gzip.compress(record(0, "", b"0 " * 20))) + 12] ^= 0xFF
    kept = list(warc.records(bytes(broken)))
    assert sum(r.get("error") is not None for r in kept) <= 2 and kept[0]["record_id"] == "<urn:page:0>"

    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    stated = {
        f"sha1:{sha1}": True, f"sha1:{sha1.lower()}": True, f"sha256:{hashlib.sha256(b'hello').hexdigest()}": True, f"SHA-256:{hashlib.sha256(b'hello').hexdigest().upper()}": True,
        f"md5:{hashlib.md5(b'hello').hexdigest()}": True, "blake3:abc": None, "": None, f"sha256:{'0' * 64}": False,
    }
    path = new_path(spark, "digests")
    os.makedirs(path)
    data = b"".join(record(i, f"WARC-Payload-Digest: {d}\r\n" if d else "") for i, d in enumerate(stated))
    with open(f"{path}/CC-MAIN.warc", "wb") as f:
        f.write(data)
    rows = warc.read_archives(spark, path).orderBy("offset").collect()
    assert [r.verified for r in rows if r.error is None] == [v for v in stated.values() if v is not False]
    assert [r.error for r in rows if r.error] == ["wrong digest"]
    assert warc.read_archives(spark, path, names="part-*").count() == 0
