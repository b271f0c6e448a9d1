import pytest
from pyspark.sql import functions as F

from tidelearn.llm.mixing import mix_sources
from tidelearn.llm.urls import judge, page_links

WEIGHTS = (5, 2, 1)


def fill(sizes):
    """Targets by resharing the excess until none is above; sizes in the order of the sources."""
    total, weight = sum(sizes), [WEIGHTS[k % 3] for k in range(len(sizes))]
    full = {}
    while True:
        open_ = [k for k in range(len(sizes)) if k not in full]
        left = total - sum(full.values())
        share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        above = [k for k in open_ if share[k] > 3 * sizes[k]]
        if not above:
            return [full.get(k, share.get(k)) for k in range(len(sizes))]
        full |= {k: 3 * sizes[k] for k in above}


def words(n):
    return " ".join(["w"] * n)


def test_targets_and_cuts(make):
    counts = {"a": [3, 4, 0, 900, 2], "B": [1, 2, 2], "é": [5], "z": [10] * 40, "m": [0, 0], None: [7, 7, 300]}
    rows = [(k * 100 + i, words(n), s) for k, (s, ns) in enumerate(counts.items()) for i, n in enumerate(ns)]
    got = mix_sources(make(rows)).collect()
    order = sorted((s for s in counts if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, fill([sum(counts[s]) for s in order])))
    assert len(got) == len(rows)
    for s in counts:
        own = [r for r in got if r.source == s]
        assert [r.target for r in own] == pytest.approx([want[s]] * len(own))
        assert sum(r.taken for r in own) == int(own[0].target + 1e-9)
        assert all(0 <= r.taken <= 3 * r.size for r in own) and {r.source_size for r in own} == {sum(counts[s])}


def test_reruns_agree_on_other_partitions(make):
    rows = [(k, words(k % 17), f"s{k % 5}") for k in range(400)]
    one, two = (sorted(map(tuple, mix_sources(make(rows, parts)).collect())) for parts in (1, 7))
    assert one == two
    assert one != sorted(map(tuple, mix_sources(make(rows), seed=2).collect()))


def test_many_ranges(make, monkeypatch):
    from tidelearn.llm import mixing

    rows = [(k, words(1 + k % 5), "hot" if k % 3 else "b") for k in range(3000)]
    one = sorted(map(tuple, mix_sources(make(rows)).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    assert sorted(map(tuple, mix_sources(make(rows)).collect())) == one


def test_mix_edges(make):
    rows = [(None, words(4), None), (None, None, None), (1, words(3), "a"), (1, words(3), "a"), (2, "", "a"), (3, words(30_000), "b")]
    got = mix_sources(make(rows)).collect()
    assert len(got) == 6 and sum(r.size for r in got) == 30_010
    assert mix_sources(make(rows).where("false")).collect() == []
    assert [r.taken for r in mix_sources(make([(1, None)])).collect()] == [0]


URLS = [
    (1, "https://EXAMPLE.org/es/9?x#y"), (2, "http://m.example.org/en/12"), (3, "https://aorg/es/"), (4, "https://a.org/zz"), (5, "http://shop.com/fr/1"),
    (6, "http://shop.com/de/1"), (7, "http://shop.com/en/1"), (8, None), (9, ""), (10, "no scheme/x"), (11, "x://y://z/w"), (12, "http://h.net"), (13, "http://h.net?q=://a.org/"),
    (14, "http://shop.com/de"), (15, "://org/"), (16, "http://comdom/de/"), (17, "http://É.Com/de/ü\nv"),
]


def test_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame(URLS, "page_id long, url string")).collect()}
    assert got == {
        1: ("example.org", "/es/9", "example.org/es/", "block"), 2: ("m.example.org", "/en/12", "example.org/en/1", "block"), 3: ("aorg", "/es/", None, "allow"),
        4: ("a.org", "/zz", "org/", "allow"), 5: ("shop.com", "/fr/1", "com/fr/", "allow"), 6: ("shop.com", "/de/1", "com/de/", "block"), 7: ("shop.com", "/en/1", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("y:", "//z/w", None, "allow"), 12: ("h.net", "", None, "allow"),
        13: ("h.net", "", None, "allow"), 14: ("shop.com", "/de", None, "allow"), 15: ("org", "/", "org/", "allow"), 16: ("comdom", "/de/", None, "allow"), 17: ("É.com", "/de/ü\nv", "com/de/", "block"),
    }


def test_aliases(spark):
    """Blocks run along links and equal addresses; explicit allows stand."""
    urls = [
        (1, "http://a.net/1"), (2, "https://A.net/1/?utm_source=x#top"), (3, "http://b.net/2?id=5&ref=q"), (4, "http://shop.com/de/9"), (5, "http://ok.org/3"), (6, "http://c.net/4"),
        (7, "http://b.net/2?id=6"), (8, "http://d.net/5"), (1, "http://a.net/1"), (9, "http://e.net/6"),
    ]
    links = [
        ("http://a.net/1/", "http://b.net/2?id=5"), ("http://b.net/2?id=5", "https://shop.com/de/9#x"), ("http://ok.org/3", "http://a.net/1"), ("http://ok.org/3", "http://c.net/4"),
        ("http://d.net/5", "http://elsewhere.example.org/es/1"), (None, "http://e.net/6"), ("http://e.net/6", "http://e.net/6"),
    ]
    rows = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("a", F.lit("y"))
    got = judge(rows, spark.createDataFrame(links, "url string, target string"))
    verdicts = sorted((r.page_id, r.verdict) for r in got.collect())
    assert verdicts == [(1, "block"), (1, "block"), (2, "block"), (3, "block"), (4, "block"), (5, "allow"), (6, "block"), (7, "allow"), (8, "block"), (9, "allow")]
    assert "a" in got.columns and judge(rows.where("false"), None).count() == 0
    assert judge(rows, spark.createDataFrame([], "url string, target string")).where("verdict = 'block'").count() == 1


def test_links_from_pages(spark):
    pages = [
        ("http://a.net/1", '<html><head><link rel="canonical" href="http://b.net/"><meta http-equiv="refresh" content="0; url=http://c.net/x"></head><body><link rel=canonical href="http://no.net/">'),
        ("http://a.net/2", '<head><link href=http://d.net/ rel=canonical></head>'), ("http://a.net/3", None), (None, '<link rel="canonical" href="http://b.net/">'), ("http://a.net/4", ""),
        ("http://a.net/5", '<link rel="canonical" href="/relative">'),
    ]
    got = page_links(spark.createDataFrame(pages, "url string, html string")).collect()
    assert sorted(map(tuple, got)) == [("http://a.net/1", "http://b.net/"), ("http://a.net/1", "http://c.net/x"), ("http://a.net/2", "http://d.net/")]
