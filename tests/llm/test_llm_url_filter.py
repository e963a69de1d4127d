import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsdeck.llm import url_filter as uf

CASES = {
    "https://a.com/x?y#z": ("a.com", "/x", "com/", "allow"),
    "HTTP://WWW.Example.COM/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://blog.example.com/en/9": ("blog.example.com", "/en/9", "example.com/en/", "block"),
    "http://example.com/EN/9": ("example.com", "/EN/9", "com/", "allow"),
    "http://example.com/en": ("example.com", "/en", "com/", "allow"),
    "http://com/": ("com", "/", "com/", "allow"),
    "http://com": ("com", "", None, None),
    "http://a.com?q": ("a.com", "", None, None),
    "http://xcom/": ("xcom", "/", None, None),
    "http://b.net/es/1#top": ("b.net", "/es/1", "net/es/", "block"),
    "http://b.net/fr/": ("b.net", "/fr/", "net/fr/", "block"),
    "http://b.net/de/": ("b.net", "/de/", None, None),
    "http://a/b://c/d": ("a", "/b://c/d", None, None),
    "x://É.Com/p": ("É.com", "/p", "com/", "allow"),
    "no scheme": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
}


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)


def test_hosts_paths_and_rules(spark):
    df = pages(spark, list(CASES) * 2).withColumn("accepted", F.lit("mine")).withColumn("html", F.lit("x"))
    rows = uf.judge(df).collect()
    assert len(rows) == 2 * len(CASES) and all(r.accepted == "mine" and r.html == "x" for r in rows)
    for r in rows:
        host, path, rule, verdict = CASES[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert uf.judge(df.limit(0)).count() == 0


def brute_score(model, url):
    """Witten-Bell from plain dictionaries of the same cells."""
    at, _ = uf.cells([url])
    out = []
    for c in (0, 1):
        total = 0.0
        for i in range(len(at[0])):
            p = 1 / uf.SYMBOLS
            for cell in at:
                row = model.counts[c].reshape(-1, uf.SYMBOLS)[cell[i] // uf.SYMBOLS]
                seen, kinds = int(row.sum()), int((row > 0).sum())
                if seen:
                    p = (row[cell[i] % uf.SYMBOLS] + kinds * p) / (seen + kinds)
            total += math.log(p)
        out.append(total)
    return (out[0] - out[1]) / len(at[0])


def test_counts_and_scores(spark):
    good, bad = [f"https://good.com/a{i % 7}" for i in range(300)], [f"https://x.net/es/{i}" for i in range(300)]
    df = spark.createDataFrame([(u, 1) for u in good] + [(u, 0) for u in bad], "url string, accepted int").repartition(5)
    model = uf.train(df, "url", "accepted")
    want = np.zeros((2, uf.SIZE), dtype=np.int64)
    for c, urls in enumerate((good, bad)):
        for url in urls:
            for cell in uf.cells([url.encode()])[0]:
                np.add.at(want[c], cell, 1)
    assert (model.counts == want).all()
    some = [b"https://good.com/a3", b"https://x.net/es/12", b"", "é???".encode(), None]
    assert model.score(some) == pytest.approx([brute_score(model, u) for u in some])
    assert model.score(some)[0] > 0.5 and model.score(some)[1] < -0.5
    for c in (0, 1):        # every context's probabilities add up to 1
        rows = model.counts[c].reshape(-1, uf.SYMBOLS)
        assert (model.seen[c] == rows.sum(axis=1)).all()


def test_method_follows_the_rules_it_learned_from(spark):
    allow = [f"https://shop{i}.com/de/item{i}" for i in range(200)]
    block = [f"http://junk{i}.net/es/spam{i}" for i in range(200)]
    other = ["https://shop9.org/de/item3"] * 3 + ["http://junk8.org/es/spam7"] * 3
    verdict = {r.page_id: r.verdict for r in uf.judge(pages(spark, allow + block + other)).collect()}
    assert [verdict[400 + i] for i in range(6)] == ["allow"] * 3 + ["block"] * 3


def test_one_class_only_allows(spark):
    assert {r.verdict for r in uf.judge(pages(spark, ["http://a.com/x", "http://b.org/y"])).collect()} == {"allow"}
