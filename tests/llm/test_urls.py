"""Rules for urls, and the character model where none fits."""

import random

from pyspark.sql import functions as F

from flowtide.llm import urls

SCHEMA = "page_id long, url string, host string, path string, rule string, label string, gram string, n long, model int"


def judged(spark, rows, **how):
    table = spark.createDataFrame([(i, u, "h", "p", "r", "allow", "g", 1, 2) for i, u in rows], SCHEMA)
    return urls.judge(table.repartition(3), **how)


def test_parts_and_rules(spark):
    want = {
        None: ("", "", None), "": ("", "", None), "no scheme.com/": ("", "", None), "http://COM/x": ("com", "/x", "com/"),
        "https://a.Example.com/en/1?x=/fr/": ("a.example.com", "/en/1", "example.com/en/"), "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "http://m.www.example.com/en/a#b": ("m.www.example.com", "/en/a", "www.example.com/en/"), "http://wwwexample.com/en/": ("wwwexample.com", "/en/", "com/"),
        "x://a.net/es": ("a.net", "/es", None), "x://a.net/es/": ("a.net", "/es/", "net/es/"), "x://net/fr/://y.com/": ("net", "/fr/://y.com/", "net/fr/"),
        "http://a.com": ("a.com", "", None), "http://a.com?x": ("a.com", "", None), "http://É.COM/": ("É.com", "/", "com/"), "http://a.com:80/": ("a.com:80", "/", None),
    }
    rows = list(enumerate(want))
    found = {r.page_id: (r.host, r.path, r.rule) for r in judged(spark, rows).collect()}
    assert found == {i: want[u] for i, u in rows}


def test_models_tell_words_of_urls_apart(spark):
    draw = random.Random(1)
    good, bad = ["garden", "recipe", "library"], ["casino", "pills", "jackpot"]
    name = lambda words: "-".join(draw.choices(words, k=3)) + str(draw.randrange(100))
    rows = [f"http://{name(good)}.example.com/de/{i}" for i in range(150)] + [f"http://{name(bad)}.net/es/{i}" for i in range(150)]
    unseen = [("allow", f"http://{name(good)}.org/x/{i}") for i in range(60)] + [("block", f"http://{name(bad)}.org/x/{i}") for i in range(60)]
    found = {r.page_id: r for r in judged(spark, enumerate(rows + [u for _, u in unseen] + [unseen[0][1]] * 3)).collect()}
    right = sum(found[300 + i].verdict == v for i, (v, _) in enumerate(unseen))
    assert right >= 114 and all(found[300 + i].rule is None for i in range(len(unseen)))
    assert {found[420 + i].score for i in range(3)} == {found[300].score}


def test_one_class_alone_rejects_nothing_and_empty_is_empty(spark):
    rows = [(1, "http://a.com/"), (2, "http://b.org/"), (3, None), (3, None), (4, "http://c.org/" + "long/" * 40_000)]
    assert sorted((r.page_id, r.verdict) for r in judged(spark, rows).collect()) == [(1, "allow"), (2, "allow"), (3, "allow"), (3, "allow"), (4, "allow")]
    assert judged(spark, []).count() == 0


def test_hot_urls_are_salted(spark, monkeypatch):
    monkeypatch.setattr(urls, "HOT_URL", 5)
    rows = [(i, "http://same.org/x") for i in range(40)] + [(100 + i, f"http://o{i}.{d}") for i in range(20) for d in ("com/", "net/es/", "org/")]
    out = judged(spark, rows)
    assert out.count() == 100 and out.where(F.col("rule").isNull()).select("url" if "url" in out.columns else "host", "verdict").distinct().count() == 21
