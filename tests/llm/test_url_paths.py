from __future__ import annotations

from skein.llm import url_filters as U


def test_deep_paths_and_their_case(spark):
    entries = [("L", "Example.COM/a/b/c", 0, "add"), ("M", "example.com/Shop", 0, "add"), ("N", "a.org/1/2/3/4/5/6", 0, "add"), ("O", "UPPER.net", 0, "add")]
    want = {
        "http://example.com/a/b/c": "L", "http://example.com/a/b/c/d/e?x": "L", "http://example.com/a/b/C": "", "http://example.com/a/b": "", "https://EXAMPLE.com/Shop/x": "M",
        "https://example.com/shop": "", "http://www.a.org/1/2/3/4/5/6": "", "http://a.org/1/2/3/4/5/6/7": "N", "http://a.org/1/2/3/4/5": "", "http://b.upper.net/Q": "O",
    }
    df = spark.createDataFrame([(u, 1) for u in want], "url string, day int")
    out = U.apply_lists(df, spark.createDataFrame(entries, "list string, key string, day int, action string"))
    assert {r.url: r.lists for r in out.collect()} == want
