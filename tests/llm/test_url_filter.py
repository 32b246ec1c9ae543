import random
import re

from helixframe.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/x/", "allow"), ("a.net", "", "block"), ("net", "/fr/", "block"), (None, "/", "block"), ("Dup.org", "/", "allow"), ("dup.org", "/", "block")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), v == "block", h.lower() + p, v) for h, p, v in RULES if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_against_brute_force(spark):
    r = random.Random(1)
    urls = [None, "", "no scheme", "http://", "http://COM/", "http://net", "x://www.example.com/en/?a", "http://.com/", "http://a..net/es/", "http://a.net./", "http://examplexcom/en/", "http://dup.org/x", "h://" + "a." * 300 + "net/es/x/y", "http://é.net/es/ü#x"]
    for _ in range(400):
        host = ".".join(r.choice(["www", "example", "a", "com", "net", "m"]) for _ in range(r.randint(1, 4)))
        urls.append("http://" + host + r.choice(["", "/", "/en/", "/en/x", "/es/", "/es/x/", "/es/x/y?q", "/fr", "/fr/#t"]))
    urls += ["http://a.net/es/x/1"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "url as host", "'x' as rule")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {row.page_id: tuple(row)[1:] for row in url_filter.judge_urls(df, rules, keep=("page_id",)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}


def test_empty(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(df, rules, keep=("page_id",)).collect()] == [(1, "a.com", "/", None, "allow")]
    assert url_filter.judge_urls(df.limit(0), rules, keep=("page_id",)).count() == 0


def test_home_pages_of_many_hosts_share_no_task(spark):
    """Half of 4,000 hosts have the path ``/``: their keys below ``com/`` are one, which is swept as one row."""
    from pyspark.sql import functions as F

    urls = spark.range(4000).select(F.concat(F.lit("http://h"), "id", F.lit(".com/"), F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("p"), "id"))).alias("url"))
    rules = spark.createDataFrame([("com", "/", "allow"), ("h8.com", "/", "block"), ("com", "/p1", "block")], "host string, path string, verdict string")
    got = {(x.host, x.path): (x.rule, x.verdict) for x in url_filter.judge_urls(urls, rules).collect()}
    assert len(got) == 4000 and got["h8.com", "/"] == ("h8.com/", "block") and got["h4.com", "/"] == ("com/", "allow")
    assert all(v == (("com/p1", "block") if p.startswith("/p1") else ("h8.com/", "block") if h == "h8.com" else ("com/", "allow")) for (h, p), v in got.items())
