import random

from crosscut.llm.url_filter import url_filter

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("a.b.c", "", "block"), ("C", "/x", "allow")]


def judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    path = path[:end]
    fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def run(spark, rows, rules=RULES):
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    r = spark.createDataFrame(rules, "host string, path string, action string")
    return {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter(pages, r).collect()}


def test_random_urls(spark):
    rng = random.Random(4)
    low = [(h.lower(), p, a) for h, p, a in RULES]
    hosts = ["com", "example.com", "Www.Example.COM", "net", "x.net", "a.b.c", "z.a.b.c", "xa.b.c", "c", "q.c", "com.", ".com", "", "İ.com", "org"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/71?q", "/en/6#x", "/de/1", "/x/y", "/X", "?a=/en/", "#/en/", "/en/\U0001f600"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}", 1) for i in range(300)]
    rows += [(300, None, 1), (301, "", 1), (302, "no scheme", 1), (303, "a://b://c/en/", 1), (304, "://com/en/x", None), (305, "http://" + "a." * 3000 + "com/en/", 1), (306, "http://com/en/" + "y" * 100_000, 1)]
    got = run(spark, rows)
    for i, url, _ in rows:
        assert got[i] == judge(url, low), url


def test_repeated_rows_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://com/en/")] * 3, "page_id long, url string")
    r = spark.createDataFrame([], "host string, path string, action string")
    assert [x["verdict"] for x in url_filter(pages, r).collect()] == ["allow"] * 3
    r = spark.createDataFrame([("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block"), ("", "/", "block")], "host string, path string, action string")
    assert [(x["rule"], x["verdict"]) for x in url_filter(pages, r).collect()] == [("com/", "allow")] * 3
    assert url_filter(pages.limit(0), r).count() == 0


def test_nested_rules_use_the_innermost(spark):
    rules = [("d", "/" + "a" * k, "block" if k % 2 else "allow") for k in range(6)]
    rows = [(k, "http://d/" + "a" * k + "b", 0) for k in range(8)]
    got = run(spark, rows, rules)
    assert [got[k][2] for k in range(8)] == ["d/" + "a" * min(k, 5) for k in range(8)]


def test_urls_without_a_host_are_spread(spark):
    pages = spark.createDataFrame([(i, None if i % 2 else "no host") for i in range(200)] + [(500, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/", "block")], "host string, path string, action string")
    rows = url_filter(pages, rules).collect()
    assert sum(r["verdict"] == "allow" and r["rule"] is None and r["host"] == "" for r in rows) == 200
    assert [(r["rule"], r["verdict"]) for r in rows if r["page_id"] == 500] == [("a.com/", "block")]


def test_release_frees_what_calls_have_written(spark):
    from crosscut.llm import shared

    s = shared.Scratch(spark, "test")
    s.keep(spark.range(3))
    assert shared.path_exists(spark, s.root)
    shared.release()
    assert not shared.path_exists(spark, s.root)
