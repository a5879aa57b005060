import random

from voxloom.llm.urlfilter import Trie, filter_urls, judge_urls

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("a.net", "block"), ("a.net/x/ok", "allow"), ("B.org/Case", "block"), ("b.org/Case/Deep/", "allow")]
SCHEMA = "page_id long, url string, host string, path string, rule string, verdict string, found string, row int, node string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for entry, verdict in rules:
        h, slash, p = entry.partition("/")
        h, p = h.lower(), slash + p
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h), len(p)) > best[0]):
            best = (len(h), len(p)), h + p, verdict
    return host, path, best and best[1], best[2] if best else default


def urls(seed=3, n=400):
    rng = random.Random(seed)
    hosts = ["example.com", "www.example.com", "notexample.com", "EXAMPLE.Com", "com", "a.net", "x.a.net", "aa.net", "net", "b.org", "c.b.ORG", "", ".com", "com.", "a.net:80"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/", "/es", "/x/ok", "/x/okay/1", "/x/o", "/Case", "/Cases/1", "/Case/Deep", "/Case/Deep/", "//", "/en//a", "?q=/en/", "#/es/", "/es/?a#b", "/é/ü"]
    fixed = [None, "", "no scheme", "://", "http://", "a://b://c.com/en/", "http:///x", "mailto:a@example.com", "http://example.com/en/\nnew", "http://" + "a." * 3000 + "com/" + "en/" * 3000, "http://example.com\n.com/en/"]
    return fixed + [f"{rng.choice(('http', 'https'))}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(n)]


def frame(spark, found):
    return spark.createDataFrame([(k if k % 50 else None, u, "h", None, "r", "v", "f", 1, "n") for k, u in enumerate(found)], SCHEMA)


def test_both_ways_equal_brute_force(spark):
    found = urls()
    want = sorted(map(repr, ((k if k % 50 else None, *brute(u, RULES)) for k, u in enumerate(found))))
    for most in (100, 0):  # the trie, and the join beyond its bound
        got = judge_urls(frame(spark, found), RULES, max_entries=most)
        assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_many_random_entries(spark):
    rng = random.Random(8)
    label = lambda: rng.choice("ab")
    rules = list({".".join(label() for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", *("/" + "/".join(label() for _ in range(rng.randint(1, 3))) + rng.choice(("", "/")) for _ in range(4))]): rng.choice(("allow", "block")) for _ in range(120)}.items())
    found = ["http://" + ".".join(label() for _ in range(rng.randint(1, 5))) + "".join("/" + rng.choice(("a", "b", "ab", "")) for _ in range(rng.randint(0, 4))) for _ in range(500)]
    want = [brute(u, rules) for u in found]
    trie = Trie(rules)
    assert [trie.find(h, p) for h, p, _, _ in want] == [(r, v) if r else None for _, _, r, v in want]
    for most in (1000, 0):
        got = judge_urls(frame(spark, found), rules, max_entries=most).collect()
        assert sorted((r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((h, p, r or "", v) for h, p, r, v in want)


def test_second_list_conflicts_and_bad_entries(spark):
    df = frame(spark, ["x", "http://q.a.net/", "http://spam.org/", "http://ok.org/"])
    entries = spark.createDataFrame([("a.net", "allow"), ("A.net", "block"), (None, "block"), ("/x", "block"), ("ok.org", "maybe"), ("ok.org", None)], "entry string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, entries, more=[("spam.org", "block")]).collect()}
    assert got == {None: (None, "allow"), 1: ("a.net", "block"), 2: (None, "block"), 3: (None, "allow")}
    assert {r.verdict for r in judge_urls(df, [], default="block").collect()} == {"block"}


def test_filter_keeps_rows_whole(spark):
    df = frame(spark, ["http://example.com/en/1", "http://example.com/fr/1", "http://example.com/fr/1", None])
    kept = filter_urls(df, RULES)
    assert kept.columns == df.columns and [r.url for r in kept.orderBy("url").collect()] == [None, "http://example.com/fr/1", "http://example.com/fr/1"]
    assert filter_urls(df.limit(0), RULES).count() == judge_urls(df.limit(0), RULES).count() == 0
