import hashlib
import math
from collections import Counter

from kinetrace.llm.urlfilter import CELL, ORDER, STRENGTH, judge_urls

SF = "/root/testdata/sf0.001"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def brute(urls):
    """The models from their definition, all in dictionaries."""
    rest = lambda u: "" if u is None else u.split("://", 1)[1] if "://" in u else u
    padded = lambda t: "\x02" * (ORDER - 1) + t + "\x03"
    counts = {v: Counter() for v in ("allow", "block")}
    contexts = {v: Counter() for v in ("allow", "block")}
    held = lambda t: hashlib.md5(t.encode()).digest()[0] % 5 == 0
    for u in urls:
        r = rule(*parts(u))
        if r and not held(rest(u)):
            t = padded(rest(u))
            for i in range(len(t) - ORDER + 1):
                for k in range(1, ORDER + 1):
                    g = t[i + ORDER - k : i + ORDER]
                    counts[r[0]][g] += 1
                    contexts[r[0]][k, g[:-1]] += 1

    def p(v, gram):
        out = 1 / 256
        for k in range(1, ORDER + 1):
            g = gram[ORDER - k :]
            out = (counts[v][g] + STRENGTH * out) / (contexts[v][k, g[:-1]] + STRENGTH)
        return out

    def score(u):
        t = padded(rest(u))
        grams = [t[i : i + ORDER] for i in range(len(t) - ORDER + 1)]
        return round(sum(round(math.log(p("allow", g)) - math.log(p("block", g)), 9) for g in grams) / len(grams), 6)

    own = [(score(u), rule(*parts(u))[0] == "allow") for u in urls if rule(*parts(u)) and held(rest(u))]
    a, b = sum(y for _, y in own), sum(not y for _, y in own)
    limit = 0.0
    if a and b:
        cells = sorted({math.floor(s / CELL) for s, _ in own})
        limit = max(((sum(y and math.floor(s / CELL) >= c for s, y in own) / a + sum(not y and math.floor(s / CELL) < c for s, y in own) / b, -abs(c), c) for c in cells))[2] * CELL
    out = []
    for u in urls:
        host, path = parts(u)
        r = rule(host, path)
        out.append((host, path, r and r[1] + r[2], r[0] if r else "allow" if score(u) >= limit else "block"))
    return out


def test_verdicts_equal_brute_force(spark):
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://a.example.com/en/", "http://xnet/es/", "http://a.net/es", "http://a.net/fr/?q", "ftp://h?/x", "http://ÄB.net/fr/\n\x02ü", "http://com/", "http://a.org/" + "long/" * 4000, urls[3], urls[3]]
    df = spark.createDataFrame([(i if i % 9 else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rest string")
    got = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in judge_urls(df).collect())
    want = sorted(str((i if i % 9 else None, *w)) for i, w in enumerate(brute(urls)))
    assert got == want


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(df).collect()} == {1: "allow", 2: "allow"}
    assert judge_urls(df.limit(0)).collect() == []


def test_main_path_is_native(spark):
    plan = judge_urls(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
