import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import entries, linkgraph

RULES = [("good.org", "/", "allow"), ("bad.net", "/", "block"), ("both.com", "/a/", "allow"), ("both.com", "/b/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def matched(rules, host, path):
    fits = [
        (len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def brute(pages, links, rules, damping=linkgraph.DAMPING):
    """Verdicts by page and both ranks by host, with dense matrices and many rounds."""
    told = [(key, *split(url)) for key, url in pages]
    judged = [(key, host, path, *matched(rules, host, path)) for key, host, path in told]
    hosts = sorted({h for _, h, _ in told if h} | {x for pair in links for x in pair})
    place = {h: i for i, h in enumerate(hosts)}
    matrix = np.zeros((len(hosts), len(hosts)))
    for a, b in links:
        if a != b:
            matrix[place[a], place[b]] += 1
    ranks = {}
    for kind, verdict, m in (("trust", "allow", matrix), ("distrust", "block", matrix.T)):
        seed = np.zeros(len(hosts))
        for host in {h for _, h, _ in told if h}:
            mine = [j for j in judged if j[1] == host]
            if np.mean([j[4] == verdict for j in mine]) >= linkgraph.SEED_SHARE:
                seed[place[host]] = 1
        seed = (1 - damping) * seed / max(seed.sum(), 1)
        out = m.sum(1, keepdims=True)
        step = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
        rank = seed
        for _ in range(400):
            rank = seed + damping * (rank @ step)
        ranks[kind] = rank
    rows = {}
    for key, host, path, rule, verdict in judged:
        trust, distrust = (ranks[k][place[host]] if host else 0.0 for k in ("trust", "distrust"))
        walked = "block" if distrust > linkgraph.BLOCK_RATIO * trust else "allow"
        rows.setdefault(key, []).append((host, path, rule, verdict or walked, trust, distrust))
    return rows


def compared(spark, pages, links, rules, extra=()):
    """``links`` go on the first page of their host."""
    html = {}
    for a, b in links:
        html.setdefault(a, []).append(f'<a class="x" href="https://{b}/p?q">t</a> <A HREF=//{b.upper()}>u</A>')
    rows, used = [], set()
    for key, url in pages:
        host = split(url)[0]
        rows.append((key, url, "\n".join(html[host]) if host in html and host not in used else None, 0.5, "k", "h"))
        used.add(host)
    schema = "page_id bigint, url string, html string, rank double, kind string, host string"
    got = {}
    for r in linkgraph.judge(spark.createDataFrame(rows, schema), rules).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict, r.trust, r.distrust))
    expected = brute(pages, links, rules)
    assert got.keys() == expected.keys()
    for key, mine in expected.items():
        assert len(mine) == len(got[key])
        for g, e in zip(sorted(got[key], key=str), sorted(mine, key=str)):
            assert g[:3] == e[:3]
            assert g[4:] == pytest.approx(e[4:], abs=1e-3)
            if abs(e[4] - e[5]) > 2e-3 or e[4] == e[5] == 0:
                assert g[3] == e[3]
    return got


def test_random_graphs_match_dense_ranks(spark):
    rng = np.random.default_rng(7)
    hosts = ["good.org", "bad.net", "both.com", "x.good.org"] + [f"h{i}.example" for i in range(20)]
    pages = [(i, f"https://{h}/{'ab'[i % 2]}/{i}") for i, h in enumerate(hosts * 2)]
    # A third of all links leave one host; some hosts have none.
    links = [tuple(rng.choice(hosts[:18], 2)) for _ in range(60)] + [("h0.example", h) for h in hosts[:15]] * 2
    links = [(str(a), str(b)) for a, b in links]
    got = compared(spark, pages, links, RULES)
    assert {row[3] for rows in got.values() for row in rows if row[2] is None} == {"allow", "block"}


def test_chain_ring_and_unlinked_hosts(spark):
    pages = [(1, "http://good.org/"), (2, "http://bad.net/"), (3, "http://a.example/x#y"), (4, "ftp://B.Example?z"),
             (5, "http://far.example/"), (6, "http://both.com/a/1"), (7, "http://both.com/b/1"), (8, "http://out.example/")]
    links = [("good.org", "a.example"), ("a.example", "far.example"), ("far.example", "a.example"),
             ("b.example", "bad.net"), ("out.example", "b.example"), ("bad.net", "elsewhere.example")]
    got = compared(spark, pages, links, RULES)
    verdict = {k: v[0][3] for k, v in got.items()}
    assert verdict == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "block"}


def test_odd_rows(spark):
    pages = [(1, None), (1, None), (None, "http://bad.net/x"), (2, ""), (3, "no scheme"), (4, "://"),
             (5, "http://" + "h" * 5000 + "/" + "p" * 50_000), (6, "HTTP://BAD.NET")]
    got = compared(spark, pages, [("bad.net", "bad.net")], RULES)
    assert [r[3] for r in got[1]] == ["allow", "allow"] and got[6][0][1] == ""
    # The rule's path is '/', and the url has none.
    assert got[6][0][2] is None
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert linkgraph.judge(none).count() == 0


def test_given_pages_with_links(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = entries.queries()["op10_linkgraph"](spark, "/root/testdata/sf0.001")
    assert got.count() == pages.count()
    # A link from every page to a blocked host: what no rule judges is distrusted.
    linked = pages.withColumn("html", F.concat(F.col("html"), F.lit('<a href="http://spam.net/">x</a>')))
    spam = spark.createDataFrame([(-1, "http://spam.net/", "")], "page_id bigint, url string, html string")
    judged = linkgraph.judge(linked.select("page_id", "url", "html").unionByName(spam))
    told = judged.filter("rule IS NULL AND host <> ''").select("verdict").distinct().collect()
    assert [r.verdict for r in told] == ["block"]
