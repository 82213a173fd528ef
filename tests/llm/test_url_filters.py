from collections import Counter

import duckdb
import pytest

from phylospark.llm import url_filters as U

PAGES = "page_id long, url string, html string, host string, rule string, w int"


def write(spark, tmp_path, pages):
    spark.createDataFrame([(*p, "clash", "clash", 1) for p in pages], PAGES).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def test_hosts_paths_and_rules(spark, tmp_path):
    urls = ["http://a.org/x", "https://EXAMPLE.ORG/es/1", "http://www.example.org/en/12?q#f", "http://example.org/en/2", "http://example.org", "http://org/", "http://notorg/x", "http://borg/", "x.com/fr/", "ftp://x.com/fr/1", "http://com/fr/", "http://x.com/FR/",
            "http://x.com/de/?a://b/c", "a?u=http://y.com/fr/z://q", "://x.org/", "http:///path", "http://É.org/ü", "http://x.org:80/", "http://u@x.org/", "http://x.com#/fr/", "http://x.com?/fr/", "", None, "no scheme", "http://notexample.org/es/", "a\nb://n.org/\npath"]
    got = {r["page_id"]: r for r in U.op12_url_filters(spark, write(spark, tmp_path, [(i, u, None) for i, u in enumerate(urls)])).collect()}
    assert len(got) == len(urls)
    rules = {"org/": ("org", "/", "allow"), "example.org/es/": ("example.org", "/es/", "block"), "example.org/en/1": ("example.org", "/en/1", "block"), "com/fr/": ("com", "/fr/", "allow"), "com/de/": ("com", "/de/", "block")}
    for i, url in enumerate(urls):
        host, path = split(url)
        fits = [k for k, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == rules[rule][2] if rule else got[i]["verdict"] in ("allow", "block")
    assert got[0]["rule"] == "org/" and got[21]["verdict"] == got[22]["verdict"] == "allow"


def link(*hosts):
    return "".join(f"<a class=x HREF = '//{h}/p'>t</a><a href=\"/local\">" for h in hosts)


def linked_pages():
    pages = [(1, "http://good.org/a", link("friend.net", "friend.net", "Other.net:80")), (2, "http://bad.com/de/1", link("victim.net")), (3, "http://farm.net/1", link("bad.com", "bad.com", "friend.net")), (4, "http://friend.net/x", link("friend2.net", "friend.net"))]
    pages += [(5, "http://friend2.net/x", "<a href='https://farm.net/1'>"), (6, "http://victim.net/x", None), (7, "http://farm.net/2", link("bad.com")), (8, "http://island.net/x", "<a href='mailto:a@b.c'>"), (None, None, link("bad.com")), (9, "http://sub.farm.net/x", ""), (9, "http://sub.farm.net/x", "")]
    pages += [(100 + i, "http://hub.net/p", link("bad.com", f"s{i}.net")) for i in range(60)]
    return pages


def ranks(pages, rounds=20, damping=85):
    """The same walk over dictionaries."""
    import re

    edges, seeds = Counter(), ({}, {})
    hosts = set()
    for _, url, html in pages:
        host, path = split(url)
        if not host:
            continue
        hosts.add(host)
        for h in re.findall(r"""href\s*=\s*["']?(?:https?:)?//([^/?#"'<>\s]+)""", (html or "").lower()):
            hosts.add(h)
            if h != host:
                edges[host, h] += 1
        if host == "org" or host.endswith(".org"):
            seeds[0][host] = seeds[0].get(host, 0) + U.UNIT
        elif host.endswith(".com") and path.startswith("/de/"):
            seeds[1][host] = seeds[1].get(host, 0) + U.UNIT
    kin = set()
    for h in hosts:
        labels = h.split(".")
        for i in range(len(labels) - 2):
            lower, upper = ".".join(labels[i:]), ".".join(labels[i + 1 :])
            kin |= {(lower, upper), (upper, lower)}
    for e in kin:
        edges[e] += 1
    found = []
    for kind in (0, 1):
        arcs = {(a, b) if kind == 0 else (b, a): w for (a, b), w in edges.items()}
        total = Counter()
        for (a, _), w in arcs.items():
            total[a] += w
        rank = dict(seeds[kind])
        for _ in range(rounds):
            new = Counter({h: r * (100 - damping) // 100 for h, r in seeds[kind].items()})
            for (a, b), w in arcs.items():
                if a in rank:
                    new[b] += rank[a] * damping * w // (total[a] * 100)
            rank = new
        found.append(rank)
    return found


def test_propagation_equals_a_plain_walk_and_sql(spark, tmp_path):
    pages = linked_pages()
    path = write(spark, tmp_path, pages)
    out = U.op12_url_filters(spark, path)
    rows = out.collect()
    trust, distrust = ranks(pages)
    by_host = {r["host"]: r for r in rows}
    for host, r in by_host.items():
        assert (r["trust"], r["distrust"]) == (trust.get(host, 0), distrust.get(host, 0)), host
    verdict = {h: r["verdict"] for h, r in by_host.items()}
    assert verdict["hub.net"] == "block" and verdict["friend.net"] == verdict["island.net"] == verdict["victim.net"] == "allow"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    wanted = sorted(map(repr, con.execute(U.OP12_SQL).fetchall()))
    assert sorted(repr(tuple(r)) for r in rows) == wanted and out.columns == [c[0] for c in con.description]


def test_empty_table(spark, tmp_path):
    assert U.op12_url_filters(spark, write(spark, tmp_path, [])).collect() == []


def test_a_very_long_page(spark, tmp_path):
    pages = [(1, "http://a.org/", "x" * 2_000_000 + link("far.net") + "<a href=//" + "y" * 500_000), (2, "http://far.net/", "")]
    got = {r["host"]: r for r in U.op12_url_filters(spark, write(spark, tmp_path, pages)).collect()}
    assert got["far.net"]["trust"] > 0 and got["far.net"]["verdict"] == "allow"


def test_no_python_on_the_way(spark, tmp_path):
    plan = U.op12_url_filters(spark, write(spark, tmp_path, linked_pages()))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_too_many_rules():
    with pytest.raises(ValueError):
        U.fitting(None, None, [("a", "/", "allow")] * 1001)
