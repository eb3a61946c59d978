import re

from plinth.llm import url_filter as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://A.Example.ORG/es/1?x#y", "http://example.org/en/1", "http://example.org/en/22", "http://b.com/fr/", "https://b.com/de/x", "http://notorg/x", "http://org/", "http://org", "http://x.org?q=/es/",
    "http://example.org#frag", None, "", "no scheme", "http://", "ftp://user@h.com:80/fr/a", "http://a://b/c", "http://ÄB.com/de/é", "http://..org/", "//x.org/y", "http://xexample.org/es/",
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for r in U.judge(df).collect():
        host, path = parts(URLS[r["page_id"]])
        want, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, want), URLS[r["page_id"]]
        if verdict:
            assert r["verdict"] == verdict


def test_reputation_spreads_to_unruled_pages(spark):
    rows = [(k, f"http://bad.com/de/{k}") for k in range(60)] + [(100 + k, f"http://good.com/fr/{k}") for k in range(60)]
    rows += [(200, "http://bad.com/other"), (201, "http://good.com/other"), (202, "http://new.net/x"), (203, None)]
    got = {r["page_id"]: r["verdict"] for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == "block" and got[201] == got[202] == got[203] == "allow"


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (None, "http://a.org/x", "y", 2), (1, None, "x", 1), (2, "http://c.net/", None, 3)], "page_id long, url string, html string, host int")
    assert U.judge(df).count() == 4
    assert U.judge(df.limit(0)).count() == 0


def tree(host):
    site = re.sub(r":\d*$", "", host.rsplit("@", 1)[-1]).rstrip(".")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", site) or site.startswith("["):
        return site, site, site
    labels = site.split(".")
    n = 2 if len(labels) > 1 and labels[-2] in U.SECOND and re.fullmatch("[a-z]{2}", labels[-1]) else 1
    return site, ".".join(labels[-n - 1 :]), ".".join(labels[-n:])


def weight(groups):
    """Moment estimate of a prior's weight from (n, b) of each group."""
    groups = [(n, b) for n, b in groups if n]
    total, bad, m = sum(n for n, _ in groups), sum(b for _, b in groups), len(groups)
    if not total or not 0 < bad < total:
        return 100.0
    p, room = bad / total, total - sum(n * n for n, _ in groups) / total - (m - 1)
    if room <= 0:
        return 100.0
    spread = sum(n * (b / n - p) ** 2 for n, b in groups)
    rho = (spread - p * (1 - p) * (m - 1)) / (room * p * (1 - p))
    return 100.0 if rho <= 0.01 else 1.0 if rho >= 0.5 else (1 - rho) / rho


def brute_reputation(urls):
    """(rate, low) by site."""
    from collections import defaultdict

    levels = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    above = {}
    for url in urls:
        site, domain, suffix = tree(parts(url)[0])
        said = rule(*parts(url))[1]
        above[site] = (domain, suffix)
        for level, name in zip(levels, (site, (domain, suffix), suffix), strict=True):
            level[name][0] += said is not None
            level[name][1] += said == "block"
    ks = [weight(map(tuple, level.values())) for level in levels]
    n, b = (sum(x[k] for x in levels[2].values()) for k in (0, 1))
    p, out = b / n if n else 0.0, {}
    for site, (domain, suffix) in above.items():
        rate = p
        for level, name, k in zip(reversed(levels), (suffix, (domain, suffix), site), reversed(ks), strict=True):
            rate = (level[name][1] + k * rate) / (level[name][0] + k)
        out[site] = rate, rate - U.Z * (rate * (1 - rate) / (levels[0][site][0] + ks[0] + 1)) ** 0.5
    return out


def test_tree(spark):
    hosts = ["a.co.uk", "x.a.co.uk", "co.uk", "10.0.0.1", "10.0.0.1:80", "h.com:80", "me@h.com", "h.com.", "[::1]:80", "a.b.c.net", "localhost", "", "x.com.au", "com.example"]
    got = {r["host"]: (r["site"], r["domain"], r["suffix"]) for r in U.with_tree(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got == {h: tree(h) for h in hosts}
    assert got["x.a.co.uk"] == ("x.a.co.uk", "a.co.uk", "co.uk") and got["10.0.0.1:80"] == ("10.0.0.1",) * 3


def test_reputation_equals_plain_python(spark):
    import random

    import pytest

    rnd = random.Random(2)
    hosts = [f"{a}.{b}{c}" for a in ("x", "www", "m:8080") for b in ("bad", "good", "mixed") for c in (".com", ".co.uk", ".org", ".net")] + ["example.org", "10.1.2.3", "u@bad.com"]
    urls = [f"http://{h}/{rnd.choice(['de/', 'fr/', 'es/', 'en/1', 'x']) if 'bad' not in h else 'de/'}{k}" for k, h in enumerate(rnd.choices(hosts, k=900))] + [None, "nothing"]
    want = brute_reputation(urls)
    got = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for r in got:
        rate, low = want[tree(r["host"])[0]]
        assert (r["rate"], r["low"]) == (pytest.approx(rate, abs=1e-9), pytest.approx(low, abs=1e-9)), r
        verdict = rule(r["host"], r["path"])[1] or ("block" if low > U.MAX_RATE else "allow")
        assert r["verdict"] == verdict


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", 1.0, 2.0, "q", "z")], "page_id long, url string, rate double, low double, site string, n string")
    assert [r["verdict"] for r in U.judge(df).collect()] == ["allow"]
