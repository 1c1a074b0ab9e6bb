import random

from leafmill.llm import queries as Q
from leafmill.llm import urls as U


def split(url):
    if url is None or "://" not in url:
        return None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    tail = rest[at:].split("#")[0]
    return host, tail.split("?")[0], host + tail


def brute(pages, rules):
    def rule(host, path):
        fit = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else None

    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for _, url, links in pages:
        if split(url):
            for link in links:
                group[find(split(url)[2])] = find(split(link)[2])
    state = {}
    for n in list(group):
        s = split("x://" + n)
        r = rule(s[0], s[1])
        state[find(n)] = max(state.get(find(n), 0), {None: 0, "block": 1, "allow": 2}[r and r[1]])
    out = []
    for i, url, _ in pages:
        s = split(url) or ("", "", None)
        r = rule(s[0], s[1]) if split(url) else None
        v = r[1] if r else "block" if s[2] in group and state[find(s[2])] == 1 else "allow"
        out.append((i, s[0], s[1], r and r[0], v))
    return sorted(map(str, out))


def test_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["a.com", "x.example.com", "b.net", "Example.NET", "c.org", "d.info", "e.info"]
    paths = ["", "/", "/en/7", "/en/", "/de/8x", "/de/", "/es/1", "/q?u=/en/", "/z?a=1", "/z?a=2"]
    pool = [f"{r.choice(['http', 'https'])}://{h}{p}{r.choice(['', '#top'])}" for h in hosts for p in paths]
    pages, rows = [], []
    for i in range(160):
        url, links = r.choice(pool), [r.choice(pool) for _ in range(r.choice([0, 0, 0, 1, 1, 2]))]
        html = "<p>x</p>" + "".join(
            f"""<LINK data-x="1" rel='alternate canonical' href="{x.replace('&', '&amp;')}"/>""" if r.random() < 0.5 else f"""<meta http-equiv="Refresh" content="0; URL={x}">""" for x in links
        )
        pages.append((i, url, links))
        rows.append((i, url, html + '<link rel="stylesheet" href="http://a.com/en/1"><link rel=canonical href="javascript:x">', 1))
    for i, url in ((900, None), (901, "no scheme"), (902, ""), (903, "://"), (None, "http://c.org/es/2"), (5, pages[5][1])):
        pages.append((i, url, []))
        rows.append((i, url, None if i == 900 else "<link", 1))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(4)
    got = sorted(map(str, (tuple(x) for x in U.judge(df, Q.URL_RULES).collect())))
    assert got == brute(pages, Q.URL_RULES)
    assert U.judge(df.limit(0), Q.URL_RULES).count() == 0
    assert {x.verdict for x in U.judge(df, []).collect()} == {"allow"}


def test_relative_links_and_chains(spark):
    rows = [
        (1, "https://a.info/x/y?q", '<link rel="canonical" href="//b.info/p">'),
        (2, "http://b.info/p", '<meta http-equiv=refresh content="5;url=/k">'),
        (3, "http://b.info/k", '<link href="z" rel=canonical>'),
        (4, "http://b.info/z", '<link href="http://w.com/en/1" rel="canonical">'),
        (5, "http://b.info/other", '<link href="#here" rel="canonical">'),
        (6, "http://c.info/x", '<link href="http://w.com/en/2" rel="canonical"><meta http-equiv="refresh" content="0;url=http://example.com/en/7">'),
    ]
    got = {x.page_id: x.verdict for x in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), Q.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}
