import re
from collections import Counter, defaultdict

from tessera.llm import url_filter
from tessera.llm.common import work_dir

LINK = '<a class="x" href="{}">t</a>'


def pages():
    rows = []
    hosts = ["good.org", "Blog.Good.ORG", "mid.net", "far.net", "bad.com", "spam.net", "alone.net", "example.org"]
    links = {
        "good.org": ["http://mid.net/", "/x", "mailto:a@b"], "mid.net": ["//far.net/a?b", "https://good.org"], "far.net": ["/"],
        "spam.net": ["http://bad.com/de/1", "HTTP://BAD.COM/de/2"], "bad.com": ["/de/"], "alone.net": ["x.html"],
    }
    for i, h in enumerate(hosts * 3):
        path = {"bad.com": f"/de/{i}", "example.org": ["/es/a", "/en/12", "/en/2"][i % 3]}.get(h, f"/p{i}")
        rows.append((i, f"http://{h}{path}?q=://z#f", "".join(LINK.format(x) for x in links.get(h.lower(), []))))
    rows += [(100, None, None), (101, "no scheme", LINK.format("http://bad.com/")), (102, "http://", ""), (103, "ftp://x.com/fr/a", None), (104, "http://x.com/fr", "")]
    rows += [(None, "https://good.org#a/b", ""), (0, rows[0][1], rows[0][2])]
    return rows


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def expected(rows):
    edges, allowed, blocked, hosts = Counter(), Counter(), Counter(), set()
    for _, url, html in rows:
        host, path = parts(url)
        verdict = rule(host, path)[1]
        if not host:
            continue
        hosts.add(host)
        allowed[host] += verdict == "allow"
        blocked[host] += verdict == "block"
        for link in re.findall('href="([^"]*)"', html or ""):
            if link.startswith("//") or re.match("(?i)https?://", link):
                to = parts("http:" + link if link.startswith("//") else link)[0]
            elif re.match("[A-Za-z][A-Za-z0-9+.-]*:", link):
                to = ""
            else:
                to = host
            if to:
                edges[host, to] += 1
                hosts.add(to)
    for h in hosts:
        edges[h, h] += 1

    def spread(edges, seeds):
        total = sum(seeds.values()) or 1
        seed = {h: seeds[h] / total for h in hosts}
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        rank = dict(seed)
        for _ in range(url_filter.ROUNDS):
            got = defaultdict(float)
            for (a, b), n in edges.items():
                got[b] += rank[a] * n / out[a]
            rank = {h: (1 - url_filter.DAMPING) * seed[h] + url_filter.DAMPING * got[h] for h in hosts}
        return rank

    trust = spread(edges, allowed)
    distrust = spread({(b, a): n for (a, b), n in edges.items()}, blocked)
    out = []
    for page, url, _ in rows:
        host, path = parts(url)
        name, verdict = rule(host, path)
        if verdict is None:
            bad = host in hosts and distrust[host] > url_filter.THRESHOLD * (trust[host] + distrust[host])
            verdict = "block" if bad else "allow"
        out.append((page, host, path, name, verdict))
    return Counter(out)


def test_rules_and_propagation(spark):
    df = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, verdict string")
    want = expected(pages())
    assert Counter(tuple(r) for r in url_filter.url_verdicts(df).collect()) == want
    by = {r[0]: r[4] for r in want}
    assert by[5] == "block" and by[2] == "allow" and by[6] == "allow"  # spam.net links to bad.com, mid.net is linked from good.org


def test_hosts_in_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", 2)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    assert Counter(tuple(r) for r in url_filter.url_verdicts(df).collect()) == expected(pages())


def test_ranks_sum_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 2, 0), ("c", 0, 5)], "host string, allowed long, blocked long")
    rows = url_filter.propagated(edges, seeds, work_dir(spark, "test")).collect()
    assert abs(sum(r.trust for r in rows) - 1) < 1e-9 and abs(sum(r.distrust for r in rows) - 1) < 1e-9


def test_empty_table(spark):
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_distrust_reaches_hosts_over_many_links(spark):
    n = 33
    rows = [(i, f"http://h{i}.net/", LINK.format(f"http://h{i + 1}.net/" if i + 1 < n else "http://bad.com/de/")) for i in range(n)]
    rows += [(n, "http://bad.com/de/", ""), (n + 1, "http://good.org/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.verdict for r in url_filter.url_verdicts(df).collect()}
    assert found == {i: "block" for i in range(n + 1)} | {n + 1: "allow"}
