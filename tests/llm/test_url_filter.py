import numpy as np
import pytest

from platewright.llm import url_filter as u


def split(url):
    """The contract's wording, one character at a time."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = ""
    while rest and rest[0] not in "/?#":
        host, rest = host + rest[0], rest[1:]
    path = ""
    while rest and rest[0] not in "?#":
        path, rest = path + rest[0], rest[1:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [
        (len(h + p), h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits) if fits else None


URLS = [
    "https://www.example.org/es/7", "https://example.org/en/12.html", "https://example.org/en/2", "http://EXAMPLE.ORG/ES/1",
    "http://notexample.org/es/1", "http://example.org.evil.com/de/x", "http://a.com/fr/1", "http://a.com/de", "http://a.com/de/",
    "http://org/", "http://org", "http://x.org?/es/", "ftp://x.com#/fr/", "no scheme.com/fr/", "", None, "://", "http://", "http:///fr/",
    "http://u@example.org:80/es/", "http://a.com/fr/?x=/de/", "http://b.com//fr/", "http://ÄÖ.org/é", "http://casino-bonus-win.net/play",
    "http://library.net/en/books.html", "a://b://c.com/fr/", "http://x.com/fr/" + "y" * 100_000, "http://.com/fr/", "http://com./fr/",
]


def test_every_url_against_the_wording(spark):
    rows = [(i, x, "clash", "clash") for i, x in enumerate(URLS)] + [(None, URLS[0], "", ""), (3, URLS[3], "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    model = u.learn()
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in u.judge(pages).collect()}
    want = set()
    for page_id, url, *_ in rows:
        host, path = split(url)
        fits = rule_of(host, path, u.RULES)
        verdict = fits[2] if fits else "block" if model.log_odds(host, path) > 0 else "allow"
        want.add((page_id, host, path, fits[1] if fits else None, verdict))
    assert got == want and u.judge(pages).count() == len(rows) and u.judge(pages.limit(0)).count() == 0
    kept = u.keep_allowed(pages)
    assert kept.columns == pages.columns
    assert sorted(r.page_id for r in kept.where("page_id is not null").collect()) == sorted(
        w[0] for w in [*want, (3, *[w for w in want if w[0] == 3][0][1:])] if w[0] is not None and w[4] == "allow"
    )


def plain_buckets(host, path):
    out = set()
    for field, value in ((u.HOST, host), (u.PATH, path)):
        s = "^" + "".join("0" if c in "0123456789" else c.lower() if c.isascii() else c for c in value) + "$"
        for size in u.SIZES:
            for i in range(len(s) - size + 1):
                h = field
                for c in s[i : i + size]:
                    h = (h * u.FACTOR + ord(c) + 1) % u.PRIME
                out.add(h % u.BUCKETS)
    return sorted(out)


def test_buckets_and_gradient():
    for url in URLS[:-3]:
        host, path = split(url)
        assert u.buckets(host, path).tolist() == plain_buckets(host, path)
    urls, y = u.default_labels()
    model = u.fit(urls, y, rounds=3000)
    w, bias = model.weights / u.SCALE, model.bias / u.SCALE
    # At the optimum, the slope of the penalised loss vanishes up to the rounding of the weights.
    x = np.zeros((len(urls), u.BUCKETS))
    for i, url in enumerate(urls):
        own = u.buckets(*u.split_url(url))
        x[i, own] = 1 / np.sqrt(len(own))
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    share = np.where(np.array(y) == 1, 0.5 / sum(y), 0.5 / (len(y) - sum(y)))
    slope = x.T @ (share * (p - y)) + u.PULL / len(y) * w
    assert np.abs(slope).max() < 1e-4 and abs((share * (p - y)).sum()) < 1e-4


def test_held_out_folds():
    urls, y = u.default_labels()
    fold = np.random.default_rng(1).integers(0, 5, len(urls))
    right = 0
    for f in range(5):
        model = u.fit([x for x, k in zip(urls, fold) if k != f], [v for v, k in zip(y, fold) if k != f])
        right += sum((model.log_odds(*u.split_url(x)) > 0) == v for x, v, k in zip(urls, y, fold) if k == f)
    assert right / len(urls) >= 0.85


def test_labels_of_ones_own(spark):
    rows = [(f"http://bad{i}.net/x", 1) for i in range(20)] + [(f"http://good{i}.net/y", 0) for i in range(20)]
    rows += [(None, 1), ("http://good1.net/z", None), ("http://good2.net/", 7)]
    labels = spark.createDataFrame(rows, "url string, blocked int")
    model = u.learn(labels)
    assert model.log_odds("bad77.net", "/x") > 0 > model.log_odds("good77.net", "/y")
    one_sided = u.learn(labels.where("blocked = 1"))
    assert one_sided.log_odds("bad1.net", "/x") == 0
    assert u.learn(labels.limit(0)).log_odds("a", "/") == 0
    assert (u.learn(labels, most=3).weights != 0).sum() < (model.weights != 0).sum()
    pages = spark.createDataFrame([(1, "http://bad5.net/x")], "page_id long, url string")
    assert u.judge(pages, rules=(), labelled=labels).first().verdict == "block"


@pytest.mark.parametrize("rules", [(("a.b", "/", "allow"), ("b", "/x/y", "block"), ("a.b", "/x", "block"), ("b", "/xx/", "allow"))])
def test_longest_rule(rules):
    known = u.Rules(rules)
    for host in ("a.b", "b", "z.a.b", "ca.b", ""):
        for path in ("", "/", "/x", "/x/y", "/xx/y", "/x/yz"):
            want = rule_of(host, path, rules)
            got = known.match(host, path)
            assert (got is None) == (want is None) and (want is None or len(got[0]) == want[0])
