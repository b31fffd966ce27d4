import numpy as np
import pytest

from terraweave.llm import queries, url_filter

SF = "/root/testdata/sf0.001"
URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.Org/x", "https://example.org", "https://sub.example.org/es/1?q=/", "https://example.org/en/12#/x",
    "https://example.org/en/2", "http://a.com/fr/x?y#z", "http://a.com/de/", "http://notcom/de/", "http://x.org?a=/", "http://x.org#://y.com/de/", "http://É.org/É", "a://b://c.org/x", "http://x.org/a\nb",
]


def brute(url):
    host, path = url_filter.split_url(url)
    best = None
    for rule in queries.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] * 2, "page_id long, url string, Host string")
    got = url_filter.judge(df, queries.RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule) == brute(URLS[r.page_id]), URLS[r.page_id]
        assert r.verdict == (queries.RULES[r.rule] if r.rule else "block" if r.score >= url_filter.THRESHOLD else "allow")
    assert url_filter.judge(df.limit(0), queries.RULES).count() == 0


def test_query(spark):
    urls = {r.page_id: r.url for r in queries.table(spark, SF, "pages").collect()}
    got = queries.op3_url_filter(spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule) == brute(urls[r.page_id])


@pytest.mark.parametrize("url, verdict", [
    ("https://mega-lotto-jackpot.example.net/fr/1", "block"), ("http://www.erotikchat.example.org/en/77", "block"), ("https://m.blackjack-vip.test/a", "block"), ("http://hookup-dates.example.com", "block"),
    ("https://national-library.example.org/en/2", "allow"), ("http://blog.ondarel.example.com/de/3.html", "allow"), ("https://oceanography.example.org", "allow"), (None, "allow"), ("", "allow"), ("http://" + "a" * 100_000, "allow"),
])
def test_verdicts_of_unseen_urls(spark, url, verdict):
    assert url_filter.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), {}).first().verdict == verdict


def logit(w, url):
    at = url_filter._grams(*url_filter.split_url(url))
    return w[at].sum() / max(len(at), 1) ** 0.5 + w[-1]


def test_words_the_model_has_not_seen():
    """Folds keep all URLs of a word together."""
    rows = url_filter.labelled()
    fold = {w: i % 5 for i, w in enumerate(sorted({w for _, _, w in rows}))}
    right = {0: [], 1: []}
    for f in range(5):
        w = url_filter.train([(u, b) for u, b, word in rows if fold[word] != f])
        for url, blocked, word in rows:
            if fold[word] == f:
                right[blocked].append((1 / (1 + np.exp(-logit(w, url))) >= url_filter.THRESHOLD) == bool(blocked))
    assert np.mean(right[1]) >= 0.8 and np.mean(right[0]) >= 0.75
    with pytest.raises(ValueError):
        url_filter.train([("x", 0)] * (url_filter.MAX_LABELLED + 1))


def test_training_finds_the_least_loss():
    """Against Newton's method on the dense matrix of a few rows."""
    rows = url_filter.LABELLED[::90]
    penalty = 0.01
    places = [url_filter._grams(*url_filter.split_url(u)) for u, _ in rows]
    used = np.unique(np.concatenate(places))
    x = np.zeros((len(rows), len(used) + 1))
    for i, p in enumerate(places):
        x[i, np.searchsorted(used, p)] = 1 / max(len(p), 1) ** 0.5
    x[:, -1] = 1
    y = np.array([b for _, b in rows], float)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = x.T @ (x * (share * p * (1 - p))[:, None]) + penalty * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (share * (p - y)) + penalty * w)
    got = url_filter.train(rows, penalty, 4000)
    assert np.abs(got[used] - w[:-1]).max() < 1e-4 and abs(got[-1] - w[-1]) < 1e-4
