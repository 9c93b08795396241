import pytest

from waymesh.llm import urls

CASES = [
    # url, host, path, rule, verdict (None: the method's)
    ("https://Blog.Example.ORG/es/1?q=/x", "blog.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12#top", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://a.com/fr/x", "a.com", "/fr/x", "com/fr/", "allow"),
    ("https://a.com/de/x", "a.com", "/de/x", "com/de/", "block"),
    ("https://example.org", "example.org", "", None, None),
    ("https://example.org?x=/es/", "example.org", "", None, None),
    ("https://Ä.Com/de/É?", "Ä.com", "/de/É", "com/de/", "block"),
    ("https://u:p@a.com:80/fr/", "u:p@a.com:80", "/fr/", None, None),
    ("x://y://z/w", "y:", "//z/w", None, None),
    ("no scheme/at/all", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None), ("://", "", "", None, None),
    ("https://casino-free.test/" + "a" * 5000, "casino-free.test", "/" + "a" * 5000, None, None),
]


def test_hosts_paths_rules(spark):
    rows = [(k, c[0], "h", "p", 1) for k, c in enumerate(CASES)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, host string, rule string, score int")
    got = urls.judge_urls(pages).collect()
    assert len(got) == len(CASES) + 1
    for g in got:
        _, host, path, rule, verdict = CASES[g.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert g.verdict == (verdict or ("block" if g.score >= 0.5 else "allow"))
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_columns_cut_like_the_training_table():
    for url, host, path, *_ in CASES:
        assert urls.split_url(url or "") == (host, path)


def test_model_on_urls_it_has_not_seen():
    model = urls.train()
    for host in ("casino-star.test", "www.cheap-pills-shop.test", "spam-farm.test", "m.free-bets.test", "blog.ads-track.test"):
        assert model.score(host, "/en/3") > 0.5
    for host in ("www.nature-walks.test", "blog.the-reader.test", "m.physics.test", "school.test"):
        assert model.score(host, "/en/3") < 0.5


def test_training_is_repeatable():
    assert (urls.train().weights == urls.train().weights).all()


@pytest.mark.parametrize("labelled", [[], [("https://a.test/", 1)]])
def test_odd_training_tables(labelled):
    assert 0 <= urls.train(labelled).score("a.test", "/") <= 1
