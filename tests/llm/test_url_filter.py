"""URL judgements: parts, rules, boundaries of terms, edge rows."""

from haulcast.llm import url_filter

SCHEMA = "page_id long, url string, html string, host string, verdict int"


def judged(spark, urls):
    df = spark.createDataFrame([(k, u, None, "x", 1) for k, u in enumerate(urls)], SCHEMA)
    return [tuple(r)[1:5] for r in url_filter.judge_urls(df).orderBy("page_id").collect()]


def test_rules_and_parts(spark):
    cases = {
        "http://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12#a": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/2": ("notexample.org", "/es/2", "org/", "allow"),
        "http://x.com/fr/a/de/": ("x.com", "/fr/a/de/", "com/fr/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/DE/": ("x.com", "/DE/", None, "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://x.org?a=/b": ("x.org", "", None, "allow"),
        "http://com/de/casino": ("com", "/de/casino", "com/de/", "block"),
        "x.org/a": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://a.net/b://c.org/": ("a.net", "/b://c.org/", None, "allow"),
        "http://É.net/é\n/x": ("É.net", "/é\n/x", None, "allow"),
    }
    assert judged(spark, list(cases)) == list(cases.values())


def test_vocabulary(spark):
    verdicts = [v for *_, v in judged(spark, [
        "http://casino-win.net/", "http://casinos.net/", "http://free.net/free", "http://free-bets.net/", "http://a.net/?q=CHEAP+Pills",
        "http://freebets.net/", "http://track.net/ads" + "x" * 100_000, "http://" + "a/" * 100_000 + "porn"])]
    assert verdicts == ["block", "allow", "allow", "block", "block", "allow", "allow", "block"]


def test_terms_have_boundaries_and_overlap():
    terms = ("bet", "bets", "free", "free-bet")
    names = lambda text: {terms[k] for k in url_filter.bounded_terms(text, terms)}
    assert names("free-bet") == {"free", "bet", "free-bet"} and names("bets") == {"bets"} and names("xbet bet1") == set()


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert url_filter.judge_urls(none).count() == 0
    assert judged(spark, ["http://a.net/"] * 3) == [("a.net", "/", None, "allow")] * 3
