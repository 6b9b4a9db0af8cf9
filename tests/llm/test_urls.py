from reposift.llm import urls

CASES = {
    "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "https://b.org/free-bets": ("b.org", "/free-bets", "org/", "allow"),
    "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://xexample.org/es/1": ("xexample.org", "/es/1", "org/", "allow"),
    "http://x.com/de/porn": ("x.com", "/de/porn", "com/de/", "block"),
    "http://x.com/fr/porn": ("x.com", "/fr/porn", "com/fr/", "allow"),
    "http://x.net/porn": ("x.net", "/porn", None, "block"),
    "http://x.net/pornography": ("x.net", "/pornography", None, "allow"),
    "http://cheap.net/cheap": ("cheap.net", "/cheap", None, "allow"),
    "http://cheap.net/pills#q": ("cheap.net", "/pills", None, "block"),
    "http://org?q://z": ("org", "", None, "allow"),
    "http://a.net/großporn": ("a.net", "/großporn", None, "allow"),
    "http://a.net/porn…": ("a.net", "/porn…", None, "allow"),
    "http://a.net/gro%C3%9F/porn": ("a.net", "/gro%C3%9F/porn", None, "block"),
    "http://long.net/" + "a/" * 200_000 + "porn": ("long.net", "/" + "a/" * 200_000 + "porn", None, "block"),
    "no scheme/xxx": ("", "", None, "block"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_rules_then_vocabulary(spark):
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(CASES)], "page_id long, url string, verdict string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got == CASES
    assert urls.judge_urls(df.limit(0)).count() == 0
    assert urls.judge_urls(df.union(df)).count() == 2 * len(CASES)
