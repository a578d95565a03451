"""URL rules of the text language: what they fit, and how few of many are tried."""

import random
import re

import pytest

from quillstrand.llm import url_filter
from quillstrand.llm.url_filter import Rule


def fits(rule, host, path):
    r = Rule.parse(rule)
    return bool(re.search(r.pattern, (host + path).lower(), re.DOTALL))


def test_wildcards_anchors_and_separators():
    yes = [("||ads.example^", "ads.example", "/x"), ("||ads.example^", "a.ads.example", ""), ("/track/*.gif|", "h", "/track/a/b.gif"), ("|shop.", "shop.example", "/"), ("^promo^", "h", "/promo/"), ("||h/a*b", "x.h", "/a--b"), ("||H/Ab", "h", "/aB")]
    no = [("||ads.example^", "ads.example.org", "/"), ("||ads.example^", "badads.example", "/"), ("/track/*.gif|", "h", "/track/a.gif2"), ("|shop.", "my.shop.example", "/"), ("^promo^", "h", "/promotion/")]
    assert all(fits(*x) for x in yes) and not any(fits(*x) for x in no)
    for bad in ("", "@@", "||", "*^*"):
        with pytest.raises(ValueError, match="says nothing"):
            Rule.parse(bad)


def test_tokens_are_whole_in_every_match():
    assert Rule.parse("||ads.example^").tokens == ("ads", "example")
    assert Rule.parse("/track/*.gif|").tokens == ("track", "gif") and Rule.parse("banner").tokens == () and Rule.parse("^foo*bar^").tokens == ()


def test_a_table_of_rules(spark):
    rows = [("||spam.example^",), ("@@||spam.example/about",), ("! a comment",), (None,), (" ",), ("||spam.example^",)]
    rules = url_filter.rules_from(spark.createDataFrame(rows, "rule string"))
    assert [r.name for r in rules] == ["@@||spam.example/about", "||spam.example^"]
    with pytest.raises(ValueError, match="over 1 rules"):
        url_filter.rules_from(spark.createDataFrame(rows, "rule string"), most=1)
    pages = spark.createDataFrame([(1, "http://spam.example/x"), (2, "http://spam.example/about/us"), (3, "http://fine.example/"), (4, "http://spam.example.net/x")], "page_id long, url string")
    out = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.filter_urls(pages, [("net/", "block")], rules).collect()}
    assert out == {1: ("block", "||spam.example^"), 2: ("allow", "@@||spam.example/about"), 3: ("allow", None), 4: ("block", "net/")}


def test_few_of_many_rules_are_tried():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(4, 9)))
    hosts = [f"{word()}.{rng.choice(('example', 'test'))}" for _ in range(4000)]
    rules = [Rule.parse(f"||{h}^") for h in hosts] + [Rule.parse(f"/{word()}/*.{rng.choice(('gif', 'js'))}|") for _ in range(1000)]
    urls = [(rng.choice(hosts) if k % 3 else f"{word()}.example", f"/{word()}/{word()}.gif") for k in range(500)]
    counts: dict[str, int] = {}
    for host, path in urls:
        for t in set(url_filter.TOKEN.findall(host + path)):
            counts[t] = counts.get(t, 0) + 1
    ready = {t: [(r, re.compile(r.pattern, re.DOTALL)) for r in rs] for t, rs in url_filter.index(rules, counts).items()}
    tried: list[Rule] = []
    for host, path in urls:
        best = url_filter.judge(host, path, ready, tried)
        assert (best is not None) == any(re.search(r.pattern, host + path, re.DOTALL) for r in rules if set(r.tokens) <= set(url_filter.TOKEN.findall(host + path)))
    assert len(tried) <= 2 * len(urls)  # of 5,000 rules for each


def test_of_equal_rank_the_first_wins(spark):
    """Whatever token a rule is filed under, and wherever that stands in the URL."""
    pages = spark.createDataFrame([(1, "http://aa.example/zz/x"), *((k, f"http://h{k}.example/aa/") for k in range(2, 9))], "page_id long, url string")
    for names in (("/zz/", "||aa.example^"), ("||aa.example^", "/zz/"), ("/x|", "/zz/", "||aa.example^")):
        rules = [Rule.parse(n) for n in names]
        assert url_filter.filter_urls(pages, [], rules).where("page_id = 1").first()["rule"] == names[0]
