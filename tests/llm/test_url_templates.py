from patchlight.llm import url_templates
from patchlight.llm.storage import saved
from patchlight.llm.url_templates import filter_urls

PAGES = "page_id long, url string, host string"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]


def judged(spark, rows, bad=()):
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES)
    labels = spark.createDataFrame([(k, b) for k, b in bad], "page_id long, bad boolean")
    return {r["page_id"]: r for r in filter_urls(pages, labels, RULES).collect()}


def test_hosts_paths_and_the_longest_rule(spark):
    got = judged(spark, [(1, "http://WWW.Example.com/en/1?x#y"), (2, "https://a.example.com/en/"), (3, "http://example.com"), (4, None), (5, "no link"), (6, "x://b.org#/en/"), (7, "http://notexample.com/en/1"), (8, "http://com/EN/")])
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("example.com/en/", "block")
    assert got[3]["path"] == "" and got[3]["rule"] is None
    assert (got[4]["host"], got[4]["path"], got[5]["host"], got[5]["path"]) == ("", "", "", "")
    assert (got[6]["host"], got[6]["path"]) == ("b.org", "")
    assert got[7]["rule"] == got[8]["rule"] == "com/"


def test_bad_templates_are_rejected_and_their_unlabelled_pages_with_them(spark):
    rows = [(k, f"http://h.org/spam/{k}.html") for k in range(40)] + [(100 + k, f"http://h.org/good/{k}.html") for k in range(200)]
    labels = [(k, True) for k in range(30)] + [(100 + k, False) for k in range(150)]
    got = judged(spark, rows, labels)
    assert got[39]["template"] == "spam/*" and got[39]["verdict"] == "block"
    assert got[299]["verdict"] == "allow"


def test_many_children_become_a_wildcard(spark):
    got = judged(spark, [(k, f"http://h.org/user/{'abcdefghijkl'[k]}/page") for k in range(12)] + [(20, "http://i.org/user/me/page")])
    assert got[3]["template"] == "user/*/page" and got[20]["template"] == "user/me/page"
    assert all(r["verdict"] == "allow" for r in got.values())


def test_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a", "x"), (1, "http://h.org/a", "x"), (None, "http://h.org/a", None)], PAGES)
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert filter_urls(pages, none, RULES).count() == 3
    assert filter_urls(pages.limit(0), none, RULES).count() == 0


def test_paths_of_any_depth(spark):
    rows = [(k, f"http://h.org/a/b/c/d/e/f/{'abcdefghijkl'[k]}/g") for k in range(12)] + [(50, "http://h.org/" + "/".join(f"p{'x' * k}" for k in range(400)))]
    got = judged(spark, rows)
    assert got[5]["template"] == "a/b/c/d/e/f/*/g" and len(got[50]["template"].split("/")) == 400


def test_equal_shares_of_good_and_bad_pass(spark):
    got = judged(spark, [(k, f"http://h.org/x/{k}") for k in range(4)], [(0, True), (1, False), (2, True), (3, False)])
    assert all(r["purity"] == 0.5 and r["verdict"] == "allow" for r in got.values())


def test_deep_traps_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(url_templates, "saved", lambda df, name: written.append(name) or saved(df, name))
    rows = [(k, "http://h.org/" + "/".join(["a"] * k)) for k in range(1, 400)]
    rows += [(1000 + k, "http://h.org/" + "b/" * 300 + "abcdefghijkl"[k % 12] + "/c/" + "mnopqrstuvwx"[k // 12]) for k in range(144)]
    got = judged(spark, rows)
    assert got[399]["template"] == "/".join(["a"] * 399) and got[1000]["template"] == "b/" * 300 + "*/c/*"
    assert written.count("url-tree") == 3


def test_the_method_blocks_where_no_rule_says_otherwise(spark):
    rows = [(k, f"http://h.org/spam/{k}") for k in range(40)] + [(100 + k, f"http://h.com/spam/{k}") for k in range(40)]
    got = judged(spark, rows, [(k, True) for k in range(40)] + [(100 + k, True) for k in range(40)])
    assert {(r["method"], r["verdict"], r["rule"]) for r in got.values()} == {("block", "block", None), ("block", "allow", "com/")}
