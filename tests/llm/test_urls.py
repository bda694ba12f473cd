from __future__ import annotations

from tenderscope.llm.q_urls import RULES
from tenderscope.llm.url_filter import judge


def link(u):
    return f'<head><LINK href="{u}" rel=canonical></head>'


def moved(u):
    return f"<meta content='0; url={u}' http-equiv=\"refresh\">"


def test_rules_aliases_and_odd_rows(spark):
    rows = [
        (1, "https://A.example.org/en/177?x#y", None),  # blocked by the longest rule
        (2, "http://example.org/fr/1", ""),  # allowed by org/
        (3, "http://x.net/a", moved("http://www.b.com/de/1")),  # alias of a blocked page
        (4, "http://www.b.com/de/1", None),
        (5, "http://y.net/b/", link("../c")),  # relative, nowhere
        (6, "http://z.net/1", link("http://q.com/de/2")),  # alias of a blocked and of an allowed url
        (7, "http://q.com/de/2", link("//r.org/ok")),
        (8, None, link("http://q.com/de/2")),
        (9, "no scheme", "<link rel=canonical>"),
        (10, "http://com/fr/", None),
        (11, "http://notexample.org/es/1", None),
        (12, "ftp://x.net/a#frag", None),  # the same node as 3
        (12, "ftp://x.net/a#frag", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' as verdict", "1 as other")
    out = judge(pages, RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == 13 and out[0]["other"] == 1
    assert got[1] == ("a.example.org", "/en/177", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/fr/1", "org/", "allow")
    assert got[3] == ("x.net", "/a", None, "block") and got[12][3] == "block"
    assert got[4] == ("www.b.com", "/de/1", "com/de/", "block")
    assert got[5][3] == "allow"
    assert got[6] == ("z.net", "/1", None, "allow") and got[7] == ("q.com", "/de/2", "com/de/", "block")
    assert got[8] == ("", "", None, "allow") == got[9]
    assert got[10] == ("com", "/fr/", "com/fr/", "allow") and got[11] == ("notexample.org", "/es/1", "org/", "allow")


def test_chains_hubs_and_empty(spark):
    rows = [(i, f"http://n{i}.net/p", link(f"http://n{i + 1}.net/p")) for i in range(40)] + [(99, "http://n40.net/p", link("http://b.com/de/x"))]
    rows += [(200 + i, f"http://h{i}.net/p", link("http://hub.net/")) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = spark.createDataFrame([("http://hub.net/", "http://c.com/de/1"), (None, "http://x.net/")], "source string, target string")
    out = judge(pages, RULES, redirects=more).collect()
    assert {r["verdict"] for r in out} == {"block"}
    assert {r["n_aliases"] for r in out} == {42, 302}
    assert judge(pages.limit(0), RULES).collect() == []


def test_columns_of_any_name(spark):
    names = "_said string, _node string, node__ string, made__ int, Passed__ string, `a b` string, host string, n_aliases int"
    rows = [("http://x.net/a", moved("http://www.b.com/de/1"), "s", "n", "k", 1, "p", "ab", "own", 7), ("http://www.b.com/de/1", None, "t", "m", "l", 2, "q", "cd", "own", 8)]
    df = spark.createDataFrame(rows, "`the url` string, `the html` string, " + names)
    got = {r["the url"]: r for r in judge(df, RULES, "the url", "the html").collect()}
    first = got["http://x.net/a"]
    assert first["verdict"] == "block" and first["n_aliases"] == 2 and first["host"] == "x.net"
    assert [first[c] for c in ("_said", "_node", "node__", "made__", "Passed__", "a b")] == ["s", "n", "k", 1, "p", "ab"]


def test_dots_entities_comments_and_rel_words(spark):
    rows = [
        (1, "http://m.com/x/y/1", link("../../de/./2")),  # m.com/de/2
        (2, "http://n.net/1", f"<!-- {link('http://www.b.com/de/1')} --><p>"),
        (3, "http://o.net/1", '<link rel="alternate canonical" href="http://www.b.com/de/1">'),
        (4, "http://p.net/q?a=1&b=2", None),
        (5, "http://q.net/1", link("http://p.net/q?a=1&amp;b=2")),
        (6, "http://r.net/1", link("http://com/de/x/../../fr/9/..")),  # com/fr/
        (7, "http://s.net/1", '<link rel="noncanonical" href="http://www.b.com/de/1">'),
    ]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert got[1]["verdict"] == "block" and got[3]["verdict"] == "block"
    assert got[2]["verdict"] == "allow" and got[2]["n_aliases"] == 1 and got[7]["n_aliases"] == 1
    assert got[4]["n_aliases"] == got[5]["n_aliases"] == 2
    assert got[6]["verdict"] == "allow" and got[6]["n_aliases"] == 2


def test_groups_of_a_long_path_and_a_hub(spark):
    from tenderscope.llm.aliases import alias_groups

    rows = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(130)] + [("hub", f"x{i}") for i in range(200)] + [("z", "z"), (None, "y"), ("p000", "p001")]
    got = {r["id"]: r["component"] for r in alias_groups(spark.createDataFrame(rows, "source string, target string")).collect()}
    assert len(got) == 131 + 201 + 1
    assert {v for k, v in got.items() if k[0] == "p"} == {"p000"} and {v for k, v in got.items() if k[0] in "xh"} == {"hub"} and got["z"] == "z"
