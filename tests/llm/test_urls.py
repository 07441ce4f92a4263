import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from siltlog.llm import url_filter as U
from siltlog.llm.queries import URL_RULES


def brute(rules, host, path):
    """The fitting rule with most labels, then the longest path, then block."""
    fits = [(len(h.split(".")), len(p), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else None


def test_splitting():
    cases = {
        None: ("", ""), "": ("", ""), "no scheme/x": ("", ""), "http://A.Example.ORG/en/1?x=/y#z": ("a.example.org", "/en/1"), "x://h": ("h", ""), "x://h?q": ("h", ""), "x://h#f/p": ("h", ""),
        "a://b://c/d": ("b:", "//c/d"), "://h/p": ("h", "/p"), "http://É.com/": ("É.com", "/"), "x://": ("", ""), "x:///p": ("", "/p"),
    }
    for url, want in cases.items():
        assert U.split_url(url) == want, url


hosts = st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=3).map(".".join)
paths = st.text("ab/", max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), hosts, paths.map(lambda p: p and "/" + p)), max_size=8), hosts, paths)
def test_trie_against_brute_force(rules, host, path):
    got = U.UrlTrie(rules).find(host, path)
    want = brute(rules, host, path)
    assert (got and got[0], got and got[1]) == (want and want[0], want and want[1])


URLS = ["http://example.org/es/1", "http://x.example.org/en/17", "http://example.org/en/2", "http://notexample.org/es/", "http://a.com/fr/", "http://a.com/de/x", "http://a.com/es/", "http://org", "http://org/", None, "", "HTTP://EXAMPLE.ORG/ES/", "http://casino.net/", "http://example.org/es"]


def test_rows_and_both_forms(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in itertools.chain(enumerate(URLS), enumerate(URLS))] + [(None, URLS[0], "", "")], "page_id long, url string, host string, verdict string")
    trie = sorted(map(repr, U.filter_urls(df, URL_RULES, "page_id", "url").collect()))
    joined = sorted(map(repr, U.filter_urls_joined(df, URL_RULES, "page_id", "url").collect()))
    assert trie == joined and len(trie) == 2 * len(URLS) + 1
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.filter_urls(df, URL_RULES, "page_id", "url").collect()}
    assert got[0] == ("example.org/es/", "block") and got[1] == ("example.org/en/1", "block") and got[2] == ("org/", "allow") and got[3] == ("org/", "allow")
    assert got[4] == ("com/fr/", "allow") and got[5] == ("com/de/", "block") and got[6] == (None, "allow") and got[7] == (None, "allow") and got[8] == ("org/", "allow") and got[9] == (None, "allow")
    assert got[11] == ("org/", "allow") and got[13] == ("org/", "allow")
    assert U.filter_urls(df.limit(0), URL_RULES, "page_id", "url").count() == 0
