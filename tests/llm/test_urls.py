import math
import re

from factloom.llm import urls

PAGES = "page_id long, url string, html string"


def pages(spark, found, first=0):
    return spark.createDataFrame([(first + i, u, "x") for i, u in enumerate(found)], PAGES).repartition(3)


def texts(spark, *found):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(found)], "doc_id long, text string, page_id string")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :])[0]


def by_rule(host, path, rules):
    fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else None


ODD = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.org", "http://a.Example.ORG/es/x?q=/en/", "http://example.org/en/12#/es/", "http://notexample.org/en/1", "http://x.example.org?/es/", "a://b://c/d"]
ODD += ["http://org/", "http://org", "http://.org/", "http://a..com/de/", "http://com.de/de/x", "http://x.com/fr", "http://x.com/fr/", "http://É.com/de/\n?", "http://user:p@x.com:80/de/", "http://" + "a." * 3000 + "com/de/" + "b" * 9000]


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in urls.judged(pages(spark, ODD + ODD), texts(spark, "a few words")).collect()}
    assert len(got) == 2 * len(ODD)
    for i, url in enumerate(ODD + ODD):
        host, path = split(url)
        want = by_rule(host, path, urls.RULES)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (want[1] if want else None)
        assert got[i].verdict in ("allow", "block") and (not want or got[i].verdict == want[0])


def test_the_longest_rule_wins(spark):
    rules = [("block", "net", "/"), ("allow", "a.net", "/"), ("block", "a.net", "/x"), ("allow", "net", "/xyzzy"), ("allow", "b.net", "/q"), ("block", "b.net", "/q"), ("allow", "net", "")]
    found = [f"http://{h}{p}" for h in ("net", "a.net", "b.a.net", "ba.net", "b.net", "c.b.net") for p in ("", "/", "/x", "/xyzzy/1", "/q", "/xq")]
    for r in urls.judged(pages(spark, found), texts(spark), rules).collect():
        want = by_rule(r.host, r.path, rules)
        assert (r.verdict, r.rule) == want


CLEAN = [f"https://{h}.net/en/{i}" for i, h in enumerate(["riverbank", "oldbridge", "www.stonegarden", "blog.lakehouse", "m.greenhill", "sunrise", "harbour-view", "treasure", "essex", "sextant-shop", "pillsbury"] * 3)]
BAD = ["http://casino-win.net/en/1", "http://www.cheap-pills.net/en/2", "http://free-bets.net/x", "http://m.ads-track.net/de/3"]


def test_words_decide(spark):
    corpus = texts(spark, "the river bank and the old bridge of stone in a garden by the lake house on a green hill at sunrise " * 30, "harbour view treasure essex sextant pillsbury win " * 20, None, "")
    joined = ["http://casinowin.net/", "http://cheappills.net/en/", "http://blog.freecasinopoker.net/en/77", "http://win-track.net/"]
    got = {r.page_id: r for r in urls.judged(pages(spark, CLEAN + BAD + joined), corpus).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == set(range(len(CLEAN), len(CLEAN) + len(BAD) + len(joined)))
    assert all(r.rule is None for r in got.values())


def test_paths_count_too(spark):
    corpus = texts(spark, "river bank " * 30)
    got = {r.page_id: r.verdict for r in urls.judged(pages(spark, CLEAN + BAD + ["http://riverbank.net/casino/poker/roulette", "http://riverbank.net/en/9"]), corpus).collect()}
    assert got[len(CLEAN) + len(BAD)] == "block" and got[len(CLEAN) + len(BAD) + 1] == "allow"


def test_hot_urls_empty_tables_and_no_documents(spark):
    found = ["http://casino-win.net/en/1"] * 500 + CLEAN
    rows = urls.judged(pages(spark, found), texts(spark)).collect()
    assert len(rows) == len(found) and sum(r.verdict == "block" for r in rows) == 500
    assert urls.judged(pages(spark, []), texts(spark, "x")).count() == 0
    assert [r.verdict for r in urls.judged(pages(spark, ["http://x.net/"]), texts(spark), []).collect()] == ["allow"]


def cheapest(name, costs):
    """Every cut of a short name, unknown pieces included."""
    best = {"": (0.0, [])}

    def go(rest):
        if rest not in best:
            options = []
            for n in range(1, len(rest) + 1):
                more, words = go(rest[n:])
                piece = min(costs.get(rest[:n], float("inf")), urls.PIECE + urls.PIECE_LETTER * n)
                options.append((piece + more, [rest[:n], *words]))
            best[rest] = min(options, key=lambda x: x[0])
        return best[rest]

    return go(name)[0]


def whole(name):
    return urls.WHOLE + urls.WHOLE_LETTER * len(name)


def cost_of(words, costs):
    cost = sum(min(costs.get(w, float("inf")), urls.PIECE + urls.PIECE_LETTER * len(w)) for w in words)
    return min(cost, whole(words[0])) if len(words) == 1 else cost


def test_cuts_are_the_cheapest():
    costs = {"cheap": 7.0, "pills": 8.0, "pill": 9.0, "s": 4.0, "he": 3.0, "cheaps": 20.0, "a": 2.0, "spill": 9.0, "an": 3.5}
    for name in ("cheappills", "cheapspills", "pillsxyz", "xx", "a", "anaana", "heheapqills", ""):
        words = urls.cut(name, costs)
        assert "".join(words) == name
        assert abs(cost_of(words, costs) - (min(cheapest(name, costs), whole(name)) if name else 0)) < 1e-9
    assert urls.cut("cheappills", costs) == ["cheap", "pills"]
    assert urls.cut("qqqcheapcheapcheap", costs) == ["qqq", "cheap", "cheap", "cheap"]
    assert urls.cut("qqqcheapqqq", costs) == ["qqqcheapqqq"]
    assert "".join(urls.cut("ab" * 30_000, costs)) == "ab" * 30_000


def test_unigrams_and_cuts_from_tables(spark):
    keys = spark.createDataFrame([("cheap-pills.net", "/a_b/c"), ("cheap-x.net", "/a_b/c")], "host string, path string")
    model = {r.word: r.cost for r in urls.unigrams(texts(spark, "Pills pills the " + "z" * 40, None), keys).collect()}
    assert model["the"] < 3 and model["cheap"] < model["academy"] and "z" * 40 not in model
    got = {r.name: r.words for r in urls.segmented(spark.createDataFrame([("cheappills",), ("thecheap",), ("qq" * 50,)], "name string"), spark.createDataFrame(list(model.items()), "word string, cost double")).collect()}
    assert got == {"cheappills": ["cheap", "pills"], "thecheap": ["the", "cheap"], "qq" * 50: ["qq" * 50]}


def test_the_fit_counts_hosts_not_pages(spark):
    uses = spark.createDataFrame([("h1", "casino", True), ("h1", "farm", True), ("h1", "farm", False), ("h1", "farm", False), ("h2", "lake", True), ("h2", "casino", False), ("h3", "lake", True)], "host string, word string, in_host boolean")
    odds, prior = urls.log_odds(uses, ("casino",))
    odds = {r.word: r.odds for r in odds.collect()}
    assert abs(prior - math.log(2 / 3)) < 1e-12
    known = len({"casino", *urls.PLAIN})
    share = {"casino": 1, "farm": 1, "lake": 2}  # not the casino in a path of h2
    for word, (b, a) in {"casino": (1, 0), "farm": (1, 0), "lake": (0, 2)}.items():
        p = 0.9 * share[word] / 4 + (0.1 / known if word in ("casino", "farm") else 0)
        drawn = 0.5 * p + (0.5 if word == "casino" else 0)
        want = math.log(((b + 10 * drawn) / 12) / ((a + 10 * p) / 12))
        assert abs(odds[word] - want) < 1e-9
    assert odds["farm"] > odds["lake"]
