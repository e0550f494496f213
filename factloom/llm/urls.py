"""Operator 13: URL filters from rules, and from the words of hosts and paths.

1. Rules (verdict, host, path) meet urls by equi-joins of a host's suffixes and a path's
   beginnings of the lengths that rules have; the longest rule that fits decides.
2. Other urls are judged by words.  Names are runs of letters of a host or path.  Each
   different name is cut into words by Viterbi over a unigram model, a mixture of the
   words of all documents, the parts of compounds in all urls ("cheap-pills") and a short
   list of words that filters know.  The pieces of names meet the model's words in a join.
3. A multinomial naive Bayes scores the words.  Its examples are all hosts of the table: a
   host with a listed word is an example of what to block, any other of what to allow; a
   word counts once for each host that uses it, in its name or paths (listed words in the
   paths of the others tell neither way, and do not count).  Counts are smoothed towards
   the words' share of all hosts, and for blocking also towards the list.  So what comes
   with listed words is learned, and listed words work where no host has one.
4. A url is blocked if the sum of its words' log odds and the prior is above 0.

Model, names and urls are tables throughout; nothing is collected but two totals and the
rules' lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import spread_join, stored, table

#: (verdict, host, path): fixed values of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that mark what is to be blocked; the model is smoothed towards them.
LISTED = (
    "adserver", "ads", "adult", "bet", "bets", "betting", "bingo", "casino", "cheap", "cialis", "clickbait", "crack", "dating", "doubleclick", "drugs", "escort", "fake",
    "gambling", "hookup", "jackpot", "keygen", "loan", "loans", "lottery", "malware", "naked", "nude", "payday", "pharma", "pharmacy", "phish", "phishing", "pills", "pirate",
    "poker", "popup", "porn", "replica", "roulette", "scam", "sex", "sexy", "slot", "slots", "spam", "spammy", "spyware", "torrent", "tracker", "tracking", "track", "viagra",
    "virus", "warez", "webcam", "xxx",
)
#: Words that hosts and paths are often made of; they only help to cut names.
PLAIN = (
    "about", "academy", "account", "api", "archive", "art", "article", "articles", "best", "blog", "book", "books", "category", "center", "city", "click", "clinic", "cloud", "club", "college",
    "com", "community", "contact", "culture", "daily", "data", "design", "digital", "docs", "domain", "edu", "example", "family", "farm", "food", "forum", "free", "garden", "global", "gov",
    "green", "group", "guide", "health", "help", "history", "home", "house", "html", "index", "info", "institute", "journal", "kids", "lab", "law", "learn", "library", "life", "live",
    "local", "magazine", "mail", "map", "market", "media", "mobile", "museum", "music", "my", "net", "network", "news", "office", "online", "open", "org", "page", "park", "photo",
    "photos", "post", "posts", "press", "radio", "research", "school", "science", "shop", "site", "sport", "static", "store", "studio", "tech", "the", "times", "today", "travel", "tv",
    "university", "video", "web", "wiki", "win", "world", "www",
)
#: Longer words are not in the model of names.
WORD_LETTERS = 24
#: Weights of documents, compounds and lists in the unigram model.
MIX = (0.5, 0.25, 0.25)
#: A name that is no known word costs WHOLE + n * WHOLE_LETTER for n letters if it is left
#: whole, and an unknown piece beside words PIECE + n * PIECE_LETTER (natural logarithms):
#: a word found within a name is trusted only if the rest is known too, or long.
WHOLE, WHOLE_LETTER = 6.0, 2.5
PIECE, PIECE_LETTER = 12.0, 3.3
#: Words' worth of smoothing, and the share of it that goes to the lists.
SMOOTHING = 10.0
LISTED_SHARE = 0.5
PLAIN_SHARE = 0.1


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def ruled(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of the different (host, path) that a rule fits.

    A rule (verdict, host, path) fits its host and the hosts that end with a dot and it,
    where the path begins with its path.  The longest (host and path together) decides;
    of several as long the longer host, and then block.
    """
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    shape = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    lengths = [int(n) for n in shape["lengths"]]  # different lengths of paths, no more than the longest has letters
    labels = F.split("host", r"\.")
    known = F.least(F.size(labels), F.lit(int(shape["labels"] or 0)))
    suffixes = F.transform(F.sequence(F.lit(1), known), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    by_host = keys.select("host").distinct().select("host", F.explode(F.when(known > 0, suffixes)).alias("rule_host")).join(rules.select("rule_host").distinct(), "rule_host", "left_semi")
    starts = keys.select("host", "path", F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")).alias("n")).where(F.length("path") >= F.col("n"))
    starts = spread_join(stored(starts, "starts"), by_host, ["host"], "inner").withColumn("rule_path", F.col("path").substr(F.lit(1), F.col("n")))
    found = starts.join(rules, ["rule_host", "rule_path"])
    size = F.length("rule_host") + F.length("rule_path")
    best = found.groupBy("host", "path").agg(F.max(F.struct(size.alias("size"), F.length("rule_host").alias("of_host"), "verdict", F.concat("rule_host", "rule_path").alias("rule"))).alias("b"))
    return best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("rule_verdict"))


def _names(text: Column) -> Column:
    """The runs of letters, in lower case; %XX parts names."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "%[0-9A-Fa-f]{2}", " ")), F.lit(r"\p{L}+"), F.lit(0))


def _compounds(text: Column) -> Column:
    """The names of those labels and segments that have two or more."""
    segments = F.split(F.lower(F.regexp_replace(text, "%[0-9A-Fa-f]{2}", "-")), r"[./:@]")
    several = F.transform(segments, lambda s: F.regexp_extract_all(s, F.lit(r"\p{L}+"), F.lit(0)))
    return F.flatten(F.filter(several, lambda names: F.size(names) > 1))


def unigrams(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(word, cost): minus the logarithm of each word's share in the mixture."""
    texts = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    parts = keys.select("host", F.explode(F.array_union(_compounds(F.col("host")), _compounds(F.col("path")))).alias("word")).distinct()
    lists = keys.sparkSession.createDataFrame([(w,) for w in sorted({*LISTED, *PLAIN})], "word string")
    known = None
    for i, words in enumerate((texts, parts.select("word"), lists)):
        counts = words.where(F.length("word").between(1, WORD_LETTERS)).groupBy("word").agg(F.count("*").alias("n")).withColumn("of", F.lit(i))
        known = counts if known is None else known.unionByName(counts)
    known = stored(known, "unigrams")
    total = {r["of"]: r["n"] for r in known.groupBy("of").agg(F.sum("n").alias("n")).collect()}
    weight = F.lit(0.0)
    for i, share in enumerate(MIX):
        if total.get(i):
            weight = F.when(F.col("of") == i, F.lit(share / total[i])).otherwise(weight)
    return known.groupBy("word").agg((-F.log(F.sum(F.col("n") * weight))).alias("cost"))


def cut(name: str, costs: dict[str, float]) -> list[str]:
    """The cheapest words and unknown pieces that make up the name; of cuts as cheap, the
    one whose last word is longer.  Runs in the name's length times WORD_LETTERS."""
    n = len(name)
    best, origin = [0.0] + [math.inf] * n, [0] * (n + 1)
    opened, start = [math.inf] * (n + 1), [0] * (n + 1)  # cheapest cuts that end in an unknown piece
    for end in range(1, n + 1):
        fresh, longer = best[end - 1] + PIECE + PIECE_LETTER, opened[end - 1] + PIECE_LETTER
        opened[end], start[end] = (longer, start[end - 1]) if longer <= fresh else (fresh, end - 1)
        best[end], origin[end] = opened[end], start[end]
        for begin in range(max(0, end - WORD_LETTERS), end):
            cost = costs.get(name[begin:end])
            if cost is not None and best[begin] + cost < best[end]:
                best[end], origin[end] = best[begin] + cost, begin
    if best[n] >= WHOLE + WHOLE_LETTER * n:
        return [name] if name else []
    out = []
    while n:
        out.append(name[origin[n] : n])
        n = origin[n]
    return out[::-1]


def segmented(names: DataFrame, model: DataFrame) -> DataFrame:
    """(name, words): different ``names`` cut by the model (word, cost)."""
    begins = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("i"))
    most = F.least(F.lit(WORD_LETTERS), F.length("name") - F.col("i") + 1)
    pieces = begins.select("name", F.explode(F.transform(F.sequence(F.lit(1), most), lambda n: F.col("name").substr(F.col("i"), n))).alias("word")).distinct()
    pieces = stored(pieces, "pieces")
    known = spread_join(pieces, model.join(pieces.select("word").distinct(), "word", "left_semi"), ["word"], "inner")
    gathered = names.join(known.groupBy("name").agg(F.collect_list(F.struct("word", "cost")).alias("known")), "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [cut(name, {k["word"]: k["cost"] for k in known or ()}) for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return gathered.mapInArrow(run, "name string, words array<string>")


def log_odds(uses: DataFrame, listed: tuple[str, ...] = LISTED) -> tuple[DataFrame, float]:
    """(word, odds) and the prior, from the different (host, word, in_host) uses.

    ``odds`` is the logarithm of a word's share in hosts to block over that in others.
    """
    spark = uses.sparkSession
    uses = uses.groupBy("host", "word").agg(F.max("in_host").alias("in_host"))
    bad = F.col("in_host") & F.col("word").isin(*listed)
    marked = stored(spread_join(stored(uses, "uses"), uses.where(bad).select("host").distinct().withColumn("blocked", F.lit(1)), ["host"]).select("host", "word", F.coalesce("blocked", F.lit(0)).alias("blocked")), "marked")
    hosts = marked.groupBy("host").agg(F.max("blocked").alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    counts = marked.where((F.col("blocked") == 1) | ~F.col("word").isin(*listed)).groupBy("word").agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    words = spark.createDataFrame([(w, int(w in listed)) for w in sorted({*listed, *PLAIN})], "word string, listed int")
    counts = stored(counts.join(words, "word", "full").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("b", F.lit(0)).alias("b"), "listed"), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    n, b = int(total["n"] or 0), int(total["b"] or 0)
    known = len({*listed, *PLAIN})
    share = (1 - PLAIN_SHARE) * F.col("n") / F.lit(float(max(n, 1))) + F.when(F.col("listed").isNotNull(), PLAIN_SHARE / known).otherwise(0.0)
    drawn = (1 - LISTED_SHARE) * share + F.when(F.col("listed") == 1, LISTED_SHARE / len(listed)).otherwise(0.0)
    block = (F.col("b") + SMOOTHING * drawn) / (b + SMOOTHING)
    allow = (F.col("n") - F.col("b") + SMOOTHING * share) / (n - b + SMOOTHING)
    return counts.select("word", F.log(block / allow).alias("odds")), float(np.log((hosts["b"] + 1) / (hosts["n"] - hosts["b"] + 1)))


def judged(pages: DataFrame, docs: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages`` (page_id, url).

    ``verdict`` is the rule's where one fits, else block where the score (log odds with
    the prior) is above 0.  A null url and one without :// have an empty host and path, no
    words, and so the prior's verdict; hosts and paths of any length are judged whole;
    repeated rows have a row each; an empty table gives none; other columns are ignored.
    """
    spark = pages.sparkSession
    urls = stored(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    keys = stored(urls.select("host", "path").distinct(), "keys")
    by_rule = ruled(keys, spark.createDataFrame(list(rules), "verdict string, host string, path string"))
    # Each name of a url, as often as it comes.
    held = keys.select("host", "path", F.explode(F.concat(_names(F.col("host")), _names(F.col("path")))).alias("name"))
    held = stored(held.groupBy("host", "path", "name").agg(F.count("*").alias("times")), "names")
    cuts = stored(segmented(held.select("name").distinct(), unigrams(docs, keys)), "cuts")
    in_host = keys.select("host").distinct().select("host", F.explode(_names(F.col("host"))).alias("name"), F.lit(True).alias("in_host"))
    owned = stored(held.select("host", "name", F.lit(False).alias("in_host")).unionByName(in_host).groupBy("host", "name").agg(F.max("in_host").alias("in_host")), "owned")
    odds, prior = log_odds(spread_join(owned, cuts, ["name"], "inner").select("host", F.explode("words").alias("word"), "in_host"))
    said = stored(cuts.select("name", F.explode("words").alias("word")), "said")
    scored = spread_join(said, odds, ["word"], "inner").groupBy("name").agg(F.sum("odds").alias("odds"))
    scores = spread_join(held, scored, ["name"], "inner").groupBy("host", "path").agg(F.sum(F.col("times") * F.col("odds")).alias("odds"))
    decided = keys.join(scores, ["host", "path"], "left").join(by_rule, ["host", "path"], "left")
    score = F.coalesce("odds", F.lit(0.0)) + F.lit(prior)
    decided = decided.select("host", "path", "rule", F.coalesce("rule_verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
    return spread_join(urls, decided, ["host", "path"], "inner").select("page_id", "host", "path", "rule", "verdict", "score")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
