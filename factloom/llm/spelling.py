"""Operator 12: spelling variants, found through pivotal grams.

1. Words and their counts come from all texts (JVM only, aggregated before the shuffle).
2. Bigrams are ordered by how many places of words hold them, rarest first.  Counts are
   kept for 65,536 buckets of bigrams, so the order has a fixed size for any alphabet;
   any one order gives right results.
3. A word's prefix is its three rarest bigrams, of equals those that come first.  Its
   pivots are two of the three that share no letter, chosen by dynamic programming so that
   their counts add up to the least.  To be found, it shows its prefix and up to two more
   bigrams as rare as the third, as one edit makes two bigrams at most: a pivot that was
   among the first three of the other word may come that much later in this one.
4. One edit spoils at most one of two disjoint pivots.  So of two near words, the one
   whose prefix ends at the rarer bigram has a pivot that lies in the prefix of the other,
   at the same place from the start (the edit comes later) or from the end (it came
   earlier).  What lies beyond the bigram on that side is then equal, and of what lies on
   the other side one half is: pivots and prefixes meet in an equi-join of hashes of these
   parts and both lengths.
5. Candidates are verified by their edit distance; hashes only have to find them.

Forms lead to words of five times the count or more, so chains are at most a few dozen
long and are followed by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import mixed, slices, span_hashes, spread_join, stored, table
from factloom.operators.graph import shuffled

#: A word has so many code points and occurrences at least.
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form occurs so many times as often as the word, at least.
RATIO = 5
#: Of so many runs one loses a code point.
SPOILED = 199
#: Buckets of bigrams that are ordered by their counts.
BUCKETS = 1 << 16
#: Bigrams of a prefix (one edit spoils two, so one more).
PREFIX = 3
#: Bigrams that one edit makes, at most.
MADE = 2
BASE = 0x9E3779B97F4A7C15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs of Latin letters of every whole text, A-Z in lower case.

    A run whose crc32 with its doc_id is divisible by ``SPOILED`` loses one code point
    first.  Null and empty texts have no words; without a doc_id no run is spoiled.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("d"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("w"))
    lowered = runs.select("d", F.translate("w", UPPER, LOWER).alias("w"))
    hashed = lowered.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    words = hashed.select(F.when(F.col("h") % SPOILED == 0, cut).otherwise(F.col("w")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, offsets)."""
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), offsets


def _grams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, bucket) of every bigram that lies within a word."""
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.flatnonzero(word[:-1] == word[1:])
    bucket = mixed(points[first].astype(np.uint64) << np.uint64(32) | points[first + 1].astype(np.uint64)) % np.uint64(BUCKETS)
    return word[first], first - offsets[word[first]], bucket.astype(np.int64)


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many places of words hold a bigram of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_grams(*_code_points(batch.column(0).to_pylist()))[2], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for row in words.select("word").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        counts[row["bucket"]] = row["n"]
    return counts


def pivots(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row the columns of two places, at least 2 apart, of least summed weight.

    ``places`` increase along a row.  ``one[j]`` is the lightest of the first j + 1 places;
    a pair that ends at j continues the lightest place that lies 2 or more before, and
    ``two`` is the lightest pair so far.
    """
    n, k = places.shape
    rows, one = np.arange(n), np.zeros((n, k), np.int64)
    two, cost = np.zeros((n, 2), np.int64), np.full(n, np.int64(1) << 62)
    for j in range(k):
        if j:
            one[:, j] = np.where(weights[rows, one[:, j - 1]] <= weights[:, j], one[:, j - 1], j)
        for last in range(j):
            # the last place that does not touch the one at j
            fits = (places[:, j] - places[:, last] >= 2) & ((last + 1 == j) | (places[:, j] - places[:, min(last + 1, j - 1)] < 2))
            pair = weights[:, j] + weights[rows, one[:, last]]
            better = fits & (pair < cost)
            cost = np.where(better, pair, cost)
            two[better, 0], two[better, 1] = one[better, last], j
    return two


def signatures(words: list[str], counts: np.ndarray) -> dict[str, np.ndarray]:
    """The rows (word, last, key, pivot) of words of 4 code points or more: ``key`` is what
    has to be equal in a near word, ``last`` the place of the prefix's end in the order of
    bigrams, and ``pivot`` tells rows of pivots from those of prefixes."""
    points, offsets = _code_points(words)
    lengths = np.diff(offsets)
    order_of = np.empty(BUCKETS, np.int64)
    order_of[np.lexsort((np.arange(BUCKETS), counts))] = np.arange(BUCKETS)
    word, place, bucket = _grams(points, offsets)
    rank = order_of[bucket]
    by = np.lexsort((place, rank, word))
    word, place, rank, bucket = word[by], place[by], rank[by], bucket[by]
    begin = np.searchsorted(word, np.arange(len(words)))
    three = begin[:, None] + np.arange(PREFIX)
    last = rank[three[:, -1]]
    below = np.bincount(word, rank < last[word], len(words)).astype(np.int64)
    prefix = np.flatnonzero((rank <= last[word]) & (np.arange(len(word)) - begin[word] < below[word] + PREFIX + MADE))
    # The three rarest by place, and the pair of them.
    three = np.take_along_axis(three, np.argsort(place[three], axis=1), axis=1)
    chosen = np.take_along_axis(three, pivots(place[three], counts[bucket[three]]), axis=1).ravel()

    values = mixed(points.astype(np.uint64))

    def part(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hashes(values, start, end, BASE)

    out = {"word": [], "last": [], "key": [], "pivot": []}
    for rows, pivot in ((prefix, False), (chosen, True)):
        w, p = word[rows], place[rows]
        length, origin, finish = lengths[w], offsets[w], offsets[w + 1]
        for other in (-1, 0, 1):
            shorter = length + min(other, 0)
            both = (length if pivot else length + other) * 4 + (other if pivot else -other) + 1  # length of the pivot's word, and by how much the other is longer
            for kind, held in enumerate((p + 2, length - p)):  # code points up to the bigram's end, or from its start
                rest = shorter - held
                half = np.maximum(rest, 0) // 2
                near = part(origin, origin + held + half) if kind == 0 else part(finish - held - half, finish)
                kept = rest - half
                fit = rest > 0
                far = np.maximum(np.where(fit, kept, 0), 0)
                split = part(origin, origin + held) ^ mixed(part(finish - far, finish)) if kind == 0 else part(finish - held, finish) ^ mixed(part(origin, origin + far))
                for which, key, use in ((0, near, rest >= 0), (1, split, fit)):
                    tagged = mixed(key + (both * 4 + kind * 2 + which).astype(np.uint64) * np.uint64(BASE))
                    out["word"].append(w[use])
                    out["last"].append(last[w[use]])
                    out["key"].append(tagged[use].view(np.int64))
                    out["pivot"].append(np.full(int(use.sum()), pivot))
    return {k: np.concatenate(v) for k, v in out.items()}


#: Words that are worked on at once.
BATCH_WORDS = 4_096


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of ``words`` (word, n; distinct words of 4 code
    points or more) that differ by one code point, both ways round."""
    counts = gram_counts(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH_WORDS):
                batch = whole.slice(low, BATCH_WORDS)
                words = batch.column(0).to_pylist()
                found = signatures(words, counts)
                rows = pa.table({"at": found["word"], "last": found["last"].astype(np.int32), "key": found["key"], "pivot": found["pivot"]})
                lengths = np.array([len(w) for w in words])[found["word"]]
                for begin, end in slices(lengths):
                    part = rows.slice(begin, end - begin).to_batches()[0]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(part.column(0)), batch.column(1).take(part.column(0)), *part.columns[1:]], names=["word", "n", "last", "key", "pivot"])

    rows = words.select("word", "n").mapInArrow(run, "word string, n long, last int, key long, pivot boolean")
    index = rows.where("not pivot").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("last").alias("near_last"))
    # A word has dozens of rows, which Spark sizes as one.
    found = rows.where("pivot").join(shuffled(index), "key").where("last <= near_last and word != near").where(F.levenshtein("word", "near", 1) == 1)
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.explode(both).alias("p")).select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the links word -> form end.  Links have no cycles."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(spread_join(now, ahead, ["root"]).select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of the different words of (word, n).

    ``form`` is the near word of largest n (the smallest in code-point order of several),
    if that n is ``ratio`` times the word's or more; ``root`` is where the forms end, the
    word itself if it has none.  An empty table gives none; words may be of any length
    from 4 code points on, and of any letters.  A null word or n takes no part.
    """
    words = stored(words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    counted = words.join(shuffled(best), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))
    fits = F.col("near_n") >= F.lit(ratio) * F.col("n")
    formed = stored(counted.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(shuffled(ends), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted_words(table(spark, sf_dir, "documents")))


#: The 256 entries follow from the polynomial of crc32; near words share what is left when
#: one code point is marked or taken out.
OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
tally AS (SELECT w, doc_id, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM runs WHERE length(w) >= 6 GROUP BY 1, 2),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, CAST(i AS BIGINT), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM tally, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM places),
near AS (SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word != y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.a || x.z = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.a || x.z = y.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS stop, 0 AS depth FROM forms UNION ALL SELECT walk.word, forms.form, depth + 1 FROM walk JOIN forms ON forms.word = walk.stop WHERE forms.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM forms f JOIN (SELECT word, arg_max(stop, depth) AS root FROM walk GROUP BY 1) r USING (word)
"""
