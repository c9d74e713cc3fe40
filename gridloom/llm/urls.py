"""URL filters: listed rules first, then a classifier over words segmented out of host names.

Unigram counts of words come from the pages' own visible text, names with dots left out, and from the words between
hyphens in host names. A Viterbi pass splits every run of letters of a host into the likeliest words, if they cover it
and are together likelier than one unknown word of its length; path words are taken as they stand. A multinomial naive
Bayes over the tokens of both gives the verdict where no rule fits, by its sign.

It is taught in two rounds. In the first, pages whose host holds a seed word count as unwanted, but a seed that alone
makes a page so is left out of that page's tokens: what is learned are the words that go with seeds. Its verdicts teach
the second round, in which seeds are words like any other: one that goes with wanted words has no say.

Words, splits and weights are tables that are joined, of any size; a run of letters looks up its own parts. Joined keys
that many rows share, such as `com`, stay where they are and get their partners by broadcast. The driver gets numbers and at most skew.HOT such keys.

Defined cases: a null url or one without :// has an empty host and path, no rule and no token, and is allowed; a null
html has no words; repeated rows count each; a null id is carried through; of rules of one length that fit, the later
listed decides; a run of more than LABEL letters, which no name can have, is one unknown word; where no page is
unwanted, all are allowed; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .skew import dealt
from .store import drop, save

#: Fixed values of the contract: (verdict, host, path), each for its host and all subdomains.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Seed words of unwanted hosts.
SEEDS = frozenset("adult ads bet bets betting casino cheat clickbait crack escort gambling jackpot keygen loans malware nude phishing pills poker porn sex slots spam torrent viagra warez xxx".split())

#: Letters in a part of a name by the rules of DNS; how much a word apart in a host name counts against one in a text.
LABEL, APART = 63, 20
NUMBER, OTHER = "0", "?"

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)\A.*?://", ""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    return F.translate(host, LETTERS, LETTERS.lower()), F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def vocabulary(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(word, n): counts of all words in the pages' text and, between hyphens, in distinct host names; each seed at least once.

    A name without a hyphen is what is to be split and teaches no word, nor does a name in a text.
    """
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")
    prose = F.lit(r"(?<![a-z])(?<![a-z0-9]\.)[a-z]++(?!\.[a-z0-9])")
    in_text = pages.select(F.explode(F.regexp_extract_all(F.lower(plain), prose, F.lit(0))).alias("word"), F.lit(1).alias("n"))
    in_host = hosts.select(F.explode(F.regexp_extract_all("host", F.lit("(?<=-)[a-z]++|[a-z]++(?=-)"), F.lit(0))).alias("word"), F.lit(APART).alias("n"))
    seeds = hosts.sparkSession.createDataFrame([(w, 1) for w in sorted(SEEDS)], "word string, n int")
    return in_text.unionByName(in_host).unionByName(seeds).where(F.length("word") <= LABEL).groupBy("word").agg(F.sum("n").alias("n"))


def split(run: str, known: dict[tuple[int, int], int], total: int) -> tuple[str, ...]:
    """The likeliest words of a run of letters. known: counts of its parts (from, to) that are words."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    into: dict[int, list[tuple[int, int]]] = {}
    for (a, b), n in known.items():
        into.setdefault(b, []).append((a, n))
    for end in range(1, len(run) + 1):
        best.append(min(((best[a][0] + math.log(total / n), a) for a, n in into.get(end, ())), default=(math.inf, 0)))
    # An unknown word: a tenth as likely with each letter.
    if best[-1][0] >= math.log(total) + (len(run) - 1) * math.log(10):
        return (OTHER,)
    out, end = [], len(run)
    while end:
        out.append(run[best[end][1] : end])
        end = best[end][1]
    return tuple(out[::-1])


def segmented(hosts: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(run, words): the split of every distinct run of letters that has one."""
    runs = hosts.select(F.explode(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))).alias("run")).distinct().where(F.length("run") <= LABEL)
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("a"))
    places = starts.select("run", "a", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("a") + 1)).alias("size"))
    parts_ = save(places.withColumn("word", F.substring("run", F.col("a"), F.col("size"))), "url-places")
    hits = dealt(parts_, words.join(parts_.select("word").distinct(), "word", "left_semi"), ["word"], "inner")
    known = hits.groupBy("run").agg(F.collect_list(F.struct((F.col("a") - 1).alias("a"), (F.col("a") - 1 + F.col("size")).alias("b"), "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("run").to_pylist()
            out = [split(r, {(k["a"], k["b"]): k["n"] for k in known}, total) for r, known in zip(names, batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    return known.mapInArrow(run, "run string, words array<string>")


def tokenized(located: DataFrame, splits: DataFrame) -> DataFrame:
    """located with tokens, an array: the host's words and numbers in order, and the path's, each after a slash."""
    each = located.select("host").distinct().select("host", F.posexplode(F.regexp_extract_all("host", F.lit("[a-z]+|[0-9]+"), F.lit(0))).alias("at", "run"))
    part = F.coalesce("words", F.array(F.when(F.col("run").rlike("^[0-9]"), NUMBER).otherwise(OTHER)))
    named = dealt(each, splits, ["run"]).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", part.alias("words")))).alias("parts"))
    named = named.select("host", F.flatten("parts.words").alias("words"))
    in_path = F.transform(F.regexp_extract_all(F.lower("path"), F.lit("[a-z]+|[0-9]+"), F.lit(0)), lambda w: F.concat(F.lit("/"), F.when(w.rlike("^[0-9]"), NUMBER).otherwise(w)))
    return dealt(located, named, ["host"]).withColumn("tokens", F.concat(F.coalesce("words", F.array().cast("array<string>")), in_path)).drop("words")


def bayes(rows: DataFrame) -> tuple[DataFrame, float] | None:
    """(token, w), log odds of each token to stand in an unwanted url against a wanted one, and those of the classes; from rows (bad, tokens)."""
    classes = rows.agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")).first()
    if not classes.b:
        return None
    each = save(rows.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")), "url-counts")
    sums = each.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.count("*").alias("n")).first()
    odds = F.log((F.col("b") + 1) / F.lit(float(sums.b + sums.n))) - F.log((F.col("g") + 1) / F.lit(float(sums.g + sums.n)))
    return each.select("token", odds.alias("w")), math.log(classes.b) - math.log(classes.g + 1)


def scored(rows: DataFrame, model: tuple[DataFrame, float] | None) -> DataFrame:
    """rows with score, the log odds to be unwanted; -1 without a model. An unknown token says nothing."""
    if model is None:
        return rows.withColumn("score", F.lit(-1.0))
    weights, prior = model
    sums = dealt(rows.select("row", F.explode("tokens").alias("token")), weights, ["token"]).groupBy("row").agg(F.sum("w").alias("w"))
    # Rounded, as the order of a sum may differ.
    return rows.join(sums, "row", "left").withColumn("score", F.round(F.coalesce("w", F.lit(0.0)) + F.lit(prior), 9)).drop("w")


def lessons(rows: DataFrame) -> DataFrame:
    """(bad, tokens) of the first round, from rows with tokens."""
    seeds = F.array(*map(F.lit, sorted(SEEDS)))
    held = F.array_intersect("tokens", seeds)
    return rows.select((F.size(held) > 0).alias("bad"), F.when(F.size(held) == 1, F.filter("tokens", lambda t: ~t.isin(sorted(SEEDS)))).otherwise(F.col("tokens")).alias("tokens"))


def judged(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row."""
    host, path = parts(F.col("url"))
    located = save(pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id()), "url-parts")
    hosts = located.select("host").distinct()
    words = save(vocabulary(pages, hosts), "url-words")
    total = words.agg(F.sum("n")).first()[0]
    splits = save(segmented(hosts, words, total), "url-splits")
    rows = save(tokenized(located, splits), "url-tokens")
    first = save(scored(rows, bayes(lessons(rows))).select((F.col("score") > 0).alias("bad"), "tokens"), "url-first")
    second = scored(rows, bayes(first))
    for done in (located, words, splits, first):
        drop(done)
    all_ = second.withColumn("r", ruled(F.col("host"), F.col("path")))
    return all_.select("page_id", "host", "path", "r.rule", F.coalesce("r.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
