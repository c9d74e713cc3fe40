"""Quality rules as a learned decision list.

Sequential covering over statistics of labelled documents: a conjunction of thresholds grows by information gain until
it covers no good document, is pruned on rows held back, and joins the list if what is left is precise there; the rows
it covers go, and the next one grows. The list becomes one ordered Spark conditional expression, so that a verdict
names the rule that gave it.

The statistics are counted over whole texts. The list is learned from at most SAMPLE labelled rows, those with the
least hash of their id.

Defined cases: a null text is an empty one; a text without words fails the base; labels other than 0 and 1 and labels
without a document are ignored; rows that share an id teach as one, that with the least statistics; without labels the list is empty and only the base rejects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import fresh, save
from .words import encoded, slices

#: Labelled rows to learn from at most; the bound is all that the driver gets.
SAMPLE = 20_000
#: A rule must be this precise on the rows held back, and cover so many rows at least.
PRECISION, COVER = 0.9, 3
#: Conditions in a rule, rules in a list, thresholds tried for a statistic.
CONDITIONS, RULES, CUTS = 3, 12, 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct", "n_runs")
SYMBOLS = "#*$%&|<>"
MARKS = "!?"


def count(text: str | None) -> tuple[int, ...]:
    """The counts of one text, as COUNTS names them."""
    if not text:
        return (0,) * len(COUNTS)
    words = encoded(text).split()
    lines = [x for x in encoded(text).split(b"\n") if x.strip(b" \t\n\v\f\r")]
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    return (len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats(words), sum(map(str.isupper, text)) if not text.islower() else 0, sum(map(text.count, MARKS)), len(set(words)), sum(a == b for a, b in pairwise(words)))


def repeats(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total = upto = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def counted(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with a struct column out that holds the counts of each text."""
    struct = pa.struct([(c, pa.int64()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            rows = [count(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            parts = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(parts, fields=list(struct))], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>"
    return df.mapInArrow(run, schema)


def features(c: str) -> dict[str, Column]:
    """What the rules test, from the struct of counts c."""
    x = lambda name: F.col(f"`{c}`.{name}")
    per = lambda a, b: F.when(x(b) > 0, x(a) / x(b)).otherwise(0.0)
    return {
        "words": x("n_words").cast("double"), "word_length": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "repeated_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"), "marks_per_word": per("n_marks", "n_words"), "distinct_share": per("n_distinct", "n_words"), "same_word_share": per("n_runs", "n_words"),
    }


def base_failed(c: str) -> Column:
    x = lambda name: F.col(f"`{c}`.{name}")
    return (x("n_words") < 50) | (100 * x("n_repeat_words") > 50 * x("n_words"))


Rule = list[tuple[str, str, float]]


def learn(names: list[str], values: np.ndarray, bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """Rules for rejection, in order. values: a row for each document, a column for each name; bad: to be rejected."""
    order = np.random.default_rng(seed).permutation(len(bad))
    values, bad = values[order], bad[order].astype(bool)
    held = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < RULES and (left & bad & ~held).any():
        rule = _prune(_grow(names, values, bad, left & ~held), names, values, bad, left & held)
        if not rule:
            break
        covers = left & _covers(rule, names, values)
        good, wrong = (covers & bad).sum(), (covers & ~bad).sum()
        test = covers & held
        if good < COVER or good / (good + wrong) < PRECISION or test.any() and bad[test].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~covers
    return rules


def _covers(rule: Rule, names: list[str], values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for name, sign, cut in rule:
        x = values[:, names.index(name)]
        out &= x >= cut if sign == ">=" else x < cut
    return out


def _grow(names: list[str], values: np.ndarray, bad: np.ndarray, rows: np.ndarray) -> Rule:
    rule: Rule = []
    while len(rule) < CONDITIONS and (rows & ~bad).any():
        p, n = (rows & bad).sum(), (rows & ~bad).sum()
        best, chosen = 0.0, None
        for k, name in enumerate(names):
            x = values[rows, k]
            y = bad[rows]
            ranked = np.sort(x)
            cuts = np.unique(ranked[np.linspace(0, len(x) - 1, CUTS).astype(int)])
            lower = np.concatenate([[-np.inf], cuts[:-1]])
            for cut in np.where(np.isfinite(lower), (cuts + lower) / 2, cuts):
                above = x >= cut
                for sign, on in ((">=", above), ("<", ~above)):
                    p1, n1 = (on & y).sum(), (on & ~y).sum()
                    if p1 and (gain := p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))) > best:
                        best, chosen = gain, (name, sign, float(cut))
        if chosen is None:
            break
        rule.append(chosen)
        rows = rows & _covers([chosen], names, values)
    return rule


def _prune(rule: Rule, names: list[str], values: np.ndarray, bad: np.ndarray, rows: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        on = rows & _covers(r, names, values)
        p, n = (on & bad).sum(), (on & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def verdict(rules: list[Rule], c: str) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    x, out = features(c), F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for name, sign, cut in rule:
            holds = holds & (x[name] >= F.lit(cut) if sign == ">=" else x[name] < F.lit(cut))
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def sampled(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): at most SAMPLE labelled rows, those with the least hash of their id."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)


def fitted(docs: DataFrame, labels: DataFrame, c: str) -> list[Rule]:
    """docs: doc_id and the struct of counts c."""
    x = features(c)
    known = docs.join(sampled(labels), "doc_id").where(~base_failed(c)).select("doc_id", "quality", F.struct(*(v.alias(k) for k, v in x.items())).alias("x"))
    rows = known.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("doc_id", "quality", "x.*").collect()  # an id that repeats is one row
    rows.sort(key=lambda r: (r.doc_id, r.quality, tuple(r)))
    if not rows:
        return []
    return learn([*x], np.array([tuple(r)[2:] for r in rows], float), np.array([r.quality == 0 for r in rows]))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, rule, kept) for every document."""
    table = save(counted(docs.select("doc_id", "text"), "text", "c").drop("text"), "rules-counts")
    rules = fitted(table, labels, "c")
    failed, rule = base_failed("c"), verdict(rules, "c")
    return table.select("doc_id", "c.n_words", "c.word_chars", "c.n_symbols", "c.n_dup_lines", "c.n_repeat_words", failed.alias("base_failed"), (~failed & rule.isNull()).alias("kept"), rule.alias("rule"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base nor a rule rejects, with their own columns."""
    c = fresh(docs.columns, "_counts")
    ids = fresh(["doc_id", "quality"], "c")
    chosen = docs.join(F.broadcast(sampled(labels).select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text")  # at most SAMPLE ids
    rules = fitted(counted(chosen, "text", ids).drop("text"), labels, ids)
    return counted(docs, "text", c).where(~base_failed(c) & verdict(rules, c).isNull()).drop(c)


def query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
