"""Personal data by weak supervision, in DataFrame functions alone.

Base spans (e-mail, ip, card, phone) follow fixed patterns. Every other run of printable ASCII characters with a digit
is a candidate, and so is one without a digit that a cue such as `password` gives a value to. Labelers vote on each:
formats by regex, lists of known token prefixes and of words in front of it, its context, its length and its mixture
of characters. Expectation-maximisation (Dawid and Skene's, for two classes) estimates what each labeler's vote is
worth from how votes go together; the posteriors train a logistic span classifier over features of the candidate,
which decides which candidates are added as spans of the kind `secret`. Both models are fitted on counts of whole
vote and feature patterns over all candidates, of which there are at most a few thousand kinds, so the driver's share
doesn't grow with the corpus.

The candidates of a text are searched once; what is found is saved, fitted on and decided upon. No pattern repeats a
group, so no text is long enough to exhaust a stack; matches within a run of characters begin at its start or where
the last one ended, so the time is linear in the text.

Defined cases: a null text is an empty one and has no spans; a null id is carried through; repeated rows are judged
each; an empty table, or one without candidates, has no model and adds nothing; where no candidate is taken to be
private, as in a table of one harmless number, nothing is added; texts of any length are masked by blocks.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .store import fresh, save

#: Fixed values of the contract: kinds in order. `secret` is what the classifier adds.
KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"

#: Word lists of the gazetteer labeler: in front of personal data or secrets, and in front of harmless numbers.
PRIVATE = "token secret password passwd pwd api key bearer auth credential ssn iban passport account tel phone mobile call fax mail card visa"
HARMLESS = "page chapter section version volume vol figure table year line item number"

#: Prefixes by which issuers mark their tokens, and the cues whose value is a candidate without a digit too.
PREFIXES = "AKIA ASIA AIza eyJ ghp_ gho_ ghs_ glpat- sk_ sk- pk_ xoxb- xoxp-"
CUES = "password passwd pwd passphrase secret token api_key apikey api-key"

#: From which probability a candidate is a span.
SURE = 0.9
LEFT = 24
#: Characters in a block and blocks in a stretch of a text to be masked; matches in a run of sums.
BLOCK, BLOCKS = 1024, 64
RUN = 128
#: Votes that a labeler starts with, for the right class and for the wrong one.
RIGHT, WRONG = 20.0, 2.0


def _prepared(text: Column, inside: str, separators: str) -> Column:
    """The text with \\x01 for each separator between two characters of a class; as long as the text."""
    return F.regexp_replace(F.translate(text, "\x01", "\x02"), f"(?<=[{inside}])[{separators}](?=[{inside}])", "\x01")


LOCAL, HOST = r"A-Za-z0-9._%+\x01-", "A-Za-z0-9-"
_CUE = "(?i:" + "|".join(CUES.split()) + ")"
#: A value without a digit: after `cue = ` or `cue: "`, or in one run with it.
_APART = rf"(?<=[=:]\s)(?:(?<=(?i:[a-z])[\"']?\s?=\s)|(?=[\"']))(?<={_CUE}[\"']?\s?[=:]\s)(?=[!-~]{{8}})"
_JOINED = rf"(?=[A-Za-z_\"'-]++=[!-~]{{8}})(?=[A-Za-z_\"'-]{{0,32}}?{_CUE}[\"']?=)"
#: By kind: what the text must hold, its preparation, its pattern there. \G: a match may begin where the last ended.
PATTERNS: dict[str, tuple] = {
    "email": (lambda t: F.contains(t, F.lit("@")), lambda t: _prepared(t, HOST, "."), rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@(?=[{HOST}]++\x01)[{HOST}\x01]++".replace(HOST + r"\x01", r"A-Za-z0-9\x01-")),
    "ip": (lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), lambda t: t, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (lambda t: F.rlike(t, F.lit("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")), lambda t: _prepared(t, "0-9", " -"), r"[0-9][0-9\x01]++"),
    "phone": (lambda t: F.rlike(t, F.lit(r"\+[0-9]")), lambda t: t, r"\+[0-9][ ().0-9-]+[0-9]"),
    ADDED: (lambda t: F.rlike(t, F.lit(rf"[0-9]|{_CUE}[\"']?\s?[=:]")), lambda t: t, rf"(?<![!-~])(?:(?=[!-/:-~]*+[0-9])|{_APART}|{_JOINED})[!-~]++"),
}


def _digits(m: Column) -> Column:
    return F.translate(m, " ().+-\x01", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    n = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    one = lambda i: F.when(i % 2 == 1, n(i)).otherwise(F.when(n(i) > 4, 2 * n(i) - 9).otherwise(2 * n(i)))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + one(i)) % 10 == 0


def _octet(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _octet),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    ADDED: lambda m: F.lit(True),
}


def _bound(x: Column, f) -> Column:
    """f(x), where x is worked out once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _apart(own: Column, others: Column, start: Column, width: int | None, end: Column) -> Column:
    """Those of the spans own, which start from start to end, that overlap none of the others; by stretches, blocks and pairs."""
    if width == 1:
        return F.filter(own, lambda c: ~F.exists(others, lambda y: (y["s"] < c["e"]) & (y["e"] > c["s"])))
    step = BLOCK * BLOCKS if width is None else BLOCK

    def part(lo: Column) -> Column:
        mine = F.filter(own, lambda c: (c["s"] >= lo) & (c["s"] < lo + step))
        near = lambda some: _bound(F.array_max(F.transform(some, lambda c: c["e"])), lambda top: F.filter(others, lambda y: (y["e"] > lo) & (y["s"] < top)))
        return _bound(mine, lambda some: _bound(near(some), lambda ys: _apart(some, ys, lo, step if width is None else 1, lo + step)))

    return F.flatten(F.transform(F.sequence(start, F.greatest(start, end - 1), F.lit(step)), part))


def _placed(gaps: Column, found: Column) -> Column:
    """[(s, e, m, left)] of the matches found, given what is between them: running sums by runs of RUN matches."""
    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g["n"].alias("g"), F.length(m).alias("n"), m.alias("m"), g["left"].alias("left")))
    item = "struct<s: int, e: int, m: string, left: string>"

    def add(acc: Column, x: Column) -> Column:
        s, e = acc["at"] + x["g"], acc["at"] + x["g"] + x["n"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["left"].alias("left")))).alias("out"))

    run = lambda all_: lambda b: F.aggregate(F.slice(all_, b, RUN), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("out")), add)
    runs = _bound(both, lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(RUN)), run(all_)))

    def shift(acc: Column, r: Column) -> Column:
        moved = F.transform(r["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["m"].alias("m"), x["left"].alias("left")))
        return F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    joined = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{item}>>").alias("out")), shift)
    return F.when(F.size(found) > 0, F.flatten(joined["out"]))


def with_spans(docs: DataFrame, text_col: str, cols: dict[str, str]) -> DataFrame:
    """docs with a column cols[kind] for each kind: an array of (s, e, m, left), in order; the candidates under `secret`.

    Each step's columns are used more than once by the next, so that the optimizer keeps the steps apart and no
    pattern runs twice on a text. Fields of one struct would be inlined.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    temps = {(k, x): fresh(docs.columns, f"_{k}_{x}") for k in PATTERNS for x in ("text", "gaps", "found")}
    steps = docs.withColumns({temps[k, "text"]: F.when(gate(text), prepare(text)) for k, (gate, prepare, _) in PATTERNS.items()})
    steps = steps.withColumns({temps[k, "found"]: F.regexp_extract_all(temps[k, "text"], F.lit(p), F.lit(0)) for k, (_, _, p) in PATTERNS.items()})
    some = lambda k: F.size(temps[k, "found"]) > 0
    # Of the texts between matches only lengths and ends stay.
    gap = lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(LEFT)).alias("left"))
    steps = steps.withColumns({temps[k, "gaps"]: F.when(some(k), F.transform(F.split(temps[k, "text"], p, -1), gap)) for k, (_, _, p) in PATTERNS.items()}).drop(*(temps[k, "text"] for k in PATTERNS))
    empty = F.array().cast("array<struct<s: int, e: int, m: string, left: string>>")
    valid = lambda k: lambda x: VALID[k](x["m"])
    spans = {cols[k]: F.coalesce(F.when(some(k), F.filter(_placed(F.col(temps[k, "gaps"]), F.col(temps[k, "found"])), valid(k))), empty) for k in PATTERNS}
    return steps.withColumns(spans).drop(*temps.values())


def span_columns(docs: DataFrame) -> dict[str, str]:
    return {k: fresh(docs.columns, f"_{k}_spans") for k in PATTERNS}


# Labelers and features of one candidate.


def _core(x: Column) -> Column:
    """The candidate without the punctuation around it: (s, e, m)."""
    lead = F.length(F.regexp_extract(x["m"], r"^[^A-Za-z0-9+]*", 0))
    core = F.regexp_extract(x["m"], r"[A-Za-z0-9+](?:.*[A-Za-z0-9])?", 0)
    # What stands before the value in the same run, as in key=value, belongs to its context.
    key = F.length(F.regexp_extract(core, r"^[A-Za-z_]+[=:][\"']?(?=[^=:]{6})", 0))
    return F.struct((x["s"] + lead + key).alias("s"), (x["s"] + lead + F.length(core)).alias("e"), F.substring(core, key + 1, F.length(core)).alias("m"), F.lower(F.right(F.concat(x["left"], F.substring(x["m"], F.lit(1), lead + key)), F.lit(2 * LEFT))).alias("left"))


def _bucket(x: Column, cuts: tuple) -> Column:
    return reduce(lambda acc, c: acc + (x >= c).cast("int"), cuts, F.lit(0))


def _any(words: str) -> str:
    return "(?<![a-zà-ÿ])(?:" + "|".join(words.split()) + ")s?(?![a-zà-ÿ])"


def _votes(c: Column) -> Column:
    """A letter for each labeler: P private, N not, - no vote."""
    vote = lambda yes, no: F.when(yes, "P").when(no, "N").otherwise("-")
    n, digits = F.length(c["m"]), F.length(F.regexp_replace(c["m"], "[^0-9]", ""))
    mixed = c["m"].rlike("[A-Za-z]") & c["m"].rlike("[0-9]")
    return F.concat(
        vote(c["m"].rlike("^[0-9a-f]{24,}$|^[0-9A-F]{24,}$|^[A-Za-z]{2,4}[_-]?[A-Za-z0-9_-]{16,}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), c["m"].rlike("^[0-9]{1,5}$")),
        vote(c["m"].rlike("^(?:" + "|".join(PREFIXES.split()) + ")"), F.lit(False)),
        vote(c["left"].rlike(_any(PRIVATE)), c["left"].rlike(_any(HARMLESS))),
        vote(c["left"].rlike(r"[=:][\s\"'(]*$"), c["left"].rlike(r"[a-zà-ÿ]\s*$") & (n < 8)),
        vote((n >= 16) & mixed & (digits >= 4), (n <= 6)),
        vote(F.regexp_count(c["m"], F.lit("(?<=[0-9])[A-Za-z]")) >= 3, ~c["m"].rlike("[A-Za-z]")),
    )


def _features(c: Column) -> Column:
    n = F.length(c["m"])
    share = lambda p: F.length(F.regexp_replace(c["m"], p, "")) / F.greatest(n, F.lit(1))
    return F.struct(
        _bucket(n, (6, 10, 16, 24, 32)).alias("size"), _bucket(share("[^0-9]"), (0.2, 0.5, 0.8, 1.0)).alias("digits"), _bucket(share("[^a-z]"), (0.1, 0.3, 0.6)).alias("lower"), _bucket(share("[^A-Z]"), (0.1, 0.3)).alias("upper"),
        c["left"].rlike(r"[=:][\s\"'(]*$").cast("int").alias("assigned"), c["left"].rlike(_any(PRIVATE)).cast("int").alias("named"),
    )


FEATURES = {"size": 6, "digits": 5, "lower": 4, "upper": 3, "assigned": 2, "named": 2}


def judged_candidates(docs: DataFrame, text_col: str, cols: dict[str, str]) -> DataFrame:
    """docs with (s, e) of the base spans and, under `secret`, (s, e, votes, x) of each candidate's core."""
    spans = with_spans(docs, text_col, cols)
    slim = {cols[k]: F.transform(cols[k], lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"))) for k in KINDS}
    cores = spans.withColumns(slim | {cols[ADDED]: F.transform(cols[ADDED], _core)})
    base = F.concat(*(F.col(cols[k]) for k in KINDS))
    fine = F.filter(cols[ADDED], lambda c: c["e"] > c["s"])
    apart = F.when((F.size(base) == 0) | (F.size(cols[ADDED]) == 0), fine).otherwise(_bound(base, lambda ys: _bound(fine, lambda cs: _apart(cs, ys, F.lit(0), None, F.length(text_col)))))
    judged = F.transform(apart, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), _votes(c).alias("votes"), _features(c).alias("x")))
    return cores.withColumn(cols[ADDED], judged)


# The models, on counts of patterns.


def reliabilities(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """The probability of each vote pattern's candidates to be private, by expectation-maximisation from the majority.

    A labeler starts with RIGHT votes for the right class and WRONG ones for the other, however many candidates there
    are, and no estimate may fall below chance: a vote never counts for the class it speaks against.
    """
    belief = {v: (v.count("P") + 0.5) / (v.count("P") + v.count("N") + 1) for v in counts}
    for _ in range(rounds):
        prior, says = estimates(counts, belief)
        # Abstaining says something about coverage, not about the candidate.
        odds = {v: math.log(min(prior, 0.5) / (1 - min(prior, 0.5))) + sum(says[k][s] for k, s in enumerate(v) if s != "-") for v in counts}
        belief = {v: 1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for v, o in odds.items()}
    return belief


def estimates(counts: dict[str, int], belief: dict[str, float]) -> tuple[float, list[dict[str, float]]]:
    """The share of private candidates and, for each labeler, the log odds that its P and its N speak for private."""
    total = sum(counts.values())
    prior = (sum(counts[v] * b for v, b in belief.items()) + 1) / (total + 2)
    out = []
    for k in range(max(map(len, counts), default=0)):
        table = {(s, y): RIGHT if (s, y) in (("P", 1), ("N", 0)) else WRONG for s in "PN" for y in (0, 1)}
        for v, n in counts.items():
            if v[k] != "-":
                table[v[k], 1] += n * belief[v]
                table[v[k], 0] += n * (1 - belief[v])
        share = {(s, y): table[s, y] / (table["P", y] + table["N", y]) for s in "PN" for y in (0, 1)}
        log = {s: math.log(share[s, 1] / share[s, 0]) for s in "PN"}
        out.append({"P": max(log["P"], 0.0), "N": min(log["N"], 0.0)})
    return prior, out


def classifier(rows: list[tuple[tuple[int, ...], float, int]], rounds: int = 4000, rate: float = 1.0, shrink: float = 1e-4) -> dict:
    """Logistic weights {(feature, bucket): w, None: bias} from (buckets, soft label, count).

    Both classes weigh alike, as far as each has a member. The rate is within what seven weights a row allow.
    """
    names = [None, *((f, b) for f, n in FEATURES.items() for b in range(n))]
    x = np.zeros((len(rows), len(names)))
    for i, (buckets, _, _) in enumerate(rows):
        x[i, [0, *(names.index(key) for key in zip(FEATURES, buckets, strict=True))]] = 1.0
    y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    yes, no = n * y / max(1.0, (n * y).sum()) / 2, n * (1 - y) / max(1.0, (n * (1 - y)).sum()) / 2
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += rate * (x.T @ (yes * (1 - p) - no * p) - shrink * w)
    return dict(zip(names, w.tolist(), strict=True))


def fitted(judged: DataFrame, candidates: str) -> dict | None:
    """The classifier, from all candidates of judged_candidates(); none where no candidate is taken to be private."""
    each = judged.select(F.explode(candidates).alias("c")).groupBy("c.votes", "c.x").count().collect()
    if not each:
        return None
    counts: dict[str, int] = {}
    for r in each:
        counts[r.votes] = counts.get(r.votes, 0) + r["count"]
    belief = reliabilities(counts)
    if max(belief.values()) <= 0.5:
        return None
    soft: dict[tuple, list[float]] = {}
    for r in each:
        got = soft.setdefault(tuple(r.x), [0.0, 0])
        got[0] += belief[r.votes] * r["count"]
        got[1] += r["count"]
    return classifier([(x, y / n, n) for x, (y, n) in sorted(soft.items())])


def score(x: Column, weights: dict) -> Column:
    parts = [F.element_at(F.array(*(F.lit(float(weights[f, b])) for b in range(n))), x[f] + 1) for f, n in FEATURES.items()]
    return 1 / (1 + F.exp(-(reduce(lambda a, b: a + b, parts) + F.lit(float(weights[None])))))


def decided(judged: DataFrame, cols: dict[str, str], out: str, weights: dict | None) -> DataFrame:
    """With a column out instead: (kind, s, e) of all spans, by kind and start."""
    base = [F.col(cols[k]) for k in KINDS]
    tag = lambda k, spans: F.transform(spans, lambda y: F.struct(F.lit(k).alias("kind"), y["s"].alias("s"), y["e"].alias("e")))
    parts = [tag(k, b) for k, b in zip(KINDS, base, strict=True)]
    if weights:
        parts.append(tag(ADDED, F.filter(cols[ADDED], lambda c: score(c["x"], weights) >= SURE)))
    return judged.withColumn(out, F.concat(*parts)).drop(*cols.values())


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda y: F.concat_ws(":", y["kind"], y["s"], y["e"])), ",")


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cols = span_columns(rows)
    table = save(judged_candidates(rows, "text", cols).drop("text"), "pii-spans")
    all_ = decided(table, cols, "p", fitted(table, cols[ADDED]))
    count = lambda k: F.size(F.filter("p", lambda y: y["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("p", lambda y: y["kind"] != ADDED)
    return all_.select("doc_id", *map(count, KINDS), F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("p")).alias("spans"), count(ADDED))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with [KIND] in place of each span; a null text stays null.

    The text is rebuilt by stretches and, in them, by blocks of BLOCK characters, which look at the stretch's spans only.
    """
    p, cols = fresh(docs.columns, "_spans"), span_columns(docs)
    table = save(judged_candidates(docs, text_col, cols), "pii-candidates")
    marked = decided(table, cols, p, fitted(table, cols[ADDED]))
    ordered = marked.withColumn(p, F.array_sort(F.transform(p, lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), F.concat(F.lit("["), F.upper(y["kind"]), F.lit("]")).alias("tag")))))
    cut = lambda t, n: F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % n), F.lit(0))
    within = lambda spans, base, n: F.filter(spans, lambda y: (y["e"] > base) & (y["s"] < base + n))

    def block(b: Column, base: Column, spans: Column) -> Column:
        def put(acc: Column, y: Column) -> Column:
            keep = F.greatest(y["s"] - base - acc["at"], F.lit(0))
            return F.struct(F.greatest(acc["at"], y["e"] - base).alias("at"), F.concat(acc["out"], F.substring(b, acc["at"] + 1, keep), F.when(y["s"] >= base, y["tag"]).otherwise("")).alias("out"))

        return F.aggregate(within(spans, base, BLOCK), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda acc: F.concat(acc["out"], F.substring(b, acc["at"] + 1, F.lit(BLOCK))))

    def stretch(t: Column, k: Column) -> Column:
        base = k * (BLOCK * BLOCKS)
        built = lambda spans: F.when(F.size(spans) > 0, F.array_join(F.transform(cut(t, BLOCK), lambda b, j: block(b, base + j * BLOCK, spans)), "")).otherwise(t)
        return _bound(within(F.col(p), base, BLOCK * BLOCKS), built)

    text = F.when(F.size(p) > 0, F.array_join(F.transform(cut(F.col(text_col), BLOCK * BLOCKS), stretch), "")).otherwise(F.col(text_col))
    return ordered.withColumn(text_col, text).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
