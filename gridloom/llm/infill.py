"""Fill-in-the-middle transformation by escaped marker injection.

A delimiter is escaped in the text, regexp_replace appends it after every unit, and the units are counted by what it
adds. Two hashes of the id choose how many of them the prefix and the middle end after; substring_index takes the
three runs of units by the delimiter's rank, which are freed of it and unescaped. The three are laid out behind their
markers, prefix first (psm) or suffix first (spm). One pass of string functions over the rows: nothing is exchanged.

Defined cases: a null text is an empty one and is plain, as is a text that holds a marker; a null id hashes as an empty
string; rows that share an id are cut at the same ranks; a text of any length is cut whole; other columns are carried
along by infilled(); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .store import fresh

#: Fixed values of the contract: the unit of a line, the seed, shares in percent, and what goes before prefix, suffix and middle.
LINES, SEED, RATE, SPM, MARKERS = r"[^\n]*\n|[^\n]+", 7, 100, 50, ("<P>", "<S>", "<M>")

#: The delimiter, what escapes it, and the codes of both behind the latter. No pattern of units may tell them from letters.
DELIMITER, ESCAPE, CODES = "\x01", "\x02", ("0", "1")


@dataclass(frozen=True)
class Infill:
    unit: str = LINES
    seed: int = SEED
    rate: int = RATE
    spm: int = SPM
    markers: tuple[str, str, str] = MARKERS

    def __post_init__(self) -> None:
        """No marker may arise where texts and markers meet, so that an output has each marker once."""
        for k, m in enumerate(self.markers):
            others = self.markers[:k] + self.markers[k + 1 :]
            if not m or any(m in x for x in others) or any(x.startswith(m[i:]) for i in range(1, len(m)) for x in self.markers):
                raise ValueError(f"marker {m!r} may overlap others")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + CODES[0])), F.lit(DELIMITER), F.lit(ESCAPE + CODES[1]))


def unescaped(text: Column) -> Column:
    """The text of escaped parts joined by delimiters. In escaped texts a code is behind every ESCAPE, so the order of the two is safe."""
    plain = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + CODES[1]), F.lit(DELIMITER)), F.lit(ESCAPE + CODES[0]), F.lit(ESCAPE))


def _ranked(injected: Column, k: Column) -> Column:
    return F.call_function("substring_index", injected, F.lit(DELIMITER), k.cast("int"))


def infilled(docs: DataFrame, how: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with n (units), form, prefix, middle, suffix (null if plain) and output; columns of these names give way."""
    new = ("n", "form", "prefix", "middle", "suffix", "output")
    rows = docs.drop(*(c for c in docs.columns if c.lower() in new and c not in (id_col, text_col)))
    taken, names = [*rows.columns, *new], {}
    for c in ("text", "escaped", "injected", "units", "hash", "a", "b", "kind"):
        names[c] = fresh(taken, f"_{c}")
        taken.append(names[c])
    col = {c: F.col(name) for c, name in names.items()}
    p, s, m = (F.lit(x) for x in how.markers)

    def h(k: int) -> Column:
        return F.conv(F.substring(col["hash"], 8 * k + 1, 8), 16, 10).cast("long")

    text, n = col["text"], col["units"]
    steps = [
        {"text": F.coalesce(F.col(text_col), F.lit("")), "hash": F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)},
        {"escaped": escaped(text)},
        {"injected": F.regexp_replace(col["escaped"], how.unit, "$0" + DELIMITER)},
        # The delimiter is one byte, and escaped texts have none.
        {"units": (F.octet_length(col["injected"]) - F.octet_length(col["escaped"])).cast("long")},
        {
            "a": F.least(h(0) % (n + 1), h(1) % (n + 1)), "b": F.greatest(h(0) % (n + 1), h(1) % (n + 1)),
            "kind": F.when((text == "") | F.contains(text, p) | F.contains(text, s) | F.contains(text, m) | (h(2) % 100 >= how.rate), "plain").when(h(3) % 100 < how.spm, "spm").otherwise("psm"),
        },
    ]
    for step in steps:
        rows = rows.withColumns({names[c]: e for c, e in step.items()})
    cut, a, b = col["kind"] != "plain", col["a"], col["b"]
    rows = rows.withColumns({
        "n": n, "form": col["kind"],
        "prefix": F.when(cut, unescaped(_ranked(col["injected"], a))),
        "middle": F.when(cut, unescaped(_ranked(_ranked(col["injected"], b), a - b))),
        "suffix": F.when(cut, unescaped(_ranked(col["injected"], b - n - 1))),  # the last part is what follows the last delimiter: nothing
    })
    laid = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return rows.withColumn("output", laid).drop(*names.values())


def restored(output: Column, form: Column, how: Infill = Infill()) -> Column:
    """The text that an output was made from."""
    p, s, m = how.markers

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, then, 1), first, -1)

    middle = F.substring_index(output, m, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), middle, between(s, m))).otherwise(F.concat(between(p, m), middle, between(s, p)))


def query(spark, sf_dir: str) -> DataFrame:
    out = infilled(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(units) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(units) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, array_to_string(units[1:least(x, y)], '') AS p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(units[greatest(x, y) + 1:n], '') AS s FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""
