"""Pieces, infilling and the repair of conversations against the library and brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import infill, repair, subwords

from .test_llm import ODD, docs

# 11.

ALPHABET = " abcde  \n\t.,1290éß中日😀▁ａﬁ́ABC\x00\x01<s></s><unk><0x41>가각①ｶﾞ　"


def texts(n, seed, alphabet=ALPHABET, most=60):
    r = random.Random(seed)
    return ["", " ", "  a", "a  ", "▁", "▁▁a▁", "<s>hi</s>", "12345 67", *("".join(r.choice(alphabet) for _ in range(r.randrange(most))) for _ in range(n))]


def library(e, text):
    found = e.library.encode(text, return_type="proto").pieces
    return [p.id for p in found], [p.begin for p in found], [p.end for p in found]


def as_lists(found):
    return [tuple(list(map(int, x)) for x in row) for row in found]


def test_pieces_and_spans_are_the_librarys():
    e, t = subwords.encoder(subwords.vocabulary()), texts(1500, 1)
    found = e.encode(t)
    assert as_lists(found) == [library(e, x) for x in t]
    for x, (_, begins, ends) in zip(t, found, strict=True):  # this model's map changes nothing, so the spans are the text
        assert b"".join(x.encode()[b:n] for b, n in zip(begins, ends, strict=True)) == x.encode()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("where", ["prefix", "suffix", "none"])
def test_compiled_maps(rule, squeeze, where):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(subwords.vocabulary(), "rb") as f:
        m = pb.ModelProto.FromString(f.read())
    if rule != "identity":
        m.normalizer_spec.precompiled_charsmap = pb.NormalizerSpec.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()).precompiled_charsmap
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix, m.trainer_spec.treat_whitespace_as_suffix = squeeze, where != "none", where == "suffix"
    e, t = subwords.Encoder(m.SerializeToString()), texts(250, 2)
    assert as_lists(e.encode(t)) == [library(e, x) for x in t]


def test_cuts_long_and_forgotten(monkeypatch):
    e = subwords.Encoder(subwords.model(subwords.vocabulary()))
    for limit in (1 << 18, 3):
        monkeypatch.setattr(subwords, "REMEMBERED", limit)
        for t in ("ab" * 3000, "a" * 41, "a" * 40, "straße" * 9 + "中" * 50, " ".join(map(str, range(300)))):
            assert as_lists(e.encode([t, "a b"])) == [library(e, t), library(e, "a b")]


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(subwords.model(subwords.vocabulary()))
    m.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        subwords.Encoder(m.SerializeToString())
    m.trainer_spec.model_type, m.pieces[300].type = 2, 4
    with pytest.raises(ValueError):
        subwords.Encoder(m.SerializeToString())


def test_encoded_rows(spark):
    df = docs(spark, ODD)
    got = subwords.encoded(df).collect()
    e = subwords.encoder(subwords.vocabulary())
    want = [(i, *library(e, t or ""), e.library.decode(library(e, t or "")[0])) for i, t in ODD]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert subwords.encoded(df.limit(0)).count() == 0


# 12.


def infilled_brute(doc_id, text, how=infill.Infill()):
    text, (p, s, m) = text or "", how.markers
    units = re.findall(how.unit, text)
    h = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or p in text or s in text or m in text or h3 % 100 >= how.rate:
        return n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", x, y, z, s + z + p + x + m + y) if h4 % 100 < how.spm else (n, "psm", x, y, z, p + x + s + z + m + y)


@pytest.mark.parametrize("how", [infill.Infill(), infill.Infill(unit=r"\S+\s*|\s+", seed=11, rate=60, spm=20, markers=("[pre]", "[suf]", "[mid]"))])
def test_infilling(spark, how):
    r = random.Random(4)
    rows = [*ODD, *((100 + k, "".join(r.choice("ab \n\n\x01\x02\x01\x0201é😀<$0\\") for _ in range(r.randrange(60)))) for k in range(400)), (900, "a<P>b\nc"), (901, "x\n<M>"), (902, "<\nS>"), (903, "\n" * 5000), (904, "[mid]")]
    df = docs(spark, rows).withColumn("n", F.lit("other")).withColumn("Prefix", F.lit(1)).withColumn("_text", F.lit("kept"))
    out = infill.infilled(df, how)
    got = out.select("doc_id", "n", "form", "prefix", "middle", "suffix", "output", infill.restored(F.col("output"), F.col("form"), how).alias("back"), "text", "_text").collect()
    assert len(got) == len(rows)
    for x in got:
        assert tuple(x)[1:7] == infilled_brute(x.doc_id, x.text, how)
        assert x.back == (x.text or "") and x["_text"] == "kept"
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert infill.infilled(df.limit(0), how).count() == 0


def test_markers_that_overlap_are_refused():
    for markers in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aba", "x", "y"), ("", "x", "y"), ("<<P>", "<P>", "x")):
        with pytest.raises(ValueError):
            infill.Infill(markers=markers)


# 13.


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def damaged_brute(rows):
    out = []
    for c, t, r, x in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x
        out += [(c, t, "user" if f == 4 else r, x)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def repaired_brute(rows):
    """The least of all edits by whole strings, from the last row to the first."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r[2], r[3])))
    turns, seen, marks = [r[1] for r in rows if r[1] is not None], set(), []
    for _, _, r, x in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", x)
        marks.append("b" if not solid else "d" if (r, x) in seen else "." if solid[-1] in ".!?" else "t")
        seen.add((r, x))
    first = [r[2][:1] for r in rows]
    arcs = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    after = {}
    for i in range(len(rows), -1, -1):
        here = {}
        for q, to in arcs.items():
            found = [(0, "", [])] if i == len(rows) and q in (0, 3) else []
            if i < len(rows):
                late = 3 * (marks[i] == "t")
                found.append((after[q][0] + 4, "D" + after[q][1], after[q][2]))
                if marks[i] in ".t":
                    if first[i] in to:
                        c, a, o = after[to[first[i]]]
                        found.append((c + late, "K" + a, [f"{rows[i][2]}:{rows[i][3]}", *o]))
                    for r, p in ((r, p) for r, p in to.items() if r != "s"):
                        c, a, o = after[p]
                        found.append((c + 3 + late, "R" + a, [f"{repair.ROLES[r]}:{rows[i][3]}", *o]))
            if found:
                here[q] = min(found)
        for _ in range(6):
            for q, to in arcs.items():
                for r, p in ((r, p) for r, p in to.items() if r != "s" and p in here):
                    c, a, o = here[p]
                    here[q] = min(here.get(q, (10**9,)), (c + 3, "I" + a, [f"{repair.ROLES[r]}:", *o]))
        after = here
    cost, audit, lines = after[0]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(n, most, seed):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randrange(1, most)):
            out.append((None if c == 3 else c, None if r.random() < 0.05 else t * r.randrange(1, 3) // r.randrange(1, 3), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2"]), r.choice(["Hi.", "ok?", "yes!", "no", "", "  \t", "x.", "y", "long text. ", None])))
    return out


@pytest.mark.parametrize(("size", "fan", "rows"), [(256, 64, conversations(60, 12, 3)), (3, 2, conversations(12, 60, 4)), (2, 2, [*conversations(1, 200, 5), *[(7, 1, "user", "a.")] * 30])])
def test_repair(spark, size, fan, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, idx int")
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    groups = {}
    for r in damaged_brute(rows):
        groups.setdefault(r[0], []).append(r)
    want |= {c: repaired_brute(g) for c, g in groups.items()}
    got = repair.repaired(repair.damaged(df), repair.keyed(df).select(*repair.CONV), size, fan)
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want


def test_repair_of_long_texts_and_nothing(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "b " * 600_000), (1, 2, "user", "c.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    keys = repair.keyed(df).select(*repair.CONV)
    plain = repair.keyed(df).drop("conv_id")
    (got,) = repair.repaired(plain, keys).collect()
    assert tuple(got)[1:] == repaired_brute(rows)
    none = repair.repaired(plain.limit(0), keys).collect()
    assert [tuple(r)[1:7] for r in none] == [(0, 0, 0, 0, 0, 0)]
    assert repair.repaired(plain.limit(0), keys.limit(0)).count() == 0
