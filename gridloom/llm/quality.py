"""Quality scores from a byte-level convolutional network in numpy.

The filters look at WIDTH bytes at a time; as each is a sum of one learned value per byte and place, it is read off
tables for pairs of bytes. The responses are max-pooled over chunks of CHUNK bytes that overlap by half and together
cover the whole document; a hidden layer judges each chunk, and the mean and the extreme of the chunks' hidden units
combine into one probability.

It is trained on the driver on at most SAMPLE labelled documents that are not held out, those with the least hash of
their id. The chunks that it learns from are drawn on the workers from over the whole text, DRAWN of a document, one
from each of as many equal parts of it (all, if it has no more); each pass takes PIECES of them. Scores are taken over
whole texts. Labels, language, source and id are no inputs.

Defined cases: a null text is an empty one, and an empty text is one chunk of padding; a null id is not held out;
labels other than 0 and 1 are ignored; without labels of both classes every score is the share of label 1, or 1/2
without any; repeated rows score alike, and
rows that share an id teach as one, that with the least text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import encoded, slices

#: Bounds of training.
SAMPLE, DRAWN, PIECES, EPOCHS, SHORT, STEPS = 3000, 96, 8, 12, 0.25, 500
#: The network: bytes a filter sees, filters, hidden units, bytes in half a chunk.
WIDTH, FILTERS, HIDDEN, HALF = 6, 24, 16, 96
#: Fixed values of the contract.
ACCEPT, FOLDS, HELD = 0.7, 4, 2
PAD = 32


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def filled(left: np.ndarray) -> np.ndarray:
    """What share of its chunk the rest of a document fills: few bytes set off few filters."""
    return (np.clip(left, 0, 2 * HALF) / (2 * HALF)).astype(np.float32)[:, None]


class Network:
    """w: (WIDTH, 256, FILTERS); the rest dense. Everything is float32."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"w": f(WIDTH, 256, FILTERS, scale=0.3), "b": np.zeros(FILTERS, np.float32), "h": f(FILTERS + 1, HIDDEN, scale=0.3), "hb": np.zeros(HIDDEN, np.float32), "o": f(2 * HIDDEN, scale=0.2), "ob": np.zeros(1, np.float32)}

    def tables(self) -> list[np.ndarray]:
        w = self.p["w"]
        return [(w[k][:, None, :] + w[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def chunks(self, data: bytes, tables: list[np.ndarray]) -> np.ndarray:
        """The pooled responses, (chunks, FILTERS)."""
        x = np.frombuffer(data + bytes([PAD]) * max(0, WIDTH - len(data)), np.uint8)
        out = []
        # Long texts go in stretches of whole half-chunks; a filter may look past its stretch.
        step = HALF * 256
        last = len(x) - WIDTH + 1
        for a in range(0, last, step):
            b = min(a + step, last)
            pair = x[a : b + WIDTH - 2].astype(np.int32) * 256 + x[a + 1 : b + WIDTH - 1]
            r = tables[0][pair[: b - a]]
            for k, t in enumerate(tables[1:], 1):
                r += t[pair[2 * k : 2 * k + b - a]]
            out.append(np.maximum.reduceat(r, np.arange(0, b - a, HALF)))
        half = np.concatenate(out)
        return np.maximum(half[:-1], half[1:]) if len(half) > 1 else half

    def score(self, data: bytes, tables: list[np.ndarray]) -> float:
        p = self.p
        pooled = np.maximum(self.chunks(data, tables) + p["b"], 0)
        pooled = np.concatenate([pooled, filled(len(data) - HALF * np.arange(len(pooled)))], axis=1)
        hidden = np.tanh(pooled @ p["h"] + p["hb"])
        z = np.concatenate([hidden.mean(axis=0), hidden.max(axis=0)]) @ p["o"] + p["ob"][0]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


SPAN = 2 * HALF + WIDTH - 1


def drawn(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of a document, (n, SPAN) bytes, and how many of its bytes there are from the start of each."""
    starts = HALF * np.arange(max(1, -(-(len(data) - HALF) // HALF)))
    if len(starts) > DRAWN:
        edges = np.linspace(0, len(starts), DRAWN + 1).astype(int)
        starts = starts[np.random.default_rng(zlib.crc32(data)).integers(edges[:-1], edges[1:])]
    rows = [data[s : s + SPAN].ljust(SPAN, bytes([PAD])) for s in starts.tolist()]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, SPAN), len(data) - starts


def _batch(docs: list[tuple[np.ndarray, np.ndarray]], r: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks (n, SPAN) of a batch of documents, whose they are, and how full. Of some documents there is a part of one chunk."""
    rows, of, left = [], [], []
    for k, (chunks, rest) in enumerate(docs):
        at = np.arange(len(chunks))
        if r.random() < SHORT:
            i = int(r.integers(len(chunks)))
            n = min(int(r.integers(8, SPAN)), int(rest[i]))
            a = int(r.integers(0, max(1, min(SPAN, int(rest[i])) - n + 1)))
            part = np.full(SPAN, PAD, np.uint8)
            part[:n] = chunks[i, a : a + n]
            rows.append(part[None])
            of.append(k)
            left.append(n)
            continue
        if len(at) > PIECES:
            at = np.sort(r.choice(at, PIECES, replace=False))
        rows.append(chunks[at])
        of += [k] * len(at)
        left += rest[at].tolist()
    return np.concatenate(rows), np.array(of), filled(np.array(left))


def train(docs: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, seed: int = 5, epochs: int = EPOCHS, size: int = 48, rate: float = 4e-3) -> Network:
    """Adam on the log loss of drawn() documents, both classes weighing alike."""
    net, r = Network(seed), np.random.default_rng(seed)
    p = net.p
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = np.where(good, 0.5 / max(good.mean(), 1e-6), 0.5 / max((~good).mean(), 1e-6)).astype(np.float32)
    # Few documents are gone over more often, for as many steps at least.
    for _ in range(max(epochs, STEPS * size // max(len(docs), 1))):
        order = r.permutation(len(docs))
        for at in range(0, len(order), size):
            some = order[at : at + size]
            x, of, full = _batch([docs[i] for i in some], r)
            n = len(some)
            resp = p["w"][0][x[:, : 2 * HALF]]
            for k in range(1, WIDTH):
                resp = resp + p["w"][k][x[:, k : k + 2 * HALF]]
            arg = resp.argmax(axis=1)
            top = np.take_along_axis(resp, arg[:, None, :], axis=1)[:, 0] + p["b"]
            pooled = np.concatenate([np.maximum(top, 0), full], axis=1)
            hidden = np.tanh(pooled @ p["h"] + p["hb"])
            each = np.bincount(of, minlength=n)
            mean = np.zeros((n, HIDDEN), np.float32)
            np.add.at(mean, of, hidden)
            mean /= each[:, None]
            first = np.concatenate([[0], np.cumsum(each)[:-1]])
            most = np.maximum.reduceat(hidden, first)
            feats = np.concatenate([mean, most], axis=1)
            prob = 1 / (1 + np.exp(-np.clip(feats @ p["o"] + p["ob"], -30, 30)))
            dz = (weight[some] * (prob - good[some]) / n).astype(np.float32)
            g = {"o": feats.T @ dz, "ob": dz.sum(keepdims=True)}
            df = dz[:, None] * p["o"]
            dh = df[:, :HIDDEN][of] / each[of][:, None] + df[:, HIDDEN:][of] * (hidden == most[of])
            dh *= 1 - hidden * hidden
            g["h"], g["hb"] = pooled.T @ dh, dh.sum(axis=0)
            dp = (dh @ p["h"][:FILTERS].T) * (top > 0)
            g["b"], g["w"] = dp.sum(axis=0), np.zeros_like(p["w"])
            rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                flat = x[rows, arg + k].astype(np.int64) * FILTERS + cols
                g["w"][k] = np.bincount(flat.ravel(), weights=dp.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, text) of at most SAMPLE labelled documents that are not held out; an id that repeats is one row."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    # Spark's crc32 is the same checksum.
    free = known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD)
    chosen = free.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def lessons(rows: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The drawn chunks of sampled() rows, and whose quality is 1, in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [drawn(encoded(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([c.tobytes() for c, _ in found], pa.binary()), pa.array([n.astype(np.int64).tobytes() for _, n in found], pa.binary())], names=["doc_id", "quality", "chunks", "rest"])

    got = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, quality int, chunks binary, rest binary").collect()
    got.sort(key=lambda x: (x.doc_id, x.quality))
    return [(np.frombuffer(x.chunks, np.uint8).reshape(-1, SPAN), np.frombuffer(x.rest, np.int64)) for x in got], np.array([x.quality == 1 for x in got], bool)


@lru_cache(maxsize=2)
def _loaded(blob: bytes) -> tuple[Network, list[np.ndarray]]:
    import pickle

    net = Network()
    net.p = pickle.loads(blob)
    return net, net.tables()


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    import pickle

    taught, good = lessons(sampled(docs.select("doc_id", "text"), labels))
    constant = None if good.any() and not good.all() else float(good.mean()) if len(good) else 0.5
    blob = b"" if constant is not None else pickle.dumps(train(taught, good).p)
    slim = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            if constant is None:
                net, tables = _loaded(blob)
                out = [net.score(encoded(t), tables) for t in texts]
            else:
                out = [constant] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    found = slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
