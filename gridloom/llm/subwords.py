"""SentencePiece encoding that keeps the source, and decoding.

The model file holds a compiled character map: a double-array trie over the bytes of what it replaces, and the
replacements. A text is normalised by the longest entry that prefixes what is left of it, and every byte of the result
records the source byte that its entry began at. What stays the same is copied in runs; a character that begins no entry
can't change. Pairs of pieces are then merged, the highest score first and the leftmost of equals, and every piece is
projected by the records of its first and following byte to the bytes of the source that it stands for. A character
without a piece becomes byte pieces; the last of them has the character's span, the others are empty at its start.

No merge crosses a place where a space mark follows another character, nor one between characters that no chain of
pieces connects, so texts are cut there and equal cuts are merged once in a worker. Whole texts go through, in batches of 2 MB or one text;
nothing is exchanged.

Defined cases: a null text is an empty one, which has no pieces; a text of any length is encoded whole, by itself if it
is long; null ids and rows that share an id are carried through; other columns are not read; an empty table gives no
rows. Characters of control pieces are ordinary text, as in the library. Models of another kind than merges with byte
pieces, or with pieces that users defined or that are unused, are refused.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import slices

#: The mark of a space in pieces, and what an invalid byte becomes.
SPACE, INVALID = "▁", "�"
#: Distinct cuts that a worker remembers at a time, and the characters they may have together.
REMEMBERED, CHARACTERS = 1 << 18, 1 << 24
#: Cuts of at most so many characters are merged many at a time; the rank of a pair that is no piece.
TOGETHER, NONE = 40, np.iinfo(np.int32).max
#: What stands for no symbol, and for one that is no piece.
EMPTY, UNKNOWN_ID = -1, -2
#: Kinds of pieces, as model files number them.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """A compiled map: four bytes of length, that many bytes of trie units, and replacements that end at zero bytes."""

    def __init__(self, compiled: bytes):
        n = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units, self.texts = np.frombuffer(compiled[4 : 4 + n], "<u4").tolist(), compiled[4 + n :]
        self.leads = bytes(b for b in range(256) if self.units and self._child(0, b) is not None)

    def _child(self, node: int, byte: int) -> int | None:
        unit = self.units[node]
        to = node ^ ((unit >> 10) << ((unit & 1 << 9) >> 6)) ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest entry that text[at:] begins with, and its replacement."""
        node, found, i = 0, None, at
        while self.units and i < len(text) and (to := self._child(node, text[i])) is not None:
            node, i = to, i + 1
            unit = self.units[node]
            if unit & 1 << 8:  # an entry ends here; its value lies in the child by a zero byte
                found = (i - at, self.units[node ^ ((unit >> 10) << ((unit & 1 << 9) >> 6))] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])]


class Encoder:
    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model must be one of merges with byte pieces, without pieces that users defined or that are unused")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = model.normalizer_spec
        self.map, self.suffix = CharacterMap(spec.precompiled_charsmap), model.trainer_spec.treat_whitespace_as_suffix
        self.prefix, self.squeeze, self.mark = spec.add_dummy_prefix, spec.remove_extra_whitespaces, (SPACE if spec.escape_whitespaces else " ").encode()
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self._join_table()
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.widths = np.array([len(p.piece.encode()) if p.type == NORMAL else 1 for p in model.pieces], np.int64)
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.cut = self._cuts([p.piece for p in model.pieces if p.type == NORMAL])
        self._forget()

    def _join_table(self) -> None:
        """Symbols are pieces and their characters, by number; joins are the pairs of them that make a piece, sorted, with the rank of its score."""
        names = list(self.ids) + sorted({c for p in self.ids for c in p} - self.ids.keys())
        number = {p: i for i, p in enumerate(names)}
        rank = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = [(number[p[:k]] << 32 | number[p[k:]], rank[self.scores[p]], number[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        table = np.array([*sorted(found), (np.iinfo(np.int64).max, NONE, EMPTY)], np.int64)
        self.joins, self.ranks, self.made = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.symbol = np.full(0x110000, len(names), np.int32)  # the last symbol is any other character
        for p, i in number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.id_of = np.array([self.ids.get(p, UNKNOWN_ID) for p in names] + [UNKNOWN_ID, EMPTY], np.int32)  # the last is for EMPTY

    def _cuts(self, pieces: list[str]) -> re.Pattern:
        """Finds the stretches of a normalised text that no merge leaves: space marks, and characters that chains of pieces connect."""
        mark = self.mark.decode()
        if any(b == mark != a for p in pieces for a, b in zip(p, p[1:], strict=False)):
            return re.compile(r"(?s).+")
        above: dict[str, str] = {}

        def root(c: str) -> str:
            while above.setdefault(c, c) != c:
                c = above[c]
            return c

        for p in pieces:
            solid = p.lstrip(mark)
            for c in solid if len(p) > 1 else "":
                above[root(c)] = root(solid[0])
        groups: dict[str, list[str]] = {}
        for c in sorted(above):
            groups.setdefault(root(c), []).append(c)
        escaped = {r: "".join(map(re.escape, g)) for r, g in groups.items()}
        kinds = [f"[{escaped[r]}]+" for r, g in groups.items() if len(g) > 1]
        single = "".join(escaped[r] for r, g in groups.items() if len(g) == 1)
        kinds += [f"[{single}]"] if single else []
        known = "".join(escaped.values())
        return re.compile((rf"{mark}*(?:{'|'.join(kinds)})|" if kinds else "") + rf"{mark}+|[^{mark}{known}]+")

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.characters, self.starts, self.sizes, self.table, self.used = 0, np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.int32), 0

    # Normalisation, and where each byte came from.

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each, and for their end, the source byte that its entry began at."""
        source = text.encode("utf-8", "replace")
        if not source:
            return b"", np.zeros(1, np.int64)
        plain, at = (self._mapped(source) if self.map.leads else (source, np.arange(len(source), dtype=np.int64)))
        raw, end = np.frombuffer(plain, np.uint8), len(source)
        if self.squeeze:
            space = raw == 32
            if space.all():
                return b"", np.zeros(1, np.int64)
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            raw, at = raw[keep], at[keep]
        at = np.repeat(at, np.where(raw == 32, len(self.mark), 1))
        out = raw.tobytes().replace(b" ", self.mark)
        if self.prefix and not self.suffix:
            out, at = self.mark + out, np.append(np.full(len(self.mark), self._solid(source) if self.squeeze else 0), at)
        while self.squeeze and out.endswith(self.mark):  # at most one was a space; the library takes the text's own marks too
            out = out[: -len(self.mark)]
            at, end = at[: len(out)], int(at[len(out)])
        if self.prefix and self.suffix:
            out, at = out + self.mark, np.append(at, np.full(len(self.mark), end))
        return out, np.append(at, end)

    def _solid(self, source: bytes) -> int:
        """Where the first entry or character begins that is no space."""
        i = 0
        while i < len(source) and (entry := self.map.longest(source, i) or (1, source[i : i + 1]))[1] == b" ":
            i += entry[0]
        return i

    def _mapped(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The source with all entries of the map replaced, and where each byte came from."""
        parts, at, i, copied = [], [], 0, 0
        lead = re.compile(b"[" + re.escape(self.map.leads) + b"]")
        while found := lead.search(source, i):
            i = found.start()
            if source[i] & 0xC0 != 0x80 and (entry := self.map.longest(source, i)):
                parts += [source[copied:i], entry[1]]
                at += [np.arange(copied, i), np.full(len(entry[1]), i)]
                i = copied = i + entry[0]
            else:
                i += 1
        return b"".join([*parts, source[copied:]]), np.concatenate([*at, np.arange(copied, len(source))]).astype(np.int64)

    # Merges.

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which join of two symbols each pair is; the last stands for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.joins, key)
        return np.where((self.joins[at] == key) & (left >= 0) & (right >= 0), at, len(self.joins) - 1)

    def _together(self, cuts: list[str]) -> np.ndarray:
        """The symbols of cuts of one length, a row each, filled up with EMPTY: the best join of every row at a time, so that rows stay of one length until they have none."""
        width = len(cuts[0])
        part = self.symbol[np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, width)]
        out, rows = np.full(part.shape, EMPTY, np.int32), np.arange(len(cuts))
        pair = self._pairs(part[:, :-1], part[:, 1:])
        while len(rows):
            rank = self.ranks[pair]
            i = rank.argmin(1) if pair.shape[1] else np.zeros(len(rows), np.int64)
            more = rank[np.arange(len(rows)), i] < NONE if pair.shape[1] else np.zeros(len(rows), bool)
            if not more.all():
                out[rows[~more], : part.shape[1]] = part[~more]
                part, pair, rows, i = part[more], pair[more], rows[more], i[more]
            r, columns = np.arange(len(rows)), np.arange(part.shape[1] - 1)
            part[r, i] = self.made[pair[r, i]]
            part = np.take_along_axis(part, columns + (columns > i[:, None]), 1)
            pair = np.take_along_axis(pair, columns[:-1] + (columns[:-1] >= i[:, None]), 1)
            for on, j in ((i > 0, i - 1), (i < part.shape[1] - 1, i)):
                pair[r[on], j[on]] = self._pairs(part[r[on], j[on]], part[r[on], j[on] + 1])
        return out

    def merged(self, cut: str) -> list[int]:
        """The ids of one cut: pairs are joined from the highest score, the leftmost of equals, until no pair is a piece."""
        score, n, part = self.scores.get, len(cut), list(cut)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(-s, i, 2) for i in range(n - 1) if (s := score(cut[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i] if part[i] else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been joined with another since
            part[i], part[j] = part[i] + part[j], ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (s := score(part[left] + part[right])) is not None:
                    heapq.heappush(agenda, (-s, left, len(part[left]) + len(part[right])))
        out: list[int] = []
        for piece in filter(None, part):
            known = self.ids.get(piece)
            out += (known,) if known is not None else (self.byte_ids[b] for b in piece.encode())
        return out

    def _learn(self, cuts: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for c in cuts:
            by_length.setdefault(len(c) if len(c) <= TOGETHER else 0, []).append(c)
        alone = by_length.pop(0, [])
        for group in by_length.values():
            ids = self.id_of[self._together(group)]
            odd = (ids == UNKNOWN_ID).any(1)
            self._add([c for c, x in zip(group, odd, strict=True) if not x], (ids[~odd] >= 0).sum(1), ids[~odd][ids[~odd] >= 0])
            alone += [c for c, x in zip(group, odd, strict=True) if x]
        found = list(map(self.merged, alone))
        self._add(alone, np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.int32))

    def _add(self, cuts: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        k, to = len(self.place), len(self.place) + len(cuts)
        if to > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * to), np.resize(self.sizes, 2 * to)
        if self.used + len(flat) > len(self.table):
            self.table = np.resize(self.table, 2 * (self.used + len(flat)))
        self.starts[k:to], self.sizes[k:to] = self.used + np.cumsum(sizes) - sizes, sizes
        self.table[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.characters += sum(map(len, cuts))
        self.place.update(zip(cuts, range(k, to), strict=True))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of each text: its pieces and the source bytes that each stands for."""
        if len(self.place) > REMEMBERED or self.characters > CHARACTERS:
            self._forget()
        norms = [self.normalised(t) for t in texts]
        cuts = [self.cut.findall(norm.decode("utf-8", "replace")) for norm, _ in norms]
        if new := set().union(*cuts).difference(self.place):
            self._learn(new)
        return [self._projected(c, *norm) for c, norm in zip(cuts, norms, strict=True)]

    def _projected(self, cuts: list[str], norm: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.fromiter(map(self.place.__getitem__, cuts), np.int64, len(cuts))
        sizes = self.sizes[k]
        stop = np.cumsum(sizes)
        ids = self.table[np.repeat(self.starts[k] - stop + sizes, sizes) + np.arange(stop[-1] if len(stop) else 0)]
        ends = np.cumsum(self.widths[ids])
        begins = ends - self.widths[ids]
        single = self.is_byte[ids]
        if single.any():
            lead = np.append((np.frombuffer(norm, np.uint8) & 0xC0) != 0x80, True)
            first = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
            begins = np.where(single, first[begins], begins)
            ends = np.where(single & ~lead[ends], begins, ends)
        return ids, at[begins], at[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(model(path))


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends, decoded): the pieces of each text, the bytes of the text that each stands for, and the library's decoding of the ids.

    path: the model file, at the same place on every machine.
    """
    rows, path = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path or vocabulary()

    def lists(found: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *found]), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in slices(batches, "text", 2 << 20):
            found = e.encode([text or "" for text in batch.column("text").to_pylist()])
            ids, begins, ends = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids, pa.int32()), lists(begins, pa.int64()), lists(ends, pa.int64()), pa.array(map(e.decode, ids), pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, begins array<bigint>, ends array<bigint>, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    out = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), digest("ends").alias("ends_sha256"))
