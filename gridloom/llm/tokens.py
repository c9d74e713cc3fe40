"""Token ids of a byte-level BPE vocabulary file, on the workers.

The file is the JSON of the tokenizers library. Its vocabulary is also a table of ranks (an id is its merge's place),
so that ordinary text goes through the faster encoder of tiktoken with the same ids; text that holds a special token's
string, and vocabularies that are no such table, go through tokenizers itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        byte, vocab = _byte_of(), {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        pre = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and all(c in byte for k in vocab for c in k)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        plain = plain and [vocab.get(a + b) for a, b in merges] == sorted(vocab.values())[len(vocab) - len(merges) :]
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in k): v for k, v in vocab.items()}, special_tokens={}) if plain else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            found = self.whole.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return np.array(found, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
