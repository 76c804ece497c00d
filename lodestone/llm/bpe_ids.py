"""Exact byte-level BPE ids through a table of distinct pre-tokens.

Merges never cross pre-tokens, so the ids of a text are its pre-tokens' ids in a row. A worker keeps the ids of the
pre-tokens that it has met, as packed bytes; new ones are merged by tiktoken, whose ranks are the tokenizer's own ids where these are in the order
of its merges (checked when the table is made; else the tokenizers library does it). Texts with characters outside the ranges below, whose classes differ between
regular-expression libraries, and texts with a special token's string go through the tokenizers library whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from lodestone.llm.common import worker_cached

#: Letters, numbers and white space among the plain characters, as in the library's pre-tokenizer.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
SPACE = "\\t\\n\\r  "
_PLAIN = re.compile(r"[\t\n\r -~ -ɏ‐-‧‰-⁞]*")
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PretokenTable(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: str, limit: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self.merge = self._ranked()

    def _ranked(self):
        import json

        import tiktoken

        model, symbol = json.loads(self.tokenizer.to_str())["model"], byte_of_symbol()
        vocab = {s: i for s, i in model["vocab"].items() if s not in self.special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or len(merged) + 256 != len(vocab):
            return lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids
        ranks = {bytes(symbol[c] for c in s): i for s, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, pretoken: str) -> bytes:
        ids = self[pretoken] = struct.pack(f"<{len(i := self.merge(pretoken))}I", *i)
        return ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        cut = [_PRETOKEN.findall(t) if p else None for t, p in zip(texts, plain, strict=True)]
        if len(self) > self.limit:
            self.clear()
        return [self.whole(t) if c is None else b"".join(map(self.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]


def pretoken_table(tokenizer: str, limit: int = 200_000) -> PretokenTable:
    return worker_cached(("pretokens", tokenizer, limit), lambda: PretokenTable(tokenizer, limit))
