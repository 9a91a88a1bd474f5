"""Token ids of a tokenizer file."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

# Letters, numbers and white space below U+0100, as Unicode has them (fixed values).
_L, _N, _S = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
# a blank after white space that no word follows belongs to the white space before it
_JOINED = re.compile(rf"[{_S}] (?:[{_S}]|\Z)")


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library, as unsigned 32-bit numbers, little-endian.

    Where the merges of the file rank as their ids, plain texts are encoded by tiktoken, which gives the same ids in less
    time; plain are texts of characters below U+0100, without special tokens and without blanks that belong to other
    white space. The library cuts a text into words before it merges, and in a plain text no word goes on over a blank,
    so very long ones are encoded in parts. Other texts go to the library as they are.
    """

    def __init__(self, path: str, part: int = 1 << 20):
        from tokenizers import Tokenizer

        self.library, self.part = Tokenizer.from_file(path), part
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec["pre_tokenizer"] or {}
        self.cuts = spec["normalizer"] is None and step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._ranked(spec["model"]) if self.cuts else None

    def _ranked(self, model: dict):
        """The same merges for tiktoken, if each merge's token has the next id after the 256 bytes."""
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = sorted(set(range(256)) - set(own))
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
        if any(vocab[a + b] != 256 + n for n, (a, b) in enumerate(merges)) or model.get("ignore_merges"):
            return None
        import tiktoken

        ranks = {bytes(byte[c] for c in token): n for token, n in vocab.items() if n < 256 + len(merges)}
        return tiktoken.Encoding("file", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        return bool(self.cuts) and (text.isascii() or max(text) < "Ā") and not any(s in text for s in self.special) and not _JOINED.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.fast is not None and self._plain(text) for text in texts]
        others = iter(self._library([text for text, fast in zip(texts, plain, strict=True) if not fast]))
        return [self._ranks(text) if fast else next(others) for text, fast in zip(texts, plain, strict=True)]

    def _ranks(self, text: str) -> bytes:
        return b"".join(array("I", self.fast.encode_ordinary(part)).tobytes() for part in cut_before_blanks(text, self.part))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


def cut_before_blanks(text: str, size: int) -> Iterator[str]:
    """Parts of at least ``size`` characters, each but the first beginning with a blank."""
    start = 0
    while (at := text.find(" ", start + size)) >= 0:
        yield text[start:at]
        start = at
    yield text[start:]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
