"""Exact token ids by the tokenizers library, one white-space word at a time.

The pre-tokenizer of a lower-casing BPE with word ends cuts at white space and
drops it, so the ids of a text are the ids of its white-space words in order.
Words repeat, so their ids are kept (as little-endian 32-bit bytes) and a text
costs one split and one join. ``word_separable`` reads that property from the
tokenizer file; a file without it is encoded text by text.
"""

from __future__ import annotations

import json
import os

import numpy as np

from larder.llm.common import BoundedCache

_CODERS: dict[str, "TokenCoder"] = {}
_CLOSING = ".,;:!?&%$#*|()"
# Letters below U+0250 other than the dotted capital I lower-case one to one and are composed (NFC).
_PLAIN_END, _DOTTED_I = "\u0250", "\u0130"
# The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def word_separable(spec: dict) -> bool:
    """True if white space only separates: it is collapsed, then dropped by a split that keeps matches."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    byte_level_plain = all(not s.get("add_prefix_space") and not s.get("use_regex")
                           for s in steps if s.get("type") == "ByteLevel")
    return (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
            and pattern.endswith(r"[^\s\p{L}\p{N}]+") and r"\s" not in pattern[:-len(r"[^\s\p{L}\p{N}]+")]
            and byte_level_plain and not spec.get("post_processor")
            and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])))


class TokenCoder:
    """Encodes texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = word_separable(spec)
        self.marks = [t["content"][:1].encode() for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.words = BoundedCache(self._word, 350_000)

    def _encode(self, raw: bytes) -> bytes:
        ids = self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _pieces(self, pieces: list[str]) -> bytes:
        return np.array([t.id for p in pieces for t in self.model.tokenize(p)], dtype="<u4").tobytes()

    def _word(self, raw: bytes) -> bytes:
        """Ids of one white-space word, through the library's own steps."""
        text = raw.decode("utf-8", "replace")
        if any(m in raw for m in self.marks):  # may hold an added token's string
            return self._encode(raw)
        if text.isalpha() and max(text) < _PLAIN_END and _DOTTED_I not in text:
            low = text.lower()  # one piece of the split, composed already: only lower-casing is left
            if low != text:
                return self.words[low.encode()]
            return self._pieces([raw.decode("latin-1").translate(_BYTE_CHARS)])
        stem = text.rstrip(_CLOSING)
        if stem != text and stem.isalpha():  # letters and closing marks are separate pieces
            return self.words[stem.encode()] + self.words[text[len(stem):].encode()]
        text = self.tokenizer.normalizer.normalize_str(text)
        return self._pieces([p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        raw = text.encode("utf-8", "replace")
        if not self.by_word:
            return self._encode(raw)
        return b"".join(map(self.words.__getitem__, raw.split()))


def coder(path: str) -> TokenCoder:
    """The process's coder for a tokenizer file (workers are reused between tasks)."""
    if path not in _CODERS:
        _CODERS[path] = TokenCoder(path)
    return _CODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
