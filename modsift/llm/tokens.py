"""Token ids of whole texts with a public word-level BPE tokenizer, through a bounded cache of words."""

from __future__ import annotations

import re
import unicodedata

import regex

# Fixed values of the tokenizer file: its split pattern and the byte alphabet of byte-level BPE.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# The usual chunk, lower case already: Latin letters, then ASCII marks or none (one part each to the split pattern).
SIMPLE = re.compile(r"([a-z\xdf-\xf6\xf8-\u024f]+)([!-/:-@\[-`{-~]*)")
# White space to Python but not to the tokenizer, special tokens, a letter lowered by context.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "<|")


def byte_alphabet() -> dict[int, str]:
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Cache(dict):
    """Values made on demand, in two generations of at most ``entries`` each; long keys are not kept."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class WordTokenizer:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False)``, as little-endian uint16 bytes.

    The normalizer (NFC, white space, lower case) and the split work word by word, so the ids of a
    text are those of its white-space-separated chunks in a row.  Chunks and words are cached in two
    generations of at most ``entries`` each.  Texts with a character that breaks this rule, or that is
    special, go through the tokenizer whole.
    """

    def __init__(self, path: str, entries: int = 300_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.alphabet = byte_alphabet()
        self.packed = [i.to_bytes(2, "little") for i in range(self.whole.get_vocab_size())]
        self.cache = _Cache(self._chunk, entries)

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()  # these bytes stand for themselves
        mapped = word if plain else word.encode().decode("latin1").translate(self.alphabet)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(mapped)])

    def _chunk(self, chunk: str) -> bytes:
        simple = SIMPLE.fullmatch(chunk)
        if simple:
            letters, marks = simple.groups()
            return self.cache[letters] + self.cache[marks] if marks else self._word(letters)
        parts = PATTERN.findall(chunk)
        if len(parts) == 1:
            return self._word(chunk)
        return b"".join([self.cache[p] for p in parts])

    def ids(self, text: str) -> bytes:
        if any(odd in text for odd in ODD):
            return b"".join(i.to_bytes(2, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.cache.__getitem__, text.lower().split()))


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file, so that its cache serves later tasks too."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
