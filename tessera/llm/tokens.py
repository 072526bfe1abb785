"""Token ids of whole texts, by a public tokenizer file.

The word BPE vocabulary lowers letters and splits before it merges: first at
white space, then into runs of letters, single digits and runs of signs.  The
ids of a text are therefore those of its parts in order.  Parts repeat; each
process keeps the ids of those it has seen, up to a bound.  A vocabulary of
another build, told by a probe, encodes whole texts.
"""

from __future__ import annotations

import os
from unicodedata import is_normalized

import regex

# Python's split() also cuts at the four control characters; lower() looks at a
# sigma's neighbours; special tokens are found before letters are lowered.
WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "<|")
# Fixed value: the vocabulary's own rule for its parts.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~\\"  # ASCII but for the apostrophe, which may begin a part of its own

PROBE = "Probe: it's  12.5 naïve\nÉtés, 日本語… a##b \x19end."


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class PartIds(dict):
    """part -> little-endian unsigned 32-bit ids, filled when a part is first met."""

    def __init__(self, path: str, most: int = 700_000, longest: int = 48):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merged = self.tokenizer.model.tokenize
        self.most, self.longest = most, longest
        self.letters = byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.by_parts = True
        self.by_parts = self.ids(PROBE) == self.encoded(PROBE)

    def encoded(self, text: str) -> bytes:
        """The ids of any text, the tokenizer's whole way."""
        packed = self.packed
        return b"".join([packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def of_part(self, part: str) -> bytes:
        """The ids of a single part of a lowered, normalised text: only its merges are left to do."""
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merged(part)])

    def __missing__(self, part: str) -> bytes:
        if part.isalpha():
            ids = self.of_part(part)
        elif (word := part.rstrip(SIGNS)).isalpha():  # a word and a run of signs
            ids = self[word] + self[part[len(word) :]]
        elif len(cut := PARTS.findall(part)) == 1 and cut[0] == part:
            ids = self.of_part(part)
        else:
            ids = b"".join(map(self.__getitem__, cut))
        if len(part) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        low = text.lower()
        if not self.by_parts or any(x in text for x in WHOLE) or not is_normalized("NFC", low):
            return self.encoded(text)
        return b"".join(map(self.__getitem__, low.split()))


_open: dict[str, PartIds] = {}


def part_ids(path: str) -> PartIds:
    """One cache for each tokenizer file in a Python worker."""
    if path not in _open:
        _open[path] = PartIds(path)
    return _open[path]


def default_path() -> str:
    """Where this machine keeps the public word BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
