"""Byte-level BPE over cached pre-tokens, shared by packing and token counts."""

from __future__ import annotations

import array
import os
import re

#: Pre-tokens of texts without an ODD character; elsewhere the tokenizer's own pre-tokenizer splits the text.
SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters on which Python's classes and Unicode's L, N and White_Space differ, or that lie beyond Latin letters.
ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
#: Pre-tokens that one worker keeps.
KEEP = 500_000

_made: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable character by which byte-level BPE stands for each byte: itself, or else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit bytes; it starts anew when full."""

    def __init__(self, model, added: dict[str, int]):
        self.model, self.added, self.letters = model, added, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEEP:
            self.clear()
        if word in self.added:  # no other pre-token is written like one
            ids = self[word] = array.array("I", [self.added[word]]).tobytes()
            return ids
        mapped = word.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = self[word] = array.array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return ids


class Encoder:
    """Ids of whole texts, equal to encode(text, add_special_tokens=False).ids.

    As there, a text that spells one of the file's added tokens, such as
    <|endoftext|>, has its id, and what is between two of them is split on its own.
    reach: the characters on either side of an edit that can become part of one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError(f"{path} has added tokens that take blanks or words around them")
        own = {t.content: i for i, t in added.items()}
        self.pieces = Pieces(self.tokenizer.model, own)
        # of several that begin at one place, the longest
        self.special = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own else None
        self.reach = max(map(len, own), default=1) - 1

    def split(self, text: str) -> list[str]:
        """The pre-tokens, added tokens among them, which make up the text."""
        if self.special is None or not self.special.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if ODD.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return SPLIT.findall(text)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
