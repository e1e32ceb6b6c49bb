"""Byte-level BPE vocabularies as the operators of this subpackage use them.

A vocabulary is read from a public ``tokenizers`` file, whose path is a parameter; nothing is
trained here. Every Python worker opens a file once (``opened``) and keeps a bounded memory of
words it has met.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import regex
import tiktoken

# The split pattern of byte-level BPE; white space is written out, since the
# libraries differ on what \s holds.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: The same for texts of ASCII alone, for which the plainer engine will do.
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
#: Words remembered per worker.
REMEMBERED = 1 << 19
#: Longer words are encoded each time, so that the memory stays bounded in bytes too.
LONGEST_REMEMBERED = 128
ID_BYTES = 4


def _byte_of_character() -> dict[str, int]:
    """The printable characters that stand for bytes in a vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words(dict):
    """Ids of a word as little-endian 32-bit integers; ``encode`` is asked once per word that is remembered.

    When half of the memory is full, the other half is forgotten, apart from what has been met again since.
    """

    def __init__(self, encode):
        super().__init__()
        self._encode = encode
        self._before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self._before.get(word)
        if ids is None:
            found = self._encode(word)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED // 2:
                self._before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteBPE:
    """A byte-level BPE vocabulary: token bytes, merges in order, special tokens, words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        pre, model = data.get("pre_tokenizer") or {}, data["model"]
        plain = (
            model.get("type") == "BPE"
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not data.get("normalizer")
        )
        if not plain:
            raise ValueError(f"{os.path.basename(path)} is not a plain byte-level BPE vocabulary")
        byte = _byte_of_character()
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.special = special
        self.token_bytes = {
            i: bytes(byte[c] for c in token)
            for token, i in model["vocab"].items()
            if token not in special
        }
        self.token_bytes |= {i: token.encode() for token, i in special.items()}
        self.ids = {b: i for i, b in self.token_bytes.items() if i not in special.values()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [tuple(bytes(byte[c] for c in part) for part in m) for m in pairs]
        if [self.ids[a + b] for a, b in self.merges] != sorted(self.ids[a + b] for a, b in self.merges):
            raise ValueError("ids do not follow the order of the merges")
        self._fast = tiktoken.Encoding(
            "words", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={}
        )
        self._split = regex.compile(PATTERN)
        self._split_ascii = re.compile(ASCII_PATTERN)
        names = "|".join(map(regex.escape, sorted(special, key=len, reverse=True)))
        self._special = regex.compile(names) if names else None
        self.longest_special = max(map(len, special), default=0)
        self.words = Words(self._fast.encode_ordinary)

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        return (self._split_ascii if text.isascii() else self._split).findall(text)

    def segments(self, text: str):
        """(start, text, id): ordinary stretches have id None, special strings their id."""
        at = 0
        if self._special is not None:
            for found in self._special.finditer(text):
                if found.start() > at:
                    yield at, text[at : found.start()], None
                yield found.start(), found[0], self.special[found[0]]
                at = found.end()
        if at < len(text):
            yield at, text[at:], None

    def encode(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        if self._special is None or not self._special.search(text):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        return b"".join(
            b"".join(map(self.words.__getitem__, self.split(part)))
            if special is None
            else special.to_bytes(ID_BYTES, "little")
            for _, part, special in self.segments(text)
        )

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the words of a text (code points), and the number of tokens of each word."""
        ends, counts = [], []
        for start, part, special in self.segments(text):
            if special is not None:
                ends.append(start + len(part))
                counts.append(1)
                continue
            for found in self._split.finditer(part):
                ends.append(start + found.end())
                counts.append(len(self.words[found[0]]) // ID_BYTES)
        return ends, counts


@lru_cache(maxsize=4)
def opened(path: str) -> ByteBPE:
    """The vocabulary of a file, once per process."""
    return ByteBPE(path)


def public_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; asked on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def resolved(path: str) -> str:
    """A path as given, or the place of a public file if only its name is given."""
    return path if os.sep in path else public_path(path)
