"""Streaming BPE: a transducer with bounded lookahead, and an incremental decoder.

**Sufficient lookahead.** Merges run in rank order, and a merge only ever loses its right part
to a merge of lower rank with what follows. ``reach`` of a token is how many bytes behind its
end can still decide whether it is formed:

    reach(x+y) = max(reach(y), grip(y), reach(x) - |y|, grip(x) - |y|)
    grip(t)    = max over earlier merges (t, z) of |z| + reach(t+z)

taken in rank order, so one pass over the merge list computes it; single bytes have reach 0. A
token with ``grip`` over all merges bytes behind it can neither change nor merge further. The
largest value over all tokens is the lookahead of the list. Merges never cross such a boundary,
so both sides of it are encoded on their own: the transducer emits a token as soon as that many bytes
follow, forgets it, and holds a bounded number of bytes whatever the length of a word.

**Words.** A word ends by the split pattern, which itself needs a bounded look ahead; a run of
letters, digits, other signs or white space that does not end within a block is fed to the
transducer as it comes.

**Decoding** goes token by token through the bytes of a token and an incremental UTF-8 decoder,
which holds at most three bytes.

Defined results: a null text is empty, its ids are empty and decode to the empty text; special strings in a
text become their ids and come back; repeated rows are treated each; other columns stay, and give way to an
added column of the same name.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import add_columns
from .bpe import _SPACE, ID_BYTES, ByteBPE, Words, opened, resolved

BLOCK = 1 << 16


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token after which nothing can change it, for a list in rank order."""
    reach: dict[bytes, int] = {}
    grip: dict[bytes, int] = {}
    for x, y in merges:
        both = x + y
        reach[both] = max(
            reach.get(both, 0),
            reach.get(y, 0),
            grip.get(y, 0),
            reach.get(x, 0) - len(y),
            grip.get(x, 0) - len(y),
        )
        grip[x] = max(grip.get(x, 0), len(y) + reach[both])
    return max([1, *reach.values(), *grip.values()])


class Transducer:
    """Bytes of one word in, ids out, as soon as they are stable."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self._made = [ids[a + b] for a, b in merges]
        self._rank = {(ids[a], ids[b]): i for i, (a, b) in reversed([*enumerate(merges)])}
        byte = {b[0]: i for b, i in ids.items() if len(b) == 1}
        self._byte = [byte.get(i) for i in range(256)]
        self._length = {i: len(b) for b, i in ids.items()}
        self.lookahead = sufficient_lookahead(merges)
        #: Bytes held at most, whatever is pushed.
        self.capacity = self.lookahead + max(map(len, ids)) + 64
        self._held = bytearray()

    def _encode(self, data: bytes) -> list[int]:
        """The merge of the least rank first, of equal ones the left one; a merge changes only the ranks beside it."""
        made, rank, never = self._made, self._rank.get, len(self._made)
        ids = [self._byte[b] for b in data]
        ranks = [rank(pair, never) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            at = ranks.index(best)
            new = ids[at] = made[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], new), never)
            if at < len(ranks):
                ranks[at] = rank((new, ids[at + 1]), never)
        return ids

    def push(self, data: bytes) -> Iterator[int]:
        view = memoryview(data)
        while view:
            room = self.capacity - len(self._held)
            self._held += view[:room]
            view = view[room:]
            if len(self._held) < self.capacity:
                return
            done, stable = 0, len(self._held) - self.lookahead
            for token in self._encode(bytes(self._held)):
                if done + self._length[token] > stable:
                    break
                done += self._length[token]
                yield token
            if not done:  # cannot be: there is room for the longest token
                raise AssertionError("no token is stable within the sufficient lookahead")
            del self._held[:done]

    def finish(self) -> list[int]:
        ids = self._encode(bytes(self._held))
        self._held.clear()
        return ids

    def word(self, word: str) -> list[int]:
        data = word.encode()
        if len(data) < self.capacity:  # all of it is held until it ends
            return self._encode(data)
        return [*self.push(data), *self.finish()]


class StreamEncoder:
    """Blocks of a text in, ids out, four bytes each."""

    def __init__(self, bpe: ByteBPE):
        self._bpe = bpe
        self.transducer = Transducer(bpe.merges, bpe.ids)
        self._words = Words(self.transducer.word)
        #: Code points behind a boundary that can still change it.
        self._margin = bpe.longest_special + 2
        self._runs = [
            regex.compile(p)
            for p in (r"\p{L}+", r"\p{N}+", rf"[^{_SPACE}\p{{L}}\p{{N}}]+", rf"[{_SPACE}]+")
        ]
        self._white = self._runs[3]

    def encode(self, blocks: Iterable[str]) -> Iterator[bytes]:
        rest, run, waiting = "", None, None
        for block in blocks:
            if waiting is not None:
                rest, run, out = self._advance(rest + waiting, run, last=False)
                yield out
            waiting = block
        yield self._advance(rest + (waiting or ""), run, last=True)[2]

    def _advance(self, text: str, run, last: bool):
        """What is certain in a text: (rest, the run that goes on, ids)."""
        out: list[bytes] = []
        if run is not None:
            text, run, more = self._go_on(text, run, last)
            out.append(more)
            if run is not None:
                return text, run, b"".join(out)
        certain = len(text) if last else len(text) - self._margin
        at = 0
        for start, part, special in self._bpe.segments(text):
            if special is not None:
                if start + len(part) > certain:
                    break
                out.append(special.to_bytes(ID_BYTES, "little"))
                at = start + len(part)
                continue
            words = self._bpe.split(part)
            end = start + len(part)
            if end <= certain:
                out.extend(map(self._words.__getitem__, words))
                at = end
                continue
            at = start
            for word in words:
                if at + len(word) > certain:
                    break
                out.append(self._words[word])
                at += len(word)
            break
        rest = text[at:]
        if len(rest) > BLOCK:  # one word, longer than a block
            lead = 1 if rest[0] == " " and not self._white.match(rest[1]) else 0
            run = next(p for p in self._runs if p.match(rest, lead))
            cut = len(rest) - self._margin
            out.append(self._ids(self.transducer.push(rest[:cut].encode())))
            rest = rest[cut:]
        return rest, run, b"".join(out)

    def _go_on(self, text: str, run, last: bool):
        """The same for a text that begins inside a run."""
        found = run.match(text)
        end = found.end() if found else 0
        special = self._bpe._special and self._bpe._special.search(text)
        if special and special.start() <= end:
            end, closes = special.start(), True
        else:
            closes = last and end == len(text)
        certain = len(text) if last else len(text) - self._margin
        if end > certain or (end == len(text) and not last):
            cut = max(0, certain)
            return text[cut:], run, self._ids(self.transducer.push(text[:cut].encode()))
        if run is self._white and not closes:
            end = max(0, end - 1)  # the last one goes to the word that follows
        ids = self._ids(self.transducer.push(text[:end].encode()))
        return text[end:], None, ids + self._ids(self.transducer.finish())

    @staticmethod
    def _ids(ids: Iterable[int]) -> bytes:
        return b"".join(i.to_bytes(ID_BYTES, "little") for i in ids)


class StreamDecoder:
    """Ids in, text out: an incremental byte-to-text state machine."""

    def __init__(self, bpe: ByteBPE):
        self._bytes = bpe.token_bytes
        self._text = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self._text.decode(b"".join(map(self._bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self._text.decode(b"", True)


@lru_cache(maxsize=2)
def _encoder(path: str) -> StreamEncoder:
    return StreamEncoder(opened(path))


def encode_text(text: str, encoder: StreamEncoder, block: int = BLOCK) -> bytes:
    return b"".join(encoder.encode(text[i : i + block] for i in range(0, len(text), block)))


def decode_ids(ids: bytes, bpe: ByteBPE, block: int = BLOCK) -> str:
    decoder, view = StreamDecoder(bpe), memoryview(ids).cast("I")
    parts = [decoder.push(view[i : i + block]) for i in range(0, len(view), block)]
    return "".join([*parts, decoder.finish()])


def encode(
    docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", keep=None
) -> DataFrame:
    """A binary column of ids, little-endian unsigned 32-bit integers, beside the columns."""

    def start():
        path = resolved(tokenizer)
        opened(path)  # its worker keeps it for the next task
        encoder = _encoder(path)
        return lambda value: (encode_text(value or "", encoder),)

    return add_columns(docs, [text], T.StructType([T.StructField(ids, T.BinaryType())]), start, keep)


def decode(
    df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded", keep=None
) -> DataFrame:
    """A column with the text of a column of ids, as ``encode`` gives them."""

    def start():
        bpe = opened(resolved(tokenizer))
        return lambda value: (decode_ids(value or b"", bpe),)

    return add_columns(df, [ids], T.StructType([T.StructField(text, T.StringType())]), start, keep)
