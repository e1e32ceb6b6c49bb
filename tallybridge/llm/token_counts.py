"""Token counts of whole texts, by overlap resynchronisation.

A text longer than a chunk is encoded in overlapping chunks, each with the offsets of its
words. Two neighbours are spliced at a word boundary that both have and that is proven to be one
of the whole text; where the overlap holds none, it is widened until it does.

Why such a boundary is proven. Splitting into words has no memory: from a true boundary on, a
chunk is split as the whole text is, up to what its cut end may change. A word, a contraction or
a special string that the end cuts can only change boundaries within ``longest special string + 2``
code points of that end. So, from its own splice point on, all boundaries of the left chunk that are
further from its end are true, and from a shared true boundary on the right chunk is right too.
Tokens never cross words.

Vocabularies other than byte-level BPE are handed to their library text by text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each;
other columns stay, and give way to an added column of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import add_columns
from .bpe import ID_BYTES, ByteBPE, opened, resolved

CHUNK = 1 << 16
OVERLAP = 1 << 9


def count_tokens_in(text: str, bpe: ByteBPE, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of one text."""
    if len(text) <= chunk + overlap:
        return len(bpe.encode(text)) // ID_BYTES
    margin = bpe.longest_special + 2

    def words(start: int, end: int) -> dict[int, int]:
        ends, counts = bpe.pieces(text[start:end])
        return dict(zip([start + e for e in ends], counts))

    total, spliced, start, end = 0, 0, 0, chunk + overlap
    left = words(start, end)
    while end < len(text):
        following, width = start + chunk, end - (start + chunk)
        following_end = min(len(text), max(end, following + chunk + overlap))
        right = words(following, following_end)
        while True:
            proven = end if end == len(text) else end - margin
            shared = (e for e in left if spliced < e <= proven and e in right)
            splice = next(shared, None)
            if splice is not None or end == len(text):
                break
            width *= 2
            end = min(len(text), following + width)
            left = words(max(start, spliced), end)
            if end > following_end:
                following_end = min(len(text), end + chunk)
                right = words(following, following_end)
        if splice is None:
            break
        total += sum(n for e, n in left.items() if spliced < e <= splice)
        left, spliced, start, end = right, splice, following, following_end
    return total + sum(n for e, n in left.items() if e > spliced)


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[str], int]:
    """A function that counts as the file's library does, without added special tokens."""
    if path.endswith(".model"):
        return lambda text: len(_pieces(path).encode(text))
    try:
        bpe = opened(path)
    except ValueError:
        tokenizer = _library(path)
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    return lambda text: count_tokens_in(text, bpe, chunk, overlap)


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 1024,
    text: str = "text",
    keep: list[str] | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` beside the columns of ``docs``.

    ``tokenizer`` is a path, or the name of a public file, which each executor looks up itself.
    """

    def start():
        count = counter(resolved(tokenizer), chunk, overlap)
        return lambda value: (len((value or "").encode()), count(value or ""))

    added = T.StructType(
        [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    return add_columns(docs, [text], added, start, keep).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
