"""Token counts by merging byte pairs, without making identifiers."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recuento.llm.byte_level import chunker, is_plain, load, plain_parts
from recuento.llm.common import text_of

MEMO_WORDS = 1_000_000
"""Counts of so many words are kept by a worker; a full memo is emptied. Results don't depend on it."""


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no adjacent pair has a rank.

    The symbols form a linked list. A heap gives the place of the pair of the
    lowest rank, the leftmost first; an entry whose pair has changed since is
    passed over.
    """
    n = len(symbols)
    rank = ranks.get
    current = [rank(pair, -1) for pair in zip(symbols, symbols[1:])] + [-1]
    heap = [r * n + i for i, r in enumerate(current) if r >= 0]
    if not heap:
        return n
    heapq.heapify(heap)
    symbol, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        if current[i] != r:
            continue
        merges += 1
        j = after[i]
        k = after[i] = after[j]
        symbol[i] += symbol[j]
        current[i] = current[j] = -1
        if k < n:
            before[k] = i
            current[i] = r = rank((symbol[i], symbol[k]), -1)
            if r >= 0:
                heapq.heappush(heap, r * n + i)
        h = before[i]
        if h >= 0:
            current[h] = r = rank((symbol[h], symbol[i]), -1)
            if r >= 0:
                heapq.heappush(heap, r * n + h)
    return n - merges


class WordCounts(dict):
    """Tokens of a chunk of text, worked out on first use."""

    def __init__(self, source: str, ranks: dict[tuple[str, str], int], added: tuple[str, ...]) -> None:
        from tokenizers import Tokenizer

        from recuento.llm.byte_level import byte_alphabet

        super().__init__((word, 1) for word in added)
        self.ranks, self.added = ranks, added
        self.split = Tokenizer.from_str(source).pre_tokenizer.pre_tokenize_str
        shown = {b: c for c, b in byte_alphabet().items()}
        self.alphabet = [shown[b] for b in range(256)]
        self.parts: dict[str, int] = {}

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
            self.update((word, 1) for word in self.added)
        if len(self.parts) >= MEMO_WORDS:
            self.parts.clear()
        if is_plain(chunk):
            total = 0
            for part in plain_parts(chunk):
                n = self.parts.get(part)
                if n is None:
                    shown = self.alphabet
                    n = self.parts[part] = merged_length([shown[b] for b in part.encode()], self.ranks)
                total += n
        else:
            total = sum(merged_length(list(part), self.ranks) for part, _ in self.split(chunk))
        if len(chunk) <= 200:
            self[chunk] = total
        return total


def count_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of each whole text: ``doc_id, n_bytes, n_tokens``.

    Counts equal the library's for the file at ``tokenizer_path`` without added
    begin or end tokens; an added string inside a text is one token. Texts are
    cut into words, and the count of a word is the number of its bytes minus the
    merges made. There is no shuffle: each task keeps a bounded memo of words.

    NULL or empty text: 0 and 0. Any ``doc_id`` (NULL, repeated) keeps its row,
    one row out for each row in. Other columns are not carried, whatever their
    names. An empty table gives an empty table.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        file = spec.value
        words, split = WordCounts(file.source, file.ranks, file.added), chunker(file.added)
        count = words.__getitem__
        for batch in batches:
            yield pd.Series([sum(map(count, split(t))) for t in batch], dtype="int64")

    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(text_of(text)).cast("long").alias("n_bytes"),
        counted(text_of(text)).alias("n_tokens"),
    )
