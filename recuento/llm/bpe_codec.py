"""Byte-pair encoding and decoding through a table of distinct words.

Tasks split their texts into words and keep a table of the distinct ones: each
is encoded once, and the words of a text take their identifiers back by
position. The table is kept per task and bounded: one table for the whole corpus
means moving every word of every block of documents there and back, over four
times the input. ``encode_decode`` decodes in the same task through the list of
pieces; ``decode`` joins rows that hold only identifiers with the table of pieces.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recuento.llm.byte_level import ByteLevel, byte_alphabet, chunker, is_plain, load, plain_parts
from recuento.llm.common import text_of

TABLE_WORDS = 400_000
"""A task's table holds about so many words; a full one is started anew. Results don't depend on it."""

SLICE_TEXTS = 200
"""So many texts are split before their new words are encoded together."""

LONG_WORD = 200
"""Longer words are encoded where they occur and not kept."""


def merge_order(file: ByteLevel) -> dict[bytes, int] | None:
    """The pieces in the order in which merges make them, single bytes first, if that order alone decides every encoding.

    A merge by pieces joins two neighbours whenever their bytes are a piece, the
    file's only if the pair is listed. Both agree if each pair makes another
    piece and the bytes of each piece, merged alone, become that piece: then no
    other pair with these bytes is ever left. Otherwise None.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(file.source).model
    alphabet = byte_alphabet()
    names = [*alphabet, *(left + right for left, right in sorted(file.ranks, key=file.ranks.__getitem__))]
    whole = all([token.value for token in model.tokenize(name)] == [name] for name in names)
    order = {bytes(map(alphabet.__getitem__, name)): place for place, name in enumerate(names)}
    return order if whole and len(order) == len(names) else None


class WordTable:
    """Distinct words and their identifiers, as little-endian 32-bit numbers.

    ``order`` comes from ``merge_order``. With it, words of plain characters are
    cut into parts here and merged part by part; all other words, and all words
    of a file without such an order, take the library's call.
    """

    def __init__(self, file: ByteLevel, order: dict[bytes, int] | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = chunker(file.added)
        self.added = {word: self._alone(word) for word in file.added}
        self.ids: dict[str, bytes] = dict(self.added)
        self.merge = None
        if order:
            import tiktoken

            number = {piece: i for i, piece in file.pieces.items()}
            self.numbers = np.array([number[piece] for piece in order], "<u4")
            self.merge = tiktoken.Encoding("parts", pat_str="(?s:.+)", mergeable_ranks=order, special_tokens={}).encode_ordinary

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        plain = [word for word in new if self.merge and is_plain(word)]
        self.ids.update((word, self._alone(word)) for word in new.difference(plain))
        merge, places, ends = self.merge, [], [0]
        for word in plain:
            for part in plain_parts(word):
                places += merge(part)
            ends.append(len(places) * 4)
        coded = self.numbers[places].tobytes() if plain else b""
        self.ids.update(zip(plain, [coded[i:j] for i, j in zip(ends, ends[1:])], strict=True))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The identifiers of each text in turn."""
        for start in range(0, len(texts), SLICE_TEXTS):
            if len(self.ids) >= TABLE_WORDS:
                self.ids = dict(self.added)
            words = [self.split(text) for text in texts[start : start + SLICE_TEXTS]]
            new = set().union(*words).difference(self.ids)
            self._learn(new)
            for places in words:
                yield np.frombuffer(b"".join(map(self.ids.__getitem__, places)), "<u4")
            for word in new:
                if len(word) > LONG_WORD:
                    del self.ids[word]


def joined_pieces(ids: np.ndarray, pieces: list[bytes]) -> str:
    """The text of a list of identifiers; bytes that are not UTF-8 become replacement characters."""
    return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def piece_list(file: ByteLevel) -> list[bytes]:
    return [file.pieces.get(i, b"") for i in range(max(file.pieces) + 1)]


def _coded(
    docs: DataFrame, path: str, doc_id: str, text: str, columns: Callable[[Iterable[tuple[np.ndarray, str]]], dict], out: str
) -> DataFrame:
    file = load(path)
    spec = docs.sparkSession.sparkContext.broadcast((file, merge_order(file)))

    @F.pandas_udf(f"struct<{out}>")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        file, order = spec.value
        table, pieces = WordTable(file, order), piece_list(file)
        for batch in batches:
            for start in range(0, len(batch), SLICE_TEXTS):
                encoded = table.encode(batch.iloc[start : start + SLICE_TEXTS].tolist())
                yield pd.DataFrame(columns((ids, joined_pieces(ids, pieces)) for ids in encoded))

    return docs.select(F.col(doc_id).alias("doc_id"), coded(text_of(text)).alias("c")).select("doc_id", "c.*")


def encode_decode(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: the identifiers of each whole text and the text they decode to.

    The identifiers are the library's for the file at ``tokenizer_path``
    without added begin or end tokens; added strings inside a text become their
    own identifier, and decoding keeps them. NULL and empty texts give an empty
    list and an empty text. One row out for each row in, also for NULL and
    repeated ``doc_id``. Other columns are not carried, whatever their names.
    """

    def whole(results: Iterable[tuple[np.ndarray, str]]) -> dict:
        pairs = [(ids.astype("int32"), decoded) for ids, decoded in results]
        return {"ids": [p[0] for p in pairs], "decoded": [p[1] for p in pairs]}

    return _coded(docs, tokenizer_path, doc_id, text, whole, "ids:array<int>,decoded:string")


def encode_decode_digests(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_decode``, with ``n_tokens, ids_sha256, decoded_sha256`` in place of the sequences."""

    def digests(results: Iterable[tuple[np.ndarray, str]]) -> dict:
        rows = [
            (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            for ids, decoded in results
        ]
        names = ("n_tokens", "ids_sha256", "decoded_sha256")
        return {name: [row[i] for row in rows] for i, name in enumerate(names)}

    return _coded(docs, tokenizer_path, doc_id, text, digests, "n_tokens:bigint,ids_sha256:string,decoded_sha256:string")


def piece_table(df: DataFrame, file: ByteLevel) -> DataFrame:
    """``id, piece``: the bytes of every identifier; as many rows as the vocabulary has."""
    rows = [(i, bytearray(piece)) for i, piece in sorted(file.pieces.items())]
    return df.sparkSession.createDataFrame(rows, "id int, piece binary")


def decode(encoded: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of rows with an array of identifiers, by a join with the table of pieces.

    Rows are told apart by ``doc_id``, which must be unique and not NULL. A NULL
    or empty array decodes to the empty text; an unknown identifier adds nothing.
    """
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(F.col(ids).cast("array<int>")).alias("pos", "id"))
    with_pieces = rows.join(piece_table(encoded, load(tokenizer_path)), "id", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("piece"))))
    whole = F.unhex(F.concat_ws("", F.transform(parts, lambda p: p["piece"])))
    return with_pieces.groupBy("doc_id").agg(F.decode(whole, "UTF-8").alias("decoded"))
