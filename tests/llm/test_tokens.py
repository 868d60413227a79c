import json
import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recuento.llm import bpe_codec
from recuento.llm.byte_level import ByteLevel, byte_alphabet, chunker, load
from recuento.llm.token_counts import count_tokens, merged_length

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "",
    None,
    "a  <|endoftext|>  b",
    "<|endoftext|><|endoftext|> \n<|endoftext|>",
    "  ",
    "\n\n b",
    "don't I'll can'T it's' 's  's a 's !'s",
    "über  straße x　　y z",
    "日本語テキスト 123abc 4½ ²",
    "a\x1cb \x1c c\x85d",
    "   lead",
    "tail   ",
    "a\t b\r\nc",
    "́a é ǅ ƻǀ \u0000 \x7f 😀",
    "x" * 5000 + " " + "ab" * 3000,
    "one two one two",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture
def docs(spark):
    """Two rows share an id, one has none, other columns have the names of results."""
    rows = [(None if i == 4 else min(i, 14), t, 7, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")


def test_counts_are_the_library_s(docs, library):
    found = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs, PATH).collect() if r.doc_id is not None)
    wanted = sorted(
        (False, min(i, 14), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for i, t in enumerate(TEXTS)
        if i != 4
    )
    assert found == wanted


def test_round_trip(docs, library):
    rows = bpe_codec.encode_decode(docs, PATH).collect()
    assert sorted(r.decoded for r in rows) == sorted(t or "" for t in TEXTS)
    assert all(list(r.ids) == library.encode(r.decoded, add_special_tokens=False).ids for r in rows)


def test_digests(docs, library):
    wanted = []
    for t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.encode_decode_digests(docs, PATH).collect()]
    assert sorted(found) == sorted(wanted)


def test_decode_by_join(spark, library):
    rows = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)] + [(99, None)]
    found = {r.doc_id: r.decoded for r in bpe_codec.decode(spark.createDataFrame(rows, "doc_id int, ids array<int>"), PATH).collect()}
    assert found == {i: t or "" for i, t in enumerate(TEXTS)} | {99: ""}


def test_a_full_table_of_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "TABLE_WORDS", 2)
    monkeypatch.setattr(bpe_codec, "SLICE_TEXTS", 1)
    file = load(PATH)
    table = bpe_codec.WordTable(file, bpe_codec.merge_order(file))
    texts = [t or "" for t in TEXTS] * 2
    assert [list(ids) for ids in table.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_merging_takes_the_lowest_rank_first():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2, ("x", "x"): 3}
    assert merged_length(list("abc"), ranks) == 1
    assert merged_length(list("xxxxx"), ranks) == 3
    assert merged_length([], ranks) == 0


def test_chunks_put_together_are_the_text():
    split = chunker(("<|endoftext|>",))
    assert all("".join(split(t)) == t for t in TEXTS if t)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert count_tokens(none, PATH).count() == bpe_codec.encode_decode(none, PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        load(public_tokenizers.path("word_bpe_49k.json"))


def test_order_of_merges_decides_only_where_every_piece_is_reached():
    file = load(PATH)
    order = bpe_codec.merge_order(file)
    assert order is not None and len(order) == len(file.pieces) - len(file.added)
    # "b c" is made before "a b", so no text is ever left with "ab" beside "c"
    source = json.loads(file.source)
    letters = {c: i for i, c in enumerate(byte_alphabet())}
    size = len(letters)
    source["model"]["vocab"] = letters | {"bc": size, "ab": size + 1, "abc": size + 2}
    source["model"]["merges"] = [["b", "c"], ["a", "b"], ["ab", "c"]]
    source["added_tokens"] = []
    pieces = {i: bytes([b]) for b, i in zip(byte_alphabet().values(), range(size))} | {size: b"bc", size + 1: b"ab", size + 2: b"abc"}
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("ab", "c"): 2}
    other = ByteLevel(json.dumps(source), pieces, ranks, ())
    assert bpe_codec.merge_order(other) is None
    table = bpe_codec.WordTable(other, None)
    assert [ids.tolist() for ids in table.encode(["abc", "ab", ""])] == [[letters["a"], size], [size + 1], []]
