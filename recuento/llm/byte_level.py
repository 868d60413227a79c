"""What both token operators need to know of a byte-level BPE file."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from recuento.llm.common import CHUNKS, SPACES, quoted


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte, and the byte.

    Bytes that print as themselves keep their character; the others take the
    code points from 256 upwards in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@dataclass(frozen=True)
class ByteLevel:
    """The parts of a tokenizer file: its JSON, pieces by id, merge ranks, added strings."""

    source: str
    pieces: dict[int, bytes]
    ranks: dict[tuple[str, str], int]
    added: tuple[str, ...]


def load(path: str) -> ByteLevel:
    """Read a tokenizer file of the kind this module handles, or raise ``ValueError``."""
    with open(path, encoding="utf-8") as file:
        source = file.read()
    spec = json.loads(source)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    known = (
        model["type"] == "BPE"
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not model.get("ignore_merges")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )
    if not known:
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    alphabet = byte_alphabet()
    pieces = {i: bytes(alphabet[c] for c in piece) for piece, i in model["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
    ranks = {pair: rank for rank, pair in enumerate(pairs)}
    return ByteLevel(source, pieces, ranks, tuple(t["content"] for t in spec["added_tokens"]))


#: Characters whose class (letter, digit, other) no version of Unicode changes.
_LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_PLAIN = re.compile(f"[ -~{_LETTERS}]+").fullmatch

#: The parts of a plain chunk within which symbols are merged.
plain_parts = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ 0-9{_LETTERS}]+| +").findall


def is_plain(chunk: str) -> bool:
    """Whether ``plain_parts`` cuts a chunk as the library does: plain characters with one space before them at most."""
    return _PLAIN(chunk) is not None and not chunk.startswith("  ")


def chunker(added: tuple[str, ...]):
    """A function from a text to its chunks, whose tokens never depend on each other.

    No token crosses a border between a non-space and a space, so runs can be
    encoded one by one. Added strings are cut out first, as the library does;
    each comes out as a chunk of its own.
    """
    chunks = re.compile(CHUNKS).findall
    if not added:
        return chunks
    cut = re.compile("(" + "|".join(map(quoted, sorted(added, key=len, reverse=True))) + ")").split

    def split(text: str) -> list[str]:
        if not any(a in text for a in added):
            return chunks(text)
        out: list[str] = []
        for i, part in enumerate(cut(text)):
            out += [part] if i % 2 else chunks(part)
        return out

    return split
