"""A public byte-level BPE: its files, its word splitter, and ids of distinct words."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import regex

#: Folder of the public vocabulary files, the same on every node; a parameter of every operator here.
VOCABULARIES = "/opt/tokenizers"

#: Fixed value: the public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A worker forgets its word cache at this many distinct words, so its memory stays bounded.
CACHE_WORDS = 1_000_000


def splitter() -> regex.Pattern:
    return regex.compile(PATTERN)


@lru_cache(2)
def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in JSON vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def load_merges(folder: str, name: str = "byte_bpe_50k.json") -> tuple[np.ndarray, np.ndarray]:
    """(id of each byte, merges as rows left id, right id, rank, merged id)."""
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    bytes_ = np.zeros(256, np.int32)
    for ch, b in byte_names().items():
        bytes_[b] = vocab[ch]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return bytes_, np.array([(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(pairs)], np.int32)


@lru_cache(2)
def token_bytes(folder: str, name: str = "byte_bpe_50k.tiktoken") -> list[bytes]:
    """The bytes of each id."""
    with open(os.path.join(folder, name), "rb") as f:
        ranks = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in ranks) + 1)
    for token, rank in ranks:
        out[int(rank)] = base64.b64decode(token)
    return out


@lru_cache(2)
def encoding(folder: str, name: str = "byte_bpe_50k.tiktoken"):
    """The same vocabulary in the public Rust encoder, for operators that only need sizes."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def clean(text: str) -> str:
    """Lone surrogates cannot be written as UTF-8; each becomes a question mark."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()
