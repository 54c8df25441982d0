"""Public vocabulary files as rank tables. The file's path is always a parameter; a table is bounded by the file."""

from __future__ import annotations

import base64
import functools


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str):
    """The token-byte table: a binary Arrow array indexed by token id."""
    import pyarrow as pa

    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        out[rank] = piece
    return pa.array(out, pa.large_binary())
