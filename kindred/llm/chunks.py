"""Token ids of a tokenizers .json vocabulary, with a memo for the chunks that texts consist of.

The ids are those of the tokenizers library; the merges of chunks that
aren't known yet are made by the tiktoken library from the same vocabulary
and pattern, which takes a third of the time for the same ids.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np

from kindred.llm.bpe import CHUNK, MAX_MEMO, MEMO_CHARS, PATTERN, load_ranks


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from texts to their ids as uint32 bytes.

    A byte-level BPE never joins what a run of white space and the word
    after it, a chunk, begins, so chunks can be encoded on their own.
    """
    import tiktoken

    with open(path, "rb") as f:
        added = json.load(f).get("added_tokens", ())
    if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that depend on what is around them")
    special = {x["content"]: pack("<I", x["id"]) for x in added if x["content"]}
    apart = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    encode = lib.encode_ordinary
    memo: dict[str, bytes] = {}

    def chunk_ids(chunk: str) -> bytes:
        got = memo.get(chunk)
        if got is None:
            found = encode(chunk)
            got = pack(f"<{len(found)}I", *found) if len(found) < 32 else np.array(found, dtype="<u4").tobytes()
            if len(chunk) <= MEMO_CHARS:
                if len(memo) >= MAX_MEMO:
                    memo.clear()
                memo[chunk] = got
        return got

    def plain(text: str) -> bytes:
        return b"".join(map(chunk_ids, CHUNK.findall(text)))

    def whole(text: str) -> bytes:
        """The added tokens' strings are found first; what is between them is encoded on its own."""
        if not any(s in text for s in special):
            return plain(text)
        return b"".join(special[x] if i % 2 else plain(x) for i, x in enumerate(apart.split(text)))

    def ids(texts: list[str]) -> list[bytes]:
        return list(map(whole, texts))

    return ids
