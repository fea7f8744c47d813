"""Token ids of whole texts by a public byte-level vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

END_TEXT = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(folder: str | None):
    """ids(text) -> array of unsigned 32-bit ids, as `tokenizers` gives them without special tokens added.

    The same vocabulary through `tiktoken` gives the same ids five times as
    fast.  A text with the string of the special token, and one that the faster
    library cannot take, goes through `tokenizers` itself.
    """
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    where = (lambda name: f"{folder}/{name}") if folder else public.path
    with open(where("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []

    def ids(text: str) -> np.ndarray:
        if END_TEXT not in text:
            try:
                return np.array(fast.encode_ordinary(text), np.uint32)
            except BaseException as error:  # the library reports a failed pattern as a panic
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if not exact:
            exact.append(Tokenizer.from_file(where("byte_bpe_50k.json")))
        return np.array(exact[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return ids
