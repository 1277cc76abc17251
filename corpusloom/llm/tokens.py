"""Token ids by the tokenizers library, white-space chunk by chunk.

Chunks recur, so each worker keeps the ids of those it sees first, up to a
bound; frequent ones are among them.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Chunks that a worker remembers.
KNOWN_CHUNKS = 320_000


@lru_cache(maxsize=2)
def word_ids(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to arrays of little-endian unsigned 32-bit ids.

    For tokenizers that lower-case, and drop white space before the merges: a
    text's ids are those of its chunks between ASCII white space, in order.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known: dict[bytes, bytes] = {}

    def chunks(text: str) -> list[bytes]:
        data = text.encode()
        # The vocabulary is of lower case; only the added tokens' names are told apart by it.
        return (data if b"<|" in data else data.lower()).split()

    def encode(texts: list[str]) -> list[np.ndarray]:
        split = [chunks(t) for t in texts]
        new = set().union(*split).difference(known)
        # A single mark behind a letter is a pre-token of its own: those chunks are two known ones.
        marked = [w for w in new if w[-1] in b".," and w[-2:-1].islower()]
        new.difference_update(marked)
        new.update({w[:-1] for w in marked}.difference(known), {b".", b","}.difference(known))
        asked = list(new)
        found = tokenizer.encode_batch_fast([w.decode() for w in asked], add_special_tokens=False)
        known.update((w, array("I", e.ids).tobytes()) for w, e in zip(asked, found, strict=True))
        known.update((w, known[w[:-1]] + known[w[-1:]]) for w in marked)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u4") for words in split]
        if len(known) > KNOWN_CHUNKS:
            for w in (*new, *marked):
                del known[w]
        return out

    return encode
