"""Byte-level BPE in batched numpy merge rounds, and its decoding.

The symbols of many words lie in one flat array.  In each round every word
merges its pair of lowest rank, all words at once; a pair's rank is found by
binary search over the sorted pair keys.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, parts, short_batches

#: Chunks that a worker remembers: those it sees first, frequent ones among them.
KNOWN_CHUNKS = 300_000
#: Characters of text that are split into chunks at once.
BLOCK = 1 << 20

# The public byte-level pre-token pattern, and Unicode's White_Space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder of a byte-level BPE vocabulary in the tokenizers library's JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab, letters = made["model"]["vocab"], byte_letters()
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.byte_ids = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in made["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {
            i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
            for t, i in [*vocab.items(), *self.added.items()]
        }
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pre_token = regex.compile(PRE_TOKEN.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]").replace(f"[^[{WHITE}]", f"[^{WHITE}"))
        # Runs between white space, each with the one space before it; no pre-token crosses their edges.
        self.chunk = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (a pre-token's bytes)."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        if not words:
            return []
        rank = np.full(len(symbol), NONE)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = lowest == NONE
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
                symbol, word, rank, lowest = (x[~over] for x in (symbol, word, rank, lowest))
                if not len(symbol):
                    break
            merge = np.flatnonzero(rank == lowest)
            # Of pairs that overlap (a a a), the first, third, ... are merged.
            first = np.concatenate([[True], (np.diff(merge) > 1) | (np.diff(word[merge]) > 0)])
            run = np.maximum.accumulate(np.where(first, np.arange(len(merge)), 0))
            merge = merge[(np.arange(len(merge)) - run) % 2 == 0]
            symbol[merge] = self.merged[rank[merge]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[merge + 1] = False
            at = merge - np.arange(len(merge))  # of the merged symbols, once the others are gone
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            touched = np.zeros(len(symbol), dtype=bool)
            touched[at] = touched[at[at > 0] - 1] = True
            changed = np.flatnonzero(touched)
            rank[changed] = NONE
            changed = changed[changed < len(symbol) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self.rank(symbol[changed], symbol[changed + 1])
        symbol = np.concatenate([np.zeros(0, np.int64), *done_symbol])
        word = np.concatenate([np.zeros(0, np.int64), *done_word])
        order = np.argsort(word, kind="stable")
        flat, ends = symbol[order].tolist(), np.searchsorted(word[order], np.arange(len(words)), side="right").tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The chunks and added tokens of ``text`` in order, a bounded list at a time."""
        for part in self.split_added.split(text) if self.split_added else [text]:
            if part in self.added:
                yield [part]
            elif len(part) <= BLOCK:
                yield self.chunk.findall(part)
            else:
                found = []
                for m in self.chunk.finditer(part):
                    found.append(m[0])
                    if len(found) >= BLOCK // 4:
                        yield found
                        found = []
                yield found

    def learn(self, chunks: set[str]) -> None:
        """Know each chunk's ids as decimal text, their number, and what they decode to."""
        names = list(chunks)
        split = [[] if c in self.added else self.pre_token.findall(c) for c in names]
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        for c, ws in zip(names, split, strict=True):
            own = [self.added[c]] if c in self.added else ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]
            self.known[c] = (",".join(map(str, own)), len(own), self.decode_bytes(own))

    def blocks(self, text: str) -> Iterator[list[tuple[str, int, bytes]]]:
        for found in self.chunks(text):
            new = set(found).difference(self.known)
            self.learn(new)
            yield list(map(self.known.__getitem__, found))
            self.forget(new)

    def forget(self, new: set[str]) -> None:
        if len(self.known) > KNOWN_CHUNKS:
            for c in new:
                del self.known[c]

    def encode(self, text: str) -> list[int]:
        return [int(i) for block in self.blocks(text) for ids, _, _ in block for i in ids.split(",") if i]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for block in self.blocks(text):
            if not block:
                continue
            ids.update(((n > 0) * "," + ",".join([x[0] for x in block])).encode())
            n += sum([x[1] for x in block])
            decoded.update(b"".join([x[2] for x in block]).decode("utf-8", "replace").encode())
        return n, ids.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every whole text; null counts as empty.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas)
    and decoded_sha256 (of the decoded text), a row per row of ``docs``, null
    and repeated doc_ids included.  Very long texts are encoded whole, a block
    of chunks at a time; an empty table gives no rows.  Other columns are not read.
    """

    @lean("bpe", byte_bpe.cache_clear)
    def run(batches):
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            for part in parts(batch, 1, 128):
                texts = part.column(1).to_pylist()
                # All new chunks of a part in one batch of merge rounds.
                new = set()
                for t in texts:
                    if len(t) <= BLOCK:
                        new.update(*bpe.chunks(t))
                bpe.learn(new := new.difference(bpe.known))
                n, ids, decoded = zip(*map(bpe.digest, texts), strict=True)
                bpe.forget(new)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
