"""Operator 10: byte-level BPE encoding and decoding.

The ranks become a model of the ``tokenizers`` library: every token's bytes are written in the printable byte alphabet and
every way of joining two lower tokens into a token is a merge, in rank order, so the library merges as the ranks say.  Texts are
split by the pattern first; each distinct split goes through the library once per worker and its ids are kept (bounded).

Defined results: a null or empty text has no tokens; equal rows get equal ids; texts of any length are encoded whole, in
Arrow pieces of a few MB; an input column named like an output column gives way to it.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import col, others, pieces, schema_with, worker_cache

#: Distinct splits whose ids a worker keeps before it starts afresh, and bytes of text that it splits at once.
KEPT, PIECE = 150_000, 1 << 20


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte: itself where printable, else the next free character from U+0100."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in same else chr(next(free)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    return {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in data.splitlines() if line.strip()}


class Table:
    """Bytes of each token."""

    def __init__(self, data: bytes):
        self.ranks = read_ranks(data)
        self.token = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


class Codec(Table):
    """Model and kept ids of one rank file and pattern.  Ids are held as their four bytes, so a text's ids are a join of bytes."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        super().__init__(data)
        alphabet = byte_alphabet()
        shown = lambda b: "".join(alphabet[x] for x in b)
        merges = []
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                if self.ranks.get(token[:i], rank) < rank and self.ranks.get(token[i:], rank) < rank:
                    merges.append((shown(token[:i]), shown(token[i:])))
        self.model = Tokenizer(models.BPE(vocab={shown(t): r for t, r in self.ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern, self.split = pattern, regex.compile(pattern).findall
        self.width = np.array([len(t) for t in self.token] or [0], dtype=np.int64)
        self.ids: dict[str, bytes] = {}
        self.odd: set[str] = set()
        # characters that no version of Unicode known here has assigned: libraries may class them differently
        runs, start = [], None
        for c in range(sys.maxunicode + 2):
            free = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
            if free and start is None:
                start = c
            elif not free and start is not None:
                runs.append((start, c - 1))
                start = None
        self.unassigned = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]").search

    def exact(self, text: str) -> bytes:
        """Ids of a text with characters that libraries may class differently."""
        import tiktoken

        coder = worker_cache(("exact", id(self)), lambda: tiktoken.Encoding("exact", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}))
        return np.array(coder.encode_ordinary(text), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian."""
        split = [self.split(t) for t in texts]
        if len(self.ids) > KEPT:
            self.ids, self.odd = {}, set()
        new = list({p for ps in split for p in ps if p not in self.ids})
        for at in range(0, len(new), 4096):
            some = new[at: at + 4096]
            for p, e in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False)):
                self.ids[p] = np.array(e.ids, "<u4").tobytes()
        self.odd.update(p for p in new if not p.isascii() and self.unassigned(p))
        get = self.ids.__getitem__
        return [self.exact(t) if self.odd and not self.odd.isdisjoint(ps) else b"".join(map(get, ps)) for t, ps in zip(texts, split)]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each token; a token inside a character spans that character."""
        ends = np.cumsum(self.width[ids]) if len(ids) else np.zeros(0, np.int64)
        char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1  # character of each byte
        return (char[ends - self.width[ids]], char[ends - 1] + 1) if len(ids) else (ends, ends)


def _codec(data: bytes, pattern: str) -> Codec:
    return worker_cache(("bpe", hash(data), pattern), lambda: Codec(data, pattern))


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", drop: tuple[str, ...] = (), offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers as binary) to each row, and with ``offsets``
    the character span of each token (``starts``, ``ends``).  With ``decoded`` the same pass decodes the ids again and adds their bytes,
    which saves a second set of workers.  ``path`` is the rank file; the driver reads it."""
    with open(path, "rb") as f:
        data = f.read()
    new = ["n_tokens", "ids", *(["starts", "ends"] if offsets else []), *(["decoded"] if decoded else [])]
    src = docs.select(*others(docs, [*new, "__text"], drop), col(text).cast("string").alias("__text"))
    types = {"n_tokens": "long", "ids": "binary", "starts": "array<int>", "ends": "array<int>", "decoded": "binary"}
    kept = src.drop("__text")
    schema = schema_with(kept, **{n: types[n] for n in new})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, pattern)
        for batch in pieces(batches, "__text", PIECE):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            ids = codec.encode(texts)
            cols = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__text"]
            cols += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if offsets:
                spans = [codec.spans(t, np.frombuffer(x, "<u4")) for t, x in zip(texts, ids)]
                cols += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            if decoded:
                cols.append(pa.array([codec.decode(np.frombuffer(x, "<u4")) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [*(n for n in batch.schema.names if n != "__text"), *new])

    return src.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, *, ids: str = "ids", as_text: bool = False) -> DataFrame:
    """Add ``decoded``: the bytes of the ids, or with ``as_text`` their text, where bytes that are no whole character
    (ids cut inside one) become U+FFFD.  Null ids decode to nothing; an id without a token fails the task."""
    with open(path, "rb") as f:
        data = f.read()
    src = tokens.select(*others(tokens, ["decoded"]))
    schema = schema_with(src, decoded="string" if as_text else "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache(("tokens", hash(data)), lambda: Table(data))
        for batch in pieces(batches, ids, PIECE):
            out = [table.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(ids).to_pylist()]
            done = pa.array([b.decode("utf-8", "replace") for b in out], pa.string()) if as_text else pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, done], [*batch.schema.names, "decoded"])

    return src.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids and digest of what they decode to."""
    coded = encode(docs.select("doc_id", "text"), path, pattern, drop=("text",), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
