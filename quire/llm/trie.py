"""Operator 6: token counts under a unigram vocabulary, by dynamic programming shared over a trie of pre-tokens.

The best segmentation of a word needs, for each of its prefixes, the best score of that prefix; words that share a prefix share those
scores.  The distinct words of an Arrow piece are taken in sorted order, which is a walk over their trie: going to the next word
keeps the scores up to the common prefix and computes only the nodes below it, so each node is computed once and only the
current path is held.  A word's end is a terminal with its token count and score; texts then sum the terminals of their words.

A word is a run of characters other than white space, with the vocabulary's word mark before it; a character outside the
vocabulary counts as its bytes.  Of segmentations with equal scores the one with fewer tokens counts.

Defined results: null, empty and blank texts have no words, no tokens and score 0; words of any length are exact (a node looks back at most
as far as the longest token).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import col, others, pieces, schema_with, worker_cache

MARK = "▁"


def read_vocabulary(path: str) -> tuple[dict[str, float], float]:
    """Log probability of each piece of a sentencepiece model, and of a byte.

    The model's scores order its pieces; by Zipf's law the piece of rank r has probability 1 / (r + 1) before scaling to one, and a byte
    that of the rank after the last.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    own.sort(key=lambda i: (-model.get_score(i), i))
    scale = math.log(sum(1 / (r + 1) for r in range(len(own) + 256)))
    return {model.id_to_piece(i): -math.log(r + 1) - scale for r, i in enumerate(own)}, -math.log(len(own) + 1) - scale


class Walk:
    """Scores along the current path of the trie."""

    def __init__(self, vocabulary: dict[str, float], byte_score: float):
        self.score, self.byte = vocabulary, byte_score
        lengths = {}
        for piece in vocabulary:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(ls) for c, ls in lengths.items()}  # lengths of the tokens that end in a character
        self.path, self.best = "", [(0.0, 0)]
        self.nodes = 0

    def to(self, word: str) -> tuple[int, float]:
        """Go to a word's node: its tokens and score.  The best of a node is (score, minus tokens), compared in that order."""
        path, best, score, lengths = self.path, self.best, self.score, self.lengths
        k, most = 0, min(len(path), len(word))
        while k < most and path[k] == word[k]:
            k += 1
        del best[k + 1:]
        for i in range(k, len(word)):
            s, n = best[i]
            width = len(word[i].encode("utf-8", "replace"))
            top = (s + width * self.byte, n - width)
            for size in lengths.get(word[i], ()):
                if size > i + 1:
                    break
                piece = score.get(word[i + 1 - size: i + 1])
                if piece is not None:
                    s, n = best[i + 1 - size]
                    here = (s + piece, n - 1)
                    if here > top:
                        top = here
            best.append(top)
            self.nodes += 1
        self.path = word
        s, n = best[len(word)]
        return -n, s


def token_counts(docs: DataFrame, path: str, *, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``n_words``, ``n_tokens`` and ``score`` (sum of the best scores of its words) to each row.  The driver reads the model at ``path``."""
    vocabulary, byte_score = read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, byte_score))  # of fixed size
    new = {"n_words": "long", "n_tokens": "long", "score": "double"}
    src = docs.select(*others(docs, [*new, "__text"], drop), col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            lists = pc.ascii_split_whitespace(pc.fill_null(batch.column("__text"), ""))
            flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
            doc = np.repeat(np.arange(len(sizes)), sizes)[real]
            coded = flat.filter(pa.array(real)).dictionary_encode()
            words = coded.dictionary.to_pylist()
            walk, order = worker_cache(("walk", path), lambda: Walk(*shared.value)), sorted(range(len(words)), key=words.__getitem__)
            ends = np.zeros((len(words), 2))
            for w in order:
                ends[w] = walk.to(MARK + words[w])
            index, n = coded.indices.to_numpy(zero_copy_only=False), batch.num_rows
            total = [np.bincount(doc, ends[index, k] if len(index) else None, minlength=n) for k in (0, 1)]
            names = [c for c in batch.schema.names if c != "__text"]
            cols = [pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(total[0].astype(np.int64)), pa.array(total[1].astype(float))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], [*names, *new])

    return src.mapInArrow(run, schema_with(src.drop("__text"), **new))


def counts(docs: DataFrame, path: str) -> DataFrame:
    """Words, tokens and mean score per token of every document."""
    d = token_counts(docs.select("doc_id", "text"), path, drop=("text",))
    return d.select("doc_id", "n_words", "n_tokens", F.when(F.col("n_tokens") > 0, F.round(F.col("score") / F.col("n_tokens"), 6)).otherwise(0.0).alias("mean_score"))
