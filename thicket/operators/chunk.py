"""Chunks of texts as rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import CLAUSE, SENTENCE, counted_chunks

_SENTENCE, _CLAUSE = re.compile(SENTENCE), re.compile(CLAUSE)


def chunks(docs: DataFrame, max_tokens: int = 100, overlap: int = 0, encode: Callable[[str], object] | None = None) -> DataFrame:
    """(tree_id, chunk_index, text, n_tokens) for docs(tree_id, text), chunk_index in order of emission.

    The default tokenizer stays in the JVM; with ``encode``, any object of a
    length for a text, chunks are cut in Arrow batches by Python workers.
    """
    if encode is None:
        out = docs.select("tree_id", F.posexplode(counted_chunks(F.col("text"), max_tokens, overlap)).alias("chunk_index", "c"))
        return out.select("tree_id", "chunk_index", "c.text", "c.n_tokens")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(t, i, c, len(encode(c))) for t, text in zip(f.tree_id, f.text, strict=True) for i, c in enumerate(split(text, max_tokens, overlap, encode))]
            yield pd.DataFrame(rows, columns=["tree_id", "chunk_index", "text", "n_tokens"])

    return docs.select(F.col("tree_id").cast("long").alias("tree_id"), "text").mapInPandas(run, "tree_id long, chunk_index int, text string, n_tokens int")


def word_chunks(docs: DataFrame, max_tokens: int = 100) -> DataFrame:
    """What chunks() gives without overlap for the default tokenizer, cut by Python workers: a fold over columns costs some ten times as much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [word_split(t, max_tokens) for t in b.column("text").to_pylist()]
            n = np.fromiter(map(len, cut), np.int64, len(cut))
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            said = [c for cs in cut for c in cs]
            texts, tokens = pa.array([t for t, _ in said], pa.string()), pa.array([c for _, c in said], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("tree_id").take(pa.array(np.repeat(np.arange(len(cut)), n))), pa.array(at.astype(np.int32)), texts, tokens], names=["tree_id", "chunk_index", "text", "n_tokens"])

    return docs.select(F.col("tree_id").cast("long").alias("tree_id"), "text").mapInArrow(run, "tree_id long, chunk_index int, text string, n_tokens int")


def word_split(text: str | None, max_tokens: int) -> list[tuple[str, int]]:
    """split() with runs of non-blanks for tokens and no overlap, with the chunks' numbers of tokens."""
    out: list[tuple[str, int]] = []

    def pack(pieces: list[str], alone: bool) -> None:
        held: list[str] = []
        spent = 0
        for p in pieces:
            c = len(p.split())
            if not c:
                continue
            if alone and c > max_tokens:
                pack([x for x in map(str.strip, _CLAUSE.split(p)) if x], False)
                continue
            if held and spent + c > max_tokens:
                out.append((" ".join(held), spent))
                held, spent = [], 0
            held.append(p)
            spent += c
        if held:
            out.append((" ".join(held), spent))

    pack(_SENTENCE.split(text or ""), True)
    return out


def split(text: str | None, max_tokens: int, overlap: int, encode: Callable[[str], object]) -> list[str]:
    """The same cut in Python, for tokenizers that only Python has; tokens of a piece are counted with a space before it."""
    import re

    size = lambda s: len(encode(" " + s))

    def pack(pieces: list[str], alone: bool) -> list[str]:
        out: list[str] = []
        held: list[tuple[str, int]] = []
        for p in pieces:
            c = size(p)
            if alone and c > max_tokens:
                out += pack([x for x in map(str.strip, re.split("[,;:]", p)) if x], False)
                continue
            if held and sum(n for _, n in held) + c > max_tokens:
                out.append(" ".join(x for x, _ in held))
                held = held[-overlap:] if overlap else []
            held.append((p, c))
        return out + [" ".join(x for x, _ in held)] * bool(held)

    return pack([s for s in re.split("[.!?\n]", text or "") if s.strip()], True)
