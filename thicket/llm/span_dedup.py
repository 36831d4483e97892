"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences of every text is hashed; runs met
more than once anywhere are joined globally; sentences that any run but the
first of its kind covers are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.scratch import drop, small_batches, stored, without
from thicket.llm.wordgrid import Texts, _powers, chunks, column, is_space, keyed, mix


@dataclass(frozen=True)
class Spans:
    """A span is a run of at least ``sentences`` sentences with at least ``words``
    words that is the shortest such from its first sentence on, or up to its last.  A sentence ends at a line break and behind one of
    ``marks`` before white space; clauses count as sentences, as a passage that
    is set into a running text shares its first and last sentence with that.
    one_in: where texts have no such ends, they can be cut behind one word in
    so many too, chosen by its hash."""

    sentences: int = 2
    words: int = 14
    marks: str = ".!?,;:"
    one_in: int | None = None


def sentences(t: Texts, how: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, first word, words, document) of each sentence with a word.  Bytes up to the next sentence's start belong to it, so sentences tile a text."""
    n = len(t.data)
    if not len(t.start):
        e = np.zeros(0, np.int64)
        return e, e, e, e
    end = np.zeros(256, bool)
    end[[ord(c) for c in how.marks]] = True
    blank = np.ones(n + 1, bool)
    blank[:n] = is_space(t.data)
    cuts = np.union1d(np.flatnonzero((t.data == 10) | (end[t.data] & blank[1:])) + 1, t.offsets[:-1])
    if how.one_in:
        cuts = np.union1d(cuts, t.end[keyed(t.word_hashes(), 21) % np.uint64(how.one_in) == 0])
    cuts = cuts[cuts < n]
    first = np.searchsorted(t.start, cuts)
    count = np.diff(np.append(first, len(t.start)))
    has = count > 0
    first, count = first[has], count[has]
    start = t.start[first]
    return start, first, count, np.searchsorted(t.offsets, start, "right") - 1


def spans(t: Texts, how: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, number of the first sentence in it, sentences) of each span."""
    _, first, count, doc = sentences(t, how)
    m = len(first)
    if not m:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e
    unit = t.hash_ranges(t.start[first], t.end[first + count - 1])
    total = np.concatenate(([0], np.cumsum(count)))
    begins = np.searchsorted(doc, np.arange(len(t) + 1))
    each = np.arange(m)
    stop = np.maximum(each + how.sentences, np.searchsorted(total, total[:-1] + how.words))
    start = np.minimum(each + 1 - how.sentences, np.searchsorted(total, total[1:] - how.words, "right") - 1)
    ahead, back = stop <= begins[doc + 1], start >= begins[doc]
    runs = np.unique(np.concatenate((each[ahead] * (m + 1) + stop[ahead], start[back] * (m + 1) + each[back] + 1)))
    at, stop = runs // (m + 1), runs % (m + 1)
    up, down = _powers(m + 1)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(unit * up[:m], out=sums[1:])
    return mix((sums[stop] - sums[at]) * down[at] + (stop - at).astype(np.uint64)), doc[at], at - begins[doc[at]], stop - at


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with two hashes, _r and _s, that name a row by id and text, nulls apart."""
    own = [F.col("doc_id"), F.col("text"), F.col("doc_id").isNull(), F.col("text").isNull()]
    return docs.withColumn("_r", F.xxhash64(F.lit(1), *own)).withColumn("_s", F.xxhash64(F.lit(2), *own))


def repeated(docs: DataFrame, how: Spans) -> DataFrame:
    """(_r, _s, covered array<struct<pos, k>>): for each row that has some, the spans whose like is met before.

    "Before" is in the order of doc_id (null first), row hashes, place.  Counting
    comes first, with map-side combine, so that only spans that repeat are
    ordered; the least place of a kind is a map-side combined minimum too, so a
    passage in a third of all documents fills no task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, t in chunks(column(batch, "text"), lower=True):
                h, doc, pos, k = spans(t, how)
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), column(batch, "doc_id").take(take), column(batch, "_r").take(take), column(batch, "_s").take(take), pa.array(pos.astype(np.int32)), pa.array(k.astype(np.int32))], ["h", "doc_id", "_r", "_s", "pos", "k"])

    own = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_r", "_s", "text")
    every = stored(own.mapInArrow(run, "h long, doc_id long, _r long, _s long, pos int, k int"))
    # counts and minima are tables of their own: a join that has an aggregate in its stage can't be split where a key is hot
    again = stored(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    met = stored(every.join(again, "h"))
    first = stored(met.groupBy("h").agg(F.min(F.struct("doc_id", "_r", "_s", "pos")).alias("first")))
    late = met.join(first, "h").where("not (_r = first._r and _s = first._s and pos = first.pos)")
    out = stored(late.groupBy("_r", "_s").agg(F.collect_set(F.struct("pos", "k")).alias("covered")))
    for df in (every, again, met, first):
        drop(df)
    return out


def deduplicated(docs: DataFrame, how: Spans = Spans()) -> DataFrame:
    """docs' columns with text cut, then n_sentences and n_removed, a row for each row of docs.

    Of spans equal but for A-Z case, the first in order of doc_id and place
    stays; sentences covered by any other are removed, with the white space
    behind them.  Texts of too few sentences or words have no span.  Null texts
    stay null.  Rows equal in doc_id and text are one document: what the first
    keeps, all keep.  An empty table gives an empty result.  Columns of docs
    named n_sentences or n_removed are replaced.
    """
    docs = small_batches(without(docs, "n_sentences", "n_removed"))
    names = {c: f"`{c.replace('`', '``')}`" for c in docs.columns}
    rows = docs.select(F.struct(*[n for c, n in names.items() if c != "text"]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = _keyed(rows).join(repeated(docs, how), ["_r", "_s"], "left").select("_row", "text", "covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, covered = column(batch, "text"), column(batch, "covered")
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, t in chunks(texts, lower=True):
                start, _, _, doc = sentences(t, how)
                begins = np.searchsorted(doc, np.arange(len(t) + 1))
                out, gone = [], np.zeros(hi - lo, np.int64)
                for i in range(hi - lo):
                    a, b = int(t.offsets[i]), int(t.offsets[i + 1])
                    raw = t.raw[a:b].tobytes()
                    cut = covered[lo + i].as_py()
                    if cut:
                        own = start[begins[i] : begins[i + 1]].copy()
                        own[0] = a
                        bad = np.zeros(len(own) + 1, np.int64)
                        for s in cut:
                            bad[s["pos"]] += 1
                            bad[s["pos"] + s["k"]] -= 1
                        bad = np.cumsum(bad)[:-1] > 0
                        ends = np.append(own[1:], b)
                        gone[i] = int(bad.sum())
                        raw = b"".join(raw[x - a : y - a] for x, y in zip(own[~bad].tolist(), ends[~bad].tolist(), strict=True)).rstrip(b" \t\n\v\f\r")
                    out.append(raw.decode() if valid[lo + i] else None)
                yield pa.RecordBatch.from_arrays([column(batch, "_row").slice(lo, hi - lo), pa.array(out, pa.string()), pa.array(np.diff(begins).astype(np.int64)), pa.array(gone)], ["_row", "text", "n_sentences", "n_removed"])

    schema = both.select("_row", "text").schema.add("n_sentences", "long").add("n_removed", "long")
    cut = both.mapInArrow(run, schema)
    return cut.select(*[F.col("text") if c == "text" else F.col(f"_row.{n}") for c, n in names.items()], "n_sentences", "n_removed")


def cleaned(docs: DataFrame, how: Spans = Spans()) -> DataFrame:
    """docs with text cut and n_chars, if there, brought in line; documents of which nothing is left go."""
    out = deduplicated(docs, how).where("n_removed = 0 or n_removed < n_sentences")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c.replace('`', '``')}`" for c in docs.columns])
