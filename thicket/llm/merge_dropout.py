"""SentencePiece (BPE type) encoding with seeded merge-dropout, and decoding.

Words are cut apart at spaces; the words of a chunk are merged side by side in
numpy: in every round each word's agenda gives its best candidate, the leftmost of
the highest-scored merge, unless a keyed hash of the candidate skips it.  Hashes
hang on the seed, the document (id, text and copy number), the word and its number
there, the place and the merged piece alone, so every occurrence is cut on its own,
and reruns, retries and other layouts cut alike.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.wordgrid import Texts, buffers, column, give_back, is_space, keyed, mix
from thicket.scratch import small_batches

#: The vocabulary file, read on the driver; another can be named in the environment.
MODEL = os.environ.get("THICKET_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
_NONE = np.iinfo(np.int32).max
#: SentencePiece writes a space as this character; in a text it is spelled in bytes.
SPACE = "▁"


@dataclass(frozen=True)
class Dropout:
    """rate: the share of candidate merges that are skipped.  cache: words that a
    worker remembers between chunks where none are, at rate 0."""

    rate: float = 0.1
    seed: int = 1
    cache: int = 300_000


@dataclass
class Pieces:
    """A vocabulary: bytes of each piece, first symbols by code point, and the merges, sorted by packed pair."""

    data: np.ndarray
    offsets: np.ndarray
    chars: np.ndarray  # sorted code points that are pieces
    char_ids: np.ndarray
    byte_ids: np.ndarray
    slots: np.ndarray  # packed pairs by hash, each at its slot or behind it; -1 where free
    merged: np.ndarray  # by slot
    rank: np.ndarray
    space: int
    name: str  # of the vocabulary, by its content

    def look(self, pair: np.ndarray) -> np.ndarray:
        """The slot of each packed pair; a free one for a pair that is no merge."""
        at = (_slot(pair) & (len(self.slots) - 1)).astype(np.int64)
        there = self.slots[at]
        on = np.flatnonzero((there != pair) & (there >= 0))
        while len(on):
            at[on] = (at[on] + 1) & (len(self.slots) - 1)
            there = self.slots[at[on]]
            on = on[(there != pair[on]) & (there >= 0)]
        return at


def _slot(pair: np.ndarray) -> np.ndarray:
    return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def _slotted(pairs: np.ndarray, merged: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Open addressing with linear probing, at most an eighth full."""
    size = 1 << max(4, (8 * len(pairs)).bit_length())
    slots, m, r = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.full(size, _NONE, np.int32)
    at = (_slot(pairs) & np.uint64(size - 1)).astype(np.int64)
    left = np.arange(len(pairs))
    while len(left):
        free = left[slots[at[left]] < 0]
        _, first = np.unique(at[free], return_index=True)
        put = free[first]
        slots[at[put]], m[at[put]], r[at[put]] = pairs[put], merged[put], rank[put]
        left = np.setdiff1d(left, put)
        at[left] = (at[left] + 1) & (size - 1)
    return slots, m, r


def load(path: str = MODEL) -> Pieces:
    """Reads a SentencePiece BPE model; on the driver, so that executors need no copy of the file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain, out, bytes_of = {}, [b""] * n, np.zeros(256, np.int32)
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(p[3:5], 16)
            bytes_of[value], out[i] = i, bytes([value])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain[p] = i
            out[i] = p.replace(SPACE, " ").encode()
    order = {i: r for r, i in enumerate(sorted(plain.values(), key=lambda i: (-sp.get_score(i), i)))}
    pairs = {(plain[p[:k]], plain[p[k:]]): i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
    key = np.array([a * n + b for a, b in pairs], np.int64)
    merged = np.array(list(pairs.values()), np.int32)
    table = _slotted(key, merged, np.array([order[i] for i in merged.tolist()], np.int32))
    singles = sorted((ord(p), i) for p, i in plain.items() if len(p) == 1 and p != SPACE)
    flat = b"".join(out)
    name = hashlib.sha256(repr((sorted(pairs.items()), singles, out)).encode()).hexdigest()
    return Pieces(np.frombuffer(flat, np.uint8), np.cumsum([0, *map(len, out)]), np.array([c for c, _ in singles]), np.array([i for _, i in singles], np.int32), bytes_of, *table, plain[SPACE], name)


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of flat that offsets cut, in the order of which, one after the other; and their bounds."""
    size = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(size)
    bounds = np.concatenate(([0], ends))
    at = np.repeat(offsets[:-1][which] - bounds[:-1], size) + np.arange(bounds[-1])
    return flat[at], bounds


def first_symbols(v: Pieces, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the words' code points, or of the bytes of those that are no pieces, and the number of each one's word."""
    lead = (words & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    size = np.diff(np.append(at, len(words)))
    b = np.concatenate((words, np.zeros(3, np.uint8))).astype(np.int64)
    c = b[at]
    code = np.where(size == 1, c, np.where(size == 2, (c & 31) << 6 | b[at + 1] & 63, np.where(size == 3, (c & 15) << 12 | (b[at + 1] & 63) << 6 | b[at + 2] & 63, (c & 7) << 18 | (b[at + 1] & 63) << 12 | (b[at + 2] & 63) << 6 | b[at + 3] & 63)))
    place = np.minimum(np.searchsorted(v.chars, code), len(v.chars) - 1)
    ids = np.where(v.chars[place] == code, v.char_ids[place], -1)
    ids[code == 32] = v.space
    begins = np.zeros(len(words) + 1, np.int32)
    np.add.at(begins, offsets[:-1], 1)
    owner = np.cumsum(begins[:-1])[at].astype(np.int32) - np.int32(1)
    if (ids >= 0).all():
        return ids, owner
    spelled = np.where(ids >= 0, 1, size)
    out = np.repeat(ids, spelled)
    where = np.repeat(at, spelled) + np.arange(len(out)) - np.repeat(np.cumsum(spelled) - spelled, spelled)
    return np.where(out >= 0, out, v.byte_ids[words[where]]), np.repeat(owner, spelled)


def merge(v: Pieces, ids: np.ndarray, owner: np.ndarray, key: np.ndarray, how: Dropout) -> tuple[np.ndarray, np.ndarray]:
    """Ids after all merges, and their words' bounds; ids: a word's first symbols; key: a hash of each word, of its document and its number there."""
    n_words, n_pieces = len(key), len(v.offsets) - 1
    done_ids, done_owner, done_place = [], [], []
    limit = np.uint64(min((1 << 64) - 1, int(how.rate * 2.0**64)))
    ids = ids.astype(np.int32)

    def look(left: np.ndarray, right: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each candidate merge, _NONE where there is none or it is skipped."""
        slot = v.look(left.astype(np.int64) * n_pieces + right)
        rank, into = v.rank[slot], v.merged[slot]
        if how.rate > 0:
            i = np.flatnonzero(rank < _NONE)
            skip = keyed(key[word[i]] + (at[i].astype(np.uint64) << np.uint64(32)) + into[i].astype(np.uint64), how.seed) < limit
            rank[i[skip]] = _NONE
        return rank, into

    begin = np.searchsorted(owner, np.arange(n_words + 1)).astype(np.int32)
    place = np.arange(len(ids), dtype=np.int32) - begin[owner]  # the place of a symbol's first character in its word
    rank = np.full(len(ids), _NONE, np.int32)
    into = np.zeros(len(ids), np.int32)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    rank[inner], into[inner] = look(ids[inner], ids[inner + 1], owner[inner], place[inner])
    while len(ids):
        heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        best = np.minimum.reduceat(rank, heads)
        size = np.diff(np.append(heads, len(ids)))
        live = best < _NONE
        if not live.all():
            stay = np.repeat(live, size)
            over = ~stay
            done_ids.append(ids[over])
            done_owner.append(owner[over])
            done_place.append(place[over])
            ids, owner, place, rank, into = ids[stay], owner[stay], place[stay], rank[stay], into[stay]
            best, size = best[live], size[live]
            if not len(ids):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        first = np.ones(len(hit), bool)
        first[1:] = owner[hit[1:]] != owner[hit[:-1]]
        hit = hit[first]
        ids[hit] = into[hit]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        hit = hit - np.arange(len(hit))  # one symbol is gone before each later hit
        ids, owner, place, rank, into = ids[keep], owner[keep], place[keep], rank[keep], into[keep]
        # only pairs at a merged symbol are looked up again: with the one behind it, and with the one before
        rank[hit] = _NONE
        after = hit[hit + 1 < len(ids)]
        after = after[owner[after] == owner[after + 1]]
        before = hit[hit > 0] - 1
        before = before[owner[before] == owner[before + 1]]
        redo = np.concatenate((before, after))
        rank[redo], into[redo] = look(ids[redo], ids[redo + 1], owner[redo], place[redo])
    if not done_ids:
        return np.zeros(0, np.int32), np.zeros(n_words + 1, np.int64)
    ids, owner, place = (np.concatenate(x) for x in (done_ids, done_owner, done_place))
    # a symbol's place in the whole is its word's, then its own: each has one, so that they are dealt out rather than sorted
    spot = np.zeros(begin[-1] + 1, bool)
    at = begin[owner] + place
    spot[at] = True
    order = np.empty(len(ids), np.int32)
    order[(np.cumsum(spot) - 1)[at]] = ids
    return order, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n_words))))


class Encoder:
    """Cuts chunks of texts, remembering words between them."""

    def __init__(self, pieces: Pieces, how: Dropout):
        self.pieces, self.how = pieces, how
        self._forget()

    def _forget(self) -> None:
        self.keys, self.flat, self.bounds = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray, who: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of texts; each is read with a space before it.  who: a hash for each text of what tells it from equal ones."""
        v, how = self.pieces, self.how
        lead = np.insert(data, offsets[:-1], 32) if len(offsets) > 1 else data
        offsets = offsets + np.arange(len(offsets))
        t = Texts(lead, offsets)
        blank = is_space(lead)
        cut = blank.copy()  # a word begins at its space; other white space stands alone
        cut[1:] |= blank[:-1] & (lead[:-1] != 32)
        cut[offsets[:-1]] = True
        lo = np.flatnonzero(cut)
        hi = np.append(lo[1:], len(lead))
        doc_first = np.searchsorted(lo, offsets)
        key = keyed(t.hash_ranges(lo, hi), 3)
        if how.rate > 0:
            text = t.hash_ranges(offsets[:-1], offsets[1:])
            text = keyed(text if who is None else text + mix(who), how.seed + 1)
            n = np.diff(doc_first)
            number = np.arange(len(lo)) - np.repeat(doc_first[:-1], n)
            key = mix(key + np.repeat(text, n) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ids, owner = first_symbols(v, lead, np.append(lo, len(lead)))
            ids, bounds = merge(v, ids, owner, key, how)
            return ids, bounds[doc_first]
        kinds, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
        known = self.keys[at] == kinds if len(self.keys) else np.zeros(len(kinds), bool)
        new = np.flatnonzero(~known)
        if len(new):
            spans = np.stack((lo[first[new]], hi[first[new]]), 1)
            size = spans[:, 1] - spans[:, 0]
            woff = np.concatenate(([0], np.cumsum(size)))
            words = lead[np.repeat(spans[:, 0] - woff[:-1], size) + np.arange(woff[-1])]
            ids, owner = first_symbols(v, words, woff)
            ids, bounds = merge(v, ids, owner, kinds[new], how)
            if len(self.keys) + len(new) > how.cache:
                old, ob = gather(self.flat, self.bounds, at[known])
                keys = kinds[known]
            else:
                old, ob, keys = self.flat, self.bounds, self.keys
            flat, both = np.concatenate((old, ids)), np.concatenate((ob, bounds[1:] + len(old)))
            keys = np.concatenate((keys, kinds[new]))
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.flat, self.bounds = gather(flat, both, order)
            at = np.searchsorted(self.keys, kinds)
        ids, bounds = gather(self.flat, self.bounds, at[inverse])
        return ids, bounds[doc_first]


def decode(v: Pieces, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that were cut into ids; the space before each is left out."""
    data, at = gather(v.data, v.offsets, ids)
    offsets = at[bounds]
    keep = np.ones(len(data), bool)
    keep[offsets[:-1][np.diff(offsets) > 0]] = False
    lead = np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
    return data[keep], offsets - lead


def _slices(col: pa.Array, size: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(col)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    if len(data) > size:
        give_back()


def _who(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """A hash of each row's whole numbers in columns; null is a value of its own."""
    out = np.zeros(batch.num_rows, np.uint64)
    for k, name in enumerate(names):
        col = column(batch, name)
        value = keyed(col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 5 + k)
        out = mix(out + np.where(col.is_null().to_numpy(zero_copy_only=False), np.uint64(1), value))
    return out


def _encoder(pieces: Pieces, how: Dropout, held: dict = {}) -> Encoder:  # noqa: B006
    """A worker's encoder, kept between its tasks."""
    key = (pieces.name, how)
    if key not in held:
        held.clear()
        held[key] = Encoder(pieces, how)
    return held[key]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _copy, each row's place in docs, by which rows that are equal in doc_id and text are told apart.  A place is told by file and row alone: nothing is shuffled, and a task that runs again gives the same."""
    return docs.withColumn("_copy", F.monotonically_increasing_id())


def encoded(docs: DataFrame, keep: list[str], how: Dropout = Dropout(), path: str = MODEL) -> DataFrame:
    """docs' columns ``keep``, then ids array<int>, a row for each row of docs.

    A null text has null ids; an empty one has the id of the space that stands
    before every text.  A character that is no piece, and the piece character
    for a space itself, is spelled in bytes, so decoding gives back any text.
    Equal texts of other ids (doc_id) or copy numbers (_copy), if docs has such
    columns, are cut on their own.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    names = [f"`{c.replace('`', '``')}`" for c in keep]
    by = [c for c in ("doc_id", "_copy") if c in docs.columns]
    rows = small_batches(docs).select(F.col("text").alias("_text"), *[F.col(c).cast("long").alias(f"_by_{c}") for c in by], *[F.col(n).alias(f"_{i}") for i, n in enumerate(names)])
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, how)
        for batch in batches:
            who = _who(batch, [f"_by_{c}" for c in by])
            for lo, hi, data, offsets in _slices(column(batch, "_text")):
                ids, bounds = enc.encode(data, offsets, who[lo:hi])
                null = column(batch, "_text").slice(lo, hi - lo).is_null()
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=null)
                yield pa.RecordBatch.from_arrays([*(column(batch, f"_{i}").slice(lo, hi - lo) for i in range(len(keep))), lists], [*keep, "ids"])

    return rows.mapInArrow(run, schema)


def decoded(rows: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """rows' columns ``keep``, then text, decoded from ids; null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(load(path))
    names = [f"`{c.replace('`', '``')}`" for c in keep]
    own = rows.select("ids", *[F.col(n).alias(f"_{i}") for i, n in enumerate(names)])
    schema = ", ".join([*(f"{n} {rows.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = column(part, "ids")
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                data, off = decode(v, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size))))
                raw = data.tobytes()
                ok = lists.is_valid().to_pylist()
                texts = [raw[a:b].decode() if g else None for a, b, g in zip(off[:-1].tolist(), off[1:].tolist(), ok, strict=True)]
                yield pa.RecordBatch.from_arrays([*(column(part, f"_{i}") for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    return own.mapInArrow(run, schema)


def round_trip(docs: DataFrame, how: Dropout = Dropout(), path: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_tokens, ids_sha256, lossless), a row for each row of docs: every text, encoded and decoded again where it lies; ids_sha256 is over the ids as little-endian int32.

    A null text counts as an empty one.  Rows equal in id and text are cut
    alike.  An empty table gives an empty result.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, how)
        for batch in batches:
            who = _who(batch, ["doc_id"])
            for lo, hi, data, offsets in _slices(column(batch, "text")):
                ids, bounds = enc.encode(data, offsets, who[lo:hi])
                back, off = decode(enc.pieces, ids, bounds)
                whole = np.array_equal(off, offsets) and np.array_equal(back, data)
                same = np.ones(hi - lo, bool) if whole else np.array([np.array_equal(back[off[i] : off[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(hi - lo)], bool)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                sha = [hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(lo, hi - lo), pa.array(np.diff(points[offsets]).astype(np.int64)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sha), pa.array(same)], ["doc_id", "n_chars", "n_tokens", "ids_sha256", "lossless"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long, ids_sha256 string, lossless boolean")
