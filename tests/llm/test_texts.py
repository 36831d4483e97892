"""Operators on single texts against plain versions of them."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, WORD, words
from thicket.llm import cotrain, curriculum, html_crf, maxent_lm, merge_dropout, prefix_targets, quality_rules, span_dedup
from thicket.llm.wordgrid import buffers, chunks, ngrams

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n", "a", "A a\tA", "é日本 \U0001f600 x", "#$| <b> & a.\nb\nb\n \nb", "w " * 400, "one two three four. " * 30, "▁ ▁▁", "\x00\x1f a\x0bb"]


def docs(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("size", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("ids", F.lit(3)) if extra else df


def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\x0b日.", max_size=30)), max_size=6))
def test_word_grid(texts):
    got = []
    for _, _, t in chunks(pa.array(texts, pa.string()), lower=True, size=16):
        h = t.word_hashes()
        for i in range(len(t)):
            got.append([t.data[a:b].tobytes().decode() for a, b in zip(t.start[t.bounds[i] : t.bounds[i + 1]], t.end[t.bounds[i] : t.bounds[i + 1]], strict=True)])
        for k, w in enumerate(h.tolist()):
            seen.setdefault(t.data[t.start[k] : t.end[k]].tobytes(), w)
            assert seen[t.data[t.start[k] : t.end[k]].tobytes()] == w
    assert got == [words(x) for x in texts]
    assert len(set(seen.values())) == len(seen)


seen: dict = {}


def test_ngrams():
    (_, _, t), = chunks(pa.array(["a b c", "a b", "b c a b c"]))
    g, at = ngrams(t.word_hashes(), t.doc, 3)
    assert len(g) == 4 and g[0] == g[3] and len(set(g.tolist())) == 3 and at.tolist() == [0, 5, 6, 7]


# quality rules


def statistics(text):
    text = text or ""
    w = words(text, lower=False)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    repeat = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


def test_quality_statistics(spark):
    df = corpus(spark).select("doc_id", "text", "lang").union(docs(spark, ODD).select(F.col("doc_id") + 10**6, "text", "lang"))
    rows = {r.doc_id: r for r in df.collect()}
    got = quality_rules.verdicts(df.withColumn("kept", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = statistics(rows[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = sum(r.kept for r in got)
    assert kept > 0.5 * len(got)
    assert quality_rules.keep_good(df).count() == kept


def test_quality_edges(spark):
    assert quality_rules.verdicts(docs(spark, [])).count() == 0
    assert quality_rules.keep_good(docs(spark, [])).count() == 0
    assert not any(r.kept for r in quality_rules.verdicts(docs(spark, ODD[:8], extra=True)).collect())


def test_bands_are_those_of_sorted_values(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 3 == 0 else f"l{i % 3}", bool(i % 7 == 0), float(x), float(x) / 3) for i, x in enumerate(rng.normal(6, 1, 2000))] + [("empty", True, 1.0, 1.0), ("l1", False, None, None)]
    df = spark.createDataFrame(rows, "lang string, base_failed boolean, log_ppl double, log_order double")
    got = {r.lang: r for r in quality_rules.bands(df, quality_rules.Rules()).collect()}
    again = {r.lang: r for r in quality_rules.bands(df.repartition(9), quality_rules.Rules()).collect()}
    assert got == again and set(got) == {None, "l1", "l2"}
    for lang, r in got.items():
        x = np.array([v for g, bad, v, _ in rows if g == lang and not bad and v is not None])
        mid, top = np.percentile(x, [50, 75])
        assert r.low == pytest.approx(0.62 * mid, abs=0.01) and r.high == pytest.approx(mid + 3.5 * (top - mid) / 0.6745, abs=0.05)


def test_tables_keep_to_their_size(spark):
    n = [1] * 50 + [2] * 30 + [3] * 20 + [7] * 10 + [5000] * 4 + [6000] * 3
    df = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "k long, n long")
    for most in (0, 2, 3, 7, 16, 17, 36, 37, 67, 10**6):
        least, k = quality_rules.least_count(df, most)
        assert least >= 2 and k == sum(x >= least for x in n) <= most
        below = max((x for x in n if x < least), default=0)
        assert below < 2 or sum(x >= below for x in n) > most
        assert len(quality_rules.packed(df, most, True)) == k
    m = quality_rules.train(corpus(spark), quality_rules.Rules(entries=500))
    assert 0 < len(m.tri) <= 500 and 0 < len(m.known) <= 500


def test_counts_that_fit_no_table_are_scored_from_further_ones(spark):
    df = corpus(spark).select("doc_id", "text", "lang")
    m = quality_rules.train(df, quality_rules.Rules(entries=700))
    assert len(m.tri_more) > 1 and len(m.known_more) >= 1
    scored = [{r.doc_id: tuple(r) for r in quality_rules.verdicts(df, quality_rules.Rules(**how)).collect()} for how in ({}, {"entries": 700})]
    assert scored[0] == scored[1]


def test_the_same_rows_are_kept_however_many_tables_hold_the_counts(spark):
    df = corpus(spark).select("doc_id", "text", "lang")
    kept = [sorted(map(tuple, quality_rules.keep_good(df, quality_rules.Rules(**how)).collect())) for how in ({}, {"entries": 2000})]
    assert kept[0] == kept[1]


def test_quality_of_very_long_and_repeated_texts(spark):
    long = " ".join(f"w{i % 9000}" for i in range(120000))
    got = quality_rules.verdicts(docs(spark, [long, "a b " * 30, "a b " * 30, None])).collect()
    assert {(r.doc_id, r.n_words) for r in got} == {(0, 120000), (1, 60), (2, 60), (3, 0)}
    assert [r.log_ppl for r in got if r.doc_id == 1] == [r.log_ppl for r in got if r.doc_id == 2]


def test_quality_rejects_gibberish_and_shuffled_texts(spark):
    rng = random.Random(4)
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    plain = [r for r in df.where("lang = 'en'").orderBy("doc_id").collect() if 150 <= len(words(r.text, lower=False)) and statistics(r.text)[4] == 0][:25]
    vocab = sorted({w for r in plain for w in words(r.text, lower=False)})
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    symbols = lambda: "".join(chr(rng.randint(33, 126)) for _ in range(rng.randint(2, 9)))
    made = {
        "letters": [" ".join(letters() for _ in range(200)) for _ in range(25)],
        "ascii": [" ".join(symbols() for _ in range(200)) for _ in range(25)],
        "vocabulary": [" ".join(rng.choice(vocab) for _ in range(200)) for _ in range(25)],
        "shuffled": [" ".join(rng.sample(w, len(w))) for r in plain for w in [words(r.text, lower=False)]],
    }
    rows = [(10**6 * (k + 1) + i, t, "en") for k, ts in enumerate(made.values()) for i, t in enumerate(ts)]
    got = {r.doc_id: r for r in quality_rules.verdicts(df.union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    for k, kind in enumerate(made):
        out = [got[10**6 * (k + 1) + i] for i in range(len(made[kind]))]
        assert not any(r.base_failed for r in out), kind
        assert sum(not r.kept for r in out) >= 0.9 * len(out), (kind, [(r.log_ppl, r.high, r.log_order, r.order_high) for r in out])
    assert sum(got[r.doc_id].kept for r in plain) >= 0.9 * len(plain)


def test_quality_model_grows_with_the_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [(len(m.frequent), len(m.known), len(m.tri)) for m in (quality_rules.train(x, quality_rules.Rules()) for x in (df.where("doc_id % 8 = 0"), df))]
    assert all(a * 1.5 < b for a, b in zip(*sizes, strict=True))


def test_word_shares_sum_to_one():
    cls, n, once = np.array([0, 0, 0, 1]), np.array([2, 5, 3, 2]), np.array([6, 1, 0])
    of = np.stack([once, *(np.bincount(cls, np.minimum(n, 5) == k, 3) for k in (2, 3, 4, 5))], 1).astype(np.int64)
    tokens = np.bincount(cls, n, 3) + once
    cut, unknown = quality_rules.shares(of, tokens)
    share = np.log((n - cut[np.minimum(n, 3)]) / tokens[cls])
    kinds = once + once * (once - 1) / (2.0 * (np.array([1, 1, 0]) + 1))
    assert np.bincount(cls, np.exp(share), 3)[:2] + kinds[:2] * np.exp(unknown[:2]) == pytest.approx(1)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 400), st.integers(0, 3))
def test_tables_hold_what_is_put_in(n, cut):
    rng = np.random.default_rng(n)
    h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    counts = rng.choice([1, 2, 200, 254, 255, 256, 10**12], len(h))
    order = rng.permutation(len(h))
    absent = rng.integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2)
    whole = quality_rules.Table.of(h[order], counts[order])
    bits = max(cut, quality_rules.Table.bits_for(len(h)))
    slices = (h >> np.uint64(64 - cut)).astype(int) if cut else np.zeros(len(h), int)
    parts = quality_rules.Table.join(bits, [quality_rules.Table.pack(h[slices == i], counts[slices == i], bits, i << (bits - cut), 1 << (bits - cut)) for i in range(1 << cut)])
    for t in (whole, parts):
        assert (t.find(h) == counts).all() and not t.find(absent).any() and len(t) == len(h)


def test_a_text_is_scored_without_its_own_counts():
    rng = np.random.default_rng(3)
    size = 9
    texts = [rng.integers(2, size, n) for n in (30, 50, 20, 40)]

    def grams(t):
        c = np.concatenate((t, [1]))
        b = np.concatenate(([0], c[:-1]))
        return np.concatenate(([0], b[:-1])), b, c

    def model(some, **how):
        k, n = np.unique(np.concatenate([(a * size + b) * size + c for a, b, c in map(grams, some)]), return_counts=True)
        return quality_rules.kneser_ney(k, n, size, np.zeros(0, np.uint64), 2, **how)

    whole = model(texts, least=2)
    without = model(texts[1:], like=whole)
    k, own = np.unique([(a * size + b) * size + c for a, b, c in zip(*grams(texts[0]), strict=True)], return_counts=True)
    a, b, c = k // size**2, k // size % size, k % size
    assert whole.log_prob(a, b, c, np.zeros(len(k), np.int64), own) == pytest.approx(without.log_prob(a, b, c))


def test_quality_model_counts_every_text(spark):
    rng = random.Random(5)
    texts = ["some phrase shared " + " ".join(str(rng.random()) for _ in range(40)) for _ in range(60)] + ["x y z w"] * 20
    m = quality_rules.train(docs(spark, texts), quality_rules.Rules())
    assert m.tri_total.sum() == sum(len(t.split()) + 1 for t in texts)


def plain_log_perplexity(texts):
    """ln perplexity a word of each text, as the module's head and Rules say, with dictionaries: every text scored without its own counts."""
    from thicket.llm.wordgrid import Texts

    split = [words(t, lower=False) for t in texts]
    count = Counter(w for ws in split for w in ws)
    t = Texts(*buffers(pa.array(list(count))))
    hash_of = dict(zip(count, t.word_hashes().view(np.int64).tolist(), strict=True))
    class_of = dict(zip(count, quality_rules.classes(t, quality_rules.Rules().rest).tolist(), strict=True))
    top = sorted(count, key=lambda w: (-count[w], hash_of[w]))[: math.ceil(round(sum(count.values()) ** (1 / 3), 9))]
    rest = quality_rules.Rules().rest
    size = 2 + len(top) + rest
    sym = {w: ("w", w) if w in set(top) else ("c", class_of[w]) for w in count}
    grams = []
    for ws in split:
        seq = ["<", "<", *(sym[w] for w in ws), ">"]
        grams.append(Counter(zip(seq, seq[1:], seq[2:], strict=False)) if ws else Counter())
    tri = sum(grams, Counter())

    def discounts(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
        return [0.0] + [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), raw, strict=True)]

    kinds = Counter((b, c) for _, b, c in tri)
    follows = Counter(c for _, c in kinds)
    cut3, cut2, cut1 = discounts(tri.values()), discounts(kinds.values()), discounts(follows.values())
    cut = lambda d, n: d[min(max(n, 0), 3)]
    total = sum(follows.values())
    spread = sum(cut(cut1, n) for n in follows.values()) / total / (size - 1)
    base = lambda c: (follows[c] - cut(cut1, follows[c])) / total + spread
    rare = {w: n for w, n in count.items() if sym[w][0] == "c"}
    word_cut = discounts(rare.values())
    out = []
    for ws, own in zip(split, grams, strict=True):
        left = Counter({g: n - own[g] for g, n in tri.items() if n > own[g]})
        two = Counter((b, c) for _, b, c in left)
        ctx3, ctx2 = {}, {}
        for (a, b, c), n in left.items():
            ctx3.setdefault((a, b), []).append(n)
        for (b, c), n in two.items():
            ctx2.setdefault(b, []).append(n)
        seen, logp = Counter(ws), 0.0
        for (a, b, c), n in own.items():
            ns = ctx2.get(b, [])
            p2 = (two[b, c] - cut(cut2, two[b, c]) + sum(cut(cut2, x) for x in ns) * base(c)) / sum(ns) if ns else base(c)
            ns = ctx3.get((a, b), [])
            p3 = (left[a, b, c] - cut(cut3, left[a, b, c]) + sum(cut(cut3, x) for x in ns) * p2) / sum(ns) if ns else p2
            logp += n * math.log(p3)
        for w, n in seen.items():
            if w in rare:
                own_class = [x for v, x in rare.items() if class_of[v] == class_of[w]]
                once, tokens, have = own_class.count(1), sum(own_class), count[w] - n
                kinds_ = max(1, once + once * (once - 1) / (2 * (own_class.count(2) + 1)))
                unknown = max(0.05, once + sum(cut(word_cut, x) for x in own_class if x > 1)) / tokens / kinds_
                logp += n * math.log((have - cut(word_cut, have)) / tokens if have >= 2 else unknown)
        out.append(-logp / (len(ws) + 1) if ws else None)
    return out


def test_log_perplexity_equals_plain_version(spark):
    rng = random.Random(9)
    vocab = ["The", "of", "and", "river", "boat,", "Moon.", "stars", "walked", "went", "green", "old;", "He", "sang", "x1", "x2", "x3"]
    texts = [" ".join(rng.choice(vocab[: rng.choice([4, 9, 16])]) for _ in range(rng.randint(1, 60))) for _ in range(40)] + [r.text for r in corpus(spark).orderBy("doc_id").limit(12).collect()] + ["", None, "alone", "w " * 70, "w " * 70]
    got = {r.doc_id: r.log_ppl for r in quality_rules.verdicts(docs(spark, texts)).collect()}
    for i, want in enumerate(plain_log_perplexity(texts)):
        assert got[i] is None if want is None else got[i] == pytest.approx(want, rel=1e-9), i


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    size = 12
    seq = rng.integers(2, size, 400)
    key = np.concatenate([[0 * size * size + 0 * size + seq[0]], (seq[:-2] * size + seq[1:-1]) * size + seq[2:]])
    k, n = np.unique(key, return_counts=True)
    m = quality_rules.kneser_ney(k, n, size, np.zeros(0, np.uint64), 2)
    for a, b in ((0, 0), (3, 4), (5, 5), (7, 2), (1, 1)):
        c = np.arange(1, size)
        p = np.exp(m.log_prob(np.full(len(c), a), np.full(len(c), b), c))
        assert p.sum() == pytest.approx(1, abs=1e-6) and (p > 0).all()


# merge dropout


def test_every_occurrence_is_cut_on_its_own(spark):
    text = "internationalization " * 200
    ids, _ = merge_dropout.Encoder(pieces(), merge_dropout.Dropout()).encode(*buffers(pa.array([text])))
    space = [i for i, x in enumerate(ids.tolist()) if pieces().data[pieces().offsets[x] : pieces().offsets[x] + 1].tobytes() == b" "]
    assert len({tuple(ids[a:b].tolist()) for a, b in zip(space, space[1:], strict=False)}) > 8
    rows = [(i, c, text) for i in (1, 2) for c in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, _copy int, text string")
    out = merge_dropout.encoded(df, ["doc_id"])
    assert len({tuple(r.ids) for r in out.collect()}) == 4
    assert sorted(r.ids for r in out.collect()) == sorted(r.ids for r in merge_dropout.encoded(df.repartition(3), ["doc_id"]).collect())
    assert {r.text for r in merge_dropout.decoded(out, ["doc_id"]).collect()} == {text}


def test_no_dropout_is_plain_encoding():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.MODEL)
    enc = merge_dropout.Encoder(merge_dropout.load(), merge_dropout.Dropout(rate=0))
    texts = ["Hello world, this is a test.", "été à la plage naïve", "straße über 12345", "one\ntwo"]
    ids, bounds = enc.encode(*buffers(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [sp.encode(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_round_trip(texts, rate):
    v = pieces()
    enc = merge_dropout.Encoder(v, merge_dropout.Dropout(rate=rate, cache=20))
    data, offsets = buffers(pa.array(texts))
    ids, bounds = enc.encode(data, offsets)
    back, off = merge_dropout.decode(v, ids, bounds)
    assert [back[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)] == texts
    again = merge_dropout.Encoder(v, merge_dropout.Dropout(rate=rate)).encode(data, offsets)
    assert np.array_equal(again[0], ids)


_PIECES: list = []


def pieces():
    if not _PIECES:
        _PIECES.append(merge_dropout.load())
    return _PIECES[0]


def test_dropout_varies_by_seed_and_rate(spark):
    texts = [f"international cooperation number {i} on understanding" for i in range(40)]
    data, offsets = buffers(pa.array(texts))
    cut = lambda **how: merge_dropout.Encoder(pieces(), merge_dropout.Dropout(**how)).encode(data, offsets)[0]
    n = [len(cut(rate=r)) for r in (0.0, 0.1, 0.5, 1.0)]
    assert n == sorted(n) and n[0] < n[1] < n[2] and n[3] >= len(data)
    assert not np.array_equal(cut(rate=0.3, seed=1), cut(rate=0.3, seed=2))


def test_encoded_and_decoded(spark):
    df = docs(spark, ODD, extra=True)
    out = merge_dropout.encoded(df.drop("ids"), ["doc_id", "size"])
    back = {r.doc_id: r.text for r in merge_dropout.decoded(out, ["doc_id"]).collect()}
    assert back == dict(enumerate(ODD))
    got = {r.doc_id: r for r in merge_dropout.round_trip(df).collect()}
    ids = {r.doc_id: r.ids for r in out.collect()}
    for i, t in enumerate(ODD):
        assert got[i].lossless and got[i].n_chars == len(t or "")
        if t is not None:
            assert got[i].n_tokens == len(ids[i]) and got[i].ids_sha256 == hashlib.sha256(np.array(ids[i], "<i4").tobytes()).hexdigest()
    assert merge_dropout.encoded(docs(spark, []), ["doc_id"]).count() == 0


# language model


def test_language_model(spark):
    df = corpus(spark)
    rows = {r.doc_id: words(r.text) for r in df.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    count = Counter(w for i, ws in rows.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(count.values()) + ends, len(count) + 1
    got = {r.doc_id: r for r in maxent_lm.score(df, maxent_lm.MaxEnt(known=4, clustered=400)).collect()}
    assert set(got) == set(rows)
    for i, ws in rows.items():
        r = got[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_is_a_distribution():
    """Class shares sum to 1 whatever the history, and words to 1 within a class."""
    rng = np.random.default_rng(0)
    how = maxent_lm.MaxEnt(own=3, groups=4)
    w, b = rng.normal(size=(64, how.classes)).astype(np.float32), rng.normal(size=how.classes).astype(np.float32)
    rows = rng.integers(0, 64, (5, 4)).astype(np.int32)
    total = sum(np.exp(maxent_lm.target_logs(w, b, rows, np.full(5, c))) for c in range(how.classes))
    assert total == pytest.approx(np.ones(5), abs=1e-5)


def test_gradient_steps_sum_repeated_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)).astype(np.float32)
    key = rng.integers(0, 12, 200)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) > 0)))
    got = maxent_lm._run_sums(x, order, first, np.diff(np.append(first, 200)))
    want = np.stack([x[key == k].sum(0) for k in np.unique(key)])
    assert got == pytest.approx(want, abs=1e-4)


def test_language_model_is_the_same_whatever_the_layout(spark):
    df = corpus(spark)
    how = maxent_lm.MaxEnt(slice=8)
    scores = [sorted((r.doc_id, round(r.score, 3)) for r in maxent_lm.score(d, how).collect()) for d in (df, df.repartition(7), df.orderBy("text").coalesce(1))]
    assert scores[0] == scores[1] == scores[2]


def test_language_model_counts_repeated_rows(spark):
    df = docs(spark, ["a b c a", "b b", None, "a"])
    one = {r.doc_id: r for r in maxent_lm.score(df).collect()}
    two = maxent_lm.score(df.union(df)).collect()
    assert len(two) == 8 and {r.train_tokens for r in two} == {2 * one[0].train_tokens}
    assert len({(r.doc_id, round(r.score, 6), r.n_known) for r in two}) == 4


def test_language_model_edges(spark):
    assert maxent_lm.score(docs(spark, [])).count() == 0
    got = {r.doc_id: r for r in maxent_lm.score(docs(spark, ODD, extra=True)).collect()}
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got.values())
    assert got[0].n_tokens == got[1].n_tokens == 1


# chat formatting


def test_prefix_targets(spark):
    rows = [(1, 0, "system", "be</s> kind"), (1, 1, "user", "[INST] \\ hi <s>"), (1, 2, "assistant", "a[/INST]\\"), (1, 3, "user", None), (1, 4, "assistant", "é</s>"), (1, 5, "user", "bye"), (2, 0, "user", "x"), (3, 0, "assistant", ""), (4, 1, "tool[/ROLE] ", "t"), (4, 1, "tool[/ROLE] ", "t"), (4, None, None, "n"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    out = prefix_targets.expand(df)
    ex = {(r.conv_id, r.example): r for r in out.collect()}
    assert sorted(ex, key=str) == sorted([(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0), (None, 0)], key=str)
    first, second = ex[1, 0], ex[1, 1]
    assert second.text.startswith(first.text) and prefix_targets.unescape(first.text[first.loss_start : first.loss_end]) == "a[/INST]\\"
    assert prefix_targets.parse(second.text) == [(r[2], r[3] or "") for r in rows[:5]]
    assert ex[1, 2].loss_start == ex[1, 2].loss_end == 0
    for back in (prefix_targets.read_back(out), prefix_targets.digest(df)):
        got = {r.conv_id: r for r in back.collect()}
        for conv in (1, 2, 3, 4, None):
            own = [r for r in rows if r[0] == conv]
            own = sorted(own, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
            said = "".join(r[3] or "" for r in own if r[2] == "assistant")
            assert got[conv].n_turns == len(own)
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
            assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert prefix_targets.expand(df.where("false")).count() == 0 and prefix_targets.digest(df.where("false")).count() == 0


def test_long_conversations_go_in_bounded_batches(spark):
    turns = [(5, i, "assistant" if i % 2 else "user", "x" * 2000) for i in range(1200)]
    sizes = [b.nbytes for b in prefix_targets._expand(iter([pa.RecordBatch.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), t, strict=True)) for t in turns])]))]
    assert len(sizes) > 100 and max(sizes) < 3 * prefix_targets.BATCH
    got = prefix_targets.digest(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()
    assert (got.n_turns, got.n_examples, got.loss_chars) == (1200, 600, 1200000)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x[/ROLE] "]), st.lists(st.sampled_from([*prefix_targets.CONTROL, "\\", "a", " ", "[", "<"])).map("".join)), max_size=5))
def test_template_is_reversible(turns):
    text = "<s>" + "".join("".join(prefix_targets.render(*t)) for t in turns)
    assert prefix_targets.parse(text) == turns


# span dedup


def test_spans(spark):
    shared = "The quick brown fox jumps over the lazy dog. It then sleeps for a very long time. Nobody knows why this is so. "
    rows = [(1, f"Alpha beta. {shared}Gamma delta."), (2, f"Other start of text and {shared}Other end!"), (3, "Short. Short. Short."), (4, "Short. Short."), (5, shared.upper()), (6, None), (7, ""), (8, shared + "Mid piece here. " + shared)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).withColumn("n_removed", F.lit(99))
    got = {r.doc_id: r for r in span_dedup.deduplicated(df).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "Other start of text and The quick brown fox jumps over the lazy dog. Other end!"
    assert got[3].text == rows[2][1] and got[4].text == rows[3][1]
    assert got[5].text == "" and got[5].n_removed == got[5].n_sentences > 0
    assert got[6].text is None and got[7].text == ""
    assert got[8].text == "Mid piece here."
    kept = {r.doc_id: r for r in span_dedup.cleaned(df).collect()}
    assert set(kept) == {1, 2, 3, 4, 6, 7, 8} and all(r.n_chars == len(r.text or "") for r in kept.values())
    assert span_dedup.deduplicated(df.where("false")).count() == 0


def plain_dedup(rows, least, most_words, marks=".!?"):
    """Cut texts of (id, text): sentences by regex, every run hashed in a dict, first run of a kind kept."""
    import re

    sents = {}
    for i, t in rows:
        parts = re.findall(rf"(?s)[^\n]*?(?:[{marks}](?=[\x20\x09-\x0D]|$)|\n|$)", t or "")
        sents[i] = [p for p in parts if WORD.search(p)]
    runs = {}
    for i in sorted(sents):
        w = [words(p) for p in sents[i]]
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                enough = lambda lo, hi, w=w: hi - lo >= least and sum(map(len, w[lo:hi])) >= most_words
                if not enough(a, b) or (enough(a, b - 1) and enough(a + 1, b)):
                    if enough(a, b):
                        break
                    continue
                key = tuple(p.strip(" \t\n\v\f\r").translate({k: k + 32 for k in range(65, 91)}) for p in sents[i][a:b])
                runs.setdefault(key, []).append((i, a, b))
    gone = {(i, k) for own in runs.values() for i, a, b in own[1:] for k in range(a, b)}
    return {i: [" ".join(words(p)) for k, p in enumerate(sents[i]) if (i, k) not in gone] for i in sents}


@pytest.mark.parametrize("how", [span_dedup.Spans(), span_dedup.Spans(sentences=2, words=6, marks=".!?")])
def test_spans_equal_plain_version(spark, how):
    import random

    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 7)))
    pool = [line() for _ in range(6)]
    rows = [(i, "".join(rng.choice(pool) + rng.choice([". ", "! ", "\n", "?\n", ", ", ".x "]) for _ in range(rng.randint(0, 25)))) for i in range(80)] + [(80, None), (81, "")]
    got = span_dedup.deduplicated(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS), how).collect()
    want = plain_dedup(rows, how.sentences, how.words, how.marks)
    assert sum(r.n_removed for r in got) > (100 if how.words == 6 else 20)
    for r in got:
        assert words(r.text) == " ".join(want[r.doc_id]).split() and r.n_sentences - r.n_removed == len(want[r.doc_id])


def test_spans_of_the_corpus_equal_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in corpus(spark).collect()]
    got = {r.doc_id: words(r.text) for r in span_dedup.deduplicated(corpus(spark)).collect()}
    how = span_dedup.Spans()
    want = {i: " ".join(x).split() for i, x in plain_dedup(rows, how.sentences, how.words, how.marks).items()}
    assert {i: [w.lower() for w in x] for i, x in got.items()} == {i: [w.lower() for w in x] for i, x in want.items()}


def test_passages_inside_running_text_are_caught(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), rng.integers(2, 9)))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", "", "", ",", "."]) for _ in range(n))
    passages = [text(60) for _ in range(10)]
    rows = [(i, f"{text(80)} {word()} {passages[i % 10]} {text(80)}", "en", "s", 0) for i in range(30)] + [(30 + i, text(300), "en", "s", 0) for i in range(20)]
    got = {r.doc_id: words(r.text) for r in span_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}
    gone = {i: len(words(t)) - len(got[i]) for i, t, *_ in rows}
    # the passage's first and last sentence may run on into the text around it
    assert all(30 <= gone[i] <= 60 for i in range(10, 30)) and np.mean([gone[i] for i in range(10, 30)]) >= 48
    assert not any(gone[i] for i in range(10)) and not any(gone[i] for i in range(30, 50))


def test_long_passages_are_caught_whatever_their_ends(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), rng.integers(2, 9)))
    text = lambda n: " ".join(word() + ("." if rng.random() < 0.03 else "") for _ in range(n))
    passages = [text(60) for _ in range(10)]
    rows = [(i, f"{text(80)} {passages[i % 10]} {text(80)}", "en", "s", 0) for i in range(30)] + [(100 + i, text(300), "en", "s", 0) for i in range(20)]
    got = {r.doc_id: r for r in span_dedup.deduplicated(spark.createDataFrame(rows, DOCS), span_dedup.Spans(one_in=5)).collect()}
    for i in range(10, 30):
        left = words(got[i].text)
        p = words(passages[i % 10])
        runs = [k for k in range(len(left)) if left[k : k + 25] == p[:25] or left[k : k + 25] == p[-25:] or left[k : k + 25] == p[18:43]]
        assert not runs and len(left) >= 150
    assert all(got[100 + i].n_removed == 0 for i in range(20)) and all(got[i].n_removed == 0 for i in range(10))


# co-training


def test_cotraining(spark):
    df, labels = corpus(spark), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in cotrain.classify(df.withColumn("y", F.lit(1)), labels).collect()}
    assert len(got) == df.count() and all(0 <= r.p_good <= 1 for r in got.values())
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect() if r.doc_id in got}
    right = sum(got[i].kept == g for i, g in good.items())
    assert right >= 0.85 * len(good)
    assert sum(got[i].kept for i, g in good.items() if g) >= 0.95 * sum(good.values())


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    hidden = labels.where("doc_id % 4 = 0")
    got = {r.doc_id: r.p_good for r in cotrain.classify(df, labels.where("doc_id % 4 != 0")).collect()}
    truth = [(got[r.doc_id], r.quality == 1 and r.toxic == 0) for r in hidden.collect()]
    pos, neg = [p for p, g in truth if g], [p for p, g in truth if not g]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc > 0.9


def test_cotraining_hangs_on_the_rows_alone(spark):
    df, labels = corpus(spark), spark.read.parquet(f"{SF}/labels.parquet")
    how = cotrain.CoTraining(give=40)
    key = lambda d: sorted((r.doc_id, round(r.p_good, 9), r.kept) for r in cotrain.classify(d, labels, how).collect())
    once = key(df)
    twice = key(df.union(df).repartition(5))
    assert twice[::2] == twice[1::2] and [x[0] for x in twice[::2]] == [x[0] for x in once]


def test_surest_go_in_turn_by_source(spark):
    rows = [(i, "hot" if i < 900 else f"s{i % 3}", float(i % 50) - 20, 0.0) for i in range(1000)] + [(2000, None, 99.0, 0.0)]
    got = cotrain.surest(spark.createDataFrame(rows, "doc_id long, source string, z0 double, z1 double"), 0, 0.8, cotrain.CoTraining(give=50))
    place = {r[0]: r for r in rows}
    good, bad = [i for i, y in got if y], [i for i, y in got if not y]
    assert len(good) == 40 and len(bad) == 10 and 2000 in good
    assert all(place[i][2] >= 2.2 for i in good) and all(place[i][2] <= -2.2 for i in bad)
    assert len({place[i][1] for i in good}) == 5 and sum(place[i][1] == "hot" for i in good) <= 10
    assert cotrain.surest(spark.createDataFrame(rows, "doc_id long, source string, z0 double, z1 double"), 1, 0.8, cotrain.CoTraining()) == []


def test_cotraining_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cotrain.classify(docs(spark, []), labels).count() == 0
    got = cotrain.classify(docs(spark, ODD, extra=True), labels).collect()
    assert len(got) == len(ODD) and all(r.p_good == pytest.approx(0.5) and r.kept for r in got)
    some = spark.createDataFrame([(4, 1, None), (5, 0, 1), (5, None, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert cotrain.classify(docs(spark, ODD), some).count() == len(ODD)


# mixing


def test_targets():
    plan = curriculum.Curriculum()
    got = curriculum.targets([("a", 100), ("b", 100), ("c", 1000), (None, 10)], plan)
    assert [g[0] for g in got] == ["a", "b", "c", None]
    want = 1.5 * 1210
    assert got[0][2] == 200 and got[1][2] == 200 and got[3][2] == 20 and got[2][2] == pytest.approx(want - 420)
    assert curriculum.targets([], plan) == [] and curriculum.targets([("a", 0)], plan)[0][2] == 0


def test_mix(spark):
    df = corpus(spark)
    odd = docs(spark, ODD).select(F.col("doc_id") + 10**6, "text", "lang", "source", "n_chars")
    both = df.union(odd).union(odd).withColumn("taken", F.lit(1))
    rows = {(r.doc_id, r.text): r for r in both.collect()}
    got = curriculum.report(both).collect()
    assert len(got) == both.count()
    texts = {r.doc_id: (r.text, r.source) for r in rows.values()}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        text, source = texts[r.doc_id]
        assert r.size == len(words(text)) and 0 <= r.taken <= 2 * r.size
        size[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
        assert r.source_size >= r.size
    largest = Counter()
    for r in got:
        largest[texts[r.doc_id][1]] = max(largest[texts[r.doc_id][1]], 2 * r.size)
    want = curriculum.targets(sorted(size.items(), key=lambda x: (x[0] is None, x[0] or "")), curriculum.Curriculum())
    for s, n, t, _ in want:
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= largest[s] + 1
    places = [-1.0 if r.first_position is None else r.first_position for r in got]
    assert places == sorted(places)
    key = lambda rs: sorted((r.doc_id, r.taken) for r in rs)
    assert key(got) == key(curriculum.report(both.repartition(7)).collect()) == key(curriculum.report(both, most=1).collect())
    out = curriculum.mixed(both)
    assert out.columns == both.columns
    n = Counter(r.doc_id for r in out.collect())
    for r in got:
        if r.size:
            assert n[r.doc_id] * r.size == sum(x.taken for x in got if x.doc_id == r.doc_id)
    assert curriculum.report(df.where("false")).count() == 0 and curriculum.mixed(df.where("false")).count() == 0


def test_curriculum_moves_sources_in_time(spark):
    df = spark.createDataFrame([(i, "w " * 10, "en", "abc"[i % 3], 20) for i in range(600)], DOCS)
    plan = curriculum.Curriculum(weights=(1.0, 1.0, 1.0), share=0.9, ramps=((1.0, 1.0), (0.0, 2.0), (2.0, 0.0)))
    got = curriculum.placed(df, plan).select("doc_id", F.explode("copies").alias("c")).select("doc_id", "c.position").collect()
    mean = [np.mean([r.position for r in got if r.doc_id % 3 == k]) for k in range(3)]
    assert mean[0] == pytest.approx(0.5, abs=0.03) and mean[1] == pytest.approx(2 / 3, abs=0.03) and mean[2] == pytest.approx(1 / 3, abs=0.03)
    order = [r.doc_id for r in curriculum.mixed(df, plan).collect()]
    place = {r.doc_id: r.position for r in got}
    assert [place[i] for i in order] == sorted(place[i] for i in order)


# page text


def test_blocks():
    page = "<body><div id='x'>a<b>b</b>&amp;c<br>d<!-- no --><script>if (a<b) x()</script>  e<p>f<p>g &lt;h&gt;</div><ul><li>1<li><a href='>'>2</a></ul><p title=\"a>b\">t 1 < 2"
    assert [(b.text, b.tag) for b in html_crf.blocks(page)] == [("ab&c d e", "div"), ("f", "p"), ("g <h>", "p"), ("1", "li"), ("2", "li"), ("t 1 < 2", "p")]
    for bad in ("", "<", "<a", "<!--", "<script>", "</p></div>", "<p " + "a" * 10000, "<" * 2000, "&#xD800;&bogus;"):
        html_crf.blocks(bad)


@pytest.mark.parametrize(("unnamed", "most"), [(0.0, 0.02), (0.33, 0.035), (1.0, 0.07)])
def test_held_out_pages(unnamed, most):
    chain = html_crf.trained()
    wrong = total = 0
    for page, labels in html_crf.labelled_pages(150, 77, unnamed):
        found = html_crf.blocks(page)
        assert len(found) == len(labels)
        got = html_crf.viterbi(chain, [chain.numbers(found)])[0]
        wrong += int((got != np.array(labels)).sum())
        total += len(labels)
    assert wrong <= most * total


def test_elements_without_text_end_where_they_should():
    said = lambda page: [b.text for b in html_crf.blocks(page)]
    for gone in ('<object data="x"/>', "<svg/>", "<svg><path d='M0'/><text>no</text></svg>", "<math><mi>x</mi></math>", "<canvas>no</canvas>", "<template><p>no</p></template>", "<noscript><p>no</p></noscript>", "<iframe src=x/>", "<iframe>no</iframe>", "<script>if (a<b) '</p>'</script>", "<style/>", "<textarea><p>no</textarea>"):
        assert said(f"<article>{gone}<p>one text here.</p></article>") == ["one text here."], gone
    assert said("<div><svg><path></div><p>behind</p>") == ["behind"] and said("<svg><g><p>broke out</p>") == ["broke out"]
    assert said("<p title=it's>hello world</p><p a=\"x>y\" b='>' c>v</p><p q=\"open>w</p>") == ["hello world", "v", "w"]
    assert said("<p>a</p><script>var x = '<p>b</p>'") == ["a"] and said("<object><p>no</p></object>yes") == ["yes"]


#: Pages of layouts that the labelled ones don't have: main text is what stands between [[ and ]].
LAYOUTS = [
    """<html><head><title>T</title></head><body><div id="top"><table width="100%"><tr><td><a href="/">Home</a></td><td><a href="/a">Archive</a></td><td><a href="/b">About us</a></td></tr></table></div>
    <table><tr><td valign="top"><a href="/1">First link</a><br><a href="/2">Second link</a></td><td><h2>[[The long road to the harbour]]</h2><p>[[On the first morning the ships lay still, and nobody spoke of the storm that had taken the northern pier.]]</p><p>[[By noon the wind had turned; men came down from the village with ropes, lanterns and whatever else they could carry.]]</p></td></tr></table><div class="bottom"><p>&copy; 2004 The Harbour Press. All rights reserved.</p></div></body></html>""",
    """<body><header class="site-header"><div class="logo">Daily News</div><nav aria-label="primary"><ul><li><a href="/w">World</a><li><a href="/s">Sport</a><li><a href="/c">Culture</a></ul></nav></header>
    <main><article class="story"><h1>[[Rivers rise after a week of rain]]</h1><p>[[Officials said on Monday that the river had risen by two metres, the highest level since records began.]]</p><figure><img src="x.jpg"></figure><p>[[Residents were asked to move cars and valuables to higher ground before the evening.]]</p><h2>[[What happens next]]</h2><ul><li>[[The dam will be opened in stages, starting at midnight.]]</li><li>[[Schools in three districts stay closed until Thursday.]]</li></ul></article>
    <aside class="related"><h3>Related stories</h3><ul><li><a href="/1">Floods in pictures</a></li><li><a href="/2">How dams work</a></li></ul></aside></main><section class="comments"><h3>2 comments</h3><div class="comment"><p>My cellar is full of water again.</p></div><div class="comment"><p>Stay safe everyone!</p></div></section><footer><p>Contact | Imprint | Privacy</p></footer></body>""",
    """<body><div class="cookie-banner"><p>We use cookies to improve your experience. <a href="#">Accept</a></p></div><div class="wrapper"><div class="content"><div class="post"><h2>[[A simple bread recipe]]</h2><div class="entry"><p>[[Mix flour, water, salt and yeast in a large bowl until no dry flour is left.]]</p><blockquote><p>[[My grandmother always said that patience is the only ingredient that you cannot buy.]]</p></blockquote><p>[[Let it rest for twelve hours, then fold it twice and bake it in a very hot oven.]]</p></div><div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div></div></div><div class="sidebar"><div class="widget"><h3>Search</h3><form><input type="text"><button>Go</button></form></div><div class="widget ad"><p>Buy the best mixer now!</p></div></div></div></body>""",
    """<body><ul class="menu"><li><a href="/">Start</a></li><li><a href="/docs">Docs</a></li></ul><section id="main-content"><h1>[[Reading sensors with two wires]]</h1><p>[[The bus needs only a clock and a data line, which all devices share.]]</p><pre>[[open(bus, address); read(bus, 2); close(bus)]]</pre><p>[[Each device answers to its own address, and stays silent otherwise.]]</p><ol><li>[[Connect both lines to the pull-up resistors.]]</li><li>[[Switch the power on and look for the start signal.]]</li></ol></section><div class="newsletter"><p>Subscribe to our newsletter for weekly updates.</p><form><input name="mail"><button>Subscribe</button></form></div><footer class="page-footer"><ul><li><a href="/imprint">Imprint</a></li><li><a href="/terms">Terms</a></li></ul></footer></body>""",
]


def test_layouts_by_another_hand():
    import re

    chain = html_crf.trained()
    hit = found = wanted = 0
    for page in LAYOUTS:
        want = set(re.findall(r"\[\[(.*?)\]\]", page))
        got = set(html_crf.main_text(chain, [page.replace("[[", "").replace("]]", "")])[0].split("\n")) - {""}
        hit, found, wanted = hit + len(want & got), found + len(got), wanted + len(want)
    assert 2 * hit >= 0.9 * (found + wanted)


def test_extract_long_page_and_empty_table(spark):
    long = "<article>" + "".join(f"<p>Sentence number {i} of a very long page, with some words.</p>" for i in range(20000)) + "</article>"
    schema = "page_id long, url string, html string"
    row = html_crf.extract(spark.createDataFrame([(1, "u", long)], schema)).first()
    assert row.text.count("\n") == 19999 and row.n_chars == len(row.text)
    assert html_crf.extract(spark.createDataFrame([], schema)).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    chain = html_crf.Chain({}, rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    pages = [[rng.integers(0, 9, 3).tolist() for _ in range(n)] for n in (1, 4, 6, 6, 2)] + [[]]
    for p, got in zip(pages, html_crf.viterbi(chain, pages), strict=True):
        def score(y, p=p):
            e = sum(chain.emit[k, a] for fs, a in zip(p, y, strict=True) for k in fs)
            return e + (chain.begin[y[0]] if y else 0) + sum(chain.step[a, b] for a, b in zip(y, y[1:], strict=False))

        best = max((tuple((m >> i) & 1 for i in range(len(p))) for m in range(1 << len(p))), key=score)
        assert tuple(got.tolist()) == best


def test_extract(spark):
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    odd = spark.createDataFrame([(-1, "u", None), (-2, None, ""), (-3, "u", "plain words only here."), (-3, "u", "plain words only here.")], pages.schema)
    got = html_crf.extract(pages.union(odd).withColumn("text", F.lit("x")))
    out = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows) + 4 and out[-1].text == out[-2].text == ""
    for i, page in rows.items():
        body = re.search("(?s)<article>(.*)</article>", page)[1]
        want = [" ".join(__import__("html").unescape(re.sub("</?b>|<br>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert out[i].text == "\n".join(x for x in want if x) and out[i].n_chars == len(out[i].text)
    assert html_crf.extract(pages.where("false")).count() == 0
