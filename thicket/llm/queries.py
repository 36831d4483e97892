"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicket.sources.tables import read_table, spread
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, name))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.quality_rules import verdicts

    return verdicts(table(spark, sf_dir, "documents")).drop("low", "high")


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.curriculum import report

    return report(table(spark, sf_dir, "documents"))


def op2_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.token_group_join import classify

    return classify(table(spark, sf_dir, "documents"))


def op6_cell_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.cell_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "embeddings"))


def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.prefix_targets import digest

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    return digest(rows.union(spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], rows.schema)))


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.merge_dropout import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.span_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "text")


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.maxent_lm import score

    return score(table(spark, sf_dir, "documents"))


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.html_crf import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.cotrain import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 says of the unigram base, which SQL can express."""
    return op4_maxent_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of op5, which SQL can express."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op10, which SQL can express."""
    return op10_curriculum_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def encoding_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of op3's texts, and that all come back from their ids."""
    return op3_merge_dropout(spark, sf_dir).select("doc_id", "n_chars", "lossless")


QUERIES = {f.__name__: f for f in (op1_html_crf, op2_token_group_join, op3_merge_dropout, op4_maxent_lm, op5_quality_rules, op6_cell_dedup, op7_prefix_targets, op8_span_dedup, op9_cotraining, op10_curriculum_mix, lm_base, quality_base, mix_base, encoding_base)}
#: Reachability over links e(a, b), both ways, from every id.
_REACH = "reach AS (SELECT {id} AS id, {id} AS r FROM {table} UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r)"
_LINKS = "e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)"
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


def _jaccard_sql() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS xs FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(xs[i:i + 2], ' ') AS g FROM (SELECT doc_id, xs, unnest(range(1, CASE WHEN len(xs) > 2 THEN len(xs) - 1 WHEN len(xs) > 0 THEN 2 ELSE 1 END)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
{_LINKS}, {_REACH.format(id="doc_id", table="documents")}
SELECT id AS doc_id, coalesce(max(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id"""


def _cosine_sql() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT *, sqrt(list_inner_product(x, x)) AS s FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x) AND a.s > 0 AND b.s > 0 AND list_inner_product(a.x, b.x) / (a.s * b.s) >= 0.98),
{_LINKS}, {_REACH.format(id="vec_id", table="embeddings")},
c AS (SELECT id AS vec_id, min(r) AS component_id FROM reach GROUP BY id), k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)"""


def _chat_sql() -> str:
    from thicket.llm.prefix_targets import CONTROL, OTHER, TAGS

    def escaped(x: str) -> str:
        x = f"replace({x}, chr(92), chr(92) || chr(92))"
        for c in CONTROL:
            x = f"replace({x}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
        return x

    marks = " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, (a, b) in TAGS.items())
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum(CASE {marks} ELSE {sum(map(len, OTHER))} + length({escaped("role")}) END + length({escaped("text")})) OVER (w ROWS UNBOUNDED PRECEDING) AS size
FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(3 + size) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant' OR i = n) AS n_examples FROM s GROUP BY conv_id"""


_SPACE = r"[\x20\x09-\x0D]"
_CASED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _page_sql() -> str:
    """The article of pages as the tables have them: its blocks are paragraphs and a heading, with bold text, line breaks and two kinds of references."""
    block = r"""trim(regexp_replace(replace(replace(regexp_replace(x, '</?b>|<br>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""
    return f"""WITH b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'), lambda x: {block}), lambda x: x <> '') AS xs FROM pages)
SELECT page_id, url, coalesce(array_to_string(xs, chr(10)), '') AS text, length(coalesce(array_to_string(xs, chr(10)), '')) AS n_chars FROM b"""


def _lm_sql() -> str:
    step = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, {step.replace('xor(a, b)', 'xor(a, b) & 255')})), 4294967295)"
    return f"""WITH d AS (SELECT doc_id, {crc} % 10 = 0 AS held_out, {_WORDS} AS xs FROM documents),
c AS (SELECT w, count(*) AS n FROM (SELECT unnest(xs) AS w FROM d WHERE NOT held_out) GROUP BY w),
t AS (SELECT ends, n + ends AS n, v + 1 AS v FROM (SELECT count(*) AS ends FROM d WHERE NOT held_out), (SELECT coalesce(sum(n), 0) AS n, count(*) AS v FROM c)),
k AS (SELECT doc_id, count(c.n) AS known, sum(log10(coalesce(c.n, 0) + 0.1)) AS logs FROM (SELECT doc_id, unnest(xs) AS w FROM d) LEFT JOIN c USING (w) GROUP BY doc_id)
SELECT doc_id, held_out, CAST(len(xs) + 1 AS BIGINT) AS n_tokens, CAST(coalesce(known, 0) + 1 AS BIGINT) AS n_known, CAST(n AS BIGINT) AS train_tokens, round(coalesce(logs, 0) + log10(ends + 0.1) - (len(xs) + 1) * log10(n + 0.1 * (v + 1)), 4) AS base_score FROM d LEFT JOIN k USING (doc_id), t"""


def _quality_sql() -> str:
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_CASED} AS xs FROM documents),
g AS (SELECT doc_id, i, xs[i:i + 2] AS g FROM (SELECT doc_id, xs, unnest(range(1, len(xs) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g), (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, CAST(len(xs) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(xs, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
len(xs) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(xs) AS base_failed FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)"""


def _mix_sql() -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_CASED}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * n / w, source) AS i FROM s),
f AS (SELECT 0::BIGINT AS i, 1.5 * (SELECT sum(n) FROM o) AS left_, (SELECT sum(w) FROM o) AS open_, 0.0::DOUBLE AS got UNION ALL
SELECT o.i, left_ - least(2 * n, left_ * w / open_), open_ - w, least(2 * n, left_ * w / open_) FROM f JOIN o ON o.i = f.i + 1)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(got, 4) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source JOIN f ON f.i = o.i"""


def _span_sql() -> str:
    """Sentences are cut by a mark behind each end; a run is a list of sentences, from the first word of each to its last."""
    from thicket.llm.span_dedup import Spans

    how = Spans()
    cut = rf"replace(regexp_replace(coalesce(text, ''), '([{how.marks}])({_SPACE})', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1))"
    unit = rf"translate(regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH p AS (SELECT doc_id, unnest(xs) AS x, unnest(range(1, len(xs) + 1)) AS k FROM (SELECT doc_id, string_split({cut}, chr(1)) AS xs FROM documents)),
w AS (SELECT *, regexp_matches(x, '[^\x20\x09-\x0D]') AS worded, sum(CASE WHEN regexp_matches(x, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS i FROM p),
-- white space before a sentence's first word belongs to the one before, but for a text's first
q AS (SELECT doc_id, k, CASE WHEN worded AND i > 1 THEN regexp_extract(x, '^{_SPACE}*') ELSE '' END AS lead_, CASE WHEN worded AND i > 1 THEN regexp_replace(x, '^{_SPACE}*', '') ELSE x END AS body, worded, greatest(i, 1) AS i, x FROM w),
raw AS (SELECT doc_id, i, string_agg(y, '' ORDER BY k, z) AS raw FROM (SELECT doc_id, i, k, 1 AS z, body AS y FROM q UNION ALL SELECT doc_id, i - 1, k, 0, lead_ FROM q WHERE lead_ <> '') GROUP BY doc_id, i),
u AS (SELECT doc_id, i, {unit} AS unit, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM q WHERE worded),
d AS (SELECT doc_id, list(unit ORDER BY i) AS units, list(n ORDER BY i) AS ns FROM u GROUP BY doc_id),
r AS (SELECT doc_id, a, b, units, ns FROM (SELECT doc_id, a, units, ns, unnest(range(a + {how.sentences - 1}, least(len(units), a + {how.sentences + how.words}) + 1)) AS b FROM (SELECT doc_id, units, ns, unnest(range(1, len(units) + 1)) AS a FROM d))),
e AS (SELECT doc_id, a, b, units[a:b] AS run FROM r WHERE list_sum(ns[a:b]) >= {how.words} AND NOT (b - a >= {how.sentences} AND list_sum(ns[a:b - 1]) >= {how.words} AND list_sum(ns[a + 1:b]) >= {how.words})),
late AS (SELECT doc_id, a, b FROM e QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM late),
c AS (SELECT raw.doc_id, string_agg(CASE WHEN gone.i IS NULL THEN raw ELSE '' END, '' ORDER BY raw.i) AS text, count(gone.i) AS n FROM raw LEFT JOIN gone USING (doc_id, i) GROUP BY raw.doc_id)
SELECT t.doc_id, coalesce(len(units), 0) AS n_sentences, coalesce(n, 0) AS n_removed, CASE WHEN coalesce(n, 0) = 0 THEN t.text ELSE regexp_replace(c.text, '{_SPACE}+$', '') END AS text FROM documents t LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id)"""


#: SQL for what it can express; the tests hold the others against plain versions.
ORACLES: dict[str, str] = {
    "op1_html_crf": _page_sql(),
    "op2_token_group_join": _jaccard_sql(),
    "op6_cell_dedup": _cosine_sql(),
    "op7_prefix_targets": _chat_sql(),
    "op8_span_dedup": _span_sql(),
    "lm_base": _lm_sql(),
    "quality_base": _quality_sql(),
    "mix_base": _mix_sql(),
    "encoding_base": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, TRUE AS lossless FROM documents",
}
