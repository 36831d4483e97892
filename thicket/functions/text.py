"""Text columns: sentences, token counts, chunks, contexts and prompts.

All are built-in expressions, so they run inside the JVM next to the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that Python's str.strip() and str.split() know, as a regex class body.
BLANK = r"\t\n\x0B\x0C\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The line breaks of str.splitlines().
BREAKS = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Where sentences, and the parts of a long one, are cut.
SENTENCE, CLAUSE = r"[.!?\n]", r"[,;:]"

#: A token: a run of non-blanks.  Graphic ASCII and the letters up to U+167F, none of which is blank, are tested first, as two ranges cost far less than the whole class.
TOKEN = rf"(?:[!-~\x{{C0}}-\x{{167F}}]++|[^{BLANK}])++"

#: What hosted models are told and asked.
SUMMARY_SYSTEM = "You are a helpful assistant."
ANSWER_SYSTEM = "You are Question Answering Portal"
SUMMARY_PROMPT = "Write a summary of the following, including as many key details as possible: {context}:"
ANSWER_PROMPT = "using the folloing information {context}. Answer the following question in less than 5-7 words, if possible: {question}"
CHAT_ANSWER_PROMPT = "Given Context: {context} Give the best full answer amongst the option to question {question}"
SEQ2SEQ_PROMPT = "{question} \\n {context}"


def token_count(text: Column) -> Column:
    """The default tokenizer's count: runs of non-blanks."""
    return F.regexp_count(text, F.lit(TOKEN))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def sentences(text: Column) -> Column:
    """The non-blank sentences of a text, delimiters dropped, blanks around them kept; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE, -1), lambda s: s.rlike(f"[^{BLANK}]"))


def subsentences(sentence: Column) -> Column:
    """The stripped, non-empty clauses of a sentence."""
    return F.filter(F.transform(F.split(sentence, CLAUSE, -1), strip), lambda s: s != "")


def _counted(pieces: Column) -> Column:
    """Each piece with its token count, so that a fold doesn't count again."""
    return F.transform(pieces, lambda s: F.struct(s.alias("s"), token_count(s).alias("c")))


def _pack(pieces: Column, most: int, overlap: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Packs pieces(s, c) in order into chunks(text, n_tokens) of at most ``most`` tokens, a lone piece excepted; joined by a space, so that counts add up.

    With overlap, a chunk begins with the last so many pieces of the one before.
    ``keep`` turns a piece over the limit into chunks of its own instead, put out
    at once while the pending buffer stays as it is.
    """
    none = F.array().cast("array<struct<text:string,n_tokens:int>>")
    chunk = lambda text, n: F.array(F.struct(text.alias("text"), n.alias("n_tokens")))
    if overlap:
        empty = F.struct(none.alias("chunks"), F.array().cast("array<struct<s:string,c:int>>").alias("buf"))
        spent = lambda a: F.aggregate(a["buf"], F.lit(0), lambda n, p: n + p["c"])
        said = lambda a: chunk(F.array_join(F.transform(a["buf"], lambda p: p["s"]), " "), spent(a))
        held = lambda a: F.size(a["buf"]) > 0
        more = lambda a, x: F.struct(a["chunks"].alias("chunks"), F.concat(a["buf"], F.array(x)).alias("buf"))
        fresh = lambda a, x: F.struct(F.concat(a["chunks"], said(a)).alias("chunks"), F.concat(F.slice(a["buf"], F.greatest(F.lit(1), F.size(a["buf"]) - (overlap - 1)), F.lit(overlap)), F.array(x)).alias("buf"))
        own = lambda a, x: F.struct(F.concat(a["chunks"], keep(x["s"])).alias("chunks"), a["buf"].alias("buf"))
    else:
        empty = F.struct(none.alias("chunks"), F.lit(None).cast("string").alias("buf"), F.lit(0).alias("n"))
        spent = lambda a: a["n"]
        said = lambda a: chunk(a["buf"], a["n"])
        held = lambda a: a["buf"].isNotNull()
        more = lambda a, x: F.struct(a["chunks"].alias("chunks"), F.concat_ws(" ", a["buf"], x["s"]).alias("buf"), (a["n"] + x["c"]).alias("n"))
        fresh = lambda a, x: F.struct(F.concat(a["chunks"], said(a)).alias("chunks"), x["s"].alias("buf"), x["c"].alias("n"))
        own = lambda a, x: F.struct(F.concat(a["chunks"], keep(x["s"])).alias("chunks"), a["buf"].alias("buf"), a["n"].alias("n"))

    def add(a: Column, x: Column) -> Column:
        step = F.when(held(a) & (spent(a) + x["c"] > most), fresh(a, x)).otherwise(more(a, x))
        return step if keep is None else F.when(x["c"] > most, own(a, x)).otherwise(step)

    return F.aggregate(pieces, empty, add, lambda a: F.when(held(a), F.concat(a["chunks"], said(a))).otherwise(a["chunks"]))


def counted_chunks(text: Column, max_tokens: int = 100, overlap: int = 0) -> Column:
    """The chunks(text, n_tokens) of a text, in order of emission; tokens are counted once, sentence by sentence.

    Sentences are packed greedily.  One that alone exceeds max_tokens is packed
    by its clauses and put out before the sentences that are still pending, so
    that chunk order may differ from text order; a clause that alone exceeds it
    becomes a chunk over the limit.  Null and blank texts have no chunks.
    """
    return _pack(_counted(sentences(text)), max_tokens, overlap, lambda s: _pack(_counted(subsentences(s)), max_tokens, overlap))


def split_text(text: Column, max_tokens: int = 100, overlap: int = 0) -> Column:
    """The texts of the chunks alone."""
    return F.transform(counted_chunks(text, max_tokens, overlap), lambda c: c["text"])


def one_line(text: Column) -> Column:
    """Lines joined by spaces; a final line break is dropped."""
    broken = F.regexp_replace(F.regexp_replace(text, f"(?:{BREAKS})$", ""), BREAKS, " ")
    return F.when(text.rlike(BREAKS.partition("|")[2]), broken).otherwise(text)  # most have none, and to see that is far less work


def context(text: Column, order: Column) -> Column:
    """Aggregate: each text on one line and a blank line behind it, in order; no rows give an empty text."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), one_line(F.coalesce(text, F.lit(""))).alias("t"))))
    return F.concat_ws("", F.transform(parts, lambda p: F.concat(p["t"], F.lit("\n\n"))))


def flat_context(text: Column, order: Column) -> Column:
    """Aggregate: texts one behind the other, nothing between."""
    return F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda p: p["t"]))


def spaced(text: Column) -> Column:
    """Newlines as spaces, as hosted embedders want."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def prompt(template: str, **columns: Column) -> Column:
    """A template with its {names} replaced by columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        said, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(said), columns[name]]
    return F.concat(*parts, F.lit(rest))
