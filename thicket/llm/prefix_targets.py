"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, its reply as the only trainable text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.scratch import small_batches

#: What opens and closes a turn.  Any other role is spelled out.
TAGS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", "</s>")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
CONTROL = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[/ROLE]", "[/TURN]")
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_UNESCAPE = re.compile(r"\\(.)", re.S)
SCHEMA = "conv_id long, example long, text string, loss_start long, loss_end long, n_turns long"
#: Examples go on in batches of about so many code points at most, or alone.
BATCH = 1 << 22


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of a control string, so that none is left."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, in and after a turn's text."""
    if role in TAGS:
        before, after = TAGS[role]
    else:
        before, after = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    return before, escape(text), after


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example; the inverse of rendering."""
    if not formatted.startswith("<s>"):
        raise ValueError("an example begins with <s>")
    at, turns = 3, []
    while at < len(formatted):
        for role, (before, after) in TAGS.items():
            if formatted.startswith(before, at):
                start = at + len(before)
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no turn begins at {at}")
            start = formatted.index(OTHER[1], at)
            role, after = unescape(formatted[at + len(OTHER[0]) : start]), OTHER[2]
            start += len(OTHER[1])
        end = formatted.index(after, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(after)
    return turns


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, n_turns): an example for each assistant turn, in order.

    Turns are ordered by turn, then role and text where that ties; a null turn
    comes first, a null role or text is empty, a null conv_id is a conversation
    of its own, repeated rows are repeated turns.  text is the formatted prefix
    up to the reply; code points loss_start to loss_end are the reply.  Turns
    behind the last reply, and conversations without one, give one more example
    with an empty loss, so that no turn is lost.  An empty table gives no rows.
    Other columns are not read.  A conversation is read as a stream of its
    sorted turns; only its formatted prefix and a batch of bounded size are held.
    """
    return _turns(conversations).mapInArrow(_expand, SCHEMA)


def _turns(conversations: DataFrame) -> DataFrame:
    rows = small_batches(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now, began = None, False
    prefix, size, turns, number, open_, held = ["<s>"], 3, 0, 0, False, 0

    def close() -> None:
        if began and open_:
            out.append((now, number, "".join(prefix), 0, 0, turns))

    for batch in batches:
        for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not began or conv != now:
                close()
                held += size
                began, now, prefix, size, turns, number = True, conv, ["<s>"], 3, 0, 0
            before, body, after = render(role, text)
            prefix += [before, body, after]
            start = size + len(before)
            size = start + len(body) + len(after)
            turns += 1
            open_ = role != "assistant"
            if not open_:
                prefix = ["".join(prefix)]
                out.append((now, number, prefix[0], start, start + len(body), turns))
                number += 1
                held += size
                if held >= BATCH or len(out) >= 512:
                    yield _batch(out)
                    held = 0
    close()
    yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "example", "text", "loss_start", "loss_end", "n_turns"])
    out.clear()
    return batch


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples), parsed from the formatted examples of each conversation, in any order."""
    return examples.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(_read_back, _DIGEST)


def digest(conversations: DataFrame) -> DataFrame:
    """read_back() of expand(), example by example as they are made: as whole prefixes repeat in every example, what a long conversation expands to is never held, shuffled or written."""
    return _turns(conversations).mapInArrow(lambda batches: _read_back(_expand(batches)), _DIGEST)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now, began, last = None, False, ""
    loss, loss_chars, chars, n = hashlib.sha256(), 0, 0, 0
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]

    def close() -> None:
        if began:
            turns = parse(last)
            sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
            out.append((now, len(turns), sha, loss_chars, loss.hexdigest(), chars, n))

    def batch_of() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        out.clear()
        return done

    for batch in batches:
        for conv, _, text, lo, hi, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not began or conv != now:
                close()
                began, now, loss, loss_chars, chars, n = True, conv, hashlib.sha256(), 0, 0, 0
            part = unescape(text[lo:hi])
            loss.update(part.encode("utf-8", "surrogatepass"))
            loss_chars += len(part)
            chars += len(text)
            n += 1
            last = text
        if len(out) >= 1000:
            yield batch_of()
    close()
    yield batch_of()
