"""Model plug-ins: what embeds, summarises, answers and tokenises.

A model is a plain object with one method; the engine calls it inside Arrow
batches on the executors.  The defaults are deterministic and need no network.
Adapters of hosted and local models import their libraries when first used, once
a Python worker, and raise when a call fails for good.
"""

from __future__ import annotations

import functools
import random
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.functions.text import ANSWER_PROMPT, ANSWER_SYSTEM, CHAT_ANSWER_PROMPT, SEQ2SEQ_PROMPT, SUMMARY_PROMPT, SUMMARY_SYSTEM

try:
    from _md5 import md5  # for short words far faster than the one that goes through a library
except ImportError:
    from hashlib import md5

WORD = re.compile(r"[a-z0-9]+")
#: Bytes of words, a-z and 0-9, as they are; all others as blanks.
_BLANKED = bytes(c if chr(c).isascii() and (chr(c).islower() or chr(c).isdigit()) else 32 for c in range(256))


class EmbeddingModel(ABC):
    @abstractmethod
    def create_embedding(self, text: str) -> list[float]:
        """The text's vector."""

    def create_embeddings(self, texts: list[str]) -> Sequence[Sequence[float]]:
        """The vectors of a batch of texts; models that can work on many at once say how."""
        return [self.create_embedding(t) for t in texts]


class SummarizationModel(ABC):
    @abstractmethod
    def summarize(self, context: str, max_tokens: int = 150) -> str:
        """A summary of the context."""


class QAModel(ABC):
    @abstractmethod
    def answer_question(self, context: str, question: str) -> str:
        """An answer from the context."""


def retried(call: Callable[[], str], attempts: int = 6, least: float = 1.0, most: float = 20.0) -> str:
    """call(), again after random waits of growing bounds; the last error is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            if i == attempts - 1:
                raise
            time.sleep(random.uniform(least, min(most, least * 2 ** (i + 1))))
    raise AssertionError


class HashedEmbedding(EmbeddingModel):
    """Counts of a text's words in dim md5 buckets: integers, so that dot products are exact in any order."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def create_embedding(self, text: str) -> list[float]:
        return self.create_embeddings([text])[0].tolist()

    def create_embeddings(self, texts: list[str]) -> np.ndarray:
        # in lower case a word is a run of ASCII, so that all other bytes can be blanks
        low = pa.array([(t or "").lower().encode("utf-8", "replace").translate(_BLANKED) for t in texts], pa.binary()).cast(pa.string())
        found = pc.ascii_split_whitespace(low)
        words = found.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        first = np.frombuffer(b"".join([md5(w).digest() for w in distinct]), ">u4")[::4].astype(np.int64)
        at, row = words.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(found.offsets.to_numpy()))
        if b"" in distinct:  # blanks at either end of a text leave one
            real = at != distinct.index(b"")
            at, row = at[real], row[real]
        at = (first % self.dim)[at]
        return np.bincount(row * self.dim + at, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(float)


class LeadSummary(SummarizationModel):
    """The first words of each line of the context in turn, max_tokens in all."""

    def summarize(self, context: str, max_tokens: int = 150) -> str:
        lines = [x for x in (context or "").split("\n") if x.strip()]
        if not lines:
            return ""
        share, more = divmod(max_tokens, len(lines))
        # no line is taken apart further than is said of it
        return " ".join(w for i, x in enumerate(lines) for w in x.split(None, share + (i < more))[: share + (i < more)])


class OverlapAnswer(QAModel):
    """The sentence of the context that shares most distinct words with the question, the first of those that tie."""

    def answer_question(self, context: str, question: str) -> str:
        asked = set(WORD.findall((question or "").lower()))
        parts = [s.strip() for s in re.split(r"[.!?\n]", context or "") if s.strip()]
        return max(parts, key=lambda s: len(asked & set(WORD.findall(s.lower()))), default="")


class Hosted:
    """What the adapters of a hosted service share: the model's name, and what gives a client once a worker; every request is retried."""

    #: Where under a client requests of this kind are created.
    under: tuple[str, ...] = ()

    def __init__(self, model: str, client: Callable[[], object] | None = None):
        self.model, self.client = model, client or _hosted

    def request(self, **fields: object) -> object:
        return retried(lambda: functools.reduce(getattr, self.under, self.client()).create(model=self.model, **fields))


class HostedEmbedding(Hosted, EmbeddingModel):
    """An embedding endpoint; newlines are sent as spaces.  A batch of texts is one request."""

    under = ("embeddings",)

    def __init__(self, model: str = "text-embedding-ada-002", client: Callable[[], object] | None = None):
        super().__init__(model, client)

    def create_embedding(self, text: str) -> list[float]:
        return self.create_embeddings([text])[0]

    def create_embeddings(self, texts: list[str], most: int = 256) -> list[list[float]]:
        sent = [t.replace("\n", " ") for t in texts]
        return [d.embedding for lo in range(0, len(sent), most) for d in self.request(input=sent[lo : lo + most]).data]


class SentenceEmbedding(EmbeddingModel):
    """A local sentence encoder; load gives one from its name, once a worker."""

    def __init__(self, model: str = "sentence-transformers/multi-qa-mpnet-base-cos-v1", load: Callable[[str], object] | None = None):
        self.model, self.load = model, load or _encoder

    def create_embedding(self, text: str) -> list[float]:
        return self.load(self.model).encode(text).tolist()

    def create_embeddings(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.load(self.model).encode(texts))


class Chat(Hosted):
    """A chat endpoint: a system's and a user's message, and the reply's text."""

    under = ("chat", "completions")
    system = ""

    def say(self, text: str, **fields: object) -> str:
        turns = {"system": self.system, "user": text}
        return self.request(messages=[{"role": r, "content": c} for r, c in turns.items()], **fields).choices[0].message.content


class ChatSummary(Chat, SummarizationModel):
    """A chat endpoint that is asked for a summary."""

    system = SUMMARY_SYSTEM

    def __init__(self, model: str = "gpt-3.5-turbo", client: Callable[[], object] | None = None):
        super().__init__(model, client)

    def summarize(self, context: str, max_tokens: int = 500) -> str:
        return self.say(SUMMARY_PROMPT.format(context=context), max_tokens=max_tokens)


class CompletionSummary(ChatSummary):
    """The same, with an older model's name."""

    def __init__(self, model: str = "text-davinci-003", client: Callable[[], object] | None = None):
        super().__init__(model, client)


class CompletionAnswer(Hosted, QAModel):
    """A completion endpoint at temperature 0; the answer is stripped."""

    under = ("completions",)

    def __init__(self, model: str = "text-davinci-003", max_tokens: int = 150, client: Callable[[], object] | None = None):
        super().__init__(model, client)
        self.max_tokens = max_tokens

    def answer_question(self, context: str, question: str) -> str:
        return self.request(prompt=ANSWER_PROMPT.format(context=context, question=question), temperature=0, max_tokens=self.max_tokens).choices[0].text.strip()


class ChatAnswer(Chat, QAModel):
    """A chat endpoint at temperature 0; the answer is stripped."""

    system = ANSWER_SYSTEM

    def __init__(self, model: str = "gpt-3.5-turbo", client: Callable[[], object] | None = None):
        super().__init__(model, client)

    def answer_question(self, context: str, question: str) -> str:
        return self.say(CHAT_ANSWER_PROMPT.format(context=context, question=question), temperature=0).strip()


class LargeChatAnswer(ChatAnswer):
    """The same, with a larger model's name."""

    def __init__(self, model: str = "gpt-4", client: Callable[[], object] | None = None):
        super().__init__(model, client)


class Seq2SeqAnswer(QAModel):
    """A local sequence-to-sequence model; load gives (device, tokenizer, model) from its name, by default on a GPU if there is one."""

    def __init__(self, model: str = "allenai/unifiedqa-v2-t5-3b-1363200", load: Callable[[str], tuple] | None = None):
        self.model, self.load = model, load or _seq2seq

    def run_model(self, text: str, **more: object) -> list[str]:
        device, tokenizer, model = self.load(self.model)
        ids = model.generate(tokenizer.encode(text, return_tensors="pt").to(device), **more)
        return tokenizer.batch_decode(ids, skip_special_tokens=True)

    def answer_question(self, context: str, question: str) -> str:
        return self.run_model(SEQ2SEQ_PROMPT.format(question=question, context=context))[0]


@functools.cache
def _hosted() -> object:
    from openai import OpenAI

    return OpenAI()


@functools.cache
def _encoder(name: str) -> object:
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


@functools.cache
def _seq2seq(name: str) -> tuple:
    import torch
    from transformers import T5ForConditionalGeneration, T5Tokenizer

    device = torch.device("cuda" if torch.cuda.is_available() else "cpu")
    return device, T5Tokenizer.from_pretrained(name), T5ForConditionalGeneration.from_pretrained(name).to(device)


def embed(model: EmbeddingModel, text: Column) -> Column:
    """The model's vectors of a text column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            vectors = model.create_embeddings([t or "" for t in b.to_pylist()]) if len(b) else []
            size = np.fromiter(map(len, vectors), np.int32, len(vectors))
            flat = np.concatenate([np.asarray(v, np.float32) for v in vectors]) if size.any() else np.zeros(0, np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<float>")(text)


def summarize(model: SummarizationModel, text: Column, max_tokens: int) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([model.summarize(t or "", max_tokens) for t in b])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(text)


def answer(model: QAModel, context: Column, question: Column) -> Column:
    def run(c: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([model.answer_question(x or "", y or "") for x, y in zip(c, q, strict=True)])

    run.__annotations__ = {"c": pd.Series, "q": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(context, question)
