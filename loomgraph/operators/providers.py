"""Models behind a batched interface: entailment scores and coreference clusters.

A provider is a small picklable object that says how to load a model; the model itself is loaded once
in each Python worker and asked in batches. Anything that answers ``score`` (or ``predict``) can be put
in; ``SharedWords`` stands in for an entailment model and makes no claim to a model's quality.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Models a worker keeps loaded.
HELD = 4
_LOADED: OrderedDict = OrderedDict()


class Entailment(Protocol):
    """What an entailment provider offers: ``key`` names its model, ``load`` gives the scorer of a worker."""

    key: str

    def load(self): ...


def loaded(provider):
    """The provider's model, loaded at most once in this worker; the least recently used of ``HELD`` goes."""
    if provider.key not in _LOADED:
        if len(_LOADED) >= HELD:
            _LOADED.popitem(last=False)
        _LOADED[provider.key] = provider.load()
    _LOADED.move_to_end(provider.key)
    return _LOADED[provider.key]


def entailment_index(labels: dict[int, str] | list[str]) -> int:
    """The place of the entailment label among a model's labels; an error where none or several fit."""
    named = dict(enumerate(labels)) if isinstance(labels, list) else {int(k): v for k, v in labels.items()}
    fit = [k for k, v in named.items() if "entail" in v.lower() and not re.search(r"not|non|contra", v.lower())]
    if len(fit) != 1:
        raise ValueError(f"no single entailment label among {sorted(named.values())}")
    return fit[0]


@dataclass(frozen=True)
class SharedWords:
    """The share of a hypothesis' words that the premise has, spread over -2..2."""

    key: str = "shared-words"

    def load(self):
        words = lambda t: set(filter(None, re.split(r"[\W_]+", (t or "").lower())))

        def score(premises: list[str], hypotheses: list[str]) -> np.ndarray:
            return np.array([4.0 * len(words(h) & words(p)) / max(len(words(h)), 1) - 2.0 for p, h in zip(premises, hypotheses)])

        return score


@dataclass(frozen=True)
class OnnxEntailment:
    """A sequence-pair classifier in ONNX with a tokenizer file, both in a folder that every executor reads."""

    model: str
    tokenizer: str
    labels: tuple[str, ...]
    max_length: int = 512

    @property
    def key(self) -> str:
        return f"{self.model}|{self.tokenizer}|{self.max_length}"

    def load(self):
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(self.model, providers=onnxruntime.get_available_providers())
        tokenizer = Tokenizer.from_file(self.tokenizer)
        tokenizer.enable_truncation(self.max_length)
        tokenizer.enable_padding()
        at, wanted = entailment_index(list(self.labels)), {i.name for i in session.get_inputs()}

        def score(premises: list[str], hypotheses: list[str]) -> np.ndarray:
            coded = tokenizer.encode_batch(list(zip(premises, hypotheses)))
            feed = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": np.array([c.attention_mask for c in coded], np.int64), "token_type_ids": np.array([c.type_ids for c in coded], np.int64)}
            return session.run(None, {k: v for k, v in feed.items() if k in wanted})[0][:, at]

        return score


def in_batches(score, premises: list[str], hypotheses: list[str], size: int) -> np.ndarray:
    """Scores of pairs, asked in batches of like lengths so that little is padded; each distinct pair is asked once."""
    pairs = list(zip(premises, hypotheses))
    distinct = sorted(set(pairs), key=lambda p: (len(p[0]) + len(p[1]), p))
    known: dict[tuple[str, str], float] = {}
    for k in range(0, len(distinct), size):
        part = distinct[k:k + size]
        known.update(zip(part, np.asarray(score([p for p, _ in part], [h for _, h in part]), np.float64).tolist()))
    return np.array([known[p] for p in pairs], np.float64)


def entailment_logit(premise: Column, hypothesis: Column, provider: Entailment, batch: int = 64) -> Column:
    """Entailment logits of pairs under a provider; null texts count as empty."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = loaded(provider)
        for left, right in parts:
            yield pd.Series(in_batches(score, left.fillna("").tolist(), right.fillna("").tolist(), batch), dtype="float64")

    return scored(premise, hypothesis)


def entailment_logits(premise: Column, hypotheses: Column, provider: Entailment, batch: int = 64) -> Column:
    """The logits of one premise with each of an array of hypotheses, in order; null arrays stay null.

    A row's hypotheses stay in the row, so a softmax over them needs no shuffle.
    """

    @F.pandas_udf("array<double>")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = loaded(provider)
        for left, lists in parts:
            sizes = [0 if x is None else len(x) for x in lists]
            flat = in_batches(score, [p or "" for p, n in zip(left, sizes) for _ in range(n)], [h or "" for x in lists if x is not None for h in x], batch)
            ends = np.cumsum([0, *sizes])
            yield pd.Series([None if x is None else flat[a:b] for x, a, b in zip(lists, ends, ends[1:])])

    return scored(premise, hypotheses)


# Coreference


def offset_clusters(prediction: dict) -> list[list[tuple[int, int]]]:
    """The clusters of a model's output as lists of (start, end); a lone pair is a cluster of one mention.

    Mentions may be pairs or objects with start/start_token and end/end_token; anything else raises.
    """
    raw = prediction["clusters_token_offsets"]
    lone = lambda v: isinstance(v, (list, tuple)) and len(v) == 2 and all(isinstance(x, int) for x in v)

    def pair(m) -> tuple[int, int]:
        if isinstance(m, dict):
            ends = (m.get("start", m.get("start_token")), m.get("end", m.get("end_token")))
            if None not in ends:
                return int(ends[0]), int(ends[1])
        elif lone(m):
            return int(m[0]), int(m[1])
        raise ValueError(f"no pair of offsets: {m!r}")

    return [[pair(m) for m in ([c] if lone(c) else c)] for c in raw]


def text_clusters(prediction: dict) -> list[list[str]]:
    """The mentions' texts that come with a prediction, empty where it has none."""
    for name in ("clusters_text_mentions", "clusters_token_text", "clusters_char_text"):
        if prediction.get(name) is not None:
            return [[str(m) for m in c] for c in prediction[name]]
    return []


def plain(text: str) -> str:
    return re.sub(r"\W+", "", text).lower()


def placed_span(start: int, end: int, words: list[str], sentences: list[int], expected: str | None = None, within_sentence: bool = True) -> tuple[int, int] | None:
    """The half-open span a pair of offsets means: the end may be meant inclusively or exclusively.

    The reading whose text is the expected one wins, then one that stays in a sentence, then the
    inclusive one. None where neither lies in the text, or with ``within_sentence`` in one sentence.
    """
    if start < 0 or end < start:
        return None
    readings = [(start, last + 1) for last in ((end, end - 1) if end > start else (end,)) if last < len(words) and (not within_sentence or sentences[start] == sentences[last])]
    if expected is not None:
        for form in (" ".join, lambda ws: plain(" ".join(ws))):  # as written, then by letters and digits alone
            for a, b in readings:
                if form(words[a:b]) == form(expected.split()):
                    return a, b
    same = [r for r in readings if sentences[r[0]] == sentences[r[1] - 1]]
    return (same or readings or [None])[0]


class Coreference(Protocol):
    """What a coreference provider offers: ``load`` gives a function from words by sentence to a prediction."""

    key: str

    def load(self): ...


EXTRACTED = "doc_id bigint, chunk_id string, local_cluster_id bigint, local_start bigint, local_end bigint, text string, head_local_i bigint"


def coreference_mentions(model_input: DataFrame, provider: Coreference, within_sentence: bool = True) -> DataFrame:
    """(doc_id, chunk_id, local_cluster_id, local_start, local_end, text, head_local_i) of a provider over chunks.

    ``model_input``: (doc_id, chunk_id, sentence_index, words); a chunk's limit bounds what a task
    holds of it. Spans that fit neither reading are left out; clusters keep their model's order.
    """
    packed = model_input.groupBy("doc_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", "words"))), lambda s: s["words"]).alias("s"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = loaded(provider)
        for batch in batches:
            rows = []
            for doc, chunk, spoken in zip(*(c.to_pylist() for c in batch.columns)):
                words = [w for s in spoken for w in s]
                numbers = [k for k, s in enumerate(spoken) for _ in s]
                prediction = predict(spoken)
                texts = text_clusters(prediction)
                for c, cluster in enumerate(offset_clusters(prediction)):
                    for m, (a, b) in enumerate(cluster):
                        expected = texts[c][m] if c < len(texts) and m < len(texts[c]) else None
                        span = placed_span(a, b, words, numbers, expected, within_sentence)
                        if span:
                            rows.append((doc, chunk, c, *span, " ".join(words[span[0]:span[1]]), span[1] - 1))
            columns = list(zip(*rows)) or [[]] * 7
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in EXTRACTED.split(", ")])

    return packed.select("doc_id", "chunk_id", "s").mapInArrow(work, EXTRACTED)
