"""Entailment judges over a model backend, and a registry of backends.

The weights are the caller's: a backend is made on the executor by a function that is sent
there, and gives token log-probabilities or logits for a batch. What is here is the rest:
token budgets and prompts, sums of masked log-likelihoods, softmax, verdicts by label name.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np

from factloom.functions.tokens import cut_to_tokens
from factloom.operators.judge import EXAMPLES, question, solved
from factloom.providers import ModelJudge
from factloom.schemas import VERDICTS

LABELS = ("entailment", "contradiction", "neutral")


class Seq2SeqBackend(Protocol):
    """A sequence-to-sequence model: ``max_lengths`` are what its configuration and tokenizer say, best first."""

    max_lengths: list[int | None]

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...

    def label_log_probs(self, prompts: list[str], labels: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (prompts x labels x tokens) of every label's tokens, and which tokens count (labels x tokens)."""


class ClassBackend(Protocol):
    """A pair classifier with its class names in the order of its logits."""

    classes: list[str]

    def logits(self, evidences: list[str], facts: list[str]) -> np.ndarray: ...


def resolve_max_length(candidates: list[int | None], default: int = 512) -> int:
    """The first plausible length (1 to 999,999), else the default."""
    return next((n for n in candidates if isinstance(n, int) and 0 < n < 1_000_000), default)


def masked_log_likelihood(log_probs: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """prompts x labels: the sums of the log-probabilities of the tokens that count."""
    return np.where(mask[None, :, :], log_probs, 0.0).sum(axis=-1)


def softmax_rows(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def truth_scores(probs: np.ndarray, names: list[str] | tuple[str, ...]) -> np.ndarray:
    """P(entailed) - P(contradicted) by the names of the columns; refuses sets of names that lack a verdict."""
    place = {VERDICTS.get(n.lower()): k for k, n in enumerate(names)}
    if not {"entailed", "contradicted", "unknown"} <= set(place):
        raise LookupError(f"unexpected label set: {list(names)}")
    return probs[:, place["entailed"]] - probs[:, place["contradicted"]]


def claim_prompt(backend: Seq2SeqBackend, evidence: str, fact: str, labels: tuple[str, ...], max_length: int, overhead: int, evidence_ratio: float, examples=EXAMPLES) -> str:
    """The prompt of one claim; evidence and fact are cut to their shares of the tokens left beside ``overhead``."""
    if len(labels) != 3:
        raise ValueError(f"expected 3 labels, got {len(labels)}")
    budget = max(0, max_length - max(0, overhead))
    room = int(budget * min(max(evidence_ratio, 0.0), 1.0))
    premise, hypothesis = (cut_to_tokens(t, n, backend.encode, backend.decode) for t, n in ((evidence, room), (fact, budget - room)))
    return f"{solved(examples)}premise: {premise}\nhypothesis: {hypothesis}\n{question(list(labels))}\nanswer:"


def seq2seq_judge(load: Callable[[], Seq2SeqBackend], labels: tuple[str, ...] = LABELS, max_length: int | None = None, overhead: int = 96, evidence_ratio: float = 0.8, batch_size: int = 32) -> ModelJudge:
    """A judge that compares the likelihoods of the three answers."""

    def model() -> Callable[[list[str], list[str]], list[float]]:
        backend = load()
        longest = max_length or resolve_max_length(backend.max_lengths)

        def score(evidences: list[str], facts: list[str]) -> list[float]:
            prompts = [claim_prompt(backend, e, f, labels, longest, overhead, evidence_ratio) for e, f in zip(evidences, facts)]
            return truth_scores(softmax_rows(masked_log_likelihood(*backend.label_log_probs(prompts, labels))), labels).tolist()

        return score

    return ModelJudge(model, batch_size)


def class_judge(load: Callable[[], ClassBackend], batch_size: int = 32) -> ModelJudge:
    """A judge over a pair classifier; the classes are found by name."""

    def model() -> Callable[[list[str], list[str]], list[float]]:
        backend = load()
        return lambda evidences, facts: truth_scores(softmax_rows(np.asarray(backend.logits(evidences, facts), np.float64)), backend.classes).tolist()

    return ModelJudge(model, batch_size)


class Registry:
    """Factories of providers (judges, extractors, embedders, language models) by a part of the model's name.

    The first entry whose pattern stands in the name is taken, whatever the case. Unknown
    names and failing factories raise at once; nothing is cached under another name.
    """

    def __init__(self) -> None:
        self.entries: list[tuple[str, Callable[..., object]]] = []

    def add(self, pattern: str, factory: Callable[..., object]) -> None:
        self.entries.append((pattern.lower(), factory))

    def make(self, name: str, **options: object) -> object:
        for pattern, factory in self.entries:
            if pattern in name.lower():
                return factory(name, **options)
        raise LookupError(f"no provider for {name!r}")
