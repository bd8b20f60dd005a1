"""Lexicon classification of texts (N15, N16): polarity, label, aspect, confidence and direction.

The rule reads a window of tokens in order and sits behind an Arrow UDF. The lexicon is a parameter; there
is no built-in one. Anything with a method ``classify(text, offsets) -> Verdict`` can take its place (E1).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the rule: the token pattern, reaches in tokens, factors, thresholds and shares.
TOKEN = regex.compile(r"/s\b|\p{Extended_Pictographic}|\?|[\p{L}\p{N}$][\p{L}\p{N}'’\-]*")
LONG, AROUND, NEGATION_REACH, NEGATED = 60, 25, 3, -0.8
SCALE, SARCASTIC, SARCASTIC_ZERO, FAINT, HEDGED, POLAR = 3.0, -0.5, -0.1, 1.5, 0.3, 0.15
BASE, EVIDENCE, STRENGTH, WITHOUT, IF_SARCASTIC, IF_UNCERTAIN = 0.35, 0.45, 0.2, 0.5, 0.5, 0.75
ASPECTS, TERMS = ("investment", "product", "reputation"), 12


@dataclass(frozen=True)
class Lexicon:
    """Lower-case tokens: values, phrases with values, factors of the token before, negators, hedges, marks of sarcasm, and cues of aspects."""

    values: dict[str, float] = field(default_factory=dict)
    phrases: dict[tuple[str, ...], float] = field(default_factory=dict)
    intensifiers: dict[str, float] = field(default_factory=dict)
    negators: frozenset[str] = frozenset()
    hedges: frozenset[str] = frozenset()
    sarcasm: tuple[tuple[str, ...], ...] = ()
    cues: dict[str, frozenset[str]] = field(default_factory=dict)


class Verdict(NamedTuple):
    score: float
    label: str
    aspect: str
    confidence: float
    direction: str | None
    terms: list[str]
    negated: bool
    sarcastic: bool
    uncertain: bool


class Classifier(Protocol):
    def classify(self, text: str | None, offsets: list[int] | None = None) -> Verdict: ...


def _three(x: float) -> float:
    return math.floor(x * 1000 + 0.5) / 1000


class LexiconClassifier:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.by_first: dict[str, list[tuple[tuple[str, ...], float]]] = {}
        for phrase, value in lexicon.phrases.items():
            self.by_first.setdefault(phrase[0], []).append((phrase, value))

    @staticmethod
    def tokens(text: str | None, offsets: list[int] | None) -> list[str]:
        """Tokens of the text; of a long one with mentions, those from before the first to after the last of them."""
        found = [(m.group().lower().replace("’", "'"), m.start()) for m in TOKEN.finditer(text or "")]
        if offsets and len(found) > LONG:
            at = [next((i for i, (_, start) in enumerate(found) if start >= o), len(found) - 1) for o in offsets]
            found = found[max(0, min(at) - AROUND) : max(at) + AROUND + 1]
        return [w for w, _ in found]

    def _factor(self, t: list[str], i: int) -> tuple[float, bool]:
        negated = any(w in self.lexicon.negators or w.endswith("n't") for w in t[max(0, i - NEGATION_REACH) : i])
        strength = self.lexicon.intensifiers.get(t[i - 1], 1.0) if i else 1.0
        return strength * (NEGATED if negated else 1.0), negated

    def classify(self, text: str | None, offsets: list[int] | None = None) -> Verdict:
        """A null text is empty: neutral, without a term."""
        x, t = self.lexicon, self.tokens(text, offsets)
        hits = [(i, p, v) for i, w in enumerate(t) for p, v in self.by_first.get(w, ()) if tuple(t[i : i + len(p)]) == p]
        taken = {j for i, p, _ in hits for j in range(i, i + len(p))}
        hits += [(i, (w,), x.values[w]) for i, w in enumerate(t) if w in x.values and i not in taken]
        factors = [self._factor(t, i) for i, _, _ in hits]
        raw = sum(v * f for (_, _, v), (f, _) in zip(hits, factors, strict=True))
        sarcastic = any(tuple(t[i : i + len(m)]) == m for m in x.sarcasm for i in range(len(t)))
        hedges = sum(w in x.hedges for w in t) + ("?" in t)
        uncertain = hedges >= 2 or (hedges == 1 and abs(raw) < FAINT)
        score = math.tanh(raw / SCALE)
        if sarcastic:
            score = SARCASTIC * score if score else SARCASTIC_ZERO
        counts = {a: sum(w in x.cues.get(a, ()) for w in t) for a in ASPECTS}
        best = max(ASPECTS, key=counts.__getitem__)  # the first of equals
        aspect = best if counts[best] else "general"
        if sarcastic:
            label = "sarcastic"
        elif uncertain and abs(score) < HEDGED:
            label = "uncertain"
        else:
            label = "positive" if score > POLAR else "negative" if score < -POLAR else "neutral"
        confidence = BASE + EVIDENCE * (1 - math.exp(-len(hits) / 2)) + STRENGTH * abs(score)
        confidence *= (IF_SARCASTIC if sarcastic else 1.0) * (IF_UNCERTAIN if uncertain else 1.0)
        if not hits:
            confidence = WITHOUT
        direction = {"positive": "bullish", "negative": "bearish"}.get(label, "neutral") if aspect == "investment" else None
        return Verdict(_three(score), label, aspect, _three(min(1.0, confidence)), direction, [" ".join(p) for _, p, _ in hits][:TERMS], any(n for _, n in factors), sarcastic, uncertain)


VERDICT = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("label", T.StringType()), T.StructField("aspect", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("direction", T.StringType()), T.StructField("terms", T.ArrayType(T.StringType()))]
    + [T.StructField(k, T.BooleanType()) for k in ("negated", "sarcastic", "uncertain")]
)


def classify(text: Column, offsets: Column, classifier: Classifier) -> Column:
    """The verdict on a whole text, or around ``offsets`` (array of int, null for none) where it is long."""

    @F.pandas_udf(VERDICT)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, at in batches:
            yield pd.DataFrame([classifier.classify(t, None if o is None else list(o)) for t, o in zip(texts, at, strict=True)], columns=VERDICT.names)

    return of(text, offsets)
