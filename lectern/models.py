"""What the engine needs of models, and deterministic stand-ins that need no files."""

from __future__ import annotations

import math
import re
import zlib
from typing import Protocol


class Embedder(Protocol):
    dimension: int

    def embed(self, mode: str, texts: list[str]) -> list[list[float]]:
        """Unit vectors; ``mode`` is ``document`` or ``query``."""


class Reranker(Protocol):
    def score(self, prompt: str, texts: list[str]) -> list[float]:
        """Between 0 and 1, higher for texts that answer the prompt."""


class Tagger(Protocol):
    def tag(self, text: str) -> list[tuple[int, int, str, float]]:
        """``start, stop, label, score`` of each entity, by start, none overlapping."""


def terms(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


class HashingEmbedder:
    """A signed, hashed bag of words."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, mode: str, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for t in terms(text):
                h = zlib.crc32(t.encode())
                v[h % self.dimension] += 1.0 if h >> 31 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class OverlapReranker:
    """The share of the prompt's words that a text has."""

    def score(self, prompt: str, texts: list[str]) -> list[float]:
        want = set(terms(prompt))
        return [len(want & set(terms(t))) / len(want) if want else 0.0 for t in texts]


class CapitalTagger:
    """Runs of capitalised words that do not begin a sentence, or have two words or more."""

    def tag(self, text: str) -> list[tuple[int, int, str, float]]:
        found = re.finditer(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*", text)
        return [(m.start(), m.end(), "category", 0.9) for m in found if " " in m[0] or (m.start() and not re.search(r"[.!?\n]\s*$", text[: m.start()]))]
