"""Model providers behind small protocols, with deterministic offline ones."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ProviderError, one_line
from ..functions.text import tokens

NOT_FOUND = "No passage of the indexed documents answers this."


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


def embed(rows: DataFrame, dim: int = 256, *, text: str = "text", into: str = "embedding", provider: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 32) -> DataFrame:
    """rows with a vector; blank texts are dropped first, by row, so vectors never shift.

    Without a provider: the text's tokens hashed to `dim` signed counts, of unit length.
    """
    own = rows.where(F.trim(F.coalesce(text, F.lit(""))) != "")

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            if provider is not None:
                values = part.tolist()
                yield pd.Series([v for i in range(0, len(values), batch) for v in provider(values[i : i + batch])])
            else:
                yield part.map(lambda t: hashed(t, dim))

    return own.withColumn(into, run(F.col(text) if provider is not None else F.concat_ws(" ", tokens(F.col(text)))))


def hashed(text: str, dim: int) -> list[float]:
    out = [0.0] * dim
    for token in text.split():
        h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        out[h % dim] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def extract_answer(prompt: str) -> str:
    """An offline generator: the first context sentence that shares most words with the question."""
    context, _, question = prompt.rpartition("\n\nQuestion: ")
    want = set(re.findall(r"\w+", question.lower()))
    lines = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", context) if s.strip() and not re.match(r"\[\d+\]", s.strip())]
    best = max(enumerate(lines), key=lambda x: (len(want & set(re.findall(r"\w+", x[1].lower()))), -x[0]), default=None)
    return best[1] if best else NOT_FOUND


def with_retries(call: Callable[[str], str], attempts: int = 0, delay: float = 0.0, secrets: tuple[str, ...] = ()) -> Callable[[str], tuple[str, str, int]]:
    """call(prompt) -> (answer, error, attempts used); an error never escapes."""

    def run(prompt: str) -> tuple[str, str, int]:
        error = ""
        for n in range(1, attempts + 2):
            try:
                return call(prompt), "", n
            except Exception as e:  # noqa: BLE001  told in the record
                error = one_line(e, secrets)
                if n <= attempts:
                    time.sleep(delay)
        return "", error, attempts + 1

    return run


def rotate(call: Callable[[str, str], str], keys: tuple[str, ...]) -> Generator:
    """A generator that tries its keys in order until one works; keys are masked in the error."""

    def run(prompt: str) -> str:
        errors = []
        for key in keys:
            try:
                return call(prompt, key)
            except Exception as e:  # noqa: BLE001  the next key may work
                errors.append(one_line(e, keys))
        raise ProviderError("; ".join(errors) or "no key is set")

    return run


def first_of(*generators: Generator) -> Generator:
    """The first generator that does not fail."""

    def run(prompt: str) -> str:
        errors = []
        for g in generators:
            try:
                return g(prompt)
            except Exception as e:  # noqa: BLE001  the next one may work
                errors.append(one_line(e))
        raise ProviderError("; ".join(errors))

    return run
