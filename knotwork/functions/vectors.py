"""Vector expressions and the offline hashing embedder."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from time import sleep

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, clip: bool = False) -> Column:
    """Cosine similarity; 0 for a zero vector; ``clip`` limits it to [0, 1]."""
    length = norm(a) * norm(b)
    c = F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) if clip else c


def normalised(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def hashing_embedder(dim: int = 64) -> Callable[[str], list[float]]:
    """Feature hashing of lower-case words to a unit vector; needs no model or network."""

    def embed(text: str) -> list[float]:
        v = np.zeros(dim)
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1 if h >> 63 else -1
        n = math.sqrt(float(v @ v))
        return (v / n if n else v).tolist()

    return embed


def embedded(text: Column, embed: Callable[[str], list[float]] | None = None, chars: int = 8000, tries: int = 3, wait: float = 1.0) -> Column:
    """Vectors of texts from any provider; empty text or a provider that keeps failing gives null."""
    embed = embed or hashing_embedder()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> list[float] | None:
            if not t or not t.strip():
                return None
            for i in range(tries):
                try:
                    return embed(t[:chars])
                except Exception:
                    if i + 1 < tries:
                        sleep(wait)
            return None

        for s in batches:
            yield pd.Series([one(t) for t in s])

    return run(text)
