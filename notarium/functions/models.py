"""Pluggable models: embedders and metadata extractors as batch functions, with stand-ins that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

METADATA = "type string, domain string, topics array<string>, people array<string>, action_items array<string>, dates map<string,string>"
Embedder = Callable[[list[str]], list[list[float]]]
Extractor = Callable[[list[str]], list[dict | None]]


def hashed_embedder(dimensions: int = 16) -> Embedder:
    """Equal texts, equal unit vectors; nothing else is meant by them."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(hashlib.sha256(f"{k}:{t}".encode()).digest() for k in range(-(-dimensions // 32)))[:dimensions]
            v = [b - 127.5 for b in raw]
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v])
        return out

    return embed


def no_metadata(texts: list[str]) -> list[dict | None]:
    return [None] * len(texts)


def embed_column(embedder: Embedder, text: Column) -> Column:
    """Vectors of a text column, in Arrow batches; null where the embedder fails on a text."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            try:
                yield pd.Series(embedder(s.tolist()))
            except Exception:
                yield pd.Series([_single(embedder, x) for x in s])

    return run(text)


def metadata_column(extractor: Extractor, text: Column) -> Column:
    """Metadata structs of a text column; null where there is none."""

    @F.pandas_udf(METADATA)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [m or {} for m in extractor(s.tolist())]
        names = [x.split()[0] for x in METADATA.split(", ")]
        return pd.DataFrame({n: [r.get(n) for r in rows] for n in names}, dtype=object)

    return run(text)


def _single(f: Embedder, text: str) -> list[float] | None:
    try:
        return f([text])[0]
    except Exception:
        return None
