"""Plug points for services outside the engine, and how Spark calls them: in Arrow batches, with the offline answer where a service fails."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: Sequence[str]) -> list[float]: ...


class Model(Protocol):
    def complete(self, prompt: str) -> str: ...


class Ocr(Protocol):
    def read(self, image: bytes) -> tuple[str, float]: ...


def _in_groups(items: list, size: int) -> Iterator[list]:
    for lo in range(0, len(items), size):
        yield items[lo : lo + size]


def embedded(fragments: DataFrame, embedder: Embedder, size: int = 16, tries: int = 3) -> DataFrame:
    """Adds ``embedding`` in groups of texts; a group that fails every try has none."""
    at = fragments.columns.index("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = []
            for group in _in_groups(pdf.iloc[:, at].fillna("").tolist(), size):
                got = None
                for _ in range(tries):
                    try:
                        got = embedder.embed(group)
                        break
                    except Exception:  # a service may fail in any way
                        continue
                out += got if got is not None else [None] * len(group)
            yield pdf.assign(embedding=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fragments.schema)
    return fragments.mapInPandas(run, f"{fields}, embedding array<double>")


def reranked(hits: DataFrame, query: str, reranker: Reranker, k: int) -> DataFrame:
    """The k best of few hits by a model's score; if it fails, the order by ``score`` stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                scores = reranker.scores(query, pdf["text"].tolist())
            except Exception:  # a service may fail in any way
                scores = [0.0] * len(pdf)
            yield pdf.assign(rerank_score=scores)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    return hits.mapInPandas(run, f"{fields}, rerank_score double").orderBy(F.col("rerank_score").desc(), F.col("score").desc(), "chunk_id").limit(k)


def completed(requests: DataFrame, model: Model, fallback: str = "") -> DataFrame:
    """Adds ``answer`` and ``warning`` to ``(prompt, ...)``; where the model fails, the fallback and why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for prompt in pdf["prompt"]:
                try:
                    rows.append((model.complete(prompt), None))
                except Exception as e:  # a service may fail in any way
                    rows.append((fallback, f"{type(e).__name__}: {e}"))
            yield pdf.assign(answer=[r[0] for r in rows], warning=[r[1] for r in rows])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{fields}, answer string, warning string")


def recognised(pages: DataFrame, ocr: Ocr) -> DataFrame:
    """Adds ``ocr_text, ocr_confidence, failure_reason`` to ``(image, ...)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for image in pdf["image"]:
                try:
                    rows.append((*ocr.read(bytes(image)), None))
                except Exception as e:  # a page that can't be read is a row, not a failed job
                    rows.append(("", 0.0, f"{type(e).__name__}: {e}"))
            yield pdf.assign(ocr_text=[r[0] for r in rows], ocr_confidence=[r[1] for r in rows], failure_reason=[r[2] for r in rows])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInPandas(run, f"{fields}, ocr_text string, ocr_confidence double, failure_reason string")
