"""Text embedding: a registry of models, pooling of token vectors, and long texts as the mean of their chunks.

A model is loaded once in each worker. The one that always works is `hashing`: deterministic signed hashing of
words. Backends that need other packages or a network load them on first use and fail then if they are missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashing(dimension: int = 64) -> Embedder:
    """Each word adds 1 or -1 to one component; then unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def pool(tokens: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """Token vectors (texts, tokens, components) to one a text: mean over the mask, max over it, or the first token."""
    m = mask[..., None].astype(float)
    if how == "mean":
        return (tokens * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    if how == "max":
        return np.where(m > 0, tokens, -1e9).max(axis=1)
    if how == "cls":
        return tokens[:, 0]
    raise ValueError(f"pooling must be mean, max or cls, not {how!r}")


def sentence_transformer(name: str) -> Embedder:
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(name)
    return lambda texts: np.asarray(model.encode(texts))


def transformer(name: str, how: str = "mean") -> Embedder:
    import torch
    from transformers import AutoModel, AutoTokenizer

    tokenizer, model = AutoTokenizer.from_pretrained(name), AutoModel.from_pretrained(name)

    def embed(texts: list[str]) -> np.ndarray:
        rows = []
        for text in texts:
            with torch.no_grad():
                x = tokenizer(text, return_tensors="pt", truncation=True)
                rows.append(pool(model(**x).last_hidden_state.numpy(), x["attention_mask"].numpy(), how)[0])
        return np.stack(rows) if rows else np.zeros((0, 0))

    return embed


def remote(name: str, client=None) -> Embedder:
    if client is None:
        from openai import OpenAI

        client = OpenAI()
    return lambda texts: np.array([x.embedding for x in client.embeddings.create(model=name, input=texts).data])


def hub(name: str) -> Embedder:
    import tensorflow_hub

    model = tensorflow_hub.load(name)
    return lambda texts: np.asarray(model(texts))


BACKENDS: dict[str, Callable[..., Embedder]] = {"hashing": hashing, "st": sentence_transformer, "hf": transformer, "openai": remote, "use": hub}


class EmbeddingRegistry:
    def __init__(self):
        self._made: dict[str, tuple[str, dict]] = {}
        self._loaded: dict[str, Embedder] = {}
        self.active: str | None = None

    def add_model(self, name: str, backend: str, /, **options) -> None:
        """Adds or replaces a model; the first one becomes the active one."""
        if backend not in BACKENDS:
            raise ValueError(f"unknown backend {backend!r}")
        self._made[name] = (backend, options)
        self._loaded.pop(name, None)
        self.active = self.active or name

    def list_models(self) -> list[str]:
        return sorted(self._made)

    def set_active_model(self, name: str) -> None:
        if name not in self._made:
            raise KeyError(name)
        self.active = name

    def _model(self, name: str | None) -> Embedder:
        name = name or self.active
        if name not in self._made:
            raise KeyError(f"no model {name!r}")
        if name not in self._loaded:
            backend, options = self._made[name]
            self._loaded[name] = BACKENDS[backend](**options)
        return self._loaded[name]

    def embed_text(self, text: str, model: str | None = None) -> np.ndarray:
        return self._model(model)([text])[0]

    def embed_chunks(self, chunks: list[str], model: str | None = None) -> np.ndarray:
        return self._model(model)(chunks)

    def column(self, text: Column, model: str | None = None, chunk_chars: int | None = None) -> Column:
        """Embeddings of a text column; with chunk_chars, the mean of the unit embeddings of a text's chunks, at unit length."""
        name = model or self.active
        if name not in self._made:
            raise KeyError(f"no model {name!r}")
        backend, options = self._made[name]

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = BACKENDS[backend](**options)
            for texts in batches:
                texts = texts.fillna("")
                if chunk_chars is None:
                    yield pd.Series(list(own(texts.tolist())), dtype=object)
                else:
                    yield pd.Series([long_text(own, t, chunk_chars) for t in texts], dtype=object)

        return embed(text)


def long_text(embed: Embedder, text: str, chunk_chars: int = 200) -> np.ndarray:
    parts = [text[i : i + chunk_chars] for i in range(0, len(text), chunk_chars)] or [""]
    v = embed(parts)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    mean = (v / np.where(n == 0, 1, n)).mean(axis=0)
    size = float(np.linalg.norm(mean))
    return mean / size if size else mean


def default_registry() -> EmbeddingRegistry:
    """The usual names; only `hashing` needs nothing else."""
    r = EmbeddingRegistry()
    r.add_model("hashing", "hashing", dimension=64)
    for name, backend, path in (
        ("mpnet", "st", "sentence-transformers/all-mpnet-base-v2"), ("mini", "st", "sentence-transformers/all-MiniLM-L6-v2"), ("e5", "hf", "intfloat/e5-base-v2"),
        ("instructor", "st", "hkunlp/instructor-large"), ("ada", "openai", "text-embedding-ada-002"), ("use", "use", "https://tfhub.dev/google/universal-sentence-encoder/4"),
    ):
        r.add_model(name, backend, name=path)
    return r
