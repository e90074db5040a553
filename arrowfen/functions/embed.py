"""Text embedders and the column that they fill."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, EmbeddingError, RateLimitedError, UnauthorizedError

#: An embedder maps a text to (vector, tokens or None).
Embedder = Callable[[str], tuple[list[float], int | None]]


def mock() -> Embedder:
    """The text's length in bytes, as a vector of one component."""
    return lambda text: ([float(len(text.encode()))], None)


def hashing(dim: int = 64) -> Embedder:
    """A deterministic bag of hashed words at length 1; runs offline."""

    def embed(text: str) -> tuple[list[float], int | None]:
        out = [0.0] * dim
        words = text.lower().split()
        for w in words:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            out[h % dim] += 1.0 if h >> 63 else -1.0
        length = sum(x * x for x in out) ** 0.5
        return ([x / length for x in out] if length else out), len(words)

    return embed


def _post(url: str, body: dict, key: str | None, timeout: float) -> dict:
    head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        kind = {401: UnauthorizedError, 429: RateLimitedError}.get(e.code, EmbeddingError)
        raise kind(f"{url}: {e.code}") from e
    except (OSError, ValueError) as e:
        raise EmbeddingError(f"{url}: {e}") from e


def data_api(base_url: str, model: str, key: str | None = None, timeout: float = 30.0) -> Embedder:
    """Servers that answer {"data": [{"embedding": [...]}], "usage": {"total_tokens": n}}."""

    def embed(text: str) -> tuple[list[float], int | None]:
        found = _post(f"{base_url.rstrip('/')}/embeddings", {"model": model, "input": text}, key, timeout)
        if not found.get("data"):
            raise EmbeddingError("the answer has no embedding")
        return found["data"][0]["embedding"], (found.get("usage") or {}).get("total_tokens")

    return embed


def prompt_api(base_url: str, model: str, timeout: float = 30.0) -> Embedder:
    """Servers that answer {"embedding": [...]} to {"model", "prompt"}; they count no tokens."""
    return lambda text: (_post(f"{base_url.rstrip('/')}/api/embeddings", {"model": model, "prompt": text}, None, timeout)["embedding"], None)


def embedder(provider: str, model: str = "", base_url: str | None = None, key: str | None = None) -> Embedder:
    """An embedder by provider name, in any case."""
    name = provider.lower()
    if name == "openai":
        if not key:
            raise ConfigError("this provider needs a key")
        return data_api(base_url or "https://api.openai.com/v1", model, key)
    if name == "ollama":
        return prompt_api(base_url or "http://localhost:11434", model)
    if name == "local":
        if not base_url:
            raise ConfigError("this provider needs a base url")
        return data_api(base_url, model)
    if name in ("mock", "hashing"):
        return {"mock": mock, "hashing": hashing}[name]()
    raise ConfigError(f"unknown embedding provider {provider!r}")


def retried(inner: Embedder, retries: int = 3, first: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """Repeats recoverable failures, waiting twice as long each time."""

    def embed(text: str) -> tuple[list[float], int | None]:
        wait = first
        for left in range(retries, -1, -1):
            try:
                return inner(text)
            except Exception as e:
                if not left or not getattr(e, "recoverable", False):
                    raise
            sleep(min(wait, most))
            wait *= 2
        raise AssertionError

    return embed


def remembered(inner: Embedder, capacity: int = 10_000) -> Embedder:
    """Keeps the last used ``capacity`` answers; a repeated text costs no tokens."""
    held: OrderedDict[str, list[float]] = OrderedDict()
    capacity = capacity or 10_000

    def embed(text: str) -> tuple[list[float], int | None]:
        if text in held:
            held.move_to_end(text)
            return held[text], None
        vector, tokens = inner(text)
        held[text] = vector
        if len(held) > capacity:
            held.popitem(last=False)
        return vector, tokens

    return embed


def embedded(df: DataFrame, embed: Embedder, text: str = "text", into: str = "vector") -> DataFrame:
    """``df`` with the vector and token count of each text; every distinct text is embedded once and joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [embed(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(map(float, v)) for v, _ in made], pa.list_(pa.float32())), pa.array([n for _, n in made], pa.int64())], names=["_text", into, "tokens"])

    once = df.select(F.col(text).alias("_text")).where("_text is not null").distinct().mapInArrow(run, f"_text string, {into} array<float>, tokens bigint")
    return df.join(once, df[text] == F.col("_text"), "left").drop("_text")
