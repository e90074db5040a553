"""Checks, normalisation and quantisation of vectors and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MAX_BATCH
from ..errors import InvalidRequestError
from .distance import norm

#: The gap after 1 in single precision: ranges below it count as constant.
EPSILON = 1.1920928955078125e-07
MAX_TEXT_BYTES, MAX_NAME_BYTES = 1_000_000, 255


def _bad(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def is_valid_vector(v: Column) -> Column:
    """Not empty, no NaN, no infinity."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, _bad), F.lit(False))


def first_bad_index(v: Column) -> Column:
    """Index from 0 of the first NaN or infinite component; null if none."""
    found = F.filter(F.transform(v, lambda x, i: F.when(_bad(x), i)), lambda i: i.isNotNull())
    return F.get(found, F.lit(0))


def normalized(v: Column) -> Column:
    """The vector at length 1; zeros if its length is 0 or not finite."""
    n = norm(v)
    good = (n > 0) & (n < float("inf"))
    return F.when(good, F.transform(v.cast("array<double>"), lambda x: x / n)).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def has_dimensions(v: Column, d: int) -> Column:
    return F.size(v) == d


def is_valid_text(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).between(1, MAX_TEXT_BYTES), F.lit(False))


def is_valid_name(name: Column) -> Column:
    """1 to 255 bytes of letters, digits, underscores and hyphens."""
    return F.coalesce(F.octet_length(name).between(1, MAX_NAME_BYTES) & name.rlike(r"^[\p{IsAlphabetic}\p{N}_-]+\z"), F.lit(False))


def check_batch_size(n: int, most: int = MAX_BATCH) -> None:
    if not 1 <= n <= most:
        raise InvalidRequestError(f"a batch has 1 to {most} entries, not {n}")


def quantized_int8(v: Column) -> Column:
    """struct(codes, min, max): codes of -127 to 127 over the vector's range; zeros for a constant vector."""
    low, high = F.array_min(v), F.array_max(v)
    span = high.cast("double") - low
    code = lambda x: F.least(F.lit(127), F.greatest(F.lit(-127), F.round((x.cast("double") - low) / span * 254 - 127).cast("int")))
    codes = F.when(span < EPSILON, F.transform(v, lambda x: F.lit(0))).otherwise(F.transform(v, code))
    return F.struct(codes.alias("codes"), low.alias("min"), high.alias("max"))


def dequantized_int8(q: Column) -> Column:
    span = q["max"].cast("double") - q["min"]
    value = lambda c: F.when(span < EPSILON, q["min"].cast("double")).otherwise((c + 127) / F.lit(254.0) * span + q["min"])
    return F.transform(q["codes"], value)


def quantized_blocks(v: Column, blocks: int) -> Column:
    """struct(codes, mins, maxs, dim, blocks): one byte for each component, scaled over its block of components."""
    m = F.greatest(F.lit(1), F.least(F.lit(blocks), F.size(v)))
    width = F.ceil(F.size(v) / m).cast("int")
    starts = F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1)
    part = F.transform(starts, lambda i: F.slice(v, i * width + 1, width))

    def codes(b: Column) -> Column:
        low, high = F.array_min(b).cast("double"), F.array_max(b).cast("double")
        return F.transform(b, lambda x: F.round((x.cast("double") - low) / F.greatest(high - low, F.lit(EPSILON)) * 255).cast("int"))

    mins, maxs = F.transform(part, lambda b: F.array_min(b)), F.transform(part, lambda b: F.array_max(b))
    return F.struct(F.flatten(F.transform(part, codes)).alias("codes"), mins.alias("mins"), maxs.alias("maxs"), F.size(v).alias("dim"), F.size(part).alias("blocks"))


def dequantized_blocks(q: Column) -> Column:
    """The vector of block codes; raises where codes or block bounds are missing."""
    width = F.ceil(q["dim"] / q["blocks"]).cast("int")

    def value(c: Column, i: Column) -> Column:
        k = F.floor(i / width).cast("int")
        low, high = F.get(q["mins"], k).cast("double"), F.get(q["maxs"], k).cast("double")
        return c / F.lit(255.0) * F.greatest(high - low, F.lit(EPSILON)) + low

    whole = (F.size(q["codes"]) == q["dim"]) & (F.size(q["mins"]) >= q["blocks"]) & (F.size(q["maxs"]) >= q["blocks"])
    return F.when(whole, F.transform(q["codes"], value)).otherwise(F.raise_error(F.lit("corrupted block codes")))


def quantized(v: Column, kind: str = "int8", blocks: int = 8) -> Column:
    if kind in ("none", "int8"):
        return quantized_int8(v)
    if kind == "block":
        return quantized_blocks(v, blocks)
    raise InvalidRequestError(f"quantisation {kind!r} isn't supported")


# The dimensions of known embedding models.
MODEL_DIMENSIONS = {
    "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536,
    "nomic-embed-text": 768, "mxbai-embed-large": 1024, "all-minilm": 384,
}


def model_dimensions(model: Column) -> Column:
    return F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("m"), F.lit(d).alias("d")) for k, d in MODEL_DIMENSIONS.items()]), lambda x: x["m"] == model), F.lit(0))["d"]


def quantized_dimensions(q: Column, kind: str = "int8") -> Column:
    """How many components a quantised vector has: its codes, or what block codes declare."""
    return q["dim"] if kind == "block" else F.size(q["codes"])
