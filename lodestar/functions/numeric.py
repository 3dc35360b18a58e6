"""Vector, hash and measure functions as column expressions."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import index_tokens


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def all_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def vector_state(vector: Column, dimension: Column, tolerance: float = 1e-3) -> Column:
    """ok, or why a vector is unusable: null, dimension, not_finite, zero or norm."""
    return (
        F.when(vector.isNull(), "null")
        .when(F.size(vector) != dimension, "dimension")
        .when(~all_finite(vector), "not_finite")
        .when(norm(vector) == 0, "zero")
        .when(F.abs(norm(vector) - 1) > tolerance, "norm")
        .otherwise("ok")
    )


def hashed_vector(text: Column, dimension: int = 32) -> Column:
    """The offline encoder: a bag of words hashed into ``dimension`` places, length 1; no word or null: the first unit vector.

    Words are split in the JVM and cross to Python in Arrow batches; each word is hashed once per worker.
    """
    return _encoder(dimension)(index_tokens(text))


def _encoder(dimension: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(tokens: pd.Series) -> pd.Series:
        out = []
        for words in tokens:
            v = np.zeros(dimension)
            if words is not None:
                np.add.at(v, [_place(w, dimension) for w in words], 1.0)
            n = np.sqrt((v * v).sum())
            if n:
                v = v / n
            else:
                v[0] = 1.0
            out.append(v)
        return pd.Series(out)

    return encode


@functools.lru_cache(maxsize=500_000)
def _place(word: str, dimension: int) -> int:
    return int.from_bytes(hashlib.sha256(word.encode()).digest(), "big") % dimension


def word_edits(a: Column, b: Column) -> Column:
    """Edits between two texts as words: each different word becomes one character beyond the first plane, of which there are a
    million, so that the built-in distance counts words. Null texts: null."""
    x, y = (F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)) for t in (a, b))
    known = F.array_distinct(F.concat(x, y))
    letters = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")), "")
    return F.levenshtein(letters(x), letters(y))


def profile_identity(model: Column, revision: Column, dimension: Column, config: Column, modality: Column) -> Column:
    """The identity of an encoder: 24 hexadecimal digits of the digest of its description as JSON with sorted keys."""
    whole = F.to_json(F.struct(F.coalesce(config, F.lit("")).alias("config"), dimension.alias("dimension"), modality.alias("modality"), model.alias("model"), revision.alias("revision")))
    return F.substring(F.sha2(whole, 256), 1, 24)


def clamped_ms(seconds: Column, duration: Column | None = None) -> Column:
    """Seconds as whole milliseconds, cut toward zero, not below 0 and not beyond ``duration`` (milliseconds)."""
    ms = F.greatest(F.lit(0).cast("long"), (seconds * 1000).cast("long"))
    return ms if duration is None else F.least(ms, duration)


def epoch_ns(moment: Column) -> Column:
    """A timestamp as nanoseconds since 1970, to the microsecond."""
    return F.unix_micros(moment) * 1000


def bit_mask(vector: Column) -> Column:
    """A 64-bit hash: bit i is set where element i reaches the mean of the first 64."""
    first = F.slice(vector, 1, 64)
    mean = F.aggregate(first, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(first)
    bits = F.transform(first, lambda x: F.when(x.cast("double") >= mean, "1").otherwise("0"))
    return F.array_join(bits, "")
