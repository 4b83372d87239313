"""Identity hashes as column expressions, tokens of whole batches, and the hashing embedder."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lectern.functions.text import SPARSE_TOKEN

DIMENSION = 768
#: Texts whose tokens are made at a time.
TEXTS = 512
#: Sums held at a time where whole batches are embedded.
SUMS = 1_000_000


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def point_id(c: Column) -> Column:
    """The first 64 bits of the SHA-256 as an unsigned number."""
    return F.conv(F.substring(sha256(c), 1, 16), 16, 10).cast("decimal(20,0)")


def plain_texts(texts: pa.Array) -> list[str]:
    """Strings of a column; what isn't UTF-8 is replaced, a null is empty."""
    return [(b or b"").decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()]


#: The words of SPARSE_TOKEN, whose last alternative is one ideograph.
_WORD, _IDEOGRAPHS = re.compile(SPARSE_TOKEN.rpartition("|")[0], re.ASCII), SPARSE_TOKEN.rpartition("|")[2].strip("[]").split("-")


def token_lists(texts: pa.Array) -> pa.ListArray:
    """text.sparse_tokens of every text, cut out of the bytes of many texts at once.

    A token is an ideograph or a word of ASCII letters, digits and a point, so the two kinds are found apart; none spans the
    line end between two texts.
    """
    first, last = map(ord, _IDEOGRAPHS)
    parts = [pa.array([], pa.list_(pa.string()))]
    each = plain_texts(texts)
    for at in range(0, len(each), TEXTS):
        some = each[at : at + TEXTS]
        line = "\n".join(some)
        codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        spans = np.array([m.span() for m in _WORD.finditer(line)], np.int64).reshape(-1, 2)
        begins = (codes >= first) & (codes <= last)
        edges = np.bincount(spans[:, 0], minlength=len(codes) + 1) - np.bincount(spans[:, 1], minlength=len(codes) + 1)
        within = begins | (np.cumsum(edges)[: len(codes)] > 0)
        begins[spans[:, 0]] = True
        width = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
        data = np.frombuffer(line.encode("utf-8"), np.uint8)[np.repeat(within, width)]
        data = np.where((data >= ord("A")) & (data <= ord("Z")), data | 32, data).astype(np.uint8)
        ends = np.cumsum(width * within)
        starts = np.flatnonzero(begins)
        offsets = np.append(ends[starts] - width[starts], len(data)).astype(np.int32)
        values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        rows = np.searchsorted(starts, np.append(0, np.cumsum([len(t) + 1 for t in some])))
        parts.append(pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), values))
    return pa.concat_arrays(parts)


def tokenizer():
    """A vectorised function from a text to its tokens."""

    @arrow_udf(T.ArrayType(T.StringType()))
    def tokenize(texts: pa.Array) -> pa.Array:
        return token_lists(texts)

    return tokenize


@lru_cache(1 << 16)
def place(token: str, by: str) -> tuple[int, float]:
    """A token's number, of which the bucket is the rest, and its sign.

    blake2b: number from the first four bytes, little end first, sign from the fifth.  md5: number from the first three
    bytes, big end first, sign from the fourth, which SQL can compute as well.
    """
    if by == "md5":
        d = md5(token.encode("utf-8"), usedforsecurity=False).digest()
        at, sign = int.from_bytes(d[:3], "big"), d[3]
    else:
        d = blake2b(token.encode("utf-8"), digest_size=8).digest()
        at, sign = int.from_bytes(d[:4], "little"), d[4]
    return at, 1.0 if sign % 2 == 0 else -1.0


def bucket_sums(tokens, dimension: int = DIMENSION, by: str = "blake2b") -> np.ndarray:
    """The signed sum of hashed tokens; the zero vector without tokens."""
    v = np.zeros(dimension, dtype=np.float64)
    for token in tokens:
        at, sign = place(token, by)
        v[at % dimension] += sign
    return v


def hashed_vector(tokens, dimension: int = DIMENSION, by: str = "blake2b") -> np.ndarray:
    """bucket_sums at length 1."""
    v = bucket_sums(tokens, dimension, by)
    n = np.linalg.norm(v)
    return (v / n if n > 0 else v).astype(np.float32)


def places(coded: pa.DictionaryArray, dimension: int = DIMENSION, by: str = "blake2b") -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the sign of each of many tokens; each distinct one is hashed once."""
    each = [place(t, by) for t in coded.dictionary.to_pylist()]
    at = np.array([p % dimension for p, _ in each], dtype=np.int64)
    sign = np.array([x for _, x in each], dtype=np.float64)
    codes = coded.indices.to_numpy()
    return at[codes], sign[codes]


def vectors(tokens: pa.ListArray, dimension: int = DIMENSION, by: str = "blake2b", normed: bool = True) -> pa.ListArray:
    """bucket_sums (or hashed_vector) of every list of tokens.  A null list has no tokens."""
    at, sign = places(tokens.flatten().dictionary_encode(), dimension, by)
    rows = pc.list_parent_indices(tokens).to_numpy()
    out, wide = np.empty((len(tokens), dimension), dtype=np.float32), max(1, SUMS // dimension)
    for first in range(0, len(tokens), wide):
        n = min(wide, len(tokens) - first)
        lo, hi = np.searchsorted(rows, (first, first + n))
        sums = np.bincount((rows[lo:hi] - first) * dimension + at[lo:hi], sign[lo:hi], n * dimension).reshape(n, dimension)
        if normed:
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            sums /= np.where(length > 0, length, 1)
        out[first : first + n] = sums
    return pa.ListArray.from_arrays(np.arange(len(tokens) + 1, dtype=np.int32) * dimension, pa.array(out.ravel()))


def embedder(dimension: int = DIMENSION, by: str = "blake2b", normed: bool = True):
    """A vectorised function from an array of tokens to an array of floats."""

    @arrow_udf("array<float>")
    def embed(tokens: pa.Array) -> pa.Array:
        return vectors(tokens, dimension, by, normed)

    return embed


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
