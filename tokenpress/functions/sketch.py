"""SimHash over FNV-1a of word shingles, as short texts and log lines are compared by it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slicewise
from .words import terms

_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: str) -> int:
    """64-bit FNV-1a over UTF-16 code units."""
    h = _BASIS
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = (h ^ unit) * _PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_of(units: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a of parts of UTF-16 code units: of all parts at once, the first unit, then the second, and so on."""
    size = ends - begins
    order = np.argsort(-size, kind="stable")
    at, size = begins[order], size[order]
    h = np.full(len(at), _BASIS, np.uint64)
    wide, prime = units.astype(np.uint64), np.uint64(_PRIME)
    longest = int(size[0]) if len(size) else 0
    left = np.searchsorted(-size, -np.arange(longest), side="left")  # how many have more units than 0, 1, ...
    for i, n in enumerate(left.tolist()):
        h[:n] ^= wide[at[:n] + i]
        h[:n] *= prime
    out = np.empty_like(h)
    out[order] = h
    return out


def simhashes(texts: list[str], shingle: int = 1) -> np.ndarray:
    """Of each text, the bits that more shingles set than don't, as signed longs; blank text: 0."""
    found = [terms(t.lower()) for t in texts]
    words = [w for f in found for w in f]
    out = np.zeros(len(texts), np.int64)
    if not words:
        return out
    units = np.frombuffer(" ".join(words).encode("utf-16-le", "surrogatepass"), "<u2")
    size = np.fromiter(map(len, words), np.int64, len(words))
    if len(units) != size.sum() + len(words) - 1:  # characters of two units
        size = np.array([len(w.encode("utf-16-le", "surrogatepass")) // 2 for w in words])
    begin = np.cumsum(size + 1) - size - 1
    end = begin + size
    # A shingle is the part from its first word to its last; texts with fewer words have these.
    firsts, lasts, counts, at = [], [], [], 0
    for f in found:
        n, width = len(f), shingle if len(f) >= shingle else 1
        first = np.arange(at, at + n - width + 1) if n else np.zeros(0, np.int64)
        firsts.append(first)
        lasts.append(first + width - 1)
        counts.append(len(first))
        at += n
    h = fnv1a_of(units, begin[np.concatenate(firsts)], end[np.concatenate(lasts)])
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    count = np.array(counts)
    some = np.flatnonzero(count)
    ones = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones > count[some, None], axis=1).view(">i8")[:, 0]
    return out


def simhash_text(text: str, shingle: int = 1) -> int:
    if len(text) > 400:
        return int(simhashes([text], shingle)[0]) & 0xFFFFFFFFFFFFFFFF
    words = terms(text.lower())
    units = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or words
    if not units:
        return 0
    bits = np.unpackbits(np.array([fnv1a(u) for u in units], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, np.int64) > len(units)).tobytes(), "big")


def hamming(a: int, b: int) -> int:
    return (a ^ b).bit_count()


def simhash(text: Column | str, shingle: int = 1) -> Column:
    """As a signed long with the same bits."""

    return slicewise(lambda rows: simhashes([x or "" for (x,) in rows], shingle), "bigint", text)


def similar_pairs(hashes: DataFrame, key: str = "doc_id", value: str = "simhash", bits: int = 3) -> DataFrame:
    """a, b, distance for pairs of distinct fingerprints of rows at most `bits` apart, with their smallest keys: fingerprints are made
    distinct first, then meet in two of bits + 2 blocks that they must share. One of bits + 1 blocks would do, but 16 bits are shared
    by one in 65,536 by chance, so that meetings grow with the square of the rows. The other rows of a fingerprint: see `same_pairs`."""
    dist = F.bit_count(F.col("va").bitwiseXOR(F.col("vb")))
    pairs = _meetings(_classes(_distinct(hashes, key, value), key, value), value, bits).filter((F.col("va") < F.col("vb")) & (dist <= bits))
    return pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), dist.cast("bigint").alias("distance")).distinct()


def _meetings(one: DataFrame, value: str, bits: int) -> DataFrame:
    """ka, va, kb, vb: pairs, either way round, that share two blocks."""
    width = -(-64 // (bits + 2))
    block = lambda i: F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << min(width, 64 - i * width)) - 1))
    bands = F.array(*(F.struct(F.lit(n).alias("i"), F.shiftleft(block(i), width).bitwiseOR(block(j)).alias("v")) for n, (i, j) in enumerate(combinations(range(bits + 2), 2))))
    b = one.select("k", value, F.explode(bands).alias("band"))
    left = b.select("band", F.col("k").alias("ka"), F.col(value).alias("va"))
    right = b.select("band", F.col("k").alias("kb"), F.col(value).alias("vb"))
    return left.join(right, "band")


def _distinct(hashes: DataFrame, key: str, value: str) -> DataFrame:
    return hashes.select(key, value).distinct()


def _classes(rows: DataFrame, key: str, value: str) -> DataFrame:
    # All have rows; without the filter the planner drops the distinct here, and fingerprints are made anew for each side.
    return rows.groupBy(value).agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 0")


def same_pairs(hashes: DataFrame, key: str = "doc_id", value: str = "simhash") -> DataFrame:
    """a, b, distance 0 for every key b of a fingerprint but its smallest, a: which class of `similar_pairs` a row belongs to. As many
    rows as keys at most; all other pairs follow from the two, as members of a class have its distances."""
    rows = _distinct(hashes, key, value)
    shared = _classes(rows, key, value).filter("n > 1").select(F.col(value).alias("_v"), F.col("k").alias("a"))
    d = rows.join(shared, F.col(value) == F.col("_v")).filter(~F.col(key).eqNullSafe(F.col("a")))
    return d.select("a", F.col(key).alias("b"), F.lit(0).cast("bigint").alias("distance"))
