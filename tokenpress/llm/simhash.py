"""SimHash near-duplicates: segment popcounts as a grid, a range join under Manhattan distance, then an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, Scratch, arrow_map, arrow_map_all, byte_texts, keyed, word_bounds
from .components import components

SHINGLE, BITS = 4, 4
#: The grid's blocks; links of up to BITS bits leave at least BLOCKS - BITS blocks as they are.
BLOCKS = 7
#: Cells with more fingerprints than this are joined through the fingerprints between them instead.
CELL = 1 << 13
STRIDE = 1 << 17
PAIRS = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles, A-Z lowered; bits set in over half the shingles' XXH64 (seed 42). Without words, zero."""
    from xxhash import xxh64_digest

    text = b" ".join(text.lower().split())
    if not text:
        return 0
    begins, ends = word_bounds(np.frombuffer(text, np.uint8))
    k = min(shingle, len(begins))
    begins, ends = begins[: len(begins) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(begins), STRIDE):
        h = b"".join([xxh64_digest(text[a:b], 42) for a, b in zip(begins[i : i + STRIDE], ends[i : i + STRIDE])])
        ones += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(begins)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """did, fp (a long with the bits of the fingerprint) of every whole text."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return arrow_map(keyed(docs).select("did", "text"), lambda b: {"did": b["did"], "fp": [signed(fingerprint(t, shingle)) for t in byte_texts(b["text"])]}, "did long, fp long")


def popcounts(x: F.Column) -> F.Column:
    """The embedding: the number of ones, 0 to 2, in each of 32 segments of two bits, in two bits each. The Manhattan distance of
    two embeddings is at most the Hamming distance of their fingerprints."""
    low, high = x.bitwiseAND(F.lit(PAIRS)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(PAIRS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # low + high, which can't overflow


def block_masks(blocks: int) -> list[int]:
    """The 32 segments in so many blocks of neighbours."""
    edges = [round(32 * i / blocks) for i in range(blocks + 1)]
    return [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:])]


def cells(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Each fingerprint in its grid cells: with a Manhattan distance of at most `bits`, two embeddings agree in at least
    blocks - bits blocks; for each choice of that many blocks, a cell is their part of the embedding."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = block_masks(blocks)
    choices = [sum(c) for c in combinations(masks, blocks - bits)]
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("e").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(choices)))
    return fps.withColumn("e", popcounts(F.col("fp"))).select("fp", F.explode(keys).alias("c")).select(F.col("c.choice").alias("choice"), F.col("c.part").alias("part"), "fp")


def embed(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(PAIRS)) + ((x >> np.uint64(1)) & np.uint64(PAIRS))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of packed embeddings. Segments differ by 0, 1 or 2: by the lower bit, by one more where 0 meets 2."""
    low, high = np.uint64(PAIRS), np.uint64(PAIRS << 1)
    x = a ^ b
    return np.bitwise_count(x & low) + 2 * np.bitwise_count(x & high & ~((x & low) << np.uint64(1)))


def forest(x: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within a cell that connect what its links connect; one row against all later ones at a time. A fingerprint that a
    link has already put in a row's set needs no second link to it."""
    e, root = embed(x), np.arange(len(x))
    for i in range(len(x) - 1):
        near = np.flatnonzero(manhattan(e[i], e[i + 1 :]) <= bits) + i + 1
        near = near[np.bitwise_count(x[near] ^ x[i]) <= bits]
        roots, first = np.unique(root[near], return_index=True)
        new = roots != root[i]
        if new.any():
            yield np.full(new.sum(), i), near[first[new]]
            root[np.isin(root, roots[new])] = root[i]


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in _and_end(batches):
            cols = rest if batch is None else [np.concatenate([r, batch[k].to_numpy()]) for r, k in zip(rest, ("choice", "part", "fp"))]
            if not len(cols[0]):
                continue
            edges = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]), True])
            whole = edges if batch is None else edges[:-1]  # the last cell may go on
            rest = [c[whole[-1] :] for c in cols]
            fp, a, b = cols[2].view(np.uint64), [], []
            sizes = np.diff(whole)
            pairs = np.flatnonzero(sizes == 2)
            i = whole[pairs]
            close = np.bitwise_count(fp[i] ^ fp[i + 1]) <= bits
            close &= manhattan(embed(fp[i]), embed(fp[i + 1])) <= bits
            a.append(fp[i[close]])
            b.append(fp[i[close] + 1])
            for k in np.flatnonzero(sizes > 2).tolist():
                x = fp[whole[k] : whole[k + 1]]
                for p, q in forest(x, bits):
                    a.append(x[p])
                    b.append(x[q])
            yield {"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)}

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _between(bits: int):
    """Each fingerprint, and all that differ from it in up to half as many bits: two are linked if and only if they share one."""
    flips = [0]
    for n in range(1, (bits + 1) // 2 + 1):
        flips += [sum(1 << i for i in c) for c in combinations(range(64), n)]
    flips = np.array(flips, np.uint64)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for x in batch["fp"].to_numpy().view(np.uint64):
            yield {"fp": np.full(len(flips), x).view(np.int64), "mid": (x ^ flips).view(np.int64)}

    return run


def links(fps: DataFrame, scratch: Scratch, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """a, b: links that connect distinct fingerprints just as all pairs of at most `bits` differing bits would.

    A cell is compared in one task, in time but not in memory quadratic, up to CELL fingerprints. In larger cells, two
    fingerprints at most `bits` apart (so this is even) share one that is at most half as far from both: its holders are linked,
    exactly and in proportion to their number. So no cell is cut short."""
    if bits % 2:
        raise ValueError("bits must be even")
    at = scratch.save(cells(fps, bits, blocks), "cells")
    sizes = at.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = scratch.save(sizes, "sizes")
    cold = at.join(sizes.filter(F.col("n") <= CELL), ["choice", "part"]).select("choice", "part", "fp")
    near = arrow_map_all(cold.repartition("choice", "part").sortWithinPartitions("choice", "part", "fp"), _links(bits), "a long, b long")
    dense = at.join(sizes.filter(F.col("n") > CELL), ["choice", "part"]).select("fp").distinct()
    mids = arrow_map(dense, _between(bits), "fp long, mid long")
    low = mids.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("hi")).filter("b < hi").select("mid", "b")
    far = mids.join(low, "mid").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(far).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links documents whose fingerprints differ in at most `bits` bits, and names each document's component.

    docs: doc_id, text; other columns are ignored. Returns a row per row: doc_id, fingerprint (16 lowercase hex digits),
    component_id (smallest doc_id reachable, itself included). A null or empty text has the fingerprint zero and is linked like
    any other. Rows with null doc_id take part; a component of such rows alone has a null id. Equal rows share a component.
    Fingerprints with very many documents count once: links are sought between distinct ones.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.save(fingerprints(docs, shingle), "each")
    one = scratch.save(each.groupBy("fp").agg(F.min("did").alias("low")), "one")
    roots = components(links(one.select("fp"), scratch, bits, blocks), scratch)
    named = one.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = scratch.save(named.join(least, "root").select("fp", "component_id"), "named")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return each.join(named, "fp").select(known("did").alias("doc_id"), hexed, known("component_id").alias("component_id"))
