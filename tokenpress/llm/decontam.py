"""Benchmark decontamination: MinHash containment search by item size, then exact containment of shingles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, SLICE, arrow_map, byte_texts, give_back, gram_hashes, parts, small_batches, word_bounds, word_hashes

SHINGLE, CONTAINED = 5, 0.8
CHUNK = 1 << 18
#: Most shingles of test items that are sent to the workers at once; more items make more passes over the documents.
BLOCK = 1 << 20


def shingles(text: bytes, n: int) -> set[bytes]:
    """Distinct shingles, A-Z lowered; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _hashes(buf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begins, ends = word_bounds(buf)
    return gram_hashes(word_hashes(buf, begins, ends), n), begins, ends


class Block:
    """Test items, ready for the search, in size partitions: an item's sketch is its bottom-k MinHash, the k shingles of least hash,
    and k, one more than may be missing, follows its size. A text that contains enough of the item has one of these, so the
    search misses nothing, however long the text is. Items shorter than a shingle are partitions by their number of words."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, contained: float):
        self.n, self.contained, self.items = n, contained, []
        owners: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            mine = shingles(text, n)
            if not mine:
                continue
            words = len(text.split())
            width = min(words, n)
            need = -(-round(contained * len(mine) * 1_000_000) // 1_000_000)
            h = sorted({int(_hashes(np.frombuffer(s, np.uint8), width)[0][0]) for s in mine})
            for x in h[: len(mine) - need + 1]:
                owners[width][x].append(len(self.items))
            self.items.append((item, mine, need))
        self.owners = {w: dict(o) for w, o in owners.items()}

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text, item, shingles shared, shingles of the item."""
        buf = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        begins, ends = word_bounds(buf)
        words = word_hashes(buf, begins, ends)
        candidates: list[set[int]] = [set() for _ in texts]
        for width, owners in self.owners.items():
            h = gram_hashes(words, width)
            known = np.array(sorted(owners), np.uint64)
            bits = np.zeros(1 << 16, bool)
            bits[known >> np.uint64(48)] = True
            maybe = np.flatnonzero(bits[h >> np.uint64(48)])
            place = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            hit = maybe[known[place] == h[maybe]]
            for p, d in zip(hit.tolist(), (np.searchsorted(at, begins[hit], "right") - 1).tolist()):
                candidates[d].update(owners[int(h[p])])
        out = []
        for text, found in zip(texts, candidates):
            rows, own = [], {}
            for i in sorted(found):
                item, mine, need = self.items[i]
                width = len(next(iter(mine)).split())
                if width not in own:
                    w = text.lower().split()
                    own[width] = {b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)}
                shared = len(mine & own[width])
                if shared >= need:
                    rows.append((item, shared, len(mine)))
            out.append(rows)
        return out


def blocks(benchmark: DataFrame, n: int = SHINGLE, contained: float = CONTAINED, most: int = BLOCK) -> Iterator[Block]:
    """The test items in blocks of bounded size, read one partition at a time."""
    batch: list[tuple[int, bytes]] = []
    words = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(LAST)).alias("item_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    for r in rows.distinct().toLocalIterator():
        size = len(bytes(r.text).split())
        if batch and words + size > most:
            yield Block(batch, n, contained)
            batch, words = [], 0
        batch.append((r.item_id, bytes(r.text)))
        words += size
    yield Block(batch, n, contained)


def _search(block: Block, keep: list[str]):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = byte_texts(batch["text"])
        for i, j in parts([len(t) for t in texts], CHUNK):
            found = block.search(texts[i:j])
            yield {k: batch[k].slice(i, j - i) for k in keep} | {"hits": [[{"item_id": a if a != LAST else None, "shared": b, "shingles": c} for a, b, c in rows] for rows in found]}

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """Documents that hold test items: a row per document and item of whose distinct shingles it has at least the share `contained`.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Returns doc_id, item_id, n_shared, n_shingles,
    containment. Words are lowered in A-Z; an item of under n words is one shingle of them all; an item without words is found
    nowhere, and a null or empty text holds nothing. Null ids stay null. Equal items count once; equal documents each have their
    rows. No shuffle of documents: items come to them in blocks of a fixed size.
    """
    out = None
    for block in blocks(benchmark, n, contained):
        hits = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _search(block, ["doc_id"]), "doc_id long, hits array<struct<item_id:bigint,shared:int,shingles:int>>")
        rows = hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", F.col("h.shared").cast("long").alias("n_shared"), F.col("h.shingles").cast("long").alias("n_shingles"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """The documents that hold no test item, all columns as they were. Narrow: each block of items filters in one pass."""
    from pyspark.sql.functions import pandas_udf

    small_batches(docs.sparkSession)
    for block in blocks(benchmark, n, contained):

        @pandas_udf("boolean")
        def holds(text, block=block):
            import pandas as pd

            out = []
            for k in range(0, len(text), SLICE):
                raw = [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in text[k : k + SLICE]]
                for i, j in parts([len(t) for t in raw], CHUNK):
                    out += [bool(x) for x in block.search(raw[i:j])]
            give_back()
            return pd.Series(out, dtype=bool)

        docs = docs.filter(~holds("text"))
    return docs
