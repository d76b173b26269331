"""Best-fit packing of documents into sequences, refined by swaps between underfull bins."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, arrow_map_all, doc_id, keyed, mixed, parts

LIMIT, END = 1024, 2
CHUNK = 1 << 18
#: Pieces that the tokenizer gets at once: what it returns for one takes a kilobyte.
ENCODED = 2000
#: Pieces that are packed together, by one task; a corpus has as many such blocks as it needs. Bins with a free share of at least
#: one in ROOMY go on to another round of blocks, until one block holds them all or a round has half as many as before or more.
BLOCK, ROOMY = 60_000, 64
_END_MARK = 0x10FFFF


def _classes() -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 white space, 4 other, 5 the end mark, 0 where Unicode versions might disagree."""
    from unicodedata import category, ucd_3_2_0

    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if (kind := ucd_3_2_0.category(x := chr(c))) == category(x) and kind[0] != "C":
            out[c] = 3 if kind[0] == "Z" else 1 if kind[0] == "L" else 2 if kind[0] == "N" else 4
    out[[9, 10, 11, 12, 13]] = 3
    out[[0x180E, 0x200B, 0x2060, 0xFEFF]] = 0
    out[_END_MARK] = 5
    return out


class Encoder:
    """Ids of texts, each with END behind it. Pieces that the tokenizer's own splitting rule yields are found for a whole batch at
    once, and the tokenizer sees each distinct piece; what ids a piece has is kept in a table by its 64-bit hash. Texts with
    special tokens or with characters on which splitting rules could differ go to the tokenizer as they are."""

    SLOTS, POOL = 1 << 20, 1 << 22

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = _classes()
        n = 1 << 20
        self.p = np.cumprod(np.r_[np.uint64(1), np.full(n, 0x9E3779B97F4A7C15, np.uint64)])
        self.q = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)])
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.int32)
        self.size = np.zeros(self.SLOTS, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i, j in parts([len(t) for t in texts], CHUNK):
            group = texts[i:j]
            odd = [len(t) > CHUNK or chr(_END_MARK) in t or any(s in t for s in self.special) for t in group]
            plain = [t for t, o in zip(group, odd) if not o]
            found = iter(self._plain(plain))
            for t, o in zip(group, odd):
                made = None if o else next(found)
                yield np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, END], np.uint32) if made is None else made

    def _plain(self, texts: list[str]) -> list[np.ndarray | None]:
        """None where the tokenizer has to see the whole text."""
        if not texts:
            return []
        cp = np.frombuffer(("".join(t + chr(_END_MARK) for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self.classes[cp]
        ends = np.flatnonzero(cls == 5)
        unsure = np.zeros(len(texts), bool)
        unsure[np.searchsorted(ends, np.flatnonzero(cls == 0))] = True
        new = np.r_[True, (cls[1:] != cls[:-1]) | (cls[1:] == 5)]
        word = (cls == 1) | (cls == 2) | (cls == 4)
        after = np.flatnonzero(word[1:] & (cls[:-1] == 3)) + 1  # begins behind white space: one space goes with it, else the last of the run stands alone
        new[after - 1] = True
        new[after[cp[after - 1] == 32]] = False
        # 's 't 'm 'd 're 've 'll at the begin of a piece
        for i in np.flatnonzero((cp == 39) & new & (np.r_[cls[1:], 5] == 1)).tolist():
            tail = cp[i + 1 : i + 3].tolist()
            n = 1 if tail[0] in (115, 116, 109, 100) else 2 if tail in ([114, 101], [118, 101], [108, 108]) else 0
            if n:
                new[i + 1] = False
                new[i + 1 + n] = True
        begins = np.flatnonzero(new)
        stops = np.r_[begins[1:], len(cp)]
        total = np.r_[np.uint64(0), np.cumsum(mixed((cp + np.uint32(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * self.p[: len(cp)])] if len(cp) <= len(self.p) else self._grown(cp)
        h = mixed((total[stops] - total[begins]) * self.q[begins])
        at, size = self._look(h, begins, stops, cp)
        sums = np.r_[0, np.cumsum(size)]
        flat = self.pool[np.repeat(at - sums[:-1], size) + np.arange(sums[-1])]
        cuts = sums[np.searchsorted(begins, ends) + 1]
        made = np.split(flat, cuts[:-1])
        return [None if u else m for u, m in zip(unsure.tolist(), made)]

    def _grown(self, cp: np.ndarray) -> np.ndarray:
        n = 2 * len(cp)
        self.p = np.cumprod(np.r_[np.uint64(1), np.full(n, 0x9E3779B97F4A7C15, np.uint64)])
        self.q = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)])
        return np.r_[np.uint64(0), np.cumsum(mixed((cp + np.uint32(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * self.p[: len(cp)])]

    def _look(self, h: np.ndarray, begins: np.ndarray, stops: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each piece; pieces not in the table are encoded and put there."""
        if self.used > self.POOL:
            self.clear()
        mask = np.uint64(self.SLOTS - 1)
        one, two = (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)
        slot = np.where(self.key[one] == h, one, two)
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            keys, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where = miss[first]
            strings = [cp[a:b].tobytes().decode("utf-32-le", "surrogatepass") if cp[a] != _END_MARK else "" for a, b in zip(begins[where].tolist(), stops[where].tolist())]
            made = []
            for i in range(0, len(strings), ENCODED):
                some = strings[i : i + ENCODED]
                made += [e.ids if s else [END] for e, s in zip(self.tokenizer.encode_batch_fast(some, add_special_tokens=False), some)]
            sizes = np.array([len(m) for m in made])
            flat = np.fromiter((x for m in made for x in m), np.uint32, sizes.sum())
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            ats = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            at[miss], size[miss] = ats[back], sizes[back]
            free = self.key[(keys & mask).astype(np.int64)] == 0
            put = np.where(free, keys & mask, (keys >> np.uint64(32)) & mask).astype(np.int64)
            self.key[put], self.at[put], self.size[put] = keys, ats, sizes
        return at, size


def encoder(path: str) -> Encoder:
    """The worker's encoder: batches and tasks share what it has seen."""
    import sys

    kept = sys.__dict__.setdefault("_tokenpress_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def best_fit(lengths: list[int], limit: int = LIMIT) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = defaultdict(list)
    frees: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect_left(frees, n)
        if k == len(frees):
            b, free = len(bins), limit
            bins.append([])
        else:
            free = frees[k]
            b = by_free[free].pop()
            if not by_free[free]:
                frees.pop(k)
        bins[b].append(i)
        free -= n
        if free:
            if not by_free[free]:
                insort(frees, free)
            by_free[free].append(b)
    return bins


def absorbers(sizes: np.ndarray, free: np.ndarray, bins: np.ndarray, limit: int) -> np.ndarray:
    """[f, w]: in how many ways bins with a free space of 1 to f take weight w, for nothing or for one lighter document. sizes, free:
    of documents in underfull bins and of their bins; bins: the free space of each such bin."""
    delta = np.zeros((limit + 1, 2 * limit + 2), np.int32)
    for f, w in ((bins, np.zeros_like(bins)), (free, sizes)):
        np.add.at(delta, (f, w + 1), 1)
        np.add.at(delta, (f, w + f + 1), -1)
    return delta.cumsum(1)[:, : limit + 1].cumsum(0)


def improve(lengths: list[int], bins: list[list[int]], limit: int = LIMIT) -> list[list[int]]:
    """Empties underfull bins, from the least filled on, by exchanges with bins at least as full: a move, one document for a
    smaller one, two for one, or one for two. Each step carries weight to the fuller bin, so the sum of squared fills only grows
    and the search ends: at the bound that no packing beats, or where no underfull bin has a step left. Which bins have one is
    told for all at once by counts of what other bins take, so bins without cost next to nothing."""
    size = np.asarray(lengths, np.int64)
    if not len(size):
        return bins
    owner = np.empty(len(size), np.int64)
    for b, items in enumerate(bins):
        owner[items] = b
    fill = np.bincount(owner, size, len(bins)).astype(np.int64)
    spare = len(bins) - int(-(-size.sum() // limit))
    bins = [list(b) for b in bins]
    open_items = np.flatnonzero(fill[owner] < limit)

    def shift(item: int, to: int) -> None:
        b = int(owner[item])
        bins[b].remove(item)
        bins[to].append(item)
        owner[item] = to
        fill[b] -= size[item]
        fill[to] += size[item]

    def weights(donor: int) -> Iterator[tuple[tuple[int, ...], int]]:
        mine = sorted(bins[donor], key=lambda i: -size[i])
        yield from (((x,), int(size[x])) for x in mine)
        yield from (((x, y), int(size[x] + size[y])) for k, x in enumerate(mine) for y in mine[k + 1 :])

    def has_step(donor: int, ways: np.ndarray) -> bool:
        free = limit - int(fill[donor])
        own = [0, *(int(size[i]) for i in bins[donor])]
        return any(ways[free, w] > sum(y < w <= y + free for y in own) for _, w in weights(donor) if w <= limit)

    def step(donor: int) -> bool:
        """One exchange that takes weight from the donor, the one that fills its partner most."""
        ys, bs = size[open_items], owner[open_items]
        free = limit - fill[bs]
        fit = (fill[bs] >= fill[donor]) & (bs != donor) & (free > 0)
        for xs, weight in weights(donor):
            room = np.where(fit & (free >= weight), free, limit + 1)
            if len(room) and room.min() <= limit:
                for x in xs:
                    shift(x, int(bs[room.argmin()]))
                return True
        for xs, weight in weights(donor):
            gain = weight - ys
            gain = np.where(fit & (gain > 0) & (gain <= free), gain - free, -limit - 1)  # 0: the partner is full
            if len(gain) and gain[best := int(gain.argmax())] > -limit - 1:
                y, to = int(open_items[best]), int(bs[best])
                for x in xs:
                    shift(x, to)
                shift(y, donor)
                return True
        return False

    while spare > 0:
        alive = np.flatnonzero((fill > 0) & (fill < limit))
        open_items = open_items[fill[owner[open_items]] < limit]
        ways = absorbers(size[open_items], limit - fill[owner[open_items]], limit - fill[alive], limit)
        donor = next((d for d in alive[np.lexsort((alive, fill[alive]))].tolist() if has_step(d, ways)), None)
        if donor is None or not step(donor):
            break
        while fill[donor] and step(donor):
            pass
        spare -= not fill[donor]
    return [b for b in bins if b]


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """did, piece, start, length, ids_crc32, and with keep_ids the ids: every document's ids with END behind them, in one piece, or if
    longer than the limit in pieces of the limit, of which the first has what is over."""
    names = ("did", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        enc = encoder(tokenizer)
        dids, texts = batch["did"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
        out = {k: [] for k in names}
        for did, ids in zip(dids, enc.ids(texts)):
            start, piece = 0, 0
            while start < len(ids):
                n = (len(ids) - 1) % limit + 1 if piece == 0 else limit
                raw = ids[start : start + n].astype("<u4").tobytes()
                for k, v in zip(out, (did, piece, start, n, crc32(raw), raw)):
                    out[k].append(v)
                start, piece = start + n, piece + 1
            if len(out["did"]) > 4000:
                yield out
                out = {k: [] for k in out}
        yield out

    return arrow_map(keyed(docs).select("did", "text"), run, "did long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, keep_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """Packs documents into sequences of at most `limit` tokens.

    docs: doc_id, text; other columns are ignored. tokenizer: path of a tokenizer file, on every executor. Returns a row per
    piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids (little-endian unsigned 32-bit
    integers). A null or empty text is END alone. Equal rows are packed each for itself. An empty table gives none. Pieces are
    packed in blocks of about `block`, whatever their ids, each in the memory of its lengths (with keep_ids, of its ids) alone; bins
    that blocks leave with room meet in further rounds.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    left = scratch.save(pieces(docs, tokenizer, limit, keep_ids).withColumn("_at", F.monotonically_increasing_id()), "pieces")
    schema = "did long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * keep_ids + "_at long, sequence_id long, offset long, roomy boolean"
    count, level, out = left.count(), 0, None
    while True:
        n = max(1, -(-count // block))
        # _at: in the first round a number of the row, then of the bin, whose pieces stay together.
        packed = arrow_map_all(left.repartition(n, F.xxhash64("_at")), _pack_blocks(limit, level), schema)
        packed = scratch.save(packed, f"packed{level}")
        roomy = packed.filter("roomy").count() if n > 1 else 0
        done = packed.filter("not roomy") if 0 < 2 * roomy < count else packed
        out = done if out is None else out.unionByName(done)
        if done is packed:
            break
        left = packed.filter("roomy").select(*left.columns[:-1], F.col("sequence_id").alias("_at"))
        count, level = roomy, level + 1
    return out.select(doc_id(), *[c for c in out.columns if c not in ("did", "_at", "roomy")])


def _pack_blocks(limit: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        first = (level << 56) + (TaskContext.get().partitionId() << 32)
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table)
        table = table.sort_by([("did", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("_at", "ascending")])
        lengths = table["length"].to_pylist()
        small = [i for i, x in enumerate(lengths) if x < limit]
        sizes = [lengths[i] for i in small]
        sequence, offset, roomy = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        packed = improve(sizes, best_fit(sizes, limit), limit)
        if level:
            was = table["_at"].to_pylist()
            bins = defaultdict(list)
            for k, i in enumerate(small):
                bins[was[i]].append(k)
            packed = min(packed, improve(sizes, list(bins.values()), limit), key=len)
        for k, items in enumerate([[small[i] for i in b] for b in packed] + [[i] for i, x in enumerate(lengths) if x == limit]):
            at = 0
            for i in items:
                sequence[i], offset[i] = first + k, at
                at += lengths[i]
            roomy[items] = (limit - at) * ROOMY >= limit
        for k, x in (("sequence_id", sequence), ("offset", offset), ("roomy", roomy)):
            table = table.append_column(k, pa.array(x))
        for b in table.to_batches(max_chunksize=10_000):
            yield {k: b[k] for k in b.schema.names}

    return run
