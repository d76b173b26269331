"""Substring removal by bytes: suffixes sorted block by block, one bucket at a time, with a difference cover."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from .common import doc_id
from .repeats import Bytes, as_runs, met_again, removed, run_hashes

DEPTH = 400
PERIOD = 32
#: Odd values of the bytes in the hashes of windows.
SPREAD = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def difference_cover(v: int) -> list[int]:
    """A small set of residues in which every difference modulo v occurs, found greedily."""
    cover, missing = [0], set(range(1, v))
    while missing:
        best = max((x for x in range(v) if x not in cover), key=lambda x: (len({d for c in cover for d in ((x - c) % v, (c - x) % v)} & missing), -x))
        missing -= {d for c in cover for d in ((best - c) % v, (c - best) % v)}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(PERIOD)
#: For two residues, the least step after which both positions are in the cover.
STEP = np.zeros((PERIOD, PERIOD), np.int64)
for _a, _b in product(range(PERIOD), repeat=2):
    STEP[_a, _b] = min(s for s in range(PERIOD) if (_a + s) % PERIOD in COVER and (_b + s) % PERIOD in COVER)


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def sample_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position of the cover, a rank of the `depth` bytes there (a multiple of PERIOD); -1 elsewhere.

    Steps are whole periods, so that ranks of 32 bytes give ranks of 64, and so on, within the sample alone."""
    n = len(text)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.full(n, -1, np.int64)
    rank[at] = row_ranks(text, at, PERIOD)
    reach = PERIOD
    while reach < depth:
        step = min(reach, depth - reach)
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        rank[at] = _ranked(rank[at] * (len(at) + 2) + after + 1)
        reach += step
    return rank


def row_ranks(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the `width` bytes at each place (zeros beyond the end), in byte order."""
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    rows = np.zeros((len(at), -(-width // 8) * 8), np.uint8)
    rows[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(np.r_[False, (words[1:] != words[:-1]).any(axis=1)][: len(at)])
    return out


def equal_suffixes(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """A class for each start, equal where the next `depth` bytes are equal.

    One bucket, the suffixes that share their first 32 bytes, is sorted at a time, so that no comparison needs more than a
    bucket's positions (the buckets of a block take their rounds side by side). Long ties are settled by the cover sample: for a
    pair of residues some step under 32 leads both suffixes into the sample, whose ranks settle the next whole periods; a rank
    of the tail settles the rest. A ternary partition about a pivot makes these comparisons for a whole bucket at once."""
    if depth < 2 * PERIOD:
        return row_ranks(text, starts, depth)
    whole = (depth - PERIOD) // PERIOD * PERIOD
    ranks = sample_ranks(text, whole)
    prefix, tail = row_ranks(text, starts, PERIOD), row_ranks(text, starts + whole, depth - whole)
    order = np.argsort(prefix, kind="stable")
    cls = np.empty(len(starts), np.int64)
    bounds = np.flatnonzero(np.r_[True, np.diff(prefix[order]) != 0, True])
    single = np.diff(bounds) == 1
    cls[order[bounds[:-1][single]]] = np.flatnonzero(single)
    left = order[np.repeat(~single, np.diff(bounds))]
    bucket = np.repeat(np.flatnonzero(~single), np.diff(bounds)[~single])
    done = len(bounds)
    while len(left):
        first = np.r_[True, bucket[1:] != bucket[:-1]]
        group = np.cumsum(first) - 1
        pivot = left[first][group]
        p, q = starts[left], starts[pivot]
        step = STEP[p % PERIOD, q % PERIOD]
        side = np.sign(ranks[p + step] - ranks[q + step])
        side = np.where(side, side, np.sign(tail[left] - tail[pivot]))
        equal = side == 0
        cls[left[equal]] = done + group[equal]
        done += group[-1] + 1
        key = group[~equal] * 2 + (side[~equal] > 0)
        again = np.argsort(key, kind="stable")
        left, bucket = left[~equal][again], key[again]
    return cls


def _flag(depth: int):
    def flag(rows: list[tuple]) -> dict:
        """Sorts the suffixes of whole buckets; windows in a class of two or more, or in a region with copies, are flagged.

        A window whose hash no other has is equal to none and needs no place in the order: of each region, what lies between its
        first and last other window is sorted. The order decides, not the hashes."""
        sizes = np.array([len(r[4]) for r in rows])
        n = sizes - depth + 1
        of = np.repeat(np.arange(len(rows)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        values = SPREAD[np.frombuffer(b"".join(r[4] for r in rows), np.uint8)]
        met = np.flatnonzero(met_again(run_hashes(values, depth)[(np.cumsum(sizes) - sizes)[of] + at]))
        flagged = np.zeros(len(of), bool)
        if len(met):
            of, at = of[met], at[met]
            new = np.r_[True, of[1:] != of[:-1]]
            group, first, last = np.cumsum(new) - 1, at[new], at[np.r_[new[1:], True]]
            text = np.frombuffer(b"".join(rows[i][4][x : y + depth] for i, x, y in zip(of[new].tolist(), first.tolist(), last.tolist())) + b"\0" * (depth + 2 * PERIOD), np.uint8)
            begin = np.cumsum(last - first + depth) - (last - first + depth)
            cls = _ranked(equal_suffixes(text, begin[group] + at - first[group], depth))
            copies = np.array([r[3] for r in rows])[of]
            # regions with copies are flagged whole, elsewhere
            flagged[met] = (np.bincount(cls, copies)[cls] > 1) & (copies == 1)
        return as_runs(rows, np.split(flagged, np.cumsum(n)[:-1]))

    return flag


def drop_repeated_bytes(docs: DataFrame, depth: int = DEPTH, keep_text: bool = False) -> DataFrame:
    """Cuts each byte covered by a string of `depth` bytes that also starts anywhere else, in the same document too.

    docs: doc_id, text; other columns are ignored. Returns a row per row: doc_id, n_bytes, n_removed, n_spans (maximal runs cut),
    kept_sha256, and with keep_text the bytes that are left. A null text is empty. Cuts may split a character: what is left is
    bytes. Rows equal in doc_id and text are one document and don't cut each other; give them different ids to have them
    compared. An empty table gives none.
    """
    out = removed(docs, Bytes(depth), "other", _flag(depth), keep_text)
    return out.select(doc_id(), out.units.alias("n_bytes"), "n_removed", "n_spans", out.sha.alias("kept_sha256"), *["kept"] * keep_text)
