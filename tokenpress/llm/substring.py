"""Substring removal by words: super-k-mer partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import doc_id
from .repeats import Words, as_runs, met_again, removed, run_hashes, word_bounds, word_hashes

WINDOW = 50


def _flag(k: int):
    def flag(rows: list[tuple]) -> dict:
        """Sorts the windows of whole buckets; those whose sequence has a smaller holder are flagged.

        A window whose hash no other has is equal to none and needs no place in the order; equal strings decide, not hashes."""
        whole = b" ".join(r[4] for r in rows)
        buf = np.frombuffer(whole, np.uint8)
        a, b = word_bounds(buf)
        at = np.searchsorted(a, np.cumsum([0, *(len(r[4]) + 1 for r in rows)]))
        n = np.diff(at) - k + 1
        of = np.repeat(np.arange(len(rows)), n)
        s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[of]
        met = np.flatnonzero(met_again(run_hashes(word_hashes(buf, a, b), k)[s]))
        lows = [r[2] for r in rows]
        windows = [(whole[x:y], lows[i], p) for x, y, i, p in zip(a[s[met]].tolist(), b[s[met] + k - 1].tolist(), of[met].tolist(), met.tolist())]
        windows.sort()
        flagged = np.zeros(len(s), bool)
        last, least = None, 0
        for text, low, p in windows:
            if text != last:
                last, least = text, low
            elif low > least:
                flagged[p] = True
        return as_runs(rows, np.split(flagged, np.cumsum(n)[:-1]))

    return flag


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Cuts each word covered by a window of so many words whose sequence also starts in a document with a smaller doc_id.

    docs: doc_id, text; other columns are ignored. Returns a row per row: doc_id, n_words, n_removed, n_spans, kept_sha256, and
    with keep_text the kept words joined by one space (bytes, UTF-8). A null or empty text has no words. A null doc_id counts as
    the largest; rows that share doc_id never cut each other. Texts shorter than the window stay whole. An empty table gives
    none.
    """
    out = removed(docs, Words(window), "smaller", _flag(window), keep_text)
    return out.select(doc_id(), out.units.alias("n_words"), "n_removed", "n_spans", out.sha.alias("kept_sha256"), *["kept"] * keep_text)
