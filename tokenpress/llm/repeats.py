"""Windows that start at two places of a corpus: the common frame of substring removal by words and by bytes.

Every window of K units has a minimiser, the least hash among its grams. Equal windows have equal minimisers, so
consecutive windows with one minimiser (a region, a super-k-mer) can go to that minimiser's bucket as one packed string.

1. One pass finds the regions of each document: an integer row each. Minimisers found once in the corpus are done.
2. Documents with other regions are kept aside, and a digest of each region's packed string pre-aggregates equal regions:
   however many documents hold a copy, one of them stands for all.
3. Only minimisers with two or more different regions send packed strings to their bucket, where windows are compared.
   A minimiser with more than HOT windows is instead cut into regions of longer grams; what these leave is spread over the
   cluster by the windows' digests.
4. Flagged runs of windows go back to their documents, which cut the units under them.

Grams are a quarter or a third of a window: short ones (four words, 32 bytes) meet by chance, the more the larger the corpus, and
make buckets of windows that have nothing else in common.

No step gathers a group of unbounded size: groups meet in aggregations with partial results, and in joins that may split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, arrow_map_all, byte_texts, keyed, mixed, parts, powers, word_bounds, word_hashes

CHUNK = 1 << 20
#: Most windows, and most units, of one minimiser that a bucket's task compares by itself.
HOT, HOT_UNITS = 1 << 16, 1 << 21
REGION = "mini long, start int, n int, times int"


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n, k = len(a) - w + 1, 1
    while 2 * k <= w:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[:n], a[w - k : w - k + n])


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of each k consecutive values, from prefix sums: its cost doesn't depend on k."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    p, q = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mixed((total[k:] - total[:-k]) * q[: len(h) - k + 1])


def met_again(h: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Words:
    """Units are words; the packed string has them joined by one space."""

    name = "words"

    def __init__(self, k: int, gram: int = 0):
        self.k, self.gram = k, gram or max(1, k // 4)

    def chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Gram hashes over the texts together, and where each text's units begin and end."""
        buf = np.frombuffer(b"\n".join(texts), np.uint8)
        begins, ends = word_bounds(buf)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return run_hashes(word_hashes(buf, begins, ends), self.gram), np.searchsorted(begins, at)

    def packed(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normal form, and each unit's begin and end in it."""
        text = b" ".join(text.split())
        return text, *word_bounds(np.frombuffer(text, np.uint8))

    def kept(self, text: bytes, covered: np.ndarray | None) -> tuple[int, bytes]:
        words = text.split()
        return len(words), b" ".join(words if covered is None else [w for w, c in zip(words, covered.tolist()) if not c])

    def count(self, text: bytes) -> int:
        return len(text.split())


class Bytes:
    """Units are the bytes of UTF-8."""

    name = "bytes"

    def __init__(self, k: int, gram: int = 0):
        self.k, self.gram = k, gram or max(8, min(128, k // 3))

    def chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf = b"".join(texts)
        at = np.cumsum([0, *map(len, texts)])
        if len(buf) < self.gram:
            return np.zeros(0, np.uint64), at
        h = np.ndarray((len(buf) - 7,), np.uint64, buf, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        reach = 8
        while reach < self.gram:  # the hash of twice as many bytes, until the gram is whole
            step = min(reach, self.gram - reach)
            h = mixed(h[: len(h) - step] ^ (h[step:] * np.uint64(0xC2B2AE3D27D4EB4F)))
            reach += step
        return mixed(h), at

    def packed(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        at = np.arange(len(text) + 1)
        return text, at[:-1], at[1:]

    def kept(self, text: bytes, covered: np.ndarray | None) -> tuple[int, bytes]:
        return len(text), text if covered is None else np.frombuffer(text, np.uint8)[~covered].tobytes()

    def count(self, text: bytes) -> int:
        return len(text)


def regions(unit, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts taken together: each region's text, first window in it, windows, minimiser, and places of that minimiser."""
    g, at = unit.chunk(texts)
    w = unit.k - unit.gram + 1
    none = np.zeros(0, np.int64)
    if len(g) < w:
        return none, none, none, none.astype(np.uint64), none
    least = sliding_min(g & np.uint64(0xFFFFFFFF00000000) | np.arange(len(g), dtype=np.uint64), w) & np.uint64(0xFFFFFFFF)
    counts = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), np.maximum(counts - unit.k + 1, 0))
    if not len(doc):
        return none, none, none, none.astype(np.uint64), none
    first = np.cumsum(np.r_[0, np.maximum(counts - unit.k + 1, 0)])[:-1]
    s = np.arange(len(doc)) - first[doc] + at[doc]
    pos = least[s]
    mini = g[pos]
    moved = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])])
    new = np.r_[True, (mini[moved[1:]] != mini[moved[:-1]]) | (doc[moved[1:]] != doc[moved[:-1]])]
    begin = moved[new]
    times = np.diff(np.r_[np.flatnonzero(new), len(moved)])
    return doc[begin], s[begin] - at[doc[begin]], np.diff(np.r_[begin, len(doc)]), mini[begin], times


def _find(unit):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = byte_texts(batch["text"])
        for i, j in parts([len(t) for t in texts], CHUNK):
            group = texts[i:j]
            doc, start, n, mini, times = regions(unit, group)
            offsets = pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32())
            rows = pa.StructArray.from_arrays([pa.array(mini.view(np.int64)), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(times, pa.int32())], ["mini", "start", "n", "times"])
            whole = [unit.kept(t, None) for t in group]
            yield {
                "did": batch["did"].slice(i, j - i), "th": batch["th"].slice(i, j - i), "units": [n for n, _ in whole],
                "sha": [hashlib.sha256(t).hexdigest() for _, t in whole], "regions": pa.ListArray.from_arrays(offsets, rows),
            }

    return run


def _digests(unit):
    """A digest for each suspected region of a document."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found, at = batch["found"], 0
        each = found.flatten()
        lengths = found.value_lengths().to_pylist()
        starts, sizes = each.field("start").to_pylist(), each.field("n").to_pylist()
        digests = []
        for text, m in zip(byte_texts(batch["text"]), lengths):
            text, a, b = unit.packed(text)
            for start, n in zip(starts[at : at + m], sizes[at : at + m]):
                digests.append(hashlib.blake2b(text[a[start] : b[start + n + unit.k - 2]], digest_size=16).digest())
            at += m
        row = np.repeat(np.arange(len(lengths)), lengths)
        out = {"did": batch["did"].take(pa.array(row)), "th": batch["th"].take(pa.array(row)), "fp": pa.array(digests, pa.binary())}
        out |= {k: each.field(k) for k in ("mini", "start", "n", "times")}
        for i in range(0, len(digests), 20_000):
            yield {k: v.slice(i, 20_000) for k, v in out.items()}

    return run


def _pack(unit):
    """The packed strings of the regions that go to buckets."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        want, at = batch["want"], 0
        each = want.flatten()
        starts, sizes = each.field("start").to_pylist(), each.field("n").to_pylist()
        out, first, size = [], 0, 0

        def made() -> dict:
            return {k: each.field(k).slice(first, len(out)) for k in ("mini", "fp", "low", "copies", "hot")} | {"packed": out}

        for text, m in zip(byte_texts(batch["text"]), want.value_lengths().to_pylist()):
            text, a, b = unit.packed(text)
            for start, n in zip(starts[at : at + m], sizes[at : at + m]):
                out.append(text[a[start] : b[start + n + unit.k - 2]])
                size += len(out[-1])
                if size > CHUNK:
                    yield made()
                    first, out, size = first + len(out), [], 0
            at += m
        if out:
            yield made()

    return run


def _again(unit):
    """Regions of longer grams in the regions of hot minimisers."""
    longer = type(unit)(unit.k, unit.k - unit.k // 8)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for mini, fp, low, copies, text in zip(*(batch[k].to_pylist() for k in ("mini", "fp", "low", "copies", "packed"))):
            text, a, b = unit.packed(text)
            _, start, n, longest, times = regions(longer, [text])
            m = len(n)
            for i in range(0, m, 10_000):
                j = min(m, i + 10_000)
                pieces = [text[a[x] : b[x + y + unit.k - 2]] for x, y in zip(start[i:j].tolist(), n[i:j].tolist())]
                yield {"mini": [mini] * (j - i), "fp": [fp] * (j - i), "low": [low] * (j - i), "copies": [copies] * (j - i), "longest": longest[i:j].view(np.int64), "first": start[i:j], "times": times[i:j], "packed": pieces}

    return run


def _window_digests(unit):
    """One row per window that is left of a hot minimiser's regions."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for mini, fp, low, copies, first, text in zip(*(batch[k].to_pylist() for k in ("mini", "fp", "low", "copies", "first", "packed"))):
            text, a, b = unit.packed(text)
            total = len(a) - unit.k + 1
            for i in range(0, total, 10_000):
                places = range(i, min(total, i + 10_000))
                n = len(places)
                yield {"mini": [mini] * n, "fp": [fp] * n, "low": [low] * n, "copies": [copies] * n, "at": [first + p for p in places], "digest": [hashlib.blake2b(text[a[p] : b[p + unit.k - 1]], digest_size=16).digest() for p in places]}

    return run


class Repeats:
    """rule: "smaller" flags windows that start in a document with a smaller did, "other" those that start anywhere else.
    flag: of the strings in a bucket, with the smallest holder and the number of holders, which windows are flagged."""

    def __init__(self, docs: DataFrame, unit, rule: str, flag):
        self.spark, self.unit, self.rule, self.flag = docs.sparkSession, unit, rule, flag
        self.scratch = Scratch(self.spark, f"repeats-{unit.name}")
        self.docs = keyed(docs)

    def covered(self) -> tuple[DataFrame, DataFrame]:
        """Each document with units, sha of the whole; and suspected documents with the runs of windows to cut, if any."""
        unit, scratch = self.unit, self.scratch
        found = scratch.save(arrow_map(self.docs, _find(unit), f"did long, th long, units long, sha string, regions array<struct<{REGION.replace(' long', ':bigint').replace(' int', ':int')}>>"), "found")
        repeated = bool(found.groupBy("did", "th").count().filter("count > 1").limit(1).count())
        source = self.docs.dropDuplicates(["did", "th"]) if repeated else self.docs
        each = (found.dropDuplicates(["did", "th"]) if repeated else found).select("did", "th", F.inline("regions"))
        twice = each.groupBy("mini").agg(F.min("did").alias("lo"), F.max("did").alias("hi"), F.sum("times").alias("times"))
        twice = twice.filter("lo < hi" if self.rule == "smaller" else "times > 1").select("mini")
        suspects = each.join(twice, "mini").groupBy("did", "th").agg(F.collect_list(F.struct("mini", "start", "n", "times")).alias("found"))
        aside = scratch.save(source.join(suspects.hint("shuffle_hash"), ["did", "th"]), "aside")

        rows = scratch.save(arrow_map(aside, _digests(unit), "did long, th long, mini long, start int, n int, times int, fp binary"), "rows")
        holder = F.struct("did", "th", "start", "n", "times")
        one = rows.groupBy("mini", "fp").agg(F.count(F.lit(1)).alias("copies"), F.min(holder).alias("h"))
        one = scratch.save(one.select("mini", "fp", "copies", "h.*"), "one")
        per = one.groupBy("mini").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("windows"), F.sum(F.col("n") + (unit.k - 1)).alias("units"), F.max((F.col("times") > 1) & (F.col("copies") == 1)).alias("selfish"))
        per = per.filter("kinds > 1" if self.rule == "smaller" else "kinds > 1 or selfish")
        per = per.select("mini", ((F.col("windows") > HOT) | (F.col("units") > HOT_UNITS)).alias("hot"))
        want = one.join(per, "mini").groupBy("did", "th").agg(F.collect_list(F.struct("mini", "fp", "start", "n", "copies", "hot", F.col("did").alias("low"))).alias("want"))
        packed = arrow_map(aside.select("did", "th", "text").join(want.hint("shuffle_hash"), ["did", "th"]), _pack(unit), "mini long, fp binary, low long, copies long, hot boolean, packed binary")
        packed = scratch.save(packed, "packed")

        cold = packed.filter("not hot").repartition("mini").sortWithinPartitions("mini")
        runs = arrow_map_all(cold, self._bucket(), "fp binary, mini long, at int, run int")
        again = scratch.save(arrow_map(packed.filter("hot"), _again(unit), "mini long, fp binary, low long, copies long, longest long, first int, times int, packed binary"), "again")
        met = again.groupBy("longest").agg(F.sum("times").alias("times")).filter("times > 1").select("longest")
        hot = scratch.save(arrow_map(again.join(met, "longest"), _window_digests(unit), "mini long, fp binary, low long, copies long, at int, digest binary"), "hot")
        if self.rule == "smaller":
            of = hot.groupBy("digest").agg(F.min("low").alias("least"))
            hot = hot.join(of, "digest").filter("least < low")
        else:
            of = hot.groupBy("digest").agg(F.sum("copies").alias("all"))
            hot = hot.join(of, "digest").filter("all > 1")
        runs = scratch.save(runs.unionByName(hot.select("fp", "mini", "at", F.lit(1).alias("run"))), "runs")

        # Whole regions are flagged by their copies; windows of the holders that remain by the buckets.
        mine = one.select("mini", "fp", "copies", F.col("did").alias("low"))
        held = rows.join(mine, ["mini", "fp"])
        whole = "did > low" if self.rule == "smaller" else "copies > 1"
        cut = held.filter(whole).select("did", "th", F.col("start").alias("begin"), (F.col("start") + F.col("n")).alias("end"))
        part = held.filter(f"not ({whole})").join(runs, ["mini", "fp"])
        cut = cut.unionByName(part.select("did", "th", (F.col("start") + F.col("at")).alias("begin"), (F.col("start") + F.col("at") + F.col("run")).alias("end")))
        cut = cut.groupBy("did", "th").agg(F.collect_list(F.struct("begin", "end")).alias("cut"))
        return found.select("did", "th", "units", "sha"), aside.select("did", "th", "text").join(cut.hint("shuffle_hash"), ["did", "th"])

    def _bucket(self):
        flag = self.flag

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            pending: list[tuple] = []  # regions of minimisers that are complete come first
            size = 0
            for batch in batches:
                for row in zip(*(batch[k].to_pylist() for k in ("mini", "fp", "low", "copies", "packed"))):
                    if size > CHUNK and row[0] != pending[-1][0]:
                        yield flag(pending)
                        pending, size = [], 0
                    pending.append(row)
                    size += len(row[4])
            if pending:
                yield flag(pending)

        return run


def as_runs(rows: list[tuple], flagged: list[np.ndarray]) -> dict:
    """Columns for runs of flagged windows; flagged: a mask for each row, empty if none."""
    out = {"fp": [], "mini": [], "at": [], "run": []}
    for row, mask in zip(rows, flagged):
        if not mask.any():
            continue
        edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
        out["at"] += edge[0::2].tolist()
        out["run"] += (edge[1::2] - edge[0::2]).tolist()
        out["fp"] += [row[1]] * (len(edge) // 2)
        out["mini"] += [row[0]] * (len(edge) // 2)
    return out


def cover(n: int, k: int, cut: list[dict]) -> np.ndarray:
    """The units of n under the windows of k that start in the runs."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, [r["begin"] for r in cut], 1)
    np.add.at(delta, [min(n, r["end"] + k - 1) for r in cut], -1)
    return np.cumsum(delta[:-1]) > 0


def removed(docs: DataFrame, unit, rule: str, flag, keep_text: bool = False) -> DataFrame:
    """did, units, n_removed, n_spans, sha (of what is kept) of every document; kept bytes too if asked for, from one more join."""
    job = Repeats(docs, unit, rule, flag)
    whole, cut = job.covered()

    def run(batch: pa.RecordBatch) -> dict:
        out = {"did": batch["did"], "th": batch["th"], "n_removed": [], "n_spans": [], "cut_sha": []}
        if keep_text:
            out["kept"] = []
        for text, runs in zip(byte_texts(batch["text"]), batch["cut"].to_pylist()):
            mask = cover(unit.count(text), unit.k, runs)
            _, rest = unit.kept(text, mask)
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(int(np.count_nonzero(np.diff(mask.view(np.int8), prepend=0) == 1)))
            out["cut_sha"].append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                out["kept"].append(rest)
        return out

    changed = job.scratch.save(arrow_map(cut, run, "did long, th long, n_removed long, n_spans long, cut_sha string" + ", kept binary" * keep_text), "changed")
    zero = F.lit(0).cast("long")
    out = whole.join(changed, ["did", "th"], "left")
    cols = ["did", "units", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha", "sha").alias("sha")]
    if keep_text:
        full = keyed(docs).select("did", "th", F.col("text")).dropDuplicates(["did", "th"])
        kept = arrow_map(full, lambda b: {"did": b["did"], "th": b["th"], "full": [unit.kept(t, None)[1] for t in byte_texts(b["text"])]}, "did long, th long, full binary")
        return out.join(kept, ["did", "th"]).select(*cols, F.coalesce("kept", "full").alias("kept"))
    return out.select(*cols)
