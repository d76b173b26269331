"""A rolling context window for each conversation, as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import fingerprint
from ..operators.chat import Options, compact_turns, count_tokens


class Window(StatefulProcessor):
    """State of a conversation: its turns as they stand, and fingerprints of contents that came before. A turn whose content came
    before changes nothing. Over budget, turns but the last few and the system's are compacted once each; what is compacted is
    part of the state, so a restart knows it. A running sum of tokens saves counting all turns at each append."""

    def __init__(self, max_tokens: int, keep_last: int):
        self.max_tokens, self.keep_last = max_tokens, keep_last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string, compacted boolean")
        self.seen = handle.getMapState("seen", "fp string", "one boolean")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        turns = [{"turn": t[0], "role": t[1], "text": t[2], "compacted": t[3]} for t in self.turns.get()] if self.turns.exists() else []
        new = pd.concat(list(rows)).sort_values("turn")
        total = sum(count_tokens(t["text"]) for t in turns)
        for r in new.itertuples():
            if self.seen.containsKey((r.fp,)):
                continue
            self.seen.updateValue((r.fp,), (True,))
            turns.append({"turn": int(r.turn), "role": r.role or "", "text": r.text or "", "compacted": False})
            total += count_tokens(r.text or "")
            if total > self.max_tokens:
                turns, total = self._compacted(turns)
        self.turns.put([(t["turn"], t["role"], t["text"], t["compacted"]) for t in turns])
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [len(turns)], "tokens": [total], "within_budget": [total <= self.max_tokens], "text": ["\n\n".join(f"{t['role'].capitalize()}: {t['text']}" for t in turns)]})

    def _compacted(self, turns: list[dict]) -> tuple[list[dict], int]:
        old, last = turns[: -self.keep_last], turns[-self.keep_last :]
        for t in old:
            if not t["compacted"] and t["role"].lower() != "system":
                t["text"] = "\n\n".join(b["text"] for b in compact_turns([t], Options(respect_safety=True)) if b["text"])
                t["compacted"] = True
        total = sum(count_tokens(t["text"]) for t in old + last)
        while total > self.max_tokens and (gone := next((t for t in old if t["role"].lower() != "system"), None)):
            old.remove(gone)
            total -= count_tokens(gone["text"])
        return old + last, total

    def close(self) -> None:
        pass


OUT = "conv_id long, n_turns long, tokens long, within_budget boolean, text string"


def context_window(turns: DataFrame, max_tokens: int = 400, keep_last: int = 4) -> DataFrame:
    """From a stream of conv_id, turn, role, text to each conversation's window after each batch (update mode). Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass)."""
    d = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", fingerprint(F.concat_ws(" ", "role", "text")).alias("fp"))
    return d.groupBy("conv_id").transformWithStateInPandas(Window(max_tokens, keep_last), OUT, "Update", "None")


def drop_seen(turns: DataFrame, *keys: str, watermark: str | None = None) -> DataFrame:
    """Rows whose content a conversation has not had: state is a hash per content, and with a watermark column it expires."""
    d = turns.withColumn("fp", fingerprint("text"))
    cols = [*(keys or ("conv_id",)), "fp"]
    return d.withWatermark(watermark, "30 minutes").dropDuplicatesWithinWatermark(cols) if watermark else d.dropDuplicates(cols)


def running_savings(results: DataFrame, *by: str) -> DataFrame:
    """Running sums of a stream of results, for complete or update mode."""
    return results.filter("original_tokens > 0").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"))
