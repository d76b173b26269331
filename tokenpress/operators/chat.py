"""Conversations: parsing of raw transcripts, compaction to a budget, memory notes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PRICES, token_count
from .rank import textrank
from .scan import CRITICAL, DESTRUCTIVE, bounded

ROLES = {
    "system": "System", "sistema": "System", "developer": "System", "user": "User", "utente": "User", "human": "User", "umano": "User", "assistant": "Assistant", "assistente": "Assistant",
    "ai": "Assistant", "bot": "Assistant", "model": "Assistant", "modello": "Assistant", "gpt": "Assistant", "tool": "Tool", "strumento": "Tool", "function": "Tool", "funzione": "Tool",
}
_LABEL = re.compile(r"^\s*(" + "|".join(ROLES) + r")\s*[:>\-]\s*(.*)$", re.IGNORECASE)
TURN = "struct<turn:int,role:string,raw_role:string,content:string>"


def role_of(raw: str | None) -> str:
    return ROLES.get((raw or "").strip().lower(), "Unknown")


def _content(value: object) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(b if isinstance(b, str) else str(b["text"]) if isinstance(b, dict) and isinstance(b.get("text"), str) else f"[{b.get('type', 'block')}]" for b in value if isinstance(b, str | dict))
    return ""


def _from_json(raw: str) -> list[tuple[str, str]]:
    try:
        data = json.loads(raw)
    except ValueError:
        return []
    if isinstance(data, dict):
        data = data.get("messages")
    out = []
    for m in data if isinstance(data, list) else ():
        if not isinstance(m, dict):
            continue
        text = _content(m.get("content"))
        for call in m.get("tool_calls") or ():
            f = call.get("function") or call if isinstance(call, dict) else {}
            args = f.get("arguments", "")
            text += ("\n" if text else "") + f"[tool_call: {f.get('name', '')}({args if isinstance(args, str) else json.dumps(args)})]"
        if text.strip():
            out.append((str(m.get("role") or ""), text))
    return out


def _from_marks(raw: str, begin: str, end: str) -> list[tuple[str, str]]:
    out = []
    for part in raw.split(begin)[1:]:
        head, _, body = part.split(end)[0].partition("\n")
        if body.strip():
            out.append((head.strip(), body.strip()))
    return out


def _from_inst(raw: str) -> list[tuple[str, str]]:
    out = []
    if m := re.search(r"(?s)<<SYS>>(.*?)<</SYS>>", raw):
        out.append(("system", m[1].strip()))
        raw = raw.replace(m[0], "")
    for m in re.finditer(r"(?s)\[INST\](.*?)\[/INST\](.*?)(?=\[INST\]|$)", raw):
        out += [(r, t) for r, t in (("user", m[1].strip()), ("assistant", m[2].replace("</s>", "").replace("<s>", "").strip())) if t]
    return out


def _from_labels(raw: str) -> list[tuple[str, str]]:
    turns: list[tuple[str, list[str]]] = []
    for row in raw.split("\n"):
        if m := _LABEL.match(row):
            turns.append((m[1], [m[2]]))
        elif turns:
            turns[-1][1].append(row)
    out = [(r, t) for r, rows in turns if (t := "\n".join(rows).strip())]
    return out if len(turns) >= 2 and len(out) >= 2 else []


def parse_conversation(raw: str) -> tuple[str, list[dict]]:
    """Format and turns of a raw conversation: JSON, ChatML, Gemma, [INST], labelled lines, else one turn of plain text."""
    lead = raw.lstrip()
    tries = [
        ("openai-json", lambda: _from_json(raw) if lead[:1] in ("[", "{") else []), ("chatml", lambda: _from_marks(raw, "<|im_start|>", "<|im_end|>")),
        ("gemma", lambda: _from_marks(raw, "<start_of_turn>", "<end_of_turn>")), ("llama-inst", lambda: _from_inst(raw) if "[INST]" in raw else []), ("transcript", lambda: _from_labels(raw)),
    ]
    for name, make in tries:
        if turns := make():
            return name, [{"turn": i, "role": role_of(r), "raw_role": r, "content": t} for i, (r, t) in enumerate(turns)]
    return "plain", [{"turn": 0, "role": "Unknown", "raw_role": None, "content": raw.strip()}] if raw.strip() else []


def parse(raw: Column | str) -> Column:
    """Struct of format and turns."""

    @F.pandas_udf(f"struct<format:string,turns:array<{TURN}>>")
    def run(s):
        import pandas as pd

        made = [parse_conversation(x or "") for x in s]
        return pd.DataFrame({"format": pd.Series([a for a, _ in made], dtype=object), "turns": [b for _, b in made]})

    return run(raw if isinstance(raw, Column) else F.col(raw))


def as_json(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key and messages: a JSON array of role and content."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content")))), lambda x: F.struct(x["role"], x["content"]))
    return turns.groupBy(conv).agg(F.to_json(rows).alias("messages"))


def as_transcript(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key and transcript: "Role: content", an empty line between."""
    line = F.concat(F.initcap(F.col(role)), F.lit(": "), F.col(text))
    return turns.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, line.alias("s")))), lambda x: x["s"]), "\n\n").alias("transcript"))


def recent_turns(turns: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    return turns.withColumn("_r", F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).desc()))).filter(F.col("_r") <= n).drop("_r")


def budget_suffix(turns: DataFrame, most: int, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The newest turns of each conversation that fit the budget together, with their tokens and the sum from the newest on."""
    d = turns.select(conv, turn, token_count(text).alias("tokens"))
    return d.withColumn("from_newest", F.sum("tokens").over(Window.partitionBy(conv).orderBy(F.col(turn).desc()).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("from_newest") <= most)


@dataclass(frozen=True)
class Options:
    """How a conversation is compacted. Discourse: paragraphs of at least so many words, share of function words and sentences. clean:
    markup goes first (markdown_text, with keep_code and keep_json), but not of critical or system turns; extract_html: pages
    become their text. model: whose price the result is given in. summarizer: any function of a text and a number of sentences."""

    max_tokens: int = 0
    keep_recent: int = 0
    summarize: bool = True
    compress_kept: bool = False
    respect_safety: bool = True
    deduplicate: bool = False
    keep_system: bool = True
    must_keep: tuple[str, ...] = ()
    min_words: int = 50
    min_sentences: int = 3
    min_stop_ratio: float = 0.20
    ratio: float = 0.4
    least: int = 2
    most: int = 8
    clean: bool = False
    keep_code: bool = False
    keep_json: bool = False
    extract_html: bool = False
    model: str = "gpt4"
    summarizer: Callable[[str, int], str] | None = None


PRESETS = {
    "default": Options(), "faithful": Options(ratio=0.6, keep_recent=4), "agent_memory": Options(deduplicate=True, compress_kept=True, keep_recent=2),
    "coding_chat": Options(deduplicate=True, keep_recent=4, must_keep=(r"```", r"\b\w+\.\w{1,4}\b")), "aggressive": Options(deduplicate=True, compress_kept=True, ratio=0.25),
}

_CRITICAL = None


def _is_critical(text: str) -> bool:
    global _CRITICAL
    if _CRITICAL is None:
        _CRITICAL = re.compile("|".join(bounded(p)[4:] for p in CRITICAL + DESTRUCTIVE), re.IGNORECASE)
    return bool(_CRITICAL.search(text))


def count_tokens(text: str) -> int:
    """The default counter, in plain Python."""
    if not text.strip():
        return 0
    n = sum(1 if len(w) <= 4 else 2 if len(w) <= 8 else 2 + (len(w) - 5) // 4 for w in re.findall(r"[a-zA-Z0-9_]+|[^\s]", text))
    return max(1, n + sum(len(w) // 4 for w in re.findall(r"\s{4,}", text)))


def compact_turns(turns: list[dict], o: Options) -> list[dict]:
    """Blocks of a conversation after compaction: turn, role, text, action. Critical, recent, system and must-keep blocks stay as they
    are; long discourse is summarized; over budget, the longest discourse loses a sentence at a time, then is compressed, then
    the oldest blocks go. Protected blocks alone may still be over budget."""
    from ..functions.sentences import split_sentences
    from ..lexicon import catalogue
    from .compress import _syntactic_one

    shorter = o.summarizer or textrank
    stop = catalogue()["eng"].function_words
    keep = [re.compile(p, re.IGNORECASE) for p in o.must_keep if _compiles(p)]
    blocks: list[dict] = []
    for i, t in enumerate(turns):
        recent = i >= len(turns) - o.keep_recent if o.keep_recent else False
        for p in [x.strip() for x in re.split(r"\n\s*\n", t["text"] or "") if x.strip()]:
            words = re.findall(r"[^\W\d_]+", p.lower())
            sents = split_sentences(p)
            long = len(words) >= o.min_words and len(sents) >= o.min_sentences and sum(w in stop for w in words) >= o.min_stop_ratio * len(words)
            safe = o.respect_safety and _is_critical(p)
            guard = safe or recent or (o.keep_system and t["role"].lower() == "system") or any(k.search(p) for k in keep)
            blocks.append({"turn": t["turn"], "role": t["role"], "text": p, "original": p, "guard": guard, "discourse": long and not guard, "n": len(sents), "action": "critical" if safe else "kept"})
    if o.deduplicate:
        seen: set[str] = set()
        for b in blocks:
            k = " ".join(b["text"].lower().split())
            if k in seen and not b["guard"]:
                b["action"], b["text"] = "deduplicated", ""
            seen.add(k)
    for b in blocks:
        if b["discourse"] and b["text"] and o.summarize:
            b["k"] = min(o.most, max(o.least, int(b["n"] * o.ratio + 0.5)))
            b["text"], b["action"] = shorter(b["original"], b["k"]), "summarized"
        if o.compress_kept and b["text"] and not b["guard"]:
            b["text"], b["action"] = _syntactic_one(b["text"], "eng"), "summarized+compressed" if b["action"] == "summarized" else "compressed"
    if o.max_tokens:
        sizes = [count_tokens(b["text"]) for b in blocks]
        for _ in range(500):
            if sum(sizes) <= o.max_tokens:
                break
            free = [i for i, b in enumerate(blocks) if not b["guard"] and b["text"]]
            if not free:
                break
            able = [i for i in free if blocks[i]["discourse"] and blocks[i].get("k", 0) > 1]
            if able:
                i = max(able, key=lambda i: (sizes[i], -i))
                b = blocks[i]
                b["k"] -= 1
                b["text"], b["action"] = shorter(b["original"], b["k"]), "summarized"
            else:
                raw = [i for i in free if "compressed" not in blocks[i]["action"]]
                i = max(raw, key=lambda i: (sizes[i], -i)) if raw else free[0]
                b = blocks[i]
                short = _syntactic_one(b["text"], "eng") if raw else ""
                b["text"], b["action"] = (short, "summarized+compressed" if b["action"] == "summarized" else "compressed") if raw else ("", "dropped")
            sizes[i] = count_tokens(b["text"])
    return blocks


def _compiles(p: str) -> bool:
    try:
        re.compile(p)
    except re.error:
        return False
    return True


def render(blocks: list[dict]) -> str:
    """Transcript of blocks, each turn's role once; runs of dropped blocks are one mark."""
    out: list[str] = []
    last = None
    for b in blocks:
        if not b["text"]:
            if b["action"] == "dropped" and (not out or out[-1] != "[…]"):
                out.append("[…]")
            continue
        out.append(b["text"] if b["turn"] == last else f"{b['role'].capitalize()}: {b['text']}")
        last = b["turn"]
    return "\n\n".join(out)


COMPACTED = "text string, original_tokens long, compacted_tokens long, saved_usd double, within_budget boolean, n_blocks long, n_summarized long, n_dropped long, trace string"


def compact(turns: DataFrame, options: Options | str = "default", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, the compacted transcript, tokens before and after, and what became of blocks. A conversation is one row's work: its turns
    are put together by one aggregation, and Arrow batches do the rest."""
    o = PRESETS[options] if isinstance(options, str) else options
    kind = dict(turns.dtypes)[conv]
    usd = float(PRICES.get(o.model, "0")) / 1000
    if o.clean or o.extract_html:
        turns = cleaned(turns, o, role, text)
    rows = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("turns"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for key, ts in zip(pdf[conv], pdf["turns"]):
                blocks = compact_turns([{**t, "role": t["role"] or "", "text": t["text"] or ""} for t in ts], o)
                made = render(blocks)
                before = sum(count_tokens(t["text"] or "") for t in ts)
                after = sum(count_tokens(b["text"]) for b in blocks)
                count = lambda a: sum(a in b["action"] for b in blocks)
                out.append((key, made, before, after, round(max(0, before - after) * usd, 6), not o.max_tokens or after <= o.max_tokens, len(blocks), count("summarized"), count("dropped"), ",".join(b["action"] for b in blocks)))
            yield pd.DataFrame(out, columns=[conv, *(x.split()[0] for x in COMPACTED.split(", "))])

    return rows.mapInPandas(run, f"{conv} {kind}, {COMPACTED}")


def cleaned(turns: DataFrame, o: Options, role: str = "role", text: str = "text") -> DataFrame:
    """Turns without markup, as the options have it. Critical and system turns stay as they are where these are kept."""
    from .route import content_type, html_text, markdown_text
    from .scan import safety

    made = markdown_text(text, o.keep_code, o.keep_json) if o.clean else F.col(text)
    if o.extract_html:
        made = F.when(content_type(text) == "Html", html_text(text, entities=False)).otherwise(made)
    guard = F.lit(False)
    if o.respect_safety:
        guard = guard | (safety(text)["level"] == "Critical")
    if o.keep_system:
        guard = guard | F.coalesce(F.lower(role) == "system", F.lit(False))
    return turns.withColumn(text, F.when(F.col(text).isNull() | guard, F.col(text)).otherwise(made))


def memory_notes(docs: DataFrame, key: str = "conv_id", text: str = "text", k: int = 5, words: int = 10) -> DataFrame:
    """key, summary and keywords of a text: what is worth to be remembered of it."""
    from .rank import keywords, summary
    from .route import markdown_text

    clean = docs.select(key, markdown_text(text).alias("clean"))
    kw = keywords(clean, key, "clean", words).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    return clean.select(key, summary("clean", k).alias("summary")).join(kw, key, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def recall(notes: DataFrame, query: str, k: int = 5, key: str = "conv_id") -> DataFrame:
    """The k notes that share most terms with the query."""
    from .rank import relevance, top

    d = notes.withColumn("score", relevance(F.concat_ws(" ", "summary", "keywords"), query)).filter("score > 0")
    return top(d, k, key)


def with_options(preset: str, **changes) -> Options:
    return replace(PRESETS[preset], **changes)
