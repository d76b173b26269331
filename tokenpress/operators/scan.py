"""Scans of texts: safety, waste, volatile tokens, duplicates, reviews of diffs, commit messages, symbols of code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, fingerprint, let, text_or_empty

# Patterns in the order in which the first one is reported; words are bounded where they begin or end with a letter or digit.
CRITICAL = tuple("security|vulnerability|exploit|cve-|data breach|leak|exposed|malware|ransomware|trojan|authentication bypass|unauthorized access|remote code execution|rce|sql injection|sqli|xss|csrf|privilege escalation|denial of service|dos|ddos|buffer overflow|overflow|certificate expired|tls|ssl|encryption key|private key|secret exposed|firewall|intrusion".split("|"))
DESTRUCTIVE = tuple("rm -rf;del /f;format ;mkfs;dd if=;> /dev/sda;> /dev/sd;drop database;drop table;truncate table;delete from;shutdown;reboot;chmod 777;chown -r;git push --force;git reset --hard;>|;:!q;:w!;cargo clean;npm cache clean;docker rmi -f;docker system prune -a".split(";"))
WARNING = tuple("warning|caution|important|do not|never|avoid|deprecated|removed|obsolete|experimental|unstable|untested|backup|back up|permission denied|access denied|rate limit|timeout|irreversible|irreversibile|production|prod|deploy|rollback|migration".split("|"))


def bounded(pattern: str) -> str:
    """Regular expression of a pattern in any case; without lookaround, so that RE2 takes it too."""
    left = r"(?:^|[^A-Za-z0-9])" if pattern[0].isalnum() else ""
    right = r"(?:[^A-Za-z0-9]|$)" if pattern[-1].isalnum() else ""
    return "(?i)" + left + re.sub(r"([^A-Za-z0-9 ])", r"\\\1", pattern) + right


def first_of(text: Column, low: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern that occurs. A plain search of the lower-case text comes first; only where it finds something do bounds matter."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(F.contains(low, F.lit(p)) & text.rlike(bounded(p)), p).otherwise(out)
    return out


def safety(text: Column | str, more_critical: tuple[str, ...] = (), more_warning: tuple[str, ...] = ()) -> Column:
    """Struct of level (Normal, Warning, Critical), pattern and reason."""
    t = text_or_empty(text)
    kinds = (("critical", CRITICAL + more_critical), ("destructive", DESTRUCTIVE), ("warning", WARNING + more_warning))
    found = let(F.lower(t), lambda low: F.struct(*(first_of(t, low, ps).alias(k) for k, ps in kinds)))

    def verdict(f: Column) -> Column:
        c, d, w = f["critical"], f["destructive"], f["warning"]
        level = F.when(c.isNotNull() | d.isNotNull(), "Critical").when(w.isNotNull(), "Warning").otherwise("Normal")
        reason = F.when(c.isNotNull(), F.concat(F.lit("Critical security pattern: "), c)).when(d.isNotNull(), F.concat(F.lit("Destructive command: "), d)).when(w.isNotNull(), F.concat(F.lit("Warning pattern: "), w))
        return F.struct(level.alias("level"), F.coalesce(c, d, w).alias("pattern"), reason.alias("reason"))

    return let(found, verdict)


HTML_TAG, BASE64, BLANKS, BLOAT = r"<[A-Za-z/!][^>]*>", r"[A-Za-z0-9+/]{50,}={0,2}", r"[ \t]{3,}|\n{3,}", r"\{[\s\S]{500,}?\}"


def waste(text: Column | str, bloat: bool = False) -> Column:
    """Struct of estimated tokens lost to tags, base64, blank runs and (if asked for) bulky JSON; each match is at least one."""
    t = text_or_empty(text)
    cost = lambda p: F.aggregate(F.regexp_extract_all(t, F.lit(p), 0), F.lit(0), lambda a, x: a + F.greatest(F.lit(1), (F.length(x) / 4).cast("int"))).cast("bigint")
    parts = {"html": cost(HTML_TAG), "base64": cost(BASE64), "blanks": cost(BLANKS), "json": cost(BLOAT) if bloat else F.lit(0).cast("bigint")}
    return F.struct(*(v.alias(k) for k, v in parts.items()), sum(parts.values(), F.lit(0).cast("bigint")).alias("total"))


VOLATILE = {
    "uuid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "iso8601": r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "jwt": r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "hex": r"\b(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b",
}


def volatile(text: Column | str) -> Column:
    """Array of structs label, sample (at most 40 characters) and position: the first token of each kind that would spoil a cache."""
    t = text_or_empty(text)
    found = F.array(*(F.struct(F.lit(k).alias("label"), F.substring(F.regexp_extract(t, p, 0), 1, 40).alias("sample"), F.regexp_instr(t, F.lit(p)).alias("position")) for k, p in VOLATILE.items()))
    return F.filter(found, lambda x: x["sample"] != "")


def message_duplicates(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", least: int = 50, gap: int = 3) -> DataFrame:
    """Adds duplicate_of (the turn that first had the text, if further back than `gap`), new_text and wasted tokens."""
    key = F.when(F.length(text) >= least, F.substring(F.sha2(F.col(text), 256), 1, 16))
    by = Window.partitionBy(conv, "_key")
    d = turns.withColumn("_key", key).withColumn("_first", F.min(turn).over(by))
    dup = F.col("_key").isNotNull() & (F.col(turn) - F.col("_first") > gap)
    return d.select(
        *turns.columns, F.when(dup, F.col("_first")).alias("duplicate_of"),
        F.when(dup, F.concat(F.lit("[duplicate of message #"), F.col("_first").cast("string"), F.lit("]"))).otherwise(F.col(text)).alias("new_text"),
        F.when(dup, F.greatest(F.lit(1), (F.length(text) / 4).cast("int"))).otherwise(0).cast("bigint").alias("wasted"),
    )


def fingerprint_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint, first (the smallest key with it) and copies: aggregated before it is joined, so a text copied very often is no hot window."""
    d = docs.select(key, fingerprint(text).alias("fingerprint"))
    per = d.groupBy("fingerprint").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
    return d.join(per, "fingerprint").select(key, "fingerprint", "first", "copies")


SECURITY = ("password", "secret", "token", "apikey", "api_key", "connectionstring", "connstring", "plaintext", "base64", "decrypt", "eval(", "exec(", "shell_exec")
BUGS = tuple("null nullptr nullreference exception throw catch todo hack fixme xxx undefined undef deadlock crash sqli injection exploit".split()) + ("null reference", "memory leak", "infinite loop")
SLOW = ("for(", "foreach(", "while(", "n+1", "select *", "orderby", "sort", "distinct", "recursive", "iteration")


def diff_lines(diffs: DataFrame, key: str = "diff_id", text: str = "diff") -> DataFrame:
    """key, no, line, kind (file, hunk, add, delete, context, other), file and new_line, which drifts after deletions: it counts them too."""
    d = diffs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("no", "line"))
    kind = (
        F.when(F.col("line").rlike(r"^\+\+\+ b/.+"), "file").when(F.col("line").rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), "hunk")
        .when(F.col("line").startswith("+"), "add").when(F.col("line").startswith("-"), "delete").when(F.col("line").startswith(" "), "context").otherwise("other")
    )
    before = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("kind", kind).withColumn("file", F.last(F.when(F.col("kind") == "file", F.regexp_extract("line", r"^\+\+\+ b/(.+)", 1)), ignorenulls=True).over(before))
    d = d.withColumn("hunk", F.last(F.when(F.col("kind") == "hunk", F.regexp_extract("line", r"\+(\d+)", 1).cast("int")).when(F.col("kind") == "file", -1), ignorenulls=True).over(before))
    d = d.withColumn("hunk_no", F.sum(F.col("kind").isin("hunk", "file").cast("int")).over(before))
    inside = Window.partitionBy(key, "hunk_no").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.col("kind").isin("add", "delete", "context").cast("int")
    return d.withColumn("new_line", F.when(F.col("hunk") >= 0, F.col("hunk") + F.coalesce(F.sum(counted).over(inside), F.lit(0)))).select(key, "no", "line", "kind", "file", "new_line", (F.col("hunk") >= 0).alias("in_hunk"))


def review(diffs: DataFrame, key: str = "diff_id", text: str = "diff") -> DataFrame:
    """The first finding on each added line: long line, security, bug, performance, null at declaration, bare try."""
    body = F.regexp_replace(F.substring("line", 2, 1_000_000), r"^\s+|\s+$", "")
    low = F.lower(body)
    first = lambda words, skip=lambda w: F.lit(False): F.coalesce(*(F.when(F.contains(low, F.lit(w)) & ~skip(w), F.lit(w)) for w in words))
    checked = body.contains("!=") | body.contains("== null") | body.contains("is null") | body.contains("?.") | body.contains("??")
    skip = lambda w: ~checked if w in ("null", "nullptr") else F.lit(False)
    security, bug, slow = first(SECURITY), first(BUGS, skip), first(SLOW)
    none = body.rlike(r"^\s*var\s+\w+\s*=\s*null;?$")
    bare = body.rlike(r"(?i)try\s*\{") & ~low.contains("catch")
    severity = (
        F.when(F.length(body) > 200, "warning").when(security.isNotNull(), "critical").when(bug == "todo", "info").when(bug.isNotNull(), "bug").when(slow.isNotNull(), "perf")
        .when(none | bare, "warning")
    )
    rule = F.when(F.length(body) > 200, "long line").when(security.isNotNull(), security).when(bug.isNotNull(), bug).when(slow.isNotNull(), slow).when(none, "null at declaration").when(bare, "bare try")
    d = diff_lines(diffs, key, text).filter("in_hunk and kind = 'add'")
    return d.withColumn("severity", severity).withColumn("rule", rule).filter("severity is not null").select(key, "file", F.col("new_line").alias("line_no"), "severity", "rule", body.alias("content"))


_COMMIT_TYPES = (("feat", "feat:|feature:|add|new|implement"), ("fix", "bug|fix|hotfix|patch"), ("docs", "doc"), ("style", "style|format"), ("refactor", "refactor"), ("perf", "perf|optimize"), ("test", "test"), ("chore", "chore|bump|update dep|upgrade"), ("ci", "ci|pipeline|build"))
_COMMIT_STOP = {"the", "and", "for", "with", "this", "that", "from", "are", "was", "were", "been", "being", "var", "let", "const", "return", "public", "private", "class", "void", "int", "string", "new", "null", "true", "false"}


def suggest_commit(diff: str) -> dict[str, str | None]:
    """Type by the first keyword that occurs, scope if all files share a short top folder, subject of up to five words, 50 characters in all."""
    if not diff.strip():
        return {"type": "chore", "scope": None, "subject": "empty diff", "message": "chore: empty diff"}
    rows = [x for x in diff.split("\n") if x]
    paths = list(dict.fromkeys(p for x in rows if x.startswith(("+++ b/", "--- a/")) and (p := x[6:].strip()) and p != "/dev/null"))
    added = [y for x in rows if x.startswith("+") and not x.startswith("+++") and (y := x[1:].strip())]
    gone = [y for x in rows if x.startswith("-") and not x.startswith("---") and (y := x[1:].strip())]
    every = " ".join(added + gone).lower()
    breaking = any(w in every for w in ("breaking", "major", "remove", "api change"))
    kind = next((k for k, words in _COMMIT_TYPES if any(w in every for w in words.split("|"))), "fix" if len(gone) > len(added) else "feat")
    tops = {t for p in paths if (t := p.replace("\\", "/").split("/")[0])}
    scope = next(iter(tops)).rstrip(":") if len(tops) == 1 and 0 < len(next(iter(tops))) <= 15 else None
    words = []
    for x in added + gone:
        words += [w for w in map(str.lower, re.findall(r"\b[A-Z][a-z]+|[a-z]{3,}\b", x)) if w not in _COMMIT_STOP][:3]
    words = words or [p.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower() for p in paths[:2]]
    subject = " ".join(list(dict.fromkeys(words))[:5]) or "update project files"
    if words and kind == "fix" and len(subject) > 3:
        subject = "handle " + subject
    if len(subject) > 45:
        subject = subject[:42] + "…"
    place = f"({scope})" if scope else ""
    message = f"{kind}{'!' * breaking}{place}: {subject}"
    if len(message) > 50 and len(subject) > 10:
        most = 50 - len(kind) - len(scope or "") - 4
        if 5 < most < len(subject):
            subject = subject[: most - 1] + "…"
        message = f"{kind}{place}: {subject}"
    return {"type": kind, "scope": scope, "subject": subject, "message": message}


def commits(diffs: DataFrame, key: str = "diff_id", text: str = "diff") -> DataFrame:
    @F.pandas_udf("struct<type:string,scope:string,subject:string,message:string>")
    def run(texts):
        import pandas as pd

        rows = [suggest_commit(t or "") for t in texts]
        return pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in ("type", "scope", "subject", "message")})

    return diffs.select(key, run(text).alias("c")).select(key, "c.*")


SYMBOLS = {
    "class": r"\b(?:class|interface|struct|enum|record)\s+([A-Za-z_]\w*)",
    "function": r"^\s*(?:async\s+)?(?:def|function|func|fn)\s+([A-Za-z_]\w*)",
    "method": r"\b(?:public|private|protected|internal|static)\b[^=;(]*?\b([A-Za-z_]\w*)\s*\(",
    "property": r"\b(?:public|private|protected|internal)\s+[\w<>\[\],?]+\s+([A-Za-z_]\w*)\s*\{\s*get",
}


def symbols(files: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """path, line_no, kind and name of what a line of code declares."""
    d = files.select(path, F.posexplode(F.split(F.col(code), "\n")).alias("no", "line"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("name")) for k, p in SYMBOLS.items()))
    return d.select(path, (F.col("no") + 1).alias("line_no"), F.explode(F.filter(kinds, lambda s: s["name"] != "")).alias("s")).select(path, "line_no", "s.*")


def symbol_counts(files: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """path, kind, n (declarations) and names (distinct ones)."""
    return symbols(files, path, code).groupBy(path, "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


STEER = "<!-- steering -->"
STEERING = {1: "Be brief.", 2: "Skip introductions and repetition.", 3: "Answer with code or facts only."}


def shape(prompt: Column, level: int) -> Column:
    """Adds steering text behind a sentinel, unless it is there: levels 1 to 3 add up, level 4 stands alone, 0 adds nothing."""
    if level == 0:
        return prompt
    text = "Answer in one line." if level == 4 else " ".join(STEERING[k] for k in range(1, level + 1))
    return F.when(prompt.contains(STEER), prompt).otherwise(F.concat(prompt, F.lit(f"\n\n{STEER}\n{text}")))


def unshape(prompt: Column) -> Column:
    """Cuts the sentinel and all behind it."""
    return F.regexp_replace(F.substring_index(prompt, STEER, 1), r"\s+$", "")


def safety_of(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("safety", F.when(blank(text), F.struct(F.lit("Normal").alias("level"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("reason"))).otherwise(safety(text)))
