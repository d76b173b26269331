"""Secret scan with corpus-wide ownership: candidates found by pattern, told apart by how widely their values are spread."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

#: A value of more owners than this is a widely copied example, not a credential that somebody uses.
MOST_OWNERS = 2
#: So is a value in more repositories than this, even if all are of one owner.
MOST_REPOSITORIES = 100
KINDS = ("assign", "access", "hex", "pair")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Mixed-alphabet keys without a name before them: kept only if one owner has them.
_PAIR = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?![A-Za-z0-9+/_-])")
SPAN = "struct<kind:string,begin:int,end:int,hash:string,base:boolean>"


def entropy(x: str) -> float:
    n = len(x)
    return -sum(c / n * log2(c / n) for c in map(x.count, set(x)))


def find(text: str) -> list[tuple[str, int, int, str]]:
    """kind, begin, end (code points) and value of each candidate, by begin and then kind. Per kind leftmost, not overlapping."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    base = list(out)
    for m in _PAIR.finditer(text):
        x = m[0]
        if any(c.isdigit() for c in x) and any(c.islower() for c in x) and any(c.isupper() for c in x) and entropy(x) >= 3.5 and not any(a < m.end() and m.start() < b for _, a, b, _ in base):
            out.append(("pair", m.start(), m.end(), x))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _digest(value: str) -> str:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def spread(values: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories of values (hash, _owner, _repo). A value that a third of all rows have is one row per task and
    repository before it meets."""
    count = lambda of, name: values.select("hash", of).groupBy("hash", of).agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias(name))
    return count("_owner", "n_owners").join(count("_repo", "n_repositories"), "hash")


def is_live(most_owners: int, most_repositories: int) -> F.Column:
    return (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS, keep_text: bool = False, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Candidates of every whole text, with the ownership of their values over the corpus.

    docs: doc_id, text and the columns named owner and repository; other columns are ignored. Returns a row per row: doc_id and
    spans, an array of kind, begin, end (code points, end exclusive), hash of the value (values themselves leave no text), base (a
    span of the base patterns), n_owners, n_repositories and live: the value is one of at most `most_owners` owners and in
    at most `most_repositories` repositories. Spans of other kinds than the base ones are candidates and live. A null text is empty; null owners and repositories count as one more
    owner and repository. Equal rows each have their row. With keep_text the columns of docs come along.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    own = F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner")
    repo = F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repo")
    # Rows get their names in a table: what joins use stays the same if a task runs again.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), own, repo)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found = []
        for t in batch["text"].to_pylist():
            found.append([{"kind": k, "begin": a, "end": b, "hash": _digest(v), "base": k in KINDS[:3]} for k, a, b, v in find(t)] if t else [])
        yield {k: batch[k] for k in ("doc_id", "_owner", "_repo")} | {"found": found}

    each = scratch.save(arrow_map(rows, run, f"doc_id long, _owner string, _repo string, found array<{SPAN}>").withColumn("_row", F.monotonically_increasing_id()), "each")
    some = each.filter(F.size("found") > 0)
    values = some.select("_owner", "_repo", F.explode("found.hash").alias("hash"))
    known = scratch.save(spread(values), "spread")
    spans = some.select("_row", F.posexplode("found").alias("i", "s")).select("_row", "i", "s.*").join(known, "hash")
    spans = spans.withColumn("live", is_live(most_owners, most_repositories)).filter("base or live")
    spans = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("i", "kind", "begin", "end", "hash", "base", "n_owners", "n_repositories", "live"))).alias("spans"))
    spans = scratch.save(spans, "spans")
    none = F.from_json(F.lit("[]"), spans.schema["spans"].dataType)
    return each.select("_row", "doc_id").join(spans, "_row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text), n_live, n_examples."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    of_kind = lambda k: lambda s: s["kind"] == k
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        "doc_id", *(count(of_kind(k)).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_examples"),
    )


MASK = "[REDACTED]"


def redact(docs: DataFrame, owner: str = "source", most_owners: int = MOST_OWNERS, repository: str = "doc_id", most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """docs with the live spans of every text replaced by a mask; all columns and rows stay. Examples stay as they are.

    The corpus-wide table of values decides; texts themselves are scanned once more where they are, so only values move. Where
    the table of live values is small it goes to every task, else the documents that have one are joined with theirs."""
    scratch = Scratch(docs.sparkSession, "redact")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_d"), F.xxhash64("text").alias("_t")]
    own = F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner")
    repo = F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repo")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {k: [] for k in ("_d", "_t", "_owner", "_repo", "begin", "end", "hash", "base")}
        for d, t, o, r, text in zip(*(batch[k].to_pylist() for k in ("_d", "_t", "_owner", "_repo", "text"))):
            for kind, a, b, v in find(text) if text else ():
                for k, x in zip(out, (d, t, o, r, a, b, _digest(v), kind in KINDS[:3])):
                    out[k].append(x)
        yield out

    rows = arrow_map(docs.select(*key, own, repo, F.col("text").cast("string").alias("text")), run, "_d long, _t long, _owner string, _repo string, begin int, end int, hash string, base boolean")
    rows = scratch.save(rows, "candidates")
    live = spread(rows).filter(is_live(most_owners, most_repositories)).select("hash")
    cut = rows.join(live, "hash").select("_d", "_t", "begin", "end").distinct()
    cut = scratch.save(cut.groupBy("_d", "_t").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_cut")), "cut")
    joined = docs.withColumns({"_d": key[0], "_t": key[1]}).join(cut, ["_d", "_t"], "left")
    # From left to right: copy what is before a span, then the mask; overlapping spans get one.
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.col("text")
    piece = lambda a, s: F.struct(
        F.when(s["begin"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["begin"] - a["at"]), F.lit(MASK))).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    done = F.aggregate("_cut", start, piece, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.col("_cut").isNull(), text).otherwise(done)
    return joined.withColumn("text", new).select(*docs.columns)
