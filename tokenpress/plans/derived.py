"""Queries on diffs, code and transcripts that are made from the tables, row for row, with the SQL that makes them too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chat, route, scan
from . import sqltools as q
from .texts import docs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Diffs: a document is a file whose sentences were changed here and there.

_SIGN = ((7, 3, "-"), (7, 4, "+"), (11, 5, "+"))
_CHANGED = ((13, 4, "var last = null;"), (17, 4, "foreach(var y in rows) {"), (19, 5, "throw new Exception()"), (23, 3, "try { run(); }"), (29, 10, "string password = load();"))
_DIFFS = rf"""diffs AS (SELECT doc_id AS diff_id, 'diff --git a/src/' || doc_id || '.txt b/src/' || doc_id || '.txt' || chr(10) || 'index 1..2 100644' || chr(10) || '--- a/src/' || doc_id || '.txt' || chr(10) || '+++ b/src/' || doc_id || '.txt' || chr(10) ||
    array_to_string(list_transform(l, lambda x, i: CASE WHEN i % 40 = 0 THEN '+++ b/src/other.txt' || chr(10) ELSE '' END || CASE WHEN i % 15 = 1 THEN '@@ -' || i || ',15 +' || i || ',15 @@' || chr(10) ELSE '' END ||
    CASE {" ".join(f"WHEN i % {m} = {r} THEN '{s}'" for m, r, s in _SIGN)} ELSE ' ' END || CASE {" ".join(f"WHEN i % {m} = {r} THEN '{s}'" for m, r, s in _CHANGED)} ELSE x END), chr(10)) AS diff
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.\n]+ *'), lambda x: x <> '') AS l FROM documents)),
    d AS (SELECT diff_id, diff, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM (SELECT *, string_split(diff, chr(10)) AS l FROM diffs))"""


def diffs(spark, sf_dir) -> DataFrame:
    def line(x, i0):
        i = i0 + 1
        sign, body = F.lit(" "), x
        for m, r, s in reversed(_SIGN):
            sign = F.when(i % m == r, s).otherwise(sign)
        for m, r, s in reversed(_CHANGED):
            body = F.when(i % m == r, s).otherwise(body)
        n = i.cast("string")
        return F.concat(F.when(i % 40 == 0, "+++ b/src/other.txt\n").otherwise(""), F.when(i % 15 == 1, F.concat(F.lit("@@ -"), n, F.lit(",15 +"), n, F.lit(",15 @@\n"))).otherwise(""), sign, body)

    lines = F.filter(F.split("text", r"[.\n]+ *"), lambda x: x != "")
    head = F.format_string("diff --git a/src/%d.txt b/src/%d.txt\nindex 1..2 100644\n--- a/src/%d.txt\n+++ b/src/%d.txt\n", *["doc_id"] * 4)
    return docs(spark, sf_dir).select(F.col("doc_id").alias("diff_id"), F.concat(head, F.array_join(F.transform(lines, line), "\n")).alias("diff"))


@query(rf"""WITH {_DIFFS},
    k AS (SELECT *, CASE WHEN regexp_matches(line, '^(?:diff --git|index |--- |\+\+\+ )') THEN 'file' WHEN starts_with(line, '@@') THEN 'hunk' WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') THEN 'delete' ELSE 'context' END AS kind FROM d),
    f AS (SELECT *, sum((kind = 'file')::INT) OVER (PARTITION BY diff_id ORDER BY no) AS f FROM k), h AS (SELECT *, sum((kind = 'hunk')::INT) OVER (PARTITION BY diff_id, f ORDER BY no) AS h FROM f),
    c AS (SELECT *, max((kind IN ('add', 'delete'))::INT) OVER (PARTITION BY diff_id, f, h) AS has, max((kind IN ('add', 'delete'))::INT) OVER (PARTITION BY diff_id, f, h ORDER BY no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h),
    o AS (SELECT diff_id, any_value(diff) AS whole, string_agg(line, chr(10) ORDER BY no) FILTER (WHERE f <= 20 AND (kind = 'file' OR (has = 1 AND h <= 10 AND (kind = 'hunk' OR near = 1)))) AS short,
          count(*) FILTER (WHERE kind = 'add')::BIGINT AS additions, count(*) FILTER (WHERE kind = 'delete')::BIGINT AS deletions FROM c GROUP BY diff_id)
    SELECT diff_id, CASE WHEN length(short) < length(whole) THEN short ELSE whole END AS trimmed, additions, deletions FROM o""")
def diff_trim(spark, sf_dir):
    return route.trim_diffs(diffs(spark, sf_dir))


def _first_sql(words, skip=lambda w: "") -> str:
    return "CASE " + " ".join(f"WHEN contains(low, {q.lit(w)}){skip(w)} THEN {q.lit(w)}" for w in words) + " END"


@query(rf"""WITH {_DIFFS},
    k AS (SELECT *, CASE WHEN regexp_matches(line, '^\+\+\+ b/.+') THEN 'file' WHEN regexp_matches(line, '^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@') THEN 'hunk' WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') THEN 'delete' WHEN starts_with(line, ' ') THEN 'context' ELSE 'other' END AS kind FROM d),
    h AS (SELECT *, last_value(CASE WHEN kind = 'file' THEN regexp_extract(line, '^\+\+\+ b/(.+)', 1) END IGNORE NULLS) OVER w AS file,
          last_value(CASE WHEN kind = 'hunk' THEN regexp_extract(line, '\+(\d+)', 1)::INT WHEN kind = 'file' THEN -1 END IGNORE NULLS) OVER w AS hunk, sum((kind IN ('hunk', 'file'))::INT) OVER w AS hunk_no
          FROM k WINDOW w AS (PARTITION BY diff_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    n AS (SELECT *, hunk + coalesce(sum((kind IN ('add', 'delete', 'context'))::INT) OVER (PARTITION BY diff_id, hunk_no ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_line,
          regexp_replace(substr(line, 2), '^\s+|\s+$', '', 'g') AS body FROM h WHERE hunk >= 0),
    a AS (SELECT *, lower(body) AS low, contains(body, '!=') OR contains(body, '== null') OR contains(body, 'is null') OR contains(body, '?.') OR contains(body, '??') AS checked FROM n WHERE kind = 'add'),
    r AS (SELECT *, {_first_sql(scan.SECURITY)} AS sec, {_first_sql(scan.BUGS, lambda w: " AND checked" if w in ("null", "nullptr") else "")} AS bug, {_first_sql(scan.SLOW)} AS slow,
          regexp_matches(body, '^\s*var\s+\w+\s*=\s*null;?$') AS none, regexp_matches(body, '(?i)try\s*\{{') AND NOT contains(low, 'catch') AS bare FROM a),
    s AS (SELECT diff_id, file, new_line::BIGINT AS line_no, body AS content,
          CASE WHEN length(body) > 200 THEN 'warning' WHEN sec IS NOT NULL THEN 'critical' WHEN bug = 'todo' THEN 'info' WHEN bug IS NOT NULL THEN 'bug' WHEN slow IS NOT NULL THEN 'perf' WHEN none OR bare THEN 'warning' END AS severity,
          CASE WHEN length(body) > 200 THEN 'long line' WHEN sec IS NOT NULL THEN sec WHEN bug IS NOT NULL THEN bug WHEN slow IS NOT NULL THEN slow WHEN none THEN 'null at declaration' WHEN bare THEN 'bare try' END AS rule FROM r)
    SELECT * FROM s WHERE severity IS NOT NULL""")
def diff_review(spark, sf_dir):
    return scan.review(diffs(spark, sf_dir))


@query()
def commit_suggest(spark, sf_dir):
    return scan.commits(diffs(spark, sf_dir))


# Code: a class for each brand, a Python module for each size.

_CODE = """files AS (SELECT replace(p_brand, '#', '_') || '.cs' AS path, '// parts of ' || p_brand || chr(10) || 'public class ' || replace(p_brand, '#', '_') || ' {' || chr(10) ||
        string_agg('    /* ' || p_name || chr(10) || '       */' || chr(10) || '    public string Name' || p_partkey || ' { get; set; }' || chr(10) || chr(10) || chr(10) || '    public int Size' || p_partkey || '(int n) { // ' || p_name || chr(10) ||
        '        return n * ' || p_size || ' + 1000000 - Lookup(n); /* at http://parts/' || p_partkey || ' */ ' || chr(10) || '    }' || chr(10), '' ORDER BY p_partkey) || '}' || chr(10) AS code FROM part GROUP BY p_brand
    UNION ALL SELECT 'size_' || p_size || '.py', '# parts of a size' || chr(10) || 'import parts' || chr(10) || chr(10) || string_agg('def part_' || p_partkey || '(n):  # ' || p_name || chr(10) || '    x = n + ' || p_size || '  ' || chr(10) || '    return x' || chr(10), chr(10) ORDER BY p_partkey) FROM part GROUP BY p_size)"""


def code(spark, sf_dir) -> DataFrame:
    p = docs(spark, sf_dir, "part")
    name, k, size = F.col("p_name"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    method = F.concat(F.lit("    /* "), name, F.lit("\n       */\n    public string Name"), k, F.lit(" { get; set; }\n\n\n    public int Size"), k, F.lit("(int n) { // "), name,
                      F.lit("\n        return n * "), size, F.lit(" + 1000000 - Lookup(n); /* at http://parts/"), k, F.lit(" */ \n    }\n"))
    function = F.concat(F.lit("def part_"), k, F.lit("(n):  # "), name, F.lit("\n    x = n + "), size, F.lit("  \n    return x\n"))
    joined = lambda what, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", what.alias("s")))), lambda x: x["s"]), sep)
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    a = p.groupBy("p_brand").agg(joined(method, "").alias("b")).select(F.concat(brand, F.lit(".cs")).alias("path"), F.concat(F.lit("// parts of "), "p_brand", F.lit("\npublic class "), brand, F.lit(" {\n"), "b", F.lit("}\n")).alias("code"))
    b = p.groupBy("p_size").agg(joined(function, "\n").alias("b")).select(F.concat(F.lit("size_"), F.col("p_size").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("# parts of a size\nimport parts\n\n"), "b").alias("code"))
    return a.unionByName(b)


_PYTHON = r"""regexp_replace(code, '(?m)(^|[^''"])#[^!\n].*$', '\1', 'g')"""
_BRACES = r"""regexp_replace(regexp_replace(code, '(?s)/\*.*?\*/', '', 'g'), '(?m)(^|[^:])//.*$', '\1', 'g')"""


@query(rf"""WITH {_CODE}, s AS (SELECT path, CASE WHEN regexp_matches(code, '(?m)^\s*(?:def |class \w+.*:\s*$|import \w+\s*$|from \w+ import)') THEN {_PYTHON} ELSE {_BRACES} END AS code FROM files)
    SELECT path, regexp_replace(regexp_replace(regexp_replace(code, '(?m)[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS code FROM s""")
def code_strip(spark, sf_dir):
    return code(spark, sf_dir).select("path", route.strip_code("code").alias("code"))


@query()
def code_skeleton(spark, sf_dir):
    return code(spark, sf_dir).select("path", route.skeleton("code").alias("code"))


_SYMBOLS = f"""l AS (SELECT path, unnest(l) AS line, generate_subscripts(l, 1)::INT AS line_no FROM (SELECT path, string_split(code, chr(10)) AS l FROM files)),
    s AS ({" UNION ALL ".join(f"SELECT path, line_no, '{k}' AS kind, regexp_extract(line, {q.lit(p)}, 1) AS name FROM l" for k, p in scan.SYMBOLS.items())})"""


@query(f"WITH {_CODE}, {_SYMBOLS} SELECT * FROM s WHERE name <> ''")
def code_symbols(spark, sf_dir):
    return scan.symbols(code(spark, sf_dir))


@query(f"WITH {_CODE}, {_SYMBOLS} SELECT path, kind, count(*)::BIGINT AS n, count(DISTINCT name)::BIGINT AS names FROM s WHERE name <> '' GROUP BY path, kind")
def code_symbol_counts(spark, sf_dir):
    return scan.symbol_counts(code(spark, sf_dir))


# Transcripts: conversations in the six formats, by turns.

_FORMATS = ("openai-json", "chatml", "gemma", "llama-inst", "transcript", "plain")


def raw_conversations(spark, sf_dir) -> DataFrame:
    t = docs(spark, sf_dir, "conversations")
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.max((F.col("role") == "user").cast("int")).alias("asks"))
    put = lambda made, sep="": F.array_join(F.transform("t", made), sep)
    of = F.col("conv_id") % 6
    turn = lambda a, b: lambda x: F.concat(F.lit(a), x["role"], F.lit("\n"), x["text"], F.lit(b))
    inst = lambda x: F.when(x["role"] == "system", F.concat(F.lit("<<SYS>>"), x["text"], F.lit("<</SYS>>"))).when(x["role"] == "user", F.concat(F.lit("[INST] "), x["text"], F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), x["text"], F.lit(" </s>")))
    raw = (
        F.when(of == 1, put(turn("<|im_start|>", "<|im_end|>\n"))).when(of == 2, put(turn("<start_of_turn>", "<end_of_turn>"))).when((of == 3) & (F.col("asks") == 1), put(inst))
        .when(of == 4, put(lambda x: F.concat(F.initcap(x["role"]), F.lit(": "), x["text"]), "\n\n")).when(of == 5, put(lambda x: x["text"], "\n\n"))
        .otherwise(F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))))
    )
    return rows.select("conv_id", raw.alias("raw"))


@query(r"""WITH c AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare, count(*) OVER w AS n, max((role = 'user')::INT) OVER w AS asks, min(CASE WHEN role = 'user' THEN turn END) OVER w AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id)),
    f AS (SELECT *, CASE WHEN conv_id % 6 = 1 THEN 'chatml' WHEN conv_id % 6 = 2 THEN 'gemma' WHEN conv_id % 6 = 3 AND asks = 1 THEN 'llama-inst' WHEN conv_id % 6 = 4 AND n > 1 THEN 'transcript' WHEN conv_id % 6 IN (4, 5) THEN 'plain' ELSE 'openai-json' END AS format FROM c),
    k AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS i FROM f WHERE format <> 'plain' AND bare <> '' AND (format <> 'llama-inst' OR role <> 'assistant' OR turn > asked))
    SELECT conv_id, format, i AS turn, upper(role[1]) || role[2:] AS role, CASE WHEN format = 'transcript' THEN upper(role[1]) || role[2:] ELSE role END AS raw_role, CASE WHEN format = 'openai-json' THEN text ELSE bare END AS content FROM k
    UNION ALL SELECT conv_id, 'plain', 0, 'Unknown', NULL, regexp_replace(string_agg(CASE WHEN conv_id % 6 = 4 THEN upper(role[1]) || role[2:] || ': ' ELSE '' END || text, chr(10) || chr(10) ORDER BY turn), '^\s+|\s+$', '', 'g') FROM f WHERE format = 'plain' GROUP BY conv_id""")
def chat_parse(spark, sf_dir):
    d = raw_conversations(spark, sf_dir).select("conv_id", chat.parse("raw").alias("c"))
    return d.select("conv_id", "c.format", F.explode("c.turns").alias("t")).select("conv_id", "format", "t.*")


# Markdown of messages, with what a cleaner should take out.

_DRESSED = """m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '# Head' || chr(10) || chr(10) || '**Bold** and *slanted* words: ' || text || chr(10) || '```' || chr(10) || 'code()' || chr(10) || '```' || chr(10) || '---'
    WHEN 1 THEN '> quoted `x` [link](http://a/b) ![pic](c.png)' || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- ') WHEN 2 THEN '```json' || chr(10) || '{"a": 1}' || chr(10) || '```' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'data {"k": {"l": "m", "n": {"o": {"p": {"q": "r", "s": 1}}}}} end'
    ELSE '<div>' || text || '</div><script>let x = 1;</script>1. one  two' || chr(9) || 'three' END AS text FROM conversations)"""


def dressed(spark, sf_dir) -> DataFrame:
    t, of = F.col("text"), F.col("turn") % 4
    text = (
        F.when(of == 0, F.concat(F.lit("# Head\n\n**Bold** and *slanted* words: "), t, F.lit("\n```\ncode()\n```\n---")))
        .when(of == 1, F.concat(F.lit("> quoted `x` [link](http://a/b) ![pic](c.png)\n- "), F.replace(t, F.lit("\n"), F.lit("\n- "))))
        .when(of == 2, F.concat(F.lit('```json\n{"a": 1}\n```\n'), t, F.lit('\n\n\n\ndata {"k": {"l": "m", "n": {"o": {"p": {"q": "r", "s": 1}}}}} end')))
        .otherwise(F.concat(F.lit("<div>"), t, F.lit("</div><script>let x = 1;</script>1. one  two\tthree")))
    )
    return docs(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))


def _replaced(x: str, *steps: tuple[str, str]) -> str:
    for p, to in steps:
        x = f"regexp_replace({x}, {q.lit(p)}, {to if to.startswith('chr') else q.lit(to)}, 'g')"
    return x


_JSON = (r"\{[^{}]*\"[^\"{}]*\"\s*:[^{}]*\}|\[[^\[\]{}]*\"[^\"]*\"\s*:[^\[\]{}]*\]", "")
_CLEAN = _replaced(
    "text", (r"(?ms)^---\s*$.*?^---\s*$", ""), (r"(?is)```json\s*(.*?)```", ""), *[_JSON] * 8, (r"(?is)<script\b.*?</script>|<style\b.*?</style>", " "),
    (r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6]|table)>", "chr(10)"), (r"</?[A-Za-z][^>]*>", " "), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"(?s)```.*?```", ""), (r"`([^`]*)`", r"\1"),
    (r"(?m)^\s*(?:-{3,}|\*{3,}|_{3,})\s*$", ""), (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*|__([^_]+)__", r"\1\2"), (r"\*([^*\n]+)\*", r"\1"), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*(?:[-*+]|\d+\.)\s+", ""),
    (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", ""),
)


@query(f"WITH {_DRESSED} SELECT conv_id, turn, {_CLEAN} AS text FROM m")
def markdown_clean(spark, sf_dir):
    return dressed(spark, sf_dir).select("conv_id", "turn", route.markdown_text("text").alias("text"))


@query()
def chat_compact_dressed(spark, sf_dir):
    """Messages full of markup, cleaned before they are compacted."""
    return chat.compact(dressed(spark, sf_dir), chat.with_options("agent_memory", max_tokens=300, clean=True))


# Logs whose lines differ a little from each other.


@query(r"""WITH s AS (SELECT source AS log_id, doc_id AS no, regexp_extract(text, '^[^\n]{0,60}') AS line FROM documents), x AS (SELECT log_id, no, unnest([0, 1, 2]) AS k, line FROM s)
    SELECT log_id, (min(no) * 10)::BIGINT AS no, line || '  (repeated ' || 3 || 'x)' AS line, 3::BIGINT AS run FROM x WHERE line <> '' AND no % 3 = 0 GROUP BY log_id, no, line
    UNION ALL SELECT log_id, no * 10 + k, line || CASE WHEN k = 0 THEN '' ELSE ' ' || repeat(chr(97 + k::INT) || 'qz ', 40) END, 1 FROM x WHERE line <> '' AND no % 3 <> 0""")
def log_fold_fuzzy(spark, sf_dir):
    """Each document's first line three times, with other numbers (folded) or with other words (kept)."""
    line = F.regexp_extract("text", r"^[^\n]{0,60}", 0)
    d = docs(spark, sf_dir).select(F.col("source").alias("log_id"), "doc_id", line.alias("line"), F.explode(F.array(*map(F.lit, range(3)))).alias("k")).filter("line <> ''")
    other = F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit(" "), F.repeat(F.concat(F.chr(F.lit(97) + F.col("k")), F.lit("qz ")), 40)))
    d = d.select(F.concat("log_id", F.lit("/"), "doc_id").alias("part"), "log_id", (F.col("doc_id") * 10 + F.col("k")).alias("no"), F.when(F.col("doc_id") % 3 == 0, F.col("line")).otherwise(F.concat("line", other)).alias("line"))
    return route.fold_fuzzy_lines(d.select(F.col("part").alias("log_id"), "no", "line")).select(F.split("log_id", "/")[0].alias("log_id"), "no", "line", "run")
