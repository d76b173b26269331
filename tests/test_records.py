"""Routing, scans, ranking, chats, sources and streaming."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tokenpress.operators import chat, rank, route, scan
from tokenpress.sources import files, stores

DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,9 +1,9 @@\n" + "\n".join(f" c{i}" for i in range(6)) + "\n-old\n+new todo\n" + "\n".join(f" d{i}" for i in range(6))
LOG = "\n".join(f"2024-01-01 INFO step {i}" for i in range(30)) + "\nERROR boom exception\n  at Foo.Bar()\n  at Foo.Baz()"


@pytest.mark.parametrize("t, kind", [
    ('[{"a": 1}, {"a": 2}]', "JsonArray"), ('{"a": 1}', "JsonObject"), ("[not json]", "PlainText"), (DIFF, "GitDiff"), ("<html><body><div>x</div></body></html>", "Html"), (LOG, "Log"),
    ("\n".join(f"src/a.py:{i}:x" for i in range(6)), "SearchResults"), ("| a | b |\n|---|---|\n| 1 | 2 |", "Tabular"), ("a,b\n1,2\n3,4", "Tabular"), ("class A {\n public int x() {\n return 1; }\n}", "Code"), ("Just words here", "PlainText"), ("", "PlainText"), (None, "PlainText"),
])
def test_content_type(spark, t, kind):
    assert spark.createDataFrame([(t,)], "t string").select(route.content_type("t").alias("k")).first().k == kind


def test_routes_never_grow(spark):
    texts = ['[{"name":"a","value":1},{"name":"b","value":2},{"name":"c","value":3},{"name":"d","value":4}]', DIFF, LOG, "<html><body><div><p>Some text &amp; more</p></div></body></html>", "Plain words of the text that are here", "", None, "x,y\n1,2\n3,4"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in route.route(d).collect()}
    assert len(got) == len(texts) and all(r.after <= r.before for r in got.values())
    assert got[0].strategy.startswith("json:") and got[3].strategy == "html+prose" and "<" not in got[3].routed


def test_results_are_known_again(spark, tmp_path):
    rows = [(1, "Plain words of the text that are here"), (2, "Plain words of the text that are here"), (3, None), (4, "x,y\n1,2\n3,4")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda df: sorted(map(str, df.select("doc_id", "content_type", "strategy", "routed", "before", "after").collect()))
    folder = f"file://{tmp_path}/known"
    assert key(route.route_known(d, folder)) == key(route.route(d)) and spark.read.parquet(folder).count() == 3
    more = d.unionByName(spark.createDataFrame([(5, "Plain words of the text that are here"), (6, "other")], d.schema))
    assert key(route.route_known(more, folder)) == key(route.route(more)) and spark.read.parquet(folder).count() == 4
    route.route_known(d, folder, profile="aggressive")
    assert spark.read.parquet(folder).count() == 7


def lines(spark, rows):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "log_id int, no int, line string")


def test_fold(spark):
    fold = lambda rows: [r.line for r in sorted(route.fold_lines(lines(spark, rows)).collect(), key=lambda r: r.no)]
    assert fold([f"job {10_000 + i} done" for i in range(8)]) == ["job 10000 done  (repeated 8x)"]
    assert fold(["job 1", "job 2", "job 3"]) == ["job 1", "job 2", "job 3"] and fold(["a", "a"]) == ["a", "a"]
    rows = [f"user {n} logged in from 10.0.0.{i} ok" for i, n in enumerate(("ann", "bob", "eve"))] + ["something else entirely happened"]
    fuzzy = lambda rows, n: [r.line for r in sorted(route.fold_fuzzy_lines(lines(spark, rows), distance=n).collect(), key=lambda r: r.no)]
    assert len(fuzzy(rows, 30)) < 4 and fuzzy(rows, 0) == rows


def test_fuzzy_fold_by_hand(spark):
    """Runs are told against their first line; logs are apart; a run may be longer than a batch."""
    from tokenpress.functions.sketch import hamming, simhash_text

    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    logs = {k: [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)] for k in (1, 2)} | {3: ["same line again"] * 500, 4: ["x", None, "x"]}
    rows = [(k, i, x) for k, xs in logs.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    got = sorted((r.log_id, r.no, r.line, r.run) for r in route.fold_fuzzy_lines(spark.createDataFrame(rows, "log_id int, no int, line string").repartition(5)).collect())
    want = []
    for k, xs in logs.items():
        i = 0
        while i < len(xs):
            j = i + 1
            while j < len(xs) and ((xs[i] or "") == (xs[j] or "") or hamming(simhash_text(xs[i] or ""), simhash_text(xs[j] or "")) <= 18):
                j += 1
            want += [(k, i, f"{xs[i]}  (repeated {j - i}x)", j - i)] if j - i >= 3 else [(k, n, xs[n] or "", 1) for n in range(i, j)]
            i = j
    assert got == sorted(want)


def test_cleaned_before_compaction(spark):
    rows = [(1, 0, "system", "**Keep** this"), (1, 1, "user", "# Head\n**Bold** text with `code` {\"a\": {\"b\": {\"c\": {\"d\": {\"e\": 1, \"f\": \"g\"}}}}}"), (1, 2, "assistant", "```py\nx = 1\n```\nrm -rf **all**"), (2, 0, "user", "<html><body><div><p>one</p><script>x</script></div></body></html>"), (2, 1, "user", None)]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = lambda **o: {r.conv_id: r for r in chat.compact(d, chat.Options(**o)).collect()}
    plain, clean, html = made(), made(clean=True), made(extract_html=True)
    assert "**Bold**" in plain[1].text and plain[1].saved_usd == 0
    assert "Bold text with code" in clean[1].text and "{" not in clean[1].text and "**Keep**" in clean[1].text and "rm -rf **all**" in clean[1].text
    assert html[2].text == "User: one" and "`code`" in made(clean=True, keep_code=True)[1].text and '"e": 1' in made(clean=True, keep_json=True)[1].text
    assert made(min_words=3, min_sentences=1, min_stop_ratio=0.0, summarizer=lambda text, k: "short")[1].text.count("short") >= 1


def made_logs() -> list[str]:
    rng = random.Random(5)
    parts = ["INFO step", "WARN slow disk", "warning: deprecated", "ERROR boom", "  at Foo.Bar()", "at", " 12 |", "3 passed", "debug trace", "note", "", "view /a/b/c/page", "x 123456", "x 7654321", "ÄRGER 0xABCDEF", "C:\\tmp\\x, y"]
    out = []
    for n in (0, 1, 2, 5, 60, 81, 150, 400):
        for spread in (2, 6, len(parts)):
            rows = []
            while len(rows) < n:
                rows += [rng.choice(parts[:spread]) + rng.choice(["", f" {rng.randint(1, 3)}", f" {rng.randint(10_000, 99_999)}"])] * rng.choice([1, 1, 1, 2, 3, 7])
            out.append("\n".join(rows[:n]))
    return out


def test_logs_are_condensed_in_their_rows(spark):
    """As by the windows of fold_lines, select_lines and render_lines."""
    d = spark.createDataFrame(list(enumerate(made_logs())), "log_id int, text string")
    exploded = d.select("log_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    want = {r.log_id: r.text for r in route.render_lines(route.select_lines(route.fold_lines(exploded))).collect()}
    got = d.select("log_id", "text", route.log_lines("text").alias("l")).collect()
    for r in got:
        assert route.condense_log([x.asDict() for x in r.l]) == want[r.log_id], r.text


def test_kinds_are_told_once(spark):
    from tokenpress.operators import compress

    page = "<html><body><div><p>Some  text &amp; more of\u00a0 it\n\n\n\n <b>here</b></p></div></body></html> \u2028"
    diff = "diff --git a/y.py b/y.py\n" + "\n".join(f" c{i}" for i in range(9)) + "\n-a\n+b"
    rows = [(1, page), (2, diff), (3, LOG), (3, LOG), (None, LOG), (4, "class A {\n public int x() { // note\n return 1; }\n}"), (5, '{"a": "the words of it"}'), (6, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = route.route(d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Union") == 0 and plan.count("Scan") <= 1
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    one = lambda e, t: spark.createDataFrame([(t,)], "t string").select(e.alias("r")).first().r
    assert len(got[3]) == 2 and len(got[None]) == 1 and got[None][0].routed == got[3][0].routed and got[6][0].routed is None
    assert got[1][0].routed == compress.pruned(one(route.html_text("t"), page), "semantic")[1] and got[4][0].strategy == "code" and "note" not in got[4][0].routed and got[2][0].strategy == "diff"
    assert route.page_text(one(route._bare_page("t"), page)) == one(route.html_text("t"), page)


def test_diff_headers_each_begin_a_file(spark):
    diff = "\n".join(f"--- a/{i}\n@@ -1 +1 @@\n-a\n+b" for i in range(25))
    got = route.trim_diffs(spark.createDataFrame([(1, diff)], "diff_id int, diff string")).first()
    assert got.trimmed.count("--- a/") == 20 and (got.additions, got.deletions) == (25, 25)


def test_diffs_stay_in_their_rows(spark):
    """No line carries its whole diff through a shuffle, and rows are diffs of their own whatever their key."""
    d = spark.createDataFrame([(1, DIFF), (1, DIFF), (2, None), (3, "+a\n" + " x\n" * 5 + "@@ -1 +1 @@\n b\n@@ -9 +9 @@\n c\n c\n d\n-e")], "diff_id long, diff string")
    out = route.trim_diffs(d)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in out.collect())
    assert [r[0] for r in got] == [1, 1, 3] and got[0] == got[1] and got[2] == (3, "+a\n x\n x\n@@ -9 +9 @@\n c\n d\n-e", 1, 1)


def test_log_selection(spark):
    rows = [f"INFO step {i}" for i in range(200)]
    rows[100] = "ERROR boom"
    got = {r.no for r in route.select_lines(lines(spark, rows), most=20).collect()}
    assert {0, 199, 98, 99, 100, 101, 102} <= got and len(got) < 40
    out = route.render_lines(route.select_lines(lines(spark, rows), most=20)).first().text
    assert "... [lines omitted] ..." in out and "ERROR boom" in out


def test_diff(spark):
    d = spark.createDataFrame([(1, DIFF), (2, "")], "diff_id long, diff string")
    got = {r.diff_id: r for r in route.trim_diffs(d).collect()}
    assert (got[1].additions, got[1].deletions) == (1, 1) and "-old" in got[1].trimmed and " c0" not in got[1].trimmed and " c5" in got[1].trimmed
    found = scan.review(d).collect()
    assert [(r.severity, r.rule, r.file) for r in found] == [("info", "todo", "x.py")]
    assert scan.suggest_commit("")["message"] == "chore: empty diff" and len(scan.suggest_commit(DIFF)["message"]) <= 50


def test_crush():
    rows = [{"id": i, "name": f"n{i}"} for i in range(12)]
    out = route.crush_array(json.dumps(rows))
    assert out["strategy"] == "markdown" and len(out["text"]) < len(json.dumps(rows))
    mixed = [{f"k{i % 7}": i, "x": "needle" if i == 20 else "hay"} for i in range(40)]
    out = route.crush_array(json.dumps(mixed), "needle", 25)
    kept, dropped = json.loads(out["text"].split("\n<<ccr:")[0]), json.loads(out["aside"])
    assert out["strategy"] == "sample" and len(kept) + len(dropped) == 40 and any(r["x"] == "needle" for r in kept) and out["hash"] in out["text"]
    assert route.crush_array("nope")["text"] == "nope" and route.crush_array("[]")["strategy"] == "none"


@pytest.mark.parametrize("name", ["json_rows_markdown", "json_rows_csv", "json_row_drop"])
def test_arrays_are_crushed_once(spark, sf_dir, name):
    from tokenpress.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_tables_code_html(spark):
    t = "| a | b | c |\n|---|---|---|\n" + "\n".join(f"| {i} |  | same text here |" for i in range(9))
    out = route.shrink_table(t)
    assert out["changed"] and out["columns"] == 1
    one = lambda e: spark.createDataFrame([("x",)], "z string").select(e.alias("r")).first().r
    assert "note" not in one(route.strip_code(F.lit("int a; // note\n/* note */\nint b;"))) and one(route.strip_code(F.lit("x = 1  # note\ndef f():\n    pass"))).startswith("x = 1")
    body = "public class A {\n  void M() {\n    " + "doThis(); " * 10 + "\n  }\n}"
    sk = route.skeleton_text(body)
    assert "void M() { /* ... */ }" in sk and sk.count("{") == sk.count("}")
    assert "..." in route.skeleton_text("def f():\n    a = 1\n    b = 2\n    return a\n")
    assert one(route.html_text(F.lit("<style>p{}</style><script>x</script><h2>T</h2><p>a &eacute; b</p>"))) == "## T\n\na é b"
    assert one(route.markdown_text(F.lit('# Head\n- **bold** [l](u) ![i](v)\n```json\n{"a": 1}\n```\ntext {"k": {"z": 1}} end'))).split() == ["Head", "bold", "l", "text", "end"]


def test_entities_end_in_a_semicolon(spark):
    t = '<p>a &amp; b &copy; &#39;x&#x27; &amp;lt; &notit; &copy=1 &bogus; &quot'
    got = spark.createDataFrame([(t,), (None,), ("cut &am",), ("cut &amp",)], "t string").select(route.html_text("t").alias("x")).collect()
    assert [r.x for r in got] == ["a & b © 'x' &lt; &notit; &copy=1 &bogus; &quot", "", "cut &am", "cut &amp"]


def test_skeletons_of_long_files_take_one_pass():
    import time

    began = time.process_time()
    method = "  /* a */ int f(int n) { return n * 2 + lookup(n) - lookup(n * 2) + 1000000; }\n"
    got = route.skeleton_text("class A {\n" + method * 10_000 + "}\n")
    assert got == "class A {\n" + "  /* a */ int f(int n) { /* ... */ }\n" * 10_000 + "}\n"
    nested = "if (x) " + "{" * 10_000 + "y;" * 30 + "}" * 9_999
    assert route.skeleton_text(nested) == "if (x) {{ /* ... */ }"
    assert route.skeleton_text("\n".join(["def f(x):", "    a", "    b", ""] * 10_000)).count("...") == 10_000
    assert time.process_time() - began < 3


@pytest.mark.parametrize("t, level", [("hello there", "Normal"), ("a SQL injection was found", "Critical"), ("rm -rf / now", "Critical"), ("never do that", "Warning"), ("dossier and thermos", "Normal"), ("", "Normal"), (None, "Normal")])
def test_safety(spark, t, level):
    assert scan.safety_of(spark.createDataFrame([(t,)], "text string")).first().safety.level == level


def test_waste_and_volatile(spark):
    d = spark.createDataFrame([("clean text",), ("<div><p>x</p></div>" + "    " * 3 + "QUJD" * 20,), ("id 123e4567-e89b-12d3-a456-426614174000 at 2024-01-01T10:00:00Z " + "a" * 40,)], "t string")
    got = d.select(scan.waste("t").alias("w"), scan.volatile("t").alias("v")).collect()
    assert got[0].w.total == 0 and got[0].v == [] and got[1].w.html > 0 and got[1].w.base64 > 0 and got[1].w.blanks > 0
    assert [x.label for x in got[2].v] == ["uuid", "iso8601", "hex"]


def test_message_duplicates(spark):
    long = "the same long message that is repeated word for word later on"
    d = spark.createDataFrame([(1, i, long if i in (0, 1, 6) else f"turn {i}") for i in range(8)], "conv_id int, turn int, text string")
    got = {r.turn: r for r in scan.message_duplicates(d).collect()}
    assert got[6].duplicate_of == 0 and got[6].new_text == "[duplicate of message #0]" and got[1].duplicate_of is None and got[6].wasted == len(long) // 4


DOCS = [(0, "the car is red"), (1, "a fast car and a car race"), (2, "engine of the race motor"), (3, "cooking with garlic"), (4, "garden flowers")]


def test_retrieval(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = [r.doc_id for r in rank.retrieve(d, "car").collect()]
    want = rank.bm25_scores([t.split() for _, t in DOCS], {"car": 1.0})
    assert got == sorted((i for i in range(5) if want[i] > 0), key=lambda i: -want[i])
    assert {r.doc_id for r in rank.retrieve_rm3(d, "car").collect()} >= {0, 1, 2}
    assert rank.retrieve(d, "").count() == 0 and rank.retrieve(d, "zebra").count() == 0 and rank.retrieve_rm3(d, "zebra").count() == 0


FINANCE = "The bank raised its rates today. Bank rates affect the money market. The money market follows the bank. Investors watch the market rates. Bank money moves markets. Market investors like bank rates. Rates and money rule the bank. The market needs money."
WEATHER = "Rain fell over the hills. Hills of clouds bring rain. Storm clouds and wind came. The wind drove the rain. Clouds over hills mean storms. Wind and storm shook trees. Rain and wind again came. Storm rain filled the hills."


def test_summaries():
    both = FINANCE + " " + WEATHER
    parts = rank.segments(rank.split_sentences(both))
    assert parts[0][0] == 0 and parts[-1][1] == 16 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and len(parts) > 1
    for make in (rank.textrank, rank.tfidf_summary, rank.topic_summary):
        out = make(both, 4)
        assert 0 < len(out) < len(both) and all(s in both for s in rank.split_sentences(out))
        assert make("One. Two.", 5) == "One. Two."
    out = rank.topic_summary(both, 4)
    assert any(s in out for s in rank.split_sentences(FINANCE)) and any(s in out for s in rank.split_sentences(WEATHER))
    assert rank.apportion([3, 3, 4], 5) in ([2, 1, 2], [1, 2, 2]) and sum(rank.apportion([7, 1, 1], 4)) == 4
    assert rank.tfidf_summary(both, ratio=1.0) == both


def test_summaries_of_long_texts_are_small():
    """Choosing a few of many sentences makes no square of them; TextRank makes one, and no copies."""
    import tracemalloc

    n = 3000
    text = " ".join(f"Word{i % 97} follows word{i % 89} and word{i}." for i in range(n))
    for make, most in ((rank.tfidf_summary, 20e6), (rank.topic_summary, 20e6), (rank.textrank, n * n * 8 + n * (n + 300) * 4 + 30e6)):
        tracemalloc.start()
        assert len(rank.split_sentences(make(text, 3))) == 3
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most, make.__name__


def test_summaries_tell_the_language(spark):
    from tokenpress.operators import language

    rows = [(1, FINANCE + " " + WEATHER), (2, "Der Hund ist nicht hier. Die Katze ist auch nicht da. Das Haus und der Garten sind leer. Wir sind alle fort."), (3, None), (4, "One.")]
    d = language.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    for how in rank.SUMMARIES:
        got = d.select(rank.summary("text", 2, how, F.col("iso3")).alias("a"), rank.summary("text", 2, how, None).alias("b")).collect()
        assert all(r.a == r.b for r in got) and "hits_eng" not in d.select(rank.summary("text", 2, how, None))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("raw, name, roles", [
    ('[{"role":"system","content":"a"},{"role":"user","content":[{"type":"text","text":"b"},{"type":"image"}]}]', "openai-json", ["System", "User"]),
    ('{"messages":[{"role":"assistant","content":null,"tool_calls":[{"function":{"name":"f","arguments":"{}"}}]}]}', "openai-json", ["Assistant"]),
    ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo", "chatml", ["User", "Assistant"]), ("<start_of_turn>model\nyo<end_of_turn>", "gemma", ["Assistant"]),
    ("[INST] <<SYS>>s<</SYS>> q [/INST] a [INST] q2 [/INST] a2", "llama-inst", ["System", "User", "Assistant", "User", "Assistant"]),
    ("Utente: ciao\nAssistente: salve\naltro", "transcript", ["User", "Assistant"]), ("just prose: nothing", "plain", ["Unknown"]), ("", "plain", []),
])
def test_parse(raw, name, roles):
    got = chat.parse_conversation(raw)
    assert got[0] == name and [t["role"] for t in got[1]] == roles
    if "tool_calls" in raw:
        assert got[1][0]["content"] == "[tool_call: f({})]"


def test_compaction(spark):
    talk = FINANCE + " " + WEATHER
    turns = [(1, i, "user" if i % 2 else "assistant", talk if i < 6 else f"short turn {i}") for i in range(8)] + [(1, 9, "user", "Run rm -rf / carefully, there was a data breach.")] + [(2, 0, None, None)]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.compact(d, chat.with_options("default", max_tokens=250, deduplicate=True)).collect()}
    assert got[1].compacted_tokens <= 250 and got[1].within_budget and "data breach" in got[1].text and got[1].n_summarized + got[1].n_dropped > 0 and got[2].text == ""
    assert chat.compact(d, chat.with_options("faithful", max_tokens=1)).filter("not within_budget").count() == 1
    notes = chat.memory_notes(d.filter("turn = 0").select("conv_id", "text"))
    assert notes.count() == 2 and chat.recall(notes, "bank rates").first().conv_id == 1


def test_stores(spark, tmp_path):
    store = stores.ConversationStore(spark, str(tmp_path / "c"))
    turns = spark.createDataFrame([("a/b", 0, "user", "hi"), ("a/b", 1, "assistant", "yo"), ("c", 0, "user", "x")], "session_id string, turn int, role string, text string")
    store.save(turns)
    store.save(turns.filter("session_id = 'c'"))
    assert [(r.turn, r.role, r.content) for r in store.load("a/b").orderBy("turn").collect()] == [(0, "user", "hi"), (1, "assistant", "yo")] and store.sessions().count() == 2
    now = datetime(2024, 1, 1)
    side = stores.put(None, spark.createDataFrame([("h", "old"), ("g", "x")], "hash string, value string"), now, timedelta(minutes=5))
    side = stores.put(side, spark.createDataFrame([("h", "new")], "hash string, value string"), now + timedelta(minutes=3), timedelta(minutes=5))
    asked = spark.createDataFrame([("h",), ("g",)], "hash string")
    assert [tuple(r) for r in stores.get(side, asked, now + timedelta(minutes=6)).collect()] == [("h", "new")]
    writes = spark.createDataFrame([("k", "1", "a", now), ("k", "2", "b", now + timedelta(minutes=1)), ("z", "0", "a", now - timedelta(hours=2))], "key string, content string, agent string, at timestamp")
    assert [(r.key, r.content) for r in stores.latest(writes, now + timedelta(minutes=2)).collect()] == [("k", "2")]
    sums = stores.savings(spark.createDataFrame([("a", 10, 4, None), ("a", 0, 0, None), ("b", 5, 9, None), ("b", 7, 1, "bad")], "k string, original_tokens long, compressed_tokens long, error string"), "k")
    assert {r.k: (r.n, r.saved_tokens) for r in sums.collect()} == {"a": (1, 6), "b": (1, 0), None: (2, 6)}


def test_files(spark, tmp_path):
    (tmp_path / "p" / "bin").mkdir(parents=True)
    for name, body in {"readme.md": "hello", "a.py": "x = 1", "bin/b.py": "no", "requirements.txt": "numpy==2.0\npandas\n", "x.csproj": '<PackageReference Include="P" Version="1.2" /><ProjectReference Include="..\\q.csproj" />', "package.json": '{"dependencies": {"left": "^1.0.0"}}'}.items():
        (tmp_path / "p" / name).write_text(body)
    path = str(tmp_path / "p")
    assert {r.name for r in files.read_context(spark, path).collect()} == {"readme.md"} and files.read_sources(spark, path, 50).count() == 2
    project = files.read_project(spark, path)
    assert not any("/bin/" in r.path for r in project.collect())
    assert {(r.kind, r.name, r.version) for r in files.dependencies(project).collect()} == {("package", "numpy", "2.0"), ("package", "pandas", ""), ("package", "P", "1.2"), ("project", "..\\q.csproj", ""), ("package", "left", "^1.0.0")}
    assert "## " in files.bundle(project).first().markdown and "numpy" in files.wiki(project)
    (tmp_path / "l.yaml").write_text("iso3: eng\nname: English\nfunction_words:\n  - the\n  - 'of'\nlemmas:\n  cars: car\nverbs:\n  go: [goes, went]\nproper_nouns:\n  - Rome\n")
    got = {(r.section, r.form, r.lemma) for r in files.read_lexicon(spark, str(tmp_path / "l.yaml")).collect()}
    assert got == {("function_words", "the", None), ("function_words", "of", None), ("lemmas", "cars", "car"), ("verbs", "goes", "go"), ("verbs", "went", "go"), ("proper_nouns", "rome", None)}
    (tmp_path / "t.conllu").write_text("# c\n1-2\tdu\t_\t_\n1\tCars\tcar\tNOUN\n2\tcars\tcar\tNOUN\n3\tcars\tcars\tVERB\n4\tcars\tcar\tNOUN\n5.1\tx\tx\tX\n\n")
    r = files.frequent_lemmas(files.read_conllu(spark, str(tmp_path / "t.conllu"))).first()
    assert (r.form, r.lemma, r.upos, r.is_name) == ("cars", "car", "NOUN", False)


def test_streams(spark, sf_dir):
    from tokenpress.plans.catalogue import QUERIES

    got = QUERIES["stream_context_window"](spark, sf_dir).collect()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    systems = {r.conv_id: r.n for r in turns.groupBy("conv_id").agg(F.sum((F.col("role") == "system").cast("int")).alias("n")).collect()}
    assert got and all(r.within_budget or r.n_turns <= 4 + systems[r.conv_id] for r in got)  # the last four and the system's stay
    want = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    assert QUERIES["stream_dedup"](spark, sf_dir).count() == want == len(got)


def test_shaper(spark):
    d = spark.createDataFrame([("do it",)], "p string").select(scan.shape(F.col("p"), 3).alias("a"))
    d = d.select("a", scan.shape(F.col("a"), 3).alias("b"), scan.unshape(F.col("a")).alias("c"), scan.shape(F.col("a"), 0).alias("z"))
    r = d.first()
    assert r.a == r.b == r.z and r.c == "do it"


def test_sql_functions(spark):
    from tokenpress.functions import sql, text
    from tokenpress.operators.chat import count_tokens

    assert len(sql.register(spark)) == 8
    t = "The  Cat     sat. It ran internationally!"
    r = spark.sql(f"SELECT tp_token_count('{t}') AS n, tp_fingerprint(' {t} ') AS f, tp_terms('{t}') AS w, tp_simhash('{t}') AS h, tp_sentences('{t}', 'eng') AS s, tp_textrank('{t}', 1) AS r, tp_iso3('de') AS l").first()
    assert r.n == count_tokens(t) and r.w[:2] == ["the", "cat"] and len(r.s) == 2 and r.r in t and r.l == "deu"
    assert r.f == spark.createDataFrame([(t,)], "t string").select(text.fingerprint("t").alias("f")).first().f
    got = spark.sql("SELECT * FROM tp_parse_conversation('User: hi\nAssistant: yo')").collect()
    assert [(x.format, x.role, x.content) for x in got] == [("transcript", "User", "hi"), ("transcript", "Assistant", "yo")]


def test_focus_and_context(spark, tmp_path):
    t = "about cats\n\nabout the report on cars\n\nnothing\n\ncars again"
    d = spark.createDataFrame([(t,), ("short",), (None,)], "t string").select(rank.focus("t", "car report", 2).alias("x"))
    assert [r.x for r in d.collect()] == ["about the report on cars\n\ncars again", "short", ""]
    (tmp_path / "notes.md").write_text("the report is about the cars")
    assert "report car" in files.condensed_context(spark, str(tmp_path)).first().markdown


def test_grep_reads_every_line(spark, sf_dir, tmp_path):
    """Against the registered SQL, but with a row for each line of a text in place of its first."""
    import duckdb

    from tokenpress.plans import records

    spark.createDataFrame([(1, "start\r\nx\ran error of the onand\nend", "a"), (2, "one\n\n" + "the\n" * 9 + "failed", "a"), (3, "plain", "b")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = "m AS (SELECT file, doc_id * 1000000000 + i AS line_no, content FROM (SELECT 'src/' || source || '.txt' AS file, doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"
    for folder, files in ((str(tmp_path), "/documents.parquet/*.parquet"), (sf_dir, "/documents.parquet")):
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}{files}'")
        got = records.grep_top_matches(spark, folder).collect()
        assert sorted(map(tuple, got)) == sorted(c.execute(records.ORACLE_SQL["grep_top_matches"].replace(records._GREP, lines)).fetchall())
        if folder == str(tmp_path):
            assert ("src/a.txt", 1_000_000_002, "x\ran error of the onand", 1.0) in {tuple(r)[:4] for r in got}
