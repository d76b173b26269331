"""Queries on pages, conversations, events, records, logs, diffs and code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chat, rank, route, scan
from ..sources import stores
from ..streaming import events as windows
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


def _kind_sql(x: str) -> str:
    """Kind of a text; texts here hold no JSON, so JSON is told by json_valid."""
    t = f"coalesce({x}, '')"
    count = lambda p: f"len(regexp_extract_all({t}, {q.lit(p)}))"
    trimmed = f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    lead = f"regexp_replace({t}, '^\\s+', '')"
    marks = lambda ms, y: " + ".join(f"contains({y}, {q.lit(m)})::INT" for m in ms)
    first = f"split_part({lead}, chr(10), 1)"
    frames = f"({count('(?m)^' + chr(92) + 's*at' + chr(92) + 's+' + chr(92) + 'S')} + CASE WHEN contains({t}, 'Traceback (most recent call last)') THEN 3 ELSE 0 END)"
    levels = count(route.LEVEL_WORD)
    return f"""CASE WHEN NOT regexp_matches({t}, '[^\\s]') THEN 'PlainText'
        WHEN starts_with({trimmed}, '[') AND ends_with({trimmed}, ']') AND json_valid({t}) THEN 'JsonArray'
        WHEN starts_with({trimmed}, '{{') AND ends_with({trimmed}, '}}') AND json_valid({t}) THEN 'JsonObject'
        WHEN starts_with({lead}, 'diff --git') OR {count('(?m)^(?:' + chr(92) + '+' + chr(92) + '+' + chr(92) + '+|---)' + chr(92) + 's')} >= 5 THEN 'GitDiff'
        WHEN {marks(route.HTML_MARKS, f'lower(substr({t}, 1, 2000))')} >= 3 THEN 'Html'
        WHEN {frames} >= 3 OR ({frames} >= 1 AND {levels} >= 2) OR {levels} >= 5 THEN 'Log'
        WHEN {count('(?m)^' + chr(92) + 's*' + chr(92) + 'd+' + chr(92) + '.' + chr(92) + 's+' + chr(92) + 'S')} >= 5 OR {count('(?m)^[A-Za-z0-9_./@' + chr(92) + '-' + chr(92) * 2 + '][^:' + chr(92) + 'n]*:' + chr(92) + 'd+:' + chr(92) + 'S')} >= 5 THEN 'SearchResults'
        WHEN (starts_with({lead}, '|') AND ends_with(rtrim({first}), '|')) OR ((contains({first}, ',') OR contains({first}, chr(9)) OR contains({first}, ';')) AND len(list_filter(string_split({t}, chr(10)), lambda l: l <> '')) >= 3) THEN 'Tabular'
        WHEN {marks(route.CODE_MARKS, t)} >= 4 THEN 'Code' ELSE 'PlainText' END"""


@query(f"SELECT 'd' || doc_id AS id, {_kind_sql('text')} AS kind FROM documents UNION ALL SELECT 'p' || page_id, {_kind_sql('html')} FROM pages")
def content_type(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(docs(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")))
    return d.select("id", route.content_type("text").alias("kind"))


XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _html_sql(x: str, entities=XML_ENTITIES) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g')"
    for n in range(1, 7):
        t = f"regexp_replace({t}, '(?i)<h{n}(?:\\s[^>]*)?>', chr(10) || '{'#' * n} ', 'g')"
    t = f"regexp_replace({t}, '(?i)</?(?:p|div|section|article|header|footer|main|nav|ul|ol|table|tr|blockquote|pre|h[1-6])(?:\\s[^>]*)?>|<br\\s*/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?i)<li(?:\\s[^>]*)?>', chr(10) || '- ', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for a, b in entities:
        t = f"replace({t}, {q.lit(a)}, {q.lit(b)})"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def html_text(spark, sf_dir):
    return docs(spark, sf_dir, "pages").select("page_id", route.html_text("html", entities=False).alias("text"))


@query(f"SELECT page_id, {_html_sql('html', (('&copy;', '©'), ('&middot;', '·'), *XML_ENTITIES[:4], ('&nbsp;', chr(160)), XML_ENTITIES[5]))} AS text FROM pages")
def html_text_all_entities(spark, sf_dir):
    return docs(spark, sf_dir, "pages").select("page_id", route.html_text("html").alias("text"))


@query("""WITH k AS (SELECT *, CASE WHEN length(text) >= 50 THEN substr(sha256(text), 1, 16) END AS k FROM conversations), f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, k) AS f FROM k)
    SELECT conv_id, turn, CASE WHEN k IS NOT NULL AND turn - f > 3 THEN f END AS duplicate_of, CASE WHEN k IS NOT NULL AND turn - f > 3 THEN '[duplicate of message #' || f || ']' ELSE text END AS new_text,
           (CASE WHEN k IS NOT NULL AND turn - f > 3 THEN greatest(1, length(text) // 4) ELSE 0 END)::BIGINT AS wasted FROM f""")
def message_dups(spark, sf_dir):
    return scan.message_duplicates(docs(spark, sf_dir, "conversations")).select("conv_id", "turn", "duplicate_of", "new_text", "wasted")


@query(r"SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY role, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1")
def first_seen_dedup(spark, sf_dir):
    d = docs(spark, sf_dir, "conversations").withColumn("at", F.struct("conv_id", "turn"))
    return stores.first_seen(d, "role", "at", "text").select("conv_id", "turn", "text")


@query("""SELECT conv_id, '[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn) || ']' AS messages FROM conversations GROUP BY conv_id""")
def messages_json(spark, sf_dir):
    return chat.as_json(docs(spark, sf_dir, "conversations"))


@query("SELECT conv_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript(spark, sf_dir):
    return chat.as_transcript(docs(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def recent_turns(spark, sf_dir):
    return chat.recent_turns(docs(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query(f"WITH c AS (SELECT conv_id, turn, {q.token_count('text')} AS tokens FROM conversations), s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS from_newest FROM c) SELECT * FROM s WHERE from_newest <= 400")
def budget_suffix(spark, sf_dir):
    return chat.budget_suffix(docs(spark, sf_dir, "conversations"), 400)


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{M}}]{{4,}}') AS l FROM conversations)),
    g AS (SELECT id, lower(w) AS low, count(*)::BIGINT AS n, arg_min(w, i) AS word, max(regexp_matches(w, '^\\p{{Lu}}')::INT) AS cap FROM w WHERE NOT {q.one_of('lower(w)', q.catalogue()['eng'].function_words)} GROUP BY id, lower(w)),
    r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY cap DESC, n DESC, low) AS rank, word, n FROM g) SELECT * FROM r WHERE rank <= 10""")
def memory_keywords(spark, sf_dir):
    d = docs(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rank.keywords(d, "id")


@query()
def memory_note(spark, sf_dir):
    return chat.memory_notes(chat.as_transcript(docs(spark, sf_dir, "conversations")).withColumnRenamed("transcript", "text"))


@query()
def memory_recall(spark, sf_dir):
    return chat.recall(memory_note(spark, sf_dir), "the thing with that")


@query()
def chat_compact(spark, sf_dir):
    return chat.compact(docs(spark, sf_dir, "conversations"), chat.with_options("agent_memory", max_tokens=300))


@query()
def chat_faithful(spark, sf_dir):
    return chat.compact(docs(spark, sf_dir, "conversations"), "faithful")


def _per_customer(spark, sf_dir) -> DataFrame:
    """A JSON array of each customer's orders."""
    o = docs(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderstatus", "o_orderpriority").alias("r"))
    return o.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("raw"))


_ROWS = "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders"


@query(f"""WITH r AS ({_ROWS}), j AS (SELECT o_custkey, n, '| o_orderkey | o_orderpriority | o_orderstatus |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
        string_agg('| ' || o_orderkey || ' | ' || o_orderpriority || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY i) AS md,
        '[' || string_agg('{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}}', ',' ORDER BY i) || ']' AS raw FROM r GROUP BY o_custkey, n)
    SELECT o_custkey, md AS text FROM j WHERE n <= 50 AND length(md) <= 0.85::DOUBLE * length(raw)""")
def json_rows_markdown(spark, sf_dir):
    d = _per_customer(spark, sf_dir).select("o_custkey", route.crush("raw").alias("c"))
    return d.filter("c.strategy = 'markdown'").select("o_custkey", "c.text")


@query("""WITH p AS (SELECT p_brand, p_partkey AS k, p_name AS n, p_size AS z FROM part),
    t AS (SELECT p_brand, count(*) AS c, '#schema: k,name,size' || chr(10) || string_agg(k || ',' || CASE WHEN regexp_matches(n, '[",\n]') THEN '"' || replace(n, '"', '""') || '"' ELSE n END || ',' || z, chr(10) ORDER BY k) AS csv,
          '| k | name | size |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || k || ' | ' || n || ' | ' || z || ' |', chr(10) ORDER BY k) AS md,
          '[' || string_agg('{"k":' || k || ',"name":"' || n || '","size":' || z || '}', ',' ORDER BY k) || ']' AS raw FROM p GROUP BY p_brand)
    SELECT p_brand, csv AS text FROM t WHERE NOT (c <= 50 AND length(md) <= 0.85::DOUBLE * length(raw)) AND length(csv) <= 0.85::DOUBLE * length(raw)""")
def json_rows_csv(spark, sf_dir):
    p = docs(spark, sf_dir, "part").select("p_brand", F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("r"))
    d = p.groupBy("p_brand").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("raw")).select("p_brand", route.crush("raw").alias("c"))
    return d.filter("c.strategy = 'csv'").select("p_brand", "c.text")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
    a AS (SELECT *, i < (n * 3 + 9) // 10 OR i >= n - (n * 15 + 99) // 100 AS anchor FROM (SELECT * FROM r WHERE n > 15)),
    f AS (SELECT *, sum(anchor::INT) OVER (PARTITION BY o_custkey) AS anchors, sum((NOT anchor)::INT) OVER (PARTITION BY o_custkey ORDER BY i) AS fill FROM a)
    SELECT o_custkey, o_orderkey FROM f WHERE anchor OR fill <= 15 - anchors""")
def json_row_drop(spark, sf_dir):
    """Rows of long arrays of mixed values that stay."""
    o = docs(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    d = o.select("o_custkey", route.crush(F.to_json("k")).alias("c")).filter("c.strategy = 'sample'")
    return d.select("o_custkey", F.explode(F.from_json(F.substring_index("c.text", "\n", 1), "array<bigint>")).alias("o_orderkey"))


@query("""SELECT n_regionkey, '| n_name | n_nationkey |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def table_prune(spark, sf_dir):
    """Tables with a constant and an empty column, which go."""
    row = F.concat(F.lit("| "), "n_name", F.lit(" |  | "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit(" |"))
    d = docs(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("body"))
    table = F.concat(F.lit("| n_name | note | n_nationkey | n_regionkey |\n|---|---|---|---|\n"), "body")
    return d.select("n_regionkey", route.shrink_tables(table).alias("t")).select("n_regionkey", "t.text")


_LOG = """lines AS (SELECT user_id AS log_id, event_id AS no, CASE event_type WHEN 'error' THEN 'ERROR failed request ' || event_id || ' of user ' || user_id WHEN 'purchase' THEN 'WARN slow payment ' || (1000 + event_id % 3)
    WHEN 'signup' THEN 'INFO new account' WHEN 'click' THEN 'debug click on /a/b/c/page' ELSE 'view ' || (10000 + event_id) END AS line FROM events)"""


def log_lines(spark, sf_dir) -> DataFrame:
    e, n = F.col("event_type"), F.col("event_id")
    line = (
        F.when(e == "error", F.concat(F.lit("ERROR failed request "), n.cast("string"), F.lit(" of user "), F.col("user_id").cast("string"))).when(e == "purchase", F.concat(F.lit("WARN slow payment "), (1000 + n % 3).cast("string")))
        .when(e == "signup", "INFO new account").when(e == "click", "debug click on /a/b/c/page").otherwise(F.concat(F.lit("view "), (10000 + n).cast("string")))
    )
    return docs(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), n.alias("no"), line.alias("line"))


_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(line, {q.lit(p)}) THEN '{k}'" for k, p in route.LOG.items()) + " ELSE 'unknown' END"


@query(f"WITH {_LOG} SELECT no, {_LEVEL} AS level, CASE {_LEVEL} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in route.LOG_SCORE.items()) + " END AS score FROM lines")
def log_classify(spark, sf_dir):
    d = log_lines(spark, sf_dir).withColumn("level", route.log_level(F.col("line")))
    return d.select("no", "level", route.log_score(F.col("level")).alias("score"))


_NOISE = r"regexp_replace(regexp_replace(regexp_replace(line, '\b\d{4,}\b', 'N', 'g'), '\b0x[0-9a-fA-F]{4,}\b', 'ADDR', 'g'), '[A-Za-z]:\\[^\s,]+|/(?:[^\s/]+/){2,}[^\s]+', '/PATH', 'g')"


def _fold_sql(lines: str) -> str:
    """CTEs up to folded."""
    return f"""n AS (SELECT *, {_NOISE} AS n FROM {lines}), c0 AS (SELECT *, (n IS DISTINCT FROM lag(n) OVER w OR row_number() OVER w = 1)::INT AS new FROM n WINDOW w AS (PARTITION BY log_id ORDER BY no)),
        r0 AS (SELECT *, sum(new) OVER (PARTITION BY log_id ORDER BY no) AS r FROM c0), s0 AS (SELECT *, count(*) OVER (PARTITION BY log_id, r) AS run FROM r0),
        folded AS (SELECT log_id, no, CASE WHEN run >= 3 THEN line || '  (repeated ' || run || 'x)' ELSE line END AS line, CASE WHEN run >= 3 THEN run ELSE 1 END::BIGINT AS run FROM s0 WHERE run < 3 OR new = 1)"""


def _select_sql(lines: str) -> str:
    """CTEs up to chosen."""
    return f"""c AS (SELECT log_id, no, line, {_LEVEL} AS level FROM {lines}),
        s AS (SELECT *, CASE level WHEN 'error' THEN 1.0 WHEN 'stack' THEN 0.8 WHEN 'summary' THEN 0.9 WHEN 'warn' THEN 0.5 WHEN 'info' THEN 0.1 WHEN 'debug' THEN 0.05 ELSE 0 END AS score,
              row_number() OVER (PARTITION BY log_id ORDER BY no) AS i, count(*) OVER (PARTITION BY log_id) AS total, row_number() OVER (PARTITION BY log_id, level ORDER BY no) AS nth FROM c),
        k AS (SELECT *, CASE WHEN i = 1 OR i = total THEN 0 WHEN level = 'error' AND nth <= 10 THEN 1 WHEN level = 'summary' THEN 2 WHEN level = 'warn' AND nth <= 5 THEN 3 ELSE 4 END AS rk FROM s),
        p AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY rk, score DESC, no) AS place FROM k), st AS (SELECT *, rk < 4 OR place <= 80 AS stays FROM p),
        a AS (SELECT *, max((stays AND level IN ('error', 'stack'))::INT) OVER (PARTITION BY log_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS around FROM st),
        w AS (SELECT *, row_number() OVER (PARTITION BY log_id, lower({_NOISE}) ORDER BY NOT stays, rk, place) AS n FROM a WHERE stays OR around OR total <= 80),
        chosen AS (SELECT log_id, no, line, level FROM w WHERE level <> 'warn' OR n = 1 OR total <= 80)"""


_SEVEN = "seven AS (SELECT no % 7 AS log_id, no, line FROM lines)"


@query(f"WITH {_LOG}, {_fold_sql('lines')} SELECT * FROM folded")
def log_fold(spark, sf_dir):
    return route.fold_lines(log_lines(spark, sf_dir))


@query(f"WITH {_LOG}, {_SEVEN}, {_select_sql('seven')} SELECT * FROM chosen")
def log_select(spark, sf_dir):
    return route.select_lines(log_lines(spark, sf_dir).withColumn("log_id", F.col("no") % 7))


@query(f"""WITH {_LOG}, {_SEVEN}, {_fold_sql('seven')}, {_select_sql('folded')}, g AS (SELECT *, no > lag(no) OVER (PARTITION BY log_id ORDER BY no) + 1 AS gap FROM chosen)
    SELECT log_id, string_agg(CASE WHEN gap THEN '... [lines omitted] ...' || chr(10) ELSE '' END || line, chr(10) ORDER BY no) AS text FROM g GROUP BY log_id""")
def log_condensed(spark, sf_dir):
    folded = route.fold_lines(log_lines(spark, sf_dir).withColumn("log_id", F.col("no") % 7))
    return route.render_lines(route.select_lines(folded))


_GREP = """m AS (SELECT 'src/' || source || '.txt' AS file, doc_id * 1000000000 + i AS line_no, content FROM (SELECT source, doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS i
    FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


@query(f"""WITH {_GREP}, s AS (SELECT *, round(least((CASE WHEN regexp_matches(content, {q.lit(route.LOG['error'])}) THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(content), 'the') THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(content), 'onand') THEN 0.3::DOUBLE ELSE 0 END), 1), 6) AS score FROM m),
    f AS (SELECT file, round(sum(score), 6) AS file_score FROM s GROUP BY file ORDER BY file_score DESC, file LIMIT 15),
    r AS (SELECT s.*, file_score, row_number() OVER (PARTITION BY file ORDER BY line_no, content) AS a, count(*) OVER (PARTITION BY file) AS n, row_number() OVER (PARTITION BY file ORDER BY score DESC, line_no, content) AS r FROM s JOIN f USING (file))
    SELECT file, line_no, content, score, file_score FROM r WHERE n <= 5 OR a = 1 OR a = n OR r <= 5""")
def grep_top_matches(spark, sf_dir):
    """Every line of every text; a line's number is that of its document and, in nine digits, its place there."""
    d = docs(spark, sf_dir).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    no = F.col("doc_id") * 1_000_000_000 + F.col("i") + 1
    d = d.select(F.concat(F.lit("src/"), "source", F.lit(".txt:"), no.cast("string"), F.lit(":"), "content").alias("line"))
    return route.top_matches(route.grep_matches(d, query="the onand"))


@query("SELECT doc_id, text || chr(10) || chr(10) || '<!-- steering -->' || chr(10) || 'Be brief. Skip introductions and repetition.' AS shaped, regexp_replace(text, '\\s+$', '') AS plain FROM documents")
def output_shaper(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", scan.shape(F.col("text"), 2).alias("shaped"))
    return d.select("doc_id", scan.shape(F.col("shaped"), 2).alias("shaped"), scan.unshape(F.col("shaped")).alias("plain"))


@query()
def route_all(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(docs(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")))
    return route.route(d, "id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return windows.tumbling_windows(docs(spark, sf_dir, "events"))


@query("SELECT begin, event_type, count(*)::BIGINT AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS begin, event_type FROM events, (SELECT unnest([0, 1]) AS o)) GROUP BY ALL")
def events_sliding(spark, sf_dir):
    return windows.sliding_windows(docs(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS begin, max(ts) AS last, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def events_session(spark, sf_dir):
    return windows.session_windows(docs(spark, sf_dir, "events"))


def _stream(spark, sf_dir, make, mode: str, name: str) -> DataFrame:
    """Runs a stream over conversations to its end and returns what it wrote, in the cluster's shared folder."""
    import tempfile
    import uuid

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = docs(spark, sf_dir, "conversations")
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix=f"{name}-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    source.write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    made = make(stream)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    made.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query()
def stream_context_window(spark, sf_dir):
    from ..streaming.window import context_window

    return _stream(spark, sf_dir, context_window, "update", "window")


@query(r"SELECT conv_id, count(*)::BIGINT AS n FROM (SELECT DISTINCT conv_id, lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS f FROM conversations) GROUP BY conv_id")
def stream_dedup(spark, sf_dir):
    from ..streaming.window import drop_seen

    return _stream(spark, sf_dir, lambda s: drop_seen(s), "append", "dedup").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT role, count(*)::BIGINT AS n, sum(t)::BIGINT AS original_tokens, sum(t)::BIGINT AS compressed_tokens FROM (SELECT role, {q.token_count('text')} AS t FROM conversations) WHERE t > 0 GROUP BY role")
def stream_counters(spark, sf_dir):
    from ..streaming.window import running_savings

    count = lambda s: running_savings(s.select("role", text.token_count("text").alias("original_tokens"), text.token_count("text").alias("compressed_tokens")), "role")
    return _stream(spark, sf_dir, count, "complete", "counters")
