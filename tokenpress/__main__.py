"""python -m tokenpress COMMAND FILE: compress, route, summarize, detect, tokens, safety or parse one text file; benchmark FILE...: token
savings of each level."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

from .functions.text import token_count
from .operators import chat, compress, language, rank, route, scan
from .session import session

COMMANDS = {
    "compress": lambda d: compress.compress(d, "semantic"), "route": route.route, "summarize": lambda d: d.select("doc_id", rank.summary("text", 5).alias("summary")), "detect": language.detect,
    "tokens": lambda d: d.select("doc_id", token_count("text").alias("tokens")), "safety": scan.safety_of, "parse": lambda d: d.select("doc_id", F.explode(chat.parse("text")["turns"]).alias("t")).select("t.*"),
}


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in (*COMMANDS, "benchmark"):
        print(__doc__)
        return 2
    spark = session("local[*]", 4)
    spark.sparkContext.setLogLevel("ERROR")
    d = spark.createDataFrame([(f, Path(f).read_text()) for f in args[1:]], "doc_id string, text string")
    if args[0] != "benchmark":
        COMMANDS[args[0]](d).show(1000, truncate=False)
        return 0
    out = d.select("doc_id", token_count("text").alias("tokens"))
    for level in compress.LEVELS[1:]:
        out = out.join(compress.compress(d, level).select("doc_id", F.round("efficiency", 1).alias(level)), "doc_id")
    out.orderBy("doc_id").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
