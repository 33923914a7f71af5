"""Line deduplication across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.llm.scratch import kept

#: White space that is stripped from both ends of a line: space, tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    lower() does just that where the text has no other upper-case letters, which shows in
    what is left without its ASCII characters; translate(), slow, is kept for the rest.
    """
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return (
        F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
        .when(F.lower(rest) == rest, F.lower(text))
        .otherwise(F.translate(text, UPPER, LOWER))
    )


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hash(key: Column) -> list[Column]:
    """128 bits of the key: equal keys give equal hashes, and chance collisions are out of reach."""
    return [F.xxhash64(key).alias("__a"), F.xxhash64(F.lit(7), F.reverse(key)).alias("__b")]


def without(lines: Column, gone: Column) -> Column:
    """The lines whose positions are not among `gone`, which ascends: one pass over both.

    Each lost position writes a mark after as many blanks as lines stay before it; the marks,
    one a character, go beside the lines.
    """
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, F.lit(1), F.greatest(F.size(gone) - 1, F.lit(0))))
    marks = F.array_join(F.zip_with(gone, before, lambda g, b: F.concat(F.repeat(F.lit(" "), g - b - 1), F.lit("x"))), "")
    beside = F.zip_with(lines, F.split(marks, ""), lambda line, m: F.struct(line.alias("line"), m.alias("m")))
    return F.transform(F.filter(beside, lambda s: s["line"].isNotNull() & (F.coalesce(s["m"], F.lit(" ")) != "x")), lambda s: s["line"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines whose key is found in at least `min_docs` documents, but in the largest id holding it.

    Returns the columns of `docs`, the text rebuilt from the lines that stay, and n_lines
    (before dropping) and n_dropped. Text splits at newlines; null and empty texts are one
    empty line, and come back empty. Keys under `min_chars` code points never count. A null id
    holds no line for the count and keeps all its lines; an id given on several rows counts
    once, and each of its rows keeps or drops lines alike. Equal rows stay equal rows. An empty
    table gives an empty table. Columns of other names pass through, but for names that begin
    with two underscores, n_lines and n_dropped, which are replaced.

    Only hashes leave a document for counting: lines that qualify, once per document, are
    exploded, counted with map-side combining, and joined back to give each document the
    positions it loses; the texts move once, in the join with those positions.
    """
    others = [c for c in docs.columns if not c.startswith("__") and c not in ("n_lines", "n_dropped")]
    docs = docs.select(*others)
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    print_of = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # a line has to have the bytes before its characters are worth counting
    long_enough = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line"))),
        lambda s: (F.octet_length(s["line"]) >= min_chars) & (F.char_length(F.btrim(s["line"], F.lit(BLANKS))) >= min_chars),
    )
    each = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) >= min_chars)).select(
        F.col(id_col).alias("__id"), print_of.alias("__print"), F.explode(long_enough).alias("__l")
    )
    each = each.select("__id", "__print", F.col("__l.pos").alias("__pos"), line_key(F.col("__l.line")).alias("__k"))
    each = kept(each.select("__id", "__print", "__pos", *line_hash(F.col("__k"))), "lines")
    # tables of their own, so that both joins are between plain scans, whose hot keys Spark can split
    spread = kept(
        each.groupBy("__a", "__b", "__id").agg(F.lit(1).alias("__one"))
        .groupBy("__a", "__b").agg(F.count("*").alias("__docs"), F.max("__id").alias("__keeper"))
        .where(F.col("__docs") >= min_docs)
        .select("__a", "__b", "__keeper"),
        "shared",
    )
    lost = kept(
        each.join(spread, ["__a", "__b"])
        .where(F.col("__id") != F.col("__keeper"))
        .groupBy("__id", "__print")
        .agg(F.sort_array(F.collect_set("__pos")).alias("__lost")),
        "lost",
    )
    marked = docs.withColumn("__print", print_of).join(lost.withColumnRenamed("__print", "__p"), (F.col(id_col) == F.col("__id")) & (F.col("__print") == F.col("__p")), "left")
    gone = F.coalesce(F.col("__lost"), F.array().cast("array<int>"))
    n_lost = F.size(gone)
    stay = without(lines, gone)
    text = F.when(n_lost == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(stay, "\n"))
    return marked.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in others),
        F.size(lines).cast("long").alias("n_lines"),
        n_lost.cast("long").alias("n_dropped"),
    )
