"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import binary_records, bpe, decontaminate, line_dedup, ngram_join, packing, prefix_trie, quality, runs, secret_scan, sharding, token_counts, topk_search
from factorlake.llm.scratch import kept, shared_dir, table

TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=20, query_every=20)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))  # spans by start, then kind as listed
    base = [r["kind"] for r in secret_scan.BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return found.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base), F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER), limit=512)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.shuffle_to_shards(rows, ["doc_id", "text_crc32", "size"], n_shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, ["doc_id"], packing.word_count(F.col("text")), n_buckets=16, budget=65_536)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    index = binary_records.write_records(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return binary_records.record_digests(index, path)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out())
    scored = quality.with_score(docs, quality.train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the texts, by the checksum of their id, go on from some word with a few periods of the words there."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    d = d.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    d = d.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents", "doc_id", "text")), min_length=6, min_exponent=4)
    # the first of the longest: runs come by start, then period
    best = F.try_element_at(F.filter("runs", lambda r: r["length"] == F.array_max(F.col("runs.length"))), F.lit(1))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_shared_starts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns, as prefix_trie.ordered() returns them, with the first ones of every conversation c those of c - c % 5; and all conversations.

    How many are replaced, up to eight, says the checksum of c; all, where the other one is shorter or absent.
    """
    turns = kept(turns, "turns")
    base = F.col("conv_id") - F.col("conv_id") % 5
    h = F.when(F.col("conv_id") == base, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9)
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", base.alias("base"), h.alias("h"))
    sizes = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = kept(convs.join(sizes, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m")), "starts")
    own = turns.join(convs, "conv_id").where("at >= h").withColumn("at", F.col("at") - F.col("h") + F.col("m"))
    near = turns.where("conv_id % 5 = 0 AND at < 8").withColumns({"base": F.col("conv_id"), "by": F.explode(F.sequence(F.lit(-4), F.lit(4)))})
    near = near.withColumn("conv_id", F.try_add("conv_id", F.col("by").cast("long"))).where((F.col("by") != 0) & (base == F.col("base")))
    lent = near.join(convs, "conv_id").where("at < h")
    names = ["conv_id", "at", "a", "b", "n_bytes"]
    return own.select(*names).unionByName(lent.select(*names)), convs


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = with_shared_starts(prefix_trie.ordered(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
    return prefix_trie.trie(turns, convs)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_TOKENIZER)
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: The words of a text in DuckDB, lower-cased in A-Z only.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, len(embedding) AS d, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS row, q.vec_id AS query_id, x.vec_id AS vec_id,
  CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(x.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.row <> x.row AND q.d = x.d WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
d AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, d.keeper IS NOT NULL AND d.keeper <> k.doc_id AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


#: All pairs that share a shingle, and all that reach one another: quadratic in groups, for tables of moderate size.
NGRAM_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM w),
c AS (SELECT min(doc_id) AS node, sh FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS (SELECT node, len(sh) AS n, unnest(sh) AS t FROM c),
p AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.t = b.t AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT node, node AS other FROM c UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT node, min(other) AS component FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN m ON c.node = m.node
"""

#: The rules as DuckDB's expressions. Letters in either case are spelt out, since (?i) folds beyond ASCII there.
_SECRETS = [
    ("assign", r"(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r")[\"\x27]?\x20*[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)", 12),
    ("access", "(AKIA[A-Z0-9]+)", 18),
    ("hex", "([0-9a-f]+)", 16),
    ("github", "(gh[pousr]_[A-Za-z0-9]+)", 40),
    ("slack", "(xox[abprs]-[A-Za-z0-9-]+)", 20),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 30),
    ("pem", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1),
]


def _secrets_sql() -> str:
    """Spans per kind: a match starts after the pieces between the matches before it, and after these."""
    kinds = []
    for k, (kind, find, least) in enumerate(_SECRETS):
        kinds.append(
            f"""SELECT doc_id, row, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{find}') AS m, regexp_extract_all(t, '{find}', 1) AS g, string_split_regex(t, '{find}') AS p FROM d"""
        )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
u AS ({" UNION ALL ".join(kinds)}),
e AS (SELECT doc_id, row, k, kind, least, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM u WHERE len(m) > 0),
f AS (SELECT doc_id, row, k, kind, length(g[i]) AS n, least, length(m[i]) AS size,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM e),
s AS (SELECT row, k, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS x FROM f WHERE n >= least)
SELECT d.doc_id, count(s.k) FILTER (k = 0) AS n_assign, count(s.k) FILTER (k = 1) AS n_access, count(s.k) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY start, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN s ON d.row = s.row GROUP BY d.doc_id, d.row
"""


#: CRC-32 of a number's digits, bit by bit, in DuckDB.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""

#: Runs as islands of words equal to those q before: all pairs of equal words of a text, for texts of moderate size.
RUNS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS o, {_CRC.format("doc_id")} AS h FROM documents),
e AS (SELECT *, len(o) AS n, h // 10 AS g, (h // 10) % greatest(len(o), 1) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
w AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(o[1:a], list_transform(range(a, n), lambda i: o[a + (i - a) % p + 1])) ELSE o END AS ws FROM f),
t AS (SELECT row, n, unnest(ws) AS x, unnest(range(0, n)) AS i FROM w),
q AS (SELECT a.row, b.i - a.i AS q, a.i FROM t a JOIN t b ON a.row = b.row AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM q),
u AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY row, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT row, start, length, min(q) AS period FROM u GROUP BY row, start, length),
b AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY length DESC, start, period) AS k FROM r),
m AS (SELECT row, count(*) AS n_runs, max(start) FILTER (k = 1) AS start, max(length) FILTER (k = 1) AS length, max(period) FILTER (k = 1) AS period,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM b GROUP BY row),
c AS (SELECT row, string_agg(x, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.row = t.row AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY row)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN m ON w.row = m.row LEFT JOIN c ON w.row = c.row
"""


#: Nodes by the turns' checksums one after another; every node is spread over its ancestors.
TRIE_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
  md5(coalesce(role, '')) || md5(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n_bytes FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE {_CRC.format("conv_id")} % 9 END AS h, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT g.conv_id, g.base, g.h, least(g.h, coalesce(b.n, 0)) AS m FROM g LEFT JOIN g b ON b.conv_id = g.base),
r AS (SELECT c.conv_id, i - h + m AS i, x, n_bytes FROM t JOIN c ON t.conv_id = c.conv_id WHERE i >= h
  UNION ALL SELECT c.conv_id, i, x, n_bytes FROM c JOIN t ON t.conv_id = c.base WHERE i < h),
p AS (SELECT conv_id, i + 1 AS depth, n_bytes, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT node, depth, count(*) AS n_convs, min(conv_id) AS conv_id, (count(*) - 1) * max(n_bytes) AS w FROM p GROUP BY node, depth),
k AS (SELECT left(node, 64 * (depth - 1)) AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.node AND n.depth = k.depth),
a AS (SELECT node, w, n_children, unnest(range(0, depth + 1)) AS d FROM l),
s AS (SELECT left(node, 64 * d) AS node, d AS depth, sum(w) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM a GROUP BY ALL),
z AS (SELECT conv_id, max(depth) AS depth, arg_max(node, depth) AS node FROM p GROUP BY conv_id),
e AS (SELECT node, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM z GROUP BY ALL)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, l.n_convs, l.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM l JOIN s ON l.node = s.node AND l.depth = s.depth LEFT JOIN l q ON l.depth > 0 AND q.depth = l.depth - 1 AND q.node = left(l.node, 64 * (l.depth - 1)) LEFT JOIN e ON e.node = l.node AND e.depth = l.depth
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_ngram_join, op3_secret_scan, op4_token_counts, op5_sharding, op6_packing, op7_line_dedup, op8_decontaminate, op9_binary_records, op10_quality, op11_periodic_runs, op12_prefix_trie, op13_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": TOPK_SQL, "op2_ngram_join": NGRAM_SQL, "op3_secret_scan": _secrets_sql(), "op7_line_dedup": LINES_SQL, "op11_periodic_runs": RUNS_SQL, "op12_prefix_trie": TRIE_SQL}
