"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat, exact_dedup, lexical, mixing, packing, pii, quality, resampling, sharding, simhash, token_store, tokens, toxicity, url_filter
from gridloom.llm.common import place, text_of, word_count, written
from gridloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g USING (x)
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


@query(r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS most FROM s),
r AS (SELECT *, most / w AS ratio, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN ratio > level THEN w * (SELECT arg_min(level, k) FROM l WHERE ratio > level) ELSE most END AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('7:' || doc_id || ':' || size), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - pos)) END::BIGINT AS taken FROM p
""")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    slim = written(docs.select("doc_id", "source", word_count(text_of()).alias("n")), "sizes")  # texts are read once
    mixed = mixing.mix(slim, size_col="n", weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", F.crc32(text_of()).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
f AS (SELECT m.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (2 * n_symbols > 3 * n_words)::BIGINT
  + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS failures FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failures = 0 AS kept, n_lines, failures FROM b
""")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ~quality.verdict("base")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.verdict("v1").alias("kept"), "n_lines", "failures"
    )


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.mark_similar(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=3)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return tokens.read_tokenizer(public_tokenizers.path(name))


@query()
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "store")
    token_store.write_store(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"), end_id=0)
    index = token_store.read_index(spark.read.schema(token_store.STORE).parquet(path))
    return index.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Fixed values of the query: verdict and host/path of the rules that go before the mined ones.
HOST_RULES = tuple(
    url_filter.HostRule.parse(v, t)
    for v, t in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
)


@query()
def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page holds the document that the number in its URL's path names; that document's labels are the page's."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    held = pages.select("url", url_filter.document_of(F.col("url")).alias("doc_id"))
    known = held.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge_urls(pages, url_filter.mine_rules(known), HOST_RULES).drop("url")


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    grade = toxicity.grades_from_labels(F.col("quality"), F.col("toxic")).alias("grade")
    model = toxicity.fit(docs.join(labels, "doc_id").select("text", grade))
    return toxicity.score(docs, model).drop("text")


@query()
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


@query(r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT (count(*) FILTER (WHERE len(w) > 0))::BIGINT AS n_docs, coalesce(sum(len(w)), 0)::BIGINT AS n_terms FROM d),
f AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
q AS (SELECT i, t, count(*)::BIGINT AS qf FROM (SELECT row_number() OVER () AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY i, t),
b AS (SELECT row_number() OVER () AS i, item_id FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY t, n_docs),
m AS (SELECT r, doc_id, (75 + (25 * len(w)::BIGINT * n_docs) // n_terms)::BIGINT AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT q.i, m.r, m.doc_id, sum(q.qf * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * m.m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY q.i, m.r, m.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT b.item_id, k.rank::INT AS rank, k.doc_id, k.score FROM k JOIN b USING (i) WHERE k.rank <= 20
""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


@query()
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=("doc_id",), n=3, count=10_000, percent=5, least_words=20, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op11_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = pii.mark_spans(docs, pii.fit(docs))
    return marked.select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans", "n_added")
