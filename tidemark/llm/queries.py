"""Registered queries of the corpus operators: ``opN_<name>`` and ``pipeline``.

Each applies its operator with production parameters to its whole table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import (grammar_runs, hamming_topk, mixing, pieces, pq_dedup, quality_rff, secret_scan, sharding, simhash_vp,
                          spelling_kd, substring_dedup, toxicity, url_lists)
from tidemark.llm.common import stored, table

#: Days after which captures and list entries are dated.
FIRST_DAY = "2024-01-01"
#: Domains of the mixing query by label, and their target weights.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'clean' WHEN quality = 0 THEN 'low' END"
TARGETS = {"clean": 0.88, "low": 0.10, "toxic": 0.02}


def _number(text: Column) -> Column:
    """32 bits of the md5, which DuckDB computes too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _day(days: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), days.cast("int"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries over the hosts of ``pages``: lasting spam blocks,
    incidents that are removed again, short blocks of parent domains, and
    allowed sections."""
    url = F.col("url")
    hosts = pages.select(url_lists.host_of(url).alias("host")).where("host <> ''").distinct()
    h = _number(F.col("host"))
    parents = hosts.select(F.regexp_extract("host", r"([^.]+[.][^.]+)$", 1).alias("host")).where("host <> ''").distinct()
    sections = pages.select(url_lists.host_of(url).alias("host"), url_lists.segment_of(url).alias("seg")).where(
        "host <> '' AND seg <> ''").select(F.concat_ws("/", "host", "seg").alias("host")).distinct()

    def rows(df, where, action, days):
        return df.where(where).select(F.col("host").alias("key"), F.lit(action).alias("action"), _day(days).alias("listed"))

    spam = F.col("host").rlike("casino|pills|bets")
    begun = 30 + h % 180
    out = rows(hosts, spam, "block", 10 + h % 60)
    for df, where, parts in (
            (hosts, ~spam & (h % 3 == 0), (("block", begun), ("remove", begun + 30 + h % 90))),
            (parents, F.lit(True), (("block", 120 + h % 90), ("remove", 125 + h % 90))),
            (sections, h % 4 == 0, (("allow", 60 + h % 200),))):
        for action, days in parts:
            out = out.union(rows(df, where, action, days))
    return out


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_date", _day(_number(F.col("url")) % 365))
    return url_lists.evaluate(captures, list_entries(pages)).select(
        "page_id", "host", F.col("fetch_date").cast("string").alias("fetch_date"), "verdict", "matched_key",
        F.col("listed_since").cast("string").alias("listed_since"))


_H = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
_HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '[.]$', '')"
_SEG = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)"
OP1_SQL = f"""
WITH cap AS (SELECT page_id, {_HOST} AS host, {_SEG} AS seg,
                    DATE '{FIRST_DAY}' + CAST({_H.format('url')} % 365 AS INTEGER) AS day FROM pages),
hosts AS (SELECT DISTINCT host, {_H.format('host')} AS h, regexp_matches(host, 'casino|pills|bets') AS spam FROM cap WHERE host <> ''),
parents AS (SELECT DISTINCT p AS host, {_H.format('p')} AS h FROM (SELECT regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS p FROM hosts) WHERE p <> ''),
sections AS (SELECT DISTINCT s AS host, {_H.format('s')} AS h FROM (SELECT host || '/' || seg AS s FROM cap WHERE host <> '' AND seg <> '')),
entries AS (
  SELECT host AS key, 1 AS a, 10 + h % 60 AS d FROM hosts WHERE spam
  UNION ALL SELECT host, 1, 30 + h % 180 FROM hosts WHERE NOT spam AND h % 3 = 0
  UNION ALL SELECT host, 3, 60 + h % 180 + h % 90 FROM hosts WHERE NOT spam AND h % 3 = 0
  UNION ALL SELECT host, 1, 120 + h % 90 FROM parents
  UNION ALL SELECT host, 3, 125 + h % 90 FROM parents
  UNION ALL SELECT host, 2, 60 + h % 200 FROM sections WHERE h % 4 = 0),
daily AS (SELECT key, DATE '{FIRST_DAY}' + CAST(d AS INTEGER) AS since, max(a) AS a FROM entries GROUP BY ALL),
spans AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS til FROM daily) WHERE a < 3),
keys AS (
  SELECT page_id, day, array_to_string(string_split(host, '.')[k:], '.') AS key, len(string_split(host, '.')) - k + 1 AS r
  FROM (SELECT *, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS k FROM cap WHERE host <> '')
  UNION ALL SELECT page_id, day, host || '/' || seg, len(string_split(host, '.')) + 1 FROM cap WHERE host <> '' AND seg <> ''),
best AS (SELECT page_id, arg_max(key, r) AS key, arg_max(a, r) AS a, arg_max(since, r) AS since
         FROM keys JOIN spans USING (key) WHERE day >= since AND (til IS NULL OR day < til) GROUP BY page_id)
SELECT page_id, host, CAST(day AS VARCHAR) AS fetch_date,
       CASE a WHEN 1 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END AS verdict,
       key AS matched_key, CAST(since AS VARCHAR) AS listed_since
FROM cap LEFT JOIN best USING (page_id)
"""


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming_topk.sign_codes(table(spark, sf_dir, "embeddings"))
    found = hamming_topk.top_k(codes, hamming_topk.every_nth(codes))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("neighbor_id"), "distance")


OP2_SQL = """
WITH v AS (SELECT vec_id AS id, list_transform(range(64), lambda i: coalesce(embedding[i + 1] > 0 AND NOT isnan(embedding[i + 1]), false)) AS b
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.id AS query_id, v.id AS neighbor_id,
             len(list_filter(range(64), lambda i: q.b[i + 1] <> v.b[i + 1])) AS distance
      FROM v AS q JOIN v ON q.id <> v.id WHERE q.id % 20 = 0)
SELECT query_id, rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
WHERE rank <= 10
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.load(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                         F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.with_spans(docs)
    of_kind = lambda k: F.size(F.filter("secret_base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(secret_scan.as_string(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.as_string(F.col("secret_spans")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.links(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_words(table(spark, sf_dir, "documents"))
    gone = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, x: a + x["after"] - x["first"])
    return found.select(F.col("id").alias("doc_id"), "n_words", gone.alias("n_removed"),
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = mixing.fit_classifier(docs, labels, F.expr(DOMAIN), domains=list(TARGETS))
    rated = mixing.document_rates(docs, model, TARGETS)
    return rated.select("doc_id", F.col("__tokens").alias("n_tokens"),
                        *[F.element_at("__p", i + 1).alias(f"p_{d}") for i, d in enumerate(model.domains)],
                        F.col("__rate").alias("rate"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the contract's periods: where 10 divides
    h = crc32(doc_id as text), the words from a on repeat the p words from a."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tenth = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("w"),
                        F.floor(h / 10).cast("long").alias("g"))
    n = F.size("w").cast("long")
    a = F.col("g") % F.greatest(n, F.lit(1))
    tenth = tenth.select("doc_id", "text", "w", a.alias("a"), (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("long").alias("p"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    turned = F.transform("w", lambda w, i: F.element_at("w", (at(i.cast("long")) + 1).cast("int")))
    return tenth.select("doc_id", F.when(F.size("w") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grammar_runs.periodic_runs(planted_runs(table(spark, sf_dir, "documents")))
    above = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, x: F.when(above(x, b) > 0, x).otherwise(b))   # first of equals
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_kd.group(spelling_kd.counted_words(table(spark, sf_dir, "documents"), drop_every=31))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality_rff.statistics(table(spark, sf_dir, "documents")))
    model = quality_rff.fit(stats, table(spark, sf_dir, "labels").where(~quality_rff.held_out(F.col("doc_id"))))
    return quality_rff.score(stats, model).select(
        F.col("id").alias("doc_id"), quality_rff.held_out(F.col("id")).alias("held_out"), "score",
        F.when(F.col("score") >= quality_rff.THRESHOLD, 1).otherwise(0).alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_topk_search, op3_sentencepiece, op4_secret_scan, op5_toxicity, op6_embedding_near_dedup,
    op7_substring_dedup, op8_sharding, op9_mixing, op10_simhash_near_dedup, op11_periodic_runs, op12_spelling_variants,
    op13_quality_classifier, pipeline)}
ORACLES = {"op1_url_filters": OP1_SQL, "op2_topk_search": OP2_SQL}
