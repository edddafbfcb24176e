"""The corpus operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.session import shared_folder, written

from . import (bytebpe, centroids, decontaminate, linedup, mixing, neardup, periodic, rules, sharding, tokencount, toxicity, urlfilter, warc)
from .common import table

SHARDS = 40
MIN_SITES = 10


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources mixed to shares of the square root of their bytes, at one epoch of the whole."""
    mixed = mixing.mix(table(spark, folder, "documents"), alpha=0.5, epochs=1.0, seed=7)
    return mixed.select("doc_id", "copy", "copies", "source", "text", F.round("rate", 6).alias("rate"),
                        F.round("order_key", 12).alias("order_key"))


OP1_SQL = """
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM documents GROUP BY source),
shares AS (SELECT source, bytes, CASE WHEN bytes > 0 THEN pow(bytes::DOUBLE, 0.5) ELSE 0 END AS share FROM sizes),
rates AS (SELECT source, CASE WHEN bytes = 0 THEN 1.0 WHEN (SELECT sum(share) FROM shares) = 0 THEN 0.0
                 ELSE (SELECT sum(bytes) FROM shares) * share / (SELECT sum(share) FROM shares) / bytes END AS rate FROM shares),
parts AS (SELECT source, rate, greatest(ceil(rate / 32.0), 1)::INT AS draws FROM rates),
means AS (SELECT source, rate, draws, rate / draws AS mean FROM parts),
cdf AS (SELECT source, generate_series AS k,
               sum(exp(generate_series * ln(mean) - lgamma(generate_series + 1) - mean))
                   OVER (PARTITION BY source ORDER BY generate_series) AS c
        FROM means, generate_series(0, 120) WHERE mean > 0),
steps AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
counted AS (SELECT d.doc_id, d.source, d.text, m.rate,
                   list_sum([len(list_filter(s.cs, lambda c: c <= (('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT)::DOUBLE
                             / 4503599627370496.0)) for i in range(1, m.draws + 1)])::INT AS copies
            FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source
            JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, g.i::INT AS copy, copies, source, text, round(rate, 6) AS rate,
       round((('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '') || ':' || g.i), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0, 12) AS order_key
FROM counted, unnest(range(0, copies)) AS g(i)
"""


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by a model of the labelled documents that are not held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "n_sentences", F.size("offending").alias("n_offending"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stand in windows of benchmark items."""
    found = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        decontaminate.digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy word-piece length of every document."""
    return tokencount.token_counts(table(spark, folder, "documents"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages archived as WARC files and read back."""
    archive = f"{shared_folder(spark)}/warc-{_fresh()}"
    warc.write(table(spark, folder, "pages"), archive)
    return warc.inventory(spark, archive)


def _fresh() -> str:
    import uuid

    return uuid.uuid4().hex


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents that links of similarity 0.85 connect."""
    return neardup.groups(table(spark, folder, "documents"), threshold=0.85)


def op7_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in shards of near equal bytes."""
    dealt = sharding.assign(table(spark, folder, "documents").select("doc_id", "text"), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of the base rule and the learned decision list on every document."""
    stats = written(rules.statistics(table(spark, folder, "documents")))
    learned = rules.fit(stats, table(spark, folder, "labels"))
    return rules.judge(stats, learned).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that stand in ten sources or more."""
    clean = linedup.remove_boilerplate(table(spark, folder, "documents"), MIN_SITES)
    return clean.select("doc_id", "n_lines", "n_removed", F.col("text").alias("clean_text"))


_BARE = r"regexp_replace(line, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(parts, 1) AS spot, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
bare AS (SELECT doc_id, source, spot, line, {_BARE} AS bare_line FROM lines),
bad AS (SELECT bare_line FROM bare WHERE bare_line <> '' GROUP BY bare_line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT b.*, (bad.bare_line IS NOT NULL) AS gone FROM bare b LEFT JOIN bad ON b.bare_line = bad.bare_line)
SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (WHERE gone)::INT AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (WHERE NOT gone), '') AS clean_text
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def listed_domains(pages: DataFrame) -> DataFrame:
    """A dated list made of the pages' own hosts: three in eight are added, some removed and added again.

    Of every sixteenth host the parent domain is listed for a month.
    """
    hosts = pages.select(urlfilter.host(F.col("url")).alias("domain")).where("domain is not null").distinct()
    digit = lambda c, n: F.conv(F.substring(F.md5(F.col(c)), n, 2), 16, 10).cast("int")
    start = F.timestamp_seconds(F.lit(1704067200) + digit("domain", 1) * 86400)
    later = lambda n: F.timestamp_seconds(F.lit(1704067200) + (digit("domain", 1) + n) * 86400)
    some = hosts.where(digit("domain", 3) % 8 < 3)
    again = some.where(digit("domain", 5) % 2 == 0)
    parents = hosts.where((digit("domain", 7) % 16 == 0) & (F.size(F.split("domain", r"\.")) > 3)).select(
        F.array_join(F.slice(F.split("domain", r"\."), 2, 100), ".").alias("domain")).distinct()
    row = lambda df, action, at: df.select("domain", F.lit(action).alias("action"), at.alias("since"))
    return (row(some, "add", start).unionByName(row(again, "remove", later(30))).unionByName(row(again, "add", later(90)))
            .unionByName(row(parents, "add", start)).unionByName(row(parents, "remove", later(30))))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures with a fetch time that follows from the page id."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(31536000)))
    return pages.select("page_id", "url", at.alias("fetched_at"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every capture judged by the list as of its fetch time."""
    pages = table(spark, folder, "pages")
    judged = urlfilter.judge(captures_of(pages), written(listed_domains(pages)))
    return judged.select("page_id", "fetched_at", "blocked", "list_domain", "listed_since")


def _digit(n: int) -> str:
    return f"('0x' || substr(md5(domain), {n}, 2))::INT"


_TIME = "make_timestamp((1704067200 + {} * 86400)::BIGINT * 1000000)"
OP10_SQL = rf"""
WITH captures AS (
  SELECT page_id, make_timestamp((1704067200 + (page_id * 7919) % 31536000)::BIGINT * 1000000) AS fetched_at,
         nullif(rtrim(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)', 1), '.'), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host AS domain FROM captures WHERE host IS NOT NULL),
listed AS (SELECT domain FROM hosts WHERE {_digit(3)} % 8 < 3),
again AS (SELECT domain FROM listed WHERE {_digit(5)} % 2 = 0),
parents AS (SELECT DISTINCT domain[instr(domain, '.') + 1:] AS domain FROM hosts
            WHERE {_digit(7)} % 16 = 0 AND len(string_split(domain, '.')) > 3),
entries AS (
  SELECT domain, true AS on_list, {_digit(1)} AS day FROM listed UNION ALL
  SELECT domain, false, {_digit(1)} + 30 FROM again UNION ALL SELECT domain, true, {_digit(1)} + 90 FROM again UNION ALL
  SELECT domain, true, {_digit(1)} FROM parents UNION ALL SELECT domain, false, {_digit(1)} + 30 FROM parents),
states AS (SELECT domain, day, bool_and(on_list) AS on_list FROM entries GROUP BY ALL),
lagged AS (SELECT *, lag(on_list, 1, false) OVER (PARTITION BY domain ORDER BY day) AS was FROM states),
changes AS (SELECT *, {_TIME.format('day')} AS since, lead({_TIME.format('day')}) OVER (PARTITION BY domain ORDER BY day) AS till
            FROM lagged WHERE on_list <> was),
spans AS (SELECT domain, since, till FROM changes WHERE on_list),
asked AS (SELECT page_id, fetched_at, host, unnest(range(0, greatest(len(string_split(host, '.')) - 1, 1))) AS skip FROM captures WHERE host IS NOT NULL),
keys AS (SELECT page_id, fetched_at, array_to_string(string_split(host, '.')[skip + 1:], '.') AS domain FROM asked),
hits AS (SELECT page_id, arg_max(s.domain, len(s.domain)) AS list_domain, arg_max(s.since, len(s.domain)) AS listed_since
         FROM keys k JOIN spans s ON k.domain = s.domain AND s.since <= k.fetched_at AND (s.till IS NULL OR k.fetched_at < s.till)
         GROUP BY page_id)
SELECT c.page_id, c.fetched_at, h.page_id IS NOT NULL AS blocked, h.list_domain, h.listed_since
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id
"""

OP3_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS width, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM item_words WHERE len(ws) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
spots AS (
  SELECT doc_id, width, i, array_to_string(ws[i:i + width - 1], ' ') AS win
  FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM doc_words, widths WHERE len(ws) >= width)),
hits AS (SELECT doc_id, i, s.width, item_id FROM spots s JOIN windows w ON s.win = w.win AND s.width = w.width),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM (SELECT DISTINCT doc_id, i, width FROM hits)) GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(w.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN words_hit w ON d.doc_id = w.doc_id LEFT JOIN items_hit t ON d.doc_id = t.doc_id
"""

def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every whole text, and what they decode to, as digests."""
    codec = bytebpe.codec()
    back = bytebpe.decode(bytebpe.encode(table(spark, folder, "documents"), codec), codec)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("body", 256).alias("decoded_sha256"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector with its cluster after ten rounds around eight centroids."""
    chunks, clusters = centroids.fit(table(spark, folder, "embeddings"), k=8, rounds=10, seed=3)
    final = clusters.table(spark).select("cluster", "cluster_inertia", "inertia",
                                         F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    return centroids.assign(chunks, clusters).join(F.broadcast(final), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _floor_div(a: str, b: str) -> str:
    return f"(({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b})"


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out one after the other."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS cluster, v AS c
       FROM kept ORDER BY cluster LIMIT {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, vec_id, min(struct_pack(s := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, g := cluster)) AS best
  FROM kept, c{n} GROUP BY r, vec_id)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
  SELECT cluster, list(m ORDER BY d) AS c FROM (
    SELECT best.g AS cluster, d, {_floor_div('sum(x)::BIGINT', 'count(*)')} AS m FROM a{n} JOIN parts USING (r) GROUP BY best.g, d) GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.best.g AS cluster, a.best.s AS distance, (sum(a.best.s) OVER (PARTITION BY a.best.g))::BIGINT AS cluster_inertia,
       (sum(a.best.s) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.best.g = c.cluster"""


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth repeat a stretch of their words to the end, at places that follow from the id."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(hashed % 10 == 0, F.lit(False))
    words = F.when(chosen, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w")
    held = docs.select("doc_id", "text", F.floor(hashed / 10).alias("g"), words).withColumn("n", F.size("w"))
    sized = held.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = sized.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of at least four periods in every whole text, a tenth of them with planted repeats."""
    found = periodic.runs(with_repeats(table(spark, folder, "documents")))
    best = periodic.longest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_toxicity, op3_decontaminate, op4_token_counts, op5_warc, op6_near_duplicates, op7_shards,
    op8_quality_rules, op9_line_dedup, op10_url_filter, op11_byte_bpe, op12_centroids, op13_periodic_runs)}
OP5_SQL = f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
                 max(page_id) OVER (PARTITION BY body) AS largest FROM bodies),
marked AS (SELECT *, payload_bytes >= {warc.REVISIT_BYTES} AND page_id IS DISTINCT FROM largest AND largest IS NOT NULL AS again FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN largest END AS refers_to
FROM marked
"""

ORACLES = {
    "op1_mix_sources": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_url_filter": OP10_SQL,
    "op12_centroids": _op12_sql(),
}
