"""Token tables: documents cut at spaces, tagged by simple token rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import tokens as B
from . import sqltext as S
from .registry import Tables, query

_WORDS = f"list_filter(regexp_split_to_array(text, '[{S.SPACES}]+'), lambda w: w <> '')"


def _tag_sql(w: str, i: str, shift: int) -> str:
    m = f"((length({w}) * 7 + {i} * 3 + {shift}) % 11)"
    return f"CASE WHEN {m} < 2 THEN 'B-이름' WHEN {m} < 5 THEN 'I-이름' WHEN {m} = 5 THEN 'B-주소' WHEN {m} = 6 THEN 'I-주소' ELSE 'O' END"


_TAG_OF = ["B-이름"] * 2 + ["I-이름"] * 3 + ["B-주소", "I-주소"] + ["O"] * 4


def _tag(w, i, shift):
    # a list of literals is one literal; a chain of cases would count the characters once per case
    return F.get(F.array(*[F.lit(x) for x in _TAG_OF]), (F.length(w) * 7 + i * 3 + shift) % 11)


def sentences(spark, folder):
    """``(doc_id, tokens, gold, predicted)``; predictions differ from gold at some tokens."""
    rows = Tables(spark, folder).documents.select("doc_id", words(F.col("text")).alias("tokens"))
    gold = F.transform("tokens", lambda w, i: _tag(w, i, F.lit(0)))
    guess = F.transform("tokens", lambda w, i: _tag(w, i, F.when(i % 9 == 4, 3).otherwise(0)))
    return rows.withColumns({"gold": gold, "predicted": guess})


_TOK = f"tok AS MATERIALIZED (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, {_WORDS} AS ws FROM documents))"
_TAGS = f"{_TOK}, tag AS (SELECT doc_id, i, w, {_tag_sql('w', 'i', 0)} AS g, CASE WHEN i % 9 = 4 THEN {_tag_sql('w', 'i', 3)} ELSE {_tag_sql('w', 'i', 0)} END AS p FROM tok)"


def _decode(column: str, name: str) -> str:
    """Islands: a span starts at B- or where the type differs from the previous token's."""
    return f"""{name}k AS (SELECT doc_id, i, {column} AS t, CASE WHEN {column} = 'O' THEN '' ELSE substr({column}, 3) END AS k FROM tag),
    {name}s AS (SELECT *, k <> '' AND (t LIKE 'B-%' OR lag(k, 1, '') OVER (PARTITION BY doc_id ORDER BY i) <> k) AS st FROM {name}k),
    {name}g AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM {name}s),
    {name} AS (SELECT doc_id, min(i) AS s, max(i) + 1 AS e, any_value(k) AS k FROM {name}g WHERE k <> '' GROUP BY doc_id, n)"""


@query("bio3_spans", f"WITH {_TAGS}, {_decode('g', 'gold')} SELECT doc_id, s AS first_token, e AS end_token, k AS label FROM gold")
def bio3(spark, folder):
    rows = sentences(spark, folder).select("doc_id", F.explode(B.bio_spans(F.col("gold"))).alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("first_token"), F.col("s.end").cast("long").alias("end_token"), F.col("s.type").alias("label"))


@query("agg14_span_scores", f"""WITH {_TAGS}, {_decode('g', 'gold')}, {_decode('p', 'pred')},
    c AS (SELECT (SELECT count(*) FROM gold)::DOUBLE AS g, (SELECT count(*) FROM pred)::DOUBLE AS p, (SELECT count(*) FROM gold JOIN pred USING (doc_id, s, e, k))::DOUBLE AS h,
      (SELECT avg(CASE WHEN g = p THEN 1.0 ELSE 0.0 END) FROM tag)::DOUBLE AS acc)
    SELECT round(h / p, 6) AS precision, round(h / g, 6) AS recall, round(2 * (h / p) * (h / g) / (h / p + h / g), 6) AS f1, round(acc, 6) AS accuracy FROM c""")
def agg14(spark, folder):
    s = B.span_scores(sentences(spark, folder))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("agg13_distinct_tags", f"WITH {_TAGS} SELECT DISTINCT g AS tag FROM tag")
def agg13(spark, folder):
    return B.distinct_tags(sentences(spark, folder), "gold")


_LABELS = ["O", "B-이름", "I-이름", "B-주소"]  # I-주소 is missing on purpose


@query("bio1_label_ids", "SELECT DISTINCT tag, id FROM (VALUES ('O', 0::BIGINT), ('B-이름', 1), ('I-이름', 2), ('B-주소', 3)) v(tag, id) WHERE EXISTS (SELECT 1 FROM documents)")
def bio1(spark, folder):
    used = B.distinct_tags(sentences(spark, folder), "gold")
    ids = B.label_ids(F.array(*[F.lit(x) for x in _LABELS]))
    return used.select("tag", F.element_at(ids, F.col("tag")).cast("long").alias("id")).where("id IS NOT NULL")


# sub-words: every token is cut into pieces of four characters between two special positions
@query("bio2_aligned_labels", f"""WITH {_TAGS}, piece AS (SELECT doc_id, i, g, unnest(range(0, greatest(1, CAST(ceil(length(w) / 4.0) AS BIGINT)))) AS j FROM tag),
    lab AS (SELECT doc_id, i, j, CASE WHEN j > 0 THEN replace(g, 'B-', 'I-') ELSE g END AS t FROM piece)
    SELECT doc_id, count(*) + 2 AS pieces, '-100,' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY i, j) || ',-100' AS label_ids FROM (
      SELECT *, CASE t WHEN 'B-이름' THEN 1 WHEN 'I-이름' THEN 2 WHEN 'B-주소' THEN 3 ELSE 0 END AS id FROM lab) GROUP BY doc_id""")
def bio2(spark, folder):
    rows = sentences(spark, folder).where(F.size("tokens") > 0)
    pieces = F.flatten(F.transform("tokens", lambda w, i: F.array_repeat(i, F.greatest(F.lit(1), F.ceil(F.length(w) / 4.0).cast("int")))))
    special = F.array(F.lit(None).cast("int"))
    ids = B.label_ids(F.array(*[F.lit(x) for x in _LABELS]))
    staged = rows.select("doc_id", "gold", F.concat(special, pieces, special).alias("word_ids"))
    labelled = staged.select("doc_id", B.align_labels(F.col("word_ids"), F.col("gold"), ids).alias("y"))
    return labelled.select("doc_id", F.size("y").cast("long").alias("pieces"), F.array_join(F.col("y").cast("array<string>"), ",").alias("label_ids"))


@query("bio4_hash_split", "SELECT doc_id, ('0x' || substr(md5(doc_id || ':42'), 1, 8))::BIGINT % 100 < 5 AS is_validation FROM documents")
def bio4(spark, folder):
    return B.hash_split(Tables(spark, folder).documents.select("doc_id"), "doc_id")


@query("bio5_extended_schema", f"WITH {_TAGS}, used AS (SELECT DISTINCT g FROM tag) SELECT tag, CAST(r AS BIGINT) AS id FROM (VALUES ('O', 0), ('B-이름', 1), ('I-이름', 2), ('B-주소', 3)) v(tag, r) "
       "UNION ALL SELECT g, 3 + row_number() OVER (ORDER BY g) FROM used WHERE g NOT IN ('O', 'B-이름', 'I-이름', 'B-주소')")
def bio5(spark, folder):
    # the tag set is at most twice the label list, so one small array holds it
    data = B.distinct_tags(sentences(spark, folder), "gold").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    merged = B.extend_schema(F.array(*[F.lit(x) for x in _LABELS]), F.col("tags"))
    return data.select(F.posexplode(merged).alias("id", "tag")).select("tag", F.col("id").cast("long").alias("id"))
