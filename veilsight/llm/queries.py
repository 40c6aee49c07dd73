"""The registered queries of this subpackage and their SQL.

Each query applies one operator, with its production parameters, to the whole
of the table it is meant for and derives digest columns from the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsight.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.toxicity import fit, labelled_texts, score_texts

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = fit(docs, labelled_texts(docs, labels.where(~held_out)))
    out = score_texts(docs, model)
    return out.select("record.doc_id", "score", "n_restored").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_restored"
    )


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.spotsigs import edited, fingerprint, likeness, neighbours, signatures

    rows = neighbours(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.col("next_head"))).drop("text", "next_head")
    rows = rows.select("*", signatures(F.col("edited")).alias("edited_sigs"))
    return rows.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def _op2_sql() -> str:
    from veilsight.llm.spotsigs import ANCHORS, CHAIN, REACH

    common = "['', " + ", ".join(f"'{a}'" for a in ANCHORS) + "]"
    sigs = lambda text: f"""(
      SELECT CASE WHEN len(w) > 1 THEN list_sort(list_distinct(list_transform(
               CASE WHEN list_has_any(c, w[2:]) THEN list_filter(range(1, len(w) + 1), lambda i: list_contains(c, w[i]))
                    ELSE list_filter(range(1, len(w) + 1), lambda i: i = 1 OR substr(md5(w[i]), 1, 1) IN ('0', '8')) END,
               lambda i: substr(md5(array_to_string(list_concat([w[i]], list_slice(list_filter(list_slice(w, i + 1, i + {REACH}), lambda x: NOT list_contains(c, x)), 1, {CHAIN})), ' ')), 1, 8))))
             ELSE CAST([] AS VARCHAR[]) END
      FROM (SELECT {common} AS c, list_concat([''], list_filter(string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w))"""  # noqa: E731
    like = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next FROM documents),
e AS (
  SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(next, 1, n_chars // 3) AS edited FROM d),
s AS (
  SELECT *, {sigs("e.text")} AS own, {sigs("e.edited")} AS other, {sigs("e.next")} AS following FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(other, '') AS edited_fingerprint,
       {like("own", "other")} AS near_edited, {like("own", "following")} AS near_next
FROM s
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.licenses import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return out.select(
        "record.doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


#: Fixed rules of op4_url_filter: host/path and verdict, a listed set of known size.
URL_RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "block"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.url_filter import judge

    out = judge(table(spark, sf_dir, "pages"), spark.createDataFrame(list(URL_RULES), "rule string, verdict string"))
    return out.select("record.page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH r(rule, rhost, rpath, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
a AS (
  SELECT page_id, row_number() OVER () AS row, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, row, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (
  SELECT b.row, r.rule, r.verdict, row_number() OVER (PARTITION BY b.row ORDER BY length(r.rule) DESC, length(r.rhost) DESC) AS n
  FROM b JOIN r ON (b.host = r.rhost OR ends_with(b.host, '.' || r.rhost)) AND starts_with(b.path, r.rpath))
SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM b LEFT JOIN m ON b.row = m.row AND m.n = 1
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veilsight.llm.packing import pack, tokenize

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0), capacity=2048)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.sharding import external_shuffle

    out = external_shuffle(table(spark, sf_dir, "documents"), n_shards=40)
    return out.select(
        "record.doc_id",
        "size",
        F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.near_dedup import Plan, near_components

    return near_components(table(spark, sf_dir, "documents"), plan=Plan(share=80, words=2)).drop("text_hash")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s WHERE len(s) > 0),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.a
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.line_dedup import drop_shared_lines

    out = drop_shared_lines(table(spark, sf_dir, "documents"), min_chars=10, min_docs=2)
    return out.select("record.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT keyed.doc_id, keyed.pos, keyed.line, (shared.k IS NOT NULL AND keyed.doc_id <> shared.first_doc) AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.tiff import store_texts, tiff_pages

    pages = tiff_pages(store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    feature = F.format_string("%dx%d c%d p%d m%.4f s%.4f", "width", "height", "compression", "predictor", "mean", "spread")
    # a stored text has one page
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"), share=1.5, weights=(3, 1, 2), cap=2)
    return out.select("record.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH c AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         row_number() OVER (PARTITION BY doc_id, source, text, lang, n_chars) AS copy FROM documents),
d AS (
  SELECT *, CASE WHEN size >= 512 THEN 2.0::DOUBLE WHEN size >= 64 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w,
         (('0x' || substr(md5('29:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null') || ':' || copy), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM c),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM s),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS room,
         CAST(sum(source_size) OVER () AS DOUBLE) AS all_words FROM w),
f AS (
  SELECT *, (1.5::DOUBLE * all_words - coalesce(sum(most) OVER (ORDER BY room, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY room, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (
  SELECT source, source_size,
         least(most, coalesce((SELECT min(level) FROM f f2 WHERE f2.room = (SELECT min(room) FROM f f3 WHERE f3.level <= f3.room) AND f2.level <= f2.room) * weight, most)) AS target
  FROM f),
kinds AS (
  SELECT d.source, w, sum(size) AS words, any_value(target) AS target FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY d.source, w HAVING sum(size) > 0),
l AS (
  SELECT source, w, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(w * words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM kinds),
lv AS (
  SELECT source, max_by(level, w) AS level FROM l WHERE level * w <= 2 GROUP BY source),
i AS (
  SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN coalesce(least(2.0::DOUBLE, lv.level * d.w), 2.0::DOUBLE) ELSE 0 END AS inclusion
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN lv ON d.source IS NOT DISTINCT FROM lv.source),
q AS (
  SELECT *, CAST(floor(inclusion) AS BIGINT) AS whole, inclusion - floor(inclusion) AS p FROM i),
o AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds,
         target - sum(whole * size) OVER (PARTITION BY source) AS lft FROM q),
k AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((whole + CASE WHEN odds IS NOT NULL AND 2 * upto - size <= 2 * lft THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM k
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.fim import fill_in_middle

    out = fill_in_middle(table(spark, sf_dir, "documents"), seed=1)
    return out.select(
        "record.doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (
  SELECT *, array_to_string(w[1:least(x, y)], '') AS a, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(w[greatest(x, y) + 1:], '') AS z FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""


def op12_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    from veilsight.llm.filtering_lloyd import quantise

    out, model = quantise(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    books = hashlib.sha256(model.codebook_text().encode()).hexdigest() if model else None
    return out.select("record.vec_id", "code", "error", F.col("group_error").alias("label_error"), F.lit(books).cast("string").alias("codebooks_sha256"))


def _op12_sql() -> str:
    books, assigned = [], []
    for turn in (0, 1, 2):
        assigned.append(f"""
a{turn} AS MATERIALIZED (
  SELECT row, part, min(far) AS far, min(e) AS e FROM (
    SELECT p.row, p.part, c.e, list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS far FROM p JOIN c{turn} c ON p.part = c.part
    QUALIFY far = min(far) OVER (PARTITION BY p.row, p.part)) GROUP BY row, part)""")
        if turn < 2:
            books.append(f"""
c{turn + 1} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{turn} c LEFT JOIN (
    SELECT part, e, list(CAST(s AS BIGINT) ORDER BY i) AS v FROM (
      SELECT a.part, a.e, i, floor(sum(p.v[i])::DOUBLE / count(*)) AS s
      FROM a{turn} a JOIN p ON a.row = p.row AND a.part = p.part, (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS i)
      GROUP BY a.part, a.e, i) GROUP BY part, e) m ON c.part = m.part AND c.e = m.e)""")
    steps = ",".join([assigned[0], books[0], assigned[1], books[1], assigned[2]])
    return rf"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (
  SELECT row, part, list_transform(embedding[part * len(embedding) // 16 + 1:(part + 1) * len(embedding) // 16], lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM k, (SELECT unnest(range(16)) AS part)),
c0 AS MATERIALIZED (
  SELECT part, row - 1 AS e, v FROM p WHERE row <= 64),
{steps},
r AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', a.e::INT), '' ORDER BY a.part) AS code, CAST(sum(a.far) AS BIGINT) AS error FROM a2 a JOIN k ON a.row = k.row GROUP BY k.row, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM c2) AS codebooks_sha256
FROM r
"""


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilsight.llm.ngram_join import Orders, ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), plan=Orders(share=85, words=4))


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN w WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s WHERE len(s) > 0),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON s.doc_id = c.a
"""


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_spotsigs": op2_spotsigs,
        "op3_licenses": op3_licenses,
        "op4_url_filter": op4_url_filter,
        "op5_packing": op5_packing,
        "op6_sharding": op6_sharding,
        "op7_near_dedup": op7_near_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_tiff": op9_tiff,
        "op10_mixing": op10_mixing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_filtering_lloyd": op12_filtering_lloyd,
        "op13_ngram_join": op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_spotsigs": _op2_sql(),
        "op4_url_filter": OP4_SQL,
        "op7_near_dedup": OP7_SQL,
        "op8_line_dedup": OP8_SQL,
        "op10_mixing": OP10_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op12_filtering_lloyd": _op12_sql(),
        "op13_ngram_join": OP13_SQL,
    }
