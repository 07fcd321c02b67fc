"""Registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm import (
    chunks,
    decontaminate,
    infill,
    licenses,
    lines,
    neardup,
    quality,
    runs,
    search,
    sentencepieces,
    toxicity,
    urls,
    winnow,
)
from tablescope.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


@query("op4_minhash_near_dedup")
def near_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, shingle=3, percent=85, keep=["doc_id"])


@query(
    "op7_benchmark_decontamination",
    """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
""",
)
def decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    benchmark = table(spark, folder, "benchmark").select("item_id", "text")
    found = decontaminate.find_contamination(docs, benchmark, keep=["doc_id"])
    hit = F.size("hit_words").cast("bigint")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


#: The rules of the URL query.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(
    "op10_url_filters",
    """
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block' WHEN 'com/de/' THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM (SELECT page_id,
      translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages))
""",
)
def url_filters(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


#: A public tokenizer model; another path may be set in the session.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


@query("op6_sentencepiece")
def sentencepiece(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    model = spark.conf.get("tablescope.sentencepiece.model", MODEL_FILE)
    ids = sentencepieces.encode(docs, model, keep=["doc_id", "sha256"])
    back = sentencepieces.decode(ids, model)
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        sentencepieces.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.coalesce(F.sha2(F.col("decoded").cast("binary"), 256) == F.col("sha256"), F.lit(True)).alias("round_trip"),
    )


@query("op3_toxicity")
def toxic(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    found = toxicity.toxicity(docs, labels, keep=["doc_id"])
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "neighbours",
    )


@query(
    "op9_line_dedup",
    """
WITH l AS (
  SELECT doc_id, source, text, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM documents),
bad AS (SELECT line FROM l WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 10),
c AS (
  SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bl,
    trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS good
  FROM documents, (SELECT coalesce(list(line), []) AS bl FROM bad))
SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines,
  CAST(coalesce(len(string_split(text, chr(10))) - len(good), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN len(good) < len(string_split(text, chr(10))) THEN array_to_string(good, chr(10)) ELSE text END) AS clean_sha256
FROM c
""",
)
def line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    found = lines.remove_boilerplate(docs, keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256"))


@query(
    "op8_license_scans",
    """
WITH k(digest, name) AS (VALUES
  (sha256('licensed under the apache license version 2 0'), 'Apache-2.0'),
  (sha256('spdx license identifier apache 2 0'), 'Apache-2.0'),
  (sha256('released under the mit license'), 'MIT'), (sha256('licensed under the mit license'), 'MIT'),
  (sha256('spdx license identifier mit'), 'MIT'), (sha256('spdx license identifier gpl 3 0 only'), 'GPL-3.0-only'),
  (sha256('this work is licensed under the gnu general public license version 3'), 'GPL-3.0-only'),
  (sha256('licensed under cc by nc 4 0'), 'CC-BY-NC-4.0'), (sha256('licensed under cc by 4 0'), 'CC-BY-4.0'),
  (sha256('spdx license identifier cc0 1 0'), 'CC0-1.0'), (sha256('all rights reserved'), 'LicenseRef-all-rights-reserved')),
l AS (
  SELECT doc_id, whole, trim(regexp_replace(CASE WHEN regexp_matches(t, '^[ \\t#*/;-]*(?:copyright|\\(c\\)|©)[ \\t:]*(?:\\(c\\)|©|[0-9]|copyright|by)')
      THEN '' ELSE t END, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS unit
  FROM (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS t, false AS whole FROM documents
    UNION ALL SELECT doc_id, lower(text), true FROM documents WHERE text NOT LIKE '%' || chr(10) || '%')),
m AS (SELECT doc_id, min(CASE WHEN whole THEN name END) AS license, list_sort(list(DISTINCT name)) AS notices
  FROM l JOIN k ON k.digest = sha256(regexp_replace(regexp_replace(unit, '\\blicence\\b', 'license', 'g'), '\\blicenced\\b', 'licensed', 'g')) GROUP BY 1)
SELECT d.doc_id, license, coalesce(array_to_string(notices, ','), '') AS notices FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
""",
)
def license_scans(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs, licenses.known_licenses(spark), keep=["doc_id"])
    return found.select("doc_id", "license", F.array_join("notices", ",").alias("notices"))


@query("op5_substring_dedup")
def substring_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = chunks.find_repeats(docs, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_chunks",
        (F.size("repeats") / 2).cast("bigint").alias("n_passages"),
        chunks.covered(F.col("repeats")).alias("repeated_bytes"),
        chunks.covered(F.col("later")).alias("removed_bytes"),
        (F.size("repeats") > 0).alias("repeated"),
    )


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op1_topk_search",
    f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
t AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
f AS (SELECT word, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT word, count(*) AS df FROM t GROUP BY 1), s),
q AS (SELECT doc_id AS query_id, word, idf FROM t JOIN f USING (word) WHERE doc_id % 20 = 0),
p AS (SELECT query_id, t.doc_id, sum(CAST(rint(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))) * 1e6) AS BIGINT)) AS score
  FROM q JOIN t USING (word) JOIN d ON d.doc_id = t.doc_id, s GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, CAST(score AS DOUBLE) / 1e6 AS score
FROM p QUALIFY rank <= 10
""".replace("rint(", "round_even(").replace("* 1e6) AS BIGINT", "* 1e6, 0) AS BIGINT"),
)
def topk_search(spark, folder):
    """Queries are the rows whose id is divisible by 20, each by all words of its text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id")
    return search.top_k(docs, queries)


@query("op2_quality_classifier")
def quality_classifier(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    found = quality.quality(docs, labels, keep=["doc_id"])
    held = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held, "text_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Words of the runs query: ASCII white space ends them.
SPACED_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op11_periodic_runs",
    f"""
WITH rest AS (SELECT list_transform(range(256), lambda k:
    list_reduce(list_concat([k], repeat([0::BIGINT], 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
h AS (
  SELECT doc_id, {SPACED_SQL} AS w, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h
  FROM documents, rest),
a AS (SELECT doc_id, w, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
p AS (SELECT doc_id, w, a, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT doc_id, CASE WHEN a IS NULL THEN w
    ELSE list_concat(w[1:a], list_transform(range(len(w) - a), lambda i: w[a + 1 + i % p])) END AS w FROM p),
x AS (SELECT doc_id, word, i - 1 AS i FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e) GROUP BY doc_id, q, g),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY 1, 2, 3),
b AS (SELECT doc_id, count(*) AS n, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS t FROM r GROUP BY 1),
top AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(b.n, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(b.t, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN c USING (doc_id)
""",
)
def periodic_run_query(spark, folder):
    return periodic_runs(table(spark, folder, "documents").select("doc_id", "text"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of all texts; one text in ten is made periodic from some word on first."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("words"), F.floor(crc / 10)
    docs = docs.withColumn("words", F.when(crc % 10 == 0, words))  # only these texts need their words here
    docs = docs.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    docs = docs.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    part = F.slice("words", F.col("a") + 1, F.col("p"))
    many = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    after = F.slice(F.flatten(F.array_repeat(part, many)), F.lit(1), n - F.col("a"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), after), " ")
    docs = docs.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))
    found = runs.find_runs(docs, keep=["doc_id"])
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    found = found.withColumn("top", F.array_max(ranked))
    lines_ = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    start, length, period = -F.col("top.s"), F.col("top.length"), -F.col("top.p")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines_, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(
    "op12_fill_in_middle",
    r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS s,
    regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS t FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT % (len(t) + 1) AS h1, ('0x' || s[9:16])::BIGINT % (len(t) + 1) AS h2,
    ('0x' || s[17:24])::BIGINT % 100 AS h3, ('0x' || s[25:32])::BIGINT % 100 AS h4 FROM w),
c AS (SELECT *, array_to_string(t[1:least(h1, h2)], '') AS a, array_to_string(t[least(h1, h2) + 1:greatest(h1, h2)], '') AS b,
    array_to_string(t[greatest(h1, h2) + 1:], '') AS e,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain'
      WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, len(t) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', a, '<S>', e, '<M>', b) ELSE concat('<S>', e, '<P>', a, '<M>', b) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
""",
)
def fill_in_middle(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = infill.fill_in_middle(docs, keep=["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


@query(
    "op13_fingerprints",
    """
WITH o AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    coalesce(coalesce(lead(text, 1, '') OVER (ORDER BY doc_id), ''), '') AS following,
    row_number() OVER (ORDER BY doc_id DESC) = 1 AS last, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS opening FROM documents),
d AS (SELECT doc_id, text, n, substr(text, 1, n - n // 4) || substr(CASE WHEN last THEN opening ELSE following END, 1, n // 4) AS edited FROM o),
t AS (SELECT doc_id, false AS edit, text AS s FROM d UNION ALL SELECT doc_id, true, edited FROM d),
c AS (SELECT doc_id, edit, length(s) AS n, unnest(range(length(s))) AS i, unnest(list_transform(string_split(s, ''), lambda x: ord(x)::BIGINT)) AS h
  FROM t WHERE s <> ''),
h2 AS (SELECT doc_id, edit, n, i, (h * {b1} + coalesce(lead(h, 1) OVER w, 0)) % 2147483647 AS h FROM c WINDOW w AS (PARTITION BY doc_id, edit ORDER BY i)),
h4 AS (SELECT doc_id, edit, n, i, (h * {b2} + coalesce(lead(h, 2) OVER w, 0)) % 2147483647 AS h FROM h2 WINDOW w AS (PARTITION BY doc_id, edit ORDER BY i)),
h8 AS (SELECT doc_id, edit, n, i, (h * {b4} + coalesce(lead(h, 4) OVER w, 0)) % 2147483647 AS h FROM h4 WINDOW w AS (PARTITION BY doc_id, edit ORDER BY i)),
g AS (SELECT * FROM (SELECT doc_id, edit, n, i, (h * {b8} + coalesce(lead(h, 8) OVER w, 0)) % 2147483647 AS h FROM h8
    WINDOW w AS (PARTITION BY doc_id, edit ORDER BY i)) WHERE i < greatest(n - 15, 1)),
m AS (SELECT doc_id, edit, n, i, min(h * 1048576 + 1048575 - i) OVER (PARTITION BY doc_id, edit ORDER BY i ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS m FROM g),
f AS (SELECT DISTINCT doc_id, edit, 1048575 - m % 1048576 AS i, m // 1048576 AS h FROM m WHERE i < greatest(n - 46, 1)),
p AS (SELECT doc_id, edit, string_agg(concat(i, ':', to_hex(h)), ',' ORDER BY i) AS s, list(DISTINCT h) AS hs FROM f GROUP BY 1, 2),
k AS (SELECT d.doc_id, n, edited, coalesce(a.s, '') AS fingerprint, coalesce(b.s, '') AS edited_fingerprint,
    coalesce(a.hs, []) AS x, coalesce(b.hs, []) AS y,
    coalesce(lead(coalesce(a.hs, [])) OVER (ORDER BY d.doc_id), first_value(coalesce(a.hs, [])) OVER (ORDER BY d.doc_id)) AS z
  FROM d LEFT JOIN p a ON a.doc_id = d.doc_id AND NOT a.edit LEFT JOIN p b ON b.doc_id = d.doc_id AND b.edit)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END::DOUBLE AS near_edited,
  CASE WHEN len(x) + len(z) = 0 THEN 1.0 ELSE len(list_intersect(x, z)) / len(list_distinct(list_concat(x, z)))::DOUBLE END::DOUBLE AS near_next
FROM k
""".format(b1=winnow.BASE, b2=pow(winnow.BASE, 2, winnow.PRIME), b4=pow(winnow.BASE, 4, winnow.PRIME), b8=pow(winnow.BASE, 8, winnow.PRIME)),
)
def fingerprint_query(spark, folder):
    return fingerprints_of(table(spark, folder, "documents").select("doc_id", "text"))


def fingerprints_of(docs: DataFrame) -> DataFrame:
    found = winnow.edited_fingerprints(docs)
    own, edited, following = (F.col(f"{c}_marks") for c in ("text", "edited", "next"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        winnow.spelled(own).alias("fingerprint"),
        winnow.spelled(edited).alias("edited_fingerprint"),
        winnow.likeness(own, edited).alias("near_edited"),
        winnow.likeness(own, following).alias("near_next"),
    )
