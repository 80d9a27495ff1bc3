"""The registered queries of this subpackage, with their SQL forms where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm import (
    activelloyd,
    bitcodes,
    chunks,
    dartminhash,
    factors,
    latent,
    licenses,
    mixing,
    periodic,
    rankprofiles,
    secretscan,
    suffixes,
    url_lists,
)
from martwright.llm.common import open_table
from martwright.plans.registry import Build, Query

LLM: dict[str, Query] = {}


def _query(name: str, sql: str | None = None):
    def keep(build: Build) -> Build:
        LLM[name] = Query(build, sql)
        return build

    return keep


@_query(
    "op4_mixing",
    sql=r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws('|', '42', doc_id::VARCHAR, source, text)) AS digest
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)] AS w
  FROM docs GROUP BY source
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER done, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER done, 0)) AS level
  FROM ranked WINDOW done AS (ORDER BY ratio, source IS NULL DESC, source
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap, water * w) AS target FROM (
    SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS water FROM levels)
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY digest, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END AS epochs
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target) - epochs * source_size - before)))
         ::BIGINT AS taken
FROM placed
""",
)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights."""
    return mixing.mix(open_table(spark, sf_dir, "documents"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, parent domains and first path segments of the pages.

    Three events per key; day and action come from a digest of the key, so the list
    is the same in every engine.
    """
    host, path = url_lists.host_of(F.col("url")), url_lists.path_of(F.col("url"))
    keys = pages.select(
        F.explode(
            F.array(
                host,
                F.regexp_replace(host, r"^[^.]*\.", ""),
                F.concat(host, F.lit("/"), F.regexp_extract(path, "^[^/]*", 0)),
            )
        ).alias("key")
    ).distinct()
    digest = F.md5(F.concat("key", F.lit("#"), F.col("seq").cast("string")))
    number = F.conv(F.substring(digest, 1, 6), 16, 10).cast("int")
    kind = F.substring(digest, 8, 1)
    return (
        keys.where("key <> ''")
        .select("key", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"))
        .select(
            "key",
            "seq",
            F.date_add(F.lit("2024-01-01").cast("date"), number % 366).alias("day"),
            F.when(kind < "6", "block").when(kind < "a", "allow").otherwise("remove").alias(
                "action"
            ),
        )
    )


@_query(
    "op9_url_lists",
    sql=r"""
WITH caps AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetch_day,
         rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
         trim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/') AS path
  FROM pages
), keys AS (
  SELECT DISTINCT unnest([host, regexp_replace(host, '^[^.]*\.', ''),
                          host || '/' || regexp_extract(path, '^[^/]*', 0)]) AS key
  FROM caps
), events AS (
  SELECT key, seq, md5(key || '#' || seq::VARCHAR) AS d
  FROM keys, (SELECT unnest([1, 2, 3]) AS seq) WHERE key <> ''
), entries AS (
  SELECT key, seq, DATE '2024-01-01' + (('0x' || substr(d, 1, 6))::INT % 366)::INT AS day,
         CASE WHEN substr(d, 8, 1) < '6' THEN 'block' WHEN substr(d, 8, 1) < 'a' THEN 'allow'
              ELSE 'remove' END AS action
  FROM events
), spans AS (
  SELECT key, action, day AS first_day,
         lead(day) OVER (PARTITION BY key ORDER BY day, seq) AS end_day
  FROM entries
), active AS (
  SELECT * FROM spans
  WHERE action <> 'remove' AND (end_day IS NULL OR end_day > first_day)
), seen AS (SELECT *, row_number() OVER () AS rid FROM caps
), cover AS (
  SELECT rid, list_aggregate(labels[i:], 'string_agg', '.') AS key, 0 AS depth, fetch_day
  FROM (SELECT *, string_split(host, '.') AS labels,
               unnest(range(1, len(string_split(host, '.')) + 1)) AS i
        FROM seen WHERE host <> '')
  UNION ALL
  SELECT rid, host || '/' || list_aggregate(parts[1:i], 'string_agg', '/'), i, fetch_day
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT *, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts
              FROM seen WHERE host <> ''))
), hits AS (
  SELECT c.rid, c.key, a.action,
         row_number() OVER (PARTITION BY c.rid ORDER BY c.depth DESC, length(c.key) DESC) AS r
  FROM cover c JOIN active a ON a.key = c.key AND c.fetch_day >= a.first_day
       AND (a.end_day IS NULL OR c.fetch_day < a.end_day)
)
SELECT s.page_id, s.url, s.fetch_day, h.key AS matched_key, h.action,
       coalesce(h.action = 'block', false) AS blocked
FROM seen s LEFT JOIN hits h ON h.rid = s.rid AND h.r = 1
""",
)
def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day given by its id, against the list of its day."""
    pages = open_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn(
        "fetch_day",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")),
    )
    return url_lists.evaluate(captures, list_entries(pages))


@_query("op6_licenses")
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license findings; compared with a word-by-word search in the tests."""
    return licenses.scan(open_table(spark, sf_dir, "documents")).drop("detections")


@_query("op1_suffixes")
def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 400 bytes, and its words in shared passages of over 50 words."""
    docs = open_table(spark, sf_dir, "documents")
    return suffixes.remove_repeats(docs, threshold=400, with_kept=False, passage=51).drop("spans")


@_query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near-copies."""
    docs = open_table(spark, sf_dir, "documents")
    return dartminhash.near_duplicates(docs).select(
        "doc_id", "n_words", "class_id", "class_size", "class_key"
    )


@_query("op2_chunks")
def op2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks that an earlier place has."""
    docs = open_table(spark, sf_dir, "documents")
    return chunks.remove_repeated_chunks(docs, with_kept=False).drop("spans")


@_query("op7_bitcodes")
def op7_bitcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector, among all others."""
    vectors = open_table(spark, sf_dir, "embeddings")
    return bitcodes.nearest(vectors, F.col("vec_id") % 50 == 0)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> factors.Model:
    return factors.fit(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "quality"))


@_query("op10_factors")
def op10_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; the labels of every third id are kept for the test."""
    docs = open_table(spark, sf_dir, "documents")
    model = quality_model(docs, open_table(spark, sf_dir, "labels"))
    doc_id = F.col("doc_id")
    scored = factors.score(docs, model, carry={"doc_id": doc_id, "held_out": held_out(doc_id)})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query("op8_latent")
def op8_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks a benchmark text, with the text."""
    found = latent.leaks(
        open_table(spark, sf_dir, "documents"), open_table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", F.col("item").alias("item_id"), "cover", "told", "cosine", "start"
    )


def secret_model(docs: DataFrame):
    return secretscan.fit(secretscan.made_findings(docs))


@_query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document, with the forest's verdict; values as digests."""
    docs = open_table(spark, sf_dir, "documents")
    found = secretscan.scan(docs, secret_model(docs))
    return found.select(
        "doc_id",
        "word_no",
        F.length("value").alias("n_chars"),
        F.sha2("value", 256).alias("value_sha256"),
        "score",
        "is_secret",
    )


def _rounds(n: int) -> str:
    """SQL of the assignments to the books b0 .. bn, of which each is made from the one before."""
    out = []
    for i in range(n + 1):
        out.append(
            f"""far{i} AS MATERIALIZED (
  SELECT p.vec_id, p.part, any_value(p.x) AS x, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (
    SELECT p.*, b.entry, list_sum(list_transform(range(1, len(p.x) + 1),
           lambda k: (p.x[k] - b.x[k]) * (p.x[k] - b.x[k]))) AS d
    FROM pieces p JOIN b{i} b ON p.part = b.part) p
  GROUP BY p.vec_id, p.part
)"""
        )
        if i < n:
            out.append(
                f"""b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY k) AS x FROM (
      SELECT part, entry, k, sum(x[k])::BIGINT AS s, count(*) AS n
      FROM far{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM pieces))) AS k)
      GROUP BY part, entry, k)
    GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry
)"""
            )
    return ", ".join(out)


@_query(
    "op11_active_lloyd",
    sql=f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
  SELECT vec_id, part, v[part * w + 1 : part * w + w] AS x
  FROM (SELECT vec_id, v, len(v) // 16 AS w, unnest(range(16)) AS part FROM kept)
), b0 AS MATERIALIZED (
  SELECT p.part, n.entry, p.x FROM pieces p JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept
    ORDER BY vec_id LIMIT 64) n ON p.vec_id = n.vec_id
), {_rounds(2)}, codes AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM far2 GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), books
""",
)
def op11_active_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every usable vector, with the digest of the codebooks."""
    made = activelloyd.compress(open_table(spark, sf_dir, "embeddings"))
    digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return activelloyd.with_label_errors(made.codes).select(
        "vec_id",
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        F.lit(made.sha256).alias("codebooks_sha256"),
    )


def learnable(docs: DataFrame) -> DataFrame:
    """Texts with their language, but for those that are kept for the test."""
    return docs.where(~held_out(F.col("doc_id"))).select("lang", "text")


@_query(
    "op12_rank_profiles",
    sql=r"""
WITH bits AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)
              ORDER BY b) AS crc
  FROM (SELECT unnest(range(256)) AS b)
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, text, lang, coalesce(xor(list_reduce(
           list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 3 = 1, false) AS held_out
  FROM documents, bits
), words AS (
  SELECT rid, ' ' || unnest(regexp_extract_all(lower(text), '\p{L}+')) || ' ' AS w FROM docs
), grams AS (
  SELECT rid, unnest(list_transform(range(1, len(w) + 2 - n), lambda i: substr(w, i, n))) AS gram
  FROM (SELECT rid, w, unnest([1, 2, 3]) AS n FROM words)
), counts AS MATERIALIZED (
  SELECT rid, gram, count(*) AS n FROM grams WHERE gram <> ' ' GROUP BY ALL
), ranked AS (
  SELECT rid, gram, row_number() OVER (PARTITION BY rid ORDER BY n DESC, gram) - 1 AS rank FROM counts
), own AS MATERIALIZED (SELECT * FROM ranked WHERE rank < 300),
profiles AS MATERIALIZED (
  SELECT * FROM (
    SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS rank
    FROM counts JOIN docs USING (rid) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram)
  WHERE rank < 300
), sizes AS (SELECT rid, count(*) AS m FROM own GROUP BY rid),
far AS (
  SELECT s.rid, l.lang, s.m, s.m * 300 - coalesce(sum(300 - abs(o.rank - p.rank)), 0) AS far
  FROM sizes s CROSS JOIN (SELECT DISTINCT lang FROM profiles) l
  LEFT JOIN (own o JOIN profiles p ON o.gram = p.gram) ON o.rid = s.rid AND p.lang = l.lang
  GROUP BY s.rid, l.lang, s.m
), best AS (
  SELECT rid, arg_min(lang, (far, lang)) AS lang_pred, min(far) AS far, any_value(m) AS m FROM far GROUP BY rid
)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred,
       coalesce(1.0::DOUBLE - far::DOUBLE / (m * 300)::DOUBLE, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN best USING (rid)
""",
)
def op12_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; the languages of every third id are kept for the test."""
    docs = open_table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    carry = {"doc_id": doc_id, "held_out": held_out(doc_id)}
    return rankprofiles.predict(docs, rankprofiles.fit(learnable(docs)), carry=carry)


def with_tails(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth (by a digest of the id) goes on in copies of a stretch of its words.

    With h the crc32 of the id and g a tenth of it, the words from a = g % n on are the
    1 + (n - a) / (3 + g % 8) words after a, again and again.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10).cast("long"), F.size("w").cast("long")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))

    def again(words: Column, a: Column, p: Column) -> Column:
        tail = F.transform(
            F.sequence(a, F.size(words).cast("long") - 1),
            lambda i: F.element_at(words, (a + (i - a) % p + 1).cast("int")),
        )
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")

    marked = docs.select("doc_id", "text", F.coalesce(h % 10 == 0, F.lit(False)).alias("tailed"))
    tailed = (
        marked.withColumn("w", F.when(F.col("tailed"), words))
        .withColumn("a", F.when(n > 0, g % n))
        .withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + g % 8)).cast("long"))
    )
    text = F.when(F.col("a").isNotNull(), again(F.col("w"), F.col("a"), F.col("p"))).otherwise(F.col("text"))
    return tailed.select("doc_id", text.alias("text"))


@_query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs and the digest of its text without their repeats."""
    docs = with_tails(open_table(spark, sf_dir, "documents"))
    found = periodic.find_runs(docs, with_kept=False)
    longer = lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
    ).otherwise(best)
    kind = found.schema["runs"].dataType.elementType
    best = F.aggregate("runs", F.lit(None).cast(kind), longer)
    line = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.col("kept_sha256").alias("collapsed_sha256"),
    )
