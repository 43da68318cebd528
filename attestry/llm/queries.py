"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import cap_filters, decontamination, exact_dedup, html_extraction, line_dedup, lm_scoring, packing, phrases, quality, ranked_search, secret_scan, simhash_dedup, toxicity
from attestry.llm.base import remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = docs.where(remainder("doc_id", 4) != 2)
    model = toxicity.learn(training, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), (remainder("id", 4) == 2).alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs)).withColumnRenamed("id", "doc_id")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.score(docs, remainder("doc_id", 7) != 2)
    return scored.select(F.col("id").alias("doc_id"), (remainder("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").alias("start_word"), F.col("size").alias("n_words"), "similarity")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.learn(docs))

    def joined(secrets):
        return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias("doc_id"),
        *(number(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "field")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best_of_each(phrases.collocations(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.equal_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_packing": op4_packing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_ranked_search": op11_ranked_search,
    "op12_phrases": op12_phrases,
    "op13_exact_dedup": op13_exact_dedup,
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "unnest(regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))".format(_LOWER.format("text"))

#: DuckDB SQL by query, where SQL can express it.
ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": f"""WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
  size AS (SELECT doc_id, sum(tf)::bigint AS n FROM tf GROUP BY 1), st AS (SELECT count(*) AS big_n, sum(n)::bigint AS l FROM size),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
  s AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // l))))::bigint AS score
    FROM q JOIN df USING (term) JOIN tf USING (term) JOIN size USING (doc_id), st GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank FROM s WHERE score > 0)
  SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_phrases": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
  g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k)),
  f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100), total AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
  cuts AS (SELECT lang, k, phrase, a, i, array_to_string(string_split(phrase, ' ')[:i], ' ') AS head, array_to_string(string_split(phrase, ' ')[i + 1:], ' ') AS tail FROM f, range(1, 5) t(i) WHERE i < k),
  scored AS (SELECT c.*, x.a AS l, y.a AS r, n, (1000::hugeint * c.a * n // (x.a::hugeint * y.a))::bigint AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail JOIN total ON total.lang = c.lang),
  low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS turn FROM scored) WHERE turn = 1),
  alone AS (SELECT * FROM low c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = c.lang AND f.k > c.k AND 100 * f.a >= 100 * c.a AND contains(' ' || f.phrase || ' ', ' ' || c.phrase || ' '))),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
  SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
    "op13_exact_dedup": r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
  SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t""",
}
