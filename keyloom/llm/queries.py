"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontamination, html_text, infilling, langid, line_dedup, mixing, set_join, simhash, token_counts, topk, toxicity, vector_codes, warc
from keyloom.llm.common import fold, keep, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture is found again by its key through the index and read from the archives."""
    captures, index, folder = warc.archive(spark, table(spark, sf_dir, "pages"))
    found = warc.lookup(captures.select(F.col("key").alias("prefix")), index, folder)
    return warc.read_records(found, folder)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(fold(F.col("doc_id"), 3) != 1), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "nats", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sizes_of(table(spark, sf_dir, "documents"), ["doc_id"]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = keep(token_counts.length_histogram(table(spark, sf_dir, "documents"), TOKENIZER), "lengths")
    return token_counts.suffix_sums(histogram)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk.top_k(vectors, vectors.where(F.col("row") % 20 == 0), 20)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are rotated, and rotated back from output and form; both are reported as digests."""
    moved = infilling.infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infilling.restored(moved.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256)))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = vector_codes.codes(vector_codes.prepared(table(spark, sf_dir, "embeddings")))
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(book)).alias("codebooks_sha256"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.near_duplicates(table(spark, sf_dir, "documents"))


_ASSIGNED = """SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT vec_id, p.part, entry,
            CAST(coalesce(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.v, c.v)]), 0) AS BIGINT) AS d FROM p JOIN {book} c ON p.part = c.part) GROUP BY vec_id, part"""
_MOVED = """SELECT part, entry, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v
            FROM (SELECT part, entry, i, CAST(floor(sum(v[i + 1]) / count(*)) AS BIGINT) AS x FROM {assigned} JOIN p USING (vec_id, part), range(len(v)) t(i) GROUP BY ALL)
            GROUP BY part, entry) m USING (part, entry)"""
VECTOR_CODES = f"""
        WITH k AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        p AS (SELECT vec_id, part, e[part * len(e) // 16 + 1 : (part + 1) * len(e) // 16] AS v FROM k, range(16) t(part)),
        c0 AS (SELECT part, entry, v FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k) JOIN p USING (vec_id) WHERE entry < 64),
        a0 AS ({_ASSIGNED.format(book="c0")}), c1 AS ({_MOVED.format(book="c0", assigned="a0")}),
        a1 AS ({_ASSIGNED.format(book="c1")}), c2 AS ({_MOVED.format(book="c1", assigned="a1")}),
        a2 AS ({_ASSIGNED.format(book="c2")}),
        s AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN s USING (vec_id), h"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": op1_warc_index,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op10_top_k": op10_top_k,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}
ORACLES: dict[str, str] = {
    "op10_top_k": """
        WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
            WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""",
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        n AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h FROM d),
        f AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
            CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
        p AS (SELECT *, '<P>' || substr(t, 1, a) AS p, '<M>' || substr(t, a + 1, b - a) AS m, '<S>' || substr(t, b + 1) AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_vector_codes": VECTOR_CODES,
    "op13_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a)
        SELECT node AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node""",
}
