"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import decontaminate, licences, line_dedup, ngram_join, pii, quality, simhash, source_mix, token_records, toxicity
from .storage import documents


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark, sf_dir):
    return simhash.fingerprints_with_edits(spark, documents(spark, sf_dir))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.digests(spark, documents(spark, sf_dir))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxic_documents(spark, documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op4_token_records(spark, sf_dir):
    return token_records.tokenized(spark, documents(spark, sf_dir), tokenizer_path())


def op5_source_mix(spark, sf_dir):
    return source_mix.taken_words(spark, documents(spark, sf_dir))


def op6_ngram_jaccard(spark, sf_dir):
    return ngram_join.similar_documents(spark, documents(spark, sf_dir))


def op7_quality(spark, sf_dir):
    return quality.quality_scores(spark, documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_license_scan(spark, sf_dir):
    return licences.scanned(spark, documents(spark, sf_dir))


def op9_decontamination(spark, sf_dir):
    return decontaminate.contaminations(spark, documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


#: For the query alone; a user passes a key of their own.
QUERY_KEY = b"a key that only the query uses"


def op10_pseudonyms(spark, sf_dir):
    return pii.counted(pii.pseudonymized(documents(spark, sf_dir), QUERY_KEY))


QUERIES = {
    f.__name__: f
    for f in (op1_document_fingerprints, op2_line_dedup, op3_toxicity, op4_token_records, op5_source_mix, op6_ngram_jaccard, op7_quality, op8_license_scan, op9_decontamination, op10_pseudonyms)
}
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_SHINGLES = "list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"

NGRAM_JACCARD_SQL = f"""
    WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_FOLDED} AS t FROM documents)),
    sets AS (SELECT doc_id, {_SHINGLES} AS s FROM words),
    elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
    links AS (
        SELECT a.doc_id AS x, b.doc_id AS y FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
    ),
    both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reached WHERE x = doc_id), doc_id)) AS component_id FROM sets
"""
LINE_DEDUP_SQL = f"""
    WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS t FROM (SELECT doc_id, string_split({_FOLDED}, chr(10)) AS l FROM documents)),
    words AS (SELECT doc_id, line, {_WORDS} AS w FROM lines),
    sets AS (SELECT doc_id, line, list_sort({_SHINGLES}) AS s FROM words),
    distinct_sets AS (SELECT s, len(s) AS n, min((doc_id, line)) AS place, row_number() OVER () AS id FROM sets WHERE len(s) > 0 GROUP BY s),
    elements AS (SELECT id, n, place, unnest(s) AS e FROM distinct_sets),
    matched AS (
        SELECT DISTINCT id FROM (
            SELECT b.id FROM elements a JOIN elements b ON a.e = b.e AND a.place < b.place AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
            GROUP BY a.id, b.id, a.n, b.n HAVING 4 * count(*) >= 3 * (a.n + b.n - count(*)))
    ),
    gone AS (SELECT doc_id, line FROM sets JOIN distinct_sets d USING (s) WHERE (doc_id, line) <> d.place OR d.id IN (SELECT id FROM matched)),
    per_doc AS (SELECT doc_id, count(*) AS k, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(k, 0) AS n_removed, coalesce(removed, '') AS removed
    FROM documents d LEFT JOIN per_doc USING (doc_id)
"""

SQL = {"op2_line_dedup": LINE_DEDUP_SQL, "op6_ngram_jaccard": NGRAM_JACCARD_SQL, "op8_license_scan": licences.oracle()}
