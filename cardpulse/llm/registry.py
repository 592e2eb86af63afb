"""Contract queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contamination import contamination
from .extraction import extract
from .innerproduct import top_products
from .linkgraph import Rule, judge
from .neardup import near_duplicates
from .packing import pack
from .pii import digest, find_pii
from .quality import fit_quality, score_quality
from .store import bound_batches
from .substrings import remove_repeats
from .toxicity import fit_toxicity, score_toxicity

#: Parameters of the contract queries.
NEAR_WORDS, NEAR_PERCENT = 3, 85
SEQUENCE_TOKENS = 2048
TOP = 10
URL_RULES: list[Rule] = [("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False)]
WINDOW_WORDS = 50
PHRASE_WORDS, HIT_SHARE = 13, 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. A query is an application: it bounds its session's Arrow batches, also for results that the caller runs."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def fold(folds: int) -> Column:
    """The fold of a row: crc32 of its doc_id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def _verdicts(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels").where(fold(5) != 0))
    return _verdicts(score_toxicity(docs, model), fold(5) == 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels").where(fold(3) != 1))
    return _verdicts(score_quality(docs, model), fold(3) == 1)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), NEAR_WORDS, NEAR_PERCENT)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), WINDOW_WORDS)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where(F.col("vec_id") % 100 == 0), TOP)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), PHRASE_WORDS, HIT_SHARE)


def tokenizer_path() -> str:
    """The word-end vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(_table(spark, sf_dir, "documents")))


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE_TOKENS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_mixture_packing": op5_mixture_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_exact_topk": op9_exact_topk,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4 that patterns alone decide, and SQL can state."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUERIES["pii_base_spans"] = pii_base_spans

_UPPER, _LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BASE_MATCHES = " UNION ALL ".join(f"SELECT u, '{k}' AS kind, {n} AS place, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS s FROM d" for n, (k, p) in enumerate(_BASE_PATTERNS.items()))
_LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(digits[length(digits) - k + 1] AS INT) ELSE CAST(digits[length(digits) - k + 1] AS INT) * 2 - CASE WHEN CAST(digits[length(digits) - k + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"

_SPACE_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_PHRASE_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
# the terms of a window, each within two words of its place in the same document (list slices end with the document)
_NEAR_TERMS = " AND ".join(f"(len(t) < {k + 1} OR list_contains(ws[greatest(b + {k} - 2, 1) : b + {k} + 2], t[{k + 1}]))" for k in range(PHRASE_WORDS))

ORACLE_SQL: dict[str, str] = {
    "pii_base_spans": f"""
        WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
        x AS ({_BASE_MATCHES}),
        y AS (SELECT u, kind, place, m[i] AS found, CAST(sum(length(s[i]) + length(m[i])) OVER (PARTITION BY u, kind ORDER BY i) AS BIGINT) AS past FROM x, unnest(range(1, len(m) + 1)) g(i)),
        z AS (SELECT *, regexp_replace(found, '[^0-9]', '', 'g') AS digits, past - length(found) AS start FROM y),
        v AS (
            SELECT * FROM z WHERE CASE kind WHEN 'ip' THEN len(list_filter(string_split(found, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT), 256) > 255)) = 0
                WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND {_LUHN} WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15 ELSE true END
        ), a AS (
            SELECT u, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE_PATTERNS)}, string_agg(kind || ':' || start || ':' || past, ',' ORDER BY place, start) AS spans FROM v GROUP BY u
        )
        SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _BASE_PATTERNS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a USING (u)
    """,
    # for pages without links between hosts, as those of the test tables; with links a test compares the scores with a plain page rank
    "op8_url_filters": f"""
        WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER_LETTERS}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in URL_RULES)}) v(rule_host, rule_path, allows)),
        m AS (SELECT h.*, (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule FROM h),
        j AS (SELECT m.*, r.allows FROM m LEFT JOIN r ON rule_host || rule_path = rule),
        n AS (SELECT host, allows, count(*) AS n, sum(count(*)) OVER (PARTITION BY allows) AS total FROM j WHERE rule IS NOT NULL GROUP BY host, allows),
        s AS (SELECT host, coalesce(sum(n / total * 0.15000000000000002::DOUBLE) FILTER (allows), 0) AS trust, coalesce(sum(n / total * 0.15000000000000002::DOUBLE) FILTER (NOT allows), 0) AS distrust FROM n GROUP BY host)
        SELECT page_id, host, path, rule, CASE WHEN CASE WHEN rule IS NULL THEN coalesce(distrust, 0) <= coalesce(trust, 0) ELSE allows END THEN 'allow' ELSE 'block' END AS verdict,
            coalesce(trust, 0.0::DOUBLE) AS trust, coalesce(distrust, 0.0::DOUBLE) AS distrust
        FROM j LEFT JOIN s USING (host)
    """,
    "op2_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT row_number() OVER () AS u, doc_id, {_SPACE_WORDS.replace("text", _LOWER)} AS ws FROM documents
        ), s AS (
            SELECT DISTINCT u, doc_id, CASE WHEN len(ws) < {NEAR_WORDS} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + {NEAR_WORDS - 1}], ' ') END AS k
            FROM w, unnest(range(1, greatest(len(ws) - {NEAR_WORDS - 1}, 1) + 1)) t(i) WHERE len(ws) > 0
        ), n AS (SELECT u, count(*) AS n FROM s GROUP BY u),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id JOIN n na ON na.u = a.u JOIN n nb ON nb.u = b.u
            GROUP BY a.u, b.u, a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {NEAR_PERCENT} * (na.n + nb.n - count(*))
        ), r AS (
            SELECT doc_id AS x, doc_id AS c FROM w UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.x
        ), m AS (SELECT x, min(c) AS c FROM r GROUP BY x)
        SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, coalesce(doc_id = m.c, true) AS kept
        FROM w LEFT JOIN n USING (u) LEFT JOIN m ON m.x = doc_id
    """,
    "op10_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_PHRASE_WORDS} AS ws FROM documents),
        q AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PHRASE_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
        z AS (SELECT DISTINCT item, CASE WHEN len(ws) < {PHRASE_WORDS} THEN ws ELSE ws[i : i + {PHRASE_WORDS - 1}] END AS t FROM q, unnest(range(1, greatest(len(ws) - {PHRASE_WORDS - 1}, 1) + 1)) g(i) WHERE len(ws) > 0),
        b AS (SELECT u, ws, b, ws[b] AS w FROM d, unnest(range(1, len(ws) + 1)) g(b)),
        c AS (SELECT u, item, b, len(t) AS n, ws[b : b + len(t) - 1] = t AS exact FROM b JOIN z ON w = t[1] WHERE {_NEAR_TERMS}),
        e AS (SELECT DISTINCT u, item FROM c WHERE exact),
        h AS (SELECT u, count(DISTINCT b + o) AS n_hit FROM c, range({PHRASE_WORDS}) r(o) WHERE exact AND o < n GROUP BY u),
        i AS (SELECT u, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM e GROUP BY u),
        k AS (SELECT u, count(DISTINCT item) AS n_near FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = c.u AND e.item = c.item) GROUP BY u)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND {HIT_SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN h USING (u) LEFT JOIN i USING (u) LEFT JOIN k USING (u)
    """,
    "op7_substring_dedup": f"""
        WITH w AS (SELECT row_number() OVER () AS u, doc_id, {_SPACE_WORDS} AS ws FROM documents),
        v AS (SELECT u, doc_id, i, array_to_string(ws[i : i + {WINDOW_WORDS - 1}], ' ') AS k FROM w, unnest(range(1, len(ws) - {WINDOW_WORDS - 2})) t(i)),
        f AS (SELECT k, min(doc_id) AS least FROM v GROUP BY k),
        g AS (SELECT DISTINCT u, i + o AS i FROM v JOIN f USING (k), range({WINDOW_WORDS}) r(o) WHERE doc_id > least),
        x AS (SELECT u, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) t(i)),
        y AS (SELECT x.u, count(g.u) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (g.u IS NULL) AS kept FROM x LEFT JOIN g ON x.u = g.u AND x.i = g.i GROUP BY 1)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y USING (u)
    """,
    "op9_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10
    """,
}
