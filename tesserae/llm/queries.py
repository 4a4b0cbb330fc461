"""The queries of this subpackage, one per operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.decontaminate import benchmark_matches
from tesserae.llm.exact_dedup import exact_groups
from tesserae.llm.filter_audit import filter_audit
from tesserae.llm.html_extract import extract_main_text
from tesserae.llm.jaccard import jaccard_components
from tesserae.llm.license_scan import license_scan
from tesserae.llm.line_dedup import line_dedup
from tesserae.llm.lsh_forest import near_components
from tesserae.llm.phrases import collocations
from tesserae.llm.quality import quality_scores
from tesserae.llm.sentencepiece_codec import encode_documents
from tesserae.llm.sharding import extendible_shards
from tesserae.llm.token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_license_scan,
        op2_html_extraction,
        op3_extendible_sharding,
        op4_benchmark_decontamination,
        op5_jaccard_join,
        op6_quality_classifier,
        op7_sentencepiece,
        op8_token_counts,
        op9_line_dedup,
        op10_exact_dedup,
        op11_filter_audit,
        op12_near_dedup,
        op13_collocations,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_extendible_sharding": """
            WITH r AS (
                SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
                       ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS hash
                FROM documents),
            d AS (
                SELECT r.*, depth::INT AS depth,
                       sum(bytes) OVER (PARTITION BY depth, hash >> (60 - depth)) AS shard_bytes
                FROM r, range(0, 61) AS t(depth)),
            f AS (
                SELECT *, row_number() OVER (PARTITION BY doc_id, hash ORDER BY depth) AS place
                FROM d WHERE shard_bytes <= 1048576 OR depth = 60)
            SELECT doc_id, right(lpad(bin(hash >> (60 - depth)), 60, '0'), depth) AS shard, depth, 0::BIGINT AS part, bytes,
                   shard_bytes::BIGINT AS shard_bytes
            FROM f WHERE place = 1""",
        "op5_jaccard_join": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x20\x09-\x0D]+') AS words
                FROM documents),
            s AS (
                SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
                    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
                FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (
                SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
                FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
            l AS (
                SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                WHERE 100 * common >= 75 * (x.n + y.n - common)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
            SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
            FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node""",
        "op9_line_dedup": r"""
            WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
            x AS (
                SELECT doc_id, unnest(range(0, len(lines)))::INT AS place, unnest(lines) AS line FROM t),
            l AS (SELECT * FROM x WHERE trim(line) <> ''),
            d AS (SELECT DISTINCT line, length(line) AS n, least(2, length(line) // 10) AS t FROM l WHERE length(line) >= 10),
            e AS (
                SELECT a.line AS a, b.line AS b FROM d a JOIN d b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line
                WHERE (a.n < 20 OR b.n < 20 OR substr(a.line, 1, 6) = substr(b.line, 1, 6) OR substr(a.line, -6) = substr(b.line, -6)
                       OR levenshtein(substr(a.line, 1, 9), substr(b.line, 1, 9)) <= 2)
                  AND levenshtein(a.line, b.line) <= least(a.t, b.t)),
            r(node, other) AS (SELECT line, line FROM l UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
            c AS (SELECT node AS line, min(other) AS head FROM r GROUP BY node),
            k AS (
                SELECT doc_id, place, row_number() OVER (PARTITION BY head ORDER BY doc_id, place) > 1 AS gone
                FROM l JOIN c USING (line)),
            g AS (SELECT doc_id, list(place ORDER BY place) AS dropped FROM k WHERE gone GROUP BY doc_id)
            SELECT t.doc_id, coalesce(len(t.lines), 0)::BIGINT AS n_lines, coalesce(len(g.dropped), 0)::BIGINT AS n_dropped,
                   coalesce(g.dropped, []::INT[]) AS dropped
            FROM t LEFT JOIN g USING (doc_id)""",
        "op10_exact_dedup": r"""
            WITH n AS (
                SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
                FROM documents)
            SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = min(doc_id) OVER g AS kept, text_sha256
            FROM n WINDOW g AS (PARTITION BY text_sha256)""",
        "op11_filter_audit": r"""
            WITH RECURSIVE words AS (
                SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
                FROM documents),
            marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
            fails AS (
                SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                       CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                       || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
                       || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                       || CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
                FROM words LEFT JOIN marks ON marks.doc_id = words.doc_id),
            counts AS (SELECT part, failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM fails GROUP BY ALL),
            orders(filter_order) AS (
                SELECT '' UNION ALL SELECT filter_order || c FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE NOT contains(filter_order, c)),
            steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS filter, filter_order[1:step - 1] AS before FROM orders, range(1, 6) t(step) WHERE length(filter_order) = 5),
            out AS (
                SELECT part, filter_order, step, filter, sum(n) FILTER (NOT gone AND NOT contains(failed, filter)) AS kept,
                       sum(n) FILTER (NOT gone AND contains(failed, filter)) AS removed, sum(n) FILTER (gone AND contains(failed, filter)) AS redundant,
                       sum(n) FILTER (failed = filter) AS unique_fails, sum(good) FILTER (NOT gone AND contains(failed, filter)) AS good_lost,
                       sum(toxic) FILTER (NOT gone AND contains(failed, filter)) AS toxic_lost
                FROM (SELECT *, regexp_matches(failed, '[' || before || '!]') AS gone FROM counts, steps) GROUP BY ALL)
            SELECT part, filter_order, step, filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
                   coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
                   coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley
            FROM out""",
        "op12_near_dedup": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x20\x09-\x0D]+') AS words
                FROM documents),
            s AS (
                SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
                    ELSE list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i + 1], ' ')) END)) AS shingle
                FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (
                SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
                FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
            l AS (
                SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                WHERE 100 * common >= 80 * (x.n + y.n - common)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
            SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id, r.node = min(r.other) AS kept
            FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node""",
        "op13_collocations": r"""
            WITH pieces AS (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
            totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
            f AS (
                SELECT lang, gram, count(*) AS a
                FROM (SELECT lang, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])) AS gram FROM w, range(1, 5) t(k))
                GROUP BY ALL HAVING count(*) >= 30),
            c AS (SELECT * FROM f WHERE len(gram) >= 2),
            inner_ AS (
                SELECT lang, sub AS gram, max(a) AS most
                FROM (SELECT lang, a, unnest(list_transform(range(1, len(gram) - k + 2), lambda i: gram[i:i + k - 1])) AS sub FROM c, range(2, 4) t(k) WHERE k < len(gram))
                GROUP BY ALL),
            kept AS (
                SELECT c.lang, c.gram, c.a FROM c LEFT JOIN inner_ i ON i.lang = c.lang AND i.gram = c.gram
                WHERE i.most IS NULL OR 100 * i.most::HUGEINT < 80 * c.a::HUGEINT),
            cuts AS (
                SELECT kept.lang, kept.gram, kept.a, k, x.a AS l, y.a AS r, (2000000 * kept.a::HUGEINT) // (x.a + y.a) AS score
                FROM kept JOIN range(1, 4) t(k) ON k < len(kept.gram) JOIN f x ON x.lang = kept.lang AND x.gram = kept.gram[1:k]
                JOIN f y ON y.lang = kept.lang AND y.gram = kept.gram[k + 1:]),
            best AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) AS place FROM cuts),
            ranked AS (
                SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(gram, ' '))) AS rank,
                       array_to_string(gram, ' ') AS phrase, a, l, r, score::BIGINT AS score
                FROM best WHERE place = 1)
            SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    }
