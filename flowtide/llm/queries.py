"""The operators of this subpackage over their whole tables, and DuckDB SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import dialogue, html, langid, lm, lzprint, mixing, packing, phrases, quality, secrets, simhash, token_files, urls
from flowtide.llm.common import documents
from flowtide.llm.urls_sql import judge_sql
from flowtide.plans.materialise import materialise, scratch_path

END_OF_TEXT = {"word_bpe_49k.json": 1, "byte_bpe_50k.json": 2}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "word_bpe_49k.json"
    return packing.packed(documents(spark, sf_dir), tokenizer_file(name), "bare", END_OF_TEXT[name]).drop("ids")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "byte_bpe_50k.json"
    folder = scratch_path(spark, "token_files")
    shards = materialise(
        token_files.write_token_files(documents(spark, sf_dir), folder, tokenizer_file(name), "leading", END_OF_TEXT[name]), "shards"
    )
    return token_files.read_token_files(shards, folder).drop("shard")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.with_edits(documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).drop("grp")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.audits(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_token_files, op3_lm_scores, op4_mixing, op5_simhash, op6_html_text, op7_lz_fingerprints,
        op8_secrets, op9_quality, op10_language_id, op11_collocations, op12_url_filters,
        op13_conversation_repair,
    )
}

_MIX = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
        source_size * 2.0::DOUBLE AS most
    FROM sources
), ranked AS (
    SELECT *, most / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted FROM weighed
), levels AS (
    SELECT *, (wanted - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here
    FROM ranked WINDOW w AS (ORDER BY ratio, source NULLS LAST)
), level AS (
    SELECT max(level_here) AS level FROM levels WHERE level_here <= ratio
), targets AS (
    SELECT source, source_size, least(most, level * weight) AS target FROM levels, level
), plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets
), placed AS (
    SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, CAST(floor(p.target) AS BIGINT) - p.epochs * p.source_size
        - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
    FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM placed
"""

_PHRASES = r"""
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece_no, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    )
), words AS (
    SELECT lang, piece_no, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM pieces
), runs AS (
    SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece_no ORDER BY pos)
), ones AS (
    SELECT lang, w1 AS w, count(*) AS a FROM runs GROUP BY ALL
), twos AS (
    SELECT lang, w1, w2, count(*) AS a FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), threes AS (
    SELECT lang, w1, w2, w3, count(*) AS a FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
    SELECT lang, w1, w2, max(a) AS most FROM (
        SELECT lang, w1, w2, a FROM threes UNION ALL SELECT lang, w2, w3, a FROM threes
    ) GROUP BY ALL
), cuts AS (
    SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, 1 AS cut, t.a, x.a AS l, y.a AS r
    FROM twos t JOIN ones x ON x.lang = t.lang AND x.w = t.w1 JOIN ones y ON y.lang = t.lang AND y.w = t.w2
    LEFT JOIN longer o ON o.lang = t.lang AND o.w1 = t.w1 AND o.w2 = t.w2
    WHERE o.most IS NULL OR 100 * o.most < 50 * t.a
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.a, x.a, y.a
    FROM threes t JOIN ones x ON x.lang = t.lang AND x.w = t.w1 JOIN twos y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.a, x.a, y.a
    FROM threes t JOIN twos x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN ones y ON y.lang = t.lang AND y.w = t.w3
), scored AS (
    SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score
FROM ranked k JOIN (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM ones GROUP BY lang) n ON n.lang = k.lang WHERE k.rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op4_mixing": _MIX, "op11_collocations": _PHRASES, "op12_url_filters": judge_sql()}
