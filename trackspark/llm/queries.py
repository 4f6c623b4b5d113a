"""The registered queries of this subpackage: each applies one operator to the whole documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, flac, infill, langid, lbl, lexical, packing, pieces, repetition, secrets, shards, simhash, substrings
from .common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_confirmed_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir), words=4, distance=4)


def op3_flac_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(flac.encode_media(documents(spark, sf_dir)))


def op4_viterbi_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label_languages(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op5_polynomial_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score_documents(documents(spark, sf_dir))


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(documents(spark, sf_dir).select("doc_id", "text"), 40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), 1024, 2)


def op9_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op10_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(documents(spark, sf_dir))


def op11_fenwick_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(documents(spark, sf_dir), unit="char", seed=1, fim=90, spm=20)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"))


def op12_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def op13_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_repeats", "longest_repeat", "covered_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_confirmed_secrets": op1_confirmed_secrets,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_flac_columns": op3_flac_columns,
    "op4_viterbi_languages": op4_viterbi_languages,
    "op5_polynomial_dedup": op5_polynomial_dedup,
    "op6_log_bilinear": op6_log_bilinear,
    "op7_jump_shards": op7_jump_shards,
    "op8_histogram_packing": op8_histogram_packing,
    "op9_piece_agenda": op9_piece_agenda,
    "op10_repeated_windows": op10_repeated_windows,
    "op11_fenwick_infill": op11_fenwick_infill,
    "op12_geometric_blocks": op12_geometric_blocks,
    "op13_suffix_repetition": op13_suffix_repetition,
}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES: dict[str, str] = {
    "op5_polynomial_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY body)""",
    "op10_repeated_windows": rf"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT r, id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
        s AS (SELECT r, id, i, word, {" || ' ' || ".join(f"lead(word, {j}) OVER o" for j in range(13))} AS win FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
        x AS (SELECT r, i, word, win IS NOT NULL AND id > min(id) OVER (PARTITION BY win) AS later FROM s),
        g AS (SELECT r, i, word, max(later) OVER (PARTITION BY r ORDER BY i ROWS 12 PRECEDING) AS gone FROM x),
        k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS body FROM g GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM t LEFT JOIN k USING (r)""",
    "op11_fenwick_infill": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
        d AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
                     CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS e FROM t),
        f AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q,
                     CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        o AS (SELECT *, substr(body, 1, p) AS pre, substr(body, p + 1, q - p) AS mid, substr(body, q + 1) AS suf FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(body) AS restored_sha256
        FROM o""",
    "op12_geometric_blocks": f"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS x FROM documents),
        d AS (SELECT r, doc_id, len(x) AS n FROM w WHERE len(x) > 0), s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(x) AS term FROM w) GROUP BY ALL),
        i AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
        t AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p CROSS JOIN s WHERE term IN (SELECT term FROM i) GROUP BY term, nd),
        m AS (SELECT r, 100 - 75 + (75 * n * nd) // l AS m FROM d CROSS JOIN s),
        e AS (SELECT item_id, r, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN t USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM e JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 10""",
}
