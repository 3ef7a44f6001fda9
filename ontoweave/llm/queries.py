"""The training-data queries and their SQL: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, line_dedup
from .decontaminate import contaminated
from .licenses import license_scan
from .licenses import oracle_sql as license_sql
from .packing import pack
from .simhash import simhash_classes
from .substring_dedup import substring_dedup
from .token_files import read_token_shards, write_token_shards
from .topk import integer_vectors, top_k
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontaminate(spark, sf_dir):
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_packing(spark, sf_dir):
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_token_files(spark, sf_dir):
    return read_token_shards(write_token_shards(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_license_scan(spark, sf_dir):
    return license_scan(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark, sf_dir):
    hard = r"\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.write_chats(rows.unionByName(more)))


def op9_simhash(spark, sf_dir):
    return simhash_classes(_table(spark, sf_dir, "documents"))


def op10_top_k(spark, sf_dir):
    vectors = integer_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.where("id % 50 = 0"), vectors)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_packing": op4_packing,
    "op5_token_files": op5_token_files,
    "op6_license_scan": op6_license_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_simhash": op9_simhash,
    "op10_top_k": op10_top_k,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
        runs AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM starts),
        firsts AS (SELECT k, min(doc_id) AS owner FROM runs GROUP BY k),
        hits AS (SELECT doc_id, s FROM runs JOIN firsts USING (k) WHERE owner < doc_id),
        gone AS (SELECT DISTINCT doc_id, s + j AS p FROM hits, range(50) AS t(j)),
        gone_of AS (SELECT doc_id, list(p) AS g FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
            sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE
                list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN gone_of USING (doc_id)""",
    "op6_license_scan": license_sql(),
    "op7_line_dedup": r"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        starts AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS s FROM d WHERE len(l) >= 3),
        runs AS (SELECT doc_id, s, l[s:s + 2] AS k FROM starts),
        firsts AS (SELECT k, min((doc_id, s)) AS owner FROM runs GROUP BY k),
        hits AS (SELECT doc_id, s FROM runs JOIN firsts USING (k) WHERE owner < (doc_id, s)),
        gone AS (SELECT DISTINCT doc_id, s + j AS p FROM hits, range(3) AS t(j)),
        gone_of AS (SELECT doc_id, list(p) AS g FROM gone GROUP BY doc_id)
        SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
            sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN l ELSE
                list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(g, i)), lambda i: l[i]) END, chr(10)), '')) AS kept_sha256
        FROM d LEFT JOIN gone_of USING (doc_id)""",
    "op8_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        t AS (SELECT *, role = 'assistant' AS target,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last,
            -- "### ", the role, ": ", the escaped text, " </turn>" and a newline
            sum(15 + length(role) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM c)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE target), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE target), '')) AS loss_sha256,
            coalesce(sum(upto) FILTER (WHERE target OR last), 0)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op10_top_k": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM v q, v x
            WHERE q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
}
