"""The operators applied to the driver's tables, and DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import op1_urls, op2_media, op3_quality, op4_bpe, op5_packing, op6_lm, op7_langid, op8_simhash, op9_chat, op10_minhash, op11_trie, op12_codes, op13_mixing

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A document is good if its score is at least this.
QUALITY_THRESHOLD = 0.3
OK_TEXT = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return op1_urls.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document, whose figure refers to the document's payload by digest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2("text", 256)
    html = F.concat(F.lit("<article><h1>Document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit('</h1><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), F.octet_length("text").cast("string"), F.lit(" bytes</figcaption></figure><p>End</p></article>"))
    parsed = op2_media.sequences(docs.select("doc_id", html.alias("html")), "doc_id", "html")
    media = op2_media.describe_media(op2_media.store_media(docs))
    items = op2_media.resolve(parsed, media, "doc_id").where("kind = 'image'")
    return items.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = op3_quality.train_quality_model(docs, _table(spark, sf_dir, "labels"))
    scored = op3_quality.score_quality(docs, model)
    return scored.select("doc_id", (op7_langid.fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_bpe.digest_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_lm.score_documents(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = op7_langid.predict_languages(docs, op7_langid.train_language_model(docs))
    return found.select("doc_id", (op7_langid.fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8_simhash.link_close(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", OK_TEXT), (-1, 1, "assistant", OK_TEXT)], "conv_id long, turn long, role string, text string")
    return op9_chat.digest_conversations(rows.unionByName(own))


def op10_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_minhash.edited_neighbours(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = op11_trie.digested(_table(spark, sf_dir, "conversations"))
    return op11_trie.prefix_trie(*op11_trie.with_shared_heads(turns))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_codes.encode_vectors(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_media_columns": op2_media_columns,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_packing": op5_packing_query,
    "op6_lm_scores": op6_lm_scores,
    "op7_language_id": op7_language_id,
    "op8_simhash_links": op8_simhash_links,
    "op9_chat_format": op9_chat_format,
    "op10_minhash_fingerprints": op10_minhash_fingerprints,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_mix": op13_source_mix,
}


def _codes_sql(parts: int = op12_codes.PARTS, entries: int = op12_codes.ENTRIES, rounds: int = op12_codes.ROUNDS, scale: int = op12_codes.SCALE) -> str:
    """Plain Lloyd over all entries, round by round."""
    steps = [
        f"""WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        ints AS MATERIALIZED (
            SELECT n, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS pos, floor({scale} * embedding[i]::DOUBLE)::BIGINT AS v
            FROM kept, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)),
        b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, pos, v FROM ints WHERE n <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
            SELECT n, part, min((d, entry)) AS best FROM (SELECT n, part, entry, sum((i.v - b.v) * (i.v - b.v))::BIGINT AS d FROM ints i JOIN b{r} b USING (part, pos) GROUP BY n, part, entry) GROUP BY n, part),
        b{r + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v
            FROM b{r} b LEFT JOIN (SELECT i.part, a.best[2] AS entry, i.pos, floor(sum(i.v) / count(*))::BIGINT AS v FROM ints i JOIN a{r} a USING (n, part) GROUP BY ALL) m USING (part, entry, pos))"""
        )
    return ",\n        ".join(steps) + f""",
        coded AS (SELECT n, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY n)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
        FROM kept JOIN coded USING (n)
    """

ORACLES = {
    "op1_url_filter": f"""
        WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
        parts AS (
            SELECT page_id, coalesce(url, '') AS u,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{op1_urls.UPPER}', '{op1_urls.LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
                   row_number() OVER () AS row_id
            FROM pages),
        fits AS (
            SELECT p.row_id, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.row_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
            FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN (SELECT * FROM fits WHERE place = 1) f ON p.row_id = f.row_id
    """,
    "op9_chat_format": f"""
        WITH rows_ AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{OK_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{OK_TEXT}'),
        sized AS (
            SELECT *, length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) + {len(op9_chat.OPEN) + len(op9_chat.CLOSE) + 2} AS n
            FROM rows_)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op11_prefix_trie": """
        WITH own AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(concat(strlen(coalesce(role, '')), ':', role, text)), 32)) AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        crcs AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
                       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM own)),
        rebuilt AS (
            SELECT c.conv_id, o.place AS nth, 0 AS side, o.role, o.text FROM crcs c JOIN own o ON o.conv_id = c.base AND o.place <= c.h
            UNION ALL SELECT c.conv_id, o.place, 1, o.role, o.text FROM crcs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h),
        turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, nth) AS depth, sha256(strlen(role) || ':' || role || text) AS turn, length(text) AS chars FROM rebuilt),
        passed AS (
            SELECT conv_id, depth, chars, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM turns
            UNION ALL SELECT conv_id, 0, 0, '' FROM crcs),
        ended AS (SELECT conv_id, max(depth) AS depth FROM passed GROUP BY conv_id),
        nodes AS (
            SELECT p.node, min(p.conv_id) AS owner, p.depth, count(*) AS n_convs, max(p.chars) AS chars,
                   sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE p.depth = e.depth), '')) AS ends_sha256
            FROM passed p JOIN ended e USING (conv_id) GROUP BY p.node, p.depth),
        family AS (SELECT n.node, p.node AS parent FROM nodes n JOIN passed p ON p.conv_id = n.owner AND p.depth = n.depth - 1),
        children AS (SELECT parent AS node, count(*) AS n FROM family GROUP BY parent),
        above AS (SELECT n.node AS below, p.node AS node FROM nodes n JOIN passed p ON p.conv_id = n.owner AND p.depth <= n.depth),
        sums AS (
            SELECT a.node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens
            FROM above a JOIN nodes b ON b.node = a.below LEFT JOIN children c ON c.node = a.below GROUP BY a.node)
        SELECT n.owner AS conv_id, n.depth::BIGINT AS depth, p.owner AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
               s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums s USING (node) LEFT JOIN family f USING (node) LEFT JOIN nodes p ON p.node = f.parent LEFT JOIN children c ON c.node = n.node
    """,
    "op12_vector_codes": _codes_sql(),
}
