"""One query an operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm import exact_dedup, hyperminhash, kneser_ney, language_id, line_dedup, mixing, packing, pstable_ann, sharding, token_alignment, token_store, turn_repair, warc_zst
from tidewell.llm.text import documents
from tidewell.storage import materialize, work_path

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-store")
    token_store.write_store(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER), end_id=0)
    return token_store.verify(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_corpus(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = line_dedup.LineIndex.build(docs).apply(docs, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_corpus(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), times=1.5, most=2.0)


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op7_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return pstable_ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), end_id=1, with_ids=False)
    return packed.drop("ids")


def op9_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    warc_zst.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, least_bytes=0)
    return warc_zst.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op11_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), shards=40)


def op12_perfect_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = token_alignment.align_corpus(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return made.documents().select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def op13_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"), damaged=True)


QUERIES = {
    f.__name__: f
    for f in (op1_token_store, op2_kneser_ney, op3_line_dedup, op4_language_id, op5_mixing, op6_hyperminhash, op7_multiprobe_ann, op8_vector_packing, op9_warc_zst, op10_exact_dedup, op11_prefix_shards, op12_perfect_hash_alignment, op13_hirschberg_repair)
}

_SPACE = r"[\x20\x09-\x0D]+"
_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def _crc_table() -> list[int]:
    """The remainders of all bytes by the polynomial of crc32."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return out


def _crc_sql(bytes_: str) -> str:
    """DuckDB's crc32 of a list of byte values."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])))"


def _steps_sql() -> str:
    """What a row can become, in SQL: kind of role, fault, state, next state, cost, edits."""
    rows = [(c // 3, c % 3, a, z, *way) for c, table in enumerate(turn_repair.ROW) for a, row in enumerate(table) for z, way in enumerate(row) if way]
    return ", ".join(map(str, rows))


#: DuckDB SQL over whole tables, where SQL can say it.
ORACLE_SQL = {
    "op3_line_dedup": rf"""
        WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
        keyed AS (SELECT doc_id, k, line, translate(regexp_replace(line, '{_TRIM}', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM split),
        often AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        told AS (SELECT d.doc_id, d.k, d.line, o.key IS NOT NULL AND o.last_doc <> d.doc_id AS gone FROM keyed d LEFT JOIN often o ON d.key = o.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM told GROUP BY doc_id""",
    "op6_hyperminhash": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                     ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
        n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
        e AS (SELECT doc_id, unnest(sh) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
        u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a)
        SELECT n.doc_id, n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n_shingles""",
    "op9_warc_zst": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        first AS (SELECT html, min(page_id) AS keep FROM p GROUP BY html),
        hex AS (SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS h, keep FROM p JOIN first USING (html)),
        bits AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(h || '000', 1 + (5 * i) // 4, 3))::BIGINT >> (7 - (5 * i) % 4)) & 31)::INT, 1)) AS c FROM hex)
        SELECT page_id, payload_bytes, array_to_string(c, '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM bits""",
    "op10_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op11_prefix_shards": f"""
        WITH b AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
        s AS (SELECT doc_id, size, {_crc_sql("bytes")} AS text_crc32 FROM b),
        o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)::HUGEINT AS upto, sum(size) OVER ()::HUGEINT AS total FROM s),
        p AS (SELECT *, least((2 * upto - size) * 40 // (2 * total), 39)::INT AS shard FROM o)
        SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, NULL::INT AS grown_shard
        FROM p""",
    "op13_hirschberg_repair": rf"""
        WITH RECURSIVE steps(kind, weight, state, next, cost, edits) AS (VALUES {_steps_sql()}),
        c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        h AS (SELECT *, {_crc_sql("list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)")} % 20 AS d FROM c),
        g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE d <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM g),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                     role[1] || lead(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM n),
        t AS (SELECT conv_id, pos, CASE role[1] WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END AS weight FROM f),
        s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                     count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS pos FROM f GROUP BY conv_id),
        w AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {{'cost': 0, 'audit': ''}} AS way FROM t
              UNION ALL
              SELECT t.conv_id, t.pos, x.next, min({{'cost': w.way.cost + x.cost, 'audit': w.way.audit || x.edits}})
              FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1 JOIN steps x ON x.kind = t.kind AND x.weight = t.weight AND x.state = w.state GROUP BY 1, 2, 3),
        b AS (SELECT s.*, best.cost, best.audit FROM s JOIN (SELECT w.conv_id, min({{'cost': w.way.cost + [0, 4, 2, 0][w.state + 1], 'audit': w.way.audit || ['', 'II', 'I', ''][w.state + 1]}}) AS best
              FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos GROUP BY w.conv_id) v ON v.conv_id IS NOT DISTINCT FROM s.conv_id),
        e AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS i, audit FROM b),
        m AS (SELECT *, audit[i] AS edit, length(replace(audit[1:i], 'I', '')) AS pos, length(replace(audit[i + 1:], 'D', '')) AS behind FROM e),
        r AS (SELECT m.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN f.role WHEN behind % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY i)) AS sha
              FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.pos = m.pos WHERE edit <> 'D' GROUP BY m.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id""",
}


# --- stages of the pipeline -------------------------------------------------------


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay, with ``lang`` as predicted; und goes.

    A row with null or empty text, or without a letter, is und. Null ids and repeated rows are judged each for itself. Where no row has
    a language to learn from, all go; no rows give no rows.
    """
    model = language_id.train(docs)
    told = language_id.identify(docs, model).where("lang_pred != 'und' AND score >= 0.5")
    return told.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them share, but in the last.

    All rows stay. A null text becomes empty, a row without an id keeps its lines, rows repeating an id count as one document and
    lose the same lines; ``n_chars`` is that of the new text.
    """
    kept = line_dedup.LineIndex.build(docs).apply(docs, min_docs=3)
    kept = kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: five words, 0.8 or more.

    Documents without words and rows without an id stay; rows repeating an id stay or go together.
    """
    gone = hyperminhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, rows with a null or repeated id each for itself.

    Rows are numbered in a written table before the mix, and its copies come back by that number. Rows of size 0 are taken by the
    whole part of their source's copy number only, so a source of empty texts gives none.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    copies = mixing.mix(rows, row_key="__row").where("copies > 0").select("__row", "copies")
    return rows.join(copies, "__row").withColumn("__k", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a null or empty text is its end id, ids may be null or repeat."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), end_id=1)
