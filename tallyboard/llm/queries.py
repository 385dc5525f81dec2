"""The registered queries of the corpus operators and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm import (
    balance,
    common,
    conversation_repair,
    decontaminate,
    line_runs,
    phrases,
    secrets,
    sharding,
    simhash,
    substring_dedup,
    token_blocks,
    token_counts,
    topk,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents, through a fresh blob ledger."""
    docs = common.table(spark, sf_dir, "documents")
    ledger = secrets.BlobLedger(spark, common.shared_path(spark, "ledger"))
    versions = ledger.scan(docs.select(F.col("doc_id").alias("path"), "text"))
    paths = versions.select(F.col("path").cast("long").alias("doc_id"), "blob")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    texts = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    found = ledger.findings().select(
        "blob", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.array_join(texts, ",").alias("spans"),
    )
    zero = F.lit(0).cast("long")
    spans = F.coalesce("spans", F.lit(""))
    return paths.join(found, "blob", "left").select(
        "doc_id", *[F.coalesce(n, zero).alias(n) for n in ("n_assign", "n_access", "n_hex")],
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of benchmark items in all documents by greedy string tiling."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, common.table(spark, sf_dir, "benchmark"))
    share = F.coalesce(F.col("coverage"), F.lit(0.0))
    return decontaminate.with_coverage(docs, found).select(
        "doc_id", "item_id", F.coalesce("covered", F.lit(0)).alias("covered"), "item_words",
        F.coalesce("longest", F.lit(0)).alias("longest"), share.alias("coverage"),
        (share >= decontaminate.COVERAGE).cast("int").alias("contaminated"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled rows that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    held_out = toxicity.held_out(F.col("doc_id"))
    labels = common.table(spark, sf_dir, "labels").where(~held_out).select(
        "doc_id", F.col("toxic").alias("label")
    )
    weights = toxicity.train(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(docs, weights, [F.col("doc_id"), held_out.alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by SimHash within two bits."""
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of all documents that each match the mixture of sources."""
    docs = common.table(spark, sf_dir, "documents")
    text = common.text_of(docs)
    rows = docs.select(
        "doc_id", "source",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.interleaved_shards(
        rows, "doc_id", "source", ["size", "text_crc32"], shards=8
    ).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words of 20-word windows that also start earlier."""
    docs = common.table(spark, sf_dir, "documents")
    return substring_dedup.remove_repeated_windows(docs).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, read back from block files in doc_id order."""
    return token_blocks.packed_documents(common.table(spark, sf_dir, "documents"))


def op8_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents so that sources reach their targets of words."""
    docs = common.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", balance.word_count(docs["text"]).alias("size"))
    mixed = balance.balanced_copies(rows, "doc_id")
    return mixed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies",
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best neighbours of every hundredth vector among all vectors."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of repeated runs of lines."""
    docs = common.table(spark, sf_dir, "documents")
    return line_runs.remove_repeated_runs(docs).select(
        "doc_id", "n_lines", "n_removed", "longest",
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents, and whether they go beyond the limit."""
    docs = common.table(spark, sf_dir, "documents")
    size = F.octet_length(common.text_of(docs)).cast("long").alias("n_bytes")
    counted = token_counts.count_tokens(docs, [F.col("doc_id"), size])
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scoring phrases of every language over all documents."""
    return phrases.collocations(common.table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage: what is wrong with them and their cheapest repair."""
    rows = common.table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(rows), rows)


QUERIES: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_blocks": op7_token_blocks,
    "op8_balance": op8_balance,
    "op9_topk": op9_topk,
    "op10_line_runs": op10_line_runs,
    "op11_token_counts": op11_token_counts,
    "op12_phrases": op12_phrases,
    "op13_conversations": op13_conversations,
}

CRC_TABLE = """
WITH RECURSIVE step(n, c, k) AS (
    SELECT range AS n, range AS c, 0 AS k FROM range(256)
    UNION ALL
    SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1
    FROM step WHERE k < 8
),
crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8)"""



def span_sql(kind: str, order: int, pattern: str, keep: str) -> str:
    """Spans of one kind: pieces between matches and matches, alternating."""
    pattern, keep = pattern.replace("'", "''"), keep.replace("'", "''")
    return f"""
    SELECT doc_id, '{kind}' AS kind, {order} AS kind_order, e - length(m) AS s, e
    FROM (
        SELECT doc_id, ms[i] AS m,
               list_sum(list_transform(gaps[1:i], lambda g: length(g)))
               + list_sum(list_transform(ms[1:i], lambda g: length(g))) AS e
        FROM (
            SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i
            FROM (
                SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms,
                       regexp_split_to_array(text, '{pattern}') AS gaps
                FROM documents WHERE regexp_matches(text, '{pattern}')
            )
        )
    )
    WHERE regexp_full_match(m, '{keep}')"""


ORACLE: dict[str, str] = {
    "op1_secrets": "WITH found AS (" + " UNION ALL ".join(
        span_sql(rule.kind, order, rule.pattern, rule.keep or rule.pattern)
        for order, rule in enumerate(secrets.BASE_RULES)
    ) + """
), per AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
           count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ','
                      ORDER BY s, kind_order) AS spans
    FROM found GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)""",
    "op5_sharding": CRC_TABLE + """,
raw AS (
    SELECT doc_id, source, coalesce(text, '') AS body FROM documents
),
bytes AS (
    SELECT doc_id, source, strlen(body) + 1 AS size, t,
           list_transform(range(strlen(body)),
               lambda i: ('0x' || substr(hex(body), CAST(2 * i + 1 AS INT), 2))::BIGINT) AS b
    FROM raw, crc
),
rows AS (
    SELECT doc_id, source, CAST(size AS BIGINT) AS size,
           xor(4294967295, list_reduce(list_prepend(4294967295, b),
               lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INT)]))) AS text_crc32,
           ('0x' || substr(md5('interleave-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')),
                           1, 15))::BIGINT AS h
    FROM bytes
),
inside AS (
    SELECT *, (row_number() OVER (PARTITION BY source
                   ORDER BY h, doc_id NULLS LAST, size, text_crc32) - 0.5::DOUBLE)
              / count(*) OVER (PARTITION BY source) AS fraction
    FROM rows
),
whole AS (
    SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, h, doc_id NULLS LAST,
                                 size, text_crc32) - 1 AS place,
           count(*) OVER () AS n
    FROM inside
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((place * 8) // n AS INT) AS shard,
       place - ((place * 8) // n * n + 7) // 8 AS slot, CAST(NULL AS INT) AS grown_shard
FROM whole""",
    "op9_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_line_runs": """
WITH docs AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents
),
lines AS (
    SELECT doc_id, unnest(range(1, len(xs) + 1)) AS place, unnest(xs) AS line FROM docs
),
pairs AS (
    SELECT a.doc_id, a.place, a.line, b.doc_id AS other, a.place - b.place AS shift
    FROM lines a JOIN lines b ON a.line = b.line
    WHERE b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.place < a.place)
),
runs AS (
    SELECT doc_id, min(place) AS first, max(place) AS last FROM (
        SELECT *, place - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY place) AS island FROM pairs
    ) GROUP BY doc_id, other, shift, island
    HAVING count(*) >= 3 OR bool_or(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 8)
),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS place FROM (SELECT DISTINCT doc_id, first, last FROM runs)
),
longest AS (
    SELECT doc_id, max(last - first + 1) AS longest FROM runs GROUP BY doc_id
)
SELECT doc_id, count(*) AS n_lines, count(gone.place) AS n_removed,
       CAST(coalesce(any_value(longest), 0) AS INT) AS longest,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY lines.place) FILTER (gone.place IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN gone USING (doc_id, place) LEFT JOIN longest USING (doc_id)
GROUP BY doc_id""",
    "op12_phrases": """
WITH parts AS (
    SELECT lang, regexp_extract_all(part, '[^ \\t]+') AS ws
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\\x0A-\\x0D]')) AS part
        FROM documents
    )
),
totals AS (
    SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM parts GROUP BY lang
),
grams AS (
    SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2),
                                              lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
        FROM parts, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k
    ) GROUP BY lang, k, phrase HAVING count(*) >= 10
),
cuts AS (
    SELECT lang, k, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head,
           array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS tail
    FROM grams, (SELECT unnest([1, 2]) AS c) WHERE c < k
),
scores AS (
    SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, c, g.f AS l, h.f AS r,
           (1000000::HUGEINT * cuts.a * cuts.a) // (g.f::HUGEINT * h.f) AS score
    FROM cuts JOIN grams g ON g.lang = cuts.lang AND g.phrase = head
              JOIN grams h ON h.lang = cuts.lang AND h.phrase = tail
),
worst AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
),
inside AS (
    SELECT lang, part, max(f) AS longer FROM (
        SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
                                array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part
        FROM grams WHERE k = 3
    ) GROUP BY lang, part
),
kept AS (
    SELECT worst.* FROM worst LEFT JOIN inside ON inside.lang = worst.lang AND part = phrase
    WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
