"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.llm._common import table


def op1_topk(spark, sf_dir):
    from quarry.llm.topk import top_k

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows, k=20).drop("query_key")


def tokenizer(name="byte_bpe_multi_50k.tiktoken"):
    """(ranks, pattern) of an installed vocabulary."""
    import public_tokenizers

    from quarry.llm.bpe import load_ranks

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op2_bpe(spark, sf_dir):
    from quarry.llm.bpe import encode

    ranks, pattern = tokenizer()
    out = encode(table(spark, sf_dir, "documents"), ranks, pattern, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_jaccard_join(spark, sf_dir):
    from quarry.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=5, percent=75)


def op4_substrings(spark, sf_dir):
    from quarry.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), window=20).drop("kept")


#: Target weights of the sources; every other source has weight 1.
MIX_WEIGHTS = {"src0": 3, "src1": 2}


def op5_mixing(spark, sf_dir):
    from quarry.llm.mixing import mixed_ids

    return mixed_ids(table(spark, sf_dir, "documents"), MIX_WEIGHTS, default_weight=1, block_rows=64)


def held_out():
    """Rows that no model learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def quality_machine(spark, sf_dir):
    """The quality classifier, fitted on the labelled rows that aren't held out."""
    from quarry.llm.quality import train

    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()), max_train=6000)


def op6_quality(spark, sf_dir):
    from quarry.llm.quality import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, quality_machine(spark, sf_dir), threshold=0.7)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_lattice(spark, sf_dir):
    from quarry.llm.lattice import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), floor=0.98)


def op8_html(spark, sf_dir):
    from quarry.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_sharding(spark, sf_dir):
    from quarry.llm.shards import shard

    return shard(table(spark, sf_dir, "documents"), shards=40)


#: The secret of the surrogates. A deployment passes its own.
PII_KEY = b"quarry surrogate key 1"


def op10_pii(spark, sf_dir):
    from quarry.llm.pii import replace

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = replace(docs, PII_KEY)
    return out.select("doc_id", "text", "n_entities", F.array_join("entity_kinds", ",").alias("entity_kinds"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_bpe, op3_jaccard_join, op4_substrings, op5_mixing, op6_quality, op7_lattice, op8_html, op9_sharding, op10_pii)}

ORACLES = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op5_mixing": """
        WITH RECURSIVE src AS (
            SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) AS n,
                CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END AS w
            FROM documents GROUP BY source
        ), cfg AS (
            SELECT sum(w)::BIGINT AS q, list(w ORDER BY i) AS ws, list(n ORDER BY i) AS ns FROM src
        ), cyc AS (
            SELECT 0::BIGINT AS slot, list_transform(ws, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS pick, list_transform(ws, lambda x: 0::BIGINT) AS had FROM cfg
            UNION ALL
            SELECT slot + 1, list_transform(done, lambda d, i: d + CASE WHEN i - 1 = p THEN 1 ELSE 0 END), p, done
            FROM (
                SELECT slot, done, q, list_min(list_transform(ws, lambda w, i: CASE
                    WHEN done[i] < w AND (done[i] * q) // w <= slot
                    THEN (((done[i] + 1) * q + w - 1) // w) * 2000 + i - 1 ELSE 4611686018427387904 END)) % 2000 AS p
                FROM cyc, cfg WHERE slot < q
            )
        ), turns AS (
            SELECT pick AS i, had, had[pick + 1] AS turn FROM cyc WHERE pick IS NOT NULL
        ), num AS (
            SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS n FROM documents
        ), b AS (
            SELECT num.doc_id, num.source, num.n, num.n // 64 AS block, (num.n // 64) // w AS c, src.i, (num.n // 64) % w AS turn
            FROM num JOIN src ON num.source IS NOT DISTINCT FROM src.source
        )
        SELECT doc_id, source, block::BIGINT AS block,
            list_sum(list_transform(had, lambda h, k: least(h + c * ws[k], (ns[k] + 63) // 64)))::BIGINT AS slot,
            (list_sum(list_transform(had, lambda h, k: least((h + c * ws[k]) * 64, ns[k]))) + n % 64)::BIGINT AS position
        FROM b JOIN turns USING (i, turn), cfg
    """,
    "op3_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
        ), e AS (
            SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), l AS (
            SELECT x, y FROM p WHERE 100 * shared >= 75 * (n - shared)
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x
        )
        SELECT doc_id, CAST(any_value(len(sh)) AS BIGINT) AS n_shingles, min(y) AS component_id FROM s JOIN reach ON x = doc_id GROUP BY doc_id
    """,
    "op4_substrings": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), p AS (
            SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM w
        ), q AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS turn FROM p
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM q WHERE turn > 1
        ), word AS (
            SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op7_lattice": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), good AS (
            SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
        ), l AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x
        ), n AS (
            SELECT x, count(*) AS n FROM l GROUP BY x
        ), c AS (
            SELECT x, min(y) AS c FROM reach GROUP BY x
        )
        SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, c.c = vec_id AS kept FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
    """,
    "op9_sharding": r"""
        WITH tab AS (
            SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
        ), r AS (
            SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size, md5(coalesce(text, '')) AS t, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS i FROM documents
        ), crc AS (
            SELECT doc_id, t, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM r, tab
        ), total AS (
            SELECT CAST(sum(size) AS BIGINT) AS total FROM r
        ), k AS (
            SELECT r.*, CASE WHEN sum(size) OVER (PARTITION BY t) <= 0.1 * total / 40 THEN t ELSE t || i END AS unit FROM r, total
        ), u AS (
            SELECT unit, CAST(sum(sum(size)) OVER (ORDER BY unit) AS BIGINT) AS b, CAST(sum(size) AS BIGINT) AS n FROM k GROUP BY unit
        ), cut AS (
            SELECT s, target, arg_min(unit, b) AS unit, min(b) AS b, arg_min(n, b) AS n FROM (SELECT s, (s * total + 39) // 40 AS target FROM total, range(1, 40) t(s)) JOIN u ON u.b >= target GROUP BY s, target
        ), placed AS (
            SELECT k.*, (SELECT count(*) FROM cut WHERE cut.unit < k.unit OR cut.unit = k.unit AND cut.b - target >= target - (cut.b - cut.n)) AS shard FROM k
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
            CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(t || i), doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM placed JOIN crc USING (doc_id, t)
    """,
}
