"""The queries of the training-data operators: one per operator, over whole tables; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_blocks, lang_id, line_dedup, lm_scoring, merkle, minhash, mixing, resampling, sharding, topk_search, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decide(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.score(docs, docs.where(lang_id.remainder(10) != 0))
    return scored.select("doc_id", (lang_id.remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = url_filter.bad_documents(table(spark, sf_dir, "labels"))
    return url_filter.judge(table(spark, sf_dir, "pages"), bad).select("page_id", "host", "path", "rule", "verdict")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.code(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(lang_id.remainder(3) != 1))
    judged = lang_id.predict(docs, model)
    return judged.select("doc_id", (lang_id.remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), percent=85)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=lang_id.remainder(3) == 0)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_sharding": op4_sharding,
    "op5_url_filter": op5_url_filter,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_topk_search": op7_topk_search,
    "op8_bpe": op8_bpe,
    "op9_language_id": op9_language_id,
    "op10_minhash": op10_minhash,
    "op11_resampling": op11_resampling,
    "op12_merkle": op12_merkle,
    "op13_html_extraction": op13_html_extraction,
}

#: The table of CRC-32, made from its polynomial.
CRC = """
        t8 AS (
          SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) r(i)))"""


def _crc(hex_: str) -> str:
    """CRC-32 of bytes written in hex."""
    numbers = f"list_transform(range(0, length({hex_}) // 2), lambda k: ('0x' || substr({hex_}, (2 * k + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])))"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    fields = [(c, c) for c in ("doc_id", "source", "lang", "n_chars")] + [("text", text)]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({v}::VARCHAR)) || ':' || {v} END" for c, v in fields) + ")"


SQL = {
    "op7_topk_search": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
          WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op6_exact_dedup": """
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS digest
          FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size,
               row_number() OVER w = 1 AS kept, digest AS text_sha256
        FROM d WINDOW w AS (PARTITION BY digest ORDER BY n DESC, doc_id)
    """,
    "op11_resampling": f"""
        WITH {CRC.strip()},
        d AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents),
        b AS (SELECT 'b' AS side, row_number() OVER () AS row, NULL AS doc_id, text FROM benchmark),
        w AS (
          SELECT side, row, doc_id, regexp_extract_all(coalesce({_LOWERED}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
          FROM (SELECT * FROM d UNION ALL SELECT * FROM b)),
        g AS (
          SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS gram FROM w),
        h AS (SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM g)),
        k AS (SELECT gram, {_crc('x')} % 10000 AS bucket FROM h, t8),
        f AS (SELECT side, row, bucket FROM g JOIN k USING (gram)),
        n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
        a AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM n),
        gain AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain FROM n, a),
        weight AS (SELECT row, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row),
        s AS (
          SELECT w.doc_id, len(w.w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
          FROM w LEFT JOIN weight USING (row) WHERE side = 'd'),
        r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM s)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM r
    """,
    "op12_merkle": f"""
        WITH RECURSIVE {CRC.strip()},
        d AS (SELECT *, hex(encode(doc_id::VARCHAR)) AS x FROM documents),
        e AS (
          SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf('text')} AS leaf,
                 CASE WHEN {_crc('x')} % 3 = 0 THEN {_leaf(_LOWERED)} ELSE {_leaf('text')} END AS checked
          FROM d, t8),
        l AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS i FROM e),
        nodes AS (
          SELECT tree, 0 AS level, i, leaf AS digest FROM l
          UNION ALL
          SELECT tree, level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i))
          FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, i // 8),
        subroot AS (SELECT tree, arg_max(digest, level) AS digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM nodes GROUP BY tree),
        tops AS (
          SELECT 0 AS level, i, digest FROM subroot
          UNION ALL
          SELECT level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i))
          FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, i // 8),
        root AS (SELECT arg_max(digest, level) AS root FROM tops),
        way AS (
          SELECT row, 0 AS part, n.level, n.i, n.digest, l.i // (8 ** n.level)::BIGINT = n.i AS own
          FROM l JOIN nodes n ON n.tree = l.tree AND n.i // 8 = l.i // (8 ** (n.level + 1))::BIGINT
          WHERE n.level < (SELECT max(level) FROM nodes m WHERE m.tree = l.tree)
          UNION ALL
          SELECT row, 1, t.level, t.i, t.digest, s.i // (8 ** t.level)::BIGINT = t.i
          FROM l JOIN subroot s USING (tree) JOIN tops t ON t.i // 8 = s.i // (8 ** (t.level + 1))::BIGINT
          WHERE t.level < (SELECT max(level) FROM tops)),
        proof AS (SELECT row, sha256(string_agg(digest, '' ORDER BY part, level, i)) AS proof FROM way WHERE NOT own GROUP BY row),
        step AS (SELECT row, row_number() OVER (PARTITION BY row ORDER BY part, level) AS step, coalesce(string_agg(digest, '' ORDER BY i) FILTER (i < mine), '') AS before, coalesce(string_agg(digest, '' ORDER BY i) FILTER (i > mine), '') AS after
                 FROM (SELECT *, max(i) FILTER (own) OVER (PARTITION BY row, part, level) AS mine FROM way) GROUP BY row, part, level),
        fold AS (
          SELECT row, 0 AS step, checked AS digest FROM l
          UNION ALL
          SELECT f.row, f.step + 1, sha256(s.before || f.digest || s.after) FROM fold f JOIN step s ON s.row = f.row AND s.step = f.step + 1)
        SELECT doc_id, leaf, s.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
        FROM l JOIN subroot s USING (tree) JOIN (SELECT row, arg_max(digest, step) AS digest FROM fold GROUP BY row) f USING (row) LEFT JOIN proof USING (row), root
    """,
}
