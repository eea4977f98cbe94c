"""The queries of this subpackage: each operator over its whole table, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, cube_mix, exact_dedup, langid, line_dedup, ngram_join, packing, quality_gam, rule_ledger, warc
from ._spark import crc_fold

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HELD_OUT = 2


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_gam.train(docs, _read(spark, sf_dir, "labels"))
    out = quality_gam.score(docs, model)
    return out.select("doc_id", (crc_fold() == HELD_OUT).alias("held_out"), "score", "predicted")


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rule_ledger.measure(_read(spark, sf_dir, "documents"))
    ledger = rule_ledger.apply_policy(rule_ledger.apply_policy(ledger, 1, "base_kept"), 2, "kept")
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failures")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"), largest=True)


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(_read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"), "complete")


def op5_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(crc_fold() != HELD_OUT))
    return langid.identify(docs, model).select("doc_id", (crc_fold() == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op6_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.cube_mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_chat_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"select * from values (-7L, 0, 'user', '{said}'), (-7L, 1, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    out = chat.format_chats(chat.as_log(turns.unionByName(own)))
    back = out.select("conv", "formatted_chars", chat.read_turns().alias("turns"), chat.read_loss().alias("loss"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    joined = back.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.array_join(line, "").alias("all"), F.array_join("loss", "").alias("loss"), "formatted_chars"
    )
    return joined.select(
        "conv_id", "n_turns",
        F.sha2(F.col("all").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"), words_a_shingle=3, num=90, den=100)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.best_fit_pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_quality_gam, op2_rule_ledger, op3_exact_dedup, op4_warc_segments, op5_language_bitmask, op6_line_bitmaps, op7_cube_mix, op8_chat_fold, op9_ngram_jaccard, op10_best_fit_packing, pipeline)
    return {f.__name__: f for f in ops}


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _escaped_length(column: str) -> str:
    out = f"replace({column}, '~', '~0')"
    for i, c in enumerate(chat.CONTROL, 1):
        out = f"replace({out}, '{c}', '~{i}')"
    return f"length({out})"


def _policy_sql(version: int) -> str:
    """SQL for "rejected" of a policy, over a column failures."""
    p = rule_ledger.POLICIES[version]
    return f"((failures & {p.mask}) <> 0 OR bit_count(failures & {p.counted_mask}) >= {p.most})"


_FAILURES = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(rule_ledger.RULES))


def oracle_sql() -> dict[str, str]:
    return {
        "op2_rule_ledger": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM w WHERE len(ws) >= 8),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM hit) GROUP BY 1),
ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) AS n_upper, (length(t) - length(regexp_replace(t, '[A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g'))) AS n_alpha,
  (length(t) - length(replace(t, '|', ''))) AS n_bars, (length(t) - length(replace(t, '!', ''))) AS n_bangs, coalesce(ln.n, 0) AS n_lines,
  len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_same_next
  FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, ({_FAILURES})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_policy_sql(1)} AS base_failed, NOT {_policy_sql(2)} AS kept, failures FROM f""",
        "op3_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWER} AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256 FROM t""",
        "op4_warc_segments": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < keep THEN keep END AS refers_to, true AS complete FROM k""",
        "op6_line_bitmaps": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_STRIP}), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT k.doc_id, pos, line, first IS NOT NULL AND first <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id""",
        "op8_chat_fold": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.BEGIN + chat.BODY + chat.END)} + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
        "op9_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    }
