"""The registered queries of this subpackage: thin functions (spark, sf_dir) -> DataFrame with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.quality import quality_rows

    return quality_rows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.simple8b import round_trip

    return round_trip(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op4_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.forced_bpe import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.cross_entropy import score_documents

    labels = table(spark, sf_dir, "labels")
    return score_documents(table(spark, sf_dir, "documents"), labels.where(labels["quality"] == 1), exact=True)


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corpusloom.llm.toxicity import held_out, learn, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corpusloom.llm.language_mixture import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op9_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.pivot_index import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op10_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.secrets import digest_documents

    return digest_documents(table(spark, sf_dir, "documents")).select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.repair import damage, summarize

    return summarize(damage(table(spark, sf_dir, "conversations")))


def op12_relational_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corpusloom.llm.infill import infill, restore

    digest = lambda c: F.sha2(c, 256)
    out = infill(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: Both turns of the conversation that op13 adds.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op13_token_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.chat import format_turns, read_back

    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    path = vocabulary("byte_bpe_50k.json")
    return read_back(format_turns(rows, path), path)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_robust_outliers, op2_simple8b, op3_vector_packing, op4_forced_bpe, op5_cross_entropy, op6_toxicity_grammar, op7_superminhash, op8_language_mixture, op9_pivot_index, op10_secret_worklist, op11_viterbi_repair, op12_relational_infill, op13_token_chat)}


OP9_SQL = """WITH q AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


#: crc32 bit by bit; the damage; faults; then the same four states, a row at a time. 1000000000 stands for unreachable.
OP11_SQL = r"""WITH RECURSIVE shown AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS code FROM conversations),
  coded AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(code, '')])),
    lambda a, e: CASE WHEN xor(a, e) % 2 = 1 THEN xor(xor(a, e) >> 1, 3988292384) ELSE xor(a, e) >> 1 END), 4294967295) % 20 AS k FROM shown),
  damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded WHERE k <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged),
  told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, role[1] AS ini, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS was FROM placed),
  g AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND again AS dup, trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS cut, was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au') AS bad FROM told),
  steps AS (SELECT conv_id, n, role, text, ini, blank OR dup AS dead, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM g),
  walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, {'c': 0, 'a': '', 'r': ''} AS b, {'c': 1000000000, 'a': '', 'r': ''} AS s, {'c': 5, 'a': 'I', 'r': 'user:'} AS u, {'c': 10, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'} AS t FROM (SELECT DISTINCT conv_id FROM shown)
    UNION ALL
    SELECT conv_id, n, b2, s2, u3, list_min([t2, {'c': u3.c + 5, 'a': u3.a || 'I', 'r': u3.r || chr(10) || 'assistant:'}]) FROM (
      SELECT conv_id, n, b2, s2, t2, list_min([u2, {'c': b2.c + 5, 'a': b2.a || 'I', 'r': 'user:'}, {'c': s2.c + 5, 'a': s2.a || 'I', 'r': s2.r || chr(10) || 'user:'}, {'c': t2.c + 5, 'a': t2.a || 'I', 'r': t2.r || chr(10) || 'user:'}]) AS u3 FROM (
        SELECT w.conv_id, p.n, {'c': b.c + 2, 'a': b.a || 'D', 'r': b.r} AS b2,
          list_min([{'c': s.c + 2, 'a': s.a || 'D', 'r': s.r}, {'c': CASE WHEN dead OR ini <> 's' THEN 1000000000 ELSE b.c + more END, 'a': b.a || 'K', 'r': role || ':' || text}]) AS s2,
          list_min([{'c': u.c + 2, 'a': u.a || 'D', 'r': u.r}, {'c': b.c + tou, 'a': b.a || nu, 'r': ru}, {'c': s.c + tou, 'a': s.a || nu, 'r': s.r || chr(10) || ru}, {'c': t.c + tou, 'a': t.a || nu, 'r': t.r || chr(10) || ru}]) AS u2,
          list_min([{'c': t.c + 2, 'a': t.a || 'D', 'r': t.r}, {'c': u.c + tot, 'a': u.a || nt, 'r': u.r || chr(10) || rt}]) AS t2
        FROM walk w JOIN (SELECT *, CASE WHEN dead THEN 1000000000 WHEN ini = 'u' THEN more ELSE 1 + more END AS tou, CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END AS nu, CASE WHEN ini = 'u' THEN role ELSE 'user' END || ':' || text AS ru,
          CASE WHEN dead THEN 1000000000 WHEN ini = 'a' THEN more ELSE 1 + more END AS tot, CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END AS nt, CASE WHEN ini = 'a' THEN role ELSE 'assistant' END || ':' || text AS rt FROM steps) p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.n = w.n + 1))),
  ended AS (SELECT conv_id, list_min([b, t]) AS e FROM (SELECT *, max(n) OVER (PARTITION BY conv_id) AS last FROM walk) WHERE n = last),
  counted AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (bad) AS illegal FROM g GROUP BY conv_id)
  SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(e.c AS BIGINT) AS cost, e.a AS audit, sha256(e.r) AS repaired_sha256
  FROM ended LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ended.conv_id"""

OP12_SQL = r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
  b AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM a),
  c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, [CAST('0x' || substr(d, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM b),
  e AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
  f AS (SELECT *, array_to_string(units[1:lo], '') AS p, array_to_string(units[lo + 1:hi], '') AS m, array_to_string(units[hi + 1:], '') AS s FROM e)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""

OP13_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
  e AS (SELECT *, length(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), '<|endoftext|>', '\x'), ':', '\c')) + length(replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e'), '<|endoftext|>', '\x')) + 14 AS shown FROM c)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(shown) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express on whole tables; the other operators are tested against brute force, round trips or held-out rows."""
    return {"op9_pivot_index": OP9_SQL, "op11_viterbi_repair": OP11_SQL, "op12_relational_infill": OP12_SQL, "op13_token_chat": OP13_SQL}
