"""One thin query for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, collocations, exact_dedup, language_id, ngram_join, packing, repair, repeats, secrets, sharding, toxicity, url_filter
from tidemark.llm.common import read


def _ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents"), _ranks(), keep=["doc_id"])
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids", "offsets")
    plain = bpe.decode(coded, _ranks(), keep=["doc_id", "n_tokens", "ids_sha256"])
    return plain.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).drop("pattern")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(read(spark, sf_dir, "documents")).drop("identity")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(toxicity.fold("doc_id", 3) != 1), read(spark, sf_dir, "labels"))
    rated = toxicity.assess(docs, model, keep=["doc_id"])
    return rated.select(
        "doc_id", (toxicity.fold("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted")
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = language_id.fit(docs.where(toxicity.fold("doc_id", 4) != 2))
    named = language_id.identify(docs, field, keep=["doc_id"], runs=False)
    return named.select("doc_id", (toxicity.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs), keep=["doc_id"])
    lines = found.select("doc_id", F.explode("findings").alias("f"))
    return lines.select("doc_id", F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.score").alias("score"), F.col("f.secret").cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best(collocations.phrases(read(spark, sf_dir, "documents")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.cleaned(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op12_suffix_dedup": op12_suffix_dedup,
    "op11_collocations": op11_collocations,
    "op13_conversation_repair": op13_conversation_repair,
    "op6_packing": op6_packing,
    "op9_secrets": op9_secrets,
    "op8_ngram_join": op8_ngram_join,
    "op7_language_id": op7_language_id,
    "op5_toxicity": op5_toxicity,
    "op2_ann": op2_ann,
    "op1_byte_bpe": op1_byte_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op10_sharding": op10_sharding,
}

def _move(state: str, cost: str, letter: str, line: str | None = None) -> str:
    lines = f"list_append({state}.l, {line})" if line else f"{state}.l"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {lines}}} END"


def _inserted(*states: str) -> str:
    """Columns of the four states with what an insertion makes of them."""
    two = ", ".join(_move(s, "5", "I", "'user:'") for s in (states[0], states[1], states[3]))
    return f"{states[0]} AS s0, {states[1]} AS s1, least({states[2]}, {two}) AS t2, {states[3]} AS t3"


def _repair_sql() -> str:
    """The plain dynamic program over (cost, edits, lines), one row of each conversation at a time."""
    keep = lambda s: _move(s, "pen", "K", "role || ':' || text")
    to_user = lambda s: _move(s, "(1 + pen)", "R", "'user:' || text")
    to_assistant = _move("s2", "(1 + pen)", "R", "'assistant:' || text")
    never = "NULL::STRUCT(c BIGINT, a VARCHAR, l VARCHAR[])"
    start = "{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}"
    user = ", ".join([f"CASE WHEN NOT must THEN {to_user(s)} END" for s in ("s0", "s1", "s3")] + [f"CASE WHEN NOT must AND ini = 'u' THEN {keep(s)} END" for s in ("s0", "s1", "s3")])
    last = _move("t2", "5", "I", "'assistant:'")
    return rf"""
        WITH RECURSIVE b AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS name
            FROM conversations),
        drawn AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(name, lambda ch: ascii(ch)::BIGINT)),
                lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS draw
            FROM b),
        r AS (
            SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   role AS was, unnest(CASE draw WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM drawn WHERE draw <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, was, copy) AS i FROM r),
        m AS (
            SELECT *, role[1] AS ini, trim(text, E' \t\n\v\f\r') AS core, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
                   lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
            FROM o),
        k AS (
            SELECT *, core = '' AS blank, core <> '' AND seen AS duplicate, core <> '' AND NOT seen AND core[-1] NOT IN ('.', '!', '?') AS truncated FROM m),
        rows AS (SELECT conv_id, i, role, text, ini, blank OR duplicate AS must, CASE WHEN truncated THEN 5 ELSE 0 END AS pen FROM k),
        counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
                   sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated, sum(coalesce(pair NOT IN ('su', 'ua', 'au'), false)::INT) AS illegal
            FROM k GROUP BY conv_id),
        walk AS (
            SELECT conv_id, 0::BIGINT AS i, s0, s1, t2 AS s2, least(t3, {last}) AS s3
            FROM (SELECT conv_id, {_inserted("o0", "o0n", "o0n", "o0n")} FROM (SELECT conv_id, {start} AS o0, {never} AS o0n FROM counts))
            UNION ALL
            SELECT conv_id, i, s0, s1, t2, least(t3, {last})
            FROM (SELECT conv_id, i, {_inserted("n0", "n1", "n2", "n3")}
                  FROM (SELECT walk.conv_id, rows.i, {_move("s0", "2", "D")} AS n0,
                               least({_move("s1", "2", "D")}, CASE WHEN NOT must AND ini = 's' THEN {keep("s0")} END) AS n1,
                               least({_move("s2", "2", "D")}, {user}) AS n2,
                               least({_move("s3", "2", "D")}, CASE WHEN NOT must THEN {to_assistant} END, CASE WHEN NOT must AND ini = 'a' THEN {keep("s2")} END) AS n3
                        FROM walk JOIN rows ON rows.conv_id IS NOT DISTINCT FROM walk.conv_id AND rows.i = walk.i + 1))),
        best AS (SELECT counts.*, least(s0, s3) AS b FROM walk JOIN counts ON counts.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.i = counts.n)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
               coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL = {
    "op3_url_filter": r"""
        WITH u AS (
            SELECT page_id, coalesce(url, '') AS url,
                   translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
        v AS (
            SELECT u.*, (SELECT max_by({'rule': rule, 'verdict': verdict}, length(rule)) FROM r
                         WHERE ('.' || host).ends_with('.' || split_part(rule, '/', 1))
                           AND path.starts_with(substr(rule, position('/' IN rule)))) AS best
            FROM u)
        SELECT page_id, host, path, best.rule AS rule,
               coalesce(best.verdict,
                        CASE WHEN regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '\bcheap\b[-.]?\bpills\b|\bcasino\b[-.]|\bspam\b[-.]|\bads\b[-.]\btrack(?:er)?\b|\b(?:xxx|adult)\b[-.]|[-.]\bbets?\b|\bpayday\b[-.]?\bloans?\b')
                        THEN 'block' ELSE 'allow' END) AS verdict
        FROM v""",
    "op4_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n""",
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        s AS (SELECT lang, unnest(w) AS x, unnest(w[2:]) AS y, unnest(w[3:]) AS z FROM w),
        one AS (SELECT lang, x, count(*) AS f FROM s GROUP BY ALL),
        two AS (SELECT lang, x, y, count(*) AS f FROM s WHERE y IS NOT NULL GROUP BY ALL HAVING f >= 10),
        three AS (SELECT lang, x, y, z, count(*) AS f FROM s WHERE z IS NOT NULL GROUP BY ALL HAVING f >= 10),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
        cuts AS (
            SELECT t.lang, concat_ws(' ', t.x, t.y, t.z) AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r
            FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
            UNION ALL
            SELECT t.lang, concat_ws(' ', t.x, t.y, t.z), t.f, 2, p.f, q.f
            FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z
            UNION ALL
            SELECT t.lang, concat_ws(' ', t.x, t.y), t.f, 1, p.f, q.f
            FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
            WHERE NOT EXISTS (SELECT 1 FROM three u WHERE u.lang = t.lang AND u.x = t.x AND u.y = t.y AND 100 * u.f >= 50 * t.f)
              AND NOT EXISTS (SELECT 1 FROM three u WHERE u.lang = t.lang AND u.y = t.x AND u.z = t.y AND 100 * u.f >= 50 * t.f)),
        scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM lowest JOIN n USING (lang)
        QUALIFY rank <= 2000""",
    "op12_suffix_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        p AS (SELECT k, unnest(list_transform(range(1, n - 398), lambda i: md5_number(t[i:i + 399]))) AS h, generate_subscripts(range(1, n - 398), 1) AS i FROM d WHERE n >= 400),
        h AS (SELECT k, i, count(*) OVER (PARTITION BY h) AS c FROM p),
        marked AS (SELECT k, i, coalesce(i > lag(i) OVER (PARTITION BY k ORDER BY i) + 400, true) AS fresh FROM h WHERE c > 1),
        numbered AS (SELECT k, i, sum(fresh::INT) OVER (PARTITION BY k ORDER BY i) AS run FROM marked),
        spans AS (SELECT k, min(i) AS s, max(i) + 400 AS e FROM numbered GROUP BY k, run),
        bounds AS (SELECT k, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e, sum(e - s) AS gone FROM spans GROUP BY k)
        SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(s), 0) AS n_spans,
               sha256(CASE WHEN s IS NULL THEN t
                      ELSE unhex(array_to_string(list_transform(range(1, len(s) + 2), lambda j: hex(t[coalesce(e[j - 1], 1):coalesce(s[j], n + 1) - 1])), '')) END) AS kept_sha256
        FROM d LEFT JOIN bounds USING (k)""",
    "op13_conversation_repair": _repair_sql(),
}
