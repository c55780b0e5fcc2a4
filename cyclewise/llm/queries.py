"""The registered queries on whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise import config, shared
from cyclewise.llm import bpe_codec, conversations, decontaminate, merkle, near_dup, quality, rank_bpe, secret_scan, sharding, token_count, token_files, topk, url_filter

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _queries[name] = lambda spark, sf_dir: fn(config.prepare(spark), sf_dir)
        if sql is not None:
            _sql[name] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_bpe_codec")
def bpe_round_trip(spark, sf_dir):
    return bpe_codec.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "doc_id")


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@_query(
    "op2_url_filter",
    """
WITH rules(rule_host, rule_path, action) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), rest AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), fits AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(action, length(rule_host || rule_path)) AS action
    FROM parts, rules
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
""",
)
def url_verdicts(spark, sf_dir):
    index = url_filter.build_index(spark.createDataFrame(URL_RULES, "host string, path string, action string"))
    return url_filter.judge(_table(spark, sf_dir, "pages"), index, "page_id")


@_query("op3_token_files")
def token_files_read_back(spark, sf_dir):
    path = shared.scratch(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_back(spark, path)


_SECRET_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
rules(pos, kind, pattern, part, least) AS (VALUES
    (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
    (2, 'hex', '[0-9a-f]+', 0, 24),
    (3, 'github', 'gh[oprsu]_[A-Za-z0-9]+', 0, 40),
    (4, 'slack', 'xox[abprs]-[A-Za-z0-9-]+', 0, 15),
    (5, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1),
    (6, 'jwt', 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', 0, 40)
), cut AS (
    SELECT n, pos, kind, least, unnest(generate_series(1, len(found))) AS i, found, parts, gaps
    FROM (
        SELECT n, pos, kind, least,
               CASE pos {found} END AS found,
               CASE pos {parts} END AS parts,
               CASE pos {gaps} END AS gaps
        FROM texts, rules
    )
), spans AS (
    SELECT n, pos, kind,
           CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS BIGINT) AS start,
           length(found[i]) AS size
    FROM cut WHERE length(parts[i]) >= least
), told AS (
    SELECT n,
           count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           coalesce(string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, pos) FILTER (pos < 3), '') AS base,
           string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, pos) AS spans
    FROM spans GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (n)
"""


def _secret_sql() -> str:
    """DuckDB wants each pattern as a constant."""
    rows = re.findall(r"\((\d), '\w+', '(.*)', (\d), \d+\)", _SECRET_SQL)
    case = lambda make: " ".join(f"WHEN {n} THEN {make(p, g)}" for n, p, g in rows)
    return (
        _SECRET_SQL.replace("{found}", case(lambda p, g: f"regexp_extract_all(text, '{p}', 0)"))
        .replace("{parts}", case(lambda p, g: f"regexp_extract_all(text, '{p}', {g})"))
        .replace("{gaps}", case(lambda p, g: f"string_split_regex(text, '{p}')"))
    )


@_query("op4_secret_scan", _secret_sql())
def secrets(spark, sf_dir):
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in secret_scan.BASE_RULES)))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(number(r.kind) for r in secret_scan.BASE_RULES),
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


@_query("op5_decontamination")
def leaked_items(spark, sf_dir):
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id")


@_query(
    "op7_minhash",
    r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS words
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
    FROM texts
), spread AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM spread a JOIN spread b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
    SELECT doc_id, doc_id AS other FROM sets
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), components AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN components USING (doc_id)
""",
)
def near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key")


@_query("op8_token_count")
def token_counts(spark, sf_dir):
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "doc_id")


@_query("op6_sharding")
def shards_of_equal_bytes(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


@_query(
    "op9_topk",
    """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id != c.vec_id
    WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
""",
)
def nearest(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query("op10_quality")
def quality_scores(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    trees = quality.fit_on(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, trees, "doc_id")
    good = (F.col("score") >= quality.KEEP_FROM).cast("int")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", good.alias("predicted"))


# CRC-32, bit by bit, of a string of ASCII characters.
_CRC32 = """
xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(8 * strlen({0})), lambda i: (ascii({0}[i // 8 + 1]) >> (i % 8)::INTEGER)::BIGINT & 1)),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))
"""
_written = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


@_query(
    "op11_merkle",
    f"""
WITH RECURSIVE digests AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree,
           sha256({' || '.join(map(_written, merkle.FIELDS))}) AS leaf,
           CASE WHEN {_CRC32.format('(doc_id::VARCHAR)')} % 2 = 0
                THEN sha256({' || '.join(_written(x if x != 'text' else "replace(text, chr(10), '')") for x in merkle.FIELDS)}) END AS cut
    FROM documents
), leaves AS (
    SELECT row_number() OVER () AS n, doc_id, tree, leaf, coalesce(cut, leaf) AS cut,
           row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size
    FROM digests
), nodes AS (
    SELECT tree, 0 AS level, place, size, leaf AS digest FROM leaves
    UNION ALL
    SELECT tree, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
    FROM nodes WHERE size > 1 GROUP BY tree, level, size, place // 3
), subroots AS (
    SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS size
    FROM nodes WHERE size = 1
), tops AS (
    SELECT 0 AS level, place, size, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
    FROM tops WHERE size > 1 GROUP BY level, size, place // 3
), climbs AS (
    SELECT l.n, 0 AS part, s.level, s.place, s.digest, l.place // CAST(power(3, s.level) AS BIGINT) AS own
    FROM leaves l JOIN nodes s ON s.tree = l.tree AND s.size > 1
         AND s.place // 3 = l.place // CAST(power(3, s.level + 1) AS BIGINT)
    UNION ALL
    SELECT l.n, 1, s.level, s.place, s.digest, t.place // CAST(power(3, s.level) AS BIGINT)
    FROM leaves l JOIN subroots t USING (tree) JOIN tops s ON s.size > 1
         AND s.place // 3 = t.place // CAST(power(3, s.level + 1) AS BIGINT)
), steps AS (
    SELECT n, part, level, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS before,
           coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS after
    FROM climbs GROUP BY n, part, level
), paths AS (
    SELECT n, string_agg(before || after, '' ORDER BY part, level) AS siblings,
           list({{'before': before, 'after': after}} ORDER BY part, level) AS path
    FROM steps GROUP BY n
), checked AS (
    SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE size = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
           list_reduce(list_prepend({{'before': cut, 'after': ''}}, coalesce(path, [])),
                       lambda a, s: {{'before': sha256(s.before || a.before || s.after), 'after': ''}}).before AS folded_root
    FROM leaves JOIN subroots USING (tree) LEFT JOIN paths USING (n)
)
SELECT *, folded_root = root AS verified FROM checked
""",
)
def merkle_proofs(spark, sf_dir):
    return merkle.verify(_table(spark, sf_dir, "documents"), merkle.without_line_feeds())


_STATES = ("start", "system", "user", "assistant")


def _repair_sql() -> str:
    """Row by row, with the cheapest (cost, edits, repaired text) that end in each of four states."""
    add = lambda state, cost, edit, line: (
        f"CASE WHEN {state}.c < 1000000000 THEN {{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}', 't': {state}.t || {line}}} END"
    )
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"
    never = "{'c': 1000000000::BIGINT, 'e': '', 't': ''}"
    kept, cut = "chr(10) || role || ':' || text", "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    here = "fault NOT IN ('blank', 'duplicate')"

    def onward(state, sources, name, keeps):
        ways = [add(state, 2, "D", "''"), never]
        for s in sources:
            ways.append(f"CASE WHEN {here} AND initial = '{keeps}' THEN {add(s, cut, 'K', kept)} END")
            if name:
                ways.append(f"CASE WHEN {here} THEN {add(s, f'1 + {cut}', 'R', f'chr(10) || {chr(39)}{name}:{chr(39)} || text')} END")
        return least(*ways) + f" AS {state}"

    def inserted(rows):
        user = least("user", *[add(s, 5, "I", "chr(10) || 'user:'") for s in ("start", "system", "assistant")])
        return f"""
            SELECT key, place, start, system, user, {least("assistant", add("user", 5, "I", "chr(10) || 'assistant:'"))} AS assistant
            FROM (SELECT * REPLACE ({user} AS user) FROM ({rows}))"""

    first = f"SELECT DISTINCT key, 0::BIGINT AS place, {{'c': 0::BIGINT, 'e': '', 't': ''}} AS start, " + ", ".join(f"{never} AS {s}" for s in _STATES[1:]) + " FROM rows"
    step = "SELECT r.key, r.place, " + ", ".join([
        onward("start", (), None, ""),
        onward("system", ("start",), None, "s"),
        onward("user", ("start", "system", "assistant"), "user", "u"),
        onward("assistant", ("user",), "assistant", "a"),
    ]) + " FROM held h JOIN rows r ON r.key = h.key AND r.place = h.place + 1"
    return f"""
WITH RECURSIVE hits AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, '') AS key,
           {_CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS hit
    FROM conversations
), damaged AS (
    SELECT key, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
           CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM hits WHERE hit != 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS place, left(role, 1) AS initial FROM damaged
), rows AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY place) > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
           lag(initial) OVER (PARTITION BY key ORDER BY place) || initial AS pair
    FROM placed
), held AS (
    {inserted(first)}
    UNION ALL
    {inserted(step)}
), ended AS (
    SELECT h.key, {least("start", "assistant")} AS way
    FROM held h JOIN (SELECT key, max(place) AS place FROM rows GROUP BY key) USING (key, place)
), facts AS (
    SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows GROUP BY key
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.c, 0) AS cost, coalesce(way.e, '') AS audit,
       sha256(coalesce(way.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM hits) LEFT JOIN facts USING (key) LEFT JOIN ended USING (key)
"""


@_query("op12_conversation_repair", _repair_sql())
def conversation_repair(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return conversations.audit(conversations.damaged(turns), turns)


@_query("op13_rank_bpe")
def rank_bpe_round_trip(spark, sf_dir):
    docs, path = _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return rank_bpe.round_trip(docs, path, public_tokenizers.PATTERN, "doc_id")


@_query("pipeline")
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
