"""Chunk tables: paths, routing, statistics, de-duplication, roll-ups, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import catalog as C
from cairn.operators import chunking as H
from cairn.runtime import table
from cairn.sources import tables as T


def _chunks(s, d):
    return table(s, d, "chunks")


def _details(s, d):
    return table(s, d, "details")


def list_languages(s, d):
    return C.languages(_chunks(s, d))


def list_repos(s, d):
    return C.repo_counts(_chunks(s, d))


def existing_repos(s, d):
    return _details(s, d).where("repo is not null").select("repo").distinct()


def expansion_plan(s, d):
    wanted = table(s, d, "documents").where("repo is not null").select("repo", F.lower("lang").alias("language")).distinct()
    return C.expansion_plan(wanted, _details(s, d))


def chunk_stats(s, d):
    return C.chunk_stats(_chunks(s, d))


def chunk_route(s, d):
    return _chunks(s, d).groupBy(C.collection(F.col("level")).alias("collection")).agg(F.count("*").alias("n"))


def dedup_prefix200(s, d):
    return C.first_by_prefix(_details(s, d), "content", "detail_id").select("detail_id")


def dedup_md5(s, d):
    return C.unseen(_chunks(s, d).where("content is not null"), _details(s, d)).select("chunk_id", "content_hash")


def hash_check(s, d):
    """How stored hashes compare with those of the contents."""
    right = C.short_hash(F.col("content"))
    kind = F.when(F.col("content").isNull(), "no_content").when(F.col("hash").isNull(), "missing").when(F.col("hash") == right, "right").when(F.lower("hash") == right, "case").otherwise("wrong")
    return _details(s, d).groupBy(kind.alias("hash_state")).agg(F.count("*").alias("n"))


def file_rollup(s, d):
    return C.file_rollup(_details(s, d), "detail_id")


def repo_rollup(s, d):
    return C.repo_rollup(_details(s, d))


def chunk_uids(s, d):
    rows = C.ordinals(_details(s, d).select("detail_id", "repo", "file_path", "name", "content"), "detail_id")
    return rows.select("detail_id", F.col("ordinal").cast("bigint").alias("ordinal"), C.chunk_uid(F.col("ordinal"), F.col("repo"), F.col("file_path"), F.col("name"), F.col("content")).alias("uid"))


def path_facts(s, d):
    p = F.col("file_path")
    return _details(s, d).where("file_path is not null").select("detail_id", H.language(p).alias("language_v1"), H.language(p, H.LANGUAGES_V2).alias("language_v2"), H.module(p).alias("module"), H.walked(p).alias("walked"), H.wanted_name(p).alias("wanted"))


def file_heads(s, d):
    """Summary text of every file chunk: path, documentation, first 50 lines."""
    c = _chunks(s, d).where("level = 3 and content is not null and file_path is not null")
    return c.select("chunk_id", F.md5(H.file_summary(F.col("file_path"), F.col("content"), F.col("docstring"))).alias("summary_md5"))


def scope_texts(s, d):
    r = _details(s, d).where("repo is not null and file_path like '%/%'").select("repo", H.module(F.col("file_path")).alias("module")).distinct()
    readme = table(s, d, "documents").where("source = 'repo_readmes' and repo is not null and text is not null").groupBy("repo").agg(F.min(F.left("text", F.lit(2000))).alias("readme"))
    r = r.join(readme, "repo", "left")
    return r.select("repo", "module", H.module_text(F.col("repo"), F.col("module")).alias("module_text"), F.md5(H.repo_text(F.col("repo"), F.col("readme"))).alias("repo_text_md5"))


def union_levels(s, d):
    """Both chunk versions as one table."""
    one = _chunks(s, d).select("level", "repo", "language", "type", F.length("content").alias("chars"))
    return one.unionByName(_details(s, d).select("level", "repo", "language", "type", F.length("content").alias("chars"))).groupBy("level", F.lower("type").alias("type")).agg(F.count("*").alias("n"), F.sum("chars").cast("bigint").alias("chars"))


def repos_only_in_documents(s, d):
    return table(s, d, "documents").select("repo").where("repo is not null").distinct().exceptAll(_details(s, d).select("repo").where("repo is not null").distinct())


def repo_languages_only_in_details(s, d):
    pairs = lambda df: df.where("repo is not null and language is not null").select("repo", F.lower("language").alias("language"))
    return pairs(_details(s, d)).distinct().exceptAll(pairs(_chunks(s, d)).distinct())


def expansion(s, d):
    """What an incremental run over the details adds to a store that holds the chunks."""
    rows = C.expansion(_details(s, d), _chunks(s, d).where("content is not null").select(C.short_hash(F.col("content")).alias("hash")), "detail_id")
    return rows.select("collection", "level", "uid", "repo", "file_path", F.md5("text").alias("text_md5"))


def fallback_documents(s, d):
    """Texts of the two lower collections, read past the index."""
    docs = _chunks(s, d).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"), "level").unionByName(_details(s, d).select(F.concat(F.lit("v2_"), F.col("detail_id").cast("string")).alias("id"), F.col("content").alias("text"), "level"))
    names = s.createDataFrame([(1, "summary"), (2, "chunks"), (3, "details")], "id int, name string")
    entries = docs.select("id", F.when(F.col("level") <= 2, 1).when(F.col("level") == 3, 2).otherwise(3).alias("collection_id"))
    return T.fallback_documents(docs.select("id", "text"), entries, names).select("id", "collection", "place", F.md5("text").alias("text_md5"))


def repos_in_both(s, d):
    return table(s, d, "documents").select("repo").where("repo is not null").intersect(_details(s, d).select("repo"))


def ast_extract(s, d):
    """Functions and classes of Python contents that parse."""
    return H.extract(_details(s, d).where("lower(file_path) like '%.py'"), "detail_id", "file_path", "content")


def regex_extract(s, d):
    return H.extract(_details(s, d).where("lower(file_path) not like '%.py'"), "detail_id", "file_path", "content")


def regex_extract_v2(s, d):
    return H.extract(_details(s, d).where("lower(file_path) not like '%.py'"), "detail_id", "file_path", "content", version=2)


QUERIES = {
    f.__name__: f
    for f in (
        list_languages, list_repos, existing_repos, expansion_plan, chunk_stats, chunk_route, dedup_prefix200, dedup_md5, hash_check, file_rollup, repo_rollup, chunk_uids, path_facts, file_heads, scope_texts, union_levels,
        repos_only_in_documents, repo_languages_only_in_details, repos_in_both, expansion, fallback_documents, ast_extract, regex_extract, regex_extract_v2,
    )
}

_EXT = "lower(regexp_extract(file_path, '(\\.[^./]+)$', 1))"


def _lang(table_: dict[str, str]) -> str:
    return f"CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


_BASE = "split_part(file_path, '/', -1)"

SQL = {
    "list_languages": "SELECT DISTINCT language FROM chunks WHERE language <> ''",
    "list_repos": "SELECT coalesce(nullif(repo, ''), 'unknown') AS repo, count(*) FILTER (level = 3) AS files, count(*) AS chunks FROM chunks GROUP BY 1",
    "existing_repos": "SELECT DISTINCT repo FROM details WHERE repo IS NOT NULL",
    "expansion_plan": """WITH w AS (SELECT DISTINCT repo, lower(lang) AS language FROM documents WHERE repo IS NOT NULL)
SELECT language, count(*) FILTER (repo NOT IN (SELECT repo FROM details WHERE repo IS NOT NULL)) AS new_repos, count(*) FILTER (repo IN (SELECT repo FROM details WHERE repo IS NOT NULL)) AS existing_repos FROM w GROUP BY language""",
    "chunk_stats": """WITH t AS (SELECT level, nullif(language, '') AS language, coalesce(length(content), 0) AS n FROM chunks)
SELECT *, chars // 4 AS est_tokens FROM (SELECT 'total' AS kind, NULL::VARCHAR AS key, count(*) AS chunks, sum(n)::BIGINT AS chars FROM t UNION ALL SELECT 'level', level::VARCHAR, count(*), sum(n)::BIGINT FROM t WHERE level IS NOT NULL GROUP BY level
UNION ALL SELECT 'language', language, count(*), sum(n)::BIGINT FROM t WHERE language IS NOT NULL GROUP BY language)""",
    "chunk_route": "SELECT CASE WHEN level <= 2 THEN 'summary' WHEN level = 3 THEN 'chunks' ELSE 'details' END AS collection, count(*) AS n FROM chunks GROUP BY 1",
    "dedup_prefix200": "SELECT min(detail_id) AS detail_id FROM details GROUP BY left(coalesce(content, ''), 200)",
    "dedup_md5": "SELECT chunk_id, left(md5(content), 12) AS content_hash FROM chunks WHERE content IS NOT NULL AND left(md5(content), 12) NOT IN (SELECT lower(hash) FROM details WHERE hash IS NOT NULL)",
    "hash_check": """SELECT CASE WHEN content IS NULL THEN 'no_content' WHEN hash IS NULL THEN 'missing' WHEN hash = left(md5(content), 12) THEN 'right' WHEN lower(hash) = left(md5(content), 12) THEN 'case' ELSE 'wrong' END AS hash_state, count(*) AS n FROM details GROUP BY 1""",
    "file_rollup": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY detail_id) AS rn FROM details WHERE repo IS NOT NULL AND file_path IS NOT NULL)
SELECT repo, file_path, min(language) FILTER (rn = 1) AS language, '# ' || file_path || chr(10) || string_agg('  ' || coalesce(type, '') || ': ' || coalesce(name, ''), chr(10) ORDER BY rn) FILTER (rn <= 20) AS summary FROM r GROUP BY repo, file_path""",
    "repo_rollup": """WITH g AS (SELECT repo, coalesce(string_agg(DISTINCT language, ', ' ORDER BY language), '') AS languages, count(DISTINCT file_path) AS files, count(*) AS chunks FROM details WHERE repo IS NOT NULL GROUP BY repo)
SELECT *, 'Repository: ' || repo || chr(10) || 'Languages: ' || languages || chr(10) || 'Files: ' || files || chr(10) || 'Chunks: ' || chunks AS summary FROM g""",
    "chunk_uids": """SELECT detail_id, row_number() OVER (ORDER BY detail_id) - 1 AS ordinal, left(translate('v2_' || (row_number() OVER (ORDER BY detail_id) - 1) || '_' || coalesce(repo, '') || '|' || coalesce(file_path, '') || '|' || coalesce(name, '') || '|' || left(md5(coalesce(content, '')), 6), ':|', '__'), 200) AS uid FROM details""",
    "path_facts": f"""SELECT detail_id, {_lang(H.LANGUAGES_V1)} AS language_v1, {_lang(H.LANGUAGES_V2)} AS language_v2, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE '' END AS module,
len(list_filter(string_split(file_path, '/')[:-2], lambda x: starts_with(x, '.') OR x IN ({", ".join(f"'{x}'" for x in H.PRUNED_V1)}))) = 0 AS walked,
NOT (contains({_BASE}, '__pycache__') OR contains({_BASE}, 'node_modules') OR contains({_BASE}, '.git')) AND NOT (contains(lower({_BASE}), 'test') AND {_EXT} <> '.py') AS wanted FROM details WHERE file_path IS NOT NULL""",
    "file_heads": """SELECT chunk_id, md5('# ' || file_path || chr(10) || chr(10) || CASE WHEN coalesce(docstring, '') <> '' THEN docstring || chr(10) || chr(10) ELSE '' END || array_to_string(string_split(content, chr(10))[1:50], chr(10))) AS summary_md5
FROM chunks WHERE level = 3 AND content IS NOT NULL AND file_path IS NOT NULL""",
    "scope_texts": """WITH r AS (SELECT repo, min(left(text, 2000)) AS readme FROM documents WHERE source = 'repo_readmes' AND repo IS NOT NULL AND text IS NOT NULL GROUP BY repo), m AS (SELECT DISTINCT repo, split_part(file_path, '/', 1) AS module FROM details WHERE repo IS NOT NULL AND contains(file_path, '/'))
SELECT repo, module, 'Module: ' || split_part(repo, '/', -1) || '/' || module AS module_text, md5(CASE WHEN coalesce(readme, '') <> '' THEN 'Repository: ' || repo || chr(10) || chr(10) || readme ELSE repo END) AS repo_text_md5 FROM m LEFT JOIN r USING (repo)""",
    "repo_languages_only_in_details": "SELECT DISTINCT repo, lower(language) AS language FROM details WHERE repo IS NOT NULL AND language IS NOT NULL EXCEPT SELECT repo, lower(language) FROM chunks WHERE repo IS NOT NULL AND language IS NOT NULL",
    "expansion": """WITH f AS (SELECT *, row_number() OVER (ORDER BY detail_id) - 1 AS i, row_number() OVER (PARTITION BY repo, file_path ORDER BY detail_id) AS rn FROM details WHERE repo IS NOT NULL AND file_path IS NOT NULL AND (content IS NULL OR left(md5(content), 12) NOT IN (SELECT left(md5(content), 12) FROM chunks WHERE content IS NOT NULL)))
SELECT 'details' AS collection, 4::INTEGER AS level, left(translate('v2_' || i || '_' || repo || '|' || file_path || '|' || coalesce(name, '') || '|' || left(md5(coalesce(content, '')), 6), ':|', '__'), 200) AS uid, repo, file_path, md5(content) AS text_md5 FROM f
UNION ALL SELECT 'chunks', 3::INTEGER, left(translate('file_' || repo || '_' || replace(file_path, '/', '_') || '_' || left(md5(repo || '|' || file_path), 8), ':|', '__'), 150), repo, file_path, md5('# ' || file_path || chr(10) || string_agg('  ' || coalesce(type, '') || ': ' || coalesce(name, ''), chr(10) ORDER BY rn) FILTER (rn <= 20)) FROM f GROUP BY repo, file_path
UNION ALL SELECT 'summary', 1::INTEGER, 'repo_v2_' || left(md5(repo), 12), repo, NULL, md5('Repository: ' || repo || chr(10) || 'Languages: ' || coalesce(string_agg(DISTINCT language, ', ' ORDER BY language), '') || chr(10) || 'Files: ' || count(DISTINCT file_path) || chr(10) || 'Chunks: ' || count(*)) FROM f GROUP BY repo""",
    "fallback_documents": """WITH x AS (SELECT chunk_id AS id, content AS text, level FROM chunks UNION ALL SELECT 'v2_' || detail_id, content, level FROM details)
SELECT id, CASE WHEN level = 3 THEN 'chunks' ELSE 'details' END AS collection, CASE WHEN level = 3 THEN 0 ELSE 1 END::INTEGER AS place, md5(text) AS text_md5 FROM x WHERE coalesce(level, 4) >= 3 AND text <> ''""",
    "union_levels": """SELECT level, lower(type) AS type, count(*) AS n, sum(length(content))::BIGINT AS chars FROM (SELECT level, type, content FROM chunks UNION ALL SELECT level, type, content FROM details) GROUP BY ALL""",
    "repos_only_in_documents": "SELECT DISTINCT repo FROM documents WHERE repo IS NOT NULL AND repo NOT IN (SELECT repo FROM details WHERE repo IS NOT NULL)",
    "repos_in_both": "SELECT DISTINCT repo FROM documents WHERE repo IN (SELECT repo FROM details)",
}
