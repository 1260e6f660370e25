"""Queries of the schema-drift operator."""

from __future__ import annotations

from cairn.operators import schema_drift
from cairn.runtime import table

QUERIES = {
    "p1_found": lambda s, d: schema_drift.found(table(s, d, "distill_lines")),
    "p1_versions": lambda s, d: schema_drift.schema_versions(table(s, d, "distill_lines")),
    "p1_merged": lambda s, d: schema_drift.merged(table(s, d, "distill_lines")),
}
_KIND = "CASE json_type({v}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END"
_AT = "json_extract({v}, '$.\"' || {k} || '\"')"

SQL: dict[str, str] = {
    "p1_found": f"""WITH once AS (SELECT file_name, line_no, trim(ltrim(line, chr(65279))) AS j FROM distill_lines WHERE file_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_name, line_no ORDER BY coalesce(loaded_at, TIMESTAMPTZ '9999-01-01'), coalesce(line_id, 4611686018427387904), coalesce(line, '')) = 1),
recs AS (SELECT file_name, line_no, j::JSON AS j, json_extract(j, '$.id')::VARCHAR AS rid FROM once WHERE starts_with(j, '{{') AND ends_with(j, '}}') AND json_valid(j)),
versions AS (SELECT feed, file_name, row_number() OVER (PARTITION BY feed ORDER BY written_on, file_name) - 1 AS version FROM (SELECT file_name, min(feed) AS feed, min(written_on) AS written_on FROM distill_lines WHERE file_name IS NOT NULL GROUP BY file_name)),
counts AS (SELECT file_name, count(*) AS n FROM recs GROUP BY file_name),
top AS (SELECT *, {_KIND.format(v="v")} AS kind FROM (SELECT file_name, line_no, rid, key, {_AT.format(v="j", k="key")} AS v FROM (SELECT *, unnest(json_keys(j)) AS key FROM recs)) WHERE key <> 'id'),
obj AS (SELECT *, {_KIND.format(v="w")} AS k2 FROM (SELECT file_name, line_no, rid, key, key || '.' || name AS path, {_AT.format(v="v", k="name")} AS w FROM (SELECT *, unnest(json_keys(v)) AS name FROM top WHERE kind = 'object'))),
el AS (SELECT file_name, line_no, rid, key, i, json_extract(v, '$[' || i || ']') AS e FROM (SELECT *, unnest(range(json_array_length(v)::BIGINT)) AS i FROM top WHERE kind = 'array')),
arr AS (SELECT *, {_KIND.format(v="w")} AS k2 FROM (SELECT file_name, line_no, rid, key, i, key || '[].' || name AS path, {_AT.format(v="e", k="name")} AS w FROM (SELECT *, unnest(json_keys(e)) AS name FROM el WHERE json_type(e) = 'OBJECT'))),
vals AS (SELECT file_name, line_no, rid, key AS path, NULL::VARCHAR AS parent, kind, kind || v::VARCHAR AS val FROM top WHERE kind IS NOT NULL
  UNION ALL SELECT file_name, line_no, rid, path, key, k2, k2 || w::VARCHAR FROM obj WHERE k2 IS NOT NULL
  UNION ALL SELECT file_name, line_no, rid, path, key, arg_min(k2, i), string_agg(i || k2 || w::VARCHAR, ' ' ORDER BY i) FROM arr WHERE k2 IS NOT NULL GROUP BY file_name, line_no, rid, path, key),
kinds AS (SELECT file_name, path, parent, kind, count(*) AS c FROM vals GROUP BY ALL),
fields AS (SELECT feed, version, file_name, path, parent, kind FROM (SELECT file_name, path, parent, sum(c) AS c, (list(kind ORDER BY c DESC, kind DESC))[1] AS kind FROM kinds GROUP BY file_name, path, parent) JOIN versions USING (file_name) JOIN counts USING (file_name) WHERE c >= 0.1::DOUBLE * n),
steps AS (SELECT b.feed, b.version, b.file_name, a.file_name AS prev_file FROM versions a JOIN versions b ON a.feed = b.feed AND a.version + 1 = b.version),
d0 AS (SELECT s.feed, s.version, s.file_name, s.prev_file, coalesce(o.path, n.path) AS path, coalesce(o.parent, n.parent) AS parent, coalesce(o.kind, '') AS old_kind, coalesce(n.kind, '') AS new_kind
  FROM (SELECT feed, version + 1 AS version, path, parent, kind FROM fields) o FULL JOIN fields n ON o.feed = n.feed AND o.version = n.version AND o.path = n.path JOIN steps s ON s.feed = coalesce(o.feed, n.feed) AND s.version = coalesce(o.version, n.version) WHERE coalesce(o.kind, '') <> coalesce(n.kind, '')),
d AS (SELECT * FROM d0 WHERE parent IS NULL OR (feed, version, parent) NOT IN (SELECT (feed, version, path) FROM d0 WHERE parent IS NULL)),
ov AS (SELECT d.feed, d.version, v.rid, d.path, min(v.val) AS val FROM d JOIN vals v ON v.file_name = d.prev_file AND v.path = d.path WHERE d.new_kind = '' AND v.rid IS NOT NULL AND v.rid <> 'null' GROUP BY ALL),
nv AS (SELECT d.feed, d.version, v.rid, d.path, min(v.val) AS val FROM d JOIN vals v ON v.file_name = d.file_name AND v.path = d.path WHERE d.old_kind = '' AND v.rid IS NOT NULL AND v.rid <> 'null' GROUP BY ALL),
sc AS (SELECT feed, version, ov.path AS was, nv.path AS now, count(*) AS n, count(*) FILTER (ov.val = nv.val) AS same FROM ov JOIN nv USING (feed, version, rid) GROUP BY ALL HAVING 2 * count(*) FILTER (ov.val = nv.val) > count(*)),
ren AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed, version, was ORDER BY same DESC, same / n DESC, now) AS ro, row_number() OVER (PARTITION BY feed, version, now ORDER BY same DESC, same / n DESC, was) AS rn FROM sc) WHERE ro = 1 AND rn = 1)
SELECT file_name, was AS field_path, 'renamed' AS change_kind, now AS new_value FROM ren JOIN steps USING (feed, version)
UNION ALL SELECT file_name, path, CASE WHEN old_kind = '' THEN 'added' WHEN new_kind = '' THEN 'removed' ELSE 'retyped' END, CASE WHEN old_kind <> '' AND new_kind <> '' THEN new_kind ELSE '' END FROM d
WHERE NOT (new_kind = '' AND (feed, version, path) IN (SELECT (feed, version, was) FROM ren)) AND NOT (old_kind = '' AND (feed, version, path) IN (SELECT (feed, version, now) FROM ren))""",
}
