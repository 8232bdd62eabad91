"""DuckDB SQL for the training-data queries that SQL can express.

Each restates its query's contract plainly, without the operator's method:
windows as word sequences rather than hashes and sketches, sums by every
prefix rather than directory splits. The others (token files, SimHash,
SpotSigs, fitted models, the pipeline) are tested against brute force.
"""

from __future__ import annotations

from . import decontaminate, lines, mixing, sharding

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = f"""
WITH s AS (SELECT doc_id, coalesce(source, 'null') AS source, len({WORDS})::BIGINT AS size,
             ('0x' || substr(md5('42:row:' || doc_id), 1, 12))::BIGINT::DOUBLE / {1 << 48}.0 AS u FROM documents),
t AS (SELECT source, sum(size)::DOUBLE AS total, row_number() OVER (ORDER BY source) AS i FROM s GROUP BY source),
w AS (SELECT *, 2.0 * total AS most, CASE (i - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM t),
f AS (SELECT *, 1.5 * sum(total) OVER () AS budget, sum(weight) OVER () AS weights,
        coalesce(sum(most) OVER before, 0.0) AS spent, coalesce(sum(weight) OVER before, 0.0) AS served FROM w
      WINDOW before AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min((budget - spent) / (weights - served)) AS level FROM (
        SELECT * FROM f WHERE (budget - spent) / (weights - served) <= most / weight ORDER BY most / weight LIMIT 1)),
g AS (SELECT source, total::BIGINT AS source_size, coalesce(least(most, level * weight), most) AS target FROM f, l),
r AS (SELECT s.*, g.source_size, g.target, target / source_size AS rate,
        ('0x' || substr(md5('42:source:s' || source), 1, 12))::BIGINT::DOUBLE / {1 << 48}.0 AS start,
        row_number() OVER (PARTITION BY source ORDER BY
          floor(log2(greatest(size, 1)) * {mixing.CLASSES_PER_DOUBLING} + 1e-9), floor(u * {mixing.SLOTS}),
          size, u, doc_id::VARCHAR) AS k
      FROM s JOIN g USING (source)),
c AS (SELECT *, (floor(start + k * rate) - floor(start + (k - 1) * rate))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""

LINES = f"""
WITH d AS (SELECT doc_id, text IS NULL AS blank, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT *, sum((words > 0)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM (
  SELECT doc_id, line, p, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM d))),
r AS (SELECT doc_id, i, list(trim(line, ' ')) OVER ahead AS s, list(words) OVER ahead AS n FROM l WHERE words > 0
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {lines.WORDS - 1} FOLLOWING)),
w AS (SELECT doc_id, i, j, array_to_string(s[1:j], chr(10)) AS content, list_sum(n[1:j]) AS total, n[1] AS head, n[j] AS tail
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM r)),
run AS (SELECT * FROM w WHERE total >= {lines.WORDS} AND (total - tail < {lines.WORDS} OR total - head < {lines.WORDS})),
first AS (SELECT content, min((doc_id, i)) AS f FROM run GROUP BY content),
gone AS (SELECT DISTINCT doc_id, unnest(range(i::BIGINT, (i + j)::BIGINT)) AS i FROM run JOIN first USING (content) WHERE (doc_id, i) > f),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS kept, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, i)
      GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN blank THEN 0 ELSE len(lines) END::BIGINT AS n_lines,
  (len(lines) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

SHARDS = f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
d AS (SELECT r.*, depth, h >> ({sharding.HASH_BITS} - depth) AS prefix
      FROM r, (SELECT unnest(range(0, {sharding.HASH_BITS + 1}))::INT AS depth)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS b FROM d)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
  b::BIGINT AS shard_bytes FROM s WHERE b <= {sharding.LIMIT}
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
own AS (SELECT s, min(doc_id) AS o FROM w GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM w JOIN own USING (s), range(13) r(j) WHERE doc_id > o),
l AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, p)
      GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def _tokens(table: str, key: str) -> str:
    return f"""(SELECT {key}, string_split(trim(regexp_replace(lower(coalesce(text, '')),
      '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS t FROM {table})"""


def _windows(tokens: str, key: str) -> str:
    """A row a window: its tokens as numbers t0, t1 ...; 0 for a token that no
    benchmark item has, null after the end."""
    later = ", ".join(f"lead(n, {k}) OVER w AS t{k}" for k in range(1, decontaminate.WINDOW))
    return f"""(SELECT {key}, i, n AS t0, {later} FROM (
        SELECT {key}, i, coalesce(n, 0) AS n FROM {tokens} LEFT JOIN dict USING (w))
      WINDOW w AS (PARTITION BY {key} ORDER BY i))"""


def _unnested(table: str, key: str) -> str:
    return f"(SELECT {key}, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM {_tokens(table, key)})"


_SAME = " + ".join(f"(a.t{k} = b.t{k})::INT" for k in range(decontaminate.WINDOW))
#: Windows that agree in enough positions agree in two whole blocks at least.
_PAIRS = " UNION ".join(
    "SELECT a.doc_id, b.item_id, a.i FROM a JOIN b ON " + " AND ".join(
        f"a.t{p} = b.t{p}" for block in mask
        for p in range(decontaminate.BLOCKS[block][0], sum(decontaminate.BLOCKS[block])))
    + f" WHERE {_SAME} >= {decontaminate.WINDOW - decontaminate.SUBSTITUTIONS}" for mask in decontaminate.MASKS)

_LAST, _LEAST = decontaminate.WINDOW - 1, decontaminate.SHORTEST
_HEAD = " AND ".join(f"a.t{k} = b.t{k}" for k in range(_LEAST))
_REST = " AND ".join(f"(b.t{k} IS NULL OR a.t{k} = b.t{k})" for k in range(_LEAST, _LAST))
_LENGTH = " + ".join(f"(b.t{k} IS NOT NULL)::INT" for k in range(_LAST))

LEAKS = f"""
WITH dt AS MATERIALIZED {_unnested('documents', 'doc_id')}, bt AS MATERIALIZED {_unnested('benchmark', 'item_id')},
dict AS MATERIALIZED (SELECT w, row_number() OVER (ORDER BY w) AS n FROM (SELECT DISTINCT w FROM bt)),
aa AS MATERIALIZED {_windows('dt', 'doc_id')}, bb AS MATERIALIZED {_windows('bt', 'item_id')},
a AS (SELECT * FROM aa WHERE t{_LAST} IS NOT NULL), b AS (SELECT * FROM bb WHERE t{_LAST} IS NOT NULL),
h AS (SELECT *, {decontaminate.WINDOW} AS n FROM ({_PAIRS}) UNION
  SELECT a.doc_id, b.item_id, a.i, {_LENGTH} AS n FROM aa a JOIN bb b ON {_HEAD}
  WHERE b.i = 1 AND b.t{_LAST} IS NULL AND {_REST})
SELECT doc_id, item_id, (min(i) - 1)::BIGINT AS first_token, (max(i + n) - 2)::BIGINT AS last_token,
  count(*)::BIGINT AS n_windows FROM h GROUP BY doc_id, item_id
"""

ORACLE: dict[str, str] = {
    "op1_mix_sources": MIX, "op3_line_dedup": LINES, "op5_shards": SHARDS,
    "op6_substring_dedup": SUBSTRINGS, "op8_decontaminate": LEAKS,
}
