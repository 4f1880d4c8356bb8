"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from poolwright.llm import license_scan, line_dedup, mixing, secret_scan
from poolwright.llm.common import LOWER, UPPER


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NORMAL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP4 = f"""
WITH d AS (SELECT doc_id, {NORMAL} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(source, NULL) AS source, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, source, unnest(a) AS line, unnest(range(len(a))) AS pos FROM d),
k AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}')) AS t FROM l),
b AS (SELECT t FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES})
SELECT doc_id, count(*) AS n_lines, count(b.t) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.t IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN b ON k.t = b.t GROUP BY doc_id
"""


def _op1() -> str:
    t = license_scan.THRESHOLD
    sets = {name: license_scan.plain_bigrams(text) for name, text in sorted(license_scan.TEMPLATES.items())}
    rows = ", ".join(f"({_quote(n)}, [{', '.join(map(_quote, g))}])" for n, g in sets.items())
    return f"""
WITH l(license, own) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_replace({NORMAL}, '[^a-z0-9\\n]+', ' ', 'g') AS c FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, c, string_split(c, chr(10)) AS a FROM d),
u AS (SELECT doc_id, unnest(range(len(a))) AS line, unnest(a) AS unit FROM s
  UNION ALL SELECT doc_id, -1, replace(c, chr(10), ' ') FROM s WHERE len(a) > 1),
w AS (SELECT doc_id, line, list_filter(string_split(unit, ' '), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1
  AND len(list_distinct(w)) <= {2 * max(map(len, sets.values()))}),
x AS (SELECT doc_id, line, license, 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM g JOIN l
  ON len(g) BETWEEN len(own) * {t} / (2 - {t}) - 1 AND len(own) * (2 - {t}) / {t} + 1)
SELECT doc_id, line::INTEGER AS line, license, dice FROM x WHERE dice >= {t}
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1
"""


def _op7() -> str:
    parts = []
    for k, r in enumerate(secret_scan.RULES):
        p = _quote(r.pattern)
        parts.append(
            f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, {r.base} AS base, {r.least} AS least, regexp_extract_all(t, {p}, 0) AS hits, "
            f"regexp_extract_all(t, {p}, {r.group}) AS grp, string_split_regex(t, {p}) AS pieces FROM d WHERE regexp_matches(t, {p})"
        )
    count = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT doc_id, rank, kind, base, least, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(grp) AS g, hits, pieces FROM m),
s AS (SELECT doc_id, rank, kind, base, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
  length(hit) AS n FROM e WHERE length(g) >= least),
a AS (SELECT doc_id, {count},
  coalesce(string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, rank) FILTER (WHERE base), '') AS b,
  coalesce(string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, rank), '') AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)
"""


def mix_sql(docs: str) -> str:
    """CTEs that end in mixed: doc_id, size, source_size, target, copies."""
    n, pick = len(mixing.WEIGHTS), ", ".join(f"{x}::DOUBLE" for x in mixing.WEIGHTS)
    return f"""
z AS (SELECT doc_id, (source IS NULL)::INT AS no_source, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {docs}),
so AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM z GROUP BY ALL),
sw AS (SELECT *, ([{pick}])[((row_number() OVER (ORDER BY no_source, source) - 1) % {n} + 1)::INT] AS weight FROM so),
sf AS (SELECT *, {mixing.CAP}::DOUBLE * source_size / weight AS full_at FROM sw),
sl AS (SELECT *, ({mixing.RATIO}::DOUBLE * sum(source_size) OVER () - {mixing.CAP}::DOUBLE * coalesce(sum(source_size) OVER p, 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM sf
  WINDOW p AS (ORDER BY full_at, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT no_source, source, source_size, coalesce(least({mixing.CAP}::DOUBLE * source_size, weight * (SELECT arg_min(level, (full_at, no_source, source)) FROM sl WHERE full_at > level)),
  {mixing.CAP}::DOUBLE * source_size) AS target, ('0x' || substr(md5('{mixing.SEED}|' || CASE WHEN no_source = 1 THEN 'null' ELSE '=' || source END), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM sl),
sr AS (SELECT z.doc_id, z.size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
  row_number() OVER (PARTITION BY z.no_source, z.source ORDER BY size, doc_id) AS k FROM z JOIN st USING (no_source, source)),
mixed AS (SELECT doc_id, size, source_size, target, least(floor(k * rate + u) - floor((k - 1) * rate + u), ceil(rate))::BIGINT AS copies FROM sr)"""


OP9 = f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"

ORACLE = {"op1_license_scan": _op1(), "op4_exact_dedup": OP4, "op5_line_dedup": OP5, "op7_secret_scan": _op7(), "op9_mixing": OP9}
