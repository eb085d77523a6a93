"""Reference SQL over the nested payloads."""

from __future__ import annotations

from threadloom.plans.relational import _DOCS


def elements(field: str) -> str:
    """SQL of the rows (id, i, e) of an array of the payloads: payload or array may be JSON text, the array a lone object."""
    return f"""(WITH t AS (SELECT id, structured AS s FROM {_DOCS} WHERE json_valid(structured)),
r AS (SELECT id, CASE WHEN json_type(s) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(s, '$')) THEN json_extract_string(s, '$') END ELSE s END AS p FROM t),
f AS (SELECT id, CASE WHEN json_type(p, '$.{field}') = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(p, '$.{field}')) THEN json_extract_string(p, '$.{field}') END ELSE CAST(json_extract(p, '$.{field}') AS VARCHAR) END AS c FROM r WHERE p IS NOT NULL AND json_type(p) = 'OBJECT'),
a AS (SELECT id, CASE WHEN json_type(c) = 'OBJECT' THEN '[' || c || ']' ELSE c END AS c FROM f WHERE c IS NOT NULL AND json_type(c) IN ('OBJECT', 'ARRAY')),
u AS (SELECT id, c, unnest(range(CAST(json_array_length(c) AS BIGINT))) AS i FROM a),
x AS (SELECT id, i, json_extract(c, '$[' || i || ']') AS e FROM u)
SELECT id, i, e FROM x WHERE json_type(e) IN ('OBJECT', 'VARCHAR'))"""
