"""SQL of drift against a reference, for several queries."""

from __future__ import annotations


def psi_sql(source: str, features: list[str], is_ref: str, key: str) -> str:
    """(feature, key, psi) of each key's rows against the reference rows of source."""
    tenths = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"
    edges = " UNION ALL ".join(f"SELECT '{f}' AS feature, list_sort(list_distinct(quantile_cont(CAST({f} AS DOUBLE), {tenths}) FILTER ({is_ref}))) AS edges FROM {source}" for f in features)
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, {key} AS key, CAST({f} AS DOUBLE) AS v, {is_ref} AS is_ref FROM {source} WHERE {f} IS NOT NULL" for f in features)
    return f"""SELECT g.feature, g.key, CASE WHEN any_value(g.bins) < 2 THEN 0.0 ELSE sum((a - e) * ln(a / e)) END AS psi FROM (
      SELECT g.feature, g.key, g.bins, greatest(coalesce(r.n, 0) / CAST(g.n_ref AS DOUBLE), 0.0001) AS e, greatest(coalesce(c.n, 0) / CAST(g.n_cur AS DOUBLE), 0.0001) AS a FROM (
        SELECT feature, key, bins, n_ref, n_cur, unnest(range(1, greatest(bins, 1) + 1)) AS bin FROM (
          SELECT l.feature, key, any_value(len(edges) - 1) AS bins, count(*) AS n_cur, any_value(n_ref) AS n_ref FROM ({long}) l JOIN ({edges}) x ON x.feature = l.feature
          JOIN (SELECT feature, count(*) AS n_ref FROM ({long}) WHERE is_ref GROUP BY feature) y ON y.feature = l.feature WHERE NOT is_ref GROUP BY l.feature, key)) g
      LEFT JOIN (SELECT l.feature, least(greatest(len(list_filter(edges, lambda x: x <= v)), 1), len(edges) - 1) AS bin, count(*) AS n FROM ({long}) l
        JOIN ({edges}) x ON x.feature = l.feature WHERE is_ref GROUP BY ALL) r ON r.feature = g.feature AND r.bin = g.bin
      LEFT JOIN (SELECT l.feature, key, least(greatest(len(list_filter(edges, lambda x: x <= v)), 1), len(edges) - 1) AS bin, count(*) AS n FROM ({long}) l
        JOIN ({edges}) x ON x.feature = l.feature WHERE NOT is_ref GROUP BY ALL) c ON c.feature = g.feature AND c.key = g.key AND c.bin = g.bin) g GROUP BY g.feature, g.key"""


REPORT = """max(round(psi, 4)) AS psi_max, '{{' || string_agg('"' || feature || '":' || printf('%.4f', round(psi, 4)), ',' ORDER BY feature) || '}}' AS psi_json"""
