"""A query on equality of JSON values, with its SQL. The catalogue adds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions.json_values import canonical_json, is_json, with_repeated_keys

_QUOTED = r"""'"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"'"""
#: Pairs of texts around each document's text, in SQL that both engines run.
_PAIRS = {
    0: ("""'{"a": ' || q || ', "b": [1, 2.50, {"z": null, "y": true}]}'""", """'{"b":[1,2.5,{"y":true,"z":null}],"a":' || q || '}'"""),
    1: ("""'{"n": 1, "t": ' || q || '}'""", """'{"n": 1.0, "t": ' || q || '}'"""),
    2: ("""'[' || q || ', 10, [], 0.5]'""", """' [ ' || q || ' , 10 , [ ] , 5e-1 ] '"""),
    3: ("""'{"k": {"x": 1}, "k": ' || q || '}'""", """'{"k": ' || q || '}'"""),
    4: ("text", "q"),
    5: ("""'{"1": ' || q || '}'""", """'{1: ' || q || '}'"""),
    6: ("""'[' || q || ', {}]'""", """'[' || q || ', []]'"""),
    7: ("""'["' || chr(92) || 'u0041", ' || q || ']'""", """'["A", ' || q || ']'"""),
    8: ("""'[true, ' || q || ']'""", """'["true", ' || q || ']'"""),
    9: ("""'[' || q""", """'[' || q || ' '"""),
}
_CASE = [f"CASE k {' '.join(f'WHEN {k} THEN {p[side]}' for k, p in _PAIRS.items())} END" for side in (0, 1)]
PAIRS = f"SELECT ordinal, k, {_CASE[0]} AS l, {_CASE[1]} AS r FROM (SELECT doc_id AS ordinal, doc_id % 10 AS k, text, {_QUOTED} AS q FROM documents) x"


def q_json_same(spark: SparkSession, d: str) -> DataFrame:
    """Whether the two texts of each pair are the same JSON value, and which of them are JSON at all."""
    own = with_repeated_keys(spark)
    own.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("documents")
    rows = own.sql(PAIRS)
    return rows.select("ordinal", is_json(F.col("l")).alias("left_json"), is_json(F.col("r")).alias("right_json"), (canonical_json(F.col("l")) == canonical_json(F.col("r"))).alias("same"))


QUERIES = {"q_json_same": q_json_same}
ORACLES = {
    # leaves and empty containers by their paths; of a path that comes twice the last counts, with what is under it
    "q_json_same": f"""WITH pairs AS ({PAIRS}),
sides AS (SELECT ordinal, 'l' AS side, l AS x FROM pairs UNION ALL SELECT ordinal, 'r', r FROM pairs),
parsed AS (SELECT ordinal, side, x, json_valid(x) AS ok, CASE WHEN json_valid(x) THEN x ELSE CAST(to_json(x) AS VARCHAR) END AS j FROM sides WHERE x IS NOT NULL),
nodes AS (SELECT p.ordinal, p.side, t.id, t.parent, t.fullkey, t.type, t.atom, max(t.id) OVER (PARTITION BY p.ordinal, p.side, t.fullkey) = t.id AS last FROM parsed p, json_tree(p.j) t),
leaves AS (SELECT n.ordinal, n.side, n.fullkey || ' ' || CASE WHEN n.type IN ('UBIGINT', 'BIGINT') THEN 'i' || CAST(n.atom AS VARCHAR) WHEN n.type = 'DOUBLE' THEN 'f' || CAST(CAST(n.atom AS DOUBLE) AS VARCHAR) ELSE n.type || coalesce(CAST(n.atom AS VARCHAR), '') END AS leaf
  FROM nodes n LEFT JOIN nodes up ON up.ordinal = n.ordinal AND up.side = n.side AND up.id = n.parent
  WHERE n.last AND coalesce(up.last, true)),
forms AS (SELECT ordinal, side, list(leaf ORDER BY leaf) AS form FROM leaves GROUP BY ALL)
SELECT p.ordinal, coalesce(a.ok, false) AS left_json, coalesce(b.ok, false) AS right_json, fl.form = fr.form AS same
FROM pairs p LEFT JOIN parsed a ON a.ordinal = p.ordinal AND a.side = 'l' LEFT JOIN parsed b ON b.ordinal = p.ordinal AND b.side = 'r'
LEFT JOIN forms fl ON fl.ordinal = p.ordinal AND fl.side = 'l' LEFT JOIN forms fr ON fr.ordinal = p.ordinal AND fr.side = 'r'""",
}
