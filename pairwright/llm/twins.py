"""SQL of the queries that SQL can express, for DuckDB over the given tables."""

from __future__ import annotations

# CRC-32 of a text of ASCII characters: eight shifts after each byte.
CRC32 = """xor(4294967295, list_reduce(
    flatten(list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295))"""

LOWER = "translate({value}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str, levels: int = 5) -> str:
    """Levels and sibling runs over ``leaves`` (tree, p, h): up to 16 ** levels leaves a tree."""
    parts = [f"{name}0 AS (SELECT tree, p, h, count(*) OVER (PARTITION BY tree) AS m FROM {leaves})"]
    for k in range(levels):
        parts.append(
            f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM (SELECT tree, p // 16 AS p, "
            f"CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {name}{k} GROUP BY tree, p // 16))"
        )
        parts.append(
            f"{name}s{k} AS (SELECT a.tree, a.p, any_value(b.m) AS m, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p // {16**k}), '') AS l, "
            f"coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p // {16**k}), '') AS r "
            f"FROM {name}0 a JOIN {name}{k} b ON a.tree = b.tree AND a.p // {16 ** (k + 1)} = b.p // 16 GROUP BY a.tree, a.p)"
        )
    return ",\n".join(parts)


def _folded(name: str, start: str, levels: int = 5) -> str:
    for k in range(levels):
        s = f"{name}s{k}"
        start = f"CASE WHEN {s}.m = 1 THEN {start} ELSE sha256({s}.l || {start} || {s}.r) END"
    return start


def _siblings(name: str, levels: int = 5) -> str:
    return " || ".join(f"{name}s{k}.l || {name}s{k}.r" for k in range(levels))


def _joins(name: str, tree: str, place: str, levels: int = 5) -> str:
    return " ".join(
        f"JOIN {name}s{k} ON {name}s{k}.tree = {tree} AND {name}s{k}.p = {place}" for k in range(levels)
    )


def _leaf(text: str) -> str:
    values = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(
        f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values
    ) + ")"


MERKLE = f"""WITH named AS (SELECT source AS name, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
rows AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST) - 1 AS p, {_leaf("text")} AS h,
  CASE WHEN {CRC32.format(value="doc_id")} % 5 = 0 THEN {_leaf(LOWER.format(value="text"))} ELSE {_leaf("text")} END AS seen
  FROM documents d JOIN named n ON d.source IS NOT DISTINCT FROM n.name),
{_tree("d", "rows")},
subroots AS (SELECT 0 AS tree, tree AS p, h FROM d5),
{_tree("g", "subroots")},
inner_fold AS (SELECT rows.*, {_siblings("d")} AS siblings, {_folded("d", "seen")} AS folded FROM rows {_joins("d", "rows.tree", "rows.p")})
SELECT doc_id, i.h AS leaf, u.h AS subroot, t.h AS root, sha256(siblings || {_siblings("g")}) AS proof_sha256,
  {_folded("g", "folded")} AS folded_root, {_folded("g", "folded")} = t.h AS verified
FROM inner_fold i JOIN subroots u ON u.p = i.tree {_joins("g", "0", "i.tree")} CROSS JOIN g5 t"""

COLLOCATIONS = f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format(value="coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
counts AS (SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS phrase, count(*) AS a
  FROM places, range(1, 5) x(s) WHERE i + s - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, a, s, k, string_split(phrase, ' ') AS w FROM counts, range(1, 4) x(k) WHERE k < s),
scored AS (SELECT c.*, f.a AS l, r.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(f.a AS HUGEINT) + r.a) AS BIGINT) AS score FROM cuts c
  JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.s], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM counts, range(2, 4) x(m), range(1, 4) y(i) WHERE m < s AND i + m - 1 <= s GROUP BY ALL),
kept AS (SELECT o.* FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase
  WHERE i.longer IS NULL OR 100 * CAST(i.longer AS HUGEINT) < 80 * CAST(o.a AS HUGEINT))
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000"""
