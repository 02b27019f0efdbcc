"""Longer checking SQL (DuckDB) of the manifest and of the conversation trie."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"


def crc32_sql(value: str) -> str:
    """Unsigned crc32 of the decimal digits of a number, bit by bit."""
    bits = "[0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]"
    digits = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = f"list_reduce({bits}, lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte))"
    return f"xor(list_reduce({digits}, lambda crc, byte: {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _levels(name: str, tree: str, leaves: str, heights: int) -> str:
    """Tables ``name0`` (tree, i, digest, n), ``name1``, ... of nodes and ``nameN_runs`` of the runs they come in."""
    parts = [f"{name}0 AS ({leaves})"]
    for h in range(heights):
        parts.append(f"""{name}{h}_runs AS (SELECT {tree} AS tree, i // 16 AS run, list(digest ORDER BY i) AS ds, any_value(n) AS n
  FROM {name}{h} WHERE n > 1 GROUP BY ALL)""")
        parts.append(f"""{name}{h + 1} AS (SELECT tree AS {tree}, run AS i, sha256(array_to_string(ds, '')) AS digest, (n + 15) // 16 AS n
  FROM {name}{h}_runs)""")
    tops = "\nUNION ALL\n".join(f"SELECT {tree} AS tree, digest FROM {name}{h} WHERE n = 1" for h in range(heights + 1))
    return ",\n".join([*parts, f"{name}_roots AS ({tops})"])


def _fold(name: str, tree: str, rank: str, source: str, heights: int, out: str) -> str:
    """Steps that lengthen ``proof`` and fold ``seen`` over the heights of one tree."""
    parts = []
    for h in range(heights):
        at = f"({rank} // {16 ** h})"
        before = f"coalesce(array_to_string(r.ds[1 : {at} % 16], ''), '')"
        after = f"coalesce(array_to_string(r.ds[{at} % 16 + 2 :], ''), '')"
        parts.append(f"""{out}{h} AS (SELECT s.* EXCLUDE (proof, seen), s.proof || CASE WHEN r.run IS NULL THEN '' ELSE {before} || {after} END AS proof,
    CASE WHEN r.run IS NULL THEN s.seen ELSE sha256({before} || s.seen || {after}) END AS seen
  FROM {source} s LEFT JOIN {name}{h}_runs r ON r.tree IS NOT DISTINCT FROM s.{tree} AND r.run = {at} // 16)""")
        source = f"{out}{h}"
    return ",\n".join(parts)


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(
        f"coalesce(CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Heights that the SQL spells out: 16 ** 6 leaves of one source, 16 ** 3 sources.
HEIGHTS, TOP_HEIGHTS = 6, 3

MERKLE_SQL = f"""WITH docs AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {crc32_sql('doc_id')} % 5 = 0 THEN {_leaf(LOWERED)} ELSE {_leaf('text')} END AS seen FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM docs),
{_levels('node', 'source', 'SELECT source, rank AS i, leaf AS digest, n FROM placed', HEIGHTS)},
subroots AS (SELECT tree AS source, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM node_roots),
{_levels('top', 'one', 'SELECT 0 AS one, place AS i, digest, n FROM subroots', TOP_HEIGHTS)},
begun AS (SELECT p.doc_id, p.source, p.leaf, p.seen, p.rank, s.digest AS subroot, s.place, 0 AS one, '' AS proof
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source),
{_fold('node', 'source', 's.rank', 'begun', HEIGHTS, 'low')},
{_fold('top', 'one', 's.place', f'low{HEIGHTS - 1}', TOP_HEIGHTS, 'high')}
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, seen AS folded_root, seen = t.digest AS verified
FROM high{TOP_HEIGHTS - 1}, top_roots t"""

TRIE_SQL = f"""WITH own AS (
  SELECT conv_id, list({{'id': md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text), 'words': len(regexp_extract_all(text, {WORDS}))}}
                       ORDER BY turn NULLS FIRST, md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
heads AS (SELECT o.conv_id, o.t, {crc32_sql('o.conv_id')} % 4 AS h, b.t AS base
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
built AS (SELECT conv_id, list_concat(coalesce(base[1 : h], []), t[h + 1 :]) AS t FROM heads),
ids AS (SELECT conv_id, len(t) AS d, array_to_string(list_transform(t, lambda x: x.id), '') AS ids,
               list_transform(t, lambda x: x.words) AS words FROM built),
steps AS (SELECT conv_id, d, unnest(range(0, d + 1)) AS depth, ids, words FROM ids),
nodes AS (SELECT left(ids, 32 * depth) AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 any_value(CASE WHEN depth = 0 THEN 0 ELSE words[depth] END) AS words,
                 sha256(coalesce(string_agg(CASE WHEN d = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM steps GROUP BY 1, 2),
kids AS (SELECT left(key, length(key) - 32) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own_parts AS (SELECT m.key, m.depth, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, (m.n_convs - 1) * m.words AS saved
  FROM nodes m LEFT JOIN kids k ON k.key = m.key),
ups AS (SELECT left(key, 32 * up) AS key, sum(leaf) AS leaves, sum(saved) AS saved
  FROM (SELECT key, leaf, saved, unnest(range(0, depth + 1)) AS up FROM own_parts) GROUP BY 1)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, coalesce(k.n, 0) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM nodes m JOIN ups u ON u.key = m.key LEFT JOIN kids k ON k.key = m.key
LEFT JOIN nodes p ON m.depth > 0 AND p.key = left(m.key, length(m.key) - 32)"""
