"""DuckDB SQL for the Merkle manifest with texts tampered where the CRC-32 of the id is even: levels by recursion, one node after another."""


def sized(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR END"


def joined(side: str) -> str:
    return f"coalesce(string_agg(t.h, '' ORDER BY t.place) FILTER (WHERE t.place {side} w.place), '')"


def step(rows: str, tree: str, same: str) -> str:
    """One level up: the node of each row of `rows` with its siblings in `tree`."""
    return f"""
    SELECT w.doc_id, w.source, w.leaf, w.row_place, sha256({joined("<")} || any_value(w.h) || {joined(">")}), any_value(w.proof) || {joined("<>")},
           w.depth + 1, w.place // 3, any_value((w.n + 2) // 3)
    FROM {rows} w JOIN {tree} t ON t.depth = w.depth AND t.place // 3 = w.place // 3 {same}
    WHERE w.n > 1 GROUP BY w.doc_id, w.source, w.leaf, w.row_place, w.depth, w.place"""


MANIFEST_SQL = f"""
WITH RECURSIVE
-- CRC-32 of the id's digits: a value from 256 on brings a byte, each 1 behind it shifts by one bit. Its last step, which flips all bits, is left out.
crcs AS (
    SELECT *, list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [(256 + ascii(c))::UBIGINT, 1, 1, 1, 1, 1, 1, 1, 1])),
        lambda a, b: CASE WHEN b > 1 THEN xor(a, b - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END) AS flipped
    FROM documents
),
fields AS (
    SELECT doc_id, source, text, {sized("doc_id")} || {sized("source")} || {sized("lang")} || {sized("n_chars")} AS head,
           CASE WHEN doc_id IS NOT NULL AND flipped % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS presented
    FROM crcs
),
hashed AS (SELECT doc_id, source, sha256(head || {sized("text")}) AS leaf, sha256(head || {sized("presented")}) AS presented FROM fields),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM hashed
),
tree AS (
    SELECT source, 0 AS depth, place, leaf AS h, n FROM leaves
    UNION ALL
    SELECT source, depth + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 2) // 3) FROM tree WHERE n > 1 GROUP BY source, depth, place // 3
),
subroots AS (
    SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1
),
upper_tree AS (
    SELECT 0 AS depth, place, h, n FROM subroots
    UNION ALL
    SELECT depth + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 2) // 3) FROM upper_tree WHERE n > 1 GROUP BY depth, place // 3
),
walk AS (
    SELECT doc_id, source, leaf, place AS row_place, presented AS h, '' AS proof, 0 AS depth, place, n FROM leaves
    UNION ALL {step("walk", "tree", "AND t.source IS NOT DISTINCT FROM w.source")}
),
upper_walk AS (
    SELECT w.doc_id, w.source, w.leaf, w.row_place, w.h, w.proof, 0 AS depth, s.place, s.n FROM walk w JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
    UNION ALL {step("upper_walk", "upper_tree", "")}
)
SELECT u.doc_id, u.leaf, s.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
FROM upper_walk u JOIN subroots s ON s.source IS NOT DISTINCT FROM u.source CROSS JOIN (SELECT h FROM upper_tree WHERE n = 1) r WHERE u.n = 1
"""
