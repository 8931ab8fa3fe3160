"""SQL that is put together from repeated steps: checksums, tree levels, prefixes."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text: each byte is met, then eight shifts (marked -1) follow."""
    shifts = ", ".join(["-1"] * 8)
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), {shifts}]))"
    step = "CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, CASE WHEN acc % 2 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce({steps}, lambda acc, x: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def merkle_sql(levels: int = 7, top_levels: int = 4) -> str:
    """The manifest for up to 8 ** levels rows of a language and 8 ** top_levels languages, a level at a time."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS found
  FROM documents),
a0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS pos, leaf AS h, doc_id, leaf, found FROM leaves)"""

    def climb(name: str, count: int) -> str:
        out = ""
        for level in range(count):
            out += f""",
{name}s{level} AS (
  SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) AS w, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{level} WINDOW run AS (PARTITION BY tree, pos // 8 ORDER BY pos)),
{name}{level + 1} AS (
  SELECT tree, pos // 8 AS pos, CASE WHEN max(w) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}s{level} GROUP BY tree, pos // 8)"""
        return out

    sql += climb("a", levels)
    sql += f""",
b0 AS (SELECT 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, tree AS lang FROM a{levels})"""
    sql += climb("b", top_levels)
    joins, fold, proof = "", "x.found", []
    steps = [("a", k, f"x.tree = a{k}_.tree AND x.pos // {8**k} = a{k}_.pos") for k in range(levels)] + [("b", k, f"y.pos // {8**k} = b{k}_.pos") for k in range(top_levels)]
    columns = []
    for name, k, on in steps:
        joins += f"\n  JOIN {name}s{k} {name}{k}_ ON {on}"
        columns.append(f"{name}{k}_.w AS {name}w{k}, {name}{k}_.l AS {name}l{k}, {name}{k}_.r AS {name}r{k}")
        proof.append(f"CASE WHEN {name}{k}_.w > 1 THEN {name}{k}_.l || {name}{k}_.r ELSE '' END")
    sql += f""",
f0 AS (
  SELECT x.doc_id, x.leaf, y.h AS subroot, root.h AS root, sha256({" || ".join(proof)}) AS proof_sha256, x.found AS f, {", ".join(columns)}
  FROM a0 x JOIN b0 y ON y.lang = x.tree CROSS JOIN b{top_levels} root{joins})"""
    for i, (name, k, _) in enumerate(steps):
        sql += f""",
f{i + 1} AS (SELECT * REPLACE (CASE WHEN {name}w{k} > 1 THEN sha256({name}l{k} || f || {name}r{k}) ELSE f END AS f) FROM f{i})"""
    return sql + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}"


PREFIX_TRIE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS xs, list(words ORDER BY turn NULLS FIRST, x) AS ws,
         {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h
  FROM t GROUP BY conv_id),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.xs[1:c.h], []), c.xs[c.h + 1:]) AS xs, list_concat(coalesce(b.ws[1:c.h], []), c.ws[c.h + 1:]) AS ws
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - ((c.conv_id % 20) + 20) % 20),
steps AS (SELECT conv_id, xs, ws, len(xs) AS n, unnest(range(0, len(xs) + 1)) AS depth FROM built),
path AS (SELECT conv_id, n, depth, array_to_string(xs[1:depth], ',') AS p, array_to_string(xs[1:greatest(depth - 1, 0)], ',') AS up, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS words FROM steps),
node AS (
  SELECT p, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM path GROUP BY p, depth),
kids AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY up, depth),
told AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON kids.up = node.p AND kids.depth = node.depth),
-- Each node lies below the prefixes of its smallest member.
sums AS (
  SELECT path.p, path.depth, CAST(sum(CASE WHEN told.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((told.n_convs - 1) * told.words) AS BIGINT) AS saved_tokens
  FROM told JOIN path ON path.conv_id = told.conv_id AND path.depth <= told.depth GROUP BY path.p, path.depth)
SELECT told.conv_id, told.depth, parent.conv_id AS parent_conv_id, told.n_convs, told.n_children, sums.n_leaves, sums.saved_tokens, told.ends_sha256
FROM told JOIN sums ON sums.p = told.p AND sums.depth = told.depth LEFT JOIN told parent ON told.depth > 0 AND parent.p = told.up AND parent.depth = told.depth - 1"""
