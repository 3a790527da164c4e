"""DuckDB SQL for the queries that SQL can express on whole tables in reasonable time."""

from gleaner.llm import chat, rules

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FAILS = " + ".join(f"CASE WHEN {rule.replace('AND', ' AND ')} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(rules.RULES.values()))

RULES = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, {_WORDS} AS ws FROM d),
  g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
  again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
  covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again CROSS JOIN (SELECT unnest(range(5)) AS k) GROUP BY r),
  lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
  m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(t, '!')) AS n_exclaims FROM w LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
  f AS (SELECT *, CAST({_FAILS} AS BIGINT) AS fail_bits FROM m)
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    fail_bits & {rules.mask("base")} <> 0 AS base_failed, fail_bits & {rules.mask("base")} = 0 AND fail_bits & {rules.mask("v1")} = 0 AS kept, fail_bits FROM f"""

_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS ws FROM documents),
  items AS (SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS ws FROM benchmark),
  each AS (SELECT k, item, i AS j, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
  wins AS (SELECT DISTINCT item, n, gram FROM each),
  sizes AS (SELECT DISTINCT n FROM wins),
  own AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN sizes)),
  hits AS (SELECT r, n, i, item FROM own JOIN wins USING (n, gram)),
  covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, n, i FROM hits) CROSS JOIN (SELECT unnest(range(10)) AS k) WHERE k < n GROUP BY r),
  runs AS (SELECT r, count(*) + 9 AS n FROM (SELECT r, k, i - j AS d, i - row_number() OVER (PARTITION BY r, k, i - j ORDER BY i) AS run FROM own JOIN each USING (n, gram) WHERE n = 10) GROUP BY r, k, d, run),
  most AS (SELECT r, max(n) AS longest FROM (SELECT r, n FROM runs UNION ALL SELECT r, n FROM hits WHERE n < 10) GROUP BY r),
  named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY r)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
  FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r) LEFT JOIN most USING (r)"""

NGRAM_JOIN = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
  sets AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS gram, len(ws) < 5 AS short FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
  sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
  pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sets a JOIN sets b ON a.gram = b.gram AND a.short = b.short AND a.r <> b.r GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
  reach AS (SELECT a AS root, a AS r FROM links UNION SELECT root, b FROM reach JOIN links ON a = reach.r),
  least AS (SELECT root AS r, min(doc_id) AS m FROM reach JOIN d ON d.r = reach.r GROUP BY root)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id FROM d LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)"""

_TEMPLATE = chat.Template()
_CONTROL = "|".join("".join(f"\\{c}" if c in "|[]/<>" else c for c in x) for x in _TEMPLATE.control).replace("\\<", "<").replace("\\>", ">").replace("\\/", "/")

CHAT = rf"""WITH rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({len(_TEMPLATE.begin + _TEMPLATE.middle + _TEMPLATE.end)} + length(role) + length(replace(t, '\', '\\')) + 2 * len(regexp_extract_all(t, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
  FROM rows GROUP BY conv_id"""


def _centroids(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    kept = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {kept})""",
        f"""x AS MATERIALIZED (SELECT r, unnest(range({dims})) AS i, unnest(e) AS x FROM v)""",
        f"""c0 AS MATERIALIZED (SELECT c, i, x FROM (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c FROM v) JOIN x USING (r) WHERE c < {k})""",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, sum((x.x - c{n}.x) * (x.x - c{n}.x)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT c, i, sum(x.x) AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY c, i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{n} LEFT JOIN m{n} USING (c, i))")
    last = f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)"
    return f"""WITH {", ".join([*steps, last])}
  SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
  FROM a{rounds} JOIN v USING (r) JOIN h USING (c)"""


CENTROIDS = _centroids()

EXACT_DEDUP = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, bit: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""


def _leaf(text: str) -> str:
    names = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({n}) || ':' || {n}, '-')" for n in names) + ")"


MANIFEST = f"""WITH RECURSIVE t AS (SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS told FROM documents),
  d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, {_leaf("text")} AS leaf, {_leaf("told")} AS seen FROM t),
  l AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
  up AS (SELECT tree, 0 AS level, idx, n, leaf AS node FROM l UNION ALL SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, level, idx // 16, n),
  top AS (SELECT 0 AS level, tree AS idx, (SELECT count(DISTINCT tree) FROM l) AS n, node FROM up WHERE n = 1 UNION ALL SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 16, n),
  s AS (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after FROM up a JOIN up b ON a.tree = b.tree AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY ALL),
  ts AS (SELECT a.level, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after FROM top a JOIN top b ON a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY ALL),
  p AS (SELECT r, level, before, after FROM l JOIN s ON s.tree = l.tree AND s.idx = l.idx // CAST(16 ** level AS BIGINT) UNION ALL SELECT r, 1000 + level, before, after FROM l JOIN ts ON ts.idx = l.tree // CAST(16 ** level AS BIGINT)),
  g AS (SELECT r, string_agg(before || after, '' ORDER BY level) AS proof, list(before || ':' || after ORDER BY level) AS steps FROM p GROUP BY r),
  o AS (SELECT doc_id, leaf, b.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, list_reduce(list_prepend(seen, coalesce(steps, [])), lambda acc, x: sha256(split_part(x, ':', 1) || acc || split_part(x, ':', 2))) AS folded_root FROM l JOIN up b ON b.tree = l.tree AND b.n = 1 LEFT JOIN g USING (r))
  SELECT *, folded_root = root AS verified FROM o"""
