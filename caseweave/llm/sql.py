"""DuckDB SQL of those queries that SQL can express over whole tables: plain joins, no hashing.

The other operators end in trained models, tokenizers or hashes of their own and are tested against
brute force instead.
"""

# Words as the shingles and the rules take them, of whole texts.
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NEAR_DOCUMENTS = rf"""
WITH RECURSIVE
doc AS (
  SELECT doc_id, {WORDS.format(text="translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, ws[i:i + 3] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM doc WHERE len(ws) >= 4) q
    UNION ALL SELECT doc_id, ws FROM doc WHERE len(ws) BETWEEN 1 AND 3
  ) s
),
size AS (SELECT doc_id, COUNT(*) AS n FROM shingle GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN link ON x = doc_id),
least AS (SELECT doc_id, MIN(root) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN size USING (doc_id)
"""

RULES = rf"""
WITH doc AS (SELECT doc_id, COALESCE(text, '') AS text, {WORDS.format(text="COALESCE(text, '')")} AS ws FROM documents),
gram AS (
  SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS times
  FROM (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM doc WHERE len(ws) >= 5) q) r
),
repeated AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM gram, range(0, 5) AS t(k) WHERE times > 1 GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc),
lines AS (SELECT doc_id, COUNT(*) AS n, COUNT(DISTINCT line) AS different FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
measured AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, COALESCE(lines.n, 0) AS n_lines,
         COALESCE(lines.n - lines.different, 0) AS n_dup_lines, COALESCE(repeated.n, 0) AS n_repeat_words
  FROM doc LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
),
ledger AS (
  SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 2 * n_words)::INT
         + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars > 25 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT AS failures
  FROM measured
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failures & 3 <> 0 AS base_failed,
       failures = 0 AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(failures AS BIGINT) AS failures, 'full-1' AS policy
FROM ledger
"""

NEAR_VECTORS = """
WITH RECURSIVE
vec AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
good AS (
  SELECT vec_id, v FROM vec
  WHERE len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in v if x <> 0]) > 0
),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT y, root FROM reach JOIN link ON x = vec_id),
least AS (SELECT vec_id, MIN(root) AS component_id FROM reach GROUP BY 1),
links AS (SELECT x AS vec_id, COUNT(*) AS n FROM link GROUP BY 1)
SELECT vec_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN links USING (vec_id)
"""

SQL: dict[str, str] = {"op5_minhash_near_dedup": NEAR_DOCUMENTS, "op7_quality_rules": RULES, "op9_vector_near_dedup": NEAR_VECTORS}
