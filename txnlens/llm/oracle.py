"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_HOST = r"translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS p FROM w)),
first AS (SELECT win, min(doc_id) AS doc_id FROM s GROUP BY win),
gone AS (SELECT DISTINCT s.doc_id, unnest(range(s.p, s.p + 13)) AS p FROM s JOIN first USING (win) WHERE first.doc_id < s.doc_id),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, words, list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(coalesce(ps, []), x[2])) AS left_over
      FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(left_over))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(left_over, lambda x: x[1]), ' '), '')) AS kept_sha256
FROM k""",
    "op2_mix_sources": """
WITH RECURSIVE size AS (SELECT coalesce(source, '') AS source, COUNT(*) AS n FROM documents GROUP BY 1),
whole AS (SELECT SUM(n)::DOUBLE AS rows, SUM(pow(n::DOUBLE, 0.5)) AS weight FROM size),
rate AS (SELECT source, rows * pow(n::DOUBLE, 0.5) / weight / n AS rate FROM size, whole),
part AS (SELECT source, greatest(1, CAST(ceil(rate / 16.0) AS INTEGER)) AS parts, rate / greatest(1, ceil(rate / 16.0)) AS mean FROM rate),
term AS (
    SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS sum FROM part
    UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), sum + p * mean / (k + 1) FROM term WHERE k < 96
),
draw AS (
    SELECT row, source, CAST('0x' || md5('1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) || ':' || j)[1:13] AS BIGINT) / 4503599627370496.0 AS u
    FROM (SELECT doc_id, text, source, row, unnest(range(1, parts + 1)) AS j FROM (SELECT doc_id, text, coalesce(source, '') AS source, row_number() OVER () AS row FROM documents) a JOIN part USING (source)) d
),
drawn AS (SELECT row, CAST(COUNT(*) AS INTEGER) AS n FROM draw JOIN term USING (source) WHERE sum <= u GROUP BY row)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM (SELECT *, row_number() OVER () AS row FROM documents) d JOIN drawn USING (row)""",
    "op3_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(words[p:p + 2], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS p FROM w WHERE len(words) > 0) t
),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
both_ways AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
    SELECT a, b FROM both_ways JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
),
reach AS (SELECT a, a AS b FROM (SELECT DISTINCT a FROM link) t UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a, MIN(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.b, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id""",
    "op6_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, p, h[2 * p - 1:2 * p + 98] AS str FROM (SELECT doc_id, h, unnest(range(1, greatest(len(h) // 2 - 48, 1))) AS p FROM d) t),
first AS (SELECT str, MIN(doc_id) AS doc_id FROM s GROUP BY str),
late AS (SELECT s.doc_id, p, TRUE AS late FROM s JOIN first USING (str) WHERE first.doc_id < s.doc_id),
b AS (SELECT doc_id, unnest(range(1, len(h) // 2 + 1)) AS p, unnest(string_split_regex(regexp_replace(h, '(..)', '\\1 ', 'g'), ' ')[1:len(h) // 2]) AS byte FROM d),
g AS (SELECT doc_id, p, byte, MAX(CASE WHEN late THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM b LEFT JOIN late USING (doc_id, p)),
m AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS opens FROM g),
r AS (SELECT doc_id, COUNT(*) FILTER (gone) AS n_removed, COUNT(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
t AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS tokens FROM l),
leaf AS (SELECT doc_id, pos, line, tokens, len(tokens) AS n, list_transform(tokens[1:6], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS lead FROM t),
shared AS (SELECT n, lead FROM leaf WHERE n > 0 GROUP BY n, lead HAVING COUNT(DISTINCT doc_id) >= 3),
c AS (SELECT leaf.* FROM leaf JOIN shared USING (n, lead)),
token AS (SELECT n, lead, i, x, COUNT(*) AS k FROM (SELECT n, lead, unnest(range(7, n + 1)) AS i, unnest(tokens[7:]) AS x FROM c) u GROUP BY ALL),
fixed AS (SELECT n, lead, list(i) AS places FROM (SELECT n, lead, i FROM token GROUP BY n, lead, i HAVING 2 * MAX(k) >= SUM(k)) u GROUP BY n, lead),
general AS (
    SELECT c.*, list_transform(list_zip(tokens, range(1, n + 1)), lambda x:
        CASE WHEN regexp_matches(x[1], '[0-9]') OR x[2] > 6 AND NOT list_contains(coalesce(places, []), x[2]) THEN '<*>' ELSE x[1] END) AS template
    FROM c LEFT JOIN fixed USING (n, lead)
),
line AS (
    SELECT doc_id, pos, CASE WHEN 2 * len(list_filter(template, lambda x: x <> '<*>')) < n THEN tokens ELSE template END AS template,
        2 * len(list_filter(template, lambda x: x <> '<*>')) < n AS plain FROM general
),
often AS (SELECT plain, template, MIN(doc_id) AS first FROM line GROUP BY plain, template HAVING COUNT(DISTINCT doc_id) >= 3),
gone AS (SELECT doc_id, pos, TRUE AS gone FROM line JOIN often USING (plain, template) WHERE doc_id > first),
m AS (SELECT DISTINCT l.doc_id, l.pos, line, coalesce(gone, FALSE) AS gone FROM l LEFT JOIN gone USING (doc_id, pos)),
r AS (SELECT doc_id, bool_or(gone) AS changed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, CASE WHEN changed THEN r.text ELSE d.text END AS text, lang, source, CASE WHEN changed THEN length(r.text) ELSE n_chars END AS n_chars
FROM documents d LEFT JOIN r USING (doc_id)""",
    "op8_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || path, '(?:[^A-Za-z0-9]|^)(?:casino|cheap|pills|bets|viagra|porn)(?:[^A-Za-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op10_embedding_dedup": """
WITH RECURSIVE link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93
),
n AS (SELECT a, COUNT(*) AS n FROM link GROUP BY a),
reach AS (SELECT a, a AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a, MIN(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(low.b, vec_id) AS component_id, coalesce(low.b, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id""",
    "op12_spelling_variants": """
WITH RECURSIVE bits AS (
    SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
),
crc AS (SELECT i, v FROM bits WHERE k = 8),
run AS (
    SELECT doc_id, run, COUNT(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
    ) t WHERE length(run) >= 6 GROUP BY 1, 2
),
sum AS (
    SELECT DISTINCT h, 0 AS p, 4294967295 AS c FROM run
    UNION ALL SELECT h, p + 1, xor(c >> 8, v) FROM sum JOIN crc ON crc.i = xor(c, ('0x' || h[2 * p + 1:2 * p + 2])::BIGINT) & 255 WHERE 2 * p < len(h)
),
code AS (SELECT h, xor(c, 4294967295) AS code FROM sum WHERE 2 * p = len(h)),
counted AS (
    SELECT CASE WHEN code % 199 = 0 THEN substr(run, 1, (code % length(run))::INT) || substr(run, (code % length(run))::INT + 2) ELSE run END AS word, n
    FROM run JOIN code USING (h)
),
w AS (SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM counted WHERE length(word) >= 6 GROUP BY 1 HAVING SUM(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w) t),
pair AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, w.word, w.n FROM less a JOIN w ON w.word = a.rest
    UNION SELECT w.word, w.n, a.word, a.n FROM less a JOIN w ON w.word = a.rest
),
best AS (SELECT word, n, other, other_n, COUNT(*) OVER (PARTITION BY word) AS n_near FROM pair QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
form AS (SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= 5 * n),
chain AS (
    SELECT word, form AS up FROM form UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.up
),
last AS (SELECT chain.word, chain.up AS root FROM chain ANTI JOIN form ON form.word = chain.up)
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n
FROM w LEFT JOIN best USING (word) LEFT JOIN form USING (word) LEFT JOIN last USING (word)""",
    "op13_collocations": r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
s AS (SELECT lang, words[i:i + 4] AS words FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w) t),
f AS (
    SELECT lang, words[1:m] AS words, CAST(COUNT(*) AS BIGINT) AS f FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS m FROM s) t GROUP BY 1, 2
),
n AS (SELECT lang, CAST(SUM(f) AS BIGINT) AS n FROM f WHERE len(words) = 1 GROUP BY 1),
c AS (SELECT lang, words, f AS a FROM f WHERE len(words) >= 2 AND f >= 100),
cut AS (SELECT lang, words, a, k, words[1:k] AS head, words[k + 1:] AS rest FROM (SELECT *, unnest(range(1, len(words))) AS k FROM c) t),
scored AS (
    SELECT cut.lang, cut.words, a, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * a * n.n // (x.f::HUGEINT * y.f))::BIGINT AS score, k
    FROM cut JOIN f x ON x.lang = cut.lang AND x.words = cut.head JOIN f y ON y.lang = cut.lang AND y.words = cut.rest JOIN n ON n.lang = cut.lang
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
part AS (
    SELECT DISTINCT lang, words[i:i + m - 1] AS words, a FROM (
        SELECT lang, words, a, i, unnest(range(1, len(words) - i + 2)) AS m FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM c) t) u
    WHERE m < len(words)
),
inside AS (SELECT DISTINCT c.lang, c.words FROM c JOIN part USING (lang, words) WHERE 100 * part.a >= 100 * c.a),
kept AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM weakest ANTI JOIN inside USING (lang, words))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000""",
}
