"""The same results as plain SQL (DuckDB dialect) over the given tables, for comparison."""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the engine shows.
DATA_WORDS = (
    "rate", "trend", "daily", "monthly", "time series", "merchant", "category", "transaction", "amount", "volume",
    "count", "share", "proportion", "distribution",
)
DOCUMENT_WORDS = (
    "application fraud", "lost/stolen", "lost or stolen", "counterfeit", "skimming", "merchant collusion",
    "triangulation", "internet", "site cloning", "neural network", "fraud detection system", "total cost of fraud",
    "prevention", "white paper",
)
DENIED = ("insert ", "update ", "delete ", "drop ", "create ", "alter ", "truncate ")

SPACE = r"\s\x{0B}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

METRICS = """
    CAST(COUNT(*) AS BIGINT) AS total_tx,
    CAST(SUM(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_tx,
    ROUND(SUM(CASE WHEN is_fraud = 1 THEN 1.0::DOUBLE ELSE 0 END) / NULLIF(COUNT(*), 0), 6) AS fraud_rate,
    ROUND(SUM(amt), 2) AS total_amount,
    ROUND(SUM(CASE WHEN is_fraud = 1 THEN amt ELSE 0 END), 2) AS fraud_amount,
    ROUND(SUM(CASE WHEN is_fraud = 1 THEN amt ELSE 0 END) / NULLIF(SUM(amt), 0), 6) AS fraud_share_by_value
"""


def calendar(day: str) -> str:
    return f"""
    CAST(year({day}) AS INTEGER) AS year, CAST(month({day}) AS INTEGER) AS month,
    CAST(day({day}) AS INTEGER) AS day, dayname({day}) AS day_of_week,
    dayname({day}) IN ('Saturday', 'Sunday') AS is_weekend, strftime({day}, '%Y-%m') AS year_month"""


EVENTS = f"""
ev AS (
    SELECT event_id AS ord, ts AS trans_ts, CAST(user_id AS VARCHAR) AS cc_num,
        'm' || k AS merchant, 'c' || (k % 7) AS category, value AS amt,
        'First' || user_id AS "first", 'Last' || (user_id % 50) AS "last",
        CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        user_id || ' Main St' AS street, 'City' || (event_id % 40) AS city, 'S' || (user_id % 50) AS state,
        CAST(10000 + user_id * 7 AS VARCHAR) AS zip,
        CAST((user_id * 7) % 180 - 90 AS DOUBLE) AS lat, CAST((user_id * 13) % 360 - 180 AS DOUBLE) AS long,
        user_id * 1000 + event_id % 10 AS city_pop, 'Job' || (user_id % 12) AS job,
        CAST(DATE '1940-01-01' + CAST((user_id * 137) % 20000 AS INTEGER) AS DATE) AS dob,
        't' || event_id AS trans_num, epoch_us(ts) // 1000000 AS unix_time,
        CAST((event_id * 3) % 180 - 90 AS DOUBLE) AS merch_lat, CAST((event_id * 11) % 360 - 180 AS DOUBLE) AS merch_long,
        CAST(event_type = 'error' AS SMALLINT) AS is_fraud,
        CASE WHEN event_id % 4 = 3 THEN 'test' ELSE 'train' END AS split,
        CAST(ts AS DATE) AS trans_date, CAST(hour(ts) AS INTEGER) AS hour, {calendar('ts')}
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
),
gaps AS (
    SELECT * EXCLUDE (merchant, amt),
        CASE WHEN CAST(substr(merchant, 2) AS INTEGER) < 95 THEN merchant END AS merchant,
        CASE WHEN amt >= 1.0 THEN amt END AS amt
    FROM ev
)"""

DISTANCE = """2 * 6371.0 * asin(sqrt(least(1.0,
    pow(sin(radians(merch_lat - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(merch_lat)) * pow(sin(radians(merch_long - long) / 2), 2))))"""


def ids(source: str, key: str, name: str) -> str:
    """Key table: ids by first appearance, 0 for null."""
    return f"""
    SELECT {key}, CASE WHEN {key} IS NULL THEN 0 ELSE row_number() OVER (ORDER BY {key} IS NULL, MIN(ord)) END AS {name},
        MIN(ord) AS first_ord, COUNT(*) AS n_rows
    FROM {source} GROUP BY {key}"""


CUSTOMER_COLUMNS = 'customer_id, cc_num, "first", "last", gender, street, city, state, zip, lat, long, city_pop, job, dob'
STAR = f"""
{EVENTS},
k_customer AS ({ids('ev', 'cc_num', 'customer_id')}), k_merchant AS ({ids('ev', 'merchant', 'merchant_id')}),
k_category AS ({ids('ev', 'category', 'category_id')}), k_date AS ({ids('ev', 'trans_date', 'date_id')}),
d_customer AS (SELECT k.customer_id, e.* FROM k_customer k JOIN ev e ON e.ord = k.first_ord),
d_merchant AS (SELECT k.merchant_id, e.merchant AS merchant_name, e.merch_lat, e.merch_long FROM k_merchant k JOIN ev e ON e.ord = k.first_ord),
fact AS (
    SELECT row_number() OVER (ORDER BY e.ord) AS transaction_id, e.trans_num, c.customer_id, m.merchant_id, g.category_id,
        d.date_id, e.trans_ts, e.unix_time, e.amt, e.is_fraud, e.year, e.month, e.hour, e.is_weekend,
        ROUND({DISTANCE}, 4) AS cust_merch_distance_km, e.split
    FROM ev e JOIN k_customer c USING (cc_num) JOIN k_merchant m USING (merchant)
        JOIN k_category g USING (category) JOIN k_date d USING (trans_date)
)"""

LINES = f"""
cat AS (
    SELECT p_type AS category_name, row_number() OVER (ORDER BY MIN(p_partkey)) AS category_id FROM part GROUP BY p_type
),
fact AS (
    SELECT l.*, o_custkey AS customer_id, l_suppkey AS merchant_id, category_id, category_name, s_name AS merchant_name,
        CAST(l_shipdate AS DATE) AS trans_date, l_shipdate AS trans_ts, l_extendedprice AS amt,
        CAST(l_returnflag = 'R' AS SMALLINT) AS is_fraud, CAST(hour(l_shipdate) AS INTEGER) AS hour, {calendar('l_shipdate')}
    FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN cat ON category_name = p_type JOIN supplier ON l_suppkey = s_suppkey
)"""

DAILY = "trans_date, year, month, day, day_of_week, is_weekend, year_month"


def loaded_ids(key: str, name: str) -> str:
    """Key table after a load of even and one of odd events: ids by first appearance, load after load, 0 for null."""
    return f"""
    SELECT {key}, CASE WHEN {key} IS NULL THEN 0 ELSE row_number() OVER (ORDER BY {key} IS NULL, load, first_ord) END AS {name}
    FROM (SELECT {key}, MIN(ord % 2) AS load, coalesce(MIN(ord) FILTER (ord % 2 = 0), MIN(ord)) AS first_ord FROM gaps GROUP BY {key}) t"""


LOADED = f"""
{EVENTS},
k_customer AS ({loaded_ids('cc_num', 'customer_id')}), k_merchant AS ({loaded_ids('merchant', 'merchant_id')}),
k_category AS ({loaded_ids('category', 'category_id')}), k_date AS ({loaded_ids('trans_date', 'date_id')}),
fact AS (
    SELECT row_number() OVER (ORDER BY e.ord % 2, e.ord) AS transaction_id, e.trans_num, c.customer_id, m.merchant_id, g.category_id,
        d.date_id, e.trans_ts, e.unix_time, e.amt, e.is_fraud, e.year, e.month, e.hour, e.is_weekend,
        ROUND({DISTANCE}, 4) AS cust_merch_distance_km, e.split
    FROM gaps e JOIN k_customer c USING (cc_num) JOIN k_merchant m ON e.merchant IS NOT DISTINCT FROM m.merchant
        JOIN k_category g USING (category) JOIN k_date d USING (trans_date)
)"""


def grouped(groups: str) -> str:
    return f"SELECT {groups}, {METRICS} FROM fact GROUP BY {groups}"


STYLED = "CASE pos % 7 WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 END"
_ELEMENTS = rf"""
lines AS (
    SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS raw
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d
),
clean AS (
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(raw, '[{SPACE}]+', ' ', 'g')) AS text,
        STYLED AS styled
    FROM lines
),
tested AS (
    SELECT *, regexp_replace(text, '[^A-Za-z]', '', 'g') AS letters FROM clean WHERE text <> ''
),
el AS (
    SELECT doc_id, pos, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS type, CAST(level AS INTEGER) AS level, text
    FROM (
        SELECT *, CASE WHEN styled IS NOT NULL THEN styled
            WHEN length(letters) > 3 AND letters = upper(letters) AND len(string_split(text, ' ')) <= 6 THEN 2 END AS level
        FROM tested
    ) t
)"""

ELEMENTS = _ELEMENTS.replace("STYLED", STYLED)

_BLOCKS = """
seg AS (
    SELECT *, COUNT(level) OVER w AS seg, COUNT(CASE WHEN level = 1 THEN 1 END) OVER w AS secn,
        last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS section
    FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
sub AS (
    SELECT *, last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER
        (PARTITION BY doc_id, secn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS subsection
    FROM seg
),
bl AS (
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS INTEGER) AS block_index, section, subsection, text
    FROM (
        SELECT doc_id, seg, MAX(section) AS section, MAX(subsection) AS subsection, string_agg(text, ' ' ORDER BY pos) AS text
        FROM sub WHERE level IS NULL OR level NOT IN (1, 2) GROUP BY doc_id, seg
    ) t
)"""


BLOCKS = f"{ELEMENTS}, {_BLOCKS}"
PLAIN_BLOCKS = f"{_ELEMENTS.replace('STYLED', 'CAST(NULL AS INTEGER)')}, {_BLOCKS}"


def sentence_list(text: str) -> str:
    marked = rf"regexp_replace({text}, '([.!?])[{SPACE}]+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s, {BLANKS})), lambda s: s <> '')"


def chunked(mode: str, blocks: str = BLOCKS) -> str:
    """Chunks of the blocks, as a fold over (number of words, state) pairs."""
    restart = "greatest(acc.first, x.i - 1)" if mode == "greedy" else "x.i"
    words = "acc.last + x.n" if mode == "greedy" else "x.n"
    low, high = ("r.a", "r.b") if mode == "greedy" else ("greatest(0, r.a - 1)", "least(len(s) - 1, r.b + 1)")
    return f"""
    {blocks},
    cut AS (SELECT *, {sentence_list('text')} AS s FROM bl),
    state AS (
        SELECT *, list_reduce(
            list_transform(s, lambda t, i: {{'i': i - 1, 'n': len(string_split(t, ' ')), 'first': 0::BIGINT,
                'words': len(string_split(t, ' ')), 'last': len(string_split(t, ' ')), 'done': []::STRUCT(a BIGINT, b BIGINT)[]}}),
            lambda acc, x: CASE WHEN acc.words + x.n > 256
                THEN {{'i': x.i, 'n': x.n, 'first': {restart}, 'words': {words}, 'last': x.n,
                    'done': list_append(acc.done, {{'a': acc.first, 'b': x.i - 1}})}}
                ELSE {{'i': x.i, 'n': x.n, 'first': acc.first, 'words': acc.words + x.n, 'last': x.n, 'done': acc.done}} END
        ) AS f FROM cut WHERE len(s) > 0
    ),
    ranges AS (
        SELECT doc_id, section, subsection, block_index, s, unnest(range(len(f.done) + 1)) AS chunk_index,
            unnest(list_append(f.done, {{'a': f.first, 'b': f.i}})) AS r
        FROM state
    ),
    ch AS (
        SELECT doc_id, section, subsection, block_index, CAST(chunk_index AS INTEGER) AS chunk_index,
            array_to_string(s[{low} + 1 : {high} + 1], ' ') AS text,
            sha256(doc_id || '|' || block_index || '|' || chunk_index) AS h
        FROM ranges
    ),
    chunk AS (
        SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS chunk_id, * EXCLUDE (h)
        FROM ch
    )"""


def stats(source: str) -> str:
    return f"""
    SELECT COUNT(*) AS n_texts, CAST(SUM(c) AS BIGINT) AS n_chars, CAST(SUM(w) AS BIGINT) AS n_words,
        ROUND(AVG(c), 6) AS chars_per_text, ROUND(AVG(w), 6) AS words_per_text, MIN(w) AS min_words, MAX(w) AS max_words
    FROM (SELECT length(text) AS c, len(string_split(text, ' ')) AS w FROM {source}) t"""


def word_set(text: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


def overlap(query: str, text: str) -> str:
    return f"coalesce(len(list_intersect({word_set(query)}, {word_set(text)})) / nullif(len({word_set(query)}), 0), 0.0)"


HITS = """
mean AS (
    SELECT label, nr, AVG(CAST(x AS DOUBLE)) AS x
    FROM (SELECT label, unnest(range(len(embedding))) AS nr, unnest(embedding) AS x FROM embeddings) t GROUP BY label, nr
),
lv AS (SELECT label, list(x ORDER BY nr) AS v FROM mean GROUP BY label),
q AS (SELECT item_id AS query_id, v FROM benchmark JOIN lv ON label = item_id % 10),
s AS (
    SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score
    FROM q, embeddings
),
hits AS (
    SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ROUND(score, 7) DESC, id) AS INTEGER) AS dense_rank
    FROM s
)"""


def reranked(k: int) -> str:
    return f"""
    {HITS},
    rr AS (
        SELECT h.*, d.source AS section, d.lang AS subsection, {overlap('b.text', 'd.text')} AS rerank_score
        FROM hits h JOIN benchmark b ON b.item_id = h.query_id LEFT JOIN documents d ON d.doc_id = h.id
        WHERE dense_rank <= {k}
    ),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, dense_rank) AS INTEGER) AS rank FROM rr
    )"""


def has_any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def routed(label: str | None) -> str:
    by_words = (
        f"CASE WHEN {has_any('question', DATA_WORDS)} THEN 'data' WHEN {has_any('question', DOCUMENT_WORDS)} "
        "THEN 'document' ELSE 'none' END"
    )
    if label is None:
        return by_words
    given = f"lower(trim({label}, {BLANKS}))"
    return f"CASE WHEN {given} IN ('data', 'document', 'none') THEN {given} ELSE {by_words} END"


QUESTIONS = """
qs AS (
    SELECT conv_id, turn, conv_id || '-' || turn AS question_id, text AS question,
        CASE length(text) % 5 WHEN 0 THEN 'data' WHEN 1 THEN ' Document' || chr(10) WHEN 2 THEN 'none' WHEN 3 THEN 'other' END AS label
    FROM conversations WHERE role = 'user'
)"""

ANSWERS = f"""
{QUESTIONS},
piece AS (
    SELECT conv_id, turn - 1 AS turn, unnest(range(len(s))) AS nr, unnest(s) AS text
    FROM (SELECT *, {sentence_list('text')} AS s FROM conversations WHERE role = 'assistant') c
),
pair AS (
    SELECT question_id, nr + 1 AS dense_rank, 'conversation ' || p.conv_id AS section,
        CASE WHEN nr % 2 = 1 THEN 'sentence ' || nr END AS subsection, text, {overlap('question', 'text')} AS rerank_score
    FROM piece p JOIN qs ON qs.conv_id = p.conv_id AND qs.turn = p.turn
),
hit AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, dense_rank) AS rank FROM pair) t
    WHERE rank <= 10
),
ans AS (
    SELECT question_id, conv_id, question, {routed('label')} AS answer_type, length(question) AS len,
        CASE length(question) % 6 WHEN 0 THEN '0.8' WHEN 1 THEN ' 1.7 ' WHEN 2 THEN '-2' WHEN 3 THEN 'n/a'
            WHEN 4 THEN '0.' || length(question) ELSE '' END AS judge
    FROM qs
),
result AS (
    SELECT question_id, event_type, COUNT(*) AS n
    FROM ans JOIN events ON user_id = conv_id WHERE answer_type = 'data' GROUP BY question_id, event_type
),
based AS (
    SELECT ans.*, coalesce(n_rows, 0) AS n_rows, coalesce(n_hits, 0) AS n_hits,
        CASE WHEN answer_type = 'data' THEN
                CASE WHEN coalesce(n_rows, 0) = 0 THEN 0.3 WHEN len % 9 = 0 THEN 0.5 ELSE 0.75 END
            WHEN n_hits > 0 THEN 0.6 + 0.3 * (1 / (1 + pow(2.71828, -mean_rerank)))
            ELSE 0.3 END AS base_score
    FROM ans
        LEFT JOIN (SELECT question_id, COUNT(*) AS n_rows FROM result GROUP BY question_id) USING (question_id)
        LEFT JOIN (SELECT question_id, COUNT(*) AS n_hits, AVG(rerank_score) AS mean_rerank FROM hit GROUP BY question_id) USING (question_id)
),
final AS (
    SELECT *, (base_score + coalesce(CASE WHEN j > 1 THEN 1.0 WHEN j < 0 THEN 0.0 ELSE j END, base_score)) / 2 AS quality_score
    FROM (SELECT *, TRY_CAST(trim(judge) AS DOUBLE) AS j FROM based) b
)"""


def oneline(text: str, n: int) -> str:
    return f"substr(replace({text}, chr(10), ' '), 1, {n})"


def buckets(role: str, text: str) -> str:
    """Numbers of the words of a text, the role before it, below 256."""
    words = rf"list_filter(regexp_split_to_array(lower('{role}: ' || coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: CAST(CAST('0x' || md5(w)[1:8] AS BIGINT) % 256 AS INTEGER))"


def word_vectors(name: str, source: str, key: str, role: str, text: str) -> str:
    """``name (key, pos, x)``: the components that are not zero, in single precision."""
    return f"""
    {name}_count AS (
        SELECT {key}, pos, COUNT(*) AS n FROM (SELECT {key}, unnest({buckets(role, text)}) AS pos FROM {source}) t GROUP BY {key}, pos
    ),
    {name} AS (
        SELECT {key}, pos, CAST(n / sqrt(SUM(n * n) OVER (PARTITION BY {key})) AS FLOAT)::DOUBLE AS x FROM {name}_count
    )"""


def word_type(token: str) -> str:
    """The word of a token: lower case, without marks around it and stops at its end."""
    return f"regexp_replace(regexp_replace(lower({token}), '^[^\\pL\\pN]+|[^\\pL\\pN.]+$', '', 'g'), '\\.+$', '')"


def likelihood(k: str, n: str, p: str) -> str:
    return f"((CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END) + (CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END))"


def stop_words(source: str) -> str:
    """Words that occur with a stop, scored as abbreviations."""
    inner = "regexp_replace(lower(token), '^[^\\pL\\pN]+|[^\\pL\\pN.]+$', '', 'g')"
    return f"""
    tok AS (SELECT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '')) AS token FROM {source}),
    c AS (SELECT {word_type('token')} AS word, COUNT(*) AS n, CAST(SUM(CASE WHEN {inner} LIKE '%.' THEN 1 ELSE 0 END) AS BIGINT) AS n_stop
          FROM tok WHERE regexp_matches({word_type('token')}, '\\pL') GROUP BY 1),
    m AS (SELECT *, n::DOUBLE AS dn, n_stop::DOUBLE AS dk, len(regexp_replace(word, '[^.]', '', 'g')) AS inside, greatest(least((SELECT SUM(n_stop) / SUM(n) FROM c), 1 - 1e-9), 1e-9) AS rate FROM c WHERE n_stop > 0),
    scored AS (SELECT word, n, n_stop, 2 * ({likelihood('dk', 'dn', '0.99')} - {likelihood('dk', 'dn', 'rate')})
        * exp(-(len(word) - inside)) * (inside + 1) * pow((len(word) - inside)::DOUBLE, -(dn - dk)) AS score FROM m)"""


ORACLE = {
    "txn_typed": f"WITH {EVENTS} SELECT trans_num, trans_ts, cc_num, zip, dob FROM ev",
    "txn_union": f"""WITH {EVENTS} SELECT row_number() OVER (ORDER BY split = 'test', ord) AS transaction_id, trans_num, split FROM ev""",
    "txn_calendar": f"""WITH {EVENTS} SELECT trans_num, trans_date, year, month, day, year_month, day_of_week, hour, is_weekend FROM ev""",
    "txn_age": f"""WITH {EVENTS} SELECT trans_num, ROUND(date_diff('day', dob, trans_date) / 365.25::DOUBLE, 6) AS age_at_txn_years FROM ev""",
    "txn_distance": f"WITH {EVENTS} SELECT trans_num, ROUND({DISTANCE}, 4) AS cust_merch_distance_km FROM ev",
    "surrogate_keys": f"WITH {EVENTS} {ids('gaps', 'merchant', 'merchant_id')}",
    "row_ids": """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS transaction_id, o_orderdate, o_orderkey, o_custkey
        FROM orders""",
    "fact_keys": f"""WITH {EVENTS}, k AS ({ids('gaps', 'merchant', 'merchant_id')})
        SELECT trans_num, merchant_id FROM gaps JOIN k ON gaps.merchant IS NOT DISTINCT FROM k.merchant""",
    "dim_customer": f"WITH {STAR} SELECT {CUSTOMER_COLUMNS} FROM d_customer",
    "dim_merchant": f"""WITH {EVENTS}, k AS ({ids('gaps', 'merchant', 'merchant_id')})
        SELECT merchant_id, e.merchant AS merchant_name, merch_lat, merch_long FROM k JOIN gaps e ON e.ord = k.first_ord""",
    "dim_category": f"WITH {STAR} SELECT category_id, category AS category_name FROM k_category",
    "dim_date": f"WITH {STAR} SELECT date_id, trans_date, {calendar('trans_date')} FROM k_date",
    "fact_txn": f"WITH {STAR} SELECT * FROM fact",
    "star_view": f"""WITH {STAR} SELECT fact.*, {CUSTOMER_COLUMNS.replace('customer_id, ', '')}, merchant_name, m.merch_lat, m.merch_long,
            category AS category_name, d.trans_date, CAST(day(d.trans_date) AS INTEGER) AS day, dayname(d.trans_date) AS day_of_week,
            strftime(d.trans_date, '%Y-%m') AS year_month
        FROM fact JOIN (SELECT {CUSTOMER_COLUMNS} FROM d_customer) c USING (customer_id) JOIN d_merchant m USING (merchant_id)
            JOIN k_category g USING (category_id) JOIN k_date d USING (date_id)""",
    "agg_daily": f"WITH {LINES} {grouped(DAILY)}",
    "agg_monthly": f"WITH {LINES} {grouped('year, month, year_month')}",
    "agg_merchant": f"WITH {LINES} {grouped('merchant_id, merchant_name')}",
    "agg_category": f"WITH {LINES} {grouped('category_id, category_name')}",
    "metrics_from_daily": f"WITH {LINES} {grouped('year, month, year_month')}",
    "fq_monthly_trend": f"""WITH {LINES} SELECT year_month, fraud_rate FROM ({grouped('year, month, year_month')}) a ORDER BY year, month""",
    "fq_daily_head": f"WITH {LINES} SELECT * FROM ({grouped(DAILY)}) a ORDER BY trans_date LIMIT 5",
    "fq_top_merchants": f"""WITH {LINES}, a AS ({grouped('merchant_id, merchant_name')})
        SELECT merchant_name, total_tx, fraud_tx, fraud_rate FROM a
        ORDER BY fraud_tx / total_tx DESC NULLS FIRST, merchant_id LIMIT 10""",
    "fq_top_categories": f"""WITH {LINES}, a AS ({grouped('category_id, category_name')})
        SELECT category_name, total_tx, fraud_tx, fraud_rate FROM a
        ORDER BY fraud_tx / total_tx DESC NULLS FIRST, category_id LIMIT 10""",
    "fq_entity_ranking": f"""WITH {LINES}, m AS ({grouped('merchant_id, merchant_name')}), c AS ({grouped('category_id, category_name')})
        SELECT entity_type, entity_id, entity_name, total_tx, fraud_tx, fraud_rate FROM (
            SELECT 'merchant' AS entity_type, merchant_id AS entity_id, merchant_name AS entity_name, total_tx, fraud_tx, fraud_rate FROM m
            UNION ALL
            SELECT 'category', category_id, category_name, total_tx, fraud_tx, fraud_rate FROM c
        ) both_kinds ORDER BY fraud_tx / total_tx DESC NULLS FIRST, fraud_tx DESC, entity_type, entity_id LIMIT 10""",
    "fq_last_fraud": f"""WITH {LINES}
        SELECT trans_ts, string_split(c_name, '#')[1] AS customer_first, string_split(c_name, '#')[2] AS customer_last,
            merchant_name, amt, is_fraud
        FROM fact JOIN customer ON c_custkey = customer_id WHERE is_fraud = 1 AND c_custkey % 7 <> 0
        ORDER BY trans_ts DESC, l_orderkey, l_linenumber, l_partkey, merchant_id, amt LIMIT 10""",
    "fq_hourly_fraud": f"""WITH {EVENTS} SELECT hour, ROUND(AVG(amt), 6) AS avg_fraud_amount, COUNT(*) AS fraud_tx
        FROM ev WHERE is_fraud = 1 GROUP BY hour""",
    "governed_select": f"""WITH {LINES},
        spend AS (
            SELECT c_mktsegment AS job, year, merchant_name, COUNT(*) AS n_tx
            FROM fact JOIN customer ON c_custkey = customer_id WHERE is_fraud = 1 GROUP BY ALL
        ),
        ranked AS (SELECT *, rank() OVER (PARTITION BY job, year ORDER BY n_tx DESC, merchant_name) AS place FROM spend)
        SELECT job, year, COUNT(DISTINCT merchant_name) AS merchants, CAST(SUM(n_tx) AS BIGINT) AS n_tx,
            MAX(CASE WHEN place = 1 THEN n_tx END) AS most
        FROM ranked GROUP BY GROUPING SETS ((job, year), (job), ())""",
    "sql_denylist": f"""
        WITH stated AS (
            SELECT o_orderkey, CASE o_orderkey % 8
                WHEN 0 THEN 'SELECT * FROM orders WHERE o_orderkey = ' || o_orderkey || ';'
                WHEN 1 THEN '  DELETE FROM orders WHERE o_orderkey = ' || o_orderkey || ' ;; '
                WHEN 2 THEN 'WITH x AS (SELECT ' || o_orderkey || ') SELECT * FROM x'
                WHEN 3 THEN 'drop' || chr(10) || 'table t' || o_orderkey || ';;' || chr(10)
                WHEN 4 THEN 'SELECT last_Update FROM t' || o_orderkey
                WHEN 5 THEN 'SELECT last_update , a FROM t' || o_orderkey
                WHEN 6 THEN 'Insert into t values (''' || o_orderpriority || ''')'
                ELSE 'TRUNCATE t' || o_orderkey || ';' END AS stmt
            FROM orders
        ),
        cut AS (SELECT o_orderkey, rtrim(trim(stmt, {BLANKS}), ';') AS cleaned FROM stated)
        SELECT o_orderkey, cleaned, {has_any('cleaned', DENIED)} AS denied FROM cut""",
    "null_audit": f"""WITH {EVENTS}
        SELECT unnest(['trans_num', 'trans_ts', 'merchant', 'category', 'amt', 'is_fraud']) AS column_name,
            unnest([COUNT(*) - COUNT(trans_num), COUNT(*) - COUNT(trans_ts), COUNT(*) - COUNT(merchant),
                COUNT(*) - COUNT(category), COUNT(*) - COUNT(amt), COUNT(*) - COUNT(is_fraud)]) AS n_null
        FROM gaps""",
    "result_profile": f"WITH {LINES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, COUNT(*) AS n_rows, ROUND(MIN({c}::DOUBLE), 6) AS min, ROUND(AVG({c}::DOUBLE), 6) AS mean, "
        f"ROUND(MAX({c}::DOUBLE), 6) AS max FROM fact"
        for c in ("merchant_id", "amt", "is_fraud", "hour")
    )
    + """ UNION ALL SELECT 'is_weekend', COUNT(*), MIN(is_weekend::INT::DOUBLE), ROUND(AVG(is_weekend::INT), 6),
        MAX(is_weekend::INT::DOUBLE) FROM fact""",
    "chk_pk": f"WITH {EVENTS} SELECT merchant, COUNT(*) AS n_rows FROM gaps GROUP BY merchant HAVING COUNT(*) > 1 OR merchant IS NULL",
    "chk_unique": """SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
    "chk_fk": "SELECT doc_id, COUNT(*) AS n_rows FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY doc_id",
    "chk_width": "SELECT conv_id, turn, role FROM conversations WHERE length(role) > 4",
    "chk_vectors": """SELECT coalesce(doc_id, vec_id) AS chunk_id, doc_id IS NOT NULL AS has_chunk, vec_id IS NOT NULL AS has_vector,
            CAST(len(embedding) AS INTEGER) AS dim
        FROM documents FULL JOIN embeddings ON doc_id = vec_id
        WHERE doc_id IS NULL OR vec_id IS NULL OR len(embedding) <> 64""",
    "text_clean": f"SELECT doc_id, trim(regexp_replace(text, '[{SPACE}]+', ' ', 'g')) AS text FROM documents",
    "text_caps": f"""WITH {ELEMENTS}, l AS (SELECT *, regexp_replace(raw, '[^A-Za-z]', '', 'g') AS letters FROM lines)
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(letters) > 3 AND letters = upper(letters) AS is_caps,
            CAST(len(list_filter(regexp_split_to_array(raw, '[{SPACE}]+'), lambda w: w <> '')) AS INTEGER) AS n_words
        FROM l""",
    "doc_elements": f"WITH {ELEMENTS} SELECT doc_id, pos, type, level, text FROM el",
    "doc_blocks": f"WITH {BLOCKS} SELECT doc_id, block_index, section, subsection, text FROM bl",
    "doc_blocks_inline": f"WITH {BLOCKS} SELECT doc_id, block_index, section, subsection, text FROM bl",
    "block_stats": f"WITH {BLOCKS} {stats('bl')}",
    "sentences": f"""SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS sentence
        FROM (SELECT doc_id, {sentence_list('text')} AS s FROM documents) d""",
    "sentence_words": f"WITH {stop_words('documents')} SELECT word, n, n_stop, score >= 0.3 AS abbreviation FROM scored",
    "sentences_learned": rf"""WITH d AS (
            SELECT doc_id, replace(replace(text, ' the ', CASE WHEN doc_id % 2 = 0 THEN ' Dr. ' ELSE ' approx. ' END), ' and ', ' e.g. ') AS text FROM documents
        ),
        {stop_words('d')},
        abbreviation AS (SELECT word FROM scored WHERE score >= 0.3),
        p AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS piece FROM (SELECT doc_id, {sentence_list('text')} AS s FROM d) l),
        e AS (SELECT *, regexp_extract(piece, '^[^{SPACE}]+') AS first, lag(regexp_extract(piece, '[^{SPACE}]+$')) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM p),
        b AS (SELECT *, {word_type('first')} AS type, regexp_matches(prev, '\.[^\pL\pN]*$') AND NOT regexp_matches(prev, '[!?][^\pL\pN]*$')
                AND ({word_type('prev')} IN (SELECT word FROM abbreviation) OR regexp_matches({word_type('prev')}, '^\pL$')) AS short FROM e),
        f AS (SELECT type AS word, COUNT(*) AS k FROM b WHERE i > 0 AND NOT short GROUP BY 1),
        x AS (SELECT word, c.n::DOUBLE AS b, least(k, c.n)::DOUBLE AS ab, (SELECT SUM(k) FROM f)::DOUBLE AS a, (SELECT greatest(SUM(n), (SELECT SUM(k) FROM f) + 1) FROM c)::DOUBLE AS t
              FROM f JOIN c USING (word)),
        r AS (SELECT *, greatest(1e-9, least(1 - 1e-9, b / t)) AS p, greatest(1e-9, least(1 - 1e-9, ab / a)) AS p1, greatest(1e-9, least(1 - 1e-9, (b - ab) / (t - a))) AS p2
              FROM x WHERE ab * t > a * b),
        starter AS (SELECT word FROM r WHERE 2 * ({likelihood('ab', 'a', 'p1')} + {likelihood('(b - ab)', '(t - a)', 'p2')}
                - {likelihood('ab', 'a', 'p')} - {likelihood('(b - ab)', '(t - a)', 'p')}) >= 30),
        g AS (SELECT doc_id, i, piece, SUM(CASE WHEN i = 0 OR NOT short OR type IN (SELECT word FROM starter) AND regexp_matches(first, '^[^\pL\pN]*\p{{Lu}}') THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM b)
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, string_agg(piece, ' ' ORDER BY i) AS sentence FROM g GROUP BY 1, 2""",
    "chunks_greedy": f"WITH {chunked('greedy')} SELECT * FROM chunk",
    "chunks_window": f"WITH {chunked('window')} SELECT * FROM chunk",
    "chunks_greedy_plain": f"WITH {chunked('greedy', PLAIN_BLOCKS)} SELECT * FROM chunk",
    "chunks_window_plain": f"WITH {chunked('window', PLAIN_BLOCKS)} SELECT * FROM chunk",
    "chunk_stats": f"WITH {chunked('window')} {stats('chunk')}",
    "snippets": f"""SELECT doc_id, {oneline('text', 500)} AS context_snippet, {oneline('text', 300)} AS evidence_snippet,
            {oneline('text', 200)} AS preview_snippet FROM documents""",
    "vec_normalize": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x::DOUBLE + label AS FLOAT)::DOUBLE) AS v FROM embeddings)
        SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos,
            ROUND(CAST(CAST(unnest(v) / sqrt(list_inner_product(v, v)) AS FLOAT) AS DOUBLE), 5) AS x FROM v""",
    "vec_topk": f"WITH {HITS} SELECT query_id, id, ROUND(score, 6) AS score, dense_rank FROM hits WHERE dense_rank <= 20",
    "vec_rerank": f"""WITH {reranked(20)} SELECT query_id, id, dense_rank, ROUND(rerank_score, 6) AS rerank_score, rank FROM ranked""",
    "embed_model": """WITH c AS (SELECT doc_id, 'passage: ' || coalesce(text, '') AS t FROM documents),
        v AS (SELECT doc_id, t, unnest(range(8)) AS pos, unnest(string_split('abcdefgh', '')) AS letter FROM c),
        n AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(len(t) - len(replace(t, letter, '')) AS DOUBLE) AS n FROM v)
        SELECT doc_id, pos, ROUND(CAST(n / sqrt(SUM(n * n) OVER (PARTITION BY doc_id)) AS FLOAT)::DOUBLE, 5) AS x FROM n""",
    "vec_rerank_model": f"""WITH {HITS},
        r AS (SELECT query_id, id, dense_rank, 1.0::DOUBLE / (1 + abs(len(b.text) - len(coalesce(d.text, '')))) AS rerank_score
              FROM hits h JOIN benchmark b ON b.item_id = h.query_id LEFT JOIN documents d ON d.doc_id = h.id WHERE dense_rank <= 20)
        SELECT query_id, id, ROUND(rerank_score, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, dense_rank) AS INTEGER) AS rank
        FROM r QUALIFY rank <= 5""",
    "retrieve": f"""WITH {reranked(10)} SELECT query_id, id, ROUND(score, 6) AS score, section, subsection,
            ROUND(rerank_score, 6) AS rerank_score, rank FROM ranked""",
    "vectors_aligned": """SELECT coalesce(doc_id, vec_id * 3) AS chunk_id, doc_id IS NOT NULL AS has_chunk, vec_id IS NOT NULL AS has_vector,
            CAST(len(embedding) AS INTEGER) AS dim
        FROM documents FULL JOIN embeddings ON doc_id = vec_id * 3""",
    "vec_upsert_buckets": """
        WITH merged AS (
            SELECT vec_id AS id, CAST(label AS BIGINT) AS label, embedding AS v FROM embeddings WHERE vec_id NOT IN (SELECT vec_id * 2 FROM embeddings)
            UNION ALL SELECT vec_id * 2, CAST(label + 100 AS BIGINT), list_reverse(embedding) FROM embeddings
        )
        SELECT id, label, CAST(unnest(range(len(v))) AS INTEGER) AS pos, ROUND(unnest(v)::DOUBLE, 6) AS x FROM merged""",
    "vec_upsert": """
        WITH merged AS (
            SELECT vec_id AS id, label, embedding AS v FROM embeddings WHERE vec_id NOT IN (SELECT vec_id * 2 FROM embeddings)
            UNION ALL SELECT vec_id * 2, label + 100, list_reverse(embedding) FROM embeddings
        )
        SELECT id, label, ROUND(list_inner_product(v::DOUBLE[], v::DOUBLE[]), 5) AS norm2, ROUND(v[1]::DOUBLE, 6) AS x0 FROM merged""",
    "collection_info": """SELECT COUNT(*) AS n_points, CAST(MIN(len(embedding)) AS INTEGER) AS min_dim,
            CAST(MAX(len(embedding)) AS INTEGER) AS max_dim FROM embeddings""",
    "embed_texts": f"WITH {word_vectors('v', 'documents', 'doc_id', 'passage', 'text')} SELECT doc_id, pos, ROUND(x, 5) AS x FROM v",
    "retrieve_texts": f"""WITH {chunked('window')},
        {word_vectors('pv', 'chunk', 'chunk_id', 'passage', 'text')}, {word_vectors('qv', 'benchmark', 'item_id', 'query', 'text')},
        pn AS (SELECT chunk_id, sqrt(SUM(x * x)) AS len FROM pv GROUP BY chunk_id),
        qn AS (SELECT item_id, sqrt(SUM(x * x)) AS len FROM qv GROUP BY item_id),
        dots AS (SELECT item_id, chunk_id, SUM(qv.x * pv.x) AS dot FROM qv JOIN pv USING (pos) GROUP BY item_id, chunk_id),
        scored AS (SELECT item_id, chunk_id, dot / (qn.len * pn.len) AS score FROM dots JOIN pn USING (chunk_id) JOIN qn USING (item_id)),
        hits AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ROUND(score, 7) DESC, chunk_id) AS dense_rank FROM scored
        ),
        rr AS (
            SELECT h.*, {overlap('b.text', 'c.text')} AS rerank_score
            FROM hits h JOIN benchmark b USING (item_id) JOIN chunk c USING (chunk_id) WHERE dense_rank <= 5
        )
        SELECT item_id AS query_id, chunk_id AS id, ROUND(score, 6) AS score, ROUND(rerank_score, 6) AS rerank_score,
            CAST(row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, dense_rank) AS INTEGER) AS rank
        FROM rr""",
    "csv_transactions": f"""WITH {EVENTS}
        SELECT trans_ts, cc_num, merchant, category, amt, first, last, gender, street, city, state, zip, lat, long, city_pop, job,
            CAST(dob AS VARCHAR) AS dob, trans_num, unix_time, merch_lat, merch_long, is_fraud, split FROM ev""",
    "chunk_files": f"WITH {chunked('window')} SELECT * FROM chunk",
    "metrics_by_weekday": f"WITH {LINES} SELECT year, day_of_week, is_weekend, {METRICS} FROM fact WHERE month > 3 GROUP BY 1, 2, 3",
    "metrics_by_merchant_hour": f"WITH {LINES} SELECT merchant_name, hour, {METRICS} FROM fact WHERE year IN (1993, 1994) GROUP BY 1, 2",
    "agg_all": f"""WITH {LINES} SELECT 'daily' AS grain, CAST(trans_date AS VARCHAR) AS name, {METRICS} FROM fact GROUP BY trans_date
        UNION ALL SELECT 'monthly', year_month, {METRICS} FROM fact GROUP BY year_month
        UNION ALL SELECT 'merchant', merchant_name, {METRICS} FROM fact GROUP BY merchant_id, merchant_name
        UNION ALL SELECT 'category', category_name, {METRICS} FROM fact GROUP BY category_name""",
    "warehouse_fact": f"WITH {LOADED} SELECT * FROM fact",
    "warehouse_continued": f"""WITH {LOADED}, n AS (SELECT merchant_id, COUNT(*) AS n_facts FROM fact GROUP BY 1)
        SELECT 'customer' AS dimension, customer_id AS id, cc_num AS name, NULL AS n_facts FROM k_customer
        UNION ALL SELECT 'merchant', k.merchant_id, merchant, n_facts FROM k_merchant k LEFT JOIN n USING (merchant_id)
        UNION ALL SELECT 'category', category_id, category, NULL FROM k_category UNION ALL SELECT 'date', date_id, CAST(trans_date AS VARCHAR), NULL FROM k_date""",
    "snapshot_counts": f"""WITH {EVENTS}, first AS (SELECT * FROM gaps QUALIFY row_number() OVER (PARTITION BY cc_num ORDER BY ord) = 1),
        m AS ({ids('gaps', 'merchant', 'id')}), g AS ({ids('gaps', 'category', 'id')}), t AS (SELECT COUNT(*) AS n, SUM(CAST(is_fraud AS BIGINT)) AS fraud, SUM(unix_time) AS times FROM gaps)
        SELECT 'dim_customer' AS relation, COUNT(*) AS n_rows, CAST(SUM(city_pop) AS BIGINT) AS total FROM first
        UNION ALL SELECT 'dim_merchant', COUNT(*), CAST(SUM(id) AS BIGINT) FROM m UNION ALL SELECT 'dim_category', COUNT(*), CAST(SUM(id) AS BIGINT) FROM g
        UNION ALL SELECT 'dim_date', COUNT(*), CAST(SUM(day) AS BIGINT) FROM (SELECT DISTINCT trans_date, day FROM gaps) d
        UNION ALL SELECT 'fact_transactions', n, CAST(times AS BIGINT) FROM t
        UNION ALL SELECT 'agg_daily_fraud', (SELECT COUNT(DISTINCT trans_date) FROM gaps), n FROM t
        UNION ALL SELECT 'agg_monthly_fraud', (SELECT COUNT(DISTINCT year_month) FROM gaps), CAST(fraud AS BIGINT) FROM t
        UNION ALL SELECT 'agg_merchant_fraud', (SELECT COUNT(*) FROM m), n FROM t
        UNION ALL SELECT 'agg_category_fraud', (SELECT COUNT(*) FROM g), CAST(fraud AS BIGINT) FROM t""",
    "warehouse_daily": f"""WITH {EVENTS}, t AS (SELECT * FROM gaps) SELECT {DAILY}, {METRICS} FROM t GROUP BY {DAILY}""",
    "snapshot_merchants": f"""WITH {EVENTS}, k AS ({ids('gaps', 'merchant', 'merchant_id')}),
        t AS (SELECT gaps.*, merchant_id, gaps.merchant AS merchant_name FROM gaps JOIN k ON gaps.merchant IS NOT DISTINCT FROM k.merchant)
        SELECT merchant_id, merchant_name, {METRICS} FROM t GROUP BY merchant_id, merchant_name""",
    "collection_files": """SELECT CAST(vec_id AS VARCHAR) AS id, label, CAST(len(embedding) AS INTEGER) AS dim, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
        ROUND(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings""",
    "vector_files": "SELECT vec_id AS chunk_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, ROUND(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings",
    "select_capped": "SELECT c_custkey AS customer_id, c_mktsegment AS job FROM customer ORDER BY c_custkey DESC LIMIT 25",
    "chk_smallint": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT BETWEEN -32768 AND 32767",
    "qa_route": f"WITH {QUESTIONS} SELECT question_id, {routed('label')} AS route, {routed(None)} AS route_by_words FROM qs",
    "qa_branches": f"""WITH {QUESTIONS}, r AS (SELECT *, {routed('label')} AS route FROM qs)
        SELECT question_id, route, CASE WHEN route = 'data' THEN 'SELECT * FROM events WHERE user_id = ' || conv_id END AS sql,
            CASE WHEN route = 'document' THEN CAST(len({word_set('question')}) AS INTEGER) END AS n_terms FROM r""",
    "chat_history": """
        SELECT conv_id, turn, role, text AS content
        FROM (SELECT *, MAX(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) c
        WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND NOT (role = 'user' AND turn = last_turn)""",
    "qa_context": f"""WITH {ANSWERS}
        SELECT question_id, string_agg('[' || rank || '] Section: ' || coalesce(section, 'None') || ' | Subsection: '
            || coalesce(subsection, 'None') || chr(10) || {oneline('text', 500)} || chr(10), chr(10) ORDER BY rank) AS context
        FROM hit GROUP BY question_id""",
    "qa_evidence": f"""WITH {ANSWERS}
        SELECT question_id, string_agg({oneline('text', 300)}, chr(10) || chr(10) ORDER BY rank) AS evidence
        FROM hit WHERE rank <= 2 GROUP BY question_id""",
    "qa_data_evidence": f"""WITH {ANSWERS},
        found AS (SELECT question_id, value, hour(ts) AS hour FROM ans JOIN events ON user_id = conv_id WHERE answer_type = 'data')
        SELECT question_id, 'value' AS field, COUNT(*) AS n_rows, ROUND(MIN(value), 6) AS min, ROUND(AVG(value), 6) AS mean, ROUND(MAX(value), 6) AS max
        FROM found GROUP BY question_id UNION ALL
        SELECT question_id, 'hour', COUNT(*), MIN(hour)::DOUBLE, ROUND(AVG(hour), 6), MAX(hour)::DOUBLE FROM found GROUP BY question_id""",
    "qa_base_score": f"""WITH {ANSWERS} SELECT question_id, answer_type, n_rows, n_hits, ROUND(base_score, 6) AS base_score FROM final""",
    "qa_final_score": f"WITH {ANSWERS} SELECT question_id, ROUND(quality_score, 6) AS quality_score FROM final",
    "qa_answers": f"""WITH {ANSWERS},
        src AS (SELECT * FROM hit JOIN (SELECT question_id FROM ans WHERE answer_type = 'document') USING (question_id) WHERE rank <= 5)
        SELECT question_id, question AS answer, answer_type, ROUND(quality_score, 6) AS quality_score,
            CASE WHEN answer_type = 'data' THEN 'SELECT * FROM events WHERE user_id = ' || conv_id END AS sql,
            CASE answer_type WHEN 'data' THEN 'sql_result' WHEN 'document' THEN 'document_chunks' END AS source_type,
            CASE WHEN answer_type = 'data' THEN n_rows END AS n_rows,
            CAST(rank - 1 AS INTEGER) AS source_no, section, subsection, text AS snippet, ROUND(rerank_score, 6) AS rerank_score
        FROM final LEFT JOIN src USING (question_id)""",
    "qa_answer_rows": f"""WITH {ANSWERS}
        SELECT question_id, event_type AS row_no, '{{"event_type":"' || event_type || '","n":' || n || '}}' AS row_json FROM result""",
}
