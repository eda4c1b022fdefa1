"""DuckDB SQL for the text operators that SQL can express."""

URL_FILTERS = """
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS authority,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM cut
), named AS (
    SELECT page_id, translate(authority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
)
SELECT page_id, host, path,
    CASE WHEN fits_example_net THEN 'example.net/en/' WHEN fits_example_com THEN 'example.com/de/'
         WHEN fits_org THEN 'org/fr/' WHEN fits_net THEN 'net/' END AS rule,
    CASE WHEN fits_example_net THEN 'allow' WHEN fits_example_com THEN 'block'
         WHEN fits_org THEN 'allow' WHEN fits_net THEN 'block' ELSE 'allow' END AS verdict
FROM (
    SELECT *,
        ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' AS fits_example_net,
        ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' AS fits_example_com,
        ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' AS fits_org,
        ('.' || host) LIKE '%.net' AND path LIKE '/%' AS fits_net
    FROM named
)
"""

_CLASSES = ["[aeiou]", "[b-df-hj-np-tv-z]", "[A-Z]", "[0-9]", "[\\x20\\x09-\\x0D]", "[.,;:!?''\"()-]"]
_COUNTS = [f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" for c in _CLASSES]
_ASCII = "length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))"
_HISTOGRAM = f"[{', '.join(_COUNTS)}, {_ASCII} - ({' + '.join(f'({c})' for c in _COUNTS)}), length(text) - {_ASCII}]"


def _share(p, q):
    return f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"


def _divergence(p, q):
    return f"(sum({_share(p, q)}) + sum({_share(q, p)})) / 2"


# Fixed values of the rules: the words for which a text counts at most, and the unit of its shares.
_TEXT_SHARE, _SHARE_UNIT = 1000, 1 << 20

QUALITY_RULES = rf"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, text IS NULL AS missing FROM documents
), words AS MATERIALIZED (
    SELECT r, lang, missing, unnest(list) AS w, generate_subscripts(list, 1) AS i
    FROM (SELECT r, lang, missing, regexp_extract_all(text, '[^ 	-
]+') AS list FROM d)
), lowered AS MATERIALIZED (
    SELECT r, lang, missing, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM words
), windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3, w4, w5) AS n
    FROM (SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
          FROM words WINDOW o AS (PARTITION BY r ORDER BY i))
    WHERE w5 IS NOT NULL
), repeated AS (
    SELECT r, count(DISTINCT i + k) AS n FROM windows, unnest([0, 1, 2, 3, 4]) AS t(k) WHERE n > 1 GROUP BY r
), lines AS (
    SELECT r, count(*) - count(DISTINCT line) AS n
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^ 	-
]') GROUP BY r
), facts AS (
    SELECT r, count(*) AS n, sum(length(w))::BIGINT AS chars FROM words GROUP BY r
), bases AS MATERIALIZED (
    SELECT r, coalesce(f.n, 0) AS n, coalesce(p.n, 0) AS repeats, coalesce(f.n, 0) < 10 OR 100 * coalesce(p.n, 0) > 20 * coalesce(f.n, 0) AS failed
    FROM d LEFT JOIN facts f USING (r) LEFT JOIN repeated p USING (r)
), told AS MATERIALIZED (
    SELECT min(d.r) AS r, d.lang, greatest(any_value(b.n), {_TEXT_SHARE}) AS size FROM d JOIN bases b USING (r)
    WHERE d.lang IN ('en', 'fr', 'de', 'es') AND NOT d.missing AND NOT b.failed GROUP BY d.lang, d.text
), classes AS MATERIALIZED (
    SELECT r, lang, missing, unnest({_HISTOGRAM}) AS n, unnest(range(8)) AS class FROM d
), class_reference AS (
    SELECT lang, class, n / sum(n) OVER (PARTITION BY lang) AS q
    FROM (SELECT t.lang, class, sum((n * {_TEXT_SHARE} * {_SHARE_UNIT}) // size) AS n FROM classes JOIN told t USING (r) GROUP BY ALL)
), class_far AS (
    SELECT r, {_divergence('p', 'q')} AS far
    FROM (SELECT r, lang, class, n / sum(n) OVER (PARTITION BY r) AS p FROM classes) JOIN class_reference USING (lang, class)
    GROUP BY r
), counted AS MATERIALIZED (
    SELECT lang, w, sum(n) AS n, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, w) AS rank, sum(sum(n)) OVER (PARTITION BY lang) AS total
    FROM (SELECT t.lang, r, w, (count(*) * {_TEXT_SHARE} * {_SHARE_UNIT}) // any_value(size) AS n FROM lowered JOIN told t USING (r) GROUP BY t.lang, r, w)
    GROUP BY lang, w
), common AS MATERIALIZED (
    SELECT lang, w, n / total AS q FROM counted WHERE rank <= 40
), word_reference AS (
    SELECT lang, w, q FROM common UNION ALL SELECT lang, ' ', 1 - sum(q) FROM common GROUP BY lang
), word_shares AS (
    SELECT r, lang, w, sum(n) OVER (PARTITION BY r, w) / sum(n) OVER (PARTITION BY r) AS p
    FROM (SELECT l.r, l.lang, coalesce(c.w, ' ') AS w, count(*) AS n FROM lowered l LEFT JOIN common c ON l.lang = c.lang AND l.w = c.w GROUP BY ALL)
), word_far AS (
    SELECT a.r, {_divergence('p', 'q')} AS far
    FROM (SELECT f.r, w, coalesce(p, 0) AS p, q
          FROM (SELECT d.r, ref.w, ref.q FROM d JOIN word_reference ref USING (lang)) f LEFT JOIN word_shares s USING (r, w)) a
    GROUP BY a.r
), judged AS (
    SELECT doc_id, coalesce(f.n, 0) AS n_words, coalesce(f.chars, 0) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
        coalesce(f.n, 0) < 10 OR 100 * coalesce(p.n, 0) > 20 * coalesce(f.n, 0) AS base_failed,
        CASE WHEN length(text) >= 400 THEN c.far END AS class_far, CASE WHEN coalesce(f.n, 0) >= 100 THEN w.far END AS word_far
    FROM d LEFT JOIN facts f USING (r) LEFT JOIN repeated p USING (r) LEFT JOIN lines l USING (r)
        LEFT JOIN class_far c USING (r) LEFT JOIN word_far w USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    round(class_far, 6) AS class_divergence, round(word_far, 6) AS word_divergence,
    NOT (base_failed OR coalesce(class_far, 0) > 0.1 OR coalesce(word_far, 0) > 0.15) AS kept
FROM judged
"""

LM_SCORING = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS list
    FROM documents
), words AS MATERIALIZED (
    SELECT r, unnest(list) AS w, generate_subscripts(list, 1) AS i FROM d
), counted AS (
    SELECT w, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, ('0x' || substr(md5(w), 1, 16))::UBIGINT >> 1) AS rank FROM words GROUP BY w
), vocabulary AS MATERIALIZED (
    SELECT w, n, rank + 1 AS number FROM counted
), seen AS MATERIALIZED (
    SELECT number, sum(n) AS n FROM vocabulary GROUP BY number
    UNION ALL SELECT 1, count(DISTINCT r) FROM words
), pairs AS MATERIALIZED (
    SELECT r, coalesce(lag(number) OVER (PARTITION BY r ORDER BY i), 1) AS u, number AS w FROM words JOIN vocabulary USING (w)
), bigrams AS (
    SELECT u, w, count(*) AS n FROM pairs GROUP BY u, w HAVING count(DISTINCT r) > 1
), scored AS (
    SELECT r, count(*) AS n_words, count(*) FILTER (b.n IS NULL) AS n_backed_off,
        sum(CASE WHEN b.n IS NOT NULL THEN ln(b.n / before.n) ELSE ln(0.4::DOUBLE * itself.n / (SELECT count(*) FROM words)) END) AS log_score
    FROM pairs p LEFT JOIN bigrams b ON p.u = b.u AND p.w = b.w
        JOIN seen before ON before.number = p.u JOIN seen itself ON itself.number = p.w
    GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backed_off, 0) AS n_backed_off,
    round(coalesce(log_score, 0), 6) AS log_score, round(log_score / n_words, 6) AS mean_log_score
FROM d LEFT JOIN scored USING (r)
"""

RANKED_SEARCH = r"""
WITH words AS MATERIALIZED (
    SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), asked AS MATERIALIZED (
    SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)
), lengths AS MATERIALIZED (
    SELECT r, count(*) AS n FROM words GROUP BY r
), whole AS MATERIALIZED (
    SELECT count(*) AS documents, sum(n)::BIGINT AS length FROM lengths
), counted AS MATERIALIZED (
    SELECT r, doc_id, t, count(*) AS tf FROM words WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weights AS MATERIALIZED (
    SELECT t, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY t
), added AS MATERIALIZED (
    SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // length))) AS part
    FROM counted JOIN weights USING (t) JOIN lengths USING (r), whole
), scored AS (
    SELECT q, item_id, r, doc_id, sum(part)::BIGINT AS score FROM asked JOIN added USING (t) GROUP BY ALL HAVING sum(part) > 0
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

# CRC-32 of a number's decimal digits, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

PREFIX_TRIE = f"""
WITH own AS MATERIALIZED (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), lengths AS MATERIALIZED (
    SELECT conv_id, count(*) AS n, {_CRC32} % 9 AS h FROM own GROUP BY conv_id
), plan AS MATERIALIZED (
    SELECT a.conv_id, a.conv_id - a.conv_id % 5 AS donor, a.h, least(a.h, coalesce(b.n, 0)) AS taken
    FROM lengths a LEFT JOIN lengths b ON b.conv_id = a.conv_id - a.conv_id % 5
), rebuilt AS (
    SELECT p.conv_id, o.place AS d, o.role, o.text FROM plan p JOIN own o ON o.conv_id = p.donor AND o.place <= p.h
    UNION ALL
    SELECT p.conv_id, o.place - p.h + p.taken, o.role, o.text FROM plan p JOIN own o ON o.conv_id = p.conv_id AND o.place > p.h
), paths AS MATERIALIZED (
    SELECT conv_id, coalesce(turns, []) AS turns, coalesce(bytes, []) AS bytes
    FROM lengths LEFT JOIN (
        SELECT conv_id, list(md5(strlen(role) || ':' || role || text) ORDER BY d) AS turns, list(strlen(text) ORDER BY d) AS bytes FROM rebuilt GROUP BY conv_id
    ) USING (conv_id)
), members AS MATERIALIZED (
    SELECT conv_id, depth, md5(array_to_string(turns[:depth], ',')) AS node, md5(array_to_string(turns[:depth - 1], ',')) AS above,
        CASE WHEN depth > 0 THEN bytes[depth] ELSE 0 END AS size, depth = len(turns) AS ends
    FROM paths, unnest(range(len(turns) + 1)) AS t(depth)
), nodes AS MATERIALIZED (
    SELECT depth, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) * (count(*) - 1) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY depth, node
), children AS MATERIALIZED (
    SELECT above, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
    SELECT m.depth, m.node, sum(n.saved) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
    FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
        LEFT JOIN children c ON c.above = n.node AND c.depth = n.depth
    GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (depth, node) LEFT JOIN children c ON c.above = n.node AND c.depth = n.depth
    LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.above
"""

SQL = {"op1_url_filters": URL_FILTERS, "op4_quality_rules": QUALITY_RULES, "op6_lm_scoring": LM_SCORING, "op11_ranked_search": RANKED_SEARCH, "op12_prefix_trie": PREFIX_TRIE}
