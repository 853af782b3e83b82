"""SQL for DuckDB that says what the queries of operators 1, 3, 5, 6 and 12 return."""

from __future__ import annotations

from wardloom.llm import chat, near_dedup
from wardloom.llm.line_dedup import PASSAGE_WORDS
from wardloom.llm.quality_rules import LineRules

_WORD = r"[^\x20\x09-\x0D]+"
_WHITE = r"[\x20\x09-\x0D]"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def quality_rules(rules: LineRules = LineRules()) -> str:
    words, chars = f"len(regexp_extract_all(line, '{_WORD}'))", f"length(regexp_replace({{}}, '{_WHITE}', '', 'g'))"
    bars = f"len(regexp_extract_all(line, '{rules.separator}'))"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    windows AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d) x),
    repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM windows) y WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS j) js GROUP BY doc_id),
    lines AS (SELECT doc_id, line, {words} AS n, {bars} AS bars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) z),
    judged AS (SELECT *, n > 0 AND ((bars >= {rules.separators} AND bars >= n * {rules.separator_share}) OR (n < {rules.boilerplate_words} AND regexp_matches(line, '{_quoted(rules.boilerplate)}'))
        OR len(regexp_extract_all(line, '{rules.decoration}')) > n * {rules.decorated_share} OR (n < {rules.unfinished_words} AND NOT regexp_matches(line, '{_quoted(rules.sentence_end)}'))) AS fails FROM lines),
    by_line AS (SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS dup, coalesce(sum({chars.format('line')}) FILTER (WHERE NOT fails), 0) AS left_chars FROM judged GROUP BY doc_id),
    counted AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, {chars.format('text')} AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, dup AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, left_chars
        FROM d JOIN by_line USING (doc_id) LEFT JOIN covered c USING (doc_id)),
    based AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND (word_chars = 0 OR 1 - CAST(left_chars AS DOUBLE) / word_chars <= CAST({1 - rules.min_kept_share} AS DOUBLE)) AS kept FROM based"""


def near_components() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    k = near_dedup.SHINGLE
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_WORD}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {k - 1}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0) x),
    sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY t)) AS whole FROM s GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= {near_dedup.PERCENT} * (x.n + y.n - k)),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id),
    low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept, CASE WHEN whole IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY whole) END AS class_id
    FROM d JOIN low USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


def chat_windows() -> str:
    """Spans are walked from start to start; each start knows its history and where the next one is."""

    def escaped(c: str) -> str:
        for plain, code in chat._ESCAPES:
            c = f"replace({c}, '{plain}', '{code}')"
        return c

    part = f"concat('{chat._OPEN}', {escaped('role')}, ']', chr(10), {escaped('text')}, '{chat._CLOSE}')"
    most, again = chat.WINDOW, chat.HISTORY_TOKENS
    return f"""
    WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
            coalesce(floor(turn / {chat.CHAPTER}), -1e18) AS chapter, len(regexp_extract_all({part}, '{chat.TOKEN}')) + strlen({part}) - length({part}) AS n, length({part}) AS chars FROM c),
    u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, chapter ORDER BY pos) AS upto,
            max(CASE WHEN pos = 0 AND role = 'system' THEN n END) OVER (PARTITION BY conv_id) AS system_n,
            max(CASE WHEN pos = 0 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS system_chars,
            CASE WHEN pos = 0 AND role = 'system' THEN NULL ELSE n END AS said_n FROM t),
    v AS (SELECT *, lag(said_n, 1) OVER w AS n1, lag(said_n, 2) OVER w AS n2, lag(chars, 1) OVER w AS chars1, lag(chars, 2) OVER w AS chars2,
            CASE WHEN pos = 0 THEN 0 ELSE coalesce(system_n, 0) END AS kept FROM u WINDOW w AS (PARTITION BY conv_id, chapter ORDER BY pos)),
    h AS (SELECT *, CASE WHEN n1 + n2 <= {again} AND kept + n1 + n2 + n <= {most} THEN 2 WHEN n1 <= {again} AND kept + n1 + n <= {most} THEN 1 ELSE 0 END AS hist FROM v),
    x AS (SELECT *, kept + CASE hist WHEN 2 THEN n1 + n2 WHEN 1 THEN n1 ELSE 0 END AS used, CASE hist WHEN 2 THEN chars1 + chars2 WHEN 1 THEN chars1 ELSE 0 END AS hist_chars FROM h),
    nexts AS (SELECT a.conv_id, a.pos, a.hist_chars, CASE WHEN a.pos > 0 THEN coalesce(a.system_chars, 0) ELSE 0 END AS repeated,
            min(CASE WHEN b.chapter > a.chapter OR a.used + b.upto - a.upto + a.n > {most} THEN b.pos END) AS following
        FROM x a LEFT JOIN x b ON a.conv_id = b.conv_id AND b.pos > a.pos GROUP BY ALL),
    starts AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos FROM c GROUP BY conv_id
        UNION ALL SELECT s.conv_id, n.following FROM starts s JOIN nexts n ON s.conv_id = n.conv_id AND s.pos = n.pos WHERE n.following IS NOT NULL),
    extra AS (SELECT n.conv_id, sum(hist_chars + repeated) AS chars FROM starts s JOIN nexts n ON s.conv_id = n.conv_id AND s.pos = n.pos GROUP BY n.conv_id)
    SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY pos)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(t.chars) + any_value(e.chars) AS BIGINT) AS formatted_chars
    FROM t JOIN extra e ON t.conv_id = e.conv_id GROUP BY t.conv_id"""


def line_dedup() -> str:
    """Windows of three lines, and of one and two lines where they hold over 50 words."""
    edges = "concat(' ', chr(9), chr(11), chr(12), chr(13))"
    return f"""
    WITH l AS (SELECT doc_id, unnest(range(len(a))) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) x),
    f AS (SELECT doc_id, no, trim(line, {edges}) AS line FROM l WHERE trim(line, {edges}) <> ''),
    n AS (SELECT doc_id, k, c, no, unnest([1, 2, 3]) AS width, unnest([no, n2, n3]) AS last, unnest([l1, l1 || chr(10) || l2, l1 || chr(10) || l2 || chr(10) || l3]) AS key
        FROM (SELECT doc_id, no, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS c, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(no, 1) OVER w AS n2, lead(no, 2) OVER w AS n3 FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY no)) x),
    windows AS (SELECT doc_id, no AS pos, last, key, width FROM n WHERE last IS NOT NULL AND (width = least(c, 3) OR len(regexp_extract_all(key, '{_WORD}')) > {PASSAGE_WORDS})),
    later AS (SELECT doc_id, pos, last FROM (SELECT *, row_number() OVER (PARTITION BY width, key ORDER BY doc_id, pos) AS nth FROM windows) y WHERE nth > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS no FROM later),
    m AS (SELECT l.*, g.no IS NOT NULL AS gone, trim(line, {edges}) <> '' AS filled FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no)
    SELECT doc_id, CAST(sum(CASE WHEN filled THEN 1 ELSE 0 END) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN filled AND gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY doc_id"""


def dialogue_repair() -> str:
    """The search is a recursion over rows that keeps the best (cost, letters) of each state; crc32 is folded bit by bit."""
    return r"""
    WITH RECURSIVE raw AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
    ), hashed AS (
      SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(name, ''),
          lambda x: [ascii(x)::UBIGINT, 256::UBIGINT, 256::UBIGINT, 256::UBIGINT, 256::UBIGINT, 256::UBIGINT, 256::UBIGINT, 256::UBIGINT, 256::UBIGINT]))),
        lambda c, e: CASE WHEN e < 256 THEN xor(c, e) ELSE xor(c >> 1, (c & 1::UBIGINT) * 3988292384::UBIGINT) END), 4294967295::UBIGINT) % 20 AS kind
      FROM raw
    ), damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
      FROM hashed, (VALUES (1), (2)) AS c(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
    ), numbered AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM damaged
    ), flagged AS (
      SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered
    ), rws AS (
      SELECT *, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM flagged
    ), inserts(s, t, ins) AS (
      VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (2, 3, 'I'), (3, 2, 'I'), (0, 3, 'II'), (1, 3, 'II')
    ), edits(t, initial, letter, u, price) AS (
      VALUES (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (3, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0),
             (0, NULL, 'R', 2, 3), (1, NULL, 'R', 2, 3), (3, NULL, 'R', 2, 3), (2, NULL, 'R', 3, 3),
             (0, NULL, 'D', 0, 4), (1, NULL, 'D', 1, 4), (2, NULL, 'D', 2, 4), (3, NULL, 'D', 3, 4)
    ), steps AS (
      SELECT s, initial, ins || letter AS letters, letter, u, price + 3 * length(ins) AS price FROM inserts JOIN edits USING (t)
    ), best(conv_id, i, s, p) AS (
      SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': ''} FROM rws
      UNION ALL
      SELECT b.conv_id, b.i + 1, e.u, min({'cost': b.p.cost + e.price + CASE WHEN r.cut AND e.letter <> 'D' THEN 3 ELSE 0 END, 'audit': b.p.audit || e.letters})
      FROM best b JOIN rws r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
      JOIN steps e ON e.s = b.s AND (e.letter = 'D' OR NOT (r.blank OR r.again)) AND (e.initial IS NULL OR e.initial = r.initial)
      GROUP BY 1, 2, 3
    ), stats AS (
      SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rws GROUP BY 1
    ), final AS (
      SELECT st.conv_id, min({'cost': b.p.cost + 3 * length(x.ins), 'audit': b.p.audit || x.ins}) AS p
      FROM stats st JOIN best b ON b.conv_id IS NOT DISTINCT FROM st.conv_id AND b.i = st.n JOIN inserts x ON x.s = b.s AND x.t IN (0, 3) GROUP BY 1
    ), letters AS (
      SELECT conv_id, k, p.audit[k] AS letter FROM final, LATERAL (SELECT unnest(generate_series(1, length(p.audit))) AS k)
    ), placed AS (
      SELECT conv_id, k, letter, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS place
      FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
    ), lines AS (
      SELECT p.conv_id, p.place, p.letter, CASE WHEN p.letter = 'K' THEN r.role END AS role, CASE WHEN p.letter = 'I' THEN '' ELSE r.text END AS text
      FROM placed p LEFT JOIN rws r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE p.letter <> 'D'
    ), roles AS (
      SELECT *, max(CASE WHEN place = 1 AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS shift FROM lines
    ), digests AS (
      SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place)) AS digest
      FROM roles GROUP BY 1
    )
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f.p.cost, 0)::BIGINT AS cost,
           coalesce(f.p.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""
