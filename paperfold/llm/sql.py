"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from paperfold.llm import quality

EXACT = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS d FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, d AS text_sha256
FROM t WINDOW w AS (PARTITION BY d)
"""

_PLAIN = "trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"

QUALITY = f"""
WITH base AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         CASE WHEN {_PLAIN} = '' THEN [] ELSE string_split({_PLAIN}, ' ') END AS words
  FROM documents
), counts AS (
  SELECT id, doc_id, host, text, words, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols
  FROM base
), windows AS (
  SELECT id, p, array_to_string(words[p:p + 4], ' ') AS w
  FROM (SELECT id, words, unnest(range(1, len(words) - 3)) AS p FROM base)
), repeated AS (
  SELECT id, p FROM (SELECT id, p, count(*) OVER (PARTITION BY id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT id, count(DISTINCT p + k) AS n FROM repeated, (SELECT unnest(range(0, 5)) AS k) GROUP BY id
), lines AS (
  SELECT id, doc_id, host, hash(text) AS content, line FROM (
    SELECT id, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), dup AS (
  SELECT id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY id
), normal AS (
  SELECT id, doc_id, host, content,
         lower(trim(regexp_replace(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'))) AS line
  FROM lines
), sizes AS (
  SELECT coalesce(source, '') AS host, count(DISTINCT hash(text)) AS size FROM documents
  WHERE regexp_matches(text, '[^\\x20\\x09-\\x0D]') GROUP BY ALL
), frequent AS (
  SELECT n.host, line, min(doc_id) AS first_id FROM normal n JOIN sizes s ON n.host = s.host GROUP BY n.host, line
  HAVING count(DISTINCT content) > {quality.HOST_FLOOR} AND 100 * count(DISTINCT content) > {quality.HOST_PERCENT} * any_value(size)
), removed AS (
  SELECT n.id, sum(len(string_split(n.line, ' '))) AS n
  FROM normal n JOIN frequent f ON n.host = f.host AND n.line = f.line
  WHERE n.doc_id IS DISTINCT FROM f.first_id GROUP BY n.id
), joined AS (
  SELECT c.doc_id, c.n_words, c.word_chars, c.n_symbols, coalesce(d.n, 0) AS n_dup_lines,
         coalesce(v.n, 0) AS n_repeat_words, coalesce(r.n, 0)::BIGINT AS removed_words
  FROM counts c LEFT JOIN covered v ON c.id = v.id LEFT JOIN dup d ON c.id = d.id
  LEFT JOIN removed r ON c.id = r.id
), judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         removed_words > 0 AND (n_words - removed_words < {quality.MIN_WORDS}
           OR 100 * (n_words - removed_words) < {quality.MIN_LEFT_PERCENT} * n_words) AS depleted
  FROM joined
)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t
), classes AS (
  SELECT min(doc_id) AS id, len(s) AS n, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s
), members AS (
  SELECT c.id, x.doc_id, c.n FROM classes c JOIN (SELECT doc_id, list_sort(s) AS s FROM sets) x ON c.s = x.s
), items AS (
  SELECT id, n, unnest(s) AS shingle FROM classes
), pairs AS (
  SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.id < b.id
    AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT id AS a, id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), groups AS (
  SELECT a AS id, min(b) AS component FROM reach GROUP BY a
)
SELECT m.doc_id, m.n AS n_shingles, CASE WHEN m.n = 0 THEN m.doc_id ELSE g.component END AS component_id,
       m.doc_id = CASE WHEN m.n = 0 THEN m.doc_id ELSE g.component END AS kept
FROM members m JOIN groups g ON m.id = g.id
"""


def mixing(levels: dict[str, str], weights: dict[str, dict[str, int]], seed: int, max_epochs: int, percent: int = 100) -> str:
    """The mix over `documents`, its budget being a percentage of all tokens there are."""
    names = list(levels)
    labels = ", ".join(f"coalesce({e}, '') AS {n}" for n, e in levels.items())
    plain = _PLAIN

    def weight(level: str) -> str:
        if level not in weights:
            return "1"
        cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in weights[level].items())
        return f"CASE {level} {cases} ELSE 1 END"

    steps = [
        f"m AS (SELECT doc_id, {labels}, CASE WHEN {plain} = '' THEN 0 ELSE len(string_split({plain}, ' ')) END AS tokens FROM documents)",
        f"leaves AS (SELECT {', '.join(names)}, sum(tokens)::BIGINT AS available, (sum(tokens) * {max_epochs})::BIGINT AS capacity "
        f"FROM m GROUP BY ALL HAVING sum(tokens) > 0)",
        f"b0 AS (SELECT least(sum(available)::HUGEINT * {percent} // 100, sum(capacity)::HUGEINT)::HUGEINT AS budget FROM leaves)",
    ]
    for depth, level in enumerate(names):
        path, parent = names[: depth + 1], names[:depth]
        above = f"b{depth}"
        on = " AND ".join(f"n.{c} = p.{c}" for c in parent) or "true"
        part = f"PARTITION BY {', '.join(parent)}" if parent else ""
        order = f"{part} ORDER BY capacity / weight, {level}"
        steps += [
            f"n{depth} AS (SELECT {', '.join(path)}, sum(capacity)::HUGEINT AS capacity, ({weight(level)})::HUGEINT AS weight FROM leaves GROUP BY {', '.join(path)})",
            f"f{depth} AS (SELECT {', '.join('n.' + c for c in path)}, n.capacity, n.weight, p.budget FROM n{depth} n JOIN {above} p ON {on})",
            f"g{depth} AS (SELECT *, capacity * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT"
            f" <= (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT) * weight AS fits FROM f{depth})",
            f"h{depth} AS (SELECT *, min(fits::INT) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS filled FROM g{depth})",
            f"b{depth + 1} AS (SELECT {', '.join(path)}, CASE WHEN filled THEN capacity ELSE least(capacity,"
            f" ((budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER ({part}), 0)::HUGEINT) * weight)"
            f" // sum(CASE WHEN NOT filled THEN weight END) OVER ({part})::HUGEINT) END AS budget FROM h{depth})",
        ]
    keys = " AND ".join(f"l.{c} = b.{c}" for c in names)
    same = " AND ".join(f"m.{c} = p.{c}" for c in names)
    leaf = ", ".join(f"m.{c}" for c in names)
    steps += [
        f"plan AS (SELECT {', '.join('l.' + c for c in names)}, (b.budget // l.available)::INT AS whole, (b.budget % l.available)::BIGINT AS rest"
        f" FROM leaves l JOIN b{len(names)} b ON {keys})",
        f"j AS (SELECT m.doc_id, {leaf}, m.tokens, p.whole, p.rest FROM m JOIN plan p ON {same})",
        f"cut AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {', '.join(names)} ORDER BY md5('{seed}|' || whole || '|' || doc_id), doc_id"
        f" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM j WHERE rest > 0)",
    ]
    out = ", ".join(names)
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, {out}, tokens, unnest(range(0, whole))::INT AS epoch, tokens AS tokens_taken FROM j WHERE whole > 0"
        f"\nUNION ALL SELECT doc_id, {out}, tokens, whole, least(tokens, rest - start)::BIGINT FROM cut WHERE start < rest"
    )


def chats(control: tuple[str, ...], escapes: dict[str, str], marks: int) -> str:
    """Digests of formatted conversations; `marks`: characters of a turn's three marks."""

    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '{escapes[chr(92)]}')"
        for word in control:
            out = f"replace({out}, '{word}', '{escapes[word[0]]}{word[1:]}')"
        return out

    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({marks} + length({escaped('role')}) + length({escaped('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def _transitions() -> str:
    """The (cost, audit) pairs of the four states behind a row, from those ahead of it (`st`)."""
    # Insertions lead from nothing, system and assistant to user, and from user to assistant.
    user = "list_min([st[3], {'c': st[1].c + 2, 'a': st[1].a || 'I'}, {'c': st[2].c + 2, 'a': st[2].a || 'I'}, {'c': st[4].c + 2, 'a': st[4].a || 'I'}])"
    assistant = "list_min([st[4], {'c': st[3].c + 2, 'a': st[3].a || 'I'}, {'c': st[1].c + 4, 'a': st[1].a || 'II'}, {'c': st[2].c + 4, 'a': st[2].a || 'II'}])"
    return f"[st[1], st[2], {user}, {assistant}]"


def _taken(state: int, role: str) -> str:
    """Behind a row that is kept as `role`, or given that role, in a state."""
    cost, letter = (f"CASE kind WHEN '{role}' THEN {a} ELSE {b} END" for a, b in ((0, 2), ("'K'", "'R'")))
    return f"{{'c': st[{state}].c + more + {cost}, 'a': st[{state}].a || {letter}}}"


CONVERSATIONS = f"""
WITH RECURSIVE crc_steps AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS tbl FROM crc_steps WHERE k = 8
), said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), coded AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: xor(c >> 8, tbl[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS code
  FROM said, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE code WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE code <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place FROM damaged
), faults AS (
  SELECT conv_id, turn, role, text, place,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault,
         CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS kind
  FROM placed
), paired AS (
  SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY place) || kind AS pair FROM faults
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM paired GROUP BY conv_id
), solved AS (
  SELECT conv_id, 0::BIGINT AS place, [{{'c': 0, 'a': ''}}, {{'c': 1000000, 'a': ''}}, {{'c': 1000000, 'a': ''}}, {{'c': 1000000, 'a': ''}}] AS st FROM counts
  UNION ALL
  SELECT conv_id, place, CASE WHEN fault IN ('b', 'd') THEN list_transform(st, lambda x: {{'c': x.c + 3, 'a': x.a || 'D'}}) ELSE [
    {{'c': st[1].c + 3, 'a': st[1].a || 'D'}},
    list_min([{{'c': st[2].c + 3, 'a': st[2].a || 'D'}}, CASE kind WHEN 's' THEN {{'c': st[1].c + more, 'a': st[1].a || 'K'}} ELSE {{'c': 1000000, 'a': ''}} END]),
    list_min([{{'c': st[3].c + 3, 'a': st[3].a || 'D'}},
      {_taken(1, 'u')},
      {_taken(2, 'u')},
      {_taken(4, 'u')}]),
    list_min([{{'c': st[4].c + 3, 'a': st[4].a || 'D'}}, {_taken(3, 'a')}])] END
  FROM (SELECT s.conv_id, f.place, f.fault, f.kind, CASE f.fault WHEN 't' THEN 1 ELSE 0 END AS more, {_transitions()} AS st
        FROM solved s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.place = s.place + 1)
), chosen AS (
  SELECT s.conv_id, list_min([st[1], st[4], {{'c': st[3].c + 2, 'a': st[3].a || 'I'}}, {{'c': st[2].c + 4, 'a': st[2].a || 'II'}}]) AS best
  FROM solved s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.place
), letters AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS letter, unnest(range(1, len(best.a) + 1)) AS nth FROM chosen WHERE best.a <> ''
), edits AS (
  SELECT conv_id, nth, letter,
         sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY nth) AS place,
         sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY nth) AS position
  FROM letters
), left_rows AS (
  SELECT e.conv_id, e.nth, e.letter, e.position, CASE e.letter WHEN 'I' THEN '' ELSE f.text END AS text, f.role,
         max(CASE WHEN e.position = 1 AND e.letter = 'K' AND f.kind = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS has_system
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.place = e.place WHERE e.letter <> 'D'
), hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (position - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || text, chr(10) ORDER BY nth)) AS digest FROM left_rows GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(h.best.c, 0)::BIGINT AS cost,
       coalesce(h.best.a, '') AS audit, coalesce(x.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN hashed x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""

DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), sizes AS (
  SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (coalesce(s.n, 0) + 2 * l.v) AS p,
         1 + 1000000000::HUGEINT * (k.total + 2) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM cells WHERE c > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 10
"""

# Base32 takes five bits a letter: eight letters from each ten hexadecimal digits.
WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response
  FROM pages
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((('0x' || substr(hex, (1 + 10 * (k // 8))::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM p
"""
