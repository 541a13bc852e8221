"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tracestrata.llm import quality, url_filter

_BLANKS = r"[\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, separators: str = _BLANKS) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{separators}'), lambda x: x <> '')"


def _quality() -> str:
    bins = (
        f"CASE WHEN v < {quality.EXACT} THEN v ELSE "
        f"(v >> (length(bin(v)) - {1 + quality.SUB_BITS})) << (length(bin(v)) - {1 + quality.SUB_BITS}) END"
    )
    values = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM metrics WHERE n_words > 0" for m in quality.LEAST
    )
    least = "CASE metric " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in quality.LEAST.items()) + " END"
    checks = " AND ".join(
        f"coalesce(m.{x} BETWEEN t.{x}_low AND t.{x}_high, true)" for x in quality.LEAST
    )
    limits = ", ".join(
        f"max(low) FILTER (metric = '{m}') AS {m}_low, max(high) FILTER (metric = '{m}') AS {m}_high"
        for m in quality.LEAST
    )

    def quartiles(keys: str) -> str:
        k = f"{keys}, " if keys else ""
        return f"""
        SELECT {k}metric, min(bin) FILTER (seen >= 0.25 * n_all) AS q1, min(bin) FILTER (seen >= 0.75 * n_all) AS q3,
               max(n_all) AS n
        FROM (SELECT {k}metric, bin, sum(n) OVER (PARTITION BY {k}metric ORDER BY bin) AS seen,
                     sum(n) OVER (PARTITION BY {k}metric) AS n_all
              FROM (SELECT {k}metric, bin, sum(n) AS n FROM sketch GROUP BY ALL))
        GROUP BY ALL"""

    return f"""
    WITH words AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS text, {_words("text")} AS w FROM documents
    ), spread AS (
        SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
    ), places AS (
        SELECT doc_id, i, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third
        FROM spread WINDOW o AS (PARTITION BY doc_id ORDER BY i)
    ), again AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, second, third) AS c
        FROM places WHERE third IS NOT NULL
    ), repeats AS (
        SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE c > 1) GROUP BY doc_id
    ), counts AS (
        SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
               coalesce(r.n, 0)::BIGINT AS n_repeat_words
        FROM words w LEFT JOIN repeats r USING (doc_id)
    ), metrics AS (
        SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
               CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length,
               CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbols,
               CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines))) * 1000 // len(lines) ELSE 0 END
                   AS dup_lines,
               CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats
        FROM counts
    ), sketch AS (
        SELECT lang, source, metric, {bins} AS bin, count(*) AS n FROM ({values}) GROUP BY ALL
    ), own AS ({quartiles("lang, source")}), by_lang AS ({quartiles("lang")}), over_all AS ({quartiles("")}),
    chosen AS (
        SELECT o.lang, o.source, metric,
               CASE WHEN o.n >= {quality.SUPPORT} THEN o.q1 WHEN l.n >= {quality.SUPPORT} THEN l.q1 ELSE a.q1 END AS q1,
               CASE WHEN o.n >= {quality.SUPPORT} THEN o.q3 WHEN l.n >= {quality.SUPPORT} THEN l.q3 ELSE a.q3 END AS q3
        FROM own o JOIN by_lang l USING (metric) JOIN over_all a USING (metric)
        WHERE o.lang IS NOT DISTINCT FROM l.lang
    ), limits AS (
        SELECT lang, source, {limits} FROM (
            SELECT lang, source, metric, q1 - ({quality.WIDTH} * (q3 - q1) + {least}) AS low,
                   q3 + ({quality.WIDTH} * (q3 - q1) + {least}) AS high FROM chosen)
        GROUP BY ALL
    )
    SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {checks} AS kept
    FROM metrics m LEFT JOIN limits t
      ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
    """


def _decontaminate() -> str:
    separators = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
    WITH items AS (
        SELECT item_id, w, least(10, len(w)) AS n
        FROM (SELECT item_id, {_words(_LOWER, separators)} AS w FROM benchmark)
        WHERE len(w) > 0 AND item_id IS NOT NULL
    ), windows AS (
        SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win
        FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM items)
    ), docs AS (
        SELECT doc_id, {_words(_LOWER, separators)} AS w FROM documents
    ), sizes AS (SELECT DISTINCT n FROM windows),
    cut AS (
        SELECT doc_id, n, i, w[i:i + n - 1] AS win
        FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
    ), found AS (
        SELECT doc_id, i, cut.n, item_id FROM cut JOIN windows ON cut.n = windows.n AND cut.win = windows.win
    ), hit AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
    ), named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """


_SUBSTRINGS = f"""
    WITH docs AS (SELECT doc_id, {_words("text")} AS w FROM documents),
    cut AS (
        SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
        FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS owner FROM cut) WHERE owner < doc_id
    ), spread AS (
        SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs
    ), kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
        FROM spread ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)
"""

_NEAR = f"""
    WITH RECURSIVE docs AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
        FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (
        SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
        WHERE 100 * k >= 75 * (s.n + t.n - k)
    ), both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reach AS (
        SELECT doc_id, doc_id AS other FROM docs
        UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x
    ), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM docs JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _urls() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))

    def fits(name, prefix):
        return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{prefix}')"

    rule = " ".join(f"WHEN {fits(n, p)} THEN '{n}{p}'" for _, n, p in rules)
    verdict = " ".join(f"WHEN {fits(n, p)} THEN '{v}'" for v, n, p in rules)
    prior, alike = url_filter.PRIOR, url_filter.ALIKE
    return f"""
    WITH split AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
        FROM pages
    ), ruled AS (
        SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS rule_verdict,
               list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM split
    ), wild AS (
        SELECT *, list_transform(segments, lambda s: CASE
            WHEN regexp_matches(regexp_replace(s, '\\.[A-Za-z]{{1,5}}$', ''), '^[0-9]+$')
              OR (regexp_matches(regexp_replace(s, '\\.[A-Za-z]{{1,5}}$', ''), '^[0-9A-Za-z_-]{{6,}}$')
                  AND regexp_matches(regexp_replace(s, '\\.[A-Za-z]{{1,5}}$', ''), '[0-9]'))
            THEN '*' || substr(s, length(regexp_replace(s, '\\.[A-Za-z]{{1,5}}$', '')) + 1) ELSE s END) AS parts
        FROM ruled
    ), wide AS (
        SELECT host FROM wild GROUP BY host HAVING count(DISTINCT coalesce(parts[1], '')) > {url_filter.MAX_CHILDREN}
    ), named AS (
        SELECT page_id, host, path, rule, rule_verdict,
               array_to_string([CASE WHEN host IN (FROM wide) AND coalesce(parts[1], '') <> '' THEN '*'
                                ELSE coalesce(parts[1], '') END]
                   || list_transform(parts[2:], lambda s, i: CASE WHEN i < 2 THEN s ELSE '*' END), '/') AS template
        FROM wild
    ), own AS (
        SELECT host, template, count(rule_verdict) AS n, count(*) FILTER (rule_verdict = 'block') AS k
        FROM named GROUP BY ALL
    ), base AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0 END AS p FROM own),
    merged AS (
        SELECT template, (sum(k) + {prior} * max(p)) / (sum(n) + {prior}) AS mp FROM own, base GROUP BY template
    ), scored AS (
        SELECT host, template, CASE
            WHEN n = 0 OR abs(k / greatest(n, 1) - mp) <= {alike} * sqrt(mp * (1 - mp) / greatest(n, 1)) THEN mp
            ELSE (k + {prior} * mp) / (n + {prior}) END AS purity
        FROM own JOIN merged USING (template)
    )
    SELECT page_id, host, path, rule,
           coalesce(rule_verdict, CASE WHEN host <> '' AND purity > {url_filter.REJECT_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict,
           template, round(purity, 9) AS purity
    FROM named JOIN scored USING (host, template)
    """


def _repair() -> str:
    """The cheapest edits row by row: for each state the least (cost, audit), forward over a conversation."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    user, assistant = "'user:'", "'assistant:'"
    return f"""
    WITH RECURSIVE bits(v, x, k) AS (
        SELECT v, v::BIGINT, 0 FROM range(256) t(v) UNION ALL
        SELECT v, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, k + 1 FROM bits WHERE k < 8
    ), crc AS (
        SELECT list(x ORDER BY v) AS t FROM bits WHERE k = 8
    ), given AS (
        SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, *,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
    ), hashed AS (
        SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(
                   list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda l: ord(l)::BIGINT)),
                   lambda a, b: xor(a // 256, crc.t[(xor(a, b) % 256) + 1])
               ), 4294967295) % 20 AS kind FROM given, crc
    ), damaged AS (
        SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
    ), seen AS (
        SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS times, rtrim(text, {blanks}) AS shown,
               substr(role, 1, 1) AS l, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM placed
    ), told AS (
        SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN times > 1 THEN 'duplicate'
                       WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
    ), counts AS (
        SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
               count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
               count(*) FILTER (WHERE fault = 'truncated') AS truncated,
               count(*) FILTER (WHERE before IS NOT NULL AND before || l NOT IN ('su', 'ua', 'au')) AS illegal
        FROM told GROUP BY c
    ), ins(s, t, cost, audit, lines) AS (
        VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 2, 'I', [{user}]), (0, 3, 4, 'II', [{user}, {assistant}]),
               (1, 1, 0, '', []::VARCHAR[]), (1, 2, 2, 'I', [{user}]), (1, 3, 4, 'II', [{user}, {assistant}]),
               (2, 2, 0, '', []::VARCHAR[]), (2, 3, 2, 'I', [{assistant}]),
               (3, 3, 0, '', []::VARCHAR[]), (3, 2, 2, 'I', [{user}])
    ), moves(s, e, l, t) AS (
        VALUES (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3),
               (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2),
               (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2)
    ), dp AS (
        SELECT g.c, 0::BIGINT AS i, ins.t, {{'cost': ins.cost, 'audit': ins.audit}} AS key, ins.lines
        FROM (SELECT DISTINCT c FROM given) g, ins WHERE ins.s = 0
        UNION ALL
        SELECT c, i, t, min(key), arg_min(lines, key) FROM (
            SELECT dp.c, r.i, ins.t,
                   {{'cost': dp.key.cost + ins.cost + CASE m.e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
                        + CASE WHEN m.e <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END,
                     'audit': dp.key.audit || m.e || ins.audit}} AS key,
                   list_concat(list_concat(dp.lines, CASE m.e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text]
                       ELSE [CASE m.t WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || r.text] END), ins.lines) AS lines
            FROM dp JOIN told r ON r.c = dp.c AND r.i = dp.i + 1 JOIN moves m ON m.s = dp.t JOIN ins ON ins.s = m.t
            WHERE m.e = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (m.e = 'R' OR m.l = r.l))
        ) GROUP BY c, i, t
    ), best AS (
        SELECT dp.c, min(key) AS key, arg_min(lines, key) AS lines
        FROM dp LEFT JOIN counts USING (c) WHERE dp.i = coalesce(counts.n, 0) AND dp.t IN (0, 3) GROUP BY dp.c
    )
    SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, best.key.cost::BIGINT AS cost, best.key.audit AS audit,
           sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
    FROM (SELECT DISTINCT c, conv_id FROM given) g JOIN best USING (c) LEFT JOIN counts USING (c)
    """


ORACLES = {
    "op1_quality_rules": _quality(),
    "op6_decontaminate": _decontaminate(),
    "op7_suffix_dedup": _SUBSTRINGS,
    "op9_near_duplicates": _NEAR,
    "op10_url_templates": _urls(),
    "op13_conversation_repair": _repair(),
}
