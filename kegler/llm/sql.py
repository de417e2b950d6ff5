"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), il AS (
  SELECT item_id, ws, least(10, len(ws)) AS n FROM iw WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM il)
), lens AS (
  SELECT DISTINCT n FROM win
), dwin AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dw, lens WHERE len(ws) >= n)
), hit AS (
  SELECT doc_id, p, dwin.n AS n, item_id FROM dwin JOIN win ON dwin.w = win.w AND dwin.n = win.n
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT dw.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""


_SPACE = r"[\x20\x09-\x0D]"


def op5() -> str:
    """Base counts and the concentration steps of ``quality``, one after the other."""
    from kegler.llm import quality as q

    dims = range(1, q.P + 1)
    pairs = [(x, y) for x in dims for y in range(x, q.P + 1)]
    dbl = lambda x: f"CAST({x!r} AS DOUBLE)"
    join = "ON r.lang IS NOT DISTINCT FROM e.lang AND r.source IS NOT DISTINCT FROM e.source"
    share = lambda x, of: f"ln({dbl(1)} + {dbl(100)} * {x} / {of})"
    unit = lambda x: f"CAST(floor({x} * {q.UNIT} + {dbl(0.5)}) AS BIGINT)"
    words, chars = "greatest(n_words, 1)", "greatest(word_chars, 1)"

    def factored(table: str) -> str:
        """The scatter as L D L', column by column."""
        inner = f"SELECT * FROM {table}"
        for k in dims:
            d = f"s{k}{k} + {dbl((q.FLOORS[k - 1] / q.UNIT) ** 2)}" + "".join(f" - l{k}{j} * l{k}{j} * d{j}" for j in range(1, k))
            inner = f"SELECT *, {d} AS d{k} FROM ({inner})"
            rest = [f"(s{k}{i}" + "".join(f" - l{k}{j} * l{i}{j} * d{j}" for j in range(1, k)) + f") / d{k} AS l{i}{k}" for i in range(k + 1, q.P + 1)]
            inner = f"SELECT *, {', '.join(rest)} FROM ({inner})" if rest else inner
        return f"SELECT *, {' * '.join(f'd{k}' for k in dims)} AS det FROM ({inner})"

    def distances(table: str) -> str:
        inner = f"SELECT r.*, e.* EXCLUDE (lang, source) FROM r LEFT JOIN {table} AS e {join}"
        for k in dims:
            inner = f"SELECT *, (x{k} - m{k}) / CAST({q.UNIT} AS DOUBLE)" + "".join(f" - l{k}{j} * y{j}" for j in range(1, k)) + f" AS y{k} FROM ({inner})"
        return f"SELECT *, {' + '.join(f'y{k} * y{k} / d{k}' for k in dims)} AS distance FROM ({inner})"

    out = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), tri AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, p, array_to_string(ws[p:p + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w))
), rep AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM tri WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), c AS (
  SELECT w.doc_id AS doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines ON w.doc_id = lines.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id
), b AS (
  SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         {unit(f"ln(CAST({chars} AS DOUBLE) / {words})")} AS x1, {unit(share("n_symbols", chars))} AS x2,
         {unit(share("n_repeat_words", words))} AS x3, {unit(share("n_dup_lines", words))} AS x4
  FROM c
), r AS MATERIALIZED (
  SELECT * FROM b WHERE NOT base_failed
), cuts AS (
  SELECT lang, source, k, {", ".join(f"CAST(min(CASE WHEN upto >= {dbl(at)} * total THEN v END) AS DOUBLE) AS {name}" for name, at in (("a", 0.25), ("b", 0.5), ("c", 0.75)))} FROM (
    SELECT lang, source, k, v, sum(n) OVER (PARTITION BY lang, source, k ORDER BY v) AS upto, sum(n) OVER (PARTITION BY lang, source, k) AS total
    FROM (SELECT lang, source, e.k AS k, e.v AS v, count(*) AS n FROM (SELECT lang, source, unnest([{", ".join(f"{{'k': {k}, 'v': CAST(floor(x{k} / CAST({q.COARSE} AS DOUBLE)) AS BIGINT) * {q.COARSE}}}" for k in dims)}]) AS e FROM r) GROUP BY ALL)
  ) GROUP BY lang, source, k
), wide AS (
  SELECT lang, source, {", ".join(f"max(CASE WHEN k = {k} THEN {c} END) AS {c}{k}" for k in dims for c in "abc")} FROM cuts GROUP BY lang, source
), e0 AS MATERIALIZED (
"""
    starts = []
    for number, (c, spread) in enumerate((("b", False), ("b", True), ("a", True), ("c", True))):
        sd = lambda k: f"((c{k} - a{k}) / {dbl(q.UNIT * q.QUARTILES)})"
        scatter = ", ".join((f"{sd(x)} * {sd(x)}" if spread and x == y else dbl(0.0)) + f" AS s{x}{y}" for x, y in pairs)
        starts.append(f"  SELECT lang, source, {number} AS start, {', '.join(f'{c}{k} AS m{k}' for k in dims)}, {scatter} FROM wide")
    out += " UNION ALL\n".join(starts) + "\n)"
    moments = ["n", *(f"t{k}" for k in dims), *(f"t{x}{y}" for x, y in pairs)]
    for k in range(q.STEPS):
        out += f""", f{k} AS MATERIALIZED (
  {factored(f"e{k}")}
), bins{k} AS (
  SELECT lang, source, start, CAST(floor(ln({dbl(1)} + distance) * {q.BINS}) AS BIGINT) AS v, count(*) AS n,
         {", ".join(f"sum(x{x}) AS t{x}" for x in dims)}, {", ".join(f"sum(x{x} * x{y}) AS t{x}{y}" for x, y in pairs)}
  FROM ({distances(f"f{k}")}) GROUP BY lang, source, start, v
), e{k + 1} AS MATERIALIZED (
  SELECT lang, source, start, {", ".join(f"CAST(t{x} AS DOUBLE) / n AS m{x}" for x in dims)},
         {", ".join(f"CAST(CAST(n AS HUGEINT) * t{x}{y} - t{x} * t{y} AS DOUBLE) / (CAST(n AS DOUBLE) * n) / CAST({q.UNIT * q.UNIT} AS DOUBLE) * {dbl(q.CONSISTENCY)} AS s{x}{y}" for x, y in pairs)}
  FROM (SELECT lang, source, start, {", ".join(f"sum({c}) AS {c}" for c in moments)} FROM (
    SELECT *, sum(n) OVER (PARTITION BY lang, source, start ORDER BY v) AS upto, sum(n) OVER (PARTITION BY lang, source, start) AS total FROM bins{k}
  ) WHERE upto - n < {dbl(q.KEPT)} * total GROUP BY lang, source, start)
)"""
    return out + f""", best AS (
  SELECT * FROM ({factored(f"e{q.STEPS}")}) QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY det, start) = 1
), judged AS (
  {distances("best").replace("FROM r LEFT JOIN", "FROM b AS r LEFT JOIN")}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(distance <= {dbl(q.CUTOFF)}, false) AS kept
FROM judged
"""


OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[p:p + 4], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT w.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least ON w.doc_id = least.a
"""


_ESCAPE = r"replace(replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>'), '<|', '<\|')"

OP3 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learned,
         sum(length({_ESCAPE.format("text")}) + length(replace({_ESCAPE.format("role")}, ':', '\:')) + 14) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": OP3, "op5_quality_outliers": op5(), "op8_ngram_jaccard": OP8, "op9_decontamination": OP9}
