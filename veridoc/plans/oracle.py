"""Plain SQL for the derived tables, used by the per-query checks (DuckDB dialect).

`with_(names, body)` prefixes the common table expressions a check needs, in dependency order.
"""

from __future__ import annotations

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    _CTES[name] = (needs, sql)


def with_(body: str, *names: str) -> str:
    done: list[str] = []

    def visit(n: str) -> None:
        for d in _CTES[n][0]:
            visit(d)
        if n not in done:
            done.append(n)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n][1]})" for n in done)
    return f"WITH {head}\n{body}"


cte("marks", "SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id")
cte("docs", r"""
SELECT side, doc_id, lang, product, channel, edited, text,
  '/data/' || channel || '/' || product || '/' || (CASE WHEN side = 'S' THEN 'Source' ELSE '2026_R11/Target' END) || '/' ||
  (CASE WHEN side = 'S' OR lang NOT IN ('fr', 'de', 'es') THEN 'DOC_' || num
        WHEN lang = 'fr' THEN 'DOC_' || num || '_cible-2026-11-10'
        WHEN lang = 'de' THEN 'ANNEX_' || num
        ELSE 'Hoja ' || translate(num, '0123456789', 'abcdefghij') END) || '.pdf' AS path
FROM (SELECT sd.side, d.doc_id, d.lang, d.source AS product, d.text,
        CASE WHEN CAST(substr(d.source, 4) AS INTEGER) < 7 THEN 'Broker' ELSE 'Bank' END AS channel,
        coalesce(m.quality, 0) = 1 AS edited, lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS num
      FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
      CROSS JOIN (VALUES ('S'), ('T')) sd(side)
      WHERE sd.side = 'S' OR coalesce(m.toxic, 0) = 0)
""", "marks")
cte("toks", r"""
SELECT side, doc_id, lang, product, channel, path, list_filter(list_transform(arr, lambda x, j: CASE
  WHEN side = 'S' THEN CASE WHEN (j-1) % 80 = 20 THEN '13/11/2026'
    WHEN (j-1) % 50 = 10 THEN CAST(100 + doc_id % 900 AS VARCHAR) || ',00' ELSE x END
  ELSE CASE WHEN (j-1) % 80 = 20 THEN '14/11/2026'
    WHEN (j-1) % 50 = 10 THEN CAST(100 + doc_id % 900 + CASE WHEN edited THEN doc_id % 5 ELSE 0 END AS VARCHAR) || ',00'
    WHEN edited AND (doc_id + (j-1)) % 211 = 7 THEN 'x' || x
    WHEN edited AND (doc_id + (j-1)) % 223 = 11 THEN '' ELSE x END END), lambda x: x <> '') AS toks
FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS arr FROM docs)
""", "docs")
cte("words", r"""
SELECT side, doc_id, lang, product, channel, path, pos, text,
  CAST(line // 50 + 1 AS INTEGER) AS page, CAST(line % 50 AS INTEGER) AS line_on_page,
  CAST(40 + 42 * col AS DOUBLE) AS x0, CAST(800 - 15 * (line % 50) AS DOUBLE) AS y0,
  CAST(40 + 42 * col + 5 * least(length(text), 7) AS DOUBLE) AS x1, CAST(810 - 15 * (line % 50) AS DOUBLE) AS y1,
  CAST(10 AS DOUBLE) AS font_size
FROM (SELECT *, pos // per_line AS line, pos % per_line AS col FROM (
  SELECT side, doc_id, lang, product, channel, path, unnest(toks) AS text, generate_subscripts(toks, 1) - 1 AS pos,
    CASE WHEN side = 'T' AND lang = 'de' THEN 13 ELSE 12 END AS per_line FROM toks))
""", "toks")
cte("raw_words", r"""
SELECT w.* EXCLUDE (text, x0, x1, long_word, twice), p.sub AS sub,
  CASE WHEN long_word AND p.sub = 0 THEN substr(text, 1, 4) WHEN long_word THEN substr(text, 5) ELSE text END AS text,
  CASE WHEN p.sub = 0 THEN x0 WHEN long_word THEN x0 + 17.5 ELSE x0 + 0.5 END AS x0,
  CASE WHEN long_word AND p.sub = 0 THEN x0 + 17 WHEN twice AND p.sub = 1 THEN x1 + 0.5 ELSE x1 END AS x1,
  1 AS n_letters, CAST(5 AS DOUBLE) AS glyph_span, CAST(595 AS DOUBLE) AS page_w, CAST(842 AS DOUBLE) AS page_h
FROM (SELECT *, length(text) >= 9 AND NOT contains(text, ' ') AS long_word,
        regexp_matches(text, '^[A-Z][a-z]+$') AND length(text) < 9 AS twice FROM (
  SELECT side, doc_id, lang, product, channel, path, pos, page, line_on_page,
    CASE WHEN pos % 149 = 8 THEN '#SIGN_1#' WHEN pos % 151 = 9 THEN 'SPECIMEN'
         WHEN pos % 157 = 12 THEN 'D000 ' || text
         WHEN pos % 131 = 7 AND line_on_page >= 44 THEN 'Exemplaire' ELSE text END AS text,
    CASE WHEN pos % 97 = 5 THEN 50.0::DOUBLE WHEN pos % 101 = 3 THEN 1.2::DOUBLE WHEN pos % 107 = 6 THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END AS font_size,
    CASE WHEN pos % 103 = 4 THEN 0.97::DOUBLE ELSE 0::DOUBLE END AS grey, pos % 109 <> 2 AS horizontal,
    CASE WHEN pos % 109 = 2 THEN 10::DOUBLE ELSE x0 END AS x0, CASE WHEN pos % 109 = 2 THEN 20::DOUBLE ELSE x1 END AS x1,
    CASE WHEN pos % 113 = 1 THEN -40::DOUBLE ELSE y0 END AS y0, CASE WHEN pos % 113 = 1 THEN -30::DOUBLE ELSE y1 END AS y1
  FROM words)) w JOIN (VALUES (0), (1)) p(sub) ON p.sub = 0 OR long_word OR twice
""", "words")
