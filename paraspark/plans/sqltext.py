"""Oracle SQL fragments (DuckDB dialect) mirroring the adapters and functions.

These strings are the independent check: the same rules written in plain
SQL, evaluated by another engine on the same Parquet tables.
"""

from __future__ import annotations

from paraspark import schemas as S
from paraspark.plans import adapters as A

WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in S.WS_CHARS) + ")"
PREFIX_RE2 = f"{S.PREFIX_WORD}.*?:{S.WS_CLASS}*"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def clean(x: str) -> str:
    d1 = f"regexp_replace({x}, {q(PREFIX_RE2)}, '', 'g')"
    d2 = f"replace(replace(replace({d1}, {q(chr(92) + 'xa0')}, ' '), chr(160), ' '), chr(8201), ' ')"
    d3 = f"replace(replace({d2}, {q(chr(92) + chr(39))}, {q(chr(39))}), {q(chr(92))}, ' ')"
    return strip_ws(d3)


def drop_nl(x: str, mode: str = "native") -> str:
    return f"replace({x}, {q(chr(92) + 'n') if mode == 'row_repr' else 'chr(10)'}, '')"


def drop_markers(x: str) -> str:
    return f"replace(replace({x}, {q(S.ASSISTANT_MARK)}, ''), {q(S.USER_MARK)}, '')"


def normalize_lang(x: str) -> str:
    cases = " ".join(f"WHEN lower({x}) = {q(k)} THEN {q(v)}" for k, v in S.LANGUAGE_ALIAS.items())
    return f"(CASE {cases} ELSE lower({x}) END)"


def model_code(x: str) -> str:
    cases = " ".join(f"WHEN {x} = {q(k)} THEN {q(v)}" for k, v in S.MODEL_LANG_CODE.items())
    return f"(CASE {cases} END)"


def pick(values: list, idx: str) -> str:
    return "[" + ", ".join(q(v) for v in values) + f"][({idx}) + 1]"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(q(v) for v in values)})"


def exportable(st="source_lang", tt="target_lang", sx="source_text", tx="target_text") -> str:
    known = list(S.MODEL_LANG_CODE)
    return (f"{in_list(st, known)} AND {in_list(tt, known)} AND coalesce(length({sx}) > 0, false) "
            f"AND coalesce(length({tx}) > 0, false)")


DIRTY = (f"replace(text, ' the ', ' ' || chr(160) || 'the' || chr(92) || ' ')")

TURNS = f"""turns AS (
  SELECT conv_id, turn, role,
         CASE WHEN conv_id % 3 = 0 AND role = 'user' THEN {q(A.DIRTY_PREFIX)} || {DIRTY} ELSE {DIRTY} END AS content
  FROM (SELECT conv_id, turn, text,
               CASE WHEN role = 'user' AND conv_id % {A.NO_USER_EVERY} = {A.NO_USER_REST} THEN 'narrator'
                    WHEN role = 'assistant' AND (conv_id + turn) % 5 = 3 THEN 'user' ELSE role END AS role
        FROM conversations))"""

SAMPLES = f"""samples AS (
  SELECT DISTINCT conv_id,
         'src' || CAST(conv_id % 3 AS VARCHAR) AS dataset,
         CAST(conv_id AS VARCHAR) AS id,
         {pick(A.DIRECTIONS_BY_MOD5, 'conv_id % 5')} AS direction
  FROM turns)"""

RAW_MIX = f"""raw_mix AS (
  SELECT s.dataset, s.id, s.direction, s.conv_id,
         list(struct_pack(content := t.content, role := t.role) ORDER BY t.turn) AS messages
  FROM turns t JOIN samples s USING (conv_id)
  GROUP BY ALL)"""


def greedy_ctes(src: str = "turns", content_expr: str | None = None, keys=("conv_id",),
                name: str = "greedy") -> str:
    """E3 in long form: within each run of user messages the 1st, 3rd, 5th…
    are visited; the target is the next message when it is an assistant."""
    k = ", ".join(keys)
    content_expr = content_expr or clean(drop_nl("content"))
    return f"""{name}_m AS (
  SELECT {k}, turn, role, {content_expr} AS content FROM {src}),
{name}_w AS (
  SELECT *, lead(role) OVER (PARTITION BY {k} ORDER BY turn) AS nrole,
            lead(content) OVER (PARTITION BY {k} ORDER BY turn) AS ncontent,
            sum(CASE WHEN role = 'user' THEN 0 ELSE 1 END)
              OVER (PARTITION BY {k} ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run_id
  FROM {name}_m),
{name}_u AS (
  SELECT *, row_number() OVER (PARTITION BY {k}, run_id ORDER BY turn) AS k FROM {name}_w WHERE role = 'user'),
{name} AS (
  SELECT {k}, turn, row_number() OVER (PARTITION BY {k} ORDER BY turn) - 1 AS pos,
         content AS texte_cible,
         CASE WHEN nrole = 'assistant' THEN ncontent ELSE '' END AS traduction
  FROM {name}_u WHERE k % 2 = 1)"""


FLAT_PAIRS = f"""flat AS (
  SELECT s.id, g.pos,
         {normalize_lang("split_part(s.direction, '_', 1)")} AS source_lang, g.texte_cible AS source_text,
         {normalize_lang("split_part(s.direction, '_', 2)")} AS target_lang, g.traduction AS target_text
  FROM greedy g JOIN samples s USING (conv_id)
  WHERE {in_list('s.direction', S.KEPT_DIRECTIONS)})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


FLAGSHIP = with_(TURNS, SAMPLES, greedy_ctes(), FLAT_PAIRS) + f"""
SELECT source_lang, target_lang, count(*) AS total
FROM (SELECT DISTINCT source_lang, source_text, target_lang, target_text FROM flat WHERE {exportable()})
GROUP BY source_lang, target_lang
ORDER BY total DESC, source_lang, target_lang"""


def target_of(x: str) -> str:
    return f"translate({x}, {q(A.ASCII_LOWER)}, {q(A.ASCII_UPPER)})"


TR = f"""tr AS (
  SELECT doc_id AS id, {pick(A.SOURCE_LANGS_BY_MOD4, 'doc_id % 4')} AS source_lang, text AS source_text,
         {pick(A.TARGET_LANGS_BY_MOD4, 'doc_id % 4')} AS target_lang, {target_of('text')} AS target_text
  FROM documents)"""

TRN = f"""trn AS (
  SELECT id, {normalize_lang('source_lang')} AS source_lang, source_text,
         {normalize_lang('target_lang')} AS target_lang, target_text FROM tr)"""

LINES = f"""lines AS (
  SELECT doc_id, lang, pos - 1 AS pos, line FROM (
    SELECT doc_id, lang, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, lang, list_transform(string_split({strip_ws('text')}, chr(10)), lambda x: {strip_ws('x')}) AS parts
          FROM documents))
  WHERE line <> '')"""


def py_repr(x: str) -> str:
    body = (f"replace(replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), "
            f"chr(9), chr(92) || 't'), chr(160), chr(92) || 'xa0')")
    return (f"(CASE WHEN contains({x}, chr(39)) AND NOT contains({x}, '\"') THEN '\"' || {body} || '\"' "
            f"ELSE chr(39) || replace({body}, chr(39), chr(92) || chr(39)) || chr(39) END)")


# the mixed (marked) messages of even conversations, in long form: one row per
# message, ``mpos`` gives their order
MARKED = f"""ua AS (
  SELECT conv_id, turn, role, content,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rdesc
  FROM turns WHERE role IN ('user', 'assistant') AND conv_id % 2 = 0 AND turn < {A.MARK_TURNS}),
ua_last AS (SELECT conv_id, role = 'assistant' AS last_is_asst, content AS last_content FROM ua WHERE rdesc = 1),
ua_body AS (
  SELECT u.conv_id,
         regexp_replace(string_agg('<|' || u.role || '|>' || u.content, '' ORDER BY u.turn), '^<\\|user\\|>', '') AS joined
  FROM ua u JOIN ua_last l USING (conv_id)
  WHERE NOT (l.last_is_asst AND u.rdesc = 1)
  GROUP BY u.conv_id),
marked_msgs AS (
  SELECT conv_id, 0 AS mpos, coalesce(b.joined, '') AS content, 'user' AS role
  FROM ua_last l LEFT JOIN ua_body b USING (conv_id)
  UNION ALL
  SELECT conv_id, 1 AS mpos, last_content AS content, 'assistant' AS role
  FROM ua_last WHERE last_is_asst
  UNION ALL
  SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND turn >= {A.MARK_TURNS} THEN turn + 2 ELSE turn END AS mpos, content, role
  FROM turns WHERE conv_id % 2 = 1 OR turn >= {A.MARK_TURNS}
     OR conv_id NOT IN (SELECT conv_id FROM ua_last))"""


HYPREF = f"""hr AS (
  SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS key, a.text AS hyp, u.text AS ref,
         array_to_string(list_filter(string_split_regex({strip_ws('a.text')}, {q(S.WS_CLASS + '+')}), lambda t, i: (i - 1) % 3 <> 2), ' ') AS hyp_b
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
  WHERE a.role = 'assistant')"""
