"""The same as some registered queries in DuckDB SQL."""

from __future__ import annotations

from factloom.llm.chat_format import CONTROLS

#: The template's control strings as a pattern.
_CONTROL = "\\\\|" + "|".join(x.replace("[", "\\[").replace("]", "\\]") for x in CONTROLS)
#: Rows of conversations and of the awkward one; turns in order, with the length of each turn's marks.
CHAT_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
w AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS written,
  CASE role WHEN 'user' THEN 10 + 8 WHEN 'assistant' THEN 1 + 4 WHEN 'system' THEN 9 + 7 ELSE 9 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) + length(role) - length(replace(role, ']', '')) + 2 + 8 END AS marks FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(written + marks)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id"""

#: Sets of shingles of each document, links by what two sets share, and the smallest id that links lead to.
JOIN_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS shingle FROM d),
n AS MATERIALIZED (SELECT d.doc_id, count(shingle) AS size FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS one, b.doc_id AS other, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT one, other FROM p JOIN n x ON one = x.doc_id JOIN n y ON other = y.doc_id WHERE 100 * shared >= 85 * (x.size + y.size - shared)),
e AS MATERIALIZED (SELECT one, other FROM l UNION ALL SELECT other, one FROM l),
c AS (SELECT doc_id, doc_id AS near FROM n UNION SELECT c.doc_id, e.other FROM c JOIN e ON c.near = e.one)
SELECT doc_id, size::BIGINT AS n_shingles, (SELECT min(near) FROM c WHERE c.doc_id = n.doc_id) AS component_id FROM n"""


def _cell(cost: str, letter: str, out: str, of: str) -> str:
    """A way on from the cell of: its cost, letters and rows so far."""
    return f"CASE WHEN {of} IS NOT NULL THEN {{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}', 'o': {out.format(of=of)}}} END"


def _least(*cells: str) -> str:
    return f"list_min(list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL))"


def _insert(of: str, role: str) -> str:
    return _cell("2", "I", f"list_append({{of}}.o, '{role}:')", of)


def _row(letter: str, initial: str, role: str, of: str) -> str:
    """A row that is kept or given another role, if it may be."""
    cost = "more" if letter == "K" else "2 + more"
    may = f"sound AND initial = '{initial}'" if letter == "K" else "sound"
    return f"CASE WHEN {may} THEN {_cell(cost, letter, f'list_append({{of}}.o, {role} || {chr(39)}:{chr(39)} || text)', of)} END"


_STEP = {
    "b": _cell("3", "D", "{of}.o", "b"),
    "s": _least(_cell("3", "D", "{of}.o", "s"), _row("K", "s", "role", "b")),
    "u": _least(_cell("3", "D", "{of}.o", "u"), *(_row("K", "u", "role", x) for x in "bsa"), *(_row("R", "", "'user'", x) for x in "bsa")),
    "a": _least(_cell("3", "D", "{of}.o", "a"), _row("K", "a", "role", "u"), _row("R", "", "'assistant'", "u")),
}
#: Inserted turns: to the user's place from all others, then to the assistant's.
_TO_USER = _least("u", *(_insert(x, "user") for x in "bsa"))
_CELL = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"
#: Rows after damage with their faults, the best way to each place in the pattern row by row (cost, then letters), and the best of the ends.
REPAIR_SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS way FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN way = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE way <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k FROM d),
f AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o),
r AS MATERIALIZED (SELECT conv_id, k, role, text, initial, fault NOT IN ('blank', 'duplicate') AS sound, (fault = 'truncated')::BIGINT AS more FROM f),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, {{'c': 0, 'a': '', 'o': []}}::{_CELL} AS b, NULL::{_CELL} AS s, {{'c': 2, 'a': 'I', 'o': ['user:']}}::{_CELL} AS u, {{'c': 4, 'a': 'II', 'o': ['user:', 'assistant:']}}::{_CELL} AS a FROM r
  UNION ALL SELECT conv_id, k, b, s, u, {_least("a", _insert("u", "assistant"))} AS a FROM (SELECT conv_id, k, b, s, {_TO_USER} AS u, a FROM (
    SELECT r.conv_id, r.k, {", ".join(f"{x} AS {n}" for n, x in _STEP.items())} FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1))),
e AS (SELECT conv_id, arg_max({_least("b", "a")}, k) AS best FROM w GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON i.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN e ON i.conv_id IS NOT DISTINCT FROM e.conv_id"""
