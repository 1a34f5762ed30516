"""DuckDB SQL of queries in this subpackage."""

from __future__ import annotations


def _step(to: str) -> str:
    """Cheapest way into a state by one row, as (cost, edits, lines)."""
    def way(src: str, edits: str, cost: int, keeps: str = "") -> str:
        """From state src; keeps: the initial that a kept row must have."""
        inserted = {"u": "assistant:", "a": "user:"}.get(to, "")
        line = "r.role || ':' || r.text" if edits[-1] == "K" else f"'{ {'u': 'user:', 'a': 'assistant:'}.get(to, '') }' || r.text"
        lines = ([f"'{inserted}'"] if edits[0] == "I" else []) + [line]
        if edits == "D":
            return f"CASE WHEN p.{src} IS NOT NULL THEN {{'c': p.{src}.c + 3, 'w': p.{src}.w || 'D', 't': p.{src}.t}} END"
        test = f" AND r.initial = '{keeps}'" if keeps else ""
        return (f"CASE WHEN p.{src} IS NOT NULL AND NOT r.blank AND NOT r.duplicate{test} THEN {{'c': p.{src}.c + {cost} + r.truncated::BIGINT, "
                f"'w': p.{src}.w || '{edits}', 't': list_concat(p.{src}.t, [{', '.join(lines)}])}} END")
    ways = [way(to, "D", 3)]
    if to == "s":
        ways.append(way("e", "K", 0, "s"))
    if to in "ua":
        for src in "esua":
            before = "" if (src == "u") == (to == "a") else "I"
            ways += [way(src, before + "K", 2 * len(before), to), way(src, before + "R", 2 + 2 * len(before))]
    return "list_min(list_filter([" + ", ".join(ways) + "], lambda x: x IS NOT NULL))"


_NO_WAY = "NULL::STRUCT(c BIGINT, w VARCHAR, t VARCHAR[])"

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
keyed AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(crc, byte)), 4294967295::BIGINT)) % 20 AS kind
  FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open FROM placed),
turns AS (SELECT conv_id, turn, role, text, n, left(role, 1) AS initial, blank, again AND NOT blank AS duplicate, open AND NOT again AND NOT blank AS truncated,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
           count(*) FILTER (truncated) AS truncated, count(*) FILTER (coalesce(illegal, false)) AS illegal, max(n) AS n FROM turns GROUP BY conv_id),
way AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'w': ''::VARCHAR, 't': []::VARCHAR[]}} AS e, {_NO_WAY} AS s, {_NO_WAY} AS u, {_NO_WAY} AS a FROM (SELECT DISTINCT conv_id FROM raw)
  UNION ALL
  SELECT p.conv_id, r.n, {_step('e')}, {_step('s')}, {_step('u')}, {_step('a')}
  FROM way p JOIN turns r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = p.n + 1),
ended AS (
  SELECT w.conv_id, list_min(list_filter([w.e, w.a, CASE WHEN w.u IS NOT NULL THEN {{'c': w.u.c + 2, 'w': w.u.w || 'I', 't': list_concat(w.u.t, ['assistant:'])}} END,
         CASE WHEN w.s IS NOT NULL THEN {{'c': w.s.c + 4, 'w': w.s.w || 'II', 't': list_concat(w.s.t, ['user:', 'assistant:'])}} END], lambda x: x IS NOT NULL)) AS best,
         coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal
  FROM way w LEFT JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id WHERE w.n = coalesce(f.n, 0))
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
       CAST(illegal AS BIGINT) AS illegal, best.c AS cost, best.w AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256 FROM ended"""


DECONTAMINATION = r"""
WITH item AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
short AS (SELECT item, w, least(10, len(w)) AS n FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM short, unnest(range(1, len(w) - n + 2)) AS t(i)),
doc AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM short),
seen AS (SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM doc, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
known AS (SELECT DISTINCT n, win FROM win),
hit AS (SELECT s.row, s.i, s.n, s.win FROM seen s JOIN known k ON s.n = k.n AND s.win = k.win),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY row),
held AS (SELECT row, list_sort(list(DISTINCT item)) AS items FROM (SELECT DISTINCT row, n, win FROM hit) h JOIN win USING (n, win) GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(h.items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(h.items, ','), '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (row) LEFT JOIN held h USING (row)"""


HARD_NEGATIVES = """
WITH vec AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.id AS anchor_id, a.v AS av, b.id, b.v AS bv, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM vec a JOIN vec b ON len(a.v) = len(b.v) AND NOT (a.id = b.id AND a.label = b.label AND a.v = b.v) WHERE a.id % 100 = 0),
scored AS (SELECT anchor_id, av, id, bv, same, coalesce(score, 0) AS score FROM pair),
positive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, av ORDER BY score DESC, id) AS nth FROM scored WHERE same) WHERE nth <= 5),
negative AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.av, p.nth ORDER BY n.score DESC, n.id) AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND n.av = p.av AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10"""
