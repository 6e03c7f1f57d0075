"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .queries import LISTED, RULES


def _values(entries) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in entries)


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
items AS (SELECT item_id, i, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS n FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
wins AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, wins.i, n, item_id, win FROM wins JOIN items USING (win, n)),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
-- windows that follow each other in document and item are one match; a match's words are those of its windows together
steps AS (SELECT h.doc_id, h.i AS p0, h.n, t.item_id, t.i AS o, h.i - t.i AS line FROM hits h JOIN items t USING (win, n, item_id)),
runs AS (SELECT *, sum((prev IS NULL OR prev <> p0 - 1)::INT) OVER (PARTITION BY doc_id, item_id, n, line ORDER BY p0) AS run FROM (SELECT *, lag(p0) OVER (PARTITION BY doc_id, item_id, n, line ORDER BY p0) AS prev FROM (SELECT DISTINCT * FROM steps))),
long AS (SELECT doc_id, n + count(*) - 1 AS words, min(p0) - 1 AS p0 FROM runs GROUP BY doc_id, item_id, n, line, run),
most AS (SELECT doc_id, max(words) AS words FROM long GROUP BY doc_id),
best AS (SELECT doc_id, words, min(p0) AS p0 FROM long JOIN most USING (doc_id, words) GROUP BY doc_id, words),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(best.words, 0)::BIGINT AS longest_words, best.p0::BIGINT AS longest_at
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN marks USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP4 = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://([^?#]*)', 1) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '/.*$'), '') AS path FROM u),
e(kind, h, p, v) AS (SELECT 'rule', * FROM (VALUES {_values(RULES)}) UNION ALL SELECT 'listed', * FROM (VALUES {_values(LISTED)})),
m AS (SELECT page_id, kind, arg_max(e.h || e.p, length(e.h || e.p)) AS s, arg_max(v, length(e.h || e.p)) AS v FROM p JOIN e ON (p.host = e.h OR ends_with(p.host, '.' || e.h)) AND starts_with(p.path, e.p) GROUP BY ALL)
SELECT p.page_id, host, path, r.s AS rule, coalesce(r.v, l.v, 'allow') AS verdict, l.s AS listed
FROM p LEFT JOIN m r ON r.page_id = p.page_id AND r.kind = 'rule' LEFT JOIN m l ON l.page_id = p.page_id AND l.kind = 'listed'"""

OP7 = r"""
WITH r AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / w AS fill, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(lv, fill) FROM l WHERE lv <= fill))::DOUBLE AS target FROM l),
c AS (SELECT r.*, source_size, target, floor(target) AS stop, coalesce('s' || r.source, 'n') AS src, coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, row_number() OVER () AS id FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
-- the slots: van der Corput points of a binary fraction each, by the source in whose share of the line of targets they lie
q AS (SELECT coalesce('s' || source, 'n') AS src, target, (SELECT sum(target) FROM t WHERE target >= 1) AS total FROM t WHERE target >= 1),
k AS (SELECT *, greatest(4, ceil(log2(greatest(1.0, total / 8192))))::INT AS m, sum(target) OVER (ORDER BY src) AS high, row_number() OVER (ORDER BY src) AS nth, lead(src) OVER (ORDER BY src) AS next FROM q),
e AS (SELECT *, 1 << m AS points, ceil(coalesce(lag(high) OVER (ORDER BY src), 0.0) / total * (1 << m))::BIGINT AS j0, CASE WHEN next IS NULL THEN 1 << m ELSE least(ceil(high / total * (1 << m)), 1 << m) END::BIGINT AS j1 FROM k),
p AS (SELECT src, target, greatest(j1 - j0, 1) AS slots, unnest(CASE WHEN j1 > j0 THEN list_transform(range(j0, j1), lambda j: list_sum(list_transform(range(m), lambda i: ((j >> i) & 1) << (m - 1 - i)))::BIGINT) ELSE [points + nth] END) AS slot FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM p),
b AS (SELECT src, slot, floor(rank * target / slots) AS lo, CASE WHEN rank + 1 = slots THEN floor(target) ELSE floor((rank + 1) * target / slots) END AS hi FROM g),
u AS (SELECT id, src, a + x AS st, least(a + x + size, stop) AS en FROM (SELECT *, unnest([0, source_size]) AS x FROM c WHERE size > 0) WHERE least(a + x + size, stop) > a + x),
w2 AS (SELECT id, sum(least(en, hi) - greatest(st, lo))::BIGINT AS taken, min(slot)::BIGINT AS first_slot, count(*) AS n_pieces FROM u JOIN b ON u.src = b.src AND lo < en AND hi > st GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_pieces, 0) AS n_pieces FROM c LEFT JOIN w2 USING (id)"""

_CONTROL = r"[<\[]\\*(/?s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>)"
OP10 = rf"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + length(role) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""


# crc32, bit by bit
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
_WORD = r"[^\x20\x09-\x0D]"
OP11 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS l, {_CRC.format("conv_id::VARCHAR")} % 4 AS h FROM t GROUP BY conv_id),
full_ AS (SELECT own.conv_id, coalesce(b.l, [])[1:own.h] || own.l[own.h + 1:] AS r FROM own LEFT JOIN own b ON b.conv_id = own.conv_id - own.conv_id % 20),
p AS (SELECT conv_id, d, r[1:d] AS k, len(r) = d AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(r[d].text, '{_WORD}+')) ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(r) + 1)) AS d FROM full_)),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(w) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS e FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS c FROM node WHERE d > 0 GROUP BY ALL),
both_ AS (SELECT node.*, coalesce(c, 0) AS c FROM node LEFT JOIN kids USING (k)),
sub AS (SELECT k[1:x] AS k, sum(own) AS saved, count(*) FILTER (c = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS x FROM both_) GROUP BY ALL)
SELECT b.conv_id, b.d::BIGINT AS depth, up.conv_id AS parent_conv_id, b.n::BIGINT AS n_convs, b.c::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, b.e AS ends_sha256
FROM both_ b JOIN sub USING (k) LEFT JOIN both_ up ON b.d > 0 AND up.d = b.d - 1 AND up.k = b.k[1:b.d - 1]"""

# a repair's heads as states e(mpty), s(ystem), u(ser asked), p(air answered); each has the least (cost, audit), rows by rows
_ADD = "CASE WHEN {0} IS NULL THEN NULL ELSE {{'c': {0}.c + {1}, 'a': {0}.a || '{2}'}} END"
_LEAST = "list_min(list_filter([{}], lambda x: x IS NOT NULL))"


def _put_in(**of: str) -> str:
    """States with the turns that may be put in behind them: to u from e, s, p, and from u to p; two in a row too."""
    u = [of["u"], *(_ADD.format(of[x], 2, "I") for x in "esp")]
    p = [of["p"], _ADD.format(of["u"], 2, "I"), *(_ADD.format(of[x], 4, "II") for x in "es")]
    return f"{of['e']} AS e, {of['s']} AS s, {_LEAST.format(', '.join(u))} AS u, {_LEAST.format(', '.join(p))} AS p"


def _row(state: str) -> str:
    """A state's least (cost, audit) behind one more row."""
    gone = _ADD.format(state, 3, "D")
    kept = {"e": [], "s": [("e", "s")], "u": [("e", "u"), ("s", "u"), ("p", "u")], "p": [("u", "a")]}[state]
    moves = [gone, *(f"CASE WHEN NOT go AND i = '{c}' THEN {_ADD.format(x, 'cut', 'K')} END" for x, c in kept), *(f"CASE WHEN NOT go THEN {_ADD.format(x, '2 + cut', 'R')} END" for x, c in kept if c != "s")]
    return _LEAST.format(", ".join(moves))


OP13 = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations WHERE conv_id IS NOT NULL),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM k)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS copy, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM n),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_WORD}') THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN regexp_matches(text, '[.!?][ 	-]*\z') THEN '' ELSE 'truncated' END AS fault FROM seen),
r AS (SELECT conv_id, n, left(role, 1) AS i, fault IN ('blank', 'duplicate') AS go, (fault = 'truncated')::BIGINT AS cut FROM f),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, {_put_in(e="{'c': 0::BIGINT, 'a': ''}", s="NULL::STRUCT(c BIGINT, a VARCHAR)", u="NULL::STRUCT(c BIGINT, a VARCHAR)", p="NULL::STRUCT(c BIGINT, a VARCHAR)")} FROM (SELECT DISTINCT conv_id FROM k)
  UNION ALL
  SELECT conv_id, n, {_put_in(e="e", s="s", u="u", p="p")} FROM (SELECT conv_id, r.n, {_row("e")} AS e, {_row("s")} AS s, {_row("u")} AS u, {_row("p")} AS p FROM walk JOIN r USING (conv_id) WHERE r.n = walk.n + 1)
),
best AS (SELECT conv_id, arg_max({_LEAST.format("e, p")}, n) AS b FROM walk GROUP BY conv_id),
-- the audit's letters with the row that each is about, and the place of each turn in the repair
l AS (SELECT conv_id, b.a AS a, unnest(range(1, length(b.a) + 1)) AS x FROM best),
m AS (SELECT conv_id, x, a[x] AS letter, length(replace(a[:x], 'I', '')) AS n, length(replace(a[:x], 'D', '')) AS place FROM l),
first_ AS (SELECT conv_id, letter = 'K' AND i = 's' AS sys FROM m JOIN r USING (conv_id, n) WHERE place = 1 AND letter <> 'D'),
made AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (place - coalesce(sys, false)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY x)) AS h FROM m LEFT JOIN f USING (conv_id, n) LEFT JOIN first_ USING (conv_id) WHERE letter <> 'D' GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM best LEFT JOIN made USING (conv_id) LEFT JOIN c USING (conv_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3, "op4_urls": OP4, "op7_mix": OP7, "op10_chat": OP10, "op11_trie": OP11, "op13_repair": OP13}
