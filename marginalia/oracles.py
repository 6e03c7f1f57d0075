"""DuckDB SQL for the queries, on the same tables."""

from __future__ import annotations

import re

from .operators.detectors import ARTIFACTS, OPENERS
from .operators.rules import RULES
from .queries import EDITS, OWN_RULES
from .seeds import seeded_sql

#: Stands for "any letter, digit or underscore" where RE2 knows ASCII only.
_WORD = r"[\p{L}\p{N}_]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    p = re.sub(r"(?<=\w)\.(?=\w)", "['’ʼ]", pattern)
    p = p.replace(r"\b[\w-]+", _WORD + r"[\p{L}\p{N}_-]*").replace(r"[\w-]+\b", r"[\p{L}\p{N}_-]*" + _WORD).replace(r"[\w-]", r"[\p{L}\p{N}_-]")
    return "(?im)" + p


def _found(name: str, pattern: str, source: str = "paras", extra: str = "", cut: str = "length(m)") -> str:
    """(doc_id, seg_idx, start, end, matched): all matches in the quotes of ``source``; lengths of matches and of what is between them add up."""
    return f"""SELECT doc_id, seg_idx, {extra} start + sum(g) OVER w + sum(l) OVER w - l AS s, start + sum(g) OVER w + sum(l) OVER w - l + {cut} AS e, m, quote
      FROM (SELECT doc_id, seg_idx, start, quote, i, m, length(m) AS l, length(gaps[i]) AS g FROM (
        SELECT *, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
          SELECT doc_id, seg_idx, start, quote, regexp_extract_all(quote, {_q(pattern)}) AS ms, regexp_split_to_array(quote, {_q(pattern)}) AS gaps FROM {source})))
      WINDOW w AS (PARTITION BY doc_id, seg_idx ORDER BY i)"""


DOCS = f"docs AS ({seeded_sql()})"
LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
  marked AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS st, lag(line, 1, '') OVER (PARTITION BY doc_id ORDER BY i) AS prev, max(i) OVER (PARTITION BY doc_id) AS n FROM lines),
  opened AS (SELECT *, sum((length(prev) = 0 OR regexp_full_match(line, '\\s+') AND i < n)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS pid FROM marked WHERE length(line) > 0),
  paras AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1)::INT AS seg_idx, min(st)::INT AS start, string_agg(line, chr(10) ORDER BY i) AS quote FROM opened GROUP BY doc_id, pid)"""
PARAS = f"{DOCS}, {LINES}"
SENTS = """pieces AS (SELECT doc_id, seg_idx AS par, start, unnest(string_split(regexp_replace(quote, '(\\S[.!?])(\\s+)', '\\1' || chr(31) || '\\2', 'g'), chr(31))) AS p, generate_subscripts(string_split(regexp_replace(quote, '(\\S[.!?])(\\s+)', '\\1' || chr(31) || '\\2', 'g'), chr(31)), 1) AS i FROM paras),
  tiled AS (SELECT doc_id, par, i, start + sum(length(p)) OVER (PARTITION BY doc_id, par ORDER BY i) AS stop, regexp_replace(p, '^\\s+', '') AS quote FROM pieces),
  sents AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY par, i) - 1)::INT AS seg_idx, (stop - length(quote))::INT AS start, quote FROM tiled WHERE length(quote) > 0)"""


def _tells(source: str = "paras") -> str:
    parts, k = [], 0
    for r in RULES:
        for p in r.patterns:
            p, cut = (r"!(\s|$)", "1") if r.id == "exclamation" else (p, "length(m)")
            parts.append(_found(r.id, _re2(p) if r.id != "exclamation" else "(?m)" + p, source, f"{_q(r.id)} AS rule, {_q(r.tier)} AS tier, {r.weight!r}::DOUBLE AS weight, {k} AS ord,", cut))
            k += 1
    return f"tells_{source} AS MATERIALIZED (" + "\n    UNION ALL ".join(parts) + ")"


LATE = f"""WITH {DOCS}, b AS (SELECT doc_id, sha256(d.text) AS now, sha256(p.text) AS old FROM docs d JOIN documents p USING (doc_id)),
  t AS (SELECT doc_id, now, CASE WHEN doc_id % 3 <> 0 THEN 4 WHEN now = old THEN 3 ELSE 2 END::BIGINT AS ticket FROM b)
  SELECT doc_id, now AS text_sha256, ticket, 'reading ' || ticket || ' of ' || left(now, 8) AS report FROM t"""

#: Words and signs of the counted model.
MODEL_TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x09-\x0D\x20]"

# The engine's patterns as RE2 writes them.
QUOTED_RE = r'`[^`\n]+`|"[^"\n]{0,200}"|“[^”\n]{0,200}”'
MARKUP_RE = r"^\s*(#{1,6}\s|[-*+]\s|\d+[.)]\s|\||>\s|```|~~~|\[[^\]]+\]:|[-=]{3,}\s*$)"
_WORDS = "len(regexp_extract_all({}, '[A-Za-z0-9’'']+'))"


def _signals(source: str = "paras") -> str:
    """CTEs that end in sig_<source> (doc_id, seg_idx, name, direction, weight, detector, s, e, at, quote): all signals."""
    t = source

    def found(name: str, direction: str, weight: float, detector: str, pattern: str, where: str = "true", cut: str = "length(m)", flags: str = "") -> str:
        return f"SELECT doc_id, seg_idx, {_q(name)} AS name, {_q(direction)} AS direction, {weight!r}::DOUBLE AS weight, {_q(detector)} AS detector, s, e, s AS at FROM ({_found(name, flags + pattern, t, '', cut)}) WHERE {where}"

    def whole(name: str, direction: str, weight: float, detector: str, where: str) -> str:
        return f"SELECT doc_id, seg_idx, {_q(name)}, {_q(direction)}, {weight!r}::DOUBLE, {_q(detector)}, NULL::INT, NULL::INT, start FROM {t} WHERE {where}"

    markup = f"(regexp_matches(quote, {_q(MARKUP_RE)}) OR contains(quote, '```'))"
    size = "CASE " + " ".join(f"WHEN starts_with(lower(quote), {_q(o)}) THEN {len(o)}" for o in OPENERS) + " END"
    spread = f"""SELECT doc_id, seg_idx, start, len(ns) AS n, sqrt(len(ns) * list_sum(list_transform(ns, lambda x: x * x)) - list_sum(ns) * list_sum(ns)) / list_sum(ns) AS cv FROM (
      SELECT doc_id, seg_idx, start, list_filter(list_transform(regexp_extract_all(quote, '[^.!?\\n]+[.!?]?'), lambda p: {_WORDS.format('p')}), lambda n: n >= 3) AS ns FROM {t})"""
    return f"""{_tells(t)},
  quoted_{t} AS MATERIALIZED ({_found('q', QUOTED_RE, t)}),
  cv_{t} AS ({spread}),
  sig_{t} AS MATERIALIZED (
    SELECT doc_id, seg_idx, rule AS name, 'machine' AS direction, weight, 'tells' AS detector, s::INT AS s, e::INT AS e, s::INT AS at FROM tells_{t} x
      WHERE NOT EXISTS (SELECT 1 FROM quoted_{t} q WHERE q.doc_id = x.doc_id AND q.seg_idx = x.seg_idx AND q.s <= x.s AND x.s < q.e)
    UNION ALL {found('em-dash', 'machine', 0.12, 'forensic', '—')}
    UNION ALL {whole('mixed-apostrophes', 'human', 0.35, 'forensic', "contains(quote, '''') AND contains(quote, '’')")}
    UNION ALL {found('trailing-whitespace', 'human', 0.25, 'forensic', '[ \\t]+$', flags='(?m)')}
    UNION ALL {found('mid-sentence-newline', 'human', 0.45, 'forensic', '[a-z,;]\\n[a-z]', f'NOT {markup}')}
    UNION ALL {whole('no-terminal-punctuation', 'human', 0.30, 'forensic', f"NOT {markup} AND {_WORDS.format('quote')} >= 4 AND NOT regexp_matches(regexp_replace(quote, '[[:space:]]+$', ''), '[.!?:;)\\]\"''’”]$')")}
    UNION ALL {found('unicode-artifact', 'machine', 0.15, 'forensic', ARTIFACTS)}
    UNION ALL {found('not-x-but-y', 'machine', 0.30, 'rhetoric', r'\bnot (?:just|merely|simply) [^,.;:]{2,45},? but\b', flags='(?i)')}
    UNION ALL {found('colon-tricolon', 'machine', 0.45, 'rhetoric', r':\s*[^,.:;]{4,90},\s*[^,.:;]{4,90},\s*and\s+[^.]{4,90}[.!?]')}
    UNION ALL SELECT doc_id, seg_idx, 'discourse-opener', 'machine', 0.2::DOUBLE, 'rhetoric', start, start + {size}, start FROM {t} WHERE {size} IS NOT NULL
    UNION ALL {found('concede-pivot', 'machine', 0.35, 'rhetoric', r'\bi (?:do |really do |genuinely )?(?:value|appreciate|respect|understand)\b[^.]{0,80}\.\s*(?:at the same time|that said|however|but)\b', flags='(?i)')}
    UNION ALL SELECT doc_id, seg_idx, CASE WHEN cv < 0.35 THEN 'low-burstiness' ELSE 'high-burstiness' END, CASE WHEN cv < 0.35 THEN 'machine' ELSE 'human' END, 0.25::DOUBLE, 'rhythm', NULL::INT, NULL::INT, start FROM cv_{t} WHERE n >= 6 AND (cv < 0.35 OR cv > 0.7))"""


def _label(lean: str, strength: str, m: str, h: str) -> str:
    return f"CASE WHEN {strength} < 0.2 THEN 'no-evidence' WHEN {lean} >= 0.45 THEN 'leans-machine' WHEN {lean} <= -0.45 THEN 'leans-human' WHEN {m} > 0 AND {h} > 0 THEN 'mixed-signals' ELSE 'uncertain' END"


def _scored(source: str, signals: str, out: str = "scored", full: str = "1.5 * greatest(1.0, length(quote) / 1000.0)") -> str:
    """CTEs that end in ``out``: segments with sums, lean, strength and label."""
    part = lambda d: f"coalesce(sum((weight * 10000)::BIGINT) FILTER (direction = '{d}'), 0)::BIGINT AS {d[0]}"
    return f"""sums_{out} AS (SELECT doc_id, seg_idx, count(*) AS k, {part('machine')}, {part('human')}, {part('neutral')} FROM {signals} GROUP BY ALL),
  base_{out} AS (SELECT p.doc_id, p.seg_idx, p.start, p.quote, coalesce(k, 0) AS n_signals, coalesce(m, 0) AS m, coalesce(h, 0) AS h, coalesce(n, 0) AS n FROM {source} p LEFT JOIN sums_{out} USING (doc_id, seg_idx)),
  nums_{out} AS (SELECT *, CASE WHEN m + h > 0 THEN round_even((m - h)::DOUBLE / (m + h), 3) ELSE 0.0 END::DOUBLE AS lean, round_even(least((m + h + n)::DOUBLE / (10000 * ({full})), 1.0), 3)::DOUBLE AS strength FROM base_{out}),
  {out} AS MATERIALIZED (SELECT *, {_label('lean', 'strength', 'm', 'h')} AS label FROM nums_{out})"""


def _rolled(scored: str, out: str = "rolled") -> str:
    """CTEs that end in ``out``: documents with their verdicts."""
    return f"""agg_{out} AS (SELECT doc_id, count(*) AS n_segments, sum(n_signals)::BIGINT AS n_signals, count(*) FILTER (label IN ('leans-machine', 'leans-human')) AS directed, sum(m)::BIGINT AS m, sum(h)::BIGINT AS h, sum(n)::BIGINT AS n FROM {scored} GROUP BY doc_id),
  num_{out} AS (SELECT d.*, length(d.text) AS n_chars, coalesce(n_segments, 0) AS n_segments, coalesce(n_signals, 0) AS n_signals, coalesce(m, 0) AS m, coalesce(h, 0) AS h, coalesce(directed, 0) > 0 AND m + h > 0 AS own, directed, n FROM docs d LEFT JOIN agg_{out} USING (doc_id)),
  val_{out} AS (SELECT *, CASE WHEN own THEN round_even((m - h)::DOUBLE / (m + h), 3) ELSE 0.0 END::DOUBLE AS lean, CASE WHEN own THEN round_even(least(directed::DOUBLE / n_segments / 0.35, (m + h + n)::DOUBLE / (10000 * 1.5 * greatest(1.0, n_chars / 1000.0)), 1.0), 3) ELSE 0.0 END::DOUBLE AS strength FROM num_{out}),
  {out} AS (SELECT *, CASE WHEN own THEN {_label('lean', 'strength', 'm', 'h')} ELSE 'no-evidence' END AS label FROM val_{out})"""


READERS = """judged AS (SELECT doc_id, unnest([
    {'reader': 'a', 'direction': 'machine', 'quote': NULL::VARCHAR, 'a': 0, 'b': 20, 'name': 'opening', 'weight': 0.5::DOUBLE},
    {'reader': 'b', 'direction': 'machine', 'quote': substring(text, 6, 10), 'a': NULL, 'b': NULL, 'name': 'middle', 'weight': 0.3::DOUBLE},
    {'reader': 'b', 'direction': 'human', 'quote': NULL, 'a': 0, 'b': 5, 'name': 'warm', 'weight': 0.4::DOUBLE},
    {'reader': 'c', 'direction': 'human', 'quote': NULL, 'a': 0, 'b': 30, 'name': 'whole', 'weight': 0.2::DOUBLE},
    {'reader': 'c', 'direction': 'machine', 'quote': 'no such words', 'a': NULL, 'b': NULL, 'name': 'gone', 'weight': 0.9::DOUBLE},
    {'reader': 'd', 'direction': NULL, 'quote': NULL, 'a': NULL, 'b': NULL, 'name': NULL, 'weight': NULL}], recursive := true), text FROM docs),
  placed AS (SELECT doc_id, reader, direction, coalesce(name, 'judgment') AS name, weight, CASE WHEN quote IS NULL THEN a WHEN instr(text, quote) > 0 THEN instr(text, quote) - 1 END::INT AS a, CASE WHEN quote IS NULL THEN b WHEN instr(text, quote) > 0 THEN instr(text, quote) - 1 + length(quote) END::INT AS b, quote IS NOT NULL AND instr(text, quote) = 0 AS dropped FROM judged),
  flagged AS (SELECT u.doc_id, u.seg_idx AS unit, reader, direction, u.start, u.quote, name, weight FROM sents u JOIN placed j ON u.doc_id = j.doc_id AND NOT dropped AND direction IS NOT NULL AND u.start < j.b AND u.start + length(u.quote) > j.a),
  own AS (SELECT doc_id, unit, direction, start, quote, reader, max(weight) AS weight, list(DISTINCT name) AS names FROM flagged GROUP BY ALL),
  units AS (SELECT doc_id, unit, direction, start, start + length(quote) AS "end", quote, string_agg(reader, ',' ORDER BY reader) AS readers, array_to_string(list_sort(list_distinct(flatten(list(names)))), ',') AS shapes, round_even((sum(weight::DECIMAL(9,4))::DOUBLE / count(*))::DECIMAL(18,10), 2)::DOUBLE AS weight, count(*) AS n FROM own GROUP BY doc_id, unit, direction, start, quote)"""


def _readings(k: int, out: str, units: str = "units", readers: str = "true") -> str:
    return f"""{out} AS (SELECT d.doc_id, {k} AS k, (SELECT count(DISTINCT reader) FILTER ({readers}) FROM judged g WHERE g.doc_id = d.doc_id)::BIGINT AS n_readers, 'sentence' AS unit, coalesce(u.c, 0) AS n_units, len(regexp_extract_all(text, '\\S+')) AS n_words, coalesce(x.machine, 0) AS machine, coalesce(x.human, 0) AS human
      FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS c FROM sents GROUP BY 1) u USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) FILTER (direction = 'machine') AS machine, count(*) FILTER (direction = 'human') AS human FROM {units} WHERE n >= {k} GROUP BY 1) x USING (doc_id))"""


def _rate(count: str, words: str) -> str:
    return f"CASE WHEN {words} > 0 THEN round_even(1000.0::DOUBLE * {count} / {words}, 2)::DOUBLE END"


TRUTH = "truth AS (SELECT d.doc_id, length(o.text) + 2 AS a, length(d.text) AS b FROM docs d JOIN documents o USING (doc_id) WHERE length(d.text) > length(o.text))"


def _fractions(scored: str) -> str:
    return f"""{TRUTH}, frac AS (SELECT s.*, CASE WHEN a IS NULL THEN 0 ELSE greatest(0, least(start + length(quote), b) - greatest(start, a)) END AS c0 FROM {scored} s LEFT JOIN truth USING (doc_id)),
  sided AS (SELECT *, coalesce(c0, 0) AS covered, coalesce(c0, 0) / greatest(1, length(quote))::DOUBLE AS fraction, CASE WHEN coalesce(c0, 0) / greatest(1, length(quote))::DOUBLE >= 0.8 THEN 'machine' WHEN coalesce(c0, 0) / greatest(1, length(quote))::DOUBLE <= 0.2 THEN 'human' END AS side FROM frac)"""


def _card(table: str, group: str = "") -> str:
    lead = "side IS NOT NULL AND lean <> 0 AND n_signals > 0"
    return f"""SELECT {group} sum(n_signals)::BIGINT AS signals, count(*) FILTER (side = 'machine') AS machine_total, count(*) FILTER (side = 'human') AS human_total, count(*) FILTER ({lead}) AS decisive, count(*) FILTER ({lead} AND (lean > 0) = (side = 'machine')) AS agreements,
    count(*) FILTER (side = 'machine' AND label = 'leans-machine') AS machine_hits, count(*) FILTER (side IS NOT NULL AND label = 'leans-machine') AS machine_flagged, count(*) FILTER (side = 'human' AND label = 'leans-human') AS human_hits, count(*) FILTER (side IS NOT NULL AND label = 'leans-human') AS human_flagged FROM {table}"""


def _share(a: str, b: str) -> str:
    return f"coalesce({a}::DOUBLE / nullif({b}, 0), 0.0)::DOUBLE"


def _mapped(edits: tuple, table: str) -> str:
    """CTEs that follow each row of ``table`` (s, e) through the edits, one by one."""
    out, at = [], table
    move = lambda p, a, b, n, behind: f"CASE WHEN {p} < {a} THEN {p} WHEN {p} > {b} THEN {p} + {n - (b - a)} ELSE {a} + CASE WHEN " + ("true" if a == b and behind else "false" if a == b else f"{p} = {b} AND {p} <> {a} OR ({p} NOT IN ({a}, {b}) AND {str(behind).lower()})") + f" THEN {n} ELSE 0 END END"
    for k, (_, a, b, n) in enumerate(edits):
        out.append(f"moved{k}_{table} AS (SELECT * REPLACE (({move('s', a, b, n, True)})::INT AS s, ({move('e', a, b, n, False)})::INT AS e) FROM {at}), met{k}_{table} AS (SELECT * REPLACE (bad OR ({a} <= e AND {a + n} >= s) AS bad) FROM moved{k}_{table})")
        at = f"met{k}_{table}"
    return ", ".join(out)


def oracle_sql() -> dict[str, str]:
    p, ps = f"WITH {PARAS}", f"WITH {PARAS}, {SENTS}"
    sig, sigs = f"{p}, {_signals()}", f"{ps}, {_signals('sents')}"
    scored, rolled = f"{sig}, {_scored('paras', 'sig_paras')}", f"{sig}, {_scored('paras', 'sig_paras')}, {_rolled('scored')}"
    rd = f"{ps}, {READERS}"
    rounded = lambda c, n=3: f"round_even({c}, {n})::DOUBLE AS {c}"
    place = lambda t: f"{t}.s::INT AS start, {t}.e::INT AS \"end\""
    score_columns = "doc_id, seg_idx, n_signals::BIGINT AS n_signals, lean, strength, label"
    card_rates = ", ".join(f"{_share(a, b)} AS {k}" for k, a, b in (("machine_recall", "machine_hits", "machine_total"), ("machine_precision", "machine_hits", "machine_flagged"), ("human_recall", "human_hits", "human_total"), ("human_precision", "human_hits", "human_flagged"), ("agreement", "agreements", "decisive")))
    ordered = "row_number() OVER (PARTITION BY doc_id ORDER BY {} weight DESC, coalesce(s, 0), seg_idx, \"at\", name, ord)"
    with_order = "(SELECT x.*, CASE detector WHEN 'tells' THEN 0 WHEN 'forensic' THEN 1 WHEN 'rhetoric' THEN 2 ELSE 3 END AS ord FROM sig_paras x)"
    rules = ", ".join(f"({_q(r.id)}, {_q(r.tier)}, {r.weight!r}::DOUBLE, {len(r.patterns)})" for r in RULES)
    injected = "inj AS (SELECT u.doc_id, u.seg_idx, j.name, j.direction, j.weight FROM sents u JOIN placed j ON u.doc_id = j.doc_id AND reader = 'b' AND NOT dropped AND u.start <= j.a AND j.b <= u.start + length(u.quote)), both_ AS (SELECT doc_id, seg_idx, name, direction, weight FROM sig_sents UNION ALL SELECT * FROM inj)"
    agreed = "inj AS (SELECT u.doc_id, u.seg_idx, 'reader-consensus' AS name, c.direction, least(c.weight, 1.0) AS weight FROM sents u JOIN units c ON u.doc_id = c.doc_id AND c.n >= 2 AND u.start <= c.start AND c.\"end\" <= u.start + length(u.quote)), both_ AS (SELECT doc_id, seg_idx, name, direction, weight FROM sig_sents UNION ALL SELECT * FROM inj)"
    inside = f"{sig}, {TRUTH}, inn AS (SELECT x.*, a IS NOT NULL AND coalesce(2 * greatest(0, least(e, b) - greatest(s, a)) >= e - s AND e > s, false) AS inside FROM sig_paras x LEFT JOIN truth USING (doc_id))"
    raw = _signals().replace("paras", "rawp")
    raw_lines = LINES.replace("docs", "rawd").replace("lines", "rlines").replace("marked", "rmarked").replace("opened", "ropened").replace("paras", "rawp")
    human = f"rawd AS (SELECT doc_id, text FROM documents), {raw_lines}, {raw}"
    acc = """h AS (SELECT detector, name, direction, max(weight) AS w1, count(DISTINCT doc_id) FILTER (direction = 'machine') AS human_docs, count(*) FILTER (direction = 'machine') AS human_hits FROM sig_rawp GROUP BY ALL)"""
    ladder = ", ".join(f"sig_{d} AS (SELECT * FROM sig_sents WHERE detector = '{d}'), {_scored('sents', f'sig_{d}', f'sc_{d}')}" for d in ("tells", "forensic", "rhetoric"))
    ladder_cards = " UNION ALL ".join(f"SELECT '{d}' AS rung, * FROM ({_card(f'sd_{d}')})" for d in ("tells", "forensic", "rhetoric"))
    ladder_sided = ", ".join(_fractions(f"sc_{d}").removeprefix(TRUTH + ", ").replace("frac ", f"fr_{d} ").replace("FROM frac", f"FROM fr_{d}").replace("sided", f"sd_{d}") for d in ("tells", "forensic", "rhetoric"))
    every = [tuple(n for k, n in enumerate(("tells", "forensic", "rhetoric", "rhythm")) if m >> k & 1) for m in range(1, 16)]
    cube = ", ".join(f"cb{k} AS (SELECT * FROM sig_sents WHERE detector IN ({', '.join(map(_q, x))})), {_scored('sents', f'cb{k}', f'sc_cb{k}')}, " + _fractions(f"sc_cb{k}").removeprefix(TRUTH + ", ").replace("frac ", f"fr_cb{k} ").replace("FROM frac", f"FROM fr_cb{k}").replace("sided", f"sd_cb{k}") for k, x in enumerate(every))
    cube_cards = " UNION ALL ".join(f"SELECT {_q('+'.join(x))} AS rung, * FROM ({_card(f'sd_cb{k}')})" for k, x in enumerate(every))
    sweep = " UNION ALL ".join(f"SELECT {'NULL' if r is None else r}::DOUBLE AS reference, doc_id, lang, label FROM ro_{r or 0}" for r in (None, 4000, 2000, 1500, 1000, 750, 500))
    sweep_ctes = ", ".join(_scored("paras", "sig_paras", f"sc_{r or 0}", "1.5" if r is None else f"1.5 * greatest(1.0, length(quote) / {r}.0)") + ", " + _rolled(f"sc_{r or 0}", f"ro_{r or 0}") for r in (None, 4000, 2000, 1500, 1000, 750, 500))
    tokens = """tk AS MATERIALIZED (SELECT doc_id, i - 1 AS tok_idx, (sum(g) OVER w + sum(l) OVER w - l)::INT AS a, (sum(g) OVER w + sum(l) OVER w)::INT AS b, l::DOUBLE AS x FROM (SELECT doc_id, i, length(m) AS l, length(gaps[i]) AS g FROM (SELECT *, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ms, regexp_split_to_array(text, '\\S+') AS gaps FROM docs))) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  cum AS MATERIALIZED (SELECT doc_id, list(x ORDER BY tok_idx) AS xs, list_prepend(0.0, list(sx ORDER BY tok_idx)) AS sums, count(*) AS n FROM (SELECT *, sum(x) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS sx FROM tk) GROUP BY doc_id),
  lows AS (SELECT u.doc_id, u.seg_idx, u.start, length(u.quote) AS len, coalesce(t.tok_idx + 1, 0) AS lo FROM sents u ASOF LEFT JOIN tk t ON u.doc_id = t.doc_id AND u.start >= t.b),
  rng AS MATERIALIZED (SELECT l.*, t.tok_idx + 1 AS hi, c.n, c.sums FROM lows l ASOF JOIN tk t ON l.doc_id = t.doc_id AND l.start + l.len > t.a JOIN cum c ON c.doc_id = l.doc_id WHERE t.tok_idx + 1 - lo >= 16),
  vals AS MATERIALIZED (SELECT doc_id, seg_idx, lo, hi, (sums[hi + 1] - sums[lo + 1]) / {per} AS v, list_transform(list_filter(generate_series(0, n - (hi - lo), greatest(1, (hi - lo) // 2)), lambda i: i + hi - lo <= lo OR i >= hi), lambda i: (sums[i + hi - lo + 1] - sums[i + 1]) / {per}) AS ws FROM rng),
  med AS MATERIALIZED (SELECT *, list_aggregate(ws, 'median') AS m FROM vals WHERE len(ws) >= 6),
  own_ AS (SELECT doc_id, seg_idx, hi - lo AS n_tokens, len(ws) AS n_windows, v AS score, m, list_aggregate(list_transform(ws, lambda w: abs(w - m)), 'median') AS d FROM med),
  std_ AS (SELECT *, CASE WHEN d * 1.4826 > 0 THEN {sign} * (score - m) / (d * 1.4826) ELSE 0.0 END AS z FROM own_)"""
    ratio, curvature = tokens.replace("{per}", "(4.0 * (hi - lo))").replace("{sign}", "-1"), tokens.replace("{per}", "sqrt(4.0 * (hi - lo))").replace("{sign}", "1")
    standing = "SELECT doc_id, seg_idx, n_tokens::INT AS n_tokens, n_windows::INT AS n_windows, round_even(score, 4)::DOUBLE AS score, CASE WHEN round_even(z, 3) = 0 THEN 0.0 ELSE round_even(z, 3) END::DOUBLE AS z, CASE WHEN abs(z) >= 2.5 THEN 0.45 WHEN abs(z) >= 1.5 THEN 0.3 END::DOUBLE AS weight FROM std_"
    # a model of three words over one of two over single ones, in full; then each sentence among the windows of its text
    model = """tk AS MATERIALIZED (SELECT doc_id, i - 1 AS tok_idx, (sum(g) OVER w + sum(l) OVER w - l)::INT AS a, (sum(g) OVER w + sum(l) OVER w)::INT AS b, m AS w, lag(m, 1, '') OVER w AS c2, lag(m, 2, '') OVER w AS c1 FROM (SELECT doc_id, i, m, length(m) AS l, length(gaps[i]) AS g FROM (SELECT *, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{re}') AS ms, regexp_split_to_array(text, '{re}') AS gaps FROM docs))) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  n3 AS MATERIALIZED (SELECT c1, c2, w, count(*)::DOUBLE AS n FROM tk GROUP BY ALL), n2 AS MATERIALIZED (SELECT c2, w, sum(n) AS n FROM n3 GROUP BY ALL), n1 AS (SELECT w, sum(n) AS n FROM n2 GROUP BY ALL),
  unk AS (SELECT 1.0::DOUBLE / (sum(n) + count(*) + 1) AS u FROM n1), p1 AS MATERIALIZED (SELECT w, (n + 1) * u AS p FROM n1, unk),
  mo AS (SELECT sum(p * ln(p)) + any_value(u * ln(u)) AS m1, sum(p * ln(p) * ln(p)) + any_value(u * ln(u) * ln(u)) AS m2 FROM p1, unk),
  t2 AS (SELECT c2, sum(n) AS s, count(*) AS k FROM n2 GROUP BY ALL), p2 AS MATERIALIZED (SELECT c2, n2.w, k / (s + k) AS be, k / (s + k) * p1.p AS q, n / (s + k) + k / (s + k) * p1.p AS p FROM n2 JOIN t2 USING (c2) JOIN p1 USING (w)),
  x2 AS MATERIALIZED (SELECT c2, sum(p * ln(p) - q * ln(q)) + max(be) * (ln(max(be)) + any_value(m1)) AS mean, sum(p * ln(p) * ln(p) - q * ln(q) * ln(q)) + max(be) * (ln(max(be)) * ln(max(be)) + 2 * ln(max(be)) * any_value(m1) + any_value(m2)) AS sq FROM p2, mo GROUP BY c2),
  t3 AS (SELECT c1, c2, sum(n) AS s, count(*) AS k FROM n3 GROUP BY ALL), p3 AS MATERIALIZED (SELECT n3.c1, n3.c2, n3.w, k / (s + k) AS be, p2.p AS lo, k / (s + k) * p2.p AS q, n / (s + k) + k / (s + k) * p2.p AS p FROM n3 JOIN t3 USING (c1, c2) JOIN p2 ON p2.c2 = n3.c2 AND p2.w = n3.w),
  y3 AS (SELECT c1, c2, max(be) AS be, sum(p * ln(p) - q * ln(q)) AS g1, sum(p * ln(p) * ln(p) - q * ln(q) * ln(q)) AS g2, sum(lo * (ln(p) - ln(q))) AS x FROM p3 GROUP BY ALL),
  x3 AS MATERIALIZED (SELECT y3.c1, y3.c2, g1 + be * (ln(be) + x2.mean) AS mean, g2 + be * (ln(be) * ln(be) + 2 * ln(be) * x2.mean + x2.sq) AS sq, -(x + ln(be) + x2.mean) AS cr FROM y3 JOIN x2 USING (c2)),
  gr AS MATERIALIZED (SELECT p3.c1, p3.c2, w, ln(p) AS ll, mean, greatest(sq - mean * mean, 0) AS var, cr AS "cross" FROM p3 JOIN x3 ON x3.c1 = p3.c1 AND x3.c2 = p3.c2)""".replace("{re}", MODEL_TOKENS)
    thought = """ts AS MATERIALIZED (SELECT doc_id, tok_idx, a, b, CASE WHEN tok_idx = 0 THEN 0 ELSE {a} END AS x, CASE WHEN tok_idx = 0 THEN 0 ELSE {b} END AS y FROM tk JOIN gr USING (c1, c2, w)),
  cum AS MATERIALIZED (SELECT doc_id, list_prepend(0.0, list(sx ORDER BY tok_idx)) AS sums, list_prepend(0.0, list(sy ORDER BY tok_idx)) AS under, count(*) AS n FROM (SELECT *, sum(x) OVER w AS sx, sum(y) OVER w AS sy FROM ts WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)) GROUP BY doc_id),"""
    of = lambda a, b, per, sign: f"{thought.replace('{a}', a).replace('{b}', b)} " + tokens[tokens.index("lows AS") :].replace("c.sums FROM", "c.sums, c.under FROM").replace("(sums[hi + 1] - sums[lo + 1]) / {per}", per.format("(sums[hi + 1] - sums[lo + 1])", "(under[hi + 1] - under[lo + 1])")).replace("(sums[i + hi - lo + 1] - sums[i + 1]) / {per}", per.format("(sums[i + hi - lo + 1] - sums[i + 1])", "(under[i + hi - lo + 1] - under[i + 1])")).replace("{sign}", sign)
    by_curve, by_cross = of("ll - mean", "var", "CASE WHEN {1} > 0 THEN {0} / sqrt({1}) ELSE 0 END", "1"), of("-ll", '"cross"', "CASE WHEN {1} <> 0 THEN {0} / {1} ELSE 0 END", "-1")
    long_words = lambda source: f"lw AS ({_found('long', '[a-z]{12,}', source)})"
    rows_ = "rows_ AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1)::INT AS seg_idx, st::INT AS start, line AS quote FROM (SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS st FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)) WHERE length(line) > 0)"
    by_cross_too = re.sub(r"\b(ts|cum|lows|rng|vals|med|own_|std_)\b", r"\g<1>2", by_cross)
    numbered = """(SELECT *, (row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY "at", name, ord, l) - 1)::INT AS nth FROM (SELECT x.*, CASE detector WHEN 'tells' THEN 0 WHEN 'forensic' THEN 1 WHEN 'rhetoric' THEN 2 ELSE 3 END AS ord, coalesce(s - e, 0) AS l FROM sig_paras x))"""
    told = lambda c: f"coalesce(round(({c})::DECIMAL(18,2), 1)::DECIMAL(18,1)::VARCHAR, 'n/a')"
    out = {
        "seg_document": "SELECT doc_id, 0 AS seg_idx, 0 AS start, length(text)::INT AS \"end\", sha256(text) AS quote_hash FROM documents",
        "seg_paragraph": f"{p} SELECT doc_id, seg_idx, start, (start + length(quote))::INT AS \"end\", sha256(quote) AS quote_hash FROM paras",
        "seg_sentence": f"{ps} SELECT doc_id, seg_idx, start, (start + length(quote))::INT AS \"end\", sha256(quote) AS quote_hash FROM sents",
        "span_context": f"{p} SELECT doc_id, seg_idx, start, (start + length(quote))::INT AS \"end\", substring(text, greatest(start - 39, 1), least(start, 40)) AS prefix, substring(text, start + length(quote) + 1, 40) AS suffix FROM paras JOIN docs USING (doc_id)",
        "segmenter_list": "SELECT unnest(['paragraph', 'sentence', 'document']) AS name",
        "detector_list": "SELECT unnest(['tells', 'forensic', 'rhetoric', 'rhythm', 'fast-detect-gpt', 'binoculars']) AS name",
        "match_offsets": f"WITH w AS (SELECT doc_id, 0 AS seg_idx, 0 AS start, text AS quote FROM documents) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS nth, s::INT AS start, e::INT AS \"end\", m AS matched FROM ({_found('x', '[a-z]{8,},', 'w')})",
        "utf16_offsets": f"{p} SELECT doc_id, seg_idx, (start + length(quote))::INT AS \"end\", (start + length(quote) + len(regexp_extract_all(substring(text, 1, start + length(quote)), '[\\x{{10000}}-\\x{{10FFFF}}]')))::INT AS utf16_end FROM paras JOIN docs USING (doc_id)",
        "word_counts": f"SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::INT AS n_words, {_WORDS.format('text')}::INT AS n_plain FROM documents",
        "tell_catalogue": f"{p}, {_tells()} SELECT doc_id, seg_idx, rule, tier, weight, {place('tells_paras')} FROM tells_paras",
        "tell_tier_filter": f"{p}, {_tells()} SELECT rule, count(*) AS n FROM tells_paras WHERE tier = 'E' GROUP BY rule",
        "tell_rules": f"SELECT * FROM (VALUES {rules}) t(id, tier, weight, n_patterns)",
        "tell_quoted_suppressed": f"{sig} SELECT doc_id, seg_idx, name, weight, {place('x')} FROM sig_paras x WHERE detector = 'tells'",
        "quoted_ranges": f"{sig} SELECT doc_id, seg_idx, {place('x')} FROM quoted_paras x",
        "markup_segments": f"{p} SELECT doc_id, seg_idx, regexp_matches(quote, {_q(MARKUP_RE)}) OR contains(quote, '```') AS markup FROM paras",
        "forensic_signals": f"{sig} SELECT doc_id, seg_idx, name, direction, weight, {place('x')} FROM sig_paras x WHERE detector = 'forensic'",
        "rhetoric_signals": f"{sig} SELECT doc_id, seg_idx, name, direction, weight, {place('x')} FROM sig_paras x WHERE detector = 'rhetoric'",
        "rhythm_spread": f"{sig} SELECT doc_id, seg_idx, n::INT AS n, {rounded('cv')} FROM cv_paras",
        "signals_all": f"{sig} SELECT doc_id, seg_idx, nth, name, direction, weight, detector, {place('x')} FROM {numbered} x",
        "artifact_values": f"{p} SELECT doc_id, s::INT AS start, chr(34) || 'U+' || printf('%04X', unicode(m)) || chr(34) AS value FROM ({_found('x', ARTIFACTS, 'paras')})",
        "judgment_records": "SELECT doc_id, 'a' AS reader, CASE WHEN doc_id % 3 < 2 THEN 'human' END AS direction, CASE WHEN doc_id % 3 < 2 THEN 'q' || doc_id END AS quote, CASE WHEN doc_id % 3 < 2 THEN '{' || chr(34) || 'n' || chr(34) || ':' || i || '}' END AS value FROM documents, (VALUES (1), (2)) t(i) WHERE i = 1 OR doc_id % 3 = 0",
        "greedy_placement": f"""{sig.replace('WITH ', 'WITH RECURSIVE ', 1)}, o AS MATERIALIZED (SELECT x.*, p.start AS st, row_number() OVER (PARTITION BY x.doc_id, x.seg_idx ORDER BY s, weight DESC, nth) AS i FROM {numbered} x JOIN paras p USING (doc_id, seg_idx) WHERE s IS NOT NULL),
          f AS (SELECT doc_id, seg_idx, i, CASE WHEN s >= st THEN e ELSE st END AS last, s >= st AS kept FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.seg_idx, o.i, CASE WHEN o.s >= f.last THEN o.e ELSE f.last END, o.s >= f.last FROM f JOIN o ON o.doc_id = f.doc_id AND o.seg_idx = f.seg_idx AND o.i = f.i + 1)
          SELECT doc_id, seg_idx, name, {place('o')}, CASE WHEN direction <> 'neutral' THEN round_even(least(greatest(weight, 0.1), 0.6) / 0.6 * 100, 0) END::INT AS shade, round_even(greatest(12.0, weight * 80), 0)::INT AS width FROM f JOIN o USING (doc_id, seg_idx, i) WHERE kept""",
        "json_report_fields": f"{rolled} SELECT doc_id, label, lean, strength, n_signals::BIGINT AS n_signals, n_segments::BIGINT AS n_listed, sha256(text) AS text_sha256, sha256(coalesce((SELECT quote FROM paras q WHERE q.doc_id = rolled.doc_id AND q.seg_idx = 0), '')) AS first_hash FROM rolled",
        "baseline_lines": f"{rd}, {_readings(2, 'r')} SELECT doc_id, '| ' || doc_id || ' | ' || format('{{:,}}', n_words) || ' | ' || n_readers || ' | ' || {told(_rate('machine', 'n_words'))} || ' | ' || {told(_rate('human', 'n_words'))} || ' |' AS line FROM r",
        "baseline_text": f"{rd}, {_readings(2, 'r')}, t AS (SELECT count(*) AS n, sum(n_words)::BIGINT AS n_words, min(k) AS k, string_agg(DISTINCT n_readers::VARCHAR, ', ' ORDER BY n_readers::VARCHAR) AS rs, sum(machine) AS machine, sum(human) AS human, min({_rate('machine', 'n_words')}) AS low, max({_rate('machine', 'n_words')}) AS high FROM r) SELECT concat('# Baseline', chr(10), chr(10), n, ' text(s), ', format('{{:,}}', n_words), ' words; sentences that at least ', k, ' readers flag (readers of a text: ', rs, ').', chr(10), chr(10), '**', {told(_rate('machine', 'n_words'))}, ' per 1,000 words machine-leaning**', printf(', %.1f to %.1f across texts', low, high), '; ', {told(_rate('human', 'n_words'))}, ' human-leaning.', chr(10)) AS markdown FROM t",
        "rule_table": f"WITH {human}, {acc} SELECT row_number() OVER (ORDER BY human_docs DESC, human_hits DESC, name, detector, direction)::INT AS rank, name, detector, direction, human_docs, human_hits FROM h",
        "score_blind": f"{sig}, {_scored('paras', 'sig_paras', full='1.5')} SELECT {score_columns} FROM scored",
        "score_density": f"{scored} SELECT {score_columns} FROM scored",
        "score_sentences": f"{sigs}, {_scored('sents', 'sig_sents')} SELECT {score_columns} FROM scored",
        "score_custom": f"{sig}, {_scored('paras', 'sig_paras', full='CASE WHEN length(quote) < 2000 THEN 1.5 ELSE 1.5 * length(quote) / 1000.0 END')} SELECT doc_id, seg_idx, lean, strength, label FROM scored",
        "label_counts": f"{scored} SELECT label, count(*) AS n FROM scored GROUP BY label",
        "rollup_document": f"{rolled} SELECT doc_id, n_chars::INT AS n_chars, n_segments::BIGINT AS n_segments, n_signals::BIGINT AS n_signals, lean, strength, label FROM rolled",
        "report_flat": f"{rolled} SELECT doc_id, sha256(text) AS text_sha256, n_chars::INT AS n_chars, n_segments::BIGINT AS n_segments, n_signals::BIGINT AS n_signals, lean, strength, label, 'paragraph' AS segmenter, 'tells,forensic,rhetoric,rhythm' AS detectors, 'uncalibrated (density_aggregate)' AS calibration, '1' AS schema_version FROM rolled",
        "saved_reports": f"{rolled} SELECT doc_id, label, n_signals::BIGINT AS n_signals, n_segments::BIGINT AS n_segments, sha256(text) AS text_sha256 FROM rolled",
        "weight_by_direction": f"{sig} SELECT doc_id, direction, sum(weight::DECIMAL(9,4))::DOUBLE AS weight FROM sig_paras GROUP BY ALL",
        "ranked_flags": f"{sig} SELECT doc_id, rank::INT AS rank, name, weight, s::INT AS start FROM (SELECT *, {ordered.format('')} AS rank FROM {with_order}) WHERE rank <= 3",
        "listed_flags": f"{sig} SELECT doc_id, name, direction, weight FROM (SELECT *, {ordered.format('CASE direction WHEN ' + _q('human') + ' THEN 0 WHEN ' + _q('machine') + ' THEN 1 ELSE 2 END,')} AS rank FROM {with_order}) WHERE rank = 1",
        "anchor_quotes": f"{rd} SELECT doc_id, reader, name, a AS start, b AS \"end\", dropped FROM placed",
        "reader_counts": f"{rd} SELECT doc_id, reader, coalesce(any_value(f.machine), 0) AS machine, coalesce(any_value(f.human), 0) AS human, count(*) FILTER (dropped) AS dropped FROM placed LEFT JOIN (SELECT doc_id, reader, count(DISTINCT unit) FILTER (direction = 'machine') AS machine, count(DISTINCT unit) FILTER (direction = 'human') AS human FROM flagged GROUP BY ALL) f USING (doc_id, reader) GROUP BY doc_id, reader",
        "consensus_units": f"{rd} SELECT doc_id, unit, direction, start, \"end\"::INT AS \"end\", readers, shapes, weight FROM units WHERE n >= 2",
        "consensus_listing": f"{rd} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY direction, start, unit))::INT AS rank, direction, unit, start FROM units WHERE n >= 2",
        "consensus_density": f"{rd}, {_readings(2, 'r')} SELECT *, {_rate('machine', 'n_words')} AS machine_per_1000, {_rate('human', 'n_words')} AS human_per_1000 FROM r",
        "pooled_baseline": f"{rd}, {_readings(2, 'r')}, t AS (SELECT 2 AS k, 'sentence' AS unit, string_agg(DISTINCT n_readers::VARCHAR, ',' ORDER BY n_readers::VARCHAR) AS n_readers, count(*) AS n_texts, sum(n_words)::BIGINT AS n_words, sum(machine)::BIGINT AS machine, min({_rate('machine', 'n_words')}) AS machine_low, max({_rate('machine', 'n_words')}) AS machine_high, sum(human)::BIGINT AS human, min({_rate('human', 'n_words')}) AS human_low, max({_rate('human', 'n_words')}) AS human_high FROM r) SELECT *, {_rate('machine', 'n_words')} AS machine_per_1000, {_rate('human', 'n_words')} AS human_per_1000 FROM t",
        "baseline_caveats": f"{rd}, ab AS (SELECT doc_id, unit, direction, count(*) AS n FROM own WHERE reader <> 'c' GROUP BY ALL), {_readings(1, 'r')}, {_readings(2, 'r2', 'ab', "reader <> 'c'")}, base AS (SELECT sum(machine)::BIGINT AS m, min(k) AS k, list(DISTINCT n_readers) AS ns FROM r2) SELECT doc_id, machine, m AS base_machine, ((r.k <> base.k)::INT + (len(list_filter(ns, lambda x: x <> n_readers)) > 0)::INT)::INT AS n_caveats FROM r, base",
        "inject_contains": f"{rd}, {_signals('sents')}, {injected}, {_scored('sents', 'both_')} SELECT {score_columns} FROM scored",
        "inject_consensus": f"{rd}, {_signals('sents')}, {agreed}, {_scored('sents', 'both_')}, {_rolled('scored')} SELECT doc_id, n_signals::BIGINT AS n_signals, lean, strength, label FROM rolled",
        "truth_overlap": f"{scored}, {_fractions('scored')} SELECT doc_id, seg_idx, covered::BIGINT AS covered, {rounded('fraction', 6)}, side FROM sided",
        "score_card": f"{sigs}, {_scored('sents', 'sig_sents')}, {_fractions('scored')}, card AS ({_card('sided')}) SELECT *, {card_rates} FROM card",
        "score_card_ladder": f"{sigs}, {ladder}, {TRUTH}, {ladder_sided}, cards AS ({ladder_cards}) SELECT c.rung, c.signals, c.machine_hits, c.machine_total, c.machine_flagged, c.decisive, c.agreements, c.machine_hits > b.machine_hits AND {_share('c.machine_hits', 'c.machine_flagged')} >= {_share('b.machine_hits', 'b.machine_flagged')} AS passes FROM cards c, (SELECT * FROM cards WHERE rung = 'tells') b",
        "evidence_cube": f"{sigs}, {TRUTH}, {cube}, cards AS ({cube_cards}) SELECT c.rung, c.signals, c.machine_hits, c.human_hits, c.machine_flagged, c.human_flagged, c.decisive, c.agreements, c.machine_hits > b.machine_hits AND {_share('c.machine_hits', 'c.machine_flagged')} >= {_share('b.machine_hits', 'b.machine_flagged')} AS passes FROM cards c, (SELECT * FROM cards WHERE rung = 'tells') b",
        "band_rates": f"{rolled}, j AS (SELECT r.lang, r.label, coalesce(s.k, 0) AS k, coalesce(s.x, 0) AS x FROM rolled r LEFT JOIN (SELECT doc_id, count(*) AS k, count(*) FILTER (label = 'leans-machine') AS x FROM scored GROUP BY 1) s USING (doc_id)), b AS (SELECT lang, count(*) AS documents, count(*) FILTER (label = 'leans-machine') AS accused, count(*) FILTER (label = 'leans-human') AS defended, count(*) FILTER (label IN ('no-evidence', 'uncertain')) AS silent, sum(k)::BIGINT AS segments, sum(x)::BIGINT AS segments_accused FROM j GROUP BY ROLLUP (lang)) SELECT *, {_share('accused', 'documents')} AS rate, {_share('segments_accused', 'segments')} AS segment_rate FROM b",
        "length_buckets": f"{rolled} SELECT ((n_chars >= 750)::INT + (n_chars >= 1500)::INT + (n_chars >= 2500)::INT)::INT AS bucket, count(*) AS documents, count(*) FILTER (label = 'leans-machine') AS accused, {_share('count(*) FILTER (label = ' + _q('leans-machine') + ')', 'count(*)')} AS rate FROM rolled GROUP BY 1",
        "rule_accounting": f"{inside}, {human}, {acc}, x AS (SELECT detector, name, direction, max(weight) AS w2, count(*) FILTER (direction = 'machine' AND inside) AS true_positive, count(*) FILTER (direction = 'machine' AND NOT inside) AS false_on_mixed FROM inn GROUP BY ALL) SELECT detector, name, direction, greatest(w1, w2) AS weight, coalesce(human_docs, 0) AS human_docs, coalesce(human_hits, 0) AS human_hits, coalesce(true_positive, 0) AS true_positive, coalesce(false_on_mixed, 0) AS false_on_mixed, direction = 'machine' AND coalesce(true_positive, 0) = 0 AND coalesce(human_docs, 0) >= 5 AS negative_value FROM h FULL JOIN x USING (detector, name, direction)",
        "detector_accounting": f"WITH {human}, {acc} SELECT detector, sum(human_docs)::BIGINT AS human_docs FROM h GROUP BY detector",
        "reference_sweep": f"{sig}, {sweep_ctes} SELECT reference, lang AS band, count(*) AS documents, count(*) FILTER (label = 'leans-machine') AS accused FROM ({sweep}) GROUP BY ALL",
        "robust_outlier": f"{ps}, {ratio} {standing}",
        "curvature_outlier": f"{ps}, {curvature} {standing}",
        "outlier_verdicts": f"{ps}, {_signals('sents')}, {ratio}, both_ AS (SELECT doc_id, seg_idx, direction, weight FROM sig_sents UNION ALL SELECT doc_id, seg_idx, CASE WHEN z > 0 THEN 'machine' ELSE 'human' END, CASE WHEN abs(z) >= 2.5 THEN 0.45 ELSE 0.3 END FROM std_ WHERE abs(z) >= 1.5), {_scored('sents', 'both_')}, {_rolled('scored')} SELECT doc_id, n_signals::BIGINT AS n_signals, lean, strength, label FROM rolled",
        "model_chunks": "WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents), c AS (SELECT doc_id, n, unnest(generate_series(0, greatest(1, ceil((n - 512) / 256.0)::INT + 1) - 1)) AS i FROM t) SELECT doc_id, (i * 256)::INT AS start, least(i * 256 + 512, n)::INT AS \"end\", CASE WHEN i = 0 THEN 1 ELSE least((i - 1) * 256 + 512, n) END::INT AS first FROM c",
        "late_results": LATE,
        "late_stream": LATE,
        "model_rows": "WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents), c AS (SELECT doc_id, n, unnest(generate_series(0, greatest(1, ceil((n - 512) / 256.0)::INT + 1) - 1)) AS i FROM t) SELECT doc_id, (i * 256)::INT AS start, (CASE WHEN i = 0 THEN 0 ELSE least((i - 1) * 256 + 512, n) - i * 256 - 1 END)::INT AS first, (least(i * 256 + 512, n) - i * 256 - 1)::INT AS \"end\" FROM c",
        "counted_model": f"WITH {DOCS}, {model} SELECT c1, c2, w, " + ", ".join(f'CASE WHEN round_even("{c}", 4) = 0 THEN 0.0 ELSE round_even("{c}", 4) END::DOUBLE AS "{c}"' for c in ("ll", "mean", "var", "cross")) + " FROM gr",
        "counted_curvature": f"{ps}, {model}, {by_curve} {standing}",
        "counted_ratio": f"{ps}, {model}, {by_cross} {standing}",
        "statistics_verdicts": f"{ps}, {_signals('sents')}, {model}, {by_curve}, {by_cross_too}, out_ AS (SELECT doc_id, seg_idx, z FROM std_ UNION ALL SELECT doc_id, seg_idx, z FROM std_2), both_ AS (SELECT doc_id, seg_idx, direction, weight FROM sig_sents UNION ALL SELECT doc_id, seg_idx, CASE WHEN z > 0 THEN 'machine' ELSE 'human' END, CASE WHEN abs(z) >= 2.5 THEN 0.45 ELSE 0.3 END FROM out_ WHERE abs(z) >= 1.5), {_scored('sents', 'both_')}, {_rolled('scored')} SELECT doc_id, n_signals::BIGINT AS n_signals, lean, strength, label, 'tells,forensic,rhetoric,rhythm,fast-detect-gpt,binoculars' AS detectors FROM rolled",
        "python_detector": f"{p}, {_signals()}, {long_words('paras')}, own_ AS (SELECT doc_id, seg_idx, direction, weight FROM sig_paras WHERE detector = 'forensic' UNION ALL SELECT doc_id, seg_idx, 'machine', 0.3 FROM lw UNION ALL SELECT doc_id, seg_idx, 'human', 0.2 FROM paras JOIN docs USING (doc_id) WHERE contains(text, '!')), {_scored('paras', 'own_')} SELECT {score_columns} FROM scored",
        "python_segmenter": f"""WITH {DOCS}, {rows_}, {long_words('rows_')}, all_ AS (SELECT doc_id, seg_idx, 'long-word' AS name, s, e, m, s AS "at" FROM lw UNION ALL SELECT doc_id, seg_idx, 'cries', NULL, NULL, NULL, start FROM rows_ JOIN docs USING (doc_id) WHERE contains(text, '!'))
          SELECT doc_id, seg_idx, (row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY "at", name) - 1)::INT AS nth, name, s::INT AS start, e::INT AS "end", m AS matched FROM all_""",
        "python_verdicts": f"""WITH {DOCS}, {rows_}, {long_words('rows_')}, n AS (SELECT r.doc_id, r.seg_idx, length(r.quote) AS size, count(lw.s) AS k FROM rows_ r LEFT JOIN lw USING (doc_id, seg_idx) GROUP BY ALL),
          v AS (SELECT doc_id, count(*) AS n_segments, sum(k)::BIGINT AS n_signals, sum((30 * k > size)::INT) AS flagged FROM n GROUP BY doc_id)
          SELECT d.doc_id, coalesce(n_segments, 0)::BIGINT AS n_segments, coalesce(n_signals, 0)::BIGINT AS n_signals, (coalesce(flagged, 0) > 0)::INT::DOUBLE AS lean, CASE WHEN coalesce(flagged, 0) = 0 THEN 'no-evidence' WHEN least(flagged / n_segments / 0.35, n_signals * 0.3 / (1.5 * greatest(1.0, length(text) / 1000.0)), 1.0) < 0.2 THEN 'no-evidence' ELSE 'leans-machine' END AS label, 'uncalibrated (share)' AS calibration
          FROM docs d LEFT JOIN v USING (doc_id)""",
        "own_rules": f"{p}, m AS (" + " UNION ALL ".join(_found(r.id, _re2(x), "paras", f"{_q(r.id)} AS rule, {r.weight!r}::DOUBLE AS weight,") for r in OWN_RULES for x in r.patterns) + ") SELECT doc_id, seg_idx, rule, weight, s::INT AS start, e::INT AS \"end\", m AS matched FROM m",
        "edit_invalidation": f"""{sig}, es AS (SELECT doc_id, seg_idx, start::INT AS s, (start + length(quote))::INT AS e, false AS bad FROM paras), {_mapped(EDITS, 'es')}, xs AS (SELECT doc_id, seg_idx, nth, name, s, e, false AS bad FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY "at", name, ord, l) - 1)::INT AS nth FROM (SELECT x.*, CASE detector WHEN 'tells' THEN 0 WHEN 'forensic' THEN 1 WHEN 'rhetoric' THEN 2 ELSE 3 END AS ord, coalesce(s - e, 0) AS l FROM sig_paras x)) WHERE s IS NOT NULL), {_mapped(EDITS, 'xs')}
          SELECT x.doc_id, x.seg_idx, nth, name, x.s AS start, x.e AS "end", x.bad OR y.bad AS unverified FROM met{len(EDITS) - 1}_xs x JOIN met{len(EDITS) - 1}_es y USING (doc_id, seg_idx)""",
    }
    return out
