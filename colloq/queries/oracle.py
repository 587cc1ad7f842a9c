"""The same queries as SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from colloq.config import CATEGORIES, DEFAULT
from colloq.operators.formatting import INSTRUCTION, SYSTEM_PROMPT
from colloq.operators.inference import PROMPT

# Fixed values, stated here again so that an error in the library's own shows: white space, word characters and filler utterances.
S = r"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}"
W = r"\p{L}\p{N}_"
FILLER = rf"^(?:mm+[{S}]*[-.]?[{S}]*hm+[{S}]*\.?|uh+[{S}]*[-.]?[{S}]*huh+[{S}]*\.?|um+[{S}]*\.?|uh+[{S}]*\.?|er+[{S}]*\.?|ah+[{S}]*\.?|oh+[{S}]*\.?|hm+[{S}]*\.?|\.)$"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{S}]+'), lambda t: t <> '')"


def plain(x: str) -> str:
    return f"regexp_replace({x}, '[^{W}{S}]', '', 'g')"


def normal(x: str) -> str:
    return f"array_to_string({tokens(plain(f'lower({x})'))}, ' ')"


def filler(x: str) -> str:
    return f"regexp_matches(lower({strip(x)}), {q(FILLER)})"


def low(x: str) -> str:
    return f"coalesce({strip(x)} = '' OR {filler(x)} OR length({strip(plain(x))}) < 3 OR length({plain(x)}) < 0.5::DOUBLE * length({x}), true)"


def mentioned(x: str, t: str) -> str:
    a, b = f"lower({x})", f"lower({t})"
    return (
        f"(regexp_matches({a}, '(^|[^{W}])' || {b} || '([^{W}]|$)') OR contains({a}, 'speaker ' || {b}) OR contains({a}, {b} || ' said') "
        f"OR contains({a}, 'tell ' || {b}) OR contains({a}, 'ask ' || {b}))"
    )


def incomplete(x: str) -> str:
    s = strip(x)
    w = tokens(s)
    return f"(ends_with({s}, '...') OR len({w}) <= 2 OR list_has_any(list_transform(({w})[-2:], lambda t: lower(t)), ['...', 'um', 'uh', 'hmm']))"


def turns(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda z: z.s || ':' || z.t), '|')"


def lines(x: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN array_to_string(list_transform({x}, lambda z: 'Speaker ' || z.s || ': ' || z.t), chr(10)) ELSE '(No previous context)' END"


#: Named steps; each may use those before it.
STEPS: dict[str, str] = {}
STEPS["spoken"] = """
SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM conversations"""
STEPS["acts"] = """
SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY starttime, speaker, ln) - 1 AS idx, len(addressee) > 0 AS explicit FROM (
  SELECT 'M' || lpad((conv_id // 2)::VARCHAR, greatest(4, length((conv_id // 2)::VARCHAR))::INT, '0') AS meeting_id, ln, trim(line) AS text,
    CASE WHEN role = 'user' THEN CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE 'C' END WHEN role = 'assistant' THEN CASE WHEN conv_id % 2 = 0 THEN 'B' ELSE 'D' END ELSE 'E' END AS speaker,
    (turn * 100 + ln * 2 + conv_id % 2)::DOUBLE AS starttime,
    CASE WHEN ln > 1 THEN []::VARCHAR[]
      WHEN role = 'user' AND turn % 4 < 2 THEN [CASE WHEN conv_id % 2 = 0 THEN 'B' ELSE 'D' END]
      WHEN role = 'user' THEN ['B', 'D']
      WHEN role = 'assistant' AND turn % 3 = 0 THEN [CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE 'C' END]
      ELSE []::VARCHAR[] END AS addressee
  FROM spoken WHERE trim(line) <> '')"""
STEPS["people"] = "SELECT meeting_id, list_sort(list(DISTINCT speaker)) AS people FROM acts GROUP BY 1"


def exchange(p: str, source: str, infix: str, stop: bool) -> None:
    """Steps from acts that address someone (``source``) to sequences, with names that begin with ``p``."""
    STEPS[f"{p}resp"] = f"""
SELECT a.meeting_id, a.idx AS i, any_value(a.speaker) AS speaker, any_value(a.text) AS text, any_value(a.addressee) AS addressee, min(b.idx) AS r,
  any_value(list_concat([a.speaker], list_filter(list_distinct(a.addressee), lambda x: x <> a.speaker))) AS members
FROM {source} a JOIN {source} b ON a.meeting_id = b.meeting_id AND b.idx BETWEEN a.idx + 1 AND a.idx + 19 AND list_contains(a.addressee, b.speaker)
WHERE a.explicit GROUP BY 1, 2"""
    changed = "b.explicit AND list_sort(list_distinct(b.addressee)) <> list_sort(list_distinct(c.addressee))" if stop else "false"
    STEPS[f"{p}later"] = f"""
SELECT c.meeting_id, c.i, b.idx AS k, b.speaker AS s, b.text AS t, list_contains(c.members, b.speaker) AS part, {changed} AS changed
FROM {p}resp c JOIN {source} b ON b.meeting_id = c.meeting_id AND b.idx > c.r"""
    STEPS[f"{p}seen"] = f"SELECT *, count(*) FILTER (part) OVER (PARTITION BY meeting_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {p}later"
    STEPS[f"{p}ends"] = f"SELECT *, min(CASE WHEN changed OR (NOT part AND seen > 0) THEN k END) OVER (PARTITION BY meeting_id, i) AS stop FROM {p}seen"
    STEPS[f"{p}more"] = f"""
SELECT meeting_id, i, list({{'s': s, 't': t}} ORDER BY k) AS after FROM {p}ends WHERE part AND (stop IS NULL OR k < stop) GROUP BY 1, 2"""
    STEPS[f"{p}before"] = f"""
SELECT c.meeting_id, c.i, list({{'s': b.speaker, 't': b.text}} ORDER BY b.idx) AS before
FROM {p}resp c JOIN {source} b ON b.meeting_id = c.meeting_id AND b.idx BETWEEN c.i - 10 AND c.i - 1 GROUP BY 1, 2"""
    STEPS[f"{p}cand"] = f"""
SELECT c.*, coalesce(m.after, []) AS after, coalesce(x.before, []) AS before, a.speaker AS rs, a.text AS rt, c.r + coalesce(len(m.after), 0) + 1 AS nxt
FROM {p}resp c LEFT JOIN {p}more m USING (meeting_id, i) LEFT JOIN {p}before x USING (meeting_id, i) JOIN {source} a ON a.meeting_id = c.meeting_id AND a.idx = c.r"""
    if stop:
        STEPS[f"{p}succ"] = f"SELECT a.meeting_id, a.i, min(b.i) AS j FROM {p}cand a LEFT JOIN {p}cand b ON a.meeting_id = b.meeting_id AND b.i >= a.nxt GROUP BY 1, 2"
        STEPS[f"{p}taken"] = f"""
SELECT meeting_id, min(i) AS i FROM {p}succ GROUP BY 1
UNION ALL SELECT t.meeting_id, s.j FROM {p}taken t JOIN {p}succ s ON s.meeting_id = t.meeting_id AND s.i = t.i WHERE s.j IS NOT NULL"""
        chosen = f"{p}cand JOIN {p}taken USING (meeting_id, i)"
    else:
        chosen = f"{p}cand"
    STEPS[f"{p}seq"] = f"SELECT *, meeting_id || '{infix}' || (row_number() OVER (ORDER BY meeting_id, i) - 1)::VARCHAR AS sequence_id FROM {chosen}"


exchange("", "acts", "_seq", True)
STEPS["quiet"] = f"""
SELECT meeting_id, speaker, text, row_number() OVER (PARTITION BY meeting_id ORDER BY starttime, speaker, ln) - 1 AS idx FROM acts WHERE NOT explicit AND NOT {low('text')}"""
STEPS["replies"] = """
SELECT q.*, people, idx * 7 % 13 AS said,
  CASE idx % 5 WHEN 0 THEN people WHEN 3 THEN list_filter(['C', 'D'], lambda x: list_contains(people, x)) WHEN 1 THEN list_filter(['A', 'B'], lambda x: list_contains(people, x)) ELSE []::VARCHAR[] END AS named
FROM quiet q JOIN people USING (meeting_id)"""
STEPS["answered"] = "SELECT meeting_id, speaker, text, idx, named AS addressee, len(named) > 0 AND least(10, said) >= 6 AS explicit, least(10, said)::INT AS confidence FROM replies"
exchange("x", "answered", "_inferred", False)
STEPS["turns"] = """
SELECT sequence_id, meeting_id, kind, s, t, addr, row_number() OVER (PARTITION BY sequence_id ORDER BY g, k) - 1 AS turn_index FROM (
  SELECT sequence_id, meeting_id, 'context' AS kind, 0 AS g, generate_subscripts(before, 1) AS k, unnest(before).s AS s, unnest(before).t AS t, []::VARCHAR[] AS addr FROM seq
  UNION ALL SELECT sequence_id, meeting_id, 'addressing', 1, 0, speaker, text, addressee FROM seq
  UNION ALL SELECT sequence_id, meeting_id, 'response', 2, 0, rs, rt, []::VARCHAR[] FROM seq
  UNION ALL SELECT sequence_id, meeting_id, 'continuation', 3, generate_subscripts(after, 1), unnest(after).s, unnest(after).t, []::VARCHAR[] FROM seq)"""
STEPS["everyone"] = "SELECT sequence_id, list_sort(list_distinct(flatten(list(list_concat([s], addr))))) AS people FROM turns GROUP BY 1"
STEPS["words_of"] = f"SELECT w.t, {normal('w.t')} AS n FROM (SELECT DISTINCT t FROM turns) w"
STEPS["placed"] = """
SELECT *, lead(s) OVER w AS then_s, concat_ws('|', lag(s || ':' || n, 3) OVER w, lag(s || ':' || n, 2) OVER w, lag(s || ':' || n, 1) OVER w) AS last_lines,
  coalesce(list({'s': s, 't': t}) OVER (PARTITION BY sequence_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS ctx FROM turns JOIN words_of USING (t)
WINDOW w AS (PARTITION BY sequence_id ORDER BY turn_index)"""
STEPS["points"] = """
SELECT p.*, people, target, sequence_id || '_turn' || turn_index::VARCHAR || '_target' || target AS decision_point_id,
  list_contains(addr, target) AS addressed, coalesce(then_s = target, false) AS spoke
FROM (SELECT p.*, e.people, unnest(e.people) AS target FROM placed p JOIN everyone e USING (sequence_id)) p WHERE target <> s"""
STEPS["samples"] = f"""
SELECT *, CASE WHEN spoke THEN 'SPEAK' ELSE 'SILENT' END AS decision,
  CASE WHEN spoke AND addressed THEN target || ' was explicitly addressed by ' || s || ' and spoke (ground truth)'
    WHEN spoke THEN target || ' spoke next in conversation (ground truth)'
    WHEN len(addr) > 0 THEN s || ' addressed ' || array_to_string(addr, ', ') || ', not ' || target || ' (ground truth: did not speak)'
    ELSE target || ' did not speak next (ground truth)' END AS reason,
  CASE WHEN spoke THEN CASE WHEN addressed THEN 'I1' WHEN list_contains(list_transform(ctx[-3:], lambda c: c.s), target) THEN 'I2' ELSE 'I3' END
    WHEN {mentioned('t', 'target')} AND NOT addressed THEN 'S2' WHEN {incomplete('t')} THEN 'S4'
    WHEN list_contains(list_transform(ctx[-2:], lambda c: c.s), target) THEN 'S3' WHEN len(addr) > 0 AND NOT addressed THEN 'S5' ELSE 'S1' END AS category
FROM points"""
STEPS["good"] = f"SELECT * FROM samples WHERE NOT {low('t')}"
STEPS["signed"] = "SELECT *, n || ':::' || last_lines || ':::' || decision AS signature FROM good"
STEPS["uniq"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY meeting_id, sequence_id, turn_index, target) AS rn FROM signed) WHERE rn = 1"""
STEPS["flat"] = f"""
SELECT row_number() OVER (ORDER BY meeting_id, sequence_id, turn_index, target) AS sample_id, decision_point_id, meeting_id, sequence_id, target AS target_speaker, people,
  {lines('ctx')} AS context, 'Speaker ' || s || ': ' || t AS current_turn, decision, 'high' AS confidence, reason, category FROM uniq"""
STEPS["seen_cats"] = "SELECT decision, category, count(*) AS n, min((meeting_id, sequence_id, turn_index, target)) AS f FROM uniq GROUP BY 1, 2"
STEPS["cats"] = "SELECT *, row_number() OVER (ORDER BY decision DESC, f) - 1 AS place, count(*) OVER (PARTITION BY decision) AS m, sum(n) OVER (PARTITION BY decision) AS total FROM seen_cats"
STEPS["goal"] = """
SELECT decision, n AS available, CASE WHEN decision = 'SPEAK' THEN least(trunc(2 * lo * 0.5::DOUBLE)::BIGINT, n) ELSE least(2 * lo - trunc(2 * lo * 0.5::DOUBLE)::BIGINT, n) END AS target
FROM (SELECT d.decision, coalesce(c.n, 0)::BIGINT AS n, min(coalesce(c.n, 0)) OVER ()::BIGINT AS lo FROM (VALUES ('SPEAK'), ('SILENT')) d(decision) LEFT JOIN (SELECT decision, sum(n) AS n FROM seen_cats GROUP BY 1) c USING (decision))"""
STEPS["share"] = """
SELECT *, least(greatest(floor_, least(trunc(target * (n::DOUBLE / total))::BIGINT, cap)), n) AS t0 FROM (
  SELECT c.*, g.target, trunc(g.target * 0.35::DOUBLE)::BIGINT AS cap, greatest(1, g.target // (2 * m)) AS floor_ FROM cats c JOIN goal g USING (decision))"""
STEPS["filled"] = """
SELECT *, target - sum(t0) OVER (PARTITION BY decision) AS gap,
  coalesce(sum(n - t0) OVER (PARTITION BY decision ORDER BY n DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
  coalesce(sum(greatest(t0 - floor_, 0)) OVER (PARTITION BY decision ORDER BY t0 DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare
FROM share"""
STEPS["quota"] = """
SELECT decision, category, n, place, target, (CASE WHEN gap > 0 THEN t0 + greatest(0, least(n - t0, gap - room)) WHEN gap < 0 THEN t0 - greatest(0, least(greatest(t0 - floor_, 0), -gap - spare)) ELSE t0 END)::BIGINT AS quota FROM filled"""
STEPS["chosen"] = """
SELECT *, row_number() OVER (ORDER BY place, rank) AS sample_id FROM (
  SELECT u.*, q.place, q.quota, row_number() OVER (PARTITION BY u.decision, u.category ORDER BY meeting_id, sequence_id, turn_index, u.target) AS rank FROM uniq u JOIN (SELECT decision, category, place, quota FROM quota) q USING (decision, category))
WHERE rank <= quota"""
STEPS["pairs"] = "SELECT meeting_id, sequence_id, 'explicit' AS source, 10 AS confidence FROM seq UNION ALL SELECT x.meeting_id, x.sequence_id, 'gemini_inferred', a.confidence FROM xseq x JOIN answered a ON a.meeting_id = x.meeting_id AND a.idx = x.i"
STEPS["xacts"] = f"""
SELECT *, row_number() OVER w - 1 AS doc_order, coalesce(sum(len(toks)) OVER (PARTITION BY meeting_id, speaker ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_,
  meeting_id || '.' || speaker AS person, explicit OR speaker = 'E' AS annotated
FROM (SELECT *, {tokens('text')} AS toks FROM acts) WINDOW w AS (PARTITION BY meeting_id, speaker ORDER BY idx)"""
STEPS["told"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('7:' || decision_point_id), decision_point_id)::INT AS rank FROM flat) WHERE rank <= 5"""
STEPS["tok"] = f"SELECT doc_id, unnest({tokens('text')}) AS text, generate_subscripts({tokens('text')}, 1) AS n FROM documents"


def used(name: str, seen: list[str]) -> None:
    import re

    for word in set(re.findall(r"\w+", STEPS[name])):
        if word in STEPS and word != name and word not in seen:
            used(word, seen)
    if name not in seen:
        seen.append(name)


def sql(body: str) -> str:
    """``body`` behind the steps it needs."""
    import re

    need: list[str] = []
    for word in re.findall(r"\w+", body):
        if word in STEPS:
            used(word, need)
    steps = [n for n in STEPS if n in need]
    own = body.startswith("WITH ")
    before = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in steps) + (",\n" if own else "\n") if steps else ""
    return before + (body.removeprefix("WITH ") if own and steps else body)


def _seq(p: str, source: str, confidence: str, reason: str, explicit: str, table: str) -> str:
    return f"""SELECT meeting_id, sequence_id, '{source}' AS source, speaker, array_to_string(addressee, ',') AS addressees, text, {explicit} AS is_explicit,
{confidence} AS confidence, {reason} AS reason, rs AS response_speaker, rt AS response_text, {turns('before')} AS context, {turns('after')} AS continuation FROM {table}"""


_prompt = q(PROMPT)
for _key, _value in (("speakers", "array_to_string(people, ', ')"), ("context", lines("ctx")), ("speaker", "speaker"), ("text", "text")):
    _prompt = _prompt.replace("{" + _key + "}", f"' || {_value} || '")
_confidence = "CASE WHEN event_id % 11 = 0 THEN 8 WHEN event_id % 11 = 1 THEN 0 ELSE least(10, event_id % 17) END::INT"
_explicit = _seq("", "explicit", "10", "'Explicit'", "true", "seq")
_template = (
    f"'<|system|>' || {q(SYSTEM_PROMPT)} || '<|/system|>' || chr(10) || '<|instruction|>' || {q(INSTRUCTION[0])} || target_speaker || {q(INSTRUCTION[1])} || '<|/instruction|>' || chr(10) "
    "|| '<|context|>' || context || '<|/context|>' || chr(10) || '<|current|>' || current_turn || '<|/current|>' || chr(10) || '<decision>' || decision || '</decision>' || chr(10) "
    "|| '<confidence>' || confidence || '</confidence>' || chr(10) || '<reason>' || reason || '</reason>'"
)
_length = "CASE WHEN context = '(No previous context)' THEN 0 ELSE len(string_split(context, chr(10))) END"
_kinds = "(VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in CATEGORIES.items()) + ") v(category, name)"

BODIES = {
    "acts_timeline": "SELECT meeting_id, idx::INT AS idx, speaker, array_to_string(addressee, ',') AS addressee, text, starttime, explicit AS has_explicit_addressee FROM acts",
    "meeting_discovery": f"SELECT meeting_id FROM acts GROUP BY 1 HAVING bool_or(explicit) ORDER BY 1 LIMIT {DEFAULT.meeting_limit}",
    "discovered_acts": f"SELECT meeting_id, count(*) AS n FROM acts GROUP BY 1 HAVING bool_or(explicit) ORDER BY 1 LIMIT {DEFAULT.meeting_limit}",
    "meeting_speakers": "SELECT meeting_id, array_to_string(people, ',') AS speakers FROM people",
    "speaker_fallback": "SELECT meeting_id, CASE WHEN meeting_id[-1]::INT % 2 = 0 THEN array_to_string(people, ',') ELSE 'A,B,C,D' END AS speakers FROM people",
    "participants": "SELECT meeting_id, i::INT AS idx, array_to_string(list_sort(members), ',') AS participants FROM resp",
    "context_window": """SELECT meeting_id, idx::INT AS idx, len(c)::INT AS turns, array_to_string(list_transform(c, lambda z: z.s || ':' || z.t), '|') AS context FROM (
SELECT meeting_id, idx, coalesce(list({'s': speaker, 't': text}) OVER (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS c FROM acts)""",
    "response_lookahead": "SELECT meeting_id, i::INT AS idx, r::INT AS response_idx, rs AS speaker, rt AS text FROM cand",
    "continuation": f"SELECT meeting_id, i::INT AS idx, len(after)::INT AS turns, {turns('after')} AS continuation FROM cand",
    "sequences_explicit": _explicit,
    "sequences_per_meeting": "SELECT meeting_id, count(*) AS n FROM seq GROUP BY 1",
    "sequence_stats": """SELECT count(*) AS sequences, count(DISTINCT meeting_id) AS meetings, count(DISTINCT speaker) AS speakers, avg(len(before)) AS avg_context, min(len(before))::INT AS min_context,
max(len(before))::INT AS max_context, avg(len(after)) AS avg_continuation, min(len(after))::INT AS min_continuation, max(len(after))::INT AS max_continuation FROM seq""",
    "sequence_head": f"SELECT * FROM ({_explicit}) ORDER BY meeting_id, sequence_id LIMIT 3",
    "quality_acts": "SELECT meeting_id, idx::INT AS idx, speaker, text FROM quiet",
    "stride_sample": "SELECT meeting_id, (idx // 3)::INT AS idx, speaker, text FROM quiet WHERE idx % 3 = 0",
    "capped_sample": "SELECT meeting_id, (idx // 2)::INT AS idx, speaker, text FROM quiet WHERE idx % 2 = 0 AND idx // 2 < 4",
    "prompt_context": f"""SELECT meeting_id, idx::INT AS idx, array_to_string(people, ',') AS speakers, {_prompt} AS prompt FROM (
SELECT *, coalesce(list({{'s': speaker, 't': text}}) OVER (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS ctx FROM quiet) JOIN people USING (meeting_id)""",
    "parse_model_reply": f"""SELECT event_id, ['A,B,C,D', 'A,B', '', 'C,D', '', '', 'B,B'][event_id % 7 + 1] AS addressees, {_confidence} AS confidence, event_type AS reason FROM events""",
    "sequences_inferred": "SELECT s.* REPLACE (a.confidence AS confidence, CASE WHEN i % 5 = 1 THEN 'No explanation provided' ELSE 'by place' END AS reason) FROM ("
    + _seq("x", "gemini_inferred", "0", "''", "false", "xseq")
    + ") s JOIN xseq x USING (sequence_id) JOIN answered a ON a.meeting_id = x.meeting_id AND a.idx = x.i",
    "merge_sequences": "SELECT meeting_id, sequence_id, source, confidence FROM pairs",
    "meeting_source_pivot": "SELECT meeting_id, count(*) FILTER (source = 'explicit') AS explicit, count(*) FILTER (source <> 'explicit') AS inferred, count(*) AS total FROM pairs GROUP BY 1",
    "confidence_histogram": "SELECT confidence, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM pairs WHERE source <> 'explicit' GROUP BY 1",
    "merge_expansion": """SELECT count(*) FILTER (source = 'explicit') AS explicit, count(*) FILTER (source <> 'explicit') AS inferred,
count(*) FILTER (source <> 'explicit') * 100.0::DOUBLE / nullif(count(*) FILTER (source = 'explicit'), 0) AS expansion_percent, avg(confidence) FILTER (source <> 'explicit') AS avg_confidence,
min(confidence) FILTER (source <> 'explicit') AS min_confidence, max(confidence) FILTER (source <> 'explicit') AS max_confidence FROM pairs""",
    "call_cost": "SELECT meeting_id, count(*) AS calls, count(*) * 650 / 1000::DOUBLE * 0.00001875::DOUBLE + count(*) * 50 / 1000::DOUBLE * 0.000075::DOUBLE AS cost FROM quiet GROUP BY 1",
    "sequence_speakers": "SELECT sequence_id, array_to_string(people, ',') AS speakers FROM everyone",
    "decision_points": """SELECT decision_point_id, sequence_id, meeting_id, target AS target_speaker, array_to_string(people, ',') AS all_speakers, turn_index::INT AS turn_index, kind AS turn_type,
len(ctx)::INT AS context_turns, s AS speaker, t AS text, array_to_string(addr, ',') AS addressees, addressed AS target_is_addressed, spoke AS target_spoke_next FROM points""",
    "dp_turn_type_counts": "SELECT kind AS turn_type, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM points GROUP BY 1",
    "dp_stats": """SELECT count(*) AS points, count(*) FILTER (addressed) AS addressed, count(*) FILTER (spoke) AS spoke, avg(len(ctx)) AS avg_context, min(len(ctx))::INT AS min_context,
max(len(ctx))::INT AS max_context, avg(len(people)) AS avg_speakers, min(len(people))::INT AS min_speakers, max(len(people))::INT AS max_speakers FROM points""",
    "dp_heads": f"SELECT decision_point_id, kind AS turn_type, {turns('ctx[-2:]')} AS last_turns, substr(t, 1, 60) AS text FROM points ORDER BY meeting_id, sequence_id, turn_index, target LIMIT 5",
    "labels_reasons": "SELECT decision_point_id, decision, 'high' AS confidence, reason FROM samples",
    "recent_flags": "SELECT decision_point_id, list_contains(list_transform(ctx[-3:], lambda c: c.s), target) AS recent3, list_contains(list_transform(ctx[-2:], lambda c: c.s), target) AS recent2 FROM points",
    "mention_flags": f"SELECT decision_point_id, {mentioned('t', 'target')} AS mentioned, {incomplete('t')} AS incomplete FROM points",
    "incomplete_flags": f"""SELECT doc_id, count(*) FILTER ({incomplete('line')}) AS incomplete, count(*) FILTER ({mentioned('line', q('A'))}) AS mentions_a
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""",
    "categories": "SELECT decision, category, count(*) AS n FROM samples GROUP BY 1, 2",
    "sample_categories": "SELECT decision_point_id, decision, category FROM samples",
    "category_confidence_crosstab": "SELECT category, count(*) AS high, 0::BIGINT AS medium, 0::BIGINT AS low FROM samples GROUP BY 1",
    "addressed_spoke_rate": "SELECT count(*) FILTER (addressed) AS addressed, count(*) FILTER (addressed AND spoke) AS spoke, count(*) FILTER (addressed AND spoke)::DOUBLE / nullif(count(*) FILTER (addressed), 0) AS rate FROM samples",
    "category_head2": "SELECT * FROM (SELECT category, row_number() OVER (PARTITION BY category ORDER BY meeting_id, sequence_id, turn_index, target)::INT AS rank, decision_point_id FROM samples) WHERE rank <= 2",
    "filler_flags": f"SELECT doc_id, count(*) FILTER ({filler('w')}) AS fillers, count(*) FILTER ({low('w')}) AS low, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1",
    "quality_filter_documents": f"SELECT doc_id, {low('text')} AS low_quality, {filler('text')} AS filler FROM documents",
    "normalize_text": f"SELECT doc_id, md5({normal('text')}) AS normal FROM documents",
    "quality_filter_samples": "SELECT category, count(*) AS n FROM good GROUP BY 1",
    "signatures": "SELECT decision_point_id, md5(signature) AS signature FROM signed",
    "dedup_keep_best": "SELECT decision_point_id, decision, category FROM uniq",
    "category_availability": "SELECT decision, category, n, f[1] || '/' || f[2] || '/' || f[3]::VARCHAR || '/' || f[4] AS first FROM seen_cats",
    "class_targets": "SELECT decision, available, target FROM goal",
    "category_quotas": "SELECT decision, category, n AS available, place::INT AS place, quota, target FROM quota",
    "balanced_samples": "SELECT sample_id, decision_point_id, decision, category FROM chosen",
    "balanced_distribution": "SELECT decision, category, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY decision) AS percent FROM chosen GROUP BY 1, 2",
    "intermediate_samples": """SELECT sample_id, decision_point_id, meeting_id, sequence_id, target_speaker, array_to_string(people, ',') AS all_speakers, md5(context) AS context,
current_turn, decision, confidence, reason, category FROM flat""",
    "training_text": f"SELECT sample_id, md5({_template}) AS text, length({_template})::INT AS size FROM flat",
    "overview": """SELECT count(*) AS total, count(DISTINCT meeting_id) AS meetings, count(DISTINCT sequence_id) AS sequences, (SELECT count(DISTINCT p) FROM (SELECT unnest(people) AS p FROM flat)) AS speakers,
count(*)::DOUBLE / nullif(count(DISTINCT sequence_id), 0) AS samples_per_sequence FROM flat""",
    "decision_distribution": """SELECT a AS speak, b AS silent, a * 100.0::DOUBLE / n AS speak_percent, b * 100.0::DOUBLE / n AS silent_percent, b::DOUBLE / a AS silent_to_speak
FROM (SELECT count(*) FILTER (decision = 'SPEAK') AS a, count(*) FILTER (decision = 'SILENT') AS b, count(*) AS n FROM flat)""",
    "category_distribution": f"SELECT category, name, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) * 100.0::DOUBLE / sum(coalesce(n, 0)) OVER () AS percent FROM {_kinds} LEFT JOIN (SELECT category, count(*) AS n FROM flat GROUP BY 1) c USING (category)",
    "confidence_grid": """SELECT d.decision, c.confidence, count(f.sample_id) AS n FROM (VALUES ('ALL'), ('SPEAK'), ('SILENT')) d(decision) CROSS JOIN (VALUES ('high'), ('medium'), ('low')) c(confidence)
LEFT JOIN flat f ON f.confidence = c.confidence AND d.decision IN ('ALL', f.decision) GROUP BY 1, 2""",
    "context_stats": f"SELECT avg(n) AS avg_turns, min(n)::INT AS min_turns, max(n)::INT AS max_turns, count(*) FILTER (n = 0) AS without FROM (SELECT {_length} AS n FROM flat)",
    "context_histogram": f"SELECT turns, count(*) AS n FROM (SELECT ({_length})::INT AS turns FROM flat) GROUP BY 1 ORDER BY 1 LIMIT 10",
    "duplicate_audit": """SELECT count(*) AS total, count(DISTINCT decision_point_id) AS unique_ids, count(*) - count(DISTINCT decision_point_id) AS duplicate_ids,
count(DISTINCT (context, current_turn)) AS unique_pairs, count(*) - count(DISTINCT (context, current_turn)) AS duplicate_pairs FROM flat""",
    "samples_per_meeting": "SELECT meeting_id, count(*) AS n FROM flat GROUP BY 1",
    "word_resolution": "SELECT 'D' || doc_id::VARCHAR AS meeting_id, count(*) * 7 AS n, count(*) * 7 AS ids, 6 AS last FROM tok WHERE n % 7 = 1 GROUP BY 1",
    "act_text_time": """SELECT 'D' || doc_id::VARCHAR AS meeting_id, ((n - 1) // 7 * 7)::BIGINT AS doc_order, string_agg(text, ' ' ORDER BY n) AS text, min(n * 0.5::DOUBLE) AS starttime, max(n * 0.5::DOUBLE + 0.25) AS endtime
FROM tok WHERE n % 5 <> 0 GROUP BY doc_id, (n - 1) // 7""",
}
_ids = "person || '.words' || (before_ + {k})::VARCHAR"
BODIES |= {
    "xml_meeting_speakers": "SELECT DISTINCT meeting_id, speaker, meeting_id || speaker AS participant_id, 'role ' || speaker AS role FROM acts",
    "xml_words": f"""SELECT meeting_id, speaker, {_ids.format(k='k')} AS word_id, toks[k] AS text, starttime + (k - 1) * 0.25::DOUBLE AS starttime, starttime + (k - 1) * 0.25::DOUBLE + 0.125::DOUBLE AS endtime
FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS k FROM xacts)""",
    "xml_act_refs": f"""SELECT meeting_id, speaker, person || '.' || doc_order::VARCHAR AS dact_id, array_to_string(addressee, ',') AS addressee_text, annotated, doc_order,
CASE WHEN len(toks) = 0 THEN '' ELSE person || '.words.xml#id(' || {_ids.format(k='1')} || ')' || CASE WHEN len(toks) > 1 THEN '..id(' || {_ids.format(k='len(toks)')} || ')' ELSE '' END END AS refs FROM xacts""",
    "xml_discovery": f"SELECT meeting_id FROM xacts GROUP BY 1 HAVING bool_or(annotated) ORDER BY 1 LIMIT {DEFAULT.meeting_limit}",
    "xml_acts": """SELECT meeting_id, (row_number() OVER (PARTITION BY meeting_id ORDER BY idx) - 1)::INT AS idx, speaker, array_to_string(addressee, ',') AS addressee, array_to_string(toks, ' ') AS text, starttime,
starttime + (len(toks) - 1) * 0.25::DOUBLE + 0.125::DOUBLE AS endtime, explicit AS has_explicit_addressee
FROM xacts WHERE len(toks) > 0 AND meeting_id IN (SELECT meeting_id FROM xacts GROUP BY 1 HAVING bool_or(annotated))""",
    "json_lines_sequences": _explicit,
    "json_array_sequences": _explicit,
    "json_dispatch": "SELECT meeting_id, count(*) AS n, form FROM seq, (VALUES ('a.json'), ('b.jsonl')) f(form) GROUP BY 1, 3",
    "file_per_sample": "SELECT sample_id, decision_point_id, decision, category FROM chosen",
    "summary_document": """SELECT 'total_samples' AS key, count(*)::VARCHAR AS value FROM chosen UNION ALL SELECT 'speak_samples', count(*)::VARCHAR FROM chosen WHERE decision = 'SPEAK'
UNION ALL SELECT 'silent_samples', count(*)::VARCHAR FROM chosen WHERE decision = 'SILENT' UNION ALL SELECT category, count(*)::VARCHAR FROM chosen GROUP BY 1 UNION ALL SELECT 'high', count(*)::VARCHAR FROM chosen
UNION ALL VALUES ('speak_ratio', '0.5'), ('max_category_ratio', '0.35'), ('min_text_length', '3'), ('deduplication', 'text + context (3 turns) + label')""",
    "statistics_document": """SELECT 'total_samples' AS key, count(*) AS value FROM flat UNION ALL SELECT 'unique_meetings', count(DISTINCT meeting_id) FROM flat UNION ALL SELECT 'unique_sequences', count(DISTINCT sequence_id) FROM flat
UNION ALL SELECT 'unique_speakers', count(DISTINCT p) FROM (SELECT unnest(people) AS p FROM flat) UNION ALL SELECT decision, count(*) FROM flat GROUP BY 1
UNION ALL SELECT 'unique_decision_points', count(DISTINCT decision_point_id) FROM flat UNION ALL SELECT 'unique_context_current_pairs', count(DISTINCT (context, current_turn)) FROM flat
UNION ALL SELECT v.category, count(f.category) FROM """
    + _kinds
    + """ LEFT JOIN flat f USING (category) GROUP BY 1 UNION ALL SELECT meeting_id, count(*) FROM flat GROUP BY 1""",
    "stratified_examples": "SELECT category, rank, sample_id, decision_point_id FROM told",
    "example_lines": f"""SELECT line, count(*) AS n FROM (
SELECT unnest(['Example ' || rank::VARCHAR || ':', 'Sample ID: ' || sample_id::VARCHAR, 'Meeting: ' || meeting_id, 'Target Speaker: ' || target_speaker, 'Decision: ' || decision, 'Confidence: ' || confidence, 'Reason: ' || reason]) AS line FROM told
UNION ALL SELECT category || ': ' || name FROM {_kinds}) GROUP BY 1""",
    "uploaded_objects": """SELECT 'run/1/counts/' || decision || '.txt' AS key, count(*) AS n FROM chosen GROUP BY decision UNION ALL SELECT 'run/1/summary.json', count(*) FROM chosen""",
    "size_metrics": f"SELECT sum(strlen({_template}) + 1)::BIGINT AS bytes, count(*) AS samples, sum(strlen({_template}) + 1)::DOUBLE / count(*) AS bytes_per_sample FROM flat",
    "merge_head": """SELECT p.meeting_id, p.sequence_id, p.source, coalesce(s.text, x.text) AS text FROM pairs p LEFT JOIN seq s ON s.sequence_id = p.sequence_id LEFT JOIN xseq x ON x.sequence_id = p.sequence_id
ORDER BY p.meeting_id, p.sequence_id LIMIT 12""",
    "one_meeting": f"SELECT * FROM ({_explicit}) WHERE meeting_id = (SELECT min(meeting_id) FROM seq)",
    "filtered_examples": "SELECT sample_id, decision, category, 'high' AS confidence, '[' || s || '] ' || substr(t, 1, 100) || '...' AS line FROM chosen ORDER BY sample_id LIMIT 5",
    "balanced_confidence": "SELECT 'high' AS confidence, count(*) AS n, 100.0::DOUBLE AS percent FROM chosen",
    "first_of_class": f"SELECT sample_id, md5({_template}) AS text FROM flat JOIN (SELECT min(sample_id) AS sample_id FROM flat GROUP BY decision) USING (sample_id)",
    "model_inference_replay": f"""SELECT meeting_id, idx::INT AS idx, CASE WHEN list_contains(people, 'ABCD'[length(prompt) % 4 + 1]) THEN 'ABCD'[length(prompt) % 4 + 1] ELSE '' END AS addressees,
(length(prompt) % 11)::INT AS confidence, 'No explanation provided' AS reason FROM (SELECT meeting_id, idx, people, {_prompt} AS prompt FROM (
SELECT *, coalesce(list({{'s': speaker, 't': text}}) OVER (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS ctx FROM quiet) JOIN people USING (meeting_id))""",
}
BODIES |= {
    "speaker_fallback_all": """SELECT p.meeting_id, coalesce(c.callers, 'A,B,C,D') AS speakers FROM people p
LEFT JOIN (SELECT meeting_id, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS callers FROM acts WHERE explicit GROUP BY 1) c USING (meeting_id)""",
    "word_references": """SELECT 'D' || doc_id::VARCHAR AS meeting_id, first - 1 AS doc_order, string_agg(t.text, ' ' ORDER BY pos) AS text FROM (
  SELECT doc_id, n AS first, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM (
    SELECT doc_id, n, CASE (n - 1) // 7 % 6 WHEN 0 THEN range(n, n + 7) WHEN 1 THEN [n] WHEN 2 THEN [n, n + 2, n + 4] WHEN 3 THEN []::BIGINT[] WHEN 4 THEN [n, n + 1, n + 2, n + 5] ELSE range(n, n + 400) END AS ids
    FROM tok WHERE n % 7 = 1)) a JOIN tok t USING (doc_id) WHERE t.n = a.id AND t.n % 5 <> 0 GROUP BY doc_id, first""",
    "statistics_figures": f"""WITH d AS (SELECT count(*) AS n, count(*) FILTER (decision = 'SPEAK') AS a, count(*) FILTER (decision = 'SILENT') AS b, count(DISTINCT sequence_id) AS s FROM flat),
l AS (SELECT {_length} AS n FROM flat)
SELECT 'samples_per_sequence' AS key, n::DOUBLE / s AS value FROM d UNION ALL SELECT 'speak_percentage', a * 100.0::DOUBLE / n FROM d UNION ALL SELECT 'silent_percentage', b * 100.0::DOUBLE / n FROM d
UNION ALL SELECT 'silent_to_speak_ratio', b::DOUBLE / a FROM d
UNION ALL SELECT 'percentage ' || v.category || ' ' || v.name, count(f.category) * 100.0::DOUBLE / max(d.n) FROM {_kinds} CROSS JOIN d LEFT JOIN flat f USING (category) GROUP BY v.category, v.name
UNION ALL SELECT 'overall ' || c, CASE WHEN c = 'high' THEN n ELSE 0 END FROM d, (VALUES ('high'), ('medium'), ('low')) x(c)
UNION ALL SELECT 'overall percentage ' || c, CASE WHEN c = 'high' THEN 100.0 ELSE 0 END FROM (VALUES ('high'), ('medium'), ('low')) x(c)
UNION ALL SELECT 'SPEAK ' || c, CASE WHEN c = 'high' THEN a ELSE 0 END FROM d, (VALUES ('high'), ('medium'), ('low')) x(c)
UNION ALL SELECT 'SILENT ' || c, CASE WHEN c = 'high' THEN b ELSE 0 END FROM d, (VALUES ('high'), ('medium'), ('low')) x(c)
UNION ALL SELECT 'average_turns', avg(n) FROM l UNION ALL SELECT 'min_turns', min(n) FROM l UNION ALL SELECT 'max_turns', max(n) FROM l UNION ALL SELECT 'samples_with_no_context', count(*) FILTER (n = 0) FROM l
UNION ALL SELECT 'duplicate_decision_points', count(*) - count(DISTINCT decision_point_id) FROM flat UNION ALL SELECT 'duplicate_context_current_pairs', count(*) - count(DISTINCT (context, current_turn)) FROM flat
UNION ALL SELECT 'meeting ' || meeting_id, row_number() OVER (ORDER BY meeting_id) FROM (SELECT DISTINCT meeting_id FROM flat)
UNION ALL SELECT 'speaker ' || p, row_number() OVER (ORDER BY p) FROM (SELECT DISTINCT unnest(people) AS p FROM flat)""",
    "example_bodies": """SELECT sample_id, md5('Example ' || rank::VARCHAR || ':' || chr(10) || repeat('-', 70) || chr(10) || 'Sample ID: ' || sample_id::VARCHAR || chr(10) || 'Meeting: ' || meeting_id || chr(10) || 'Target Speaker: ' || target_speaker
|| chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Current Turn:' || chr(10) || current_turn || chr(10) || chr(10) || 'Decision: ' || decision || chr(10) || 'Confidence: ' || confidence || chr(10)
|| 'Reason: ' || reason) AS body FROM told""",
}
ORACLE_SQL = {name: sql(body) for name, body in BODIES.items()}
