"""The same queries in DuckDB SQL, written from the definitions and not from the Spark expressions."""

from __future__ import annotations

from tessera.functions.text import HTML_ENTITIES, NUMBER_WORDS
from tessera.operators.embedding import STOP_WORDS

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return f"[{', '.join(map(lit, x))}]"
    return str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def strip(x: str) -> str:
    return replace(replace(x, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def words(x: str, v: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda {v}: {v} <> '')"


def tokens(x: str, v: str) -> str:
    return f"CAST(floor(len({words(x, v)}) * 1.3::DOUBLE) + 1 AS INT)"


def clean(x: str) -> str:
    return strip(replace(replace(x, r"-\n([a-z])", r"\1"), f"{SPACE}+", " "))


def norm(x: str) -> str:
    return f"trim({replace(f'lower({x})', '[^a-z0-9]+', ' ')})"


def sentences(x: str, v: str = "s") -> str:
    paragraphs = f"list_filter(list_transform(regexp_split_to_array({x}, '\\n{SPACE}*\\n'), lambda {v}p: {strip(v + 'p')}), lambda {v}q: {v}q <> '')"
    marked = replace(f"{v}r", rf"""([.!?]){SPACE}+([A-Z0-9"'(\[])""", "\\1\x1e\\2")
    pieces = f"flatten(list_transform({paragraphs}, lambda {v}r: string_split({marked}, chr(30))))"
    return f"list_filter(list_transform({pieces}, lambda {v}t: {strip(v + 't')}), lambda {v}u: {v}u <> '')"


def citations(x: str) -> str:
    return strip(replace(x, rf"{SPACE}*\[[0-9]+(?:{SPACE}*,{SPACE}*[0-9]+)*\]", ""))


def claims(x: str) -> str:
    return f"list_filter(list_transform({sentences(x)}, lambda c: {citations('c')}), lambda d: len({words('d', 'e')}) >= 3)"


def slices(x: str, step: int, v: str) -> str:
    own = words(x, v + "w")
    return f"list_transform(range(0, len({own}), {step}), lambda {v}i: array_to_string(list_slice({own}, {v}i + 1, {v}i + {step}), ' '))"


UNITS = f"""flatten(list_transform({sentences('text')}, lambda u:
  CASE WHEN {tokens('u', 'w1')} > 350 THEN {slices('u', 269, 'h')} ELSE [u] END))"""

CHUNKS = f"""
units AS (SELECT source, doc_id AS page, text, list_transform({UNITS}, lambda u: {{'t': u, 'k': {tokens('u', 'w2')}}}) AS us
  FROM (SELECT source, doc_id, coalesce(text, '') AS text FROM documents)),
packed AS (SELECT source, page, text, list_reduce(us, lambda a, u:
  CASE WHEN len(a.cur) > 0 AND a.n + u.k > 350 THEN list_transform([list_reduce(list_reverse(a.cur), lambda c, p:
      CASE WHEN c.stop OR c.n + p.k > 60 THEN {{'kept': c.kept, 'n': c.n, 'stop': true}}
           ELSE {{'kept': list_prepend(p, c.kept), 'n': c.n + p.k, 'stop': false}} END,
      {{'kept': []::STRUCT(t VARCHAR, k INT)[], 'n': 0, 'stop': false}})], lambda k:
      {{'done': list_append(a.done, array_to_string(list_transform(a.cur, lambda x: x.t), ' ')), 'cur': list_append(k.kept, u), 'n': k.n + u.k}})[1]
  ELSE {{'done': a.done, 'cur': list_append(a.cur, u), 'n': a.n + u.k}} END,
  {{'done': []::VARCHAR[], 'cur': []::STRUCT(t VARCHAR, k INT)[], 'n': 0}}) AS a FROM units),
pieces AS (SELECT source, page, CASE WHEN len(a.cur) > 0
  THEN list_append(a.done, array_to_string(list_transform(a.cur, lambda x: x.t), ' ')) ELSE a.done END AS done FROM packed),
keys AS (SELECT source, substr(sha1(concat_ws(':', source, count(*),
  sum(CAST('0x' || substr(sha1(concat_ws(':', page, text)), 1, 8) AS BIGINT)))), 1, 8) AS doc_key FROM units GROUP BY source),
rows_ AS (SELECT source, page, unnest(done) AS text, generate_subscripts(done, 1) AS pos FROM pieces),
chunks AS (SELECT concat_ws(':', doc_key, i) AS id, text, page, source, i AS index FROM
  (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, pos) - 1 AS i FROM rows_) JOIN keys USING (source))"""


def crc32(word: str) -> str:
    table = "list_reduce([1,2,3,4,5,6,7,8], lambda t, j: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, xor(r, b))"
    codes = f"list_transform(regexp_extract_all({word}, '.'), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda r, b: {table}, 4294967295::BIGINT), 4294967295)"


def vectors(name: str, key: str, source: str) -> str:
    """CTEs: `name` (key, bucket, value) and `name`_norm (key, norm2)."""
    stop = ", ".join(map(lit, STOP_WORDS))
    return f"""
{name}_words AS (SELECT {key}, w AS w0 FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {source}) WHERE w NOT IN ({stop})),
{name}_stems AS (SELECT {key}, CASE WHEN length(w0) > 3 AND ends_with(w0, 's') THEN left(w0, length(w0) - 1) ELSE w0 END AS w FROM {name}_words),
{name}_hash AS (SELECT w, {crc32('w')} AS h FROM (SELECT DISTINCT w FROM {name}_stems)),
{name} AS (SELECT {key}, h % 512 AS bucket, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS value
  FROM {name}_stems JOIN {name}_hash USING (w) GROUP BY ALL HAVING value <> 0),
{name}_norm AS (SELECT {key}, sum(value * value) AS norm2 FROM {name} GROUP BY ALL)"""


def top(k: int, questions: str, qid: str, rows: str, key: str, name: str) -> str:
    return f"""
{vectors('qv', qid, questions)}, {vectors('rv', key, rows)},
dots AS (SELECT qv.{qid}, rv.{key}, sum(qv.value * rv.value) AS dot FROM qv JOIN rv USING (bucket) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT q.{qid}, r.{key}, score, row_number() OVER (PARTITION BY q.{qid} ORDER BY score DESC, r.{key}) AS rank
  FROM (SELECT q.{qid}, r.{key}, coalesce(round(dot::DOUBLE / sqrt((qn.norm2 * rn.norm2)::DOUBLE), 9), 0.0) AS score
    FROM {questions} q CROSS JOIN {rows} r LEFT JOIN dots USING ({qid}, {key})
    LEFT JOIN qv_norm qn USING ({qid}) LEFT JOIN rv_norm rn USING ({key})) AS q
  JOIN (SELECT {key} FROM {rows}) AS r USING ({key})) WHERE rank <= {k})"""


RETRIEVED = f"""WITH {CHUNKS}, asked AS (SELECT item_id, text FROM benchmark), {top(4, 'asked', 'item_id', 'chunks', 'id', 'best')},
retrieved AS (SELECT item_id, rank, id, score, page, source, c.text FROM best JOIN chunks c USING (id))"""
CONTEXT = "string_agg('[' || rank || '] (page ' || page || ', ' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)"
PLAIN_CONTEXT = "string_agg('[' || rank || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)"


def windows(x: str, w: int = 3) -> str:
    own = sentences(x)
    s = f"(CASE WHEN len({own}) > 0 THEN {own} ELSE [{x}] END)"
    starts = f"range(0, greatest(1, len({s}) - {w} + 2), {max(1, w - 1)})"
    return f"list_concat({s}, list_transform({starts}, lambda i: array_to_string(list_slice({s}, i + 1, i + {w}), ' ')))"


def premises(source: str, qid: str) -> str:
    """qid, rank, no, premise, the first of repeats."""
    return f"""SELECT {qid}, rank, row_number() OVER (PARTITION BY {qid}, rank ORDER BY p) - 1 AS no, premise FROM
  (SELECT {qid}, rank, premise, min(p) AS p FROM (SELECT {qid}, rank, unnest(l) AS premise, generate_subscripts(l, 1) AS p
    FROM (SELECT {qid}, rank, {windows('text')} AS l FROM {source})) GROUP BY ALL)"""


def quote_found(quote: str, text: str, pad: str) -> str:
    segments = f"list_filter(list_transform(regexp_split_to_array({quote}, '\\.{{3}}|…'), lambda g: {norm('g')}), lambda m: m <> '')"
    return f"(len({segments}) > 0 AND len(list_filter({segments}, lambda z: NOT contains({pad} || {norm(text)} || {pad}, {pad} || z || {pad}))) = 0)"


def html_escape(x: str) -> str:
    for character, entity in HTML_ENTITIES:
        x = f"replace({x}, {lit(character)}, {lit(entity)})"
    return x


def scored(x: str) -> str:
    x = f"lower({replace(x, SPACE + '+', ' ')})"
    for word, digit in NUMBER_WORDS:
        x = replace(x, rf"\b{word}\b", digit)
    return x


NOT_FOUND_TEST = "({0} = '' OR upper(regexp_replace({1}, '[^A-Za-z]', '', 'g')) = 'NOTFOUND')"
def cleaned(x: str) -> str:
    spaces = "translate({0}, chr(160) || chr(8194) || chr(8195) || chr(8199) || chr(8201) || chr(8202) || chr(8239), '       ')".format(x)
    return strip(replace(replace(spaces, rf'[【\[]{SPACE}*([0-9]+(?:{SPACE}*,{SPACE}*[0-9]+)*){SPACE}*[】\]]', r'[\1]'), '[ \\t]+', ' '))


def said_nothing(x: str) -> str:
    return NOT_FOUND_TEST.format(strip(f"coalesce({x}, '')"), f"coalesce({x}, '')")


def claim_json(claim: str, supported: str, source: str, quote: str, reason: str) -> str:
    return f"CAST(json_object('claim', {claim}, 'supported', {supported}, 'source', {source}, 'quote', {quote}, 'reason', {reason}) AS VARCHAR)"


QUOTE = "substr(prompt, 14, 60)"
GOOD = claim_json("'It says ' || substr(prompt, 14, 30)", "true", "1", QUOTE, "'stated'")
BAD = claim_json("'It is otherwise'", "false", "NULL", "''", "'absent'")
FAR = claim_json("'Far off'", "true", "99", QUOTE, "''")
HALF = claim_json("'Half a source'", "true", "1.5", QUOTE, "'seen'")
TOLD = claim_json("'Told as text'", "'true'", "1", QUOTE, "''")
RAW = f"""CASE length(prompt) % 9 WHEN 0 THEN 'not json' WHEN 1 THEN '{{broken' WHEN 2 THEN '{{"claims":[]}}' WHEN 3 THEN '{{"claims":["only words"]}}'
  WHEN 4 THEN '```json' || chr(10) || '{{"claims":[' || {GOOD} || ']}}' || chr(10) || '```' WHEN 5 THEN 'Sure: {{"claims":[' || {GOOD} || ',' || {BAD} || ',"words"]}} Done.'
  WHEN 6 THEN '{{"claims":[' || {FAR} || ',' || {HALF} || ']}}' WHEN 7 THEN '{{"claims":[' || {GOOD} || ',' || {FAR} || ']}}' ELSE '{{"claims":[' || {TOLD} || ']}}' END"""
#: From retrieval to verdicts, with the scripted models, for the strict and the naive generator.
ASK = f"""{RETRIEVED},
gate AS (SELECT item_id, score AS best, score >= 0.15 AS passed FROM retrieved WHERE rank = 1),
contexts AS (SELECT item_id, {CONTEXT} AS headed, {PLAIN_CONTEXT} AS plain FROM retrieved GROUP BY item_id),
gen AS (SELECT item_id, naive, 'SOURCES:' || chr(10) || headed || chr(10) || chr(10) || 'QUESTION: ' || text || chr(10) || chr(10) || 'ANSWER:' AS prompt
  FROM contexts JOIN asked USING (item_id) JOIN gate USING (item_id) CROSS JOIN (VALUES (false), (true)) AS v(naive) WHERE passed),
drafted AS MATERIALIZED (SELECT item_id, naive, {cleaned('reply')} AS draft FROM (SELECT item_id, naive, CASE WHEN NOT naive AND length(prompt) % 6 = 0 THEN 'NOT_FOUND'
  ELSE substr(prompt, strpos(prompt, ')' || chr(10)) + 2, 120) || CASE WHEN naive THEN ' and so on [1].' ELSE ' [1].' END END AS reply FROM gen)),
said AS (SELECT * FROM drafted WHERE NOT {said_nothing('draft')}),
raws AS (SELECT item_id, naive, {RAW} AS raw FROM (SELECT item_id, naive, 'SOURCES:' || chr(10) || plain || chr(10) || chr(10) || 'ANSWER:' || chr(10)
  || {citations('draft')} || chr(10) || chr(10) || 'JSON:' AS prompt FROM said JOIN contexts USING (item_id))),
parsed AS MATERIALIZED (SELECT item_id, naive, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS v FROM (SELECT item_id, naive, regexp_extract(raw, '(?s)\\{{.*\\}}') AS body FROM raws)),
items AS (SELECT item_id, naive, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS claim_no
  FROM (SELECT item_id, naive, CAST(json_extract(v, '$.claims') AS JSON[]) AS l FROM parsed WHERE json_type(v, '$.claims') = 'ARRAY')),
told AS (SELECT item_id, naive, claim_no, {strip("coalesce(item->>'$.claim', '')")} AS claim, {strip("coalesce(item->>'$.quote', '')")} AS told_quote,
  {strip("coalesce(item->>'$.reason', '')")} AS told_reason, coalesce(json_type(item, '$.supported') = 'BOOLEAN' AND item->>'$.supported' = 'true', false) AS told,
  CASE WHEN json_type(item, '$.source') IN ('BIGINT', 'UBIGINT') THEN CAST(item->>'$.source' AS BIGINT) END AS src FROM items WHERE json_type(item) = 'OBJECT'),
judged_ AS (SELECT told.*, page, told AND text IS NOT NULL AND coalesce({quote_found('told_quote', 'text', "''")}, false) AS supported
  FROM told LEFT JOIN retrieved ON retrieved.item_id = told.item_id AND rank = src WHERE claim <> ''),
verdicts AS MATERIALIZED (SELECT item_id, naive, claim_no, claim, supported, page, CASE WHEN supported THEN src END AS source_rank, CASE WHEN supported THEN told_quote ELSE '' END AS quote,
  CASE WHEN told AND NOT supported THEN CASE WHEN told_reason = '' THEN '' ELSE told_reason || ' ' END || '[evidence quote not found in cited source]' ELSE told_reason END AS reason FROM judged_),
counted AS (SELECT item_id, naive, count(*) FILTER (supported) AS k, count(*) AS n FROM verdicts GROUP BY ALL),
errors AS (SELECT item_id, naive, CASE WHEN v IS NULL THEN 'no JSON object' WHEN coalesce(json_array_length(v, '$.claims'), 0) < 1 THEN 'no claims'
  WHEN n IS NULL THEN 'no usable claims' END AS verify_error FROM parsed LEFT JOIN counted USING (item_id, naive))"""


def entailed(drafts: str, retrieved: str) -> str:
    """CTEs up to `chosen` (item_id, claim_no, claim, p, rank, premise): the best premise of each claim of drafts (item_id, text)."""
    return f"""premises AS ({premises(retrieved, 'item_id')}),
      claims AS (SELECT item_id, generate_subscripts(l, 1) - 1 AS claim_no, unnest(l) AS claim FROM (SELECT item_id, {claims('text')} AS l FROM {drafts})),
      said_words AS (SELECT DISTINCT claim, list_distinct(list_filter(string_split({norm('claim')}, ' '), lambda w: w <> '')) AS ws FROM claims),
      pairs AS (SELECT item_id, claim_no, claim, rank, no, premise, len(ws) AS m,
        len(list_intersect(ws, string_split({norm('premise')}, ' '))) AS hit FROM claims JOIN said_words USING (claim) JOIN premises USING (item_id)),
      judged AS (SELECT *, CASE WHEN m = 0 THEN 0.0 ELSE hit::DOUBLE / m::DOUBLE END AS p FROM pairs),
      chosen AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY item_id, claim_no ORDER BY p DESC, rank, no) = 1)"""


#: Every question under each configuration: config, item_id, question, best, draft, status, k, n.
RUNS = f"""{ASK}, strict_drafts AS (SELECT item_id, draft AS text FROM said WHERE NOT naive), {entailed('strict_drafts', 'retrieved')},
nli AS (SELECT item_id, count(*) FILTER (p >= 0.5) AS k, count(*) AS n FROM chosen GROUP BY item_id),
configs AS (SELECT * FROM (VALUES ('none', NULL, false), ('llm', 'llm', false), ('nli', 'nli', false), ('naive', NULL, true), ('naive_llm', 'llm', true)) AS t(config, verifier, naive)),
runs_ AS (SELECT config, verifier, item_id, asked.text AS question, best, passed, draft, CASE verifier WHEN 'llm' THEN counted.k WHEN 'nli' THEN nli.k END AS k,
  CASE verifier WHEN 'llm' THEN counted.n WHEN 'nli' THEN nli.n END AS n, CASE WHEN verifier = 'llm' THEN verify_error END AS verify_error
  FROM configs CROSS JOIN asked JOIN gate USING (item_id) LEFT JOIN drafted USING (item_id, naive) LEFT JOIN counted USING (item_id, naive)
  LEFT JOIN errors USING (item_id, naive) LEFT JOIN nli USING (item_id)),
stated AS MATERIALIZED (SELECT *, CASE WHEN NOT passed OR {said_nothing('draft')} THEN 'not_found' WHEN verifier IS NULL THEN 'unchecked'
  WHEN verify_error IS NOT NULL OR coalesce(n, 0) = 0 THEN 'unverified' WHEN k = n THEN 'grounded' WHEN k = 0 THEN 'ungrounded' ELSE 'partial' END AS status FROM runs_),
runs AS (SELECT *, CASE status WHEN 'not_found' THEN 'Not found in the document.' WHEN 'ungrounded' THEN
  'I could not verify an answer against the document, so I am not showing one. The unverified draft is available below.' ELSE draft END AS answer,
  status IN ('not_found', 'ungrounded') AS abstained FROM stated)"""
SHOWN = "status IN ('grounded', 'partial', 'unchecked', 'unverified')"
RESULTS = f"""{RUNS}, results AS (SELECT config, CASE WHEN item_id % 2 = 1 THEN 'unanswerable' ELSE 'answerable' END AS type, question AS q,
  CASE WHEN item_id % 2 = 1 THEN 'off-topic' END AS kind, status, answer,
  CASE WHEN item_id % 2 = 0 THEN {SHOWN} AND contains({scored('answer')}, {scored('upper(substr(question, 1, 2))')}) AND contains({scored('answer')}, 'a') END AS correct,
  CASE WHEN item_id % 2 = 1 THEN {SHOWN} END AS hallucinated FROM runs)"""
SUMMARY = """summary AS (SELECT config,
  count(*) FILTER (type = 'answerable' AND correct) / nullif(count(*) FILTER (type = 'answerable'), 0)::DOUBLE AS answer_rate,
  count(*) FILTER (type = 'unanswerable' AND NOT hallucinated) / nullif(count(*) FILTER (type = 'unanswerable'), 0)::DOUBLE AS abstain_rate,
  count(*) FILTER (type = 'unanswerable' AND hallucinated) / nullif(count(*) FILTER (type = 'unanswerable'), 0)::DOUBLE AS hallucination_rate,
  count(*) FILTER (type = 'answerable' AND status = 'grounded' AND correct) / nullif(count(*) FILTER (type = 'answerable' AND status = 'grounded'), 0)::DOUBLE AS grounded_precision,
  count(*) FILTER (type = 'answerable') AS n_answerable, count(*) FILTER (type = 'unanswerable') AS n_unanswerable,
  count(*) FILTER (type = 'answerable' AND status = 'grounded' AND correct) / nullif(count(*) FILTER (status = 'grounded'), 0)::DOUBLE AS grounded_precision_all
  FROM results GROUP BY config)"""
PERCENT = "CASE WHEN {0} IS NULL THEN 'n/a' ELSE CAST(round_even({0} * 100, 0) AS INT) || '%' END"

DOT = "list_reduce(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE), lambda x, y: x + y)"
NORM = "sqrt(list_reduce(list_transform({0}.embedding, lambda z: z::DOUBLE * z::DOUBLE), lambda x, y: x + y))"



def marked(x: str) -> str:
    """The second and third sentence of a text marked in it. Texts of the tables hold Latin letters alone."""
    between = "[^A-Za-z0-9_À-ɏ]+"
    found = f"regexp_extract({x}, '(?i)' || array_to_string(regexp_extract_all(q, '[A-Za-z0-9]+'), '{between}'))"
    told = f"list_filter(list_slice({sentences(x)}, 2, 3), lambda q: regexp_matches(q, '[A-Za-z0-9]'))"
    places = f"list_sort(list_filter(list_transform(list_transform({told}, lambda q: {found}), lambda m: {{'at': strpos({x}, m), 'size': length(m)}}), lambda p: p.at > 0 AND p.size > 0))"
    before, inside = html_escape(f"substr({x}, d.e + 1, p.at - 1 - d.e)"), html_escape(f"substr({x}, p.at, p.size)")
    swept = f"""list_reduce({places}, lambda d, p: CASE WHEN p.at > d.e THEN {{'at': 0::BIGINT, 'size': 0::BIGINT, 'h': d.h || {before} || '<mark>' || {inside} || '</mark>', 'e': p.at + p.size - 1}}
      ELSE d END, {{'at': 0::BIGINT, 'size': 0::BIGINT, 'h': '', 'e': 0::BIGINT}})"""
    return f"list_transform([{swept}], lambda d: d.h || {html_escape(f'substr({x}, d.e + 1)')})[1]"


def joined(blocks: str) -> str:
    short = f"(len({words('string_split(o, chr(10))[-1]', 'w')}) < 8 AND NOT regexp_matches(o, '[.!?:,;]$'))"
    return f"""list_reduce(list_filter(list_transform({blocks}, lambda b: {clean('b')}), lambda f: f <> ''),
      lambda o, b: CASE WHEN o = '' THEN b WHEN {short} OR regexp_matches(o, '[.!?]$') THEN o || chr(10) || chr(10) || b ELSE o || ' ' || b END, '')"""


PARAGRAPHS = f"regexp_split_to_array(text, '\\n{SPACE}*\\n')"

#: The scripted client's reply, model and error.
OUTCOME = """CASE WHEN length(prompt) % 7 NOT IN (1, 3) THEN (CASE WHEN length(prompt) % 7 IN (0, 2) THEN 'second' ELSE 'first' END) || ': ' || md5(prompt) END AS reply,
  CASE WHEN length(prompt) % 7 IN (1, 3) THEN NULL WHEN length(prompt) % 7 IN (0, 2) THEN 'second' ELSE 'first' END AS model,
  CASE length(prompt) % 7 WHEN 1 THEN 'Unreachable: no route' WHEN 3 THEN 'ValueError: bad request' END AS error"""

FAILED = f"""{ASK}, outcomes AS (SELECT item_id, {OUTCOME} FROM gen WHERE NOT naive)
      SELECT item_id, CASE WHEN NOT passed THEN 'not_found' WHEN error IS NOT NULL THEN 'failed' ELSE 'unchecked' END AS status,
        CASE WHEN NOT passed THEN 'Not found in the document.' WHEN error IS NOT NULL THEN 'No answer: the call to the model failed.' ELSE reply END AS answer,
        NOT passed AS abstained, model, error FROM gate LEFT JOIN outcomes USING (item_id)"""

ORACLES: dict[str, str] = {
    "approx_tokens": f"SELECT doc_id, {tokens('text', 'w')} AS tokens FROM documents",
    "clean_block": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
    "join_blocks": f"""SELECT doc_id, list_reduce(list_filter(list_transform(string_split(text, chr(10)), lambda b: {clean('b')}), lambda f: f <> ''),
      lambda o, b: CASE WHEN o = '' THEN b WHEN (len({words("string_split(o, chr(10))[-1]", 'w')}) < 8 AND NOT regexp_matches(o, '[.!?:,;]$'))
        OR regexp_matches(o, '[.!?]$') THEN o || chr(10) || chr(10) || b ELSE o || ' ' || b END, '') AS joined FROM documents""",
    "split_sentences": f"SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {sentences('text')} AS l FROM documents)",
    "hard_split": f"SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS piece FROM (SELECT doc_id, {slices('text', 76, 'h')} AS l FROM documents)",
    "strip_citations": f"SELECT doc_id, {citations('t')} AS stripped FROM (SELECT doc_id, text || ' [1]. Also so [2, 3].' AS t FROM documents)",
    "clean_answer": f"""SELECT doc_id, {cleaned('t')} AS answer
      FROM (SELECT doc_id, '  【 ' || doc_id || ' 】 ' || chr(9) || text || ' [ 2, 3 ] ' AS t FROM documents)""",
    "normalise_text": f"SELECT doc_id, {norm('text')} AS normalised FROM documents",
    "scorer_normalise": f"SELECT doc_id, {scored('t')} AS normalised FROM (SELECT doc_id, text || ' two  Three twenty-five thirty' AS t FROM documents)",
    "escape_dollars": "SELECT doc_id, replace('$60 or $70 ' || text, '$', '\\$') AS escaped FROM documents",
    "escape_html": f"SELECT page_id, {html_escape('html')} AS escaped FROM pages",
    "is_not_found": f"""SELECT conv_id, turn, {NOT_FOUND_TEST.format(strip('t'), 't')} AS not_found
      FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' not_found. ' ELSE text END AS t FROM conversations)""",
    "split_claims": f"""SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS claim
      FROM (SELECT conv_id, turn, {claims('t')} AS l FROM (SELECT conv_id, turn, text || ' So it is said [4].' AS t FROM conversations WHERE role = 'assistant'))""",
    "chunk_pages": f"WITH {CHUNKS} SELECT id, text, page, source, index FROM chunks",
    "chunk_stats": f"""WITH {CHUNKS} SELECT source, count(*) AS n_chunks, sum(t) AS tokens, max(t) AS longest, count(DISTINCT page) AS pages
      FROM (SELECT source, page, {tokens('text', 'w')} AS t FROM chunks) GROUP BY source""",
    "document_registry": f"WITH {CHUNKS} SELECT source, count(DISTINCT id) AS n_chunks FROM chunks GROUP BY source",
    "hash_embed": f"WITH {vectors('v', 'doc_id', 'documents')} SELECT doc_id, bucket, value, norm2 FROM v JOIN v_norm USING (doc_id)",
    "embed_norms": f"""WITH {vectors('v', 'doc_id', 'documents')} SELECT doc_id, sqrt(coalesce(norm2, 0)::DOUBLE) AS norm
      FROM documents LEFT JOIN v_norm USING (doc_id)""",
    "topk_sparse": f"{RETRIEVED} SELECT item_id, rank, id, page, source, round(score, 6) AS score FROM retrieved",
    "similarity_gate": f"""WITH turns AS (SELECT conv_id || '/' || turn AS qid, text FROM conversations WHERE role = 'user'),
      docs AS (SELECT doc_id, text FROM documents), {top(1, 'turns', 'qid', 'docs', 'doc_id', 'best')}
      SELECT qid, round(score, 6) AS best, coalesce(score >= 0.15, false) AS passed FROM turns LEFT JOIN best USING (qid)""",
    "topk_dense": f"""SELECT qid, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank
      FROM (SELECT a.vec_id AS qid, b.vec_id, round({DOT} / ({NORM.format('a')} * {NORM.format('b')}), 9) AS score
        FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 4""",
    "build_context": f"{RETRIEVED} SELECT item_id, {CONTEXT} AS context FROM retrieved GROUP BY item_id",
    "generator_prompts": f"""{RETRIEVED} SELECT item_id, 'SOURCES:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || text || chr(10) || chr(10) || 'ANSWER:' AS prompt
      FROM (SELECT item_id, {CONTEXT} AS context FROM retrieved GROUP BY item_id) JOIN asked USING (item_id)""",
    "verifier_prompts": f"""{RETRIEVED} SELECT item_id, 'SOURCES:' || chr(10) || context || chr(10) || chr(10) || 'ANSWER:' || chr(10) || {citations('text')} || chr(10) || chr(10) || 'JSON:' AS prompt
      FROM (SELECT item_id, {PLAIN_CONTEXT} AS context FROM retrieved GROUP BY item_id) JOIN asked USING (item_id)""",
    "quote_in_text": f"""{RETRIEVED} SELECT item_id, rank, {quote_found('asked.text', 'retrieved.text', "''")} AS found,
      {quote_found('asked.text', 'retrieved.text', "' '")} AS found_strict FROM retrieved JOIN asked USING (item_id)""",
    "nli_windows": premises("(SELECT item_id, 1 AS rank, text FROM benchmark)", "item_id"),
    "nli_verdicts": f"""{RETRIEVED}, {entailed('asked', 'retrieved')}
      SELECT item_id, claim_no, claim, p >= 0.5 AS supported, CASE WHEN p >= 0.5 THEN rank END AS source_rank,
        CASE WHEN p >= 0.5 THEN premise ELSE '' END AS quote, round_even(p, 3) AS score FROM chosen""",
    "parse_json_object": f"{ASK} SELECT item_id, v IS NOT NULL AS parsed FROM parsed WHERE NOT naive",
    "reply_errors": f"{ASK} SELECT item_id, verify_error FROM errors WHERE NOT naive",
    "llm_verdicts": f"{ASK} SELECT item_id, claim_no, claim, supported, source_rank, quote, reason FROM verdicts WHERE NOT naive",
    "claim_support": f"{ASK} SELECT item_id, k, n, k / n::DOUBLE AS ratio FROM counted WHERE NOT naive",
    "verdict_lines": f"""{ASK} SELECT item_id, claim_no, CASE WHEN supported THEN '[ok] ' || claim || ' (source ' || source_rank || ', page ' || page || ')'
      ELSE '[no] ' || claim || CASE WHEN reason <> '' THEN ' - ' || reason ELSE '' END END AS line FROM verdicts WHERE NOT naive""",
    "quotes_by_rank": f"{ASK} SELECT item_id, source_rank, string_agg(quote, ' / ' ORDER BY claim_no) AS quotes FROM verdicts WHERE supported AND NOT naive GROUP BY ALL",
    "sources_with_quotes": f"""{ASK} SELECT r.item_id, rank, r.page, source, count(quote) AS n_quotes, coalesce(string_agg(quote, ' / ' ORDER BY claim_no), '') AS quotes
      FROM retrieved r LEFT JOIN (SELECT * FROM verdicts WHERE supported AND NOT naive) v ON v.item_id = r.item_id AND v.source_rank = r.rank GROUP BY ALL""",
    "ask": f"{RUNS} SELECT item_id, round(best, 6) AS best, status, answer, draft, abstained, k, n, verify_error FROM runs WHERE config = 'llm'",
    "decide_status": f"{RUNS} SELECT config, item_id, status, answer, abstained FROM runs",
    "badge": f"""{RUNS} SELECT config, item_id, CASE status WHEN 'grounded' THEN 'success' WHEN 'ungrounded' THEN 'error' WHEN 'not_found' THEN 'info'
      WHEN 'unchecked' THEN 'info' ELSE 'warning' END AS level, CASE status WHEN 'grounded' THEN 'Grounded - ' || k || '/' || n || ' claims supported'
      WHEN 'partial' THEN 'Partially grounded - ' || k || '/' || n || ' claims supported. Check the flagged claims.'
      WHEN 'ungrounded' THEN 'Not grounded - no claim could be verified against the document.' WHEN 'not_found' THEN 'Not found in the document.'
      WHEN 'unverified' THEN 'Could not run the grounding check - treat this answer as unverified.'
      ELSE 'Grounding check is off (baseline mode) - this answer is unverified.' END AS label FROM runs""",
    "highlight": f"SELECT doc_id, {marked('text')} AS html FROM documents",
    "question_rows": """SELECT document, type, row_number() OVER (PARTITION BY document, type ORDER BY item_id) - 1 AS no, text AS q,
      CASE type WHEN 'answerable' THEN substr(text, 1, 3) || '|two' END AS expect,
      CASE type WHEN 'unanswerable' THEN CASE WHEN item_id % 3 = 0 THEN 'off-topic' ELSE 'near-miss' END END AS kind
      FROM (SELECT *, 'set-' || item_id % 4 || '.json' AS document, CASE WHEN item_id % 8 < 4 THEN 'answerable' ELSE 'unanswerable' END AS type FROM benchmark)""",
    "eval_rows": f"{RESULTS} SELECT config, type, q, kind, status, answer, correct, hallucinated FROM results",
    "eval_summary": f"{RESULTS}, {SUMMARY} SELECT * FROM summary",
    "eval_markdown": f"""{RESULTS}, {SUMMARY} SELECT config, '| ' || concat_ws(' | ', config, {PERCENT.format('answer_rate')}, {PERCENT.format('abstain_rate')},
      {PERCENT.format('hallucination_rate')}, {PERCENT.format('grounded_precision')}) || ' |' AS line FROM summary""",
    "status_pivot": f"""{RESULTS} SELECT config, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('grounded', 'partial', 'ungrounded', 'not_found', 'unverified', 'unchecked'))}
      FROM results GROUP BY config""",
    "logged_replies": f"""{RETRIEVED}, prompts AS (SELECT item_id, 'SOURCES:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || text || chr(10) || chr(10) || 'ANSWER:' AS prompt
      FROM (SELECT item_id, {CONTEXT} AS context FROM retrieved GROUP BY item_id) JOIN asked USING (item_id)) SELECT item_id, {OUTCOME} FROM prompts""",
    "failed_calls": FAILED,
    "sql_ask": FAILED,
    "stage_rows": f"""{ASK} SELECT 'retrieved' AS stage, count(*) AS rows FROM retrieved UNION ALL SELECT 'gate', count(*) FROM gate
      UNION ALL SELECT 'drafts', count(*) FROM drafted WHERE NOT naive UNION ALL SELECT 'verdicts', count(*) FROM verdicts WHERE NOT naive
      UNION ALL SELECT 'errors', count(*) FROM errors WHERE NOT naive""",
    "stream_registry": f"WITH {CHUNKS} SELECT source, count(DISTINCT id) AS n_chunks FROM chunks GROUP BY source",
    "store_batches": "SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE lower(text) END AS text, lang FROM documents",
    "pdf_round_trip": f"SELECT doc_id, text FROM (SELECT doc_id, {joined(PARAGRAPHS)} AS text FROM documents) WHERE text <> ''",
    "config_ablation": f"{RUNS} SELECT config, status, count(*) AS questions, sum(k) AS supported, sum(n) AS claims FROM runs GROUP BY ALL",
}
