"""The registered queries again, as independent DuckDB SQL over the same tables."""

from __future__ import annotations

from hopframe import schemas
from hopframe.functions.stemming import DOUBLE_SUFFIXES, IRREGULAR, LAST_SUFFIXES, PLAIN_SUFFIXES
from hopframe.plans.derived import run_names, run_rows

NL = "chr(10)"
REASON = "First break the reasoning down into intermediate questions, then provide an answer."
ANSWER = "First provide an answer, then break the reasoning down into intermediate questions."
FOLLOW = "Are follow up questions needed here:"


def _tok(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))"


def _join(items: str, sep: str = "''") -> str:
    return f"coalesce(array_to_string({items}, {sep}), '')"


def _strip_lines(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, {NL}), lambda li: trim(li, ' ' || chr(9) || chr(13))), {NL})"


def _run_values() -> str:
    rows = [
        f"({r['run_no']}, '{name}', '{r['model']}', '{r['strategy']}', false, false, {str(r['examplars']).lower()})"
        for r, name in zip(run_rows(), run_names())
    ]
    return "(VALUES " + ", ".join(rows) + ") v(run_no, run_id, model, strategy, answer_first, random_facts, examplars)"


def _word(o: str) -> str:
    return (
        f"CASE WHEN list_contains(ents, {o}) THEN 'What' WHEN regexp_full_match({o}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
        f"THEN 'When' WHEN regexp_full_match({o}, '[-+]?[0-9][0-9,]*([.][0-9]+)?') THEN 'What' ELSE 'Who' END"
    )


CUST = """
cust AS (SELECT c_custkey AS k, c_name, c_mktsegment, n_name, r_name FROM customer
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

# every question with its facts in order; bad marks rows whose reference leads nowhere
QA = CUST + """,
qa AS (
  SELECT 'c' || k || cp AS id, k * 8 + length(cp) AS pos, k AS n,
         'Which region does the nation of ' || c_name || ' lie in?' AS question, r_name AS answer,
         'compositional' AS type, [c_name, n_name] AS titles,
         [c_name || ' belongs to the nation ' || n_name || '.',
          CASE WHEN k % 17 = 0 THEN n_name || ' is a trading nation.'
               ELSE n_name || ' lies in the region ' || r_name || '.' END] AS facts,
         [c_name, n_name] AS subj, ['country of citizenship', 'country'] AS rel, [n_name, r_name] AS obj,
         k % 97 = 0 AS bad
  FROM cust, (VALUES (''), ('d')) c(cp) WHERE cp = '' OR k % 50 = 0
  UNION ALL
  SELECT 'o' || o_orderkey, o_orderkey * 8 + 2, o_orderkey,
         'Which nation does the customer of Order ' || o_orderkey || ' belong to?', n_name, 'inference',
         ['Order ' || o_orderkey, 'Order ' || o_orderkey, c_name],
         ['Order ' || o_orderkey || ' was placed by ' || c_name || '.',
          'Order ' || o_orderkey || ' was placed on ' || strftime(o_orderdate, '%Y-%m-%d') || '.',
          c_name || ' belongs to the nation ' || n_name || '.'],
         ['Order ' || o_orderkey, 'Order ' || o_orderkey, c_name],
         ['customer', 'inception', 'country of citizenship'],
         [c_name, strftime(o_orderdate, '%Y-%m-%d'), n_name], false
  FROM orders JOIN cust ON o_custkey = k
  UNION ALL
  SELECT 's' || a.s_suppkey, a.s_suppkey * 8 + 3, a.s_suppkey,
         'Who has the larger account balance, ' || a.s_name || ' or ' || b.s_name || '?',
         CASE WHEN b.s_acctbal > a.s_acctbal THEN b.s_name ELSE a.s_name END, 'comparison',
         [a.s_name, b.s_name],
         [a.s_name || ' has an account balance of ' || CAST(a.s_acctbal AS DECIMAL(12,2)) || '.',
          b.s_name || ' has an account balance of ' || CAST(b.s_acctbal AS DECIMAL(12,2)) || '.'],
         [a.s_name, b.s_name], ['balance', 'balance'],
         [CAST(CAST(a.s_acctbal AS DECIMAL(12,2)) AS VARCHAR), CAST(CAST(b.s_acctbal AS DECIMAL(12,2)) AS VARCHAR)], false
  FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
  UNION ALL
  SELECT 'b' || a.k, a.k * 8 + 4, a.k, 'Are ' || a.c_name || ' and ' || b.c_name || ' from the same region?',
         CASE WHEN a.r_name = b.r_name THEN 'yes' ELSE 'no' END, 'bridge_comparison',
         [a.c_name, a.n_name, b.c_name, b.n_name],
         [a.c_name || ' belongs to the nation ' || a.n_name || '.', a.n_name || ' lies in the region ' || a.r_name || '.',
          b.c_name || ' belongs to the nation ' || b.n_name || '.', b.n_name || ' lies in the region ' || b.r_name || '.'],
         [a.c_name, a.n_name, b.c_name, b.n_name],
         ['country of citizenship', 'country', 'country of citizenship', 'country'],
         [a.n_name, a.r_name, b.n_name, b.r_name], false
  FROM cust a JOIN cust b ON b.k = a.k + 1
),
enl AS (SELECT list(nm) AS ents FROM (SELECT n_name AS nm FROM nation UNION ALL SELECT r_name FROM region))
"""

_STEP = _join(
    "list_transform(range(1, len(obj) + 1), lambda i: {asked} || ': ' || "
    "(" + _word("obj[i]") + ") || ' is the ' || rel[i] || ' of ' || subj[i] || '?' || chr(10) || "
    "'Intermediate answer: ' || obj[i] || chr(10))"
).replace("{asked}", "'Intermediate question'")

_THOUGHT = (
    "CASE rel[i] WHEN 'country of citizenship' THEN subj[i] || ' is a ' || obj[i] || ' citizen' "
    "WHEN 'country' THEN subj[i] || ' is in ' || obj[i] WHEN 'inception' THEN subj[i] || ' started in ' || obj[i] "
    "ELSE obj[i] || ' is the ' || rel[i] || ' of ' || subj[i] END"
)

_HOT = _join(
    "list_transform(range(1, len(facts) + 1), lambda i: 'Follow up: ' || (" + _word("titles[i]")
    + ") || ' is ' || titles[i] || '?' || chr(10) || 'Intermediate answer: ' || facts[i] || chr(10))"
)


def _facts(base: int, lst: str = "facts") -> str:
    return (
        "'Facts:' || chr(10) || "
        + _join(f"list_transform(range(1, len({lst}) + 1), lambda i: 'Fact #' || (i - 1 + {base}) || ': ' || {lst}[i] || chr(10))")
    )


# the pieces of every strategy, and the finished texts
EX = QA + f""",
pieces AS (
  SELECT qa.*, len(facts) AS hops, array_to_string(rel, '|') AS relationships,
         {_facts(1)} AS fb1, {_facts(0)} AS fb0, array_to_string(facts, ' ') AS ctx,
         {_STEP} AS steps, {_HOT} AS hot_steps,
         {_join(f"list_transform(range(1, len(obj) + 1), lambda i: {_THOUGHT} || '.')", "' '")} AS chain
  FROM qa, enl WHERE NOT bad
),
ex AS (
  SELECT id, pos, n, type, question, answer, hops, relationships, facts, steps, chain,
    fb1 || {NL} || 'Question: ' || question || {NL} || 'Answer:' AS direct_prompt, answer AS direct_target,
    'question: ' || question || ' context: ' || ctx AS squad_prompt, answer AS squad_target,
    fb1 || {NL} || 'Question: ' || question || {NL} || '{REASON}' || {NL} AS self_ask_prompt,
    steps || 'So the final answer is ' || answer || '.' || {NL} AS self_ask_target,
    fb1 || {NL} || 'Question: ' || question || {NL} || '{ANSWER}' || {NL} AS self_ask_first_prompt,
    'The answer is ' || answer || '. Here are the intermediate steps:' || {NL} || steps AS self_ask_first_target,
    fb1 || {NL} || 'Question: ' || question || {NL} || 'Answer:' AS chain_of_thought_prompt,
    chain || ' So the answer is ' || answer || '.' || {NL} AS chain_of_thought_target,
    'The answer is ' || answer || '.' || {NL} || chain || {NL} AS chain_of_thought_first_target,
    'Question: ' || question || {NL} || '{REASON}' || {NL} || steps || 'So the answer is ' || answer || '.' || {NL} AS self_ask_shot,
    'Question: ' || question || {NL} || '{ANSWER}' || {NL} || 'The answer is ' || answer
      || '. Here are the intermediate steps:' || {NL} || steps AS self_ask_first_shot,
    'Question: ' || question || {NL} || 'Answer: ' || chain || ' So the answer is ' || answer || '.' || {NL} AS chain_of_thought_shot,
    'Question: ' || question || {NL} || 'Answer: The answer is ' || answer || '.' || {NL} || chain || {NL} AS chain_of_thought_first_shot,
    fb0 || {NL} || 'Question: ' || question || {NL} || '{FOLLOW}' || {NL} AS hot_prompt,
    'Yes.' || {NL} || hot_steps || 'So the final answer is ' || answer || '.' || {NL} AS hot_target,
    fb0 || {NL} || 'Question: ' || question || {NL} || 'Answer:' AS hot_direct_prompt,
    fb0, fb1, ctx
  FROM pieces
)
"""

RUNS = f"runs AS (SELECT * FROM {_run_values()})"

RESP = EX + f""",
{RUNS},
truth AS (
  SELECT run_id, run_no, strategy, id, pos, n, type, answer, hops,
         CASE strategy WHEN 'direct' THEN direct_target WHEN 'self_ask' THEN self_ask_target ELSE chain_of_thought_target END AS target,
         {_tok("CASE strategy WHEN 'self_ask' THEN self_ask_prompt ELSE direct_prompt END")} AS num_prompt_tokens
  FROM ex, runs
),
lined AS (SELECT *, trim(replace(target, {NL}, ' ')) AS line FROM truth),
resp AS (
  SELECT * EXCLUDE (line), CASE WHEN (n * 7 + run_no * 3) % 10 <= run_no THEN line ELSE
    CASE n % 5 WHEN 0 THEN replace(line, answer, 'unknown') WHEN 1 THEN answer WHEN 2 THEN lower(line)
               WHEN 3 THEN substring(line, 1, greatest(length(line) - 20, 0)) ELSE '' END END AS response
  FROM lined
),
judged AS (
  SELECT *, regexp_extract(response, '.*answer is (.*)[.].*', 1) AS model_answer,
         contains(lower(response), 'intermediate answer') OR contains(lower(response), 'follow up') AS self_ask,
         contains(lower(regexp_extract(response, '.*answer is (.*)[.].*', 1)), lower(answer)) AS correct
  FROM resp
)
"""


def _grams(side: str, col: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({col}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"{words} AS {side}"


WORDED = f""",
sides AS (SELECT DISTINCT target AS body FROM resp UNION SELECT DISTINCT response FROM resp),
worded AS (SELECT body, {_grams('words', 'body')} FROM sides),
"""

# From the words of each side on, whether they are stems or not.
OVERLAP = """numbered AS MATERIALIZED (SELECT row_number() OVER () AS no, any_value(words) AS words, list(body) AS bodies FROM worded GROUP BY array_to_string(words, ' ')),
nos AS (SELECT unnest(bodies) AS body, no, len(words) AS size FROM numbered),
toks AS (
  SELECT run_id, id, t.no AS tn, r.no AS rn, t.size AS ts, r.size AS rs
  FROM resp JOIN nos t ON target = t.body JOIN nos r ON response = r.body
),
asked AS MATERIALIZED (SELECT DISTINCT tn, rn, ts FROM toks),
grams AS MATERIALIZED (
  SELECT no, g, count(*) AS c FROM (
    SELECT no, unnest(words) AS g FROM numbered
    UNION ALL SELECT no, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM numbered
  ) GROUP BY no, g
),
wanted AS MATERIALIZED (SELECT tn, rn, g, c FROM asked JOIN grams ON no = tn WHERE tn <> rn),
hits AS (
  SELECT tn, rn, coalesce(sum(least(w.c, b.c)) FILTER (NOT contains(w.g, ' ')), 0) AS o1, coalesce(sum(least(w.c, b.c)) FILTER (contains(w.g, ' ')), 0) AS o2
  FROM wanted w JOIN grams b ON b.no = w.rn AND b.g = w.g GROUP BY tn, rn
  UNION ALL SELECT tn, rn, ts, greatest(ts - 1, 0) FROM asked WHERE tn = rn
),
pr AS (
  SELECT run_id, id,
         CASE WHEN rs = 0 THEN 0.0 ELSE coalesce(o1, 0)::DOUBLE / rs END AS bleu_1,
         CASE WHEN rs < 2 THEN 0.0 ELSE coalesce(o2, 0)::DOUBLE / (rs - 1) END AS bleu_2,
         CASE WHEN ts = 0 THEN 0.0 ELSE coalesce(o1, 0)::DOUBLE / ts END AS rouge_1,
         CASE WHEN ts < 2 THEN 0.0 ELSE coalesce(o2, 0)::DOUBLE / (ts - 1) END AS rouge_2
  FROM toks LEFT JOIN hits USING (tn, rn)
),
scored AS (
  SELECT judged.*, bleu_1, bleu_2, rouge_1, rouge_2,
         CASE WHEN bleu_1 + rouge_1 = 0 THEN 0.0 ELSE 2 * bleu_1 * rouge_1 / (bleu_1 + rouge_1) END AS f1_1,
         CASE WHEN bleu_2 + rouge_2 = 0 THEN 0.0 ELSE 2 * bleu_2 * rouge_2 / (bleu_2 + rouge_2) END AS f1_2
  FROM judged JOIN pr USING (run_id, id)
)
"""

SCORED = RESP + WORDED + OVERLAP


# Shape of a word: c for a consonant, v for a vowel; y is a vowel after a consonant.
_SHAPE = (
    "list_reduce(list_prepend('', string_split(x, '')), "
    "lambda a, ch: a || CASE WHEN contains('aeiou', ch) OR (ch = 'y' AND suffix(a, 'c')) THEN 'v' ELSE 'c' END)"
)


def _cut(n: int, new: str = "") -> str:
    """The word without its last n letters, with a new end."""
    return f"left(x, len(x) - {n})" + (f" || '{new}'" if new else "")


def _measure(n: int) -> str:
    """Vowel-consonant runs of the word without its last n letters."""
    return f"len(regexp_extract_all(left(s, len(x) - {n}), 'v+c+'))"


def _short_end(n: int) -> str:
    """Whether the word without its last n letters ends in a short syllable."""
    shape, stem = f"left(s, len(x) - {n})", f"left(x, len(x) - {n})"
    return f"CASE WHEN len({stem}) = 2 THEN {shape} = 'vc' ELSE suffix({shape}, 'cvc') AND NOT regexp_matches({stem}, '[wxy]$') END"


def _ends(*cases: tuple[str, str]) -> str:
    """What the first suffix that a word has makes of it; a word with none stays."""
    return "CASE " + " ".join(f"WHEN suffix(x, '{end}') THEN {value}" for end, value in cases) + " ELSE x END"


def _replaced(rules: list[tuple[str, str]]) -> str:
    """The suffix rules that need one vowel-consonant run; 'logi' keeps its l in the measured part."""
    return _ends(*[(old, f"CASE WHEN {_measure(len(old) - (old == 'logi'))} > 0 THEN {_cut(len(old), new)} ELSE x END") for old, new in rules])


def _stems(table: str) -> str:
    """CTEs from the distinct words w in the lists of a table to their stems x, a step each."""
    vowel = lambda n: f"contains(left(s, len(x) - {n}), 'v')"
    last = {end: f"{_measure(len(end))} > 1" for end in LAST_SUFFIXES}
    last["ion"] += " AND regexp_matches(left(x, len(x) - 3), '[st]$')"
    steps = [
        _ends(("ies", f"CASE WHEN len(x) = 4 THEN {_cut(1)} ELSE {_cut(2)} END"), ("sses", _cut(2)), ("ss", "x"), ("s", _cut(1))),
        # a dot marks the words whose stem is mended in the next step
        _ends(
            ("ied", f"CASE WHEN len(x) = 4 THEN {_cut(1)} ELSE {_cut(2)} END"), ("eed", f"CASE WHEN {_measure(3)} > 0 THEN {_cut(1)} ELSE x END"),
            ("ed", f"CASE WHEN {vowel(2)} THEN {_cut(2, '.')} ELSE x END"), ("ing", f"CASE WHEN {vowel(3)} THEN {_cut(3, '.')} ELSE x END"),
        ),
        f"CASE WHEN NOT suffix(x, '.') THEN x WHEN regexp_matches(x, '(at|bl|iz)[.]$') THEN {_cut(1, 'e')} "
        "WHEN len(x) > 2 AND x[-2] = x[-3] AND s[-2] = 'c' THEN CASE WHEN contains('lsz', x[-2]) THEN " + _cut(1) + " ELSE " + _cut(2) + " END "
        f"WHEN {_measure(1)} = 1 AND {_short_end(1)} THEN {_cut(1, 'e')} ELSE {_cut(1)} END",
        f"CASE WHEN suffix(x, 'y') AND len(x) > 2 AND s[-2] = 'c' THEN {_cut(1, 'i')} ELSE x END",
        f"CASE WHEN suffix(x, 'alli') AND {_measure(4)} > 0 THEN {_cut(4, 'al')} ELSE x END",
        _replaced(DOUBLE_SUFFIXES),
        _replaced(PLAIN_SUFFIXES),
        _ends(*[(end, f"CASE WHEN {cond} THEN {_cut(len(end))} ELSE x END") for end, cond in last.items()]),
        f"CASE WHEN suffix(x, 'e') AND ({_measure(1)} > 1 OR ({_measure(1)} = 1 AND NOT {_short_end(1)})) THEN {_cut(1)} ELSE x END",
        f"CASE WHEN suffix(x, 'll') AND {_measure(1)} > 1 THEN {_cut(1)} ELSE x END",
    ]
    ctes = [f"stem_0 AS (SELECT DISTINCT unnest(words) AS w, unnest(words) AS x FROM {table})"]
    ctes += [f"stem_{i + 1} AS MATERIALIZED (SELECT w, {step} AS x FROM (SELECT w, x, {_SHAPE} AS s FROM stem_{i}))" for i, step in enumerate(steps)]
    odd = " ".join(f"WHEN '{w}' THEN '{x}'" for w, x in IRREGULAR.items())
    ctes.append(f"stems AS MATERIALIZED (SELECT w, CASE WHEN len(w) <= 3 THEN w ELSE CASE w {odd} ELSE x END END AS x FROM stem_{len(steps)})")
    return ",\n".join(ctes)


# The same scores over stems, and the common subsequence: a list of the least places in the target at which a subsequence
# of each length ends grows word by word of the response, of which p are the places in the target.
STEMMED = RESP + WORDED.replace("worded AS", "plain AS") + f"""parted AS (SELECT body, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM plain),
{_stems("plain")},
worded AS (SELECT body, coalesce(stemmed, []) AS words FROM plain LEFT JOIN (SELECT body, list(x ORDER BY i) AS stemmed FROM parted JOIN stems USING (w) GROUP BY body) USING (body)),
""" + OVERLAP + """,
lcs AS (
  SELECT tn, rn, CASE WHEN tn = rn THEN ts ELSE len(list_reduce(
    list_prepend([]::BIGINT[], list_transform(r.words, lambda w: list_filter(range(1, len(t.words) + 1), lambda i: t.words[i] = w))),
    lambda best, p: list_filter(list_transform(range(1, len(best) + 2), lambda c: least(best[c], list_min(list_filter(p, lambda i: i > coalesce(best[c - 1], 0))))), lambda x: x IS NOT NULL)
  )) END AS shared
  FROM asked JOIN numbered t ON t.no = tn JOIN numbered r ON r.no = rn
),
longest AS (SELECT run_id, id, CASE WHEN ts = 0 THEN 0.0 ELSE shared::DOUBLE / ts END AS rouge_l FROM toks JOIN lcs USING (tn, rn))
"""

METRICS = ("bleu_1", "bleu_2", "rouge_1", "rouge_2", "f1_1", "f1_2")

MACRO = SCORED + """,
macro AS (
  SELECT run_id, round(avg(correct::INT), 4) AS accuracy, """ + ", ".join(f"round(avg({m}), 4) AS {m}" for m in METRICS) + """
  FROM scored GROUP BY run_id
)
"""


def _rounds(cols, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def _example(name: str, prompt: str, target: str) -> str:
    return (
        f"WITH {EX} SELECT id, {prompt} AS prompt, {target} AS target, answer, {_tok(prompt)}::INT AS num_prompt_tokens, "
        f"{_tok(target)}::INT AS num_target_tokens, ({_tok(prompt)} + {_tok(target)})::INT AS num_tokens, "
        f"hops::INT AS hops, type, relationships FROM ex"
    )


def _counts(p: str, t: str) -> str:
    return f"{_tok(p)}::INT AS num_prompt_tokens, {_tok(t)}::INT AS num_target_tokens, ({_tok(p)} + {_tok(t)})::INT AS num_tokens"


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 6) END"


def _draw(source: str, n: int, seed: int) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || id)) <= {n} AS drawn FROM {source}"


def _pool(name: str, shot: str, n: int = 20, k: int = 2) -> str:
    """k exemplars of the n drawn ones, with their own draw order."""
    return (
        f"{name}_all AS (SELECT id, {shot} AS text FROM ex ORDER BY md5('43:' || id) LIMIT {n}), "
        f"{name} AS (SELECT id, text FROM {name}_all ORDER BY md5('42:' || id) LIMIT {k})"
    )


def _block(texts: str) -> str:
    return (
        f"'Examples:' || {NL} || 'START' || {NL} || array_to_string({texts}, {NL} || 'END' || {NL} || {NL} || 'START' || {NL}) "
        f"|| {NL} || 'END' || {NL} || {NL}"
    )


def _per_row(pool: str, k: int = 2) -> str:
    """Exemplar texts of each row, ordered by a digest of row and exemplar."""
    return (
        f"SELECT ex.id, list(p.text ORDER BY md5('42:' || ex.id || ':' || p.id))[1:{k}] AS texts "
        f"FROM ex, {pool} p GROUP BY ex.id"
    )


def _att() -> str:
    return """
att AS (
  SELECT vec_id // 10 AS id, 0 AS layer, (vec_id % 10)::INT AS head, label AS out_pos, i - 1 AS in_pos,
         round(abs(embedding[i]::DOUBLE), 6) AS weight
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
)"""


def _turns() -> str:
    """Every turn, with the assistant's direct reply if there is one."""
    return """turns AS (
  SELECT u.conv_id || '-' || u.turn AS id, coalesce(u.text, '') AS prompt, coalesce(a.text, '') AS target
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
)"""


def _pairs() -> str:
    return """
turns AS (
  SELECT u.conv_id || '-' || u.turn AS id, u.text AS prompt, a.text AS target
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def _sentences(name: str, tab: str) -> str:
    return (
        f"{name} AS (SELECT DISTINCT s FROM (SELECT trim(unnest(string_split_regex(text, '[.\\n]'))) AS s FROM {tab}) WHERE s <> '')"
    )


PERTURB = EX + """,
ring AS (
  SELECT *, row_number() OVER (ORDER BY md5('7:' || id), id) AS place, count(*) OVER () AS ring_size FROM ex WHERE len(facts) > 0
),
asked AS (
  SELECT r.id, r.type, r.question, r.answer, r.facts, d.facts[1] AS other_fact
  FROM ring r JOIN ring d ON d.place = r.place % r.ring_size + 1 WHERE d.id <> r.id
),
swapped AS (
  SELECT id, type, question AS old, regexp_replace(question, '^(.*(?:, |^Are ))(.+?) (or|and) (.+?)([?]| from .*[?])$', '\\1\\4 \\3 \\2\\5') AS question, answer, facts
  FROM ex WHERE regexp_matches(question, '^(.*(?:, |^Are ))(.+?) (or|and) (.+?)([?]| from .*[?])$')
),
variants AS (
  SELECT id, 'add_fact' AS kind, type, question, answer, list_append(facts, other_fact) AS facts FROM asked
  UNION ALL
  SELECT id, 'replace_fact', type, question, answer, list_append(facts[1:len(facts) - 1], other_fact) FROM asked
  UNION ALL
  SELECT id, 'alter_word', type, question, answer,
         list_concat([substring(f, 1, m - 1) || substring(f, m + 1, 1) || substring(f, m, 1) || substring(f, m + 2)], facts[2:])
  FROM (SELECT *, facts[1] AS f, length(facts[1]) // 2 AS m FROM ex) WHERE length(f) >= 4
  UNION ALL
  SELECT id, 'swap_options', type, question, answer, facts FROM swapped
)
"""


def _reader(q: str = "question") -> str:
    return (
        f"CASE WHEN type = 'comparison' THEN contains({q}, ', ' || answer || ' or ') "
        "ELSE contains(array_to_string(facts, ' '), answer) END"
    )


def _stats(col: str) -> str:
    return (
        f"count({col}) AS count, round(avg({col}), 2) AS mean, round(stddev_samp({col}), 2) AS std, min({col})::DOUBLE AS min, "
        f"round(quantile_cont({col}, 0.25), 2) AS p25, round(quantile_cont({col}, 0.5), 2) AS p50, "
        f"round(quantile_cont({col}, 0.75), 2) AS p75, max({col})::DOUBLE AS max, sum({col})::DOUBLE AS sum"
    )


def _wide(value: str = "correct") -> str:
    cols = ", ".join(
        f"any_value({value}) FILTER (run_no = {r['run_no']}) AS run_{r['run_no']}" for r in run_rows()
    )
    return f"wide AS (SELECT id, {cols} FROM judged GROUP BY id)"


def _run_pairs(ordered: bool) -> list[tuple[int, int]]:
    names = run_names()
    return [
        (i, j) for i in range(len(names)) for j in range(len(names))
        if (names[i] < names[j] or (not ordered and i != j))
    ]


_DATES = {
    "birthday": r"\b(?:0?[1-9]|[12]\d|3[01])[- /.](?:0?[1-9]|1[0-2])[- /.](?:19|20)?\d{2}\b",
    "worded": r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)"
              r"\s(?:0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?,?\s(?:19|20)?\d{2}\b",
    "date": r"\b(?:0?[1-9]|[12]\d|3[01])[- /.](?:0?[1-9]|1[0-2])[- /.](?:\d{2}|\d{4})\b",
    "age": r"\b(?:1[89]|2\d|3[0-9])\b",
    "word": r"\b(?:died|death|born|birth)",
}


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    names = run_names()

    for s in ("direct", "self_ask", "squad"):
        q[f"{s}_examples"] = _example(s, f"{s}_prompt", f"{s}_target")
    q["cot_examples"] = _example("cot", "chain_of_thought_prompt", "chain_of_thought_target")
    parts = []
    for s, p in (("self_ask", "self_ask_first_prompt"), ("chain_of_thought", "direct_prompt")):
        t = f"{s}_first_target"
        parts.append(
            f"SELECT '{s}' AS strategy, id, {p} AS prompt, {t} AS target, answer, {_counts(p, t)}, hops::INT AS hops, type, relationships FROM ex"
        )
    q["answer_first_examples"] = f"WITH {EX} " + " UNION ALL ".join(parts)
    for key, s in (("self_ask_exemplars", "self_ask"), ("cot_exemplars", "chain_of_thought")):
        q[key] = (
            f"WITH {EX} SELECT id, {s}_shot AS text, false AS answer_first FROM ex "
            f"UNION ALL SELECT id, {s}_first_shot, true FROM ex"
        )
    celeb = CUST + f""",
celeb AS (
  SELECT 'c' || k AS id, r_name AS answer,
    'Question: Which region does the nation of ' || c_name || ' lie in?' || {NL} || '{FOLLOW}' AS head,
    'Yes.' || {NL} || 'Follow up: What is the nation of ' || c_name || '?' || {NL} || 'Intermediate answer: ' || n_name || {NL}
    || 'Follow up: What is the region of ' || n_name || '?' || {NL} || 'Intermediate answer: ' || r_name || {NL}
    || 'So the final answer is ' || r_name || '.' || {NL} AS target FROM cust
)"""
    q["celebrity_examples"] = (
        f"WITH {celeb} SELECT id, head || {NL} AS prompt, target, answer, {_counts('head', 'target')}, "
        f"head || ' ' || target AS exemplar FROM celeb"
    )
    q["hotpot_examples"] = (
        f"WITH {EX} SELECT 'self_ask' AS form, id, hot_prompt AS prompt, hot_target AS target, answer, {_counts('hot_prompt', 'hot_target')} FROM ex "
        f"UNION ALL SELECT 'direct', id, hot_direct_prompt, answer, answer, {_counts('hot_direct_prompt', 'answer')} FROM ex"
    )
    q["hotpot_exemplars"] = f"WITH {EX} SELECT id, 'Question: ' || question || {NL} || '{FOLLOW} ' || hot_target AS text FROM ex"
    strat = EX + f""",
strat AS (
  SELECT id, CASE answer WHEN 'yes' THEN 'Yes' ELSE 'No' END AS target, hot_prompt AS self_ask,
         hot_direct_prompt || {NL} AS direct, squad_prompt AS squad
  FROM ex WHERE type = 'bridge_comparison'
)"""
    q["strategy_examples"] = f"WITH {strat} " + " UNION ALL ".join(
        f"SELECT '{s}' AS form, id, {s} AS prompt, target, target AS answer, {_counts(s, 'target')} FROM strat"
        for s in ("self_ask", "direct", "squad")
    )
    few = f"{EX}, {_pool('pool', 'self_ask_shot')}, chosen AS ({_per_row('pool')})"
    fewp = f"{_block('texts')} || self_ask_prompt"
    q["few_shot_prompts"] = (
        f"WITH {few} SELECT id, {fewp} AS prompt, {_tok(fewp)}::INT AS num_prompt_tokens FROM ex JOIN chosen USING (id)"
    )
    digit = "('0x' || substring(md5('42:' || id || ':{}'), 1, 15))::BIGINT"
    cot_few = (
        f"{EX}, {_pool('pool', 'chain_of_thought_shot')}, "
        "placed AS (SELECT text, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS place FROM pool_all), "
        f"d AS (SELECT id, {digit.format(0)} % size AS a, {digit.format(1)} % (size - 1) AS b FROM ex, (SELECT count(*) AS size FROM placed)), "
        "chosen AS (SELECT d.id, [p.text, q.text] AS texts FROM d JOIN placed p ON p.place = a JOIN placed q ON q.place = b + (b >= a)::INT)"
    )
    cotp = f"{_block('texts')} || chain_of_thought_prompt"
    q["few_shot_per_row"] = (
        f"WITH {cot_few} SELECT id, {cotp} AS prompt, {_tok(cotp)}::INT AS num_prompt_tokens FROM ex JOIN chosen USING (id)"
    )
    q["joined_few_shot"] = (
        f"WITH {celeb}, four AS (SELECT string_agg(text, {NL} ORDER BY h) AS shots FROM (SELECT head || ' ' || target AS text, "
        f"md5('42:' || id) AS h FROM celeb ORDER BY h LIMIT 4)) "
        f"SELECT id, shots || {NL} || head || {NL} AS prompt, target FROM celeb, four"
    )
    shuffled = EX + """,
mixed AS (
  SELECT id, question, list_transform(list_sort(list_transform(range(1, len(facts) + 1),
         lambda i: {'k': md5('42:' || id || ':' || (i - 1)), 'f': facts[i]})), lambda s: s.f) AS mixed FROM ex
)"""
    q["random_fact_order"] = (
        f"WITH {shuffled} SELECT id, {_facts(1, 'mixed')} || {NL} || 'Question: ' || question || {NL} || 'Answer:' AS prompt FROM mixed"
    )
    q["facts_blocks"] = f"WITH {EX} SELECT id, fb1 AS one_based, fb0 AS zero_based, 'context: ' || ctx AS context FROM ex"
    q["sub_questions"] = (
        f"WITH {QA}, w AS (SELECT *, unnest(range(1, len(obj) + 1)) AS i FROM qa, enl WHERE NOT bad), "
        "h AS (SELECT *, unnest(range(1, len(facts) + 1)) AS i FROM qa, enl WHERE NOT bad) "
        f"SELECT 'wiki' AS source, id, (i - 1)::INT AS step, ({_word('obj[i]')}) || ' is the ' || rel[i] || ' of ' || subj[i] || '?' AS question, obj[i] AS answer FROM w "
        f"UNION ALL SELECT 'hotpot', id, (i - 1)::INT, ({_word('titles[i]')}) || ' is ' || titles[i] || '?', facts[i] FROM h"
    )
    q["thoughts"] = f"WITH {QA} SELECT id, " + _join(
        f"list_transform(range(1, len(obj) + 1), lambda i: {_THOUGHT})", "'; '") + " AS thoughts FROM qa"
    q["token_counts"] = f"WITH {_turns()} SELECT id, {_counts('prompt', 'target')} FROM turns"
    q["qa_pairs"] = (
        f"WITH {EX} SELECT id, direct_prompt AS prompt, answer AS target, answer, direct_prompt || answer AS input FROM ex"
    )

    # wide tables: exemplars keep their draw order here
    def fixed(name: str) -> str:
        return f"{name}_t AS (SELECT list(text ORDER BY md5('42:' || id)) AS {name}_texts FROM {name})"

    wide_from = (
        f"{EX}, {_pool('sa', 'self_ask_shot')}, {_pool('ct', 'chain_of_thought_shot')}, {fixed('sa')}, {fixed('ct')}, "
        f"v AS (SELECT *, {_block('sa_texts')} AS sab, {_block('ct_texts')} AS ctb FROM ex, sa_t, ct_t)"
    )
    prompts = {
        "direct_prompt": ("direct", "direct_prompt"),
        "squad_prompt_with_examplars": ("squad", "sab || squad_prompt"),
        "squad_prompt": ("squad", "squad_prompt"),
        "self_ask_prompt_with_examplars": ("self_ask", "sab || self_ask_prompt"),
        "self_ask_prompt_without_examplars": ("self_ask", "self_ask_prompt"),
        "chain_of_thought_prompt_with_examplars": ("chain_of_thought", "ctb || chain_of_thought_prompt"),
        "chain_of_thought_prompt_without_examplars": ("chain_of_thought", "chain_of_thought_prompt"),
    }
    cols = [f"{e} AS {n}" for n, (_, e) in prompts.items()]
    cols += ["self_ask_target AS self_ask_answer", "answer", "chain_of_thought_target AS chain_of_thought_answer",
             "type", "hops::INT AS hops", "relationships"]
    cols += [f"{_tok(f'{s}_target')}::INT AS {s}_target_tokens" for s in ("direct", "squad", "self_ask", "chain_of_thought")]
    cols += [f"{_tok(e)}::INT AS {n}_tokens" for n, (_, e) in prompts.items()]
    cols += [f"({_tok(e)} + {_tok(s + '_target')})::INT AS {n.replace('_prompt', '')}_total_tokens" for n, (s, e) in prompts.items()]
    q["evaluation_wide"] = f"WITH {wide_from} SELECT id, {', '.join(cols)} FROM v"
    sp = {
        "direct_prompt": "direct",
        "self_ask_prompt_with_examplars": "sab || self_ask",
        "self_ask_prompt_without_examplars": "self_ask",
    }
    cols = [f"{e} AS {n}" for n, e in sp.items()] + ["target AS self_ask_answer", "target AS answer"]
    cols += [f"{_tok('target')}::INT AS {s}_target_tokens" for s in ("direct", "self_ask")]
    cols += [f"{_tok(e)}::INT AS {n}_tokens" for n, e in sp.items()]
    cols += [f"({_tok(e)} + {_tok('target')})::INT AS {n.replace('_prompt', '')}_total_tokens" for n, e in sp.items()]
    q["strategy_wide"] = (
        f"WITH {strat}, {_pool('sa', 'self_ask_shot')}, {fixed('sa')}, v AS (SELECT *, {_block('sa_texts')} AS sab FROM strat, sa_t) "
        f"SELECT id, {', '.join(cols)} FROM v"
    )
    q["parse_instances"] = (
        f"WITH {CUST} SELECT 'c' || k AS id, array_to_string([c_name || ' belongs to ' || n_name, ' ' || n_name || ' lies in ' || r_name, "
        f"c_name || ' is a customer'], '|') AS evidences, ' Which region does ' || c_name || ' trade in? ' AS question, r_name AS answer FROM cust"
    )
    q["prompt_sections"] = (
        f"WITH {few} SELECT id, rtrim(fb1, {NL}) AS facts_part, 'Question: ' || question || {NL} || '{REASON}' AS question_part, "
        f"{_tok(_block('texts'))}::INT AS examples_tokens, {_tok('fb1')}::INT AS facts_tokens, "
        + _tok(f"'Question: ' || question || {NL} || '{REASON}'") + "::INT AS question_tokens FROM ex JOIN chosen USING (id)"
    )

    # filters
    dpt = _tok("direct_prompt")
    q["token_filter"] = f"WITH {EX} SELECT id, {dpt}::INT AS num_prompt_tokens FROM ex WHERE {dpt} <= 60"
    q["document_token_filter"] = (
        f"SELECT doc_id, source, {_tok('text')}::INT AS num_prompt_tokens FROM documents WHERE {_tok('text')} <= 130"
    )
    present = "contains(lower(direct_prompt), lower(answer)) OR answer IN ('yes', 'no')"
    q["verify_answer"] = f"WITH {EX} SELECT id, answer AS found_answer, ({present}) AS kept FROM ex"
    told = "lower(trim(regexp_extract(self_ask_target, 'answer is\\s*([^.]+)[.]', 1)))"
    q["verify_answer_strict"] = (
        f"WITH {EX} SELECT id, {told} AS found_answer, (contains(lower(self_ask_prompt), {told}) OR {told} IN ('yes', 'no')) AS kept FROM ex"
    )
    q["allow_list_filter"] = (
        f"WITH {EX} SELECT id, self_ask_prompt AS prompt, self_ask_target AS target FROM ex WHERE {dpt} <= 60 AND ({present})"
    )
    q["merged_ids"] = f"WITH {EX} SELECT id FROM ex WHERE {dpt} <= 60 UNION SELECT id FROM ex WHERE {present}"
    q["dedup_prompts"] = (
        f"WITH {EX} SELECT id, row_number() OVER (PARTITION BY direct_prompt ORDER BY pos) = 1 AS kept FROM ex"
    )
    q["dedup_documents"] = (
        "SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
    )
    flags = {n: f"regexp_matches(text, '{p}')" for n, p in _DATES.items()}
    q["date_category"] = (
        "SELECT doc_id, " + ", ".join(f"{e} AS has_{n}" for n, e in flags.items())
        + ", (" + " OR ".join(flags.values()) + ") AS any_date FROM documents"
    )
    q["bad_fact_rejects"] = f"WITH {QA} SELECT id, type, 1 AS bad_ref FROM qa WHERE bad"
    q["facts_from_corpus"] = f"WITH {QA} SELECT id, array_to_string(facts, '|') AS facts FROM qa WHERE NOT bad"
    q["extract_answers"] = (
        f"WITH {RESP} SELECT run_id, id, "
        "CASE WHEN regexp_matches(target, 'answer is\\s*([^.]+)[.]') THEN trim(regexp_extract(target, 'answer is\\s*([^.]+)[.]', 1)) ELSE target END AS from_target, "
        "model_answer AS from_response, CASE WHEN regexp_matches(response, '.*answer is (.*)[.].*') THEN model_answer ELSE trim(response) END AS with_fallback FROM judged"
    )
    q["self_ask_flag"] = f"WITH {RESP} SELECT run_id, id, self_ask FROM judged"
    q["correctness"] = f"WITH {RESP} SELECT run_id, id, model_answer, correct FROM judged"
    q["coverage_under_limit"] = (
        f"WITH {EX}, c AS (SELECT type, {_tok('self_ask_prompt')} + {_tok('self_ask_target')} AS t FROM ex) "
        "SELECT type, count(*) AS rows, round(avg((t < 130)::INT), 6) AS share_under FROM c GROUP BY type"
    )

    # scoring
    q["rouge_n"] = f"WITH {SCORED} SELECT run_id, id, {_rounds(METRICS)} FROM scored"
    q["macro_results"] = (
        f"WITH {STEMMED} SELECT run_id, round(avg(correct::INT), 4) AS accuracy, "
        + ", ".join(f"round(avg({m}), 4) AS {m}" for m in (*METRICS, "rouge_l")) + " FROM scored JOIN longest USING (run_id, id) GROUP BY run_id"
    )
    q["leaderboard"] = (
        f"WITH {MACRO} SELECT macro.*, model, strategy, answer_first, random_facts, examplars, "
        "row_number() OVER (PARTITION BY strategy ORDER BY accuracy DESC, run_id) = 1 AS is_best FROM macro JOIN runs USING (run_id)"
    )
    q["model_means"] = (
        f"WITH {MACRO} SELECT model, count(*) AS runs, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("accuracy", *METRICS))
        + " FROM macro JOIN runs USING (run_id) GROUP BY model"
    )
    q["evaluate_run"] = (
        f"WITH {RESP} SELECT run_id, count(*) AS answered, count(*) FILTER (correct) AS \"right\", count(*) FILTER (self_ask) AS self_asked FROM judged GROUP BY run_id"
    )
    q["resume_eval"] = f"WITH {RESP} SELECT run_id, id FROM resp WHERE n % 4 = 3"
    q["completeness"] = (
        f"WITH {RESP}, have AS (SELECT run_id, CASE WHEN n = 0 AND type = 'inference' THEN 'unknown' ELSE id END AS id FROM resp WHERE n % 4 <> 3), "
        "h AS (SELECT run_id, id, count(*) AS c FROM have GROUP BY ALL), "
        "b AS (SELECT coalesce(r.run_id, h.run_id) AS run_id, r.id AS want, h.c AS c FROM resp r FULL JOIN h ON r.run_id = h.run_id AND r.id = h.id) "
        "SELECT run_id, count(want) AS expected, count(c) AS answered, count(*) FILTER (c IS NULL) AS missing, "
        "count(*) FILTER (want IS NULL) AS unknown, count(*) FILTER (c > 1) AS repeated, false AS complete FROM b GROUP BY run_id"
    )
    q["generated_stub"] = f"WITH {EX} SELECT id, upper('Question: ' || question) AS response FROM ex"
    q["normalized_targets"] = (
        f"WITH {EX} SELECT id, answer, trim(regexp_replace(self_ask_target, '\\s+', ' ', 'g')) AS target FROM ex"
    )
    q["progress_counts"] = (
        f"WITH {RESP} SELECT run_id, count(*) AS expected, count(*) FILTER (n % 4 < 2) AS responses, "
        "count(answer) FILTER (n % 4 < 2 AND n % 8 <> 1) AS answers, count(target) FILTER (n % 4 < 2 AND n % 8 <> 1) AS targets, "
        "count(*) FILTER (n % 4 >= 2) AS missing, count(*) FILTER (n % 8 = 1) AS unaligned FROM resp GROUP BY run_id"
    )
    q["stream_scores"] = f"WITH {SCORED} SELECT run_id, id, correct, self_ask, {_rounds(METRICS)} FROM scored"

    # analysis
    parts = []
    for s in ("self_ask", "direct"):
        p, t = _tok(f"{s}_prompt"), _tok(f"{s}_target")
        parts.append(f"SELECT '{s}' AS strategy, 'num_prompt_tokens' AS c, {p} AS v FROM ex UNION ALL "
                     f"SELECT '{s}', 'num_target_tokens', {t} FROM ex UNION ALL SELECT '{s}', 'num_tokens', {p} + {t} FROM ex")
    q["token_stats"] = (
        f"WITH {EX}, l AS ({' UNION ALL '.join(parts)}) SELECT strategy, c AS \"column\", {_stats('v')} FROM l GROUP BY strategy, c"
    )
    q["document_token_stats"] = (
        f"WITH l AS (SELECT lang, {_tok('text')} AS v FROM documents) SELECT lang, 'num_tokens' AS \"column\", {_stats('v')} FROM l GROUP BY lang"
    )
    q["stage_counts"] = (
        f"WITH {EX}, s AS (SELECT type, {dpt} <= 60 AS short, ({present}) AS ok FROM ex) "
        "SELECT type, count(*) AS built, count(*) FILTER (short) AS short_enough, count(*) FILTER (short AND ok) AS verified, "
        "count(*) FILTER (NOT short) AS dropped_long, count(*) FILTER (short AND NOT ok) AS dropped_unverified FROM s GROUP BY type"
    )
    size = "num_prompt_tokens::DOUBLE"
    q["context_corr"] = (
        f"WITH {SCORED} SELECT run_id, {_corr(size, 'correct::INT::DOUBLE')} AS correct, "
        + ", ".join(f"{_corr(size, m)} AS {m}" for m in METRICS) + " FROM scored GROUP BY run_id"
    )
    q["run_corr"] = f"WITH {RESP}, {_wide()} " + " UNION ALL ".join(
        f"SELECT '{names[i]}' AS run_a, '{names[j]}' AS run_b, "
        f"{_corr(f'run_{i}::INT::DOUBLE', f'run_{j}::INT::DOUBLE')} AS corr FROM wide" for i, j in _run_pairs(True)
    )
    q["conditional_agreement"] = (
        f"WITH {RESP}, c AS (SELECT a.run_id AS run_a, b.run_id AS run_b, a.correct AS a_correct, b.correct AS b_correct, count(*) AS questions "
        "FROM judged a JOIN judged b ON a.id = b.id AND a.run_id <> b.run_id GROUP BY ALL) "
        "SELECT *, round(questions / sum(questions) OVER (PARTITION BY run_a, run_b, a_correct), 6) AS share FROM c"
    )
    q["runs_wide"] = f"WITH {RESP}, {_wide()} SELECT * FROM wide"
    by_type = (
        "bt AS (SELECT run_id, type, count(*) FILTER (NOT correct) AS wrong, count(*) FILTER (correct) AS \"right\", count(*) AS total "
        "FROM judged GROUP BY run_id, type)"
    )
    q["accuracy_by_type"] = (
        f"WITH {RESP}, {by_type} SELECT *, round(wrong / total, 6) AS share_wrong, round(\"right\" / total, 6) AS share_right FROM bt"
    )
    q["type_accuracy_corr"] = (
        f"WITH {RESP}, {by_type} SELECT a.run_id AS run_a, b.run_id AS run_b, "
        f"{_corr('a.right / a.total', 'b.right / b.total')} AS corr FROM bt a JOIN bt b ON a.type = b.type AND a.run_id < b.run_id GROUP BY ALL"
    )
    q["self_ask_rate"] = f"WITH {RESP} SELECT run_id, round(avg(self_ask::INT), 6) AS self_ask_rate FROM judged GROUP BY run_id"
    q["value_counts"] = (
        f"WITH {QA}, l AS (SELECT type, CASE n % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS level FROM qa) "
        + " UNION ALL ".join(
            f"SELECT {c} AS value, count(*) AS occurrences, round(count(*) / (SELECT count(*) FROM l), 6) AS share, '{c}' AS \"column\" FROM l GROUP BY {c}"
            for c in ("type", "level")
        )
    )
    q["label_counts"] = (
        "SELECT quality, count(*) FILTER (toxic = 0) AS not_toxic, count(*) FILTER (toxic = 1) AS toxic FROM labels GROUP BY quality"
    )
    q["relation_freq"] = (
        f"WITH {QA} SELECT relation, count(*) AS occurrences FROM (SELECT unnest(rel) AS relation FROM qa) GROUP BY relation"
    )
    q["first_per_relation"] = (
        f"WITH {QA}, e AS (SELECT pos, unnest(range(1, len(rel) + 1)) AS i, rel, subj, obj FROM qa) "
        "SELECT rel[i] AS relation, subj[i] AS subject, obj[i] AS object FROM e QUALIFY row_number() OVER (PARTITION BY rel[i] ORDER BY pos, i) = 1"
    )
    q["context_hist"] = (
        f"WITH {RESP}, b AS (SELECT run_id, correct, min(num_prompt_tokens)::DOUBLE AS lo, max(num_prompt_tokens)::DOUBLE AS hi, avg(num_prompt_tokens) AS mean_size FROM judged GROUP BY ALL) "
        "SELECT run_id, correct, (CASE WHEN lo = hi THEN 1 ELSE least(20, floor((num_prompt_tokens - lo) / ((hi - lo) / 20)) + 1) END)::INT AS bin, count(*) AS rows, "
        "any_value(lo) AS lo, any_value(hi) AS hi, round(any_value(mean_size), 6) AS mean_size FROM judged JOIN b USING (run_id, correct) GROUP BY 1, 2, 3"
    )
    q["compositionality_gap"] = (
        f"WITH {RESP}, subs AS (SELECT id, unnest(obj) AS step FROM qa WHERE NOT bad), "
        "s AS (SELECT run_id, id, bool_and(contains(response, step)) AS subs_ok, any_value(correct) AS main_ok FROM judged JOIN subs USING (id) GROUP BY run_id, id) "
        "SELECT run_id, count(*) AS questions, count(*) FILTER (subs_ok) AS subs_right, count(*) FILTER (subs_ok AND NOT main_ok) AS composed_wrong, "
        "CASE WHEN count(*) FILTER (subs_ok) > 0 THEN round(count(*) FILTER (subs_ok AND NOT main_ok) / count(*) FILTER (subs_ok), 6) END AS gap FROM s GROUP BY run_id"
    )
    q["aligned_scores"] = (
        f"WITH {RESP} SELECT run_id, type, count(*) AS rows, count(*) FILTER (correct) AS \"right\", count(*) FILTER (self_ask) AS self_asked FROM judged GROUP BY run_id, type"
    )
    keyed = f"{SCORED}, r AS (SELECT run_id || '/' || id AS key, round(f1_2, 9) AS f FROM scored)"
    q["top_bottom_random"] = (
        f"WITH {keyed}, t AS (SELECT 'top' AS section, (row_number() OVER (ORDER BY f DESC, key))::INT AS rank, key, f FROM r), "
        "b AS (SELECT 'bottom' AS section, (6 - row_number() OVER (ORDER BY f, key DESC))::INT AS rank, key, f FROM r), "
        "c AS (SELECT 'random' AS section, (row_number() OVER (ORDER BY md5('0:' || key), key))::INT AS rank, key, f FROM r) "
        "SELECT section, rank, key, round(f, 6) AS f1_2 FROM (SELECT * FROM t WHERE rank <= 5 UNION ALL SELECT * FROM b WHERE rank >= 1 UNION ALL SELECT * FROM c WHERE rank <= 5)"
    )
    q["nth_ranked"] = (
        f"WITH {keyed}, o AS (SELECT *, row_number() OVER (ORDER BY f DESC, key) AS rn, count(*) OVER () AS total FROM r) "
        "SELECT CASE WHEN rn = 16 THEN 15 ELSE -1 END AS k, key, round(f, 6) AS f1_2 FROM o WHERE rn = 16 OR rn = total"
    )

    q["middle_ranked"] = (
        "WITH o AS (SELECT event_id, value::DOUBLE AS value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) - 1 AS up, count(*) OVER () AS total FROM events), "
        "p(place) AS (VALUES (500), (1000), (4321), (-2000)) "
        "SELECT place::INT AS place, event_id, value FROM o JOIN p ON up = CASE WHEN place < 0 THEN total + place ELSE place END"
    )
    q["digest_batches"] = (
        "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS row_index FROM documents) "
        "SELECT doc_id, row_index, (row_index // 64)::BIGINT AS batch_id FROM o WHERE row_index >= 128"
    )
    # The subsequence of the few reported rows grows word by word of the response: a row of the comparison table per step.
    score_text = " || ', ' || ".join(f"'{label}: ' || round({c}, 5)::VARCHAR" for c, label in schemas.METRICS.items())
    q["sample_report"] = (
        f"WITH RECURSIVE {SCORED}, r AS (SELECT s.*, round(s.f1_2, 9) AS f, self_ask_prompt FROM scored s JOIN ex USING (id)), "
        "t AS (SELECT 0 AS section_no, 'top' AS section, row_number() OVER (PARTITION BY run_id ORDER BY f DESC, id) AS rank, * FROM r), "
        "b AS (SELECT 1 AS section_no, 'bottom' AS section, 6 - row_number() OVER (PARTITION BY run_id ORDER BY f, id DESC) AS rank, * FROM r), "
        "c AS (SELECT 2 AS section_no, 'random' AS section, row_number() OVER (PARTITION BY run_id ORDER BY md5('0:' || id), id) AS rank, * FROM r), "
        "chosen AS MATERIALIZED (SELECT * FROM t WHERE rank <= 5 UNION ALL SELECT * FROM b WHERE rank >= 1 UNION ALL SELECT * FROM c WHERE rank <= 5), "
        f"sides_of AS MATERIALIZED (SELECT run_id, id, {_grams('tw', 'target')}, {_grams('rw', 'response')} FROM chosen WHERE section = 'random'), "
        "steps_of AS (SELECT run_id, id, 0 AS step, tw, rw, list_transform(range(len(tw) + 1), lambda j: 0) AS best FROM sides_of UNION ALL "
        "SELECT run_id, id, step + 1, tw, rw, list_transform(range(len(tw) + 1), lambda j: "
        "list_max(list_transform(range(j + 1), lambda k: CASE WHEN k = 0 THEN 0 WHEN tw[k] = rw[step + 1] THEN greatest(best[k + 1], best[k] + 1) ELSE best[k + 1] END))) "
        "FROM steps_of WHERE step < len(rw)), "
        "lcs_of AS (SELECT run_id, id, CASE WHEN len(tw) = 0 THEN 0.0 ELSE best[len(tw) + 1]::DOUBLE / len(tw) END AS rouge_l FROM steps_of WHERE step = len(rw)), "
        "z AS (SELECT chosen.*, rouge_l FROM chosen LEFT JOIN lcs_of USING (run_id, id)) "
        f"SELECT run_id, section_no, section, rank::INT AS rank, CASE WHEN section = 'top' AND rank = 1 THEN '# sample' || {NL} ELSE '' END "
        f"|| CASE WHEN rank = 1 THEN '## ' || CASE section WHEN 'top' THEN 'Top' WHEN 'bottom' THEN 'Bottom' ELSE 'Random' END || ' Five Examples' || {NL} ELSE '' END "
        f"|| '### Example ' || (pos + 1) || {NL} || 'Prompt:' || {NL} || '```' || {NL} || self_ask_prompt || '```' || {NL} || 'Target:' || {NL} || '```' || {NL} || target "
        f"|| '```' || {NL} || 'Response:' || {NL} || '```' || {NL} || response || {NL} || '```' || {NL} || CASE WHEN section = 'random' THEN {score_text} ELSE '' END AS text FROM z"
    )

    # splits and batches
    q["train_dev_split"] = (
        f"WITH {QA}, d AS ({_draw('qa', 1256, 42)}) SELECT id, CASE WHEN drawn THEN 'dev' ELSE 'train' END AS split FROM d"
    )
    q["exemplar_holdout"] = (
        f"WITH {QA}, d AS ({_draw('qa', 1256, 42)}), t AS (SELECT * EXCLUDE (drawn) FROM d WHERE NOT drawn), e AS ({_draw('t', 50, 43)}), "
        "p AS (SELECT id, type, 'dev' AS part FROM d WHERE drawn UNION ALL SELECT id, type, CASE WHEN drawn THEN 'exemplars' ELSE 'train' END FROM e) "
        "SELECT type, count(*) AS rows, min(id) AS first_id, part FROM p GROUP BY type, part"
    )
    indexed = f"{QA}, i AS (SELECT id, row_number() OVER (ORDER BY pos) - 1 AS row_index, count(*) OVER () AS total FROM qa)"
    q["chunks"] = (
        f"WITH {indexed} SELECT id, row_index, (row_index // (total // 15) + 1)::INT AS chunk FROM i WHERE row_index // (total // 15) + 1 <= total // (total // 15)"
    )
    q["batches"] = (
        f"WITH {indexed} SELECT id, row_index // 512 AS batch_id FROM i WHERE row_index // 512 >= 3 AND row_index // 512 < total // 512"
    )
    q["head_rows"] = f"WITH {QA} SELECT id, question FROM qa ORDER BY pos LIMIT 100"

    def ids(col: str) -> str:
        return (
            rf"list_transform(regexp_extract_all({col}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'), "
            "lambda t: ('0x' || substring(md5(t), 1, 7))::BIGINT % 31998 + 2)"
        )

    q["packed_inputs"] = (
        f"WITH {_turns()}, l AS (SELECT id, {ids('prompt')}[1:512] AS p, {ids('target')}[1:512] AS t FROM turns), "
        "f AS (SELECT id, p, list_concat(p, list_transform(range(512 - len(p)), lambda x: 0)) AS pp, "
        "list_concat(t, list_transform(range(512 - len(t)), lambda x: 0)) AS tt FROM l) "
        "SELECT id, array_to_string(pp, ' ') AS input_ids, "
        "array_to_string(list_transform(range(512), lambda x: CASE WHEN x < len(p) THEN 1 ELSE 0 END), ' ') AS attention_mask, "
        "array_to_string(tt, ' ') AS labels, array_to_string(list_concat([0], tt[1:511]), ' ') AS decoder_input_ids FROM f"
    )

    # overlap
    q["exact_overlap"] = (
        f"WITH {QA}, {_sentences('ds', 'documents')}, {_sentences('bs', 'benchmark')} "
        "SELECT count(DISTINCT answer) AS shared, 'answers' AS what FROM qa WHERE answer IN (SELECT r_name FROM cust) "
        "UNION ALL SELECT count(DISTINCT question), 'questions' FROM qa WHERE question IN (SELECT 'Which region does the nation of ' || c_name || ' lie in?' FROM cust) "
        "UNION ALL SELECT count(*), 'sentences' FROM ds JOIN bs USING (s)"
    )
    q["shared_answer_pairs"] = (
        f"WITH {QA}, a AS (SELECT answer, arg_min(question, pos) AS question_a FROM qa GROUP BY answer), "
        "b AS (SELECT r_name AS answer, arg_min('Which region does the nation of ' || c_name || ' lie in?', 'c' || k) AS question_b FROM cust GROUP BY r_name) "
        "SELECT answer, question_a, question_b FROM a JOIN b USING (answer) ORDER BY answer LIMIT 11"
    )

    # grids and builds
    flags_sql = (
        "flags AS (SELECT * FROM (VALUES ('direct'), ('self_ask'), ('chain_of_thought')) s(strategy), "
        "(VALUES (false, false), (true, false), (false, true)) f(answer_first, random_facts))"
    )

    def title(c: str) -> str:
        return f"CASE WHEN {c} THEN 'True' ELSE 'False' END"

    def shots(c: str) -> str:
        return f"CASE WHEN {c} THEN '-with-examplars' ELSE '-without-examplars' END"

    q["experiment_grid"] = (
        f"WITH {QA}, {flags_sql}, t AS (SELECT type, count(*) AS questions FROM qa GROUP BY type) "
        "SELECT model, strategy, answer_first, random_facts, examplars, "
        f"model || '-' || strategy || '-answer_first=' || {title('answer_first')} || '-random_facts=' || {title('random_facts')} || {shots('examplars')} AS run_id, "
        "type, questions FROM (VALUES ('t5-small'), ('flan-t5-small'), ('opt-125m')) m(model), flags, (VALUES (true), (false)) e(examplars), t"
    )
    set_of = (
        "CASE WHEN strategy = 'direct' AND {0} THEN 'self_ask' ELSE strategy END || '-answer_first=False-random_facts=False' || "
    )
    q["cross_evaluation"] = (
        f"WITH {EX}, {RUNS}, e AS (SELECT DISTINCT strategy, examplars AS eval_examplars FROM runs), "
        f"x AS (SELECT run_id, run_no, examplars = eval_examplars AS own, {set_of.format('eval_examplars')}{shots('eval_examplars')} AS test_set, "
        "CASE WHEN strategy = 'direct' AND eval_examplars THEN 'self_ask' ELSE strategy END AS s FROM runs JOIN e USING (strategy)), "
        "a AS (SELECT x.*, n, answer, CASE s WHEN 'direct' THEN direct_target WHEN 'self_ask' THEN self_ask_target ELSE chain_of_thought_target END AS target FROM ex, x), "
        f"l AS (SELECT *, trim(replace(target, {NL}, ' ')) AS line FROM a), "
        "r AS (SELECT *, CASE WHEN own AND (n * 7 + run_no * 3) % 10 <= run_no THEN line WHEN NOT own AND (n * 3 + run_no * 7 + 4) % 10 < run_no THEN line "
        "WHEN n % 5 = 1 THEN answer WHEN n % 5 = 2 THEN replace(line, answer, 'unknown') ELSE '' END AS response FROM l) "
        "SELECT run_id, test_set, run_id || CASE WHEN any_value(own) THEN '-results' ELSE '-results-on-' || test_set END AS results_name, count(*) AS questions, "
        "round(avg(contains(lower(regexp_extract(response, '.*answer is (.*)[.].*', 1)), lower(answer))::INT), 4) AS accuracy FROM r GROUP BY run_id, test_set"
    )

    # all texts of the grid: flags x (plain or shuffled facts)
    grid_texts = shuffled + f""",
allowed AS (SELECT id FROM ex WHERE {dpt} <= 60 AND ({present})),
fb AS (SELECT ex.*, {_facts(1, 'mixed')} AS fbr FROM ex JOIN mixed USING (id)),
cells AS (
  SELECT id, question, strategy, answer_first, random_facts,
    CASE WHEN random_facts THEN fbr ELSE fb1 END || {NL} || 'Question: ' || question || {NL} ||
      CASE WHEN strategy = 'self_ask' THEN CASE WHEN answer_first THEN '{ANSWER}' ELSE '{REASON}' END || {NL} ELSE 'Answer:' END AS base,
    CASE strategy WHEN 'direct' THEN answer
      WHEN 'self_ask' THEN CASE WHEN answer_first THEN self_ask_first_target ELSE self_ask_target END
      ELSE CASE WHEN answer_first THEN chain_of_thought_first_target ELSE chain_of_thought_target END END AS target
  FROM fb, flags WHERE NOT (strategy = 'direct' AND answer_first)
)"""
    grid_texts = flags_sql + ", " + grid_texts

    def shot_pool(source: str) -> str:
        """k = 2 of the pool for each (strategy, answer_first)."""
        return (
            f"shotrows AS (SELECT id, strategy, answer_first, CASE strategy WHEN 'self_ask' THEN CASE WHEN answer_first THEN self_ask_first_shot ELSE self_ask_shot END "
            f"ELSE CASE WHEN answer_first THEN chain_of_thought_first_shot ELSE chain_of_thought_shot END END AS text "
            f"FROM {source}, (VALUES ('self_ask'), ('chain_of_thought')) s(strategy), (VALUES (true), (false)) f(answer_first)), "
            "two AS (SELECT * FROM shotrows QUALIFY row_number() OVER (PARTITION BY strategy, answer_first ORDER BY md5('42:' || id)) <= 2)"
        )

    def few_of(cells: str) -> str:
        return (
            f"SELECT c.id, c.strategy, c.answer_first, c.random_facts, any_value(c.target) AS target, any_value(c.base) AS base, "
            f"list(t.text ORDER BY md5('42:' || c.id || ':' || t.id)) AS texts FROM {cells} c JOIN two t USING (strategy, answer_first) GROUP BY ALL"
        )

    q["test_build"] = (
        f"WITH {grid_texts}, shotsrc AS (SELECT * FROM ex ORDER BY md5('43:' || id) LIMIT 20), {shot_pool('shotsrc')}, "
        "kept AS (SELECT * FROM cells WHERE id IN (SELECT id FROM allowed)), "
        f"few AS ({few_of('kept')}), "
        "every AS (SELECT id, strategy, answer_first, random_facts, false AS examplars, base AS prompt, target FROM kept "
        f"UNION ALL SELECT id, strategy, answer_first, random_facts, true, {_block('texts')} || base, target FROM few) "
        f"SELECT id, strategy, answer_first, random_facts, examplars, md5(prompt) AS prompt_md5, md5(target) AS target_md5, ({_tok('prompt')} + {_tok('target')})::INT AS num_tokens FROM every"
    )
    q["finetuning_build"] = (
        f"WITH {grid_texts}, d AS ({_draw('ex', 1256, 42)}), tr AS (SELECT * EXCLUDE (drawn) FROM d WHERE NOT drawn), sh AS ({_draw('tr', 20, 43)}), "
        f"shotsrc AS (SELECT * FROM sh WHERE drawn), {shot_pool('shotsrc')}, "
        "kept AS (SELECT c.*, d.drawn AS is_dev, c.id IN (SELECT id FROM shotsrc) AS is_shot FROM cells c JOIN d USING (id) WHERE c.id IN (SELECT id FROM allowed)), "
        "prompted AS (SELECT * FROM kept WHERE strategy <> 'direct' AND NOT is_shot), "
        f"few AS ({few_of('prompted')}), "
        "every AS (SELECT CASE WHEN is_dev THEN 'dev' ELSE 'train' END AS split, strategy, answer_first, random_facts, false AS examplars, base AS prompt, target FROM kept WHERE strategy = 'direct' "
        f"UNION ALL SELECT CASE WHEN d.drawn THEN 'dev' ELSE 'train' END, few.strategy, few.answer_first, few.random_facts, true, {_block('texts')} || base, target FROM few JOIN d USING (id)) "
        f"SELECT split, strategy, answer_first, random_facts, examplars, count(*) AS rows, sum({_tok('target')})::BIGINT AS target_tokens, sum({_tok('prompt')})::BIGINT AS prompt_tokens "
        "FROM every GROUP BY ALL"
    )

    # attention and robustness
    q["attention_top_words"] = (
        f"WITH {_att()}, s AS (SELECT id, layer, head, in_pos, sum(weight) AS w FROM att GROUP BY ALL), "
        "e AS (SELECT *, exp(w - max(w) OVER (PARTITION BY id, layer, head)) AS e FROM s), "
        "m AS (SELECT id, layer, head, in_pos, e / sum(e) OVER (PARTITION BY id, layer, head) AS w FROM e), "
        "t AS (SELECT id, layer, head, in_pos // 3 + 1 AS word_no, string_agg(CASE WHEN in_pos % 3 = 0 THEN '▁w' || in_pos ELSE 's' || in_pos END, '' ORDER BY in_pos) AS word, round(sum(w), 9) AS w "
        "FROM m GROUP BY id, layer, head, in_pos // 3 + 1) "
        "SELECT id, layer, head, (row_number() OVER (PARTITION BY id, layer, head ORDER BY w DESC, word_no))::INT AS rank, word, round(w, 6) AS weight FROM t QUALIFY rank <= 5"
    )
    q["phrase_top_words"] = (
        f"WITH {_att()}, p AS (SELECT id // 10 AS id, layer, head, id % 10 AS out_pos, in_pos, weight FROM att), "
        "s AS (SELECT id, layer, head, in_pos, sum(weight) AS w FROM p WHERE out_pos BETWEEN 3 AND 5 AND id IN (SELECT id FROM p GROUP BY id HAVING max(out_pos) >= 5) GROUP BY ALL), "
        "e AS (SELECT *, exp(w - max(w) OVER (PARTITION BY id, layer, head)) AS e FROM s), "
        "m AS (SELECT id, layer, head, in_pos, e / sum(e) OVER (PARTITION BY id, layer, head) AS w FROM e), "
        "t AS (SELECT id, layer, head, in_pos // 3 + 1 AS word_no, string_agg(CASE WHEN in_pos % 3 = 0 THEN '▁w' || in_pos ELSE 's' || in_pos END, '' ORDER BY in_pos) AS word, round(sum(w), 9) AS w "
        "FROM m GROUP BY id, layer, head, in_pos // 3 + 1) "
        "SELECT id, layer, head, (row_number() OVER (PARTITION BY id, layer, head ORDER BY w DESC, word_no))::INT AS rank, word, round(w, 6) AS weight FROM t QUALIFY rank <= 5"
    )
    q["phrase_attention"] = (
        f"WITH {_att()} SELECT id, layer, head, out_pos, count(*) AS cells, round(sum(weight), 6) AS weight FROM att WHERE out_pos BETWEEN 3 AND 5 GROUP BY ALL"
    )
    q["head_slices"] = f"WITH {_att()} SELECT id, in_pos::INT AS in_pos, round(sum(weight), 6) AS weight FROM att WHERE layer = 0 AND head = 3 GROUP BY ALL"
    q["perturbed_prompts"] = (
        f"WITH {PERTURB} SELECT id, kind, question, array_to_string(facts, '|') AS facts FROM variants"
    )
    q["perturb_flip_rate"] = (
        f"WITH {PERTURB}, o AS (SELECT id, {_reader()} AS b FROM ex), v AS (SELECT id, kind, {_reader()} AS c FROM variants) "
        "SELECT kind, count(*) AS rows, count(*) FILTER (b <> c) AS flipped, count(*) FILTER (b AND NOT c) AS lost, count(*) FILTER (c AND NOT b) AS gained, "
        "round(avg((b <> c)::INT), 6) AS flip_rate FROM v JOIN o USING (id) GROUP BY kind"
    )
    return q
