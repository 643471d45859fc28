"""The same results in ANSI SQL, written without regard to how the DataFrame queries get them."""

from __future__ import annotations

import math

from textloom.plans.inputs import STOP_WORDS
from textloom.plans.queries import REPLICAS, VOCABULARY_SIZE


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


def _rouge_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"


def _strip(text: str) -> str:
    blank = r"[\s\x0b\p{Z}\x1c-\x1f\x{85}]+"
    return f"regexp_replace({text}, '^{blank}|{blank}$', '', 'g')"


VOCAB = f"""
words AS (SELECT doc_id, {_words('text')} AS w FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM words),
counted AS (SELECT token, count(*) AS n FROM tokens GROUP BY token),
vocab AS (
  SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id
  FROM counted ORDER BY n DESC, token LIMIT {VOCABULARY_SIZE})"""

ENCODED = f"""{VOCAB},
ids AS (
  SELECT t.doc_id, t.pos, coalesce(v.id, 1) AS id, v.token AS known
  FROM tokens t LEFT JOIN vocab v ON t.token = v.token)"""

PAIRS = """
pairs AS (
  SELECT u.conv_id * 4294967296 + u.turn AS key, u.text AS reference, a.text AS prediction
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

USER_TURNS = "turns AS (SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user')"

HISTORY = """
history AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         event_type AS metric, value AS loss
  FROM events)"""

SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'eval' ELSE 'test' END"

GAPS = """
gaps AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ''
                      WHEN doc_id % 13 = 0 THEN '   ' ELSE text END AS text
  FROM documents)"""

QUALITY = """
judged AS (
  SELECT l.quality AS label, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS prediction
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _language() -> str:
    def hits(lang: str) -> str:
        listed = ", ".join(f"'{w}'" for w in STOP_WORDS[lang])
        return f"len(list_filter(w, lambda x: x IN ({listed}))) AS {lang}"

    counted = ", ".join(hits(lang) for lang in STOP_WORDS)
    best = f"greatest({', '.join(STOP_WORDS)})"
    guess = " ".join(f"WHEN {lang} = {best} THEN '{lang}'" for lang in STOP_WORDS)
    return f"""
lower_words AS (SELECT lang AS label, {_words('lower(text)')} AS w FROM documents),
hits AS (SELECT label, {counted} FROM lower_words),
judged AS (SELECT label, CASE {guess} END AS prediction FROM hits)"""


CLASSES = """
classes AS (SELECT label AS class FROM judged UNION SELECT prediction FROM judged),
counts AS (
  SELECT c.class,
         (SELECT count(*) FROM judged j WHERE j.label = c.class AND j.prediction = c.class) AS tp,
         (SELECT count(*) FROM judged j WHERE j.prediction = c.class) AS predicted,
         (SELECT count(*) FROM judged j WHERE j.label = c.class) AS support
  FROM classes c),
ratios AS (
  SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS recall FROM counts),
scores AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
  FROM ratios)"""

SUMMARY = """
summary AS (
  SELECT CAST(sum(support) AS BIGINT) AS n_rows,
         round((SELECT avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM judged), 6) AS accuracy,
         round(sum(precision * support) / sum(support), 6) AS precision,
         round(sum(recall * support) / sum(support), 6) AS recall,
         round(sum(f1 * support) / sum(support), 6) AS f1
  FROM scores)"""


def _grams(words: str, n: int) -> str:
    """Rows (key, gram, n_grams) of one side of the pairs."""
    joined = " || chr(1) || ".join(f"w[i + {j}]" for j in range(n))
    return f"""
  SELECT key, gram, count(*) AS c
  FROM (SELECT key, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: {joined})) AS gram
        FROM (SELECT key, {words} AS w FROM pairs))
  GROUP BY key, gram"""


def _bleu() -> str:
    r, p = _words("reference"), _words("prediction")
    parts, sums = [], []
    for n in range(1, 5):
        parts.append(f"r{n} AS ({_grams(r, n)}), p{n} AS ({_grams(p, n)})")
        sums.append(
            f"""(SELECT CAST(coalesce(sum(least(p.c, r.c)), 0) AS BIGINT)
                 FROM p{n} p JOIN r{n} r ON p.key = r.key AND p.gram = r.gram) AS match_{n},
                (SELECT CAST(sum(c) AS BIGINT) FROM p{n}) AS total_{n}"""
        )
    logs = " + ".join(f"ln(CAST(match_{n} AS DOUBLE) / total_{n})" for n in range(1, 5))
    return f"""
{PAIRS.strip()}, {", ".join(parts)},
sums AS (
  SELECT (SELECT CAST(sum(len({p})) AS BIGINT) FROM pairs) AS prediction_length,
         (SELECT CAST(sum(len({r})) AS BIGINT) FROM pairs) AS reference_length, {", ".join(sums)}),
bleu_score AS (
  SELECT *, round(CASE WHEN least(match_1, match_2, match_3, match_4) = 0 THEN 0.0::DOUBLE
    ELSE CASE WHEN prediction_length > reference_length THEN 1.0::DOUBLE
              ELSE exp(1.0::DOUBLE - CAST(reference_length AS DOUBLE) / prediction_length) END
         * exp(({logs}) / 4.0::DOUBLE) END, 6) AS bleu FROM sums)"""


def _rouge_n() -> str:
    r, p = _rouge_words("reference"), _rouge_words("prediction")
    parts = []
    for n in (1, 2):
        parts.append(f"""
x{n} AS ({_grams(r, n)}), y{n} AS ({_grams(p, n)}),
f{n} AS (
  SELECT pairs.key,
         coalesce(2.0::DOUBLE * m.common
           / (greatest(len({r}) - {n - 1}, 0) + greatest(len({p}) - {n - 1}, 0)), 0.0::DOUBLE) AS f
  FROM pairs LEFT JOIN (
    SELECT x.key, sum(least(x.c, y.c)) AS common
    FROM x{n} x JOIN y{n} y ON x.key = y.key AND x.gram = y.gram GROUP BY x.key) m ON pairs.key = m.key)""")
    return ",".join(parts)


def _rouge_l() -> str:
    return f"""
split AS (SELECT key, {_rouge_words('reference')} AS r, {_rouge_words('prediction')} AS p FROM pairs),
steps(key, i, d) AS (
  SELECT key, CAST(0 AS BIGINT), list_transform(r, lambda x: CAST(0 AS BIGINT)) FROM split
  UNION ALL
  SELECT s.key, s.i + 1,
    list_transform(range(1, len(t.r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
      greatest(s.d[k], (CASE WHEN k > 1 THEN s.d[k - 1] ELSE 0 END)
                       + (CASE WHEN t.r[k] = t.p[s.i + 1] THEN 1 ELSE 0 END)))))
  FROM steps s JOIN split t ON s.key = t.key WHERE s.i < len(t.p)),
fl AS (
  SELECT s.key, CASE WHEN len(t.r) + len(t.p) = 0 OR len(t.r) = 0 THEN 0.0::DOUBLE
                     ELSE 2.0::DOUBLE * s.d[len(t.r)] / (len(t.r) + len(t.p)) END AS f
  FROM steps s JOIN split t ON s.key = t.key AND s.i = len(t.p))"""


def _poisson(u: str) -> str:
    total, steps = 0.0, []
    for k in range(18):
        total += math.exp(-1.0) / math.factorial(k)
        if total >= 1.0:
            break
        steps.append(f"(CASE WHEN {u} >= CAST('{total!r}' AS DOUBLE) THEN 1 ELSE 0 END)")
    return " + ".join(steps)


BIGRAMS = f"""
doc_words AS (SELECT {_words('text')} AS w FROM documents),
train AS (
  SELECT unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 THEN '<s>' ELSE w[i - 1] END)) AS prev,
         unnest(w) AS token FROM doc_words),
pair_counts AS (SELECT prev, token, count(*) AS n FROM train GROUP BY prev, token)"""

LM_SCORED = f"""{BIGRAMS},
contexts AS (SELECT prev, sum(n) AS n FROM pair_counts GROUP BY prev),
v AS (SELECT count(DISTINCT token) + 1 AS v FROM pair_counts),
eval_words AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
eval AS (
  SELECT item_id,
         unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 THEN '<s>' ELSE w[i - 1] END)) AS prev,
         unnest(w) AS token FROM eval_words),
scored AS (
  SELECT e.item_id, count(*) AS n_tokens,
         -avg(ln((coalesce(p.n, 0) + 0.1::DOUBLE) / (coalesce(c.n, 0) + 0.1::DOUBLE * v.v))) AS loss
  FROM eval e LEFT JOIN pair_counts p ON e.prev = p.prev AND e.token = p.token
  LEFT JOIN contexts c ON e.prev = c.prev CROSS JOIN v
  GROUP BY e.item_id)"""

REQUESTS = """
asked AS (SELECT event_id, event_id % 11 AS kind, event_type || ' ' || user_id AS asked,
          CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
requests AS (
  SELECT event_id, kind, CASE WHEN kind IN (2, 3, 4, 7, 8, 9, 10) THEN asked END AS prompt,
         CASE WHEN kind >= 7 THEN k ELSE CAST(50 AS INTEGER) END AS top_k,
         CASE kind WHEN 0 THEN 'body is not a JSON object' WHEN 1 THEN 'prompt is missing'
           WHEN 2 THEN 'top_k is not a whole number' WHEN 3 THEN 'top_k is not a whole number'
           WHEN 4 THEN 'temperature is not a number' WHEN 5 THEN 'prompt is not a text'
           WHEN 6 THEN 'body is not a JSON object' END AS request_error
  FROM asked)"""

WINDOWS = """
log AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, value AS latency,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed, ts FROM events),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY latency) AS nth,
         count(*) OVER (PARTITION BY window_start) AS n FROM log),
windows AS (
  SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, count(*) AS requests,
         CAST(sum(failed) AS BIGINT) AS errors, round(sum(failed) / CAST(count(*) AS DOUBLE), 6) AS error_rate,
         min(CASE WHEN nth = ceil(n * 0.5::DOUBLE) THEN latency END) AS p50,
         min(CASE WHEN nth = ceil(n * 0.95::DOUBLE) THEN latency END) AS p95,
         min(CASE WHEN nth = ceil(n * 0.99::DOUBLE) THEN latency END) AS p99
  FROM ordered GROUP BY window_start)"""


def _file_lines() -> str:
    return rf"""
lines AS (
  SELECT item_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS nth
  FROM (SELECT item_id, regexp_split_to_array(text, '\r\n|\r|\n') AS parts FROM benchmark)),
kept AS (SELECT item_id, nth, {_strip('line')} AS prompt FROM lines)"""


ORACLE: dict[str, str] = {
    "src_csv": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "src_jsonl": "SELECT conv_id, turn, role, text FROM conversations",
    "src_parquet": "SELECT * FROM documents",
    "src_table": "SELECT * FROM documents",
    "src_prompts": f"""WITH {_file_lines()}
        SELECT row_number() OVER (ORDER BY item_id, nth) - 1 AS prompt_idx, prompt FROM kept WHERE prompt <> ''""",
    "split_select": f"SELECT *, {SPLIT} AS split FROM documents WHERE {SPLIT} = 'train'",
    "split_union": """SELECT doc_id AS key, text, 'train' AS split FROM documents
        UNION ALL SELECT item_id, text, 'eval' FROM benchmark""",
    "sink_results": """SELECT conv_id * 4294967296 + turn AS prompt_idx, text AS prompt,
        're: ' || text || '|' || lower(text) AS generated_texts FROM conversations WHERE role = 'user'""",
    "params_long": """SELECT o_orderkey AS run, name, value FROM (
          SELECT o_orderkey, 'training.o_custkey' AS name, CAST(o_custkey AS VARCHAR) AS value FROM orders
          UNION ALL SELECT o_orderkey, 'training.o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders
          UNION ALL SELECT o_orderkey, 'data.o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders
          UNION ALL SELECT o_orderkey, 'data.o_orderpriority', o_orderpriority FROM orders
          UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders)""",
    "filter_nonempty": f"WITH {GAPS} SELECT doc_id, text FROM gaps WHERE text IS NOT NULL AND length(text) > 0",
    "row_report": rf"""WITH {GAPS} SELECT count(*) AS rows_read,
        count(*) FILTER (WHERE text IS NULL) AS rows_null, count(*) FILTER (WHERE text = '') AS rows_zero_length,
        count(*) FILTER (WHERE length(text) > 0) AS rows_kept,
        count(*) FILTER (WHERE length(text) > 0 AND regexp_full_match(text, '[ \t\n\x0b\f\r]+')) AS rows_blank_kept
        FROM gaps""",
    "length_report": f"""WITH n AS (SELECT lang, len({_words('text')}) AS n FROM documents WHERE length(text) > 0)
        SELECT lang, count(*) AS n_rows, CAST(sum(least(n, 512)) AS BIGINT) AS tokens_kept,
               CAST(sum(greatest(n - 512, 0)) AS BIGINT) AS tokens_cut,
               round(1 - sum(least(n, 512)) / (count(*) * 512.0::DOUBLE), 6) AS pad_share
        FROM n GROUP BY lang""",
    "vocab": f"WITH {VOCAB} SELECT token, n, id FROM vocab",
    "encode_ids": f"""WITH {ENCODED}
        SELECT w.doc_id, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos), '') AS input_ids
        FROM words w LEFT JOIN ids i ON w.doc_id = i.doc_id GROUP BY w.doc_id""",
    "decode_ids": f"""WITH {ENCODED}
        SELECT w.doc_id, coalesce(string_agg(known, ' ' ORDER BY pos), '') AS decoded
        FROM words w LEFT JOIN ids i ON w.doc_id = i.doc_id GROUP BY w.doc_id""",
    "prep_tokenise": f"""WITH {ENCODED},
        numbered AS (SELECT doc_id, list(id ORDER BY pos) AS a FROM ids WHERE pos <= 512 GROUP BY doc_id),
        filled AS (
          SELECT w.doc_id, least(len(w.w), 512) AS n, coalesce(a, []) AS a
          FROM words w LEFT JOIN numbered d ON w.doc_id = d.doc_id)
        SELECT doc_id, CAST(n AS INTEGER) AS n_tokens,
               rtrim(array_to_string(a, ' ') || ' ' || repeat('0 ', 512 - n)) AS input_ids,
               rtrim(repeat('1 ', n) || repeat('0 ', 512 - n)) AS attention_mask
        FROM filled""",
    "tokenise_arrow": f"""WITH {ENCODED}
        SELECT w.doc_id, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos), '') AS input_ids
        FROM words w LEFT JOIN ids i ON w.doc_id = i.doc_id GROUP BY w.doc_id""",
    "batch_assign": "SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM documents",
    "batch_assign_text": """WITH p AS (
          SELECT doc_id, source, text, row_number() OVER (ORDER BY source, doc_id) AS position FROM documents)
        SELECT *, (position - 1) // 8 AS batch_id FROM p""",
    "batch_map": """WITH b AS (SELECT n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS batch_id FROM documents)
        SELECT batch_id, count(*) AS n_rows, max(n_chars) AS longest FROM b GROUP BY batch_id""",
    "load_dispatch": """SELECT t.conv_id, t.turn, t.role, t.text, s.split FROM conversations t,
        (VALUES ('csv'), ('jsonl'), ('parquet'), ('directory'), ('table')) s(split)""",
    "cache_copy": "SELECT * FROM documents",
    "cache_files": "SELECT * FROM documents",
    "metrics_append": f"WITH {HISTORY} SELECT run, step, metric, loss AS value FROM history",
    "metric_choice": f"WITH {_bleu()} SELECT 'bleu' AS metric, bleu AS value FROM bleu_score",
    "pad_fallback": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 50256 ELSE doc_id % 3 - 1 END::BIGINT AS pad_id
        FROM documents""",
    "collate_batches": f"""WITH w AS (SELECT doc_id, list_transform({_words('text')}, lambda x: length(x)) AS a
          FROM documents),
        b AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM w),
        wide AS (SELECT *, CAST(ceil(max(len(a)) OVER (PARTITION BY batch_id) / 8.0) * 8 AS INTEGER) AS width FROM b),
        padded AS (SELECT doc_id, batch_id, width,
          array_to_string(list_transform(range(1, width + 1), lambda i: coalesce(a[i], 0)), ' ') AS input_ids,
          array_to_string(list_transform(range(1, width + 1), lambda i: CASE WHEN i <= len(a) THEN 1 ELSE 0 END), ' ')
            AS attention_mask FROM wide)
        SELECT *, input_ids AS labels FROM padded""",
    "seeded_shuffle": """SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS shuffled_idx
        FROM documents""",
    "step_plan": f"""WITH s AS (SELECT {SPLIT} AS split, count(*) AS n_rows FROM documents GROUP BY 1),
        b AS (SELECT *, CAST(ceil(n_rows / 16.0) AS BIGINT) AS n_batches FROM s)
        SELECT split, n_rows, n_batches, CAST(64 AS BIGINT) AS effective_batch,
               greatest(n_batches // 4, 1) AS steps_per_epoch, greatest(n_batches // 4, 1) * 3 AS total_steps FROM b""",
    "cls_confusion": f"WITH {_language()} SELECT label, prediction, count(*) AS n FROM judged GROUP BY ALL",
    "cls_counts": f"WITH {QUALITY}, {CLASSES} SELECT class, tp, predicted, support FROM counts",
    "cls_summary": f"WITH {QUALITY}, {CLASSES}, {SUMMARY} SELECT * FROM summary",
    "cls_per_class": f"""WITH {_language()}, {CLASSES}
        SELECT CASE row_number() OVER (ORDER BY class) WHEN 1 THEN 'German' WHEN 2 THEN 'English'
                    WHEN 3 THEN 'Spanish' ELSE 'French' END AS name,
               class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
        FROM scores""",
    "cls_evaluate": f"""WITH {QUALITY}, {CLASSES}, {SUMMARY},
        named AS (SELECT CASE class WHEN 0 THEN 'low' ELSE 'high' END AS class, precision, recall, f1,
                         CAST(support AS DOUBLE) AS support FROM scores)
        SELECT 'overall' AS scope, CAST(NULL AS VARCHAR) AS class, metric, value
          FROM (SELECT accuracy, precision, recall, f1 FROM summary)
          UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1))
        UNION ALL SELECT 'per_class', class, metric, round(value, 6)
          FROM named UNPIVOT (value FOR metric IN (precision, recall, f1, support))""",
    "pair_align": f"WITH {PAIRS} SELECT key, reference, prediction FROM pairs",
    "bleu": f"WITH {_bleu()} SELECT * FROM bleu_score",
    "rouge_n": f"""WITH {PAIRS}, {_rouge_n()}
        SELECT (SELECT round(avg(f), 6) FROM f1) AS rouge1, (SELECT round(avg(f), 6) FROM f2) AS rouge2""",
    "rouge_l": f"WITH RECURSIVE {PAIRS}, {_rouge_l()} SELECT key, round(f, 6) AS rouge_l FROM fl",
    "rouge_bootstrap": f"""WITH {PAIRS}, {_rouge_n()},
        blocks AS (SELECT CAST('0x' || substr(md5(key::VARCHAR), 1, 3) AS BIGINT) AS block, sum(f) AS s, count(*) AS n
          FROM f1 GROUP BY 1),
        draws AS (
          SELECT b AS replica, s, n,
                 CAST('0x' || substr(md5(b || ':' || block), 1, 13) AS BIGINT) / CAST({1 << 52} AS DOUBLE) AS u
          FROM blocks, range(1, {REPLICAS + 1}) r(b)),
        weighted AS (SELECT replica, s, n, {_poisson('u')} AS w FROM draws),
        means AS (SELECT replica, sum(w * s) / nullif(CAST(sum(w * n) AS DOUBLE), 0) AS mean FROM weighted GROUP BY replica)
        SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.5), 6) AS mid,
               round(quantile_cont(mean, 0.975), 6) AS high FROM means""",
    "text_evaluate": f"""WITH RECURSIVE {_bleu()}, {_rouge_n()}, {_rouge_l()}
        SELECT 'bleu' AS metric, bleu AS value FROM bleu_score
        UNION ALL SELECT 'rouge1', round(avg(f), 6) FROM f1
        UNION ALL SELECT 'rouge2', round(avg(f), 6) FROM f2
        UNION ALL SELECT 'rougeL', round(avg(f), 6) FROM fl""",
    "lm_fit": f"WITH {BIGRAMS} SELECT prev, token, n FROM pair_counts",
    "lm_score": f"WITH {LM_SCORED} SELECT item_id, n_tokens, round(loss, 6) AS loss FROM scored",
    "lm_perplexity": f"""WITH {LM_SCORED}
        SELECT count(*) AS n_rows, round(exp(avg(loss)), 3) AS perplexity, 'rows' AS weighted_by FROM scored
        UNION ALL
        SELECT count(*), round(exp(sum(loss * n_tokens) / sum(n_tokens)), 3), 'tokens' FROM scored""",
    "perplexity": """WITH b AS (
          SELECT n_chars / 1000.0::DOUBLE AS loss, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id
          FROM documents),
        m AS (SELECT avg(loss) AS loss, count(*) AS n FROM b GROUP BY batch_id)
        SELECT CAST(sum(n) AS BIGINT) AS n_rows, round(exp(sum(loss * n) / sum(n)), 6) AS perplexity FROM m""",
    "batch_losses": """WITH b AS (
          SELECT n_chars / 1000.0::DOUBLE AS loss, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id
          FROM documents)
        SELECT batch_id, round(avg(loss), 6) AS loss, count(*) AS n_rows FROM b GROUP BY batch_id""",
    "request_defaults": f"""WITH {REQUESTS} SELECT event_id, prompt, CAST(128 AS INTEGER) AS max_new_tokens,
        CASE WHEN kind > 7 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS temperature, 0.9::DOUBLE AS top_p, top_k,
        CAST(1 AS INTEGER) AS num_return_sequences, request_error FROM requests""",
    "response_struct": f"""WITH {USER_TURNS} SELECT conv_id, turn, prompt, 're: ' || prompt AS generated_texts,
        CAST(128 AS INTEGER) AS max_new_tokens, 1.0::DOUBLE AS temperature, 0.9::DOUBLE AS top_p,
        CAST(CASE WHEN turn > 0 THEN turn ELSE 50 END AS INTEGER) AS top_k, CAST(1 AS INTEGER) AS num_return_sequences
        FROM turns""",
    "strip_prompt": f"WITH {PAIRS} SELECT key, {_strip('prediction')} AS generated FROM pairs",
    "expand_sequences": f"""WITH {USER_TURNS} SELECT conv_id, turn,
        array_to_string(list_transform(range(1, conv_id % 3 + 2), lambda i: prompt || ' #' || i), '|') AS generated_texts
        FROM turns""",
    "nucleus_filter": """WITH c AS (SELECT lang, source, ln(CAST(count(*) AS DOUBLE)) AS score FROM documents GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, source) AS rank FROM c),
        e AS (SELECT *, exp(score / 0.7::DOUBLE) AS e FROM r WHERE rank <= 50),
        p AS (SELECT *, e / sum(e) OVER (PARTITION BY lang) AS p FROM e),
        b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY lang ORDER BY rank
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
        SELECT lang, source, rank, round(p / sum(p) OVER (PARTITION BY lang), 6) AS probability
        FROM b WHERE before < 0.9::DOUBLE""",
    "batch_predict": f"""WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents)
        SELECT doc_id, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)
                             / CAST(greatest(len(w), 1) AS DOUBLE), 6) AS score FROM w""",
    "generate_texts": f"""WITH {USER_TURNS},
        m AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN prompt || '?' ELSE prompt END AS prompt FROM turns)
        SELECT conv_id, turn, CASE WHEN contains(prompt, '?') THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN contains(prompt, '?') THEN 'model failed: no questions' END AS error,
               CASE WHEN contains(prompt, '?') THEN '' ELSE array_to_string(list_transform(range(1, turn % 2 + 2),
                 lambda i: 'reply ' || i || ' of ' || length(prompt) || ' characters'), '|') END AS generated_texts
        FROM m""",
    "steps_every": f"WITH {HISTORY} SELECT run, step, metric, loss FROM history WHERE step % 10 = 0",
    "best_step": f"""WITH {HISTORY}, r AS (
          SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, step) AS place FROM history)
        SELECT run, step AS best_step, loss AS best_loss FROM r WHERE place = 1""",
    "early_stop": f"""WITH {HISTORY},
        m AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM history),
        f AS (SELECT *, CASE WHEN best IS NULL OR loss < best THEN 1 ELSE 0 END AS gain FROM m),
        g AS (SELECT *, sum(gain) OVER (PARTITION BY run ORDER BY step) AS island FROM f),
        n AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) - 1 AS failed FROM g),
        s AS (SELECT run, max(step) AS n_steps, min(CASE WHEN failed >= 3 THEN step END) AS stop_step FROM n GROUP BY run),
        b AS (SELECT h.run, step, loss, row_number() OVER (PARTITION BY h.run ORDER BY loss, step) AS place
              FROM history h JOIN s ON h.run = s.run WHERE step <= coalesce(stop_step, n_steps))
        SELECT s.run, n_steps, stop_step, b.step AS best_step, b.loss AS best_loss
        FROM s JOIN b ON s.run = b.run AND b.place = 1""",
    "runs_compare": """SELECT user_id, min(value) FILTER (WHERE event_type = 'click') AS click_min,
        arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS click_last,
        min(value) FILTER (WHERE event_type = 'view') AS view_min,
        arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS view_last FROM events GROUP BY user_id""",
    "dataset_fingerprint": """WITH h AS (
          SELECT CAST('0x' || substr(md5(concat_ws('', coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '~'),
            coalesce(length(text) || ':' || text, '~'))), 1, 15) AS BIGINT) AS h FROM documents)
        SELECT count(*) AS n_rows, bit_xor(h) AS fingerprint, CAST(CAST(sum(h) AS HUGEINT) AS VARCHAR) AS hash_sum FROM h""",
    "dataset_diff": """WITH old AS (
          SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN lang END AS a, CASE WHEN doc_id % 5 > 0 THEN source || '|' END AS b, text
          FROM documents),
        v2 AS (
          SELECT doc_id, CASE WHEN doc_id % 21 = 0 THEN b ELSE a END AS a, CASE WHEN doc_id % 21 = 0 THEN a ELSE b END AS b,
                 CASE WHEN doc_id % 19 = 0 THEN upper(text) ELSE text END AS text
          FROM old WHERE doc_id % 17 <> 0
          UNION ALL SELECT item_id + 1000000000, NULL, NULL, text FROM benchmark)
        SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
               CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
                    WHEN o.a IS DISTINCT FROM n.a OR o.b IS DISTINCT FROM n.b OR o.text IS DISTINCT FROM n.text
                    THEN 'changed' ELSE 'same' END AS change
        FROM old o FULL JOIN v2 n ON o.doc_id = n.doc_id""",
    "monitor_windows": f"WITH {WINDOWS} SELECT * FROM windows",
    "stream_windows": f"WITH {WINDOWS} SELECT * FROM windows",
    "stream_requests": f"""WITH {REQUESTS},
        answered AS (SELECT *, coalesce(request_error, CASE WHEN starts_with(prompt, 'error')
                       THEN 'model failed: not accepted' END) AS error FROM requests)
        SELECT event_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, prompt,
               CASE WHEN error IS NULL THEN 'top ' || top_k ELSE '' END AS generated_texts, top_k FROM answered""",
}

for _ids in ("encode_ids", "decode_ids"):
    ORACLE[_ids.replace("_ids", "_join")] = ORACLE[_ids]

ORACLE |= {
    "align_positions": f"""WITH {PAIRS}
        SELECT row_number() OVER (ORDER BY key) - 1 AS position, reference, prediction FROM pairs""",
    "csv_borders": """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'say "' || replace(text, ' the ', ',' || chr(10) || chr(10) || '"')
          || '"' || chr(10) ELSE text END AS text, lang FROM documents""",
    "generate_by_length": f"SELECT *, TRUE AS little_padding FROM ({ORACLE['generate_texts']})",
    "early_stop_stream": ORACLE["early_stop"],
    "stored_changes": f"SELECT * FROM ({ORACLE['dataset_diff']}) WHERE change <> 'same'",
    "monitor_rollup": f"""WITH {WINDOWS} SELECT window_start, window_end, requests, errors, error_rate, TRUE AS near
        FROM windows""",
}
