"""Registered queries of the conversation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.stage import materialize
from docloom.operators import conversation as C
from docloom.operators.documents import atom_offsets
from docloom.plans.bridge import CONTEXT_BUDGET, Corpus, digit
from docloom.plans.oracle_base import WS_RE2, compose, cte, digit as sql_digit
from docloom.plans.registry import register

CHAT = C.ChatConfig(model_id="model-a", context_window=6000)


def _citations(c: Corpus):
    return c.allowed.select(
        F.col("request_id").alias("message_id"), F.lit(0).alias("order_index"), F.col("context_id").alias("block_id"),
        F.lit(1).alias("page"), F.lit("p. 1").alias("label"))


register("C1_conversation_heads", lambda c: C.conversation_snapshot(c.chats, c.messages, _citations(c))[0].select(
    "conversation_id", "document_id", "active_message_id", "latest_selection", F.coalesce("message_count", F.lit(0)).alias("message_count")),
    compose("""SELECT c.id AS conversation_id, any_value(c.document_id) AS document_id, arg_max(m.id, CASE WHEN m.role = 'assistant' AND m.state = 'streaming' THEN m.sequence END) AS active_message_id,
  arg_max(m.selection, CASE WHEN m.selection IS NOT NULL THEN m.sequence END) AS latest_selection, count(m.id) AS message_count
FROM chats c LEFT JOIN messages m ON m.conversation_id = c.id GROUP BY c.id"""))
register("C1_messages", lambda c: C.conversation_snapshot(c.chats, c.messages, _citations(c))[1].select(
    "id", "role", "state", "sequence", "responding_to", F.size("citations").alias("citation_count")),
    compose("SELECT id, role, state, sequence, responding_to, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END::INT AS citation_count FROM messages"))
cte("turns_judged", f"""
SELECT t.*, top, CASE WHEN code IS NOT NULL THEN code WHEN busy THEN 'assistant_busy' END AS code1, last_answer, old_text, coalesce(t.selection, latest) AS use_selection FROM (
  SELECT t.*, s.top, coalesce(s.busy, false) AS busy, a.id AS last_answer, q.text AS old_text, l.latest, CASE WHEN is_retry THEN CASE WHEN q.id IS NULL OR q.selection IS NULL THEN 'not_retryable'
      WHEN coalesce(a.state, '') NOT IN ('failed', 'cancelled') THEN 'answer_not_failed' END
    WHEN regexp_full_match(t.text, '{WS_RE2}*') OR octet_length(encode(regexp_replace(t.text, '^{WS_RE2}+|{WS_RE2}+$', '', 'g'))) > 8000 THEN 'invalid_question'
    WHEN q.id IS NOT NULL THEN 'reader_id_used' WHEN t.selection IS NULL AND l.latest IS NULL THEN 'selection_required' END AS code
  FROM turns t LEFT JOIN messages q ON q.id = t.reader_id AND q.role = 'reader'
  LEFT JOIN (SELECT conversation_id, max(sequence) AS top, bool_or(role = 'assistant' AND state = 'streaming') AS busy FROM messages GROUP BY 1) s ON s.conversation_id = t.conversation_id
  LEFT JOIN (SELECT conversation_id, arg_max(selection, sequence) AS latest FROM messages WHERE selection IS NOT NULL GROUP BY 1) l ON l.conversation_id = t.conversation_id
  LEFT JOIN (SELECT responding_to, arg_max(id, sequence) AS id, arg_max(state, sequence) AS state FROM messages WHERE role = 'assistant' GROUP BY 1) a ON a.responding_to = t.reader_id) t""")
cte("turns_final", """SELECT *, CASE WHEN code1 IS NOT NULL THEN code1 WHEN row_number() OVER (PARTITION BY conversation_id, code1 IS NULL ORDER BY created_at, turn_id) > 1 THEN 'assistant_busy' END AS error_code FROM turns_judged""")
register("C2_enqueue_turns", lambda c: C.enqueue_turns(c.messages, c.turns)[0].select("id", "conversation_id", "role", "state", "sequence", "responding_to", "selection", "retry_of"),
         compose("""SELECT reader_id AS id, conversation_id, 'reader' AS role, 'ready' AS state, top + 1 AS sequence, NULL AS responding_to, use_selection AS selection, NULL AS retry_of FROM turns_final WHERE error_code IS NULL AND NOT is_retry
UNION ALL SELECT assistant_id, conversation_id, 'assistant', 'queued', top + CASE WHEN is_retry THEN 1 ELSE 2 END, reader_id, NULL, CASE WHEN is_retry THEN last_answer END FROM turns_final WHERE error_code IS NULL"""))
register("C2_rejected_turns", lambda c: C.enqueue_turns(c.messages, c.turns)[1],
         compose("SELECT turn_id, conversation_id, error_code FROM turns_final WHERE error_code IS NOT NULL"))
register("C3_validate_questions", lambda c: C.validate_questions(c.turns, c.messages).select("turn_id", "selection", "error_code"),
         compose(f"""SELECT turn_id, coalesce(t.selection, l.latest) AS selection, CASE WHEN regexp_full_match(t.text, '{WS_RE2}*') OR octet_length(encode(regexp_replace(t.text, '^{WS_RE2}+|{WS_RE2}+$', '', 'g'))) > 8000 THEN 'invalid_question'
  WHEN coalesce(t.selection, l.latest) IS NULL THEN 'selection_required' END AS error_code FROM turns t
LEFT JOIN (SELECT conversation_id, arg_max(selection, sequence) AS latest FROM messages WHERE selection IS NOT NULL GROUP BY 1) l ON l.conversation_id = t.conversation_id"""))
register("C4_validate_selections", lambda c: C.validate_selections(c.selections, c.block_facts, c.view).select("selection_id", "chapter_id", "error_code"),
         compose("SELECT selection_id, chapter_id, error_code FROM selections_judged"))


register("C5_neighbour_context", lambda c: c.neighbours.select(
    "selection_id", "used_bytes", "context_error", F.array_join(F.transform("blocks", lambda b: b["blockId"]), ",").alias("block_ids")),
    compose(f"""SELECT a.selection_id, CASE WHEN a.base <= {CONTEXT_BUDGET} THEN a.u4 END AS used_bytes, CASE WHEN a.base > {CONTEXT_BUDGET} THEN 'context_too_large' END AS context_error,
  (SELECT string_agg(block_id, ',' ORDER BY off) FROM admitted d WHERE d.selection_id = a.selection_id) AS block_ids FROM admission4 a"""))
register("C6_recent_history", lambda c: C.recent_history(c.messages).select("conversation_id", "turn", "sequence", "responding_to"),
         compose("SELECT conversation_id, turn::INT AS turn, sequence, responding_to FROM history"))


def _fitted(c: Corpus):
    return C.fit_requests(c.contexts, C.recent_history(c.messages), CHAT)


cte("context_pieces", """
SELECT selection_id, conversation_id, any_value(sel_json) AS sel_json, any_value(selected_text) AS selected_text, count(*) AS n, count(*) FILTER (off < 0) AS s,
  list(block_id ORDER BY off) AS ids, list(octet_length(encode(cj)) ORDER BY off) AS sizes FROM (SELECT *, '{"id":"ctx-00000000-00","source":' || to_json(plain_text)::VARCHAR
  || CASE WHEN translated IS NOT NULL THEN ',"translation":' || to_json(translated)::VARCHAR ELSE '' END || ',"pageStart":' || page || ',"pageEnd":' || page || ',"selected":' || CASE WHEN off = 0 THEN 'true' ELSE 'false' END || '}' AS cj FROM admitted) GROUP BY 1, 2""")
cte("past_pieces", """
SELECT conversation_id, count(*) AS h, list(octet_length(encode('{"role":"reader","text":' || to_json(question)::VARCHAR || '},{"role":"assistant","text":' || to_json(answer)::VARCHAR || '}')) ORDER BY turn) AS turns FROM history GROUP BY 1""")
cte("fit_steps", """
SELECT p.*, coalesce(h, 0) AS h, coalesce(turns, []) AS turns, unnest(range(0, coalesce(h, 0)::BIGINT + n)) AS step,
  octet_length(encode('{"task":"explain_selected_translation","question":' || to_json('Why "' || selected_text || '"?')::VARCHAR || ',"selection":' || sel_json || ',"context":[')) + 22 AS fixed
FROM context_pieces p LEFT JOIN past_pieces t ON t.conversation_id = p.conversation_id""")
cte("fit_cuts", """
SELECT *, least(step, h) AS dropped, CASE WHEN step > h THEN step - h ELSE 0 END AS cuts FROM fit_steps""")
# with cuts blocks gone: the first drop is on the side that is not smaller, then sides alternate by size
cte("recursive_cuts", """
SELECT n AS tn, s AS ts, 0 AS cuts, 0 AS lo, n AS hi FROM (SELECT DISTINCT n, s FROM context_pieces)
UNION ALL SELECT tn, ts, cuts + 1, CASE WHEN ts - lo >= hi - 1 - ts THEN lo + 1 ELSE lo END, CASE WHEN ts - lo >= hi - 1 - ts THEN hi ELSE hi - 1 END FROM recursive_cuts WHERE hi - lo > 1""")
cte("fit_sizes", """
SELECT f.*, r.lo, r.hi, fixed + list_sum(sizes[r.lo + 1:r.hi]) + (r.hi - r.lo) - 1 + coalesce(list_sum(turns[dropped + 1:h]), 0) + CASE WHEN h - dropped > 0 THEN h - dropped - 1 ELSE 0 END AS total
FROM fit_cuts f JOIN recursive_cuts r ON r.tn = f.n AND r.ts = f.s AND r.cuts = f.cuts""")
register("C7_fit_requests", lambda c: _fitted(c).select(
    "request_id", "error_code", F.size("turns").alias("turns_kept"), F.array_join(F.transform("blocks", lambda b: b["blockId"]), ",").alias("block_ids"), F.octet_length("input_json").alias("input_bytes")),
    compose(f"""SELECT p.selection_id AS request_id, CASE WHEN f.selection_id IS NULL THEN 'request_too_large' END AS error_code, CASE WHEN f.selection_id IS NULL THEN -1 ELSE f.h - f.dropped END::INT AS turns_kept,
  array_to_string(f.ids[f.lo + 1:f.hi], ',') AS block_ids, f.total::INT AS input_bytes
FROM context_pieces p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY step) AS rn FROM fit_sizes WHERE total <= {CHAT.request_bytes}) f ON f.selection_id = p.selection_id AND f.rn = 1"""))
register("C8_encode_context", lambda c: _fitted(c).filter("error_code IS NULL").select(
    "request_id", F.get_json_object("input_json", "$.question").alias("question"), F.get_json_object("input_json", "$.selection.blockId").alias("block_id"),
    F.get_json_object("input_json", "$.context[0].id").alias("first_id"), F.octet_length("input_json").alias("bytes")),
    compose(f"""SELECT selection_id AS request_id, 'Why "' || selected_text || '"?' AS question, substr(selection_id, 3) AS block_id, 'ctx-' || left(sha256(selection_id), 8) || '-00' AS first_id, total::INT AS bytes
FROM (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY step) AS rn FROM fit_sizes WHERE total <= {CHAT.request_bytes}) WHERE rn = 1"""))


def _occurrences(c: Corpus):
    d = c.table("documents")
    k = F.col("doc_id") % 3
    needle = F.when(k == 0, "the").when(k == 1, "er").otherwise("ch")
    return d.select("doc_id", F.col("text").alias("target"), needle.alias("selected_text"),
                    (F.col("doc_id") * 37 % 3000).cast("int").alias("approximate_start"))


register("C9_selection_occurrence", lambda c: C.selection_occurrence(_occurrences(c)).select("doc_id", "start_utf16", "end_utf16"),
         """WITH t AS (SELECT doc_id, text AS x, doc_id * 37 % 3000 AS near, CASE doc_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'er' ELSE 'ch' END AS n FROM documents),
p AS (SELECT doc_id, near, n, unnest(string_split(x, n)) AS piece, generate_subscripts(string_split(x, n), 1) AS j, len(string_split(x, n)) AS k FROM t),
m AS (SELECT doc_id, near, j, k, (sum(length(piece) + length(regexp_replace(piece, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) OVER (
    PARTITION BY doc_id ORDER BY j ROWS UNBOUNDED PRECEDING) + (j - 1) * length(n))::INT AS at_ FROM p),
b AS (SELECT doc_id, arg_min(at_, abs(at_ - near) * 1000000 + at_) AS s FROM m WHERE j < k GROUP BY 1)
SELECT t.doc_id, b.s AS start_utf16, (b.s + length(t.n))::INT AS end_utf16 FROM t LEFT JOIN b ON b.doc_id = t.doc_id""")
register("C10_cleaned_answers", lambda c: C.extract_citations(c.answers, c.allowed)[0],
         compose("SELECT request_id, original AS text FROM answers"))
register("C10_extract_citations", lambda c: C.extract_citations(c.answers, c.allowed)[1],
         compose("SELECT request_id, 0 AS order_index, 'ctx-' || sequence AS context_id FROM answers"))
register("C10_citation_warnings", lambda c: C.extract_citations(c.answers, c.allowed)[2].select("request_id", "code"),
         compose("""SELECT request_id, 'citation_duplicate' AS code FROM answers WHERE k % 3 = 0 UNION ALL SELECT request_id, 'citation_out_of_context' FROM answers WHERE k % 4 = 1
UNION ALL SELECT request_id, 'citation_marker_invalid' FROM answers WHERE k IN (2, 3, 4)"""))


def _resolved(c: Corpus):
    # ids and pages only; both sides of the join read them
    targets = materialize(C.citation_targets(_fitted(c)), "targets")
    k = digit(F.concat("request_id", "context_id"))
    cites = targets.select("request_id", F.when(k < 4, F.lit("ctx-gone")).otherwise(F.col("context_id")).alias("context_id"))
    return C.resolve_citations(cites, targets)


register("C11_resolve_citations", lambda c: _resolved(c).select("request_id", "context_id", "block_id", "label"),
         compose(f"""SELECT request_id, context_id, block_id, 'p. ' || page AS label FROM (SELECT f.selection_id AS request_id, 'ctx-' || left(sha256(f.selection_id), 8) || '-' || lpad(i::VARCHAR, 2, '0') AS context_id, f.ids[f.lo + 1 + i] AS block_id
  FROM (SELECT *, unnest(range(0, hi - lo)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY step) AS rn FROM fit_sizes WHERE total <= {CHAT.request_bytes}) WHERE rn = 1) f) x
JOIN (SELECT block_id AS b, page FROM blocks_all) p ON p.b = x.block_id WHERE {sql_digit('request_id || context_id')} >= 4"""))


def _checkpoints(c: Corpus):
    m = c.messages.filter("role = 'assistant' AND state IN ('streaming', 'failed')")
    k = digit(F.concat(F.lit("cp"), "id"))
    return m.select(F.col("id").alias("message_id"), k.alias("k"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("version")).select(
        "message_id", "version",
        F.when((F.col("version") == 2) & (F.col("k") < 4), "queued").when((F.col("version") == 3) & (F.col("k") > 8), "ready")
        .when((F.col("version") == 4) & (F.col("k") > 12), "failed").otherwise("streaming").alias("state"),
        F.concat(F.lit("text "), F.col("version").cast("string")).alias("text"),
        F.array(F.struct(F.col("message_id").alias("block_id"), F.col("version").alias("page"))).alias("citations"))


cte("checkpoints", f"""
SELECT id AS message_id, v AS version, CASE WHEN v = 2 AND kc < 4 THEN 'queued' WHEN v = 3 AND kc > 8 THEN 'ready' WHEN v = 4 AND kc > 12 THEN 'failed' ELSE 'streaming' END AS state, open
FROM (SELECT id, state = 'streaming' AS open, {sql_digit("'cp' || id")} AS kc, unnest([1, 2, 3, 4]) AS v FROM messages WHERE role = 'assistant' AND state IN ('streaming', 'failed'))""")
cte("checkpoint_ends", """SELECT message_id, coalesce(min(CASE WHEN state IN ('ready', 'failed') THEN version END), max(version)) AS v, min(CASE WHEN state IN ('ready', 'failed') THEN version END) AS e FROM checkpoints WHERE open AND state <> 'queued' GROUP BY 1""")
register("C12_apply_checkpoints", lambda c: C.apply_checkpoints(c.messages, _checkpoints(c))[0].select("id", "state", F.substring("text", 1, 7).alias("text")),
         compose("""SELECT m.id, coalesce(p.state, m.state) AS state, CASE WHEN e.v IS NOT NULL THEN 'text ' || e.v ELSE left(m.text, 7) END AS text
FROM messages m LEFT JOIN checkpoint_ends e ON e.message_id = m.id LEFT JOIN checkpoints p ON p.message_id = e.message_id AND p.version = e.v"""))
register("C12_rejected_checkpoints", lambda c: C.apply_checkpoints(c.messages, _checkpoints(c))[2],
         compose("""SELECT c.message_id, c.version, CASE WHEN state = 'queued' THEN 'cannot_return_to_queued' ELSE 'response_changed' END AS error_code
FROM checkpoints c LEFT JOIN checkpoint_ends e ON e.message_id = c.message_id WHERE state = 'queued' OR NOT open OR version > e.e"""))
register("C12_replace_citations", lambda c: C.replace_citations(
    _citations(c).select("message_id", "order_index", "block_id", F.lit(9).alias("page")), C.apply_checkpoints(c.messages, _checkpoints(c))[1]),
    compose("""SELECT request_id AS message_id, 0 AS order_index, 'ctx-' || sequence AS block_id, 9 AS page FROM answers WHERE request_id NOT IN (SELECT message_id FROM checkpoint_ends)
UNION ALL SELECT message_id, 0, message_id, v FROM checkpoint_ends"""))
register("C13_finalize_responses", lambda c: C.finalize_responses(c.answers.withColumn("k", digit("request_id")).select(
    "request_id", (F.col("k") == 5).alias("cancelled"), F.when(F.col("k") != 6, "stop").alias("finish_reason"), F.when(F.col("k") == 7, F.lit("  ")).otherwise(F.col("text")).alias("text"),
    F.when(F.col("k") == 8, "timeout").alias("provider_code"), (F.col("k") % 3).alias("warnings"))),
    compose("""SELECT request_id, CASE WHEN k = 5 THEN 'cancelled' WHEN k IN (6, 7, 8) THEN 'failed' ELSE 'ready' END AS state, CASE WHEN k = 5 THEN 'cancelled' WHEN k = 8 THEN 'timeout' WHEN k IN (6, 7) THEN 'response_incomplete' END AS error_code,
  CASE WHEN k NOT IN (5, 6, 7, 8) AND k % 3 > 0 THEN 'Some invalid citation markers were ignored' END AS safe_message FROM answers"""))
register("C14_recover_responses", lambda c: C.recover_responses(c.messages, c.chats).select("id", "conversation_id", "state", "text", "error_code"),
         compose("SELECT id, conversation_id, 'failed' AS state, text, 'interrupted' AS error_code FROM messages WHERE role = 'assistant' AND state = 'streaming'"))


def _cleared(c: Corpus, which: int):
    docs = c.chats.filter(digit("document_id") < 6).select("document_id")
    return C.clear_conversations(c.chats, c.messages, _citations(c), docs)[which]


register("C15_clear_conversations", lambda c: _cleared(c, 0).select("id", "document_id"),
         compose(f"SELECT id, document_id FROM chats WHERE {sql_digit('document_id')} >= 6"))
register("C15_clear_messages", lambda c: _cleared(c, 1).select("id"),
         compose(f"SELECT m.id FROM messages m JOIN chats c ON c.id = m.conversation_id WHERE {sql_digit('document_id')} >= 6"))
register("C15_clear_citations", lambda c: _cleared(c, 2).select("message_id"),
         compose(f"SELECT m.id AS message_id FROM messages m JOIN chats c ON c.id = m.conversation_id WHERE role = 'assistant' AND {sql_digit('document_id')} >= 6"))


def _spans(c: Corpus):
    blocks = c.normalized.blocks
    k = digit("block_id")
    sel = blocks.select(F.concat(F.lit("h-"), "block_id").alias("selection_id"), "block_id", (k * 2).alias("start_utf16"), (k * 9 + 20).alias("end_utf16"))
    return C.highlight_spans(atom_offsets(blocks), sel)


register("C16_highlight_spans", lambda c: _spans(c).select("block_id", "leaf_index", "from_utf16", "to_utf16"),
         compose(rf"""WITH v AS (SELECT *, length(t) + length(regexp_replace(t, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS n FROM leaves),
o AS (SELECT block_id, row_number() OVER w - 1 AS leaf_index, sum(n + gap) OVER w - n AS a, sum(n + gap) OVER w AS b, {sql_digit('block_id')} AS k FROM v WINDOW w AS (PARTITION BY block_id ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT block_id, leaf_index::INT AS leaf_index, (greatest(k * 2, a) - a)::INT AS from_utf16, (least(k * 9 + 20, b) - a)::INT AS to_utf16 FROM o WHERE k * 9 + 20 > a AND k * 2 < b"""))
