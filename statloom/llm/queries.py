"""The numbered corpus queries over whole tables, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import chat, divergence, exact, hilbert, lexical, licenses, lines, mixing, nbsvm, packing, repair, simhash, warc

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def corpus_query(sql: str | None = None):
    def wrap(fn):
        LLM_QUERIES[fn.__name__] = fn
        if sql is not None:
            LLM_ORACLES[fn.__name__] = sql
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


@corpus_query(
    """
    WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, text_sha256
    FROM hashed WINDOW same AS (PARTITION BY text_sha256)
    """
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir))


@corpus_query()
def op2_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


@corpus_query(
    """
    WITH hashed AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    coded AS (
      SELECT *, max(page_id) OVER (PARTITION BY h) AS response_id,
             list_transform(range(0, 8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::BIGINT) AS groups
      FROM hashed)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(groups, lambda g:
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> 10) & 31) + 1, 1) ||
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (g & 31) + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> response_id THEN response_id END AS refers_to
    FROM coded
    """
)
def op3_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, _table(spark, sf_dir, "pages"))


@corpus_query()
def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.contract_rows(hilbert.hilbert_shards(_documents(spark, sf_dir)))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@corpus_query(
    f"""
    WITH split AS (
      SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place, unnest(string_split(coalesce(text, ''), chr(10))) AS line
      FROM documents),
    keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{lines.UPPER}', '{lines.LOWER}') AS k FROM split),
    hits AS (SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hits.k IS NOT NULL AND doc_id <> largest) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (hits.k IS NULL OR doc_id = largest), '')) AS kept_sha256
    FROM keyed LEFT JOIN hits USING (k) GROUP BY doc_id
    """
)
def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.with_kept_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@corpus_query()
def op6_histogram_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.rule_rows(_documents(spark, sf_dir))


@corpus_query()
def op7_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


@corpus_query()
def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


@corpus_query()
def op9_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_documents(spark, sf_dir))


@corpus_query()
def op10_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir)).drop("spans")


@corpus_query(
    r"""
    WITH every AS (
      SELECT conv_id, turn, role, text FROM conversations
      UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
    rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             sha256(coalesce(role, '') || chr(10) || coalesce(text, '')) AS tie FROM every)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
               + length('<|im_start|>') + length('<|im_sep|>') + length('<|im_end|>'))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id
    """
)
def op11_chat_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat.digests(chat.formatted(chat.with_probe(_table(spark, sf_dir, "conversations")), path), path)


@corpus_query(
    """
    WITH RECURSIVE coded AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
                 lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS fate
      FROM conversations),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
             CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM (SELECT *, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) FROM coded WHERE fate <> 0)),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(10) || text)) AS k,
             trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped FROM damaged),
    ordered AS (
      SELECT *, left(role, 1) AS initial,
             CASE WHEN stripped = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
                  WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
      FROM numbered),
    steps(state, initial, role, next) AS (VALUES (0, 's', 'system', 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (3, 'u', 'user', 2), (2, 'a', 'assistant', 3)),
    inserted AS (
      SELECT state, state AS next, '' AS audit, 0 AS cost, [] AS lines FROM (VALUES (0), (1), (2), (3)) AS s(state)
      UNION ALL SELECT state, next, 'I', 5, [role || ':'] FROM steps WHERE initial <> 's'
      UNION ALL SELECT a.state, b.next, 'II', 10, [a.role || ':', b.role || ':'] FROM steps a JOIN steps b ON a.next = b.state WHERE a.initial <> 's' AND b.initial <> 's'),
    search AS (
      SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM ordered
      UNION ALL
      SELECT conv_id, any_value(k), state, min(best) FROM (
        SELECT p.conv_id, o.k, e.next AS state,
               {'cost': p.best.cost + i.cost + e.cost, 'audit': p.best.audit || i.audit || e.audit,
                'lines': list_concat(p.best.lines, list_concat(i.lines, CASE WHEN e.role IS NULL THEN []::VARCHAR[] ELSE [e.role || ':' || o.text] END))} AS best
        FROM search p JOIN ordered o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.k = p.k + 1 JOIN inserted i ON i.state = p.state,
        LATERAL (
          SELECT 2 AS cost, 'D' AS audit, i.next AS next, NULL::VARCHAR AS role
          UNION ALL SELECT CASE WHEN o.fault = 't' THEN 5 ELSE 0 END, 'K', s.next, o.role FROM steps s WHERE s.state = i.next AND s.initial = o.initial AND o.fault IN ('-', 't')
          UNION ALL SELECT CASE WHEN o.fault = 't' THEN 6 ELSE 1 END, 'R', s.next, s.role FROM steps s WHERE s.state = i.next AND s.initial <> 's' AND o.fault IN ('-', 't')) e)
      GROUP BY conv_id, state),
    final AS (
      SELECT conv_id, min({'cost': best.cost + i.cost, 'audit': best.audit || i.audit, 'lines': list_concat(best.lines, i.lines)}) AS best
      FROM search JOIN (SELECT conv_id, max(k) AS k FROM ordered GROUP BY conv_id) USING (conv_id, k) JOIN inserted i USING (state)
      WHERE i.next IN (0, 3) GROUP BY conv_id),
    pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM ordered),
    told AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
             count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM pairs GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told USING (conv_id) LEFT JOIN final USING (conv_id)
    """
)
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(_table(spark, sf_dir, "conversations"))


@corpus_query(
    r"""
    WITH words AS (
      SELECT doc_id, row_number() OVER () AS row_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents),
    counts AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM words),
    asked AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
    postings AS (
      SELECT row_id, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
      FROM (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM words)
      WHERE term IN (SELECT term FROM asked) GROUP BY row_id, term),
    weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, counts GROUP BY term),
    scores AS (
      SELECT item_id, row_id, any_value(doc_id) AS doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM asked JOIN postings USING (term) JOIN weights USING (term), counts GROUP BY item_id, row_id)
    SELECT item_id, rank, doc_id, score
    FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
    WHERE rank <= 50
    """
)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
