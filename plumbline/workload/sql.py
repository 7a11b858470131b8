"""SQL fragments (common table expressions) shared by the SQL twins of the registered queries."""
from plumbline.functions.intent import INTENTS, TABLE_SIGNALS

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TOKENS = r"'[a-z0-9]+(?:\.[a-z0-9]+)*'"


def clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {TOKENS})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def pieces(source: str, key: str = "doc_id", text: str = "text", extra: str = "lang", name: str = "pieces") -> str:
    """Chunk texts: ``key, extra, pos, content``."""
    return f"""{name}_s AS (SELECT {key}::VARCHAR AS {key}, {extra}, string_split(regexp_replace({clean(text)},
  '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS s FROM {source} WHERE {clean(text)} <> ''),
{name}_f AS (SELECT {key}, {extra}, list_reduce(list_transform(s, lambda x: {{'cur': x, 'done': []::VARCHAR[]}}),
  lambda a, e: CASE WHEN length(a.cur) + length(e.cur) < 1800
    THEN {{'cur': a.cur || ' ' || e.cur, 'done': a.done}}
    ELSE {{'cur': right(a.cur, 200) || ' ' || e.cur,
          'done': CASE WHEN trim(a.cur) <> '' THEN list_append(a.done, trim(a.cur)) ELSE a.done END}} END,
  {{'cur': '', 'done': []::VARCHAR[]}}) AS r FROM {name}_s),
{name}_l AS (SELECT {key}, {extra}, list_filter(list_append(r.done, trim(r.cur)), lambda x: x <> '') AS l FROM {name}_f),
{name} AS (SELECT {key}, {extra}, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS content FROM {name}_l)"""


def text_chunks(org: str = "'default'", name: str = "text_chunks") -> str:
    return pieces("documents") + f""",
{name} AS (SELECT doc_id || '_s0_t' || pos AS chunk_id, doc_id, 0 AS section_id, 'text' AS modality, content,
  {org} AS org_id, doc_id AS file_id, pos FROM pieces)"""


def row_chunks(name: str, table: str, row_no: str, columns: dict) -> str:
    """Chunks of a relational table whose cells are never empty."""
    header = "| " + " | ".join(columns) + " |"
    described = " || ' | ' || ".join(f"'{c}: ' || ({e})::VARCHAR" for c, e in columns.items())
    line = " || ' | ' || ".join(f"({e})::VARCHAR" for e in columns.values())
    return f"""{name}_r AS (SELECT row_number() OVER (ORDER BY {row_no}) - 1 AS p, {described} AS described,
  '| ' || {line} || ' |' AS line FROM {table}),
{name} AS (SELECT '{table}_s0_tbl0_r' || (p // 5) AS chunk_id, '{table}' AS doc_id, 0 AS section_id,
  'table' AS modality, '[TABLE] Columns: {", ".join(columns)}.' || chr(10) || string_agg(described, chr(10) ORDER BY p)
  || chr(10) || chr(10) || 'Markdown:' || chr(10) || '{header}' || chr(10) || string_agg(line, chr(10) ORDER BY p)
  AS content, 'default' AS org_id, '{table}' AS file_id, p // 5 AS pos FROM {name}_r GROUP BY p // 5)"""


PART = {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}
SUPPLIER = {"name": "s_name", "nation": "s_nationkey", "balance": "cast(s_acctbal as decimal(12,2))"}

PAGES = f"""pg AS (SELECT 'page' || page_id AS doc_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS caption,
  regexp_extract(html, '<div class="ad">(.*?)</div>', 1) AS ocr_text,
  regexp_extract(html, '<h1>(.*?)</h1>', 1) AS fig_caption,
  substr({clean("regexp_replace(html, '<[^>]*>', ' ', 'g')")}, 1, 400) AS nearby_text FROM pages)"""
DECORATIVE = ("length(trim(ocr_text)) < 10 AND "
              "regexp_matches(lower(caption), 'logo|icon|banner|decorative|border|watermark|seal|badge')")
IMAGE_CHUNKS = PAGES + f""",
image_chunks AS (SELECT doc_id || '_s0_img0' AS chunk_id, doc_id, 0 AS section_id, 'image' AS modality,
  concat_ws(' ', CASE WHEN caption <> '' THEN '[Caption]: ' || caption END,
    CASE WHEN ocr_text <> '' THEN '[OCR]: ' || substr(ocr_text, 1, 500) END,
    CASE WHEN fig_caption <> '' THEN '[Figure caption]: ' || fig_caption END,
    CASE WHEN nearby_text <> '' THEN '[Context]: ' || substr(nearby_text, 1, 300) END) AS content,
  'default' AS org_id, doc_id AS file_id, 0 AS pos, ocr_text <> '' AS has_ocr, caption <> '' AS has_caption
  FROM pg WHERE NOT ({DECORATIVE}))"""

_C = "chunk_id, doc_id, section_id, modality, content, org_id, file_id"
CORPUS = ",\n".join([
    text_chunks(), row_chunks("part_chunks", "part", "p_partkey", PART),
    row_chunks("supplier_chunks", "supplier", "s_suppkey", SUPPLIER), IMAGE_CHUNKS,
    f"""chunks AS MATERIALIZED (SELECT {_C} FROM text_chunks UNION ALL SELECT {_C} FROM part_chunks
  UNION ALL SELECT {_C} FROM supplier_chunks UNION ALL SELECT {_C} FROM image_chunks)"""])

QUERIES = "q AS (SELECT item_id::VARCHAR AS qid, text AS query FROM benchmark)"
QRELS = """qrels AS (SELECT item_id::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, 0 AS section_id, d.source
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def bm25(chunks: str = "chunks") -> str:
    return f"""tf AS MATERIALIZED (SELECT org_id, modality, chunk_id, term, count(*) AS tf FROM (
  SELECT org_id, modality, chunk_id, unnest({tokens('content')}) AS term FROM {chunks}) GROUP BY ALL),
dl AS (SELECT org_id, modality, chunk_id, file_id, len({tokens('content')}) AS dl FROM {chunks}),
cs AS (SELECT org_id, modality, count(*) AS n_docs, avg(dl) AS avgdl FROM dl GROUP BY ALL),
dfs AS (SELECT org_id, modality, term, count(*) AS df FROM tf GROUP BY ALL),
raws AS (SELECT org_id, modality, term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw
  FROM dfs JOIN cs USING (org_id, modality)),
ts AS MATERIALIZED (SELECT org_id, modality, term, df, CASE WHEN raw < 0
  THEN 0.25 * avg(raw) OVER (PARTITION BY org_id, modality) ELSE raw END AS idf FROM raws),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens('query')}) AS term FROM q) GROUP BY ALL),
scored AS MATERIALIZED (SELECT qid, modality, chunk_id, round(sum(qtf * idf * tf * 2.5
  / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN ts USING (term)
  JOIN tf USING (org_id, modality, term) JOIN dl USING (org_id, modality, chunk_id) JOIN cs USING (org_id, modality)
  GROUP BY ALL)"""


def embedded(name: str, source: str, key: str, text: str, dim: int = 128) -> str:
    return f"""{name}_c AS (SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS b, count(*) AS n FROM (
  SELECT {key}, unnest({tokens(text)}) AS term FROM {source}) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {key}, b, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w
  FROM {name}_c)"""


def dense(query_text: str = "query", source: str = "q", chunks: str = "chunks") -> str:
    return ",\n".join([embedded("ce", chunks, "chunk_id", "content"), embedded("qe", source, "qid", query_text), f"""cn AS (SELECT chunk_id, sqrt(sum(w * w)) AS n FROM ce GROUP BY ALL),
qn AS (SELECT qid, sqrt(sum(w * w)) AS n FROM qe GROUP BY ALL),
nearest AS MATERIALIZED (SELECT qid, chunk_id, modality, round(dot / (qn.n * cn.n), 6) AS score FROM (
  SELECT qid, chunk_id, sum(qe.w * ce.w) AS dot FROM qe JOIN ce USING (b) GROUP BY ALL)
  JOIN cn USING (chunk_id) JOIN qn USING (qid) JOIN {chunks} USING (chunk_id))"""])


INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(query), '{p}') THEN '{n}'" for n, p in INTENTS.items()) \
    + " ELSE 'general' END"
TABLE_WEIGHT = "least(1.0::DOUBLE + (" + " + ".join(
    f"regexp_matches(lower(query), '{p}')::INT" for p in TABLE_SIGNALS) + ")::DOUBLE * 0.12::DOUBLE, 1.5::DOUBLE)"
ADAPTIVE_K = f"CASE modality WHEN 'table' THEN floor(30 * {TABLE_WEIGHT})::INT WHEN 'image' THEN 20 ELSE 30 END"
LIST_NO = "CASE modality WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END"
CROSS_WEIGHT = f"CASE modality WHEN 'table' THEN {TABLE_WEIGHT} WHEN 'image' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"


def overlap(query: str = "query", content: str = "content") -> str:
    q = f"list_distinct({tokens(query)})"
    return (f"CASE WHEN len({q}) > 0 THEN round(len(list_filter({q}, lambda t: list_contains({tokens(content)}, t)))"
            f"::DOUBLE / len({q}), 6) ELSE 0.0 END")


HYBRID = f"""dense_list AS (SELECT * FROM (SELECT qid, modality, chunk_id, query, row_number() OVER (
  PARTITION BY qid, modality ORDER BY score DESC, chunk_id) AS rnk FROM nearest JOIN q USING (qid))
  WHERE rnk <= {ADAPTIVE_K}),
sparse_list AS (SELECT * FROM (SELECT qid, modality, chunk_id, query, row_number() OVER (
  PARTITION BY qid, modality ORDER BY score DESC, chunk_id) AS rnk FROM scored JOIN q USING (qid) WHERE score <> 0)
  WHERE rnk <= {ADAPTIVE_K}),
both_lists AS (SELECT qid, modality, chunk_id, rnk, 0 AS list_no FROM dense_list
  UNION ALL SELECT qid, modality, chunk_id, rnk, 1 FROM sparse_list),
hybrid AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid, modality
  ORDER BY rrf_score DESC, first_seen, chunk_id) AS rnk FROM (SELECT qid, modality, chunk_id,
  round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS rrf_score, min(list_no * 1000 + rnk) AS first_seen
  FROM both_lists GROUP BY ALL))"""

CROSSED = f"""crossed AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid
  ORDER BY fused DESC, first_seen2, chunk_id) AS fused_rnk FROM (SELECT qid, chunk_id,
  round(sum({CROSS_WEIGHT} / (60 + rnk)), 12) AS fused, min({LIST_NO} * 1000 + rnk) AS first_seen2
  FROM hybrid JOIN q USING (qid) GROUP BY ALL)) WHERE fused_rnk <= 50)"""


def reranked(top_k: int, fused: str = "crossed") -> str:
    return f"""retrieved AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid
  ORDER BY rerank_score DESC, fused_rnk) AS rnk FROM (SELECT qid, query, chunk_id, doc_id, section_id, modality, content,
  fused_rnk, {overlap()} AS rerank_score FROM {fused} JOIN chunks USING (chunk_id) JOIN q USING (qid)))
  WHERE rnk <= {top_k})"""


RETRIEVE = [CORPUS, QUERIES, bm25(), dense(), HYBRID, CROSSED]

DESCRIBED = """gold AS (SELECT qid, min(doc_id) AS gold_doc FROM qrels GROUP BY qid),
described AS (SELECT q.qid, query, CASE WHEN length(query) > 250 THEN 'extractive' ELSE 'abstractive' END AS type,
  coalesce(d.source, 'text') AS source, gold_doc FROM q LEFT JOIN gold USING (qid)
  LEFT JOIN documents d ON d.doc_id::VARCHAR = gold_doc)"""


def evaluated(retrieved: str = "retrieved") -> str:
    return DESCRIBED + f""",
hits AS (SELECT qid, min(rnk) AS h FROM {retrieved} JOIN (SELECT DISTINCT qid, doc_id, section_id FROM qrels)
  USING (qid, doc_id, section_id) GROUP BY qid),
sizes AS (SELECT qid, count(*) AS n FROM {retrieved} GROUP BY qid),
per_query AS MATERIALIZED (SELECT d.qid, query, type, source, gold_doc, 0 AS gold_section,
  coalesce(n, 0) AS n_retrieved, {INTENT} AS intent,
  (coalesce(h <= 1, false))::INT::DOUBLE AS recall_at_1, (coalesce(h <= 3, false))::INT::DOUBLE AS recall_at_3,
  (coalesce(h <= 5, false))::INT::DOUBLE AS recall_at_5, (coalesce(h <= 10, false))::INT::DOUBLE AS recall_at_10,
  CASE WHEN h <= 10 THEN 1.0::DOUBLE / h ELSE 0.0 END AS mrr_at_10,
  CASE WHEN h <= 10 THEN 1.0::DOUBLE / log2(h + 1) ELSE 0.0 END AS ndcg_at_10
  FROM described d LEFT JOIN hits USING (qid) LEFT JOIN sizes USING (qid) WHERE gold_doc IS NOT NULL)"""
