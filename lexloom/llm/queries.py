"""One query for each training-data operator over its whole table, and the SQL that says what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.substring_dedup import remove_repeated_passages

    return remove_repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op1_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS k FROM win),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM keyed) WHERE doc_id > f),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM late)),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS t, count(*) AS n FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.line_dedup import remove_repeated_lines

    return remove_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLES["op2_line_dedup"] = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM l),
keyed AS (SELECT doc_id, p, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
seen AS (SELECT doc_id, p, line, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM seen GROUP BY doc_id
"""


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.ngram_join import near_duplicate_components

    return near_duplicate_components(table(spark, sf_dir, "documents"))


ORACLES["op9_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v WHERE r.c < e.y)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.c, documents.doc_id)::BIGINT AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY 1) k ON k.v = documents.doc_id
"""


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op10_sql() -> str:
    from lexloom.llm.decontaminate import PUNCTUATION, SHARE, UNITS, WIDTH

    space = r"[\x20\x09-\x0D]"
    name = r"""'([^.!?:\s] )\p{Lu}[^\s.!?:,;"()]*', '\1<name>', 'g'"""
    marked = f"regexp_replace(regexp_replace(text, {name}), {name})"
    marked = f"regexp_replace({marked}, '(^|{space})[$€£#(+-]?[0-9][^\\x20\\x09-\\x0D]*', '\\1<num>', 'g')"
    marked = f"regexp_replace({marked}, '(<num>{space}+)(?:{'|'.join(UNITS)})({space[:-1]}.,;:!?)]|$)', '\\1<unit>\\2', 'g')"
    bare = lambda x: f"translate({x}, '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', '')"
    words = lambda x: f"string_split_regex(regexp_replace({x}, '^{space}+|{space}+$', '', 'g'), '{space}+')"
    return rf"""
WITH b AS (SELECT item_id, {words(f'lower({marked})')} AS c0, {words('text')} AS raw FROM benchmark WHERE regexp_matches(text, '[^\x20\x09-\x0D]')),
d AS (SELECT doc_id, {words(f'lower({marked})')} AS c0, {words('text')} AS raw FROM documents WHERE text IS NOT NULL),
bc AS (SELECT item_id, raw, list_transform(c0, lambda x: {bare('x')}) AS c FROM b),
dc AS (SELECT doc_id, raw, list_transform(c0, lambda x: {bare('x')}) AS c FROM d),
bw AS (SELECT item_id, i AS bpos, least(len(c), {WIDTH}) AS w, c[i:i+least(len(c), {WIDTH})-1] AS k, raw[i:i+least(len(c), {WIDTH})-1] AS braw FROM (SELECT *, unnest(range(1, len(c) - least(len(c), {WIDTH}) + 2)) AS i FROM bc)),
bk AS (SELECT * FROM bw WHERE len(list_filter(k, lambda x: starts_with(x, '<'))) * 2 <= w),
dw AS (SELECT doc_id, p, w, c[p:p+w-1] AS k, raw[p:p+w-1] AS draw FROM (SELECT *, unnest(range(1, len(c) - w + 2)) AS p FROM dc, (SELECT DISTINCT w FROM bk))),
hit AS (SELECT doc_id, item_id, bpos, p - bpos AS line, k, braw, draw FROM dw JOIN bk USING (k)),
slot AS (SELECT DISTINCT doc_id, item_id, line, {bare('b')} AS bv, {bare('v')} AS dv FROM (SELECT doc_id, item_id, line, unnest(k) AS x, unnest(braw) AS b, unnest(draw) AS v FROM hit) WHERE starts_with(x, '<')),
wrong AS (SELECT doc_id, item_id, line FROM slot GROUP BY ALL HAVING count(*) <> count(DISTINCT bv) OR count(*) <> count(DISTINCT dv)),
n AS (SELECT doc_id, item_id, max(n) AS n FROM (SELECT doc_id, item_id, line, count(DISTINCT bpos) AS n FROM hit ANTI JOIN wrong USING (doc_id, item_id, line) GROUP BY ALL) GROUP BY ALL),
found AS (SELECT doc_id, item_id, n FROM n JOIN (SELECT item_id, count(*) AS a FROM bk GROUP BY 1) USING (item_id) WHERE n >= a * {SHARE}),
v AS (SELECT doc_id, list(item_id ORDER BY item_id) AS items, sum(n) AS n FROM found GROUP BY 1)
SELECT documents.doc_id, v.doc_id IS NOT NULL AS contaminated, coalesce(items, []::BIGINT[]) AS items, coalesce(n, 0)::BIGINT AS n_windows FROM documents LEFT JOIN v ON v.doc_id = documents.doc_id
"""


ORACLES["op10_decontaminate"] = _op10_sql()


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.sentencepiece_codec import encode

    return encode(table(spark, sf_dir, "documents"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents")).drop("words_by_label")


_ODD = "<|im_end|><|im_start|>assistant ok"


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lexloom.llm.chat_format import digests, format_conversations, read_back

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_ODD).alias("text"))
    return digests(read_back(format_conversations(rows.unionByName(odd))))


ORACLES["op8_chat_format"] = rf"""
WITH RECURSIVE a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_ODD}' UNION ALL SELECT -1, 1, 'assistant', '{_ODD}'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, len(string_split_regex(text, '[\x20\x09-\x0D]+')) + 4 AS cost,
  12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11 AS size FROM a),
c AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY i) AS p, first_value(role = 'system') OVER (PARTITION BY conv_id ORDER BY i) AS sys, first_value(cost) OVER (PARTITION BY conv_id ORDER BY i) AS c0,
  first_value(size) OVER (PARTITION BY conv_id ORDER BY i) AS s0, lag(cost, 1, 0) OVER w AS b1, lag(cost, 2, 0) OVER w AS b2, lag(size, 1, 0) OVER w AS z1, lag(size, 2, 0) OVER w AS z2 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
h AS (SELECT *, CASE WHEN i - 2 >= sys::INT AND (b1 + b2) * 4 <= 256 THEN 2 WHEN i - 1 >= sys::INT AND b1 * 4 <= 256 THEN 1 ELSE 0 END AS h FROM c),
r AS (SELECT conv_id, i, cost AS used, false AS opens FROM h WHERE i = 0
  UNION ALL SELECT h.conv_id, h.i, CASE WHEN h.i > h.sys::INT AND r.used + h.cost > 256 THEN CASE WHEN sys THEN c0 ELSE 0 END + CASE h.h WHEN 2 THEN b1 + b2 WHEN 1 THEN b1 ELSE 0 END + h.cost ELSE r.used + h.cost END,
  h.i > h.sys::INT AND r.used + h.cost > 256 FROM r JOIN h ON h.conv_id = r.conv_id AND h.i = r.i + 1)
SELECT h.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY h.i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY h.i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + CASE WHEN opens THEN CASE WHEN sys THEN s0 ELSE 0 END + CASE h.h WHEN 2 THEN z1 + z2 WHEN 1 THEN z1 ELSE 0 END ELSE 0 END)::BIGINT AS formatted_chars
FROM h JOIN r ON r.conv_id = h.conv_id AND r.i = h.i GROUP BY h.conv_id
"""


@query
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.topk_search import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLES["op3_topk_search"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.shared import scratch_path
    from lexloom.llm.warc import plan_records, read_archives, summarise, write_archives

    path = scratch_path(spark, "warc")
    write_archives(plan_records(table(spark, sf_dir, "pages")), path)
    return summarise(read_archives(spark, path))


ORACLES["op4_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS best FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < best THEN best END AS refers_to FROM d
"""


@query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.lexical_search import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_LETTERS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES["op12_lexical_search"] = rf"""
WITH d AS (SELECT doc_id, {_LETTERS} AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_LETTERS} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
size AS (SELECT count(*) AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
post AS (SELECT doc_id, term, 75 + (25 * any_value(dl) * n) // l AS m, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM d), size GROUP BY doc_id, term, n, l),
w AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM post, size GROUP BY term, n),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM (SELECT item_id, unnest(ws) AS term FROM i) JOIN w USING (term) JOIN post USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
