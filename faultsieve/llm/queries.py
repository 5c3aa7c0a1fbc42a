"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bag_ranking, line_winnow, permutation_index, quality_gam, secret_forest, sentencepiece_bpe, simhash_dedup, source_mix, sphere_means, tool_links, transport_stream, warc_zst, word_language
from .common import read


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(read(spark, sf_dir, "documents"), model_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zst.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(read(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slot", "source")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: What the tools of `tool_links.as_messages` take.
TOOLS = [("answer", "prompt", "string", True), ("answer", "turn", "integer", True), ("answer", "after", "string", False), ("configure", "instruction", "string", True)]


def op6_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', '{p}', '{k}', {str(r).lower()})" for t, p, k, r in TOOLS) + " AS t(tool, property, type, required)")
    return tool_links.link(tool_links.as_messages(read(spark, sf_dir, "conversations")), schemas)


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.digest(transport_stream.store(read(spark, sf_dir, "documents")))


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(read(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_winnow.line_dedup(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op11_bag_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_ranking.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("class_id")


def op12_sphere_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sphere_means.cluster(read(spark, sf_dir, "embeddings")).drop("scanned")


def op13_word_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_language.identify(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_warc, op3_secret_scan, op4_source_mix, op5_quality, op6_tool_links, op7_transport_stream, op8_permutation_index, op9_line_dedup, op10_simhash,
        op11_bag_ranking, op12_sphere_means, op13_word_language,
    )
}

#: Of equal payloads the largest page_id is the response. DuckDB has no base-32, so hex digits become bits, then letters.
OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS largest FROM d)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum([
    ((instr('0123456789abcdef', substr(h, (1 + (5 * i + j) // 4)::INT, 1)) - 1) // (2 ** (3 - (5 * i + j) % 4))::INT) % 2 * (2 ** (4 - j))::INT FOR j IN range(5)]))::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM m
"""

#: Each slot's source is the one that its point falls to; block k of a source goes to its slot k. The level of the targets is that of the first source, by cap and weight, that it does not fill.
OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, (sid - 1) % 3 + 1 AS weight, {source_mix.MOST_PASSES} * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
o AS (SELECT *, cap / weight AS ratio, CAST(total - (sum(cap) OVER f - cap) AS BIGINT) / CAST(sum(weight) OVER () - sum(weight) OVER f + weight AS BIGINT) AS level FROM w WHERE source_size > 0 WINDOW f AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT w.*, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, ratio) FILTER (WHERE level <= ratio) FROM o) * weight) AS target FROM w),
p AS (SELECT *, CAST(round(target) AS BIGINT) AS words, CAST(sum(round(target)) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto, CAST(sum(round(target)) OVER () AS BIGINT) AS whole FROM t WHERE source_size > 0),
e AS (SELECT sid, CAST(upto - words AS HUGEINT) * {source_mix.TURN} // whole AS lo, CAST(upto AS HUGEINT) * {source_mix.TURN} // whole AS hi FROM p),
b AS (SELECT least({source_mix.BLOCK_WORDS}, greatest(1, any_value(total) // {source_mix.SLOTS})) AS block, any_value(total) AS total FROM w),
n AS (SELECT slot, CAST(slot AS HUGEINT) * {source_mix.GOLDEN} % {source_mix.TURN} AS u FROM (SELECT unnest(range((total + block - 1) // block)) AS slot FROM b)),
k AS (SELECT n.slot, e.sid, row_number() OVER (PARTITION BY e.sid ORDER BY n.slot) - 1 AS k FROM n JOIN e ON n.u >= e.lo AND n.u < e.hi),
l AS (SELECT d.*, t.sid, t.source_size, t.target, CAST(sum(d.size) OVER (PARTITION BY t.sid ORDER BY md5('{source_mix.SEED}|' || doc_id || '|' || tie), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS start FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
h AS (SELECT doc_id, sid, start, size, source_size * pass + start AS first_, source_size * pass + start + size AS last_ FROM l CROSS JOIN (SELECT unnest(range({source_mix.MOST_PASSES})) AS pass) WHERE size > 0),
x AS (SELECT h.doc_id, h.sid, first_, last_, block, unnest(range(first_ // block, (last_ - 1) // block + 1)) AS k FROM h CROSS JOIN b),
y AS (SELECT x.doc_id, CAST(sum(least(last_, (x.k + 1) * block) - greatest(first_, x.k * block)) AS BIGINT) AS taken, min(slot) AS slot FROM x JOIN k ON k.sid = x.sid AND k.k = x.k GROUP BY 1)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(y.taken, 0) AS taken, y.slot, l.source FROM l LEFT JOIN y ON y.doc_id = l.doc_id
"""

#: Each user turn is a call, the assistant turn behind it its result; calls that need others stand behind them, those that wait for a circle at the end.
OP6_SQL = """
WITH RECURSIVE c AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind FROM conversations),
r AS (SELECT conv_id, before AS turn, arg_min(text, turn) AS result, true AS hit FROM c WHERE role NOT IN ('user', 'system') AND before IS NOT NULL GROUP BY 1, 2),
k AS (SELECT c.conv_id, c.turn, c.role, 'c' || c.conv_id || '-' || c.turn AS call_id, c.text, r.result, coalesce(r.hit, false) AS linked,
  CASE WHEN role <> 'user' THEN NULL WHEN behind IS NOT NULL AND md5('c' || c.conv_id || '-' || c.turn)[1] <= '3' THEN behind
    WHEN md5('c' || c.conv_id || '-' || before)[1] > '3' OR md5('c' || c.conv_id || '-' || before)[1] = '0' THEN before END AS after
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn AND c.role = 'user' WHERE c.role IN ('user', 'system')),
p AS (SELECT conv_id, turn AS key, turn AS spot, 0 AS step, after AS next, [turn] AS seen FROM k
  UNION ALL SELECT p.conv_id, p.key, k.turn, p.step + 1, k.after, list_append(p.seen, k.turn) FROM p JOIN k ON k.conv_id = p.conv_id AND k.turn = p.next WHERE NOT list_contains(p.seen, p.next)),
o AS (SELECT conv_id, key, max(struct_pack(a := spot, s := step)) AS place, bool_or(next IS NOT NULL AND list_contains(seen, next)) AS circle FROM p GROUP BY 1, 2),
e AS (SELECT k.*, o.place, o.circle, concat_ws(',', CASE WHEN circle THEN 'cycle' END, CASE WHEN text IS NULL THEN CASE role WHEN 'user' THEN 'missing:prompt' ELSE 'missing:instruction' END END) AS errors
  FROM k JOIN o ON o.conv_id = k.conv_id AND o.key = k.turn)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY circle, CASE WHEN NOT circle THEN place.a END, CASE WHEN NOT circle THEN place.s END, turn) - 1 AS position,
  call_id, CASE role WHEN 'user' THEN 'answer' ELSE 'configure' END AS name, linked, errors = '' AS valid, errors,
  '{"arguments":{' || CASE WHEN role = 'user' THEN concat_ws(',', '"after":"$c' || conv_id || '-' || after || '"', '"prompt":' || to_json(text), '"turn":' || turn) ELSE coalesce('"instruction":' || to_json(text), '') END
  || '},"id":"' || call_id || '","name":"' || CASE role WHEN 'user' THEN 'answer' ELSE 'configure' END || '","result":' || coalesce(to_json(result), 'null') || '}' AS json
FROM e
"""

#: Windows of lines that begin or end at each line, by content; all but the first occurrence go.
OP9_SQL = """
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text <> ''),
w AS (SELECT *, greatest(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')), 1) AS w FROM l),
b AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS after_, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS BIGINT) AS before FROM w),
f AS (SELECT doc_id, pos, list(line) OVER x AS content, sum(w) OVER x AS words FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL SELECT doc_id, min(pos) OVER x AS pos, list(line) OVER x AS content, sum(w) OVER x AS words FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY after_ RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
g AS (SELECT doc_id, pos, content, len(content) AS k FROM f WHERE words >= 50),
o AS (SELECT content, min(struct_pack(d := doc_id, p := pos)) AS first FROM g GROUP BY content),
gone AS (SELECT DISTINCT g.doc_id, unnest(range(g.pos, g.pos + k)) AS pos FROM g JOIN o USING (content) WHERE g.doc_id <> o.first.d OR g.pos <> o.first.p),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS text FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY 1)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_deleted, 0) AS n_deleted, coalesce(t.text, '') AS text FROM documents d LEFT JOIN t USING (doc_id)
"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{bag_ranking.UPPER}', '{bag_ranking.LOWER}'), '{bag_ranking.TERM}')"

#: Each document is scored by itself, with the weights of the terms that it shares with an item.
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
g AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY 1), g),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN w USING (term), g GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 AND doc_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {bag_ranking.MOST}
"""


def _op12_sql() -> str:
    """Every round compares all vectors with all centroids."""
    size, each = sphere_means.SIZE, f"range(1, {sphere_means.SIZE + 1})"
    code = f"sha256('{sphere_means.SEED}:' || vec_id)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({sphere_means.SCALE} * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings WHERE len(embedding) = {size} AND list_count(embedding) = {size} AND list_bool_and([isfinite(c) FOR c IN embedding]))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {code}, x) - 1 AS k, x FROM v WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY {code}, x) <= {sphere_means.CLUSTERS})",
    ]
    for n in range(sphere_means.ROUNDS + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS m FROM (SELECT v.r, c.k, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)]) AS BIGINT) AS d FROM v CROSS JOIN c{n} c) GROUP BY r)")
        if n < sphere_means.ROUNDS:
            parts.append(f"""u{n} AS MATERIALIZED (SELECT k, list(mean ORDER BY j) AS x FROM (SELECT k, j, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean
  FROM (SELECT a.m.k AS k, unnest({each}) AS j, unnest(v.x) AS e FROM a{n} a JOIN v USING (r)) GROUP BY 1, 2) GROUP BY k),
c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(u.x, c.x) AS x FROM c{n} c LEFT JOIN u{n} u USING (k))""")
    last = sphere_means.ROUNDS
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, CAST(a.m.k AS INTEGER) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{last} a JOIN v USING (r) JOIN c{last} c ON c.k = a.m.k
"""


OP12_SQL = _op12_sql()

ORACLE_SQL = {"op2_warc": OP2_SQL, "op4_source_mix": OP4_SQL, "op6_tool_links": OP6_SQL, "op9_line_dedup": OP9_SQL, "op11_bag_ranking": OP11_SQL, "op12_sphere_means": OP12_SQL}
