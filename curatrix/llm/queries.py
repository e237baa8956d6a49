"""The thin opN_<name> queries over the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import chat, exact, fingerprints, jaccard, language, manifest, mixing, mixture, packing, pieces, prefixes, secret_scan, toxicity
from curatrix.llm.common import crc_mod, table

PIECE_MODEL = "piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.decode(pieces.encode(docs, PIECE_MODEL).select("doc_id", "ids"), PIECE_MODEL)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    model = language.train(docs.where("not held_out"))
    return language.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", F.to_json("proportions").alias("proportions"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the token ids that op1 gives each document go."""
    return packing.best_fit(packing.token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 10) != 0).alias("train"))
    return mixing.score(docs).withColumn("held_out", ~F.col("train")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = secret_scan.train(secret_scan.labelled_samples(spark, docs))
    s = F.col("spans")
    out = secret_scan.scan(docs, ratios).select("doc_id", "spans")
    return out.select("doc_id", *(secret_scan.count_kind(s, k).alias(f"n_{k}") for k in secret_scan.KINDS), F.sha2(secret_scan.listed(secret_scan.base_only(s)), 256).alias("base_sha256"), secret_scan.listed(s).alias("spans"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.link_components(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id", "class_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
k AS (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS k FROM s GROUP BY doc_id),
q AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM k)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id, coalesce(q.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id LEFT JOIN q USING (doc_id)
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = chat.read_back(chat.format_trees(turns.unionByName(probe)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


_ESCAPES = " + ".join(f"len(regexp_extract_all(x, '{chat.sql_pattern(c)}'))" for c in chat.CONTROL)
OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, (SELECT {_ESCAPES} FROM (SELECT role AS x)) + (SELECT {_ESCAPES} FROM (SELECT text AS x)) AS escapes FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS lost,
    CAST(sum(length(role) + length(text) + {len(chat.formatted_turn("", ""))} + escapes) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars FROM g
"""


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = rf"""
WITH w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM w GROUP BY source),
o AS (SELECT *, [5.0, 2.0, 1.0][1 + (place - 1) % 3]::DOUBLE AS weight, sum(source_size) OVER ()::BIGINT AS everything FROM p),
b AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS bounds,
  sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o),
f AS (SELECT *, (everything - bounds) * weight > 3.0::DOUBLE * source_size * weights AS whole FROM b),
t AS (SELECT *, CASE WHEN whole THEN 3.0::DOUBLE * source_size ELSE weight * (everything - coalesce(sum(3 * source_size) FILTER (whole) OVER (), 0)::DOUBLE) / sum(weight) FILTER (NOT whole) OVER () END AS target,
  greatest(ceil(source_size / {mixture.SHARD_WORDS}), 1)::BIGINT AS shards, round(everything / {mixture.BLOCK_WORDS})::BIGINT AS blocks FROM f),
-- every quotient that can win: a source gets at most its share of the blocks and one for each source more
q1 AS (SELECT place, count(*) AS quota FROM (SELECT place, row_number() OVER (ORDER BY bid DESC, place) <= blocks AS won
  FROM (SELECT place, blocks, target / (2 * unnest(range(1, (blocks * target / everything)::BIGINT + (SELECT count(*) FROM t) + 2)) - 1) AS bid FROM t WHERE target > 0)) WHERE won GROUP BY place),
s AS (SELECT t.*, quota, ceil(sqrt(shards))::BIGINT AS racks, ceil(shards / ceil(sqrt(shards)))::BIGINT AS each FROM t LEFT JOIN q1 USING (place)),
d AS (SELECT w.*, source_size, target, place, quota, ('0x' || key[1:8])::BIGINT % racks AS rack, ('0x' || key[9:16])::BIGINT % each AS shard FROM w JOIN s ON w.source IS NOT DISTINCT FROM s.source),
r AS (SELECT place, rack, sum(size)::BIGINT AS words, any_value(quota) AS quota, sum(sum(size)) OVER (PARTITION BY place) AS of_all, count(*) OVER (PARTITION BY place) AS n FROM d WHERE size > 0 GROUP BY place, rack),
q2 AS (SELECT place, rack, count(*) AS quota FROM (SELECT place, rack, row_number() OVER (PARTITION BY place ORDER BY bid DESC, rack) <= quota AS won
  FROM (SELECT place, rack, quota, words / (2 * unnest(range(1, (quota * words / of_all)::BIGINT + n + 2)) - 1) AS bid FROM r)) WHERE won GROUP BY ALL),
h AS (SELECT d.place, d.rack, shard, sum(size)::BIGINT AS words, any_value(q2.quota) AS quota, sum(sum(size)) OVER (PARTITION BY d.place, d.rack) AS of_all, count(*) OVER (PARTITION BY d.place, d.rack) AS n
  FROM d LEFT JOIN q2 ON d.place = q2.place AND d.rack = q2.rack WHERE size > 0 GROUP BY d.place, d.rack, shard),
q3 AS (SELECT place, rack, shard, count(*) AS quota FROM (SELECT place, rack, shard, row_number() OVER (PARTITION BY place, rack ORDER BY bid DESC, shard) <= quota AS won
  FROM (SELECT place, rack, shard, quota, words / (2 * unnest(range(1, (quota * words / of_all)::BIGINT + n + 2)) - 1) AS bid FROM h WHERE quota > 0)) WHERE won GROUP BY ALL),
g AS (SELECT h.place, h.rack, h.shard, words, least(coalesce(q3.quota, 0) * {mixture.BLOCK_WORDS}, 3 * words) AS gives FROM h LEFT JOIN q3 ON h.place = q3.place AND h.rack = q3.rack AND h.shard = q3.shard),
k AS (SELECT place, rack, shard, n * {mixture.BLOCK_WORDS} AS a, least({mixture.BLOCK_WORDS}, words - n * {mixture.BLOCK_WORDS}) AS len, gives % words AS rest, md5(concat_ws(':', '0', place, rack, shard, n)) AS lot, n
  FROM (SELECT *, unnest(range(0, (words - 1) // {mixture.BLOCK_WORDS} + 1)) AS n FROM g)),
x AS (SELECT place, rack, shard, a, greatest(0, least(len, rest - (sum(len) OVER (PARTITION BY place, rack, shard ORDER BY lot, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len))) AS take FROM k),
e AS (SELECT d.*, gives // words AS rounds, sum(size) OVER (PARTITION BY d.place, d.rack, d.shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS a
  FROM d JOIN g ON d.place = g.place AND d.rack = g.rack AND d.shard = g.shard WHERE size > 0),
m AS (SELECT e.doc_id, e.size, any_value(source_size) AS source_size, any_value(target) AS target, any_value(rounds) * e.size + coalesce(sum(greatest(0, least(e.a + e.size, x.a + take) - greatest(e.a, x.a))) FILTER (x.a IS NOT NULL), 0) AS taken
  FROM e LEFT JOIN x ON e.place = x.place AND e.rack = x.rack AND e.shard = x.shard AND x.a < e.a + e.size AND x.a + take > e.a GROUP BY e.doc_id, e.size, e.a, e.place, e.rack, e.shard)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM m UNION ALL SELECT doc_id, size, source_size, target, 0 FROM d WHERE size = 0
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def crc32_sql(text: str) -> str:
    """crc32 of a text of ASCII characters, in DuckDB, which has none."""
    step = "list_reduce(list_concat([xor(u, b)], range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)), lambda u, b: {step}), 4294967295::BIGINT)"


OP12_SQL = f"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM c)),
parts AS (SELECT ids.conv_id, 0 AS lent, i, role, text FROM ids JOIN c ON c.conv_id = ids.conv_id - ids.conv_id % 5 AND i <= h UNION ALL SELECT ids.conv_id, 1, i, role, text FROM ids JOIN c ON c.conv_id = ids.conv_id AND i > h),
convs AS (SELECT ids.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY lent, i) FILTER (role IS NOT NULL), []) AS turns FROM ids LEFT JOIN parts USING (conv_id) GROUP BY ids.conv_id),
members AS (SELECT conv_id, len(turns) AS n, d, turns[:d] AS path FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM convs)),
nodes AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM members GROUP BY d, path),
kids AS (SELECT d - 1 AS d, path[:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[d].text) END AS saved FROM nodes LEFT JOIN kids USING (d, path)),
sums AS (SELECT a.d, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens FROM own a JOIN own b ON b.d >= a.d AND b.path[:a.d] = a.path GROUP BY a.d, a.path)
SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, sha256(own.ends) AS ends_sha256
FROM own JOIN sums USING (d, path) LEFT JOIN own up ON up.d = own.d - 1 AND up.path = own.path[:own.d - 1]
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered rows, those whose crc32 is even, lose their line ends."""
    docs = table(spark, sf_dir, "documents").select(*manifest.COLUMNS)
    return manifest.prove(docs, {"text": F.replace(docs["text"], F.lit("\n"), F.lit(""))}, crc_mod("doc_id", 2) == 0)


_LEAF = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
OP13_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, source, {_LEAF("text")} AS leaf, CASE WHEN {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS sent FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM l),
a AS (SELECT source, 0 AS level, place, n, leaf AS digest FROM r UNION ALL SELECT source, level + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY place)) FROM a WHERE n > 1 GROUP BY source, level, place // 3),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM a WHERE n = 1),
b AS (SELECT 0 AS level, rank AS place, (SELECT count(*) FROM s) AS n, subroot AS digest FROM s UNION ALL SELECT level + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY place)) FROM b WHERE n > 1 GROUP BY level, place // 3),
path AS (SELECT doc_id, leaf, sent, 0 AS tree, x.level, x.place AS at, x.place < r.place // (3 ** x.level)::BIGINT AS before, digest FROM r JOIN a x ON x.source IS NOT DISTINCT FROM r.source AND x.n > 1 AND x.place // 3 = (r.place // (3 ** x.level)::BIGINT) // 3
  UNION ALL SELECT doc_id, leaf, sent, 1, x.level, x.place, x.place < rank // (3 ** x.level)::BIGINT, digest FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source JOIN b x ON x.n > 1 AND x.place // 3 = (rank // (3 ** x.level)::BIGINT) // 3),
own AS (SELECT r.doc_id, r.leaf, 0 AS tree, x.level, x.place AS at FROM r JOIN a x ON x.source IS NOT DISTINCT FROM r.source AND x.n > 1 AND x.place = r.place // (3 ** x.level)::BIGINT UNION ALL SELECT r.doc_id, r.leaf, 1, x.level, x.place FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source JOIN b x ON x.n > 1 AND x.place = rank // (3 ** x.level)::BIGINT),
sides AS (SELECT p.doc_id, p.leaf, p.sent, row_number() OVER (PARTITION BY p.doc_id, p.leaf ORDER BY p.tree, p.level) AS step, coalesce(string_agg(digest, '' ORDER BY p.at) FILTER (p.at < o.at), '') AS lefts, coalesce(string_agg(digest, '' ORDER BY p.at) FILTER (p.at > o.at), '') AS rights
  FROM path p JOIN own o ON o.doc_id IS NOT DISTINCT FROM p.doc_id AND o.leaf = p.leaf AND o.tree = p.tree AND o.level = p.level GROUP BY p.doc_id, p.leaf, p.sent, p.tree, p.level),
walk AS (SELECT doc_id, leaf, 0 AS step, sent AS digest FROM r UNION ALL SELECT w.doc_id, w.leaf, w.step + 1, sha256(lefts || digest || rights) FROM walk w JOIN sides p ON p.doc_id IS NOT DISTINCT FROM w.doc_id AND p.leaf = w.leaf AND p.step = w.step + 1),
last AS (SELECT doc_id, leaf, arg_max(digest, step) AS folded_root FROM walk GROUP BY doc_id, leaf),
proof AS (SELECT doc_id, leaf, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY doc_id, leaf)
SELECT r.doc_id, r.leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source JOIN (SELECT digest AS root FROM b WHERE n = 1) ON true JOIN last ON last.doc_id IS NOT DISTINCT FROM r.doc_id AND last.leaf = r.leaf LEFT JOIN proof ON proof.doc_id IS NOT DISTINCT FROM r.doc_id AND proof.leaf = r.leaf
"""


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_language, op3_best_fit_packing, op4_context_mixing, op5_exact_dedup, op6_fingerprints, op7_secret_scan, op8_ngram_jaccard, op9_chat_format, op10_toxicity, op11_source_mix, op12_conversation_trie, op13_merkle_manifest)}
SQL = {"op5_exact_dedup": OP5_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_chat_format": OP9_SQL, "op11_source_mix": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
