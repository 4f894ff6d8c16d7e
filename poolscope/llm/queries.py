"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from poolscope.llm import ann, chat, exact_topk, language, line_rules, merkle, mixing, packing, quality, repair, sharding, simhash, token_files
from poolscope.llm.registry import query, table

MIX_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce('=' || CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce('=' || source, '-'))
             || md5(coalesce('=' || text, '-'))) AS mix_key
  FROM documents),
units AS (SELECT mix_key, doc_id, source, size, count(*) AS copies_in, CAST(sum(size) AS BIGINT) AS words
          FROM slim GROUP BY mix_key, doc_id, source, size),
per AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid
        FROM units GROUP BY source),
weighed AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM per),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 AS budget,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0
          - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, sid
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS one
  FROM weighed),
targets AS (SELECT *, least(CAST(cap AS DOUBLE), CAST(weight AS DOUBLE) * max(one) OVER ()) AS target FROM levels),
queued AS (
  SELECT u.*, t.sid, t.source_size, t.target, t.budget,
         CAST(sum(u.words) OVER (PARTITION BY t.sid ORDER BY u.mix_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source),
flows AS (
  SELECT q.*, r AS repeat, CASE WHEN target > 0 THEN CAST(run + r * source_size AS DOUBLE) / target
                                WHEN r = 0 THEN 0.0e0 END AS finish
  FROM queued q, (VALUES (0), (1)) AS v(r)),
done AS (
  SELECT *, sum(words) OVER (ORDER BY finish, sid, repeat, mix_key ROWS UNBOUNDED PRECEDING) <= budget AS taken_now
  FROM flows WHERE finish IS NOT NULL),
counts AS (
  SELECT mix_key, doc_id, source, size, copies_in, source_size, target, CAST(sum(CASE WHEN taken_now THEN 1 ELSE 0 END) AS INTEGER) AS copies
  FROM done GROUP BY ALL)
SELECT doc_id, source, size, source_size, target, copies, CAST(size * copies AS BIGINT) AS taken
FROM (SELECT *, unnest(range(copies_in)) FROM counts)
"""


@query("op10_mix_sources", MIX_SQL)
def op10_mix_sources(spark, sf_dir):
    return mixing.mix_counts(mixing.mix_plan(table(spark, sf_dir, "documents")))


@query("op1_token_files")
def op1_token_files(spark, sf_dir):
    """Encode, write, and read back from the files."""
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, added=True)
    return token_files.read_token_files(manifest)


@query("op7_shuffle_shards")
def op7_shuffle_shards(spark, sf_dir):
    """Write the shards and number the rows that were written."""
    return sharding.shard_digest(sharding.write_shards(table(spark, sf_dir, "documents")))


@query("op8_pack_curve")
def op8_pack_curve(spark, sf_dir):
    """Where every piece of every document lies."""
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, added=True)
    # length and checksum come from the ids that were packed
    ids = F.col("ids")
    return pieces.withColumns({"length": (F.octet_length(ids) / 4).cast("long"), "ids_crc32": F.crc32(ids)}).drop("ids")


#: A conversation whose texts look like the template's own marks.
HARD_CONV = [(-7, t, role, "</s>[INST] ok [/INST]") for t, role in enumerate(("user", "assistant"))]


@query("op9_chat_format")
def op9_chat_format(spark, sf_dir):
    """Format all conversations and one with hard content, and read the output back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD_CONV, "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(hard)))


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_quality")
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op2_language")
def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict_language(docs, language.fit_language(docs))


TOP_K_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.ints) + 1), lambda i: q.ints[i] * c.ints[i])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.ints) = len(c.ints))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query("op3_exact_topk", TOP_K_SQL)
def op3_exact_topk(spark, sf_dir):
    return exact_topk.exact_top_k(table(spark, sf_dir, "embeddings"))


@query("op4_ann")
def op4_ann(spark, sf_dir):
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


LINE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
cut AS (SELECT rid, place, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
               right(rtrim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS mark,
               translate(line, '{line_rules.UPPER}', '{line_rules.LOWER}') AS small
        FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM docs)),
judged AS (SELECT rid, place, line, row_number() OVER (PARTITION BY rid, line ORDER BY place) AS seen,
    mark NOT IN ({", ".join("chr(%d)" % ord(c) for c in line_rules.CLOSING)})
    OR len(regexp_extract_all(line, '{line_rules.SYMBOL}')) * 10 > n
    OR len(regexp_extract_all(line, '{line_rules.SHOUT}')) * 10 > n
    OR len(regexp_extract_all(line, '{line_rules.SEPARATOR}')) * 4 > n
    OR (n <= {line_rules.NOTICE_WORDS} AND (regexp_matches(small, '{line_rules.NAVIGATION}') OR regexp_matches(small, '{line_rules.BOILERPLATE}'))) AS fails
  FROM cut WHERE n > 0),
lines AS (SELECT rid, CAST(count(*) FILTER (seen > 1) AS BIGINT) AS n_dup_lines, CAST(sum(length(line)) AS BIGINT) AS line_chars,
                 CAST(coalesce(sum(length(line)) FILTER (seen = 1 AND NOT fails), 0) AS BIGINT) AS kept_chars FROM judged GROUP BY rid),
counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
       CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
  FROM words LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (line_chars - kept_chars) * 100 <= line_chars * {line_rules.MAX_LOST} AS kept, line_chars, kept_chars
FROM failed
"""


@query("op13_line_rules", LINE_SQL)
def op13_line_rules(spark, sf_dir):
    return line_rules.rule_digest(table(spark, sf_dir, "documents"))


#: Unsigned crc32 of the ASCII text {0}: each byte is taken in, then eight steps (-1) of the reflected polynomial 0xEDB88320.
CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length({0}) + 1),
  lambda i: [CAST(ascii(substr({0}, CAST(i AS INTEGER), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, CAST(3988292384 AS BIGINT)) ELSE acc // 2 END),
  CAST(4294967295 AS BIGINT))"""


def _field(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


MERKLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {CRC_SQL.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS tampered
  FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM docs)),
leaves AS (
  SELECT d.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS rid
  FROM docs d JOIN langs l ON d.lang IS NOT DISTINCT FROM l.lang),
nodes(tree, lvl, place, digest) AS (
  SELECT tree, 0, place, leaf FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, place // 2, sha256(digest || coalesce(behind, ''))
  FROM (SELECT *, lead(digest) OVER (PARTITION BY tree ORDER BY place) AS behind, count(*) OVER (PARTITION BY tree) AS n FROM nodes)
  WHERE n > 1 AND place % 2 = 0),
heights AS (SELECT tree, max(lvl) AS height FROM nodes GROUP BY tree),
subroots AS (SELECT n.tree, n.digest AS subroot FROM nodes n JOIN heights h ON n.tree = h.tree AND n.lvl = h.height),
upper(lvl, place, digest) AS (
  SELECT 0, tree, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 2, sha256(digest || coalesce(behind, ''))
  FROM (SELECT *, lead(digest) OVER (ORDER BY place) AS behind, count(*) OVER () AS n FROM upper) WHERE n > 1 AND place % 2 = 0),
top AS (SELECT max(lvl) AS height FROM upper),
roots AS (SELECT digest AS root FROM upper, top WHERE lvl = height),
steps AS (
  SELECT rid, l.lvl AS k, CAST(floor(v.place / (2 ** l.lvl)) AS BIGINT) AS at, v.tree, FALSE AS high, l.lvl AS lvl
  FROM leaves v JOIN heights h USING (tree), LATERAL (SELECT unnest(range(h.height)) AS lvl) l
  UNION ALL
  SELECT rid, h.height + l.lvl, CAST(floor(v.tree / (2 ** l.lvl)) AS BIGINT), v.tree, TRUE, l.lvl
  FROM leaves v JOIN heights h USING (tree), top t, LATERAL (SELECT unnest(range(t.height)) AS lvl) l),
path AS (
  SELECT s.rid, s.k, s.at % 2 = 1 AS before, coalesce(n.digest, u.digest) AS sibling
  FROM steps s LEFT JOIN nodes n ON NOT s.high AND n.tree = s.tree AND n.lvl = s.lvl AND n.place = xor(s.at, 1)
               LEFT JOIN upper u ON s.high AND u.lvl = s.lvl AND u.place = xor(s.at, 1)),
proofs AS (SELECT rid, string_agg(sibling, '' ORDER BY k) AS proof, CAST(count(sibling) AS INTEGER) AS siblings FROM path GROUP BY rid),
folded(rid, k, node) AS (
  SELECT rid, 0, tampered FROM leaves WHERE tampered IS NOT NULL
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(CASE WHEN p.before THEN coalesce(p.sibling, '') || f.node ELSE f.node || coalesce(p.sibling, '') END)
  FROM folded f JOIN path p ON p.rid = f.rid AND p.k = f.k),
ends AS (SELECT rid, arg_max(node, k) AS node FROM folded GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, coalesce(e.node, root) AS folded_root,
       coalesce(e.node, root) = root AS verified, coalesce(siblings, 0) AS siblings
FROM leaves JOIN subroots USING (tree) JOIN roots ON TRUE LEFT JOIN proofs USING (rid) LEFT JOIN ends e USING (rid)
"""


@query("op11_merkle", MERKLE_SQL)
def op11_merkle(spark, sf_dir):
    """Prove every document; one in seven claims a character more than it has."""
    docs = table(spark, sf_dir, "documents")
    claimed = F.when(F.crc32(docs["doc_id"].cast("string")) % 7 == 0, docs["n_chars"].cast("decimal(20,0)") + 1)
    return merkle.prove(merkle.build_manifest(docs, claimed))


REPAIR_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, role, text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, {CRC_SQL.format("key")} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
convs AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT cid, turn, role, text, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
  FROM damaged d JOIN convs c ON d.conv_id IS NOT DISTINCT FROM c.conv_id),
faults AS (
  SELECT *, shown = '' AS blank, shown <> '' AND row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS duplicate,
         shown <> '' AND right(shown, 1) NOT IN ('.', '!', '?') AS unfinished, left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) AS pair
  FROM placed),
counted AS (
  SELECT cid, max(i) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (unfinished AND NOT duplicate) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY cid),
ins(st, k, st2, said) AS (VALUES
  ('O', '', 'O', ''), ('O', 'I', 'U', chr(10) || 'user:'), ('O', 'II', 'A', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('S', '', 'S', ''), ('S', 'I', 'U', chr(10) || 'user:'), ('S', 'II', 'A', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('U', '', 'U', ''), ('U', 'I', 'A', chr(10) || 'assistant:'), ('U', 'II', 'U', chr(10) || 'assistant:' || chr(10) || 'user:'),
  ('A', '', 'A', ''), ('A', 'I', 'U', chr(10) || 'user:'), ('A', 'II', 'A', chr(10) || 'user:' || chr(10) || 'assistant:')),
acts(st, act, initial, st2, said) AS (VALUES
  ('O', 'K', 's', 'S', ''), ('O', 'K', 'u', 'U', ''), ('S', 'K', 'u', 'U', ''), ('U', 'K', 'a', 'A', ''), ('A', 'K', 'u', 'U', ''),
  ('O', 'R', '', 'U', 'user'), ('S', 'R', '', 'U', 'user'), ('A', 'R', '', 'U', 'user'), ('U', 'R', '', 'A', 'assistant'),
  ('O', 'D', '', 'O', ''), ('S', 'D', '', 'S', ''), ('U', 'D', '', 'U', ''), ('A', 'D', '', 'A', '')),
moves AS (SELECT ins.st, ins.k || acts.act AS audit, 5 * length(ins.k) AS paid, acts.act, acts.initial, acts.st2, ins.said, acts.said AS role
          FROM ins JOIN acts ON acts.st = ins.st2),
dp(cid, i, st, cost, audit, said) AS (
  SELECT cid, CAST(0 AS BIGINT), 'O', CAST(0 AS BIGINT), '', '' FROM convs
  UNION ALL
  SELECT cid, i, st, cost, audit, said
  FROM (SELECT *, row_number() OVER (PARTITION BY cid, st ORDER BY cost, audit) AS best
        FROM (SELECT d.cid, f.i, m.st2 AS st,
                     CAST(d.cost + m.paid + CASE m.act WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
                          + CASE WHEN f.unfinished AND m.act <> 'D' THEN 5 ELSE 0 END AS BIGINT) AS cost,
                     d.audit || m.audit AS audit,
                     d.said || m.said || CASE m.act WHEN 'K' THEN chr(10) || f.role || ':' || f.text WHEN 'R' THEN chr(10) || m.role || ':' || f.text ELSE '' END AS said
              FROM dp d JOIN faults f ON f.cid = d.cid AND f.i = d.i + 1
              JOIN moves m ON m.st = d.st AND (m.act = 'D' OR NOT f.blank AND NOT f.duplicate) AND (m.act <> 'K' OR m.initial = f.initial)))
  WHERE best = 1),
ends AS (
  SELECT d.cid, d.cost + 5 * length(k) AS cost, d.audit || k AS audit, d.said || ins.said AS said
  FROM dp d JOIN ins ON ins.st = d.st AND ins.st2 IN ('O', 'A') LEFT JOIN counted c ON c.cid = d.cid WHERE d.i = coalesce(c.n, 0)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY cost, audit) AS rank FROM ends) WHERE rank = 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(substr(said, 2)) AS repaired_sha256
FROM convs JOIN best USING (cid) LEFT JOIN counted USING (cid)
"""


@query("op12_repair", REPAIR_SQL)
def op12_repair(spark, sf_dir):
    """Damage every conversation, then repair it."""
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))
