"""The registered queries of this subpackage, over whole tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, langid, manifest, near_dup, pii, reputation, secrets, sharding, toxicity, vectors, warc

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, BPE_RANKS).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _remainder(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def learnable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a toxicity model may learn from."""
    return table(spark, sf_dir, "labels").where(_remainder(4) != 2)


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, learnable_labels(spark, sf_dir))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op3_marginal_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out), PIECES)
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_warc_in_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs), ["doc_id"])
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [n(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op8_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    digest = F.sha2(secrets.joined(F.col("base_spans")), 256)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), digest.alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH item_words AS (SELECT item_id, row_number() OVER () AS item_row, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
doc_words AS (SELECT doc_id, row_number() OVER () AS doc_row, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
item_sets AS (SELECT DISTINCT item_id, item_row, least(5, len(w)) AS k, array_to_string(w[i:i + 4], ' ') AS s FROM item_words, unnest(range(1, greatest(2, len(w) - 3))) AS u(i) WHERE len(w) > 0),
doc_sets AS (SELECT DISTINCT doc_id, doc_row, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM doc_words, (SELECT DISTINCT k FROM item_sets) AS lengths, unnest(range(1, greatest(1, len(w) - k + 2))) AS u(i)),
sizes AS (SELECT item_row, count(*) AS n_item FROM item_sets GROUP BY item_row),
shared AS (SELECT doc_id, doc_row, item_id, item_row, count(*) AS n_shared FROM doc_sets JOIN item_sets USING (s, k) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM shared JOIN sizes USING (item_row) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""


def op9_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.range_join(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP9_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM component LEFT JOIN counts USING (vec_id)
"""


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dup.jaccard_join(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "group_id", "n_links", (F.col("uid") == F.col("group_uid")).alias("kept"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and bad of labelled pages: labels are given by number, and a page of low quality or with toxic text is bad."""
    said = F.greatest(F.col("toxic") == 1, F.col("quality") == 0)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), said.alias("bad"))


def op11_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = reputation.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "n_labelled", "n_bad")


OP11_SQL = r"""
WITH RECURSIVE fixed AS (
  SELECT 0.3 AS cut, 0.9 AS confidence, ['ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'net.au', 'or.jp', 'org.au', 'org.uk'] AS suffixes,
  list_transform(range(201), lambda k: -4.5 + k * 0.06) AS nodes),
rules(action, zone, prefix) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
said AS (SELECT doc_id AS page_id, max(CASE WHEN greatest((toxic = 1)::INT, (quality = 0)::INT) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND coalesce(toxic, quality) IS NOT NULL GROUP BY 1),
counts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS x, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS bare FROM parsed LEFT JOIN said USING (page_id) WHERE host <> '' GROUP BY host),
split AS (SELECT *, string_split(bare, '.') AS l, CASE WHEN len(l) >= 2 THEN l[-2] || '.' || l[-1] ELSE bare END AS two FROM counts),
hosts AS (SELECT host, n, x, CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[') THEN bare WHEN two IN (SELECT unnest(suffixes) FROM fixed) THEN array_to_string(l[-3:], '.') ELSE two END AS domain,
  CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[') THEN bare WHEN two IN (SELECT unnest(suffixes) FROM fixed) THEN two ELSE l[-1] END AS suffix FROM split),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL),
tops AS (SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT (sum(x) + 0.5::DOUBLE) / (sum(n) + 1) FROM hosts) AS m FROM domains GROUP BY suffix),
s1 AS (SELECT least(greatest(coalesce(sum((x - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1::DOUBLE / 3), 1e-4), 0.99) AS r FROM tops WHERE n > 0),
tops2 AS (SELECT suffix, (m * (1 / r - 1) + x) / ((1 / r - 1) + n) AS m FROM tops, s1),
doms AS (SELECT d.*, t.m FROM domains d JOIN tops2 t USING (suffix)),
s2 AS (SELECT least(greatest(coalesce(sum((x - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1::DOUBLE / 3), 1e-4), 0.99) AS r FROM doms WHERE n > 0),
doms2 AS (SELECT domain, (m * (1 / r - 1) + x) / ((1 / r - 1) + n) AS m FROM doms, s2),
own AS (SELECT h.*, d.m FROM hosts h JOIN doms2 d USING (domain)),
s3 AS (SELECT least(greatest(coalesce(sum((x - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1::DOUBLE / 3), 1e-4), 0.99) AS r FROM own WHERE n > 0),
beta AS (SELECT host, n, x, m * (1 / r - 1) + x AS a, (1 - m) * (1 / r - 1) + n - x AS b FROM own, s3),
points AS (SELECT *, cut, ln(cut / (1 - cut)) AS t, sqrt(1 / a + 1 / b) AS s, ln(a / b) AS mode, unnest(nodes) AS v FROM beta, fixed),
sides AS (SELECT *, t + s * exp(v - exp(-v)) AS up, t - s * exp(v - exp(-v)) AS down, exp(v - exp(-v)) * (1 + exp(-v)) AS w, a * mode - (a + b) * (greatest(mode, 0) + ln(1 + exp(-abs(mode)))) AS top FROM points),
mass AS (SELECT host, any_value(n) AS n, any_value(x) AS x, any_value(mode > t) AS over, sum(w * exp(a * up - (a + b) * (greatest(up, 0) + ln(1 + exp(-abs(up)))) - top)) AS above,
  sum(w * exp(a * down - (a + b) * (greatest(down, 0) + ln(1 + exp(-abs(down)))) - top)) AS below FROM sides GROUP BY host),
judged AS (SELECT host, n, x, CASE WHEN above + below > 0 THEN above / (above + below) ELSE over::INT END >= (SELECT confidence FROM fixed) AS bad FROM mass),
fits AS (SELECT page_id, host, path, arg_max(struct_pack(action := action, rule := zone || prefix), length(zone || prefix)) AS fit FROM (SELECT DISTINCT page_id, host, path FROM parsed) p
  JOIN rules ON (host = zone OR ends_with(host, '.' || zone)) AND starts_with(path, prefix) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, fit.rule AS rule, coalesce(fit.action, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, coalesce(n, 0)::BIGINT AS n_labelled, coalesce(x, 0)::BIGINT AS n_bad
FROM parsed p LEFT JOIN judged j ON p.host = j.host LEFT JOIN fits f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w2.doc_id > least, false)] AS f
  FROM words w2 LEFT JOIN said ON w2.doc_id = said.doc_id),
kinds AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
perm(o, k) AS (SELECT '', 0 UNION ALL SELECT o || c, k + 1 FROM perm, unnest(['A', 'B', 'C', 'D', 'E']) AS u(c) WHERE k < 5 AND NOT contains(o, c)),
steps AS (SELECT o, step, ascii(o[step]) - 64 AS i, list_transform(range(1, step), lambda j: ascii(o[j]) - 64) AS before FROM perm, range(1, 6) AS r(step) WHERE k = 5),
gone AS (SELECT part, o AS filter_order, step, i, n, good, toxic, f[i] AS failing, len(list_filter(before, lambda j: f[j])) > 0 AS earlier, len(list_filter(f, lambda x: x)) AS fails FROM kinds, steps),
sums AS (SELECT part, filter_order, step, i, sum(CASE WHEN NOT earlier AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN failing AND NOT earlier THEN n ELSE 0 END) AS removed, sum(CASE WHEN failing AND earlier THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN failing AND fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN failing AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost FROM gone GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM sums
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = {"n_chars": F.col("n_chars") + F.when(_remainder(7) == 0, 1).otherwise(0)}
    rows = manifest.manifest(docs, changed)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP13_SQL = """
WITH RECURSIVE checked AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda k, i: xor(k >> 1, 3988292384 * (k & 1))))) AS crc FROM documents),
claims AS (SELECT *, n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS claimed, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail FROM checked),
leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(strlen(claimed::VARCHAR) || ':' || claimed, '-') || tail) AS claim FROM claims),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM leaves),
nodes(level, lang, pos, h) AS (SELECT 0, lang, pos, leaf FROM placed UNION ALL
  SELECT level + 1, lang, pos // 2, sha256(h || coalesce(after, '')) FROM (SELECT *, lead(h) OVER w AS after, max(pos) OVER (PARTITION BY lang) AS last FROM nodes WINDOW w AS (PARTITION BY lang ORDER BY pos)) WHERE last > 0 AND pos % 2 = 0),
subroots AS (SELECT lang, arg_max(h, level) AS subroot, max(level) AS height, row_number() OVER (ORDER BY lang::BLOB NULLS FIRST) - 1 AS pos FROM nodes GROUP BY lang),
uppers(level, pos, h) AS (SELECT 0, pos, subroot FROM subroots UNION ALL
  SELECT level + 1, pos // 2, sha256(h || coalesce(after, '')) FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS after, max(pos) OVER () AS last FROM uppers) WHERE last > 0 AND pos % 2 = 0),
tops AS (SELECT arg_max(h, level) AS root, max(level) AS height FROM uppers),
upper_path AS (SELECT s.lang, list(struct_pack(sibling := u.h, odd := (s.pos >> u2.l) % 2) ORDER BY u2.l) AS path FROM subroots s, (SELECT DISTINCT level AS l FROM uppers) u2 LEFT JOIN uppers u ON u.level = u2.l AND u.pos = xor(s.pos >> u2.l, 1) WHERE u2.l < (SELECT height FROM tops) GROUP BY s.lang),
lower_path AS (SELECT p.lang, p.pos, list(struct_pack(sibling := n.h, odd := (p.pos >> l) % 2) ORDER BY l) AS path FROM (SELECT p.lang, p.pos, unnest(range(s.height)) AS l FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang) p
  LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.level = l AND n.pos = xor(p.pos >> l, 1) GROUP BY p.lang, p.pos),
paths AS (SELECT p.doc_id, leaf, claim, subroot, root, coalesce(l.path, []) || coalesce(u.path, []) AS path FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN lower_path l ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
  LEFT JOIN upper_path u ON p.lang IS NOT DISTINCT FROM u.lang, tops),
folded AS (SELECT *, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.sibling), ''), '')) AS proof_sha256,
  list_reduce(list_prepend(struct_pack(sibling := claim, odd := 0::BIGINT), path), lambda a, x: struct_pack(sibling := CASE WHEN x.sibling IS NULL THEN sha256(a.sibling) WHEN x.odd = 1 THEN sha256(x.sibling || a.sibling) ELSE sha256(a.sibling || x.sibling) END, odd := 0::BIGINT)).sibling AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_counterfactual_toxicity, op3_marginal_langid, op4_best_fit_shards, op5_warc_in_zip, op6_benchmark_containment, op7_skip_chain_pii, op8_randomness_secrets, op9_metric_range_join, op10_chosen_path_join, op11_host_reputation, op12_filter_audit, op13_merkle_manifest)}
ORACLE_SQL: dict[str, str] = {"op6_benchmark_containment": OP6_SQL, "op9_metric_range_join": OP9_SQL, "op11_host_reputation": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
