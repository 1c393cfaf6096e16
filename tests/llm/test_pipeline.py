"""The pipeline and the registered queries of the subpackage, on small tables and by brute force."""

import hashlib
import re
import struct
import zlib

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken

from loomframe.llm import bpe, decontaminate, near_dup, pii, queries, secrets, toxicity
from loomframe.llm.common import scratch_path

from .test_operators import battery_by_hand, brute_pii, brute_secrets


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "benchmark", "secrets", "tokens"]
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns
    counts = [stages[n].count() for n in ["documents", *names]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_toxicity_stage(spark, sf):
    # the smallest tables have too few labels to learn from
    larger = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, larger).collect()}
    toxic = {k for k, y in labels.items() if y}
    assert len(toxic & kept) <= 0.4 * len(toxic)
    assert len(labels.keys() - toxic - kept) <= 0.02 * len(labels)


def test_near_copies_stage(stages):
    rows = stages["toxicity"].select("doc_id", "text").collect()
    sets = [frozenset(decontaminate.exact_shingles(r.text)) for r in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= near_dup.THRESHOLD * len(a | sets[j]) - 1e-9:
                p, q = find(i), find(j)
                group[max(p, q)] = min(p, q)
    kept = {r.doc_id for r in stages["near_copies"].collect()}
    left = [find(i) for i, r in enumerate(rows) if r.doc_id in kept]
    assert len(left) == len(set(left)) == len({find(i) for i in range(len(rows))})


def test_near_copies_stage_with_repeated_rows(spark, sf):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a", 1)] * 30 + [(1, text, "b", 2)] * 3 + [(2, text + " more", "a", 1), (3, "other words that stand apart", "a", 1), (4, None, "a", 1), (4, None, "a", 1), (5, "?!", "a", 1), (None, text, "a", 1), (None, "alone in this", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rows string, kept int")
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, sf)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(False, 1, text), (False, 3, rows[34][1]), (False, 4, ""), (False, 4, ""), (False, 5, "?!"), (True, 0, "alone in this")])


def test_near_copies_join_alike_at_every_size(spark, sf, monkeypatch):
    """Texts meet keys by a shuffle however few there are, and rows of large buckets are joined once, with their pivot's sketch."""
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words, f"more{k}"])) for k in range(40)] + [(100 + k, f"other words {k} of this row {k * k}") for k in range(20)] + [(None, " ".join(words)), (0, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, split, compared = {}, near_dup._split, near_dup.compared
    monkeypatch.setattr(near_dup, "LEAF", 8)
    monkeypatch.setattr(near_dup, "_split", lambda met: split(plans.setdefault("split", met)))
    monkeypatch.setattr(near_dup, "compared", lambda blocks, t: compared(plans.setdefault("blocks", blocks), t))
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, sf)
    assert len({r.doc_id for r in kept.collect()}) == 21
    assert "Join" not in plan(plans["split"])
    texts = plan(plans["blocks"])
    assert "SortMergeJoin [k#" in texts and "BroadcastHashJoin [k#" not in texts
    assert "SortMergeJoin [coalesce(doc_id#" in plan(kept) and "BroadcastHashJoin" not in plan(kept)


def test_benchmark_stage(stages, spark, sf):
    items = [decontaminate.exact_shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = set()
    for r in stages["near_copies"].collect():
        own = decontaminate.exact_shingles(r.text)
        if not any(len(s & own) >= 0.8 * len(s) - 1e-9 for s in items if s):
            clean.add(r.doc_id)
    assert {r.doc_id for r in stages["benchmark"].collect()} == clean


def test_secret_and_token_stages(stages):
    before = {r.doc_id: r.text for r in stages["benchmark"].collect()}
    after = {r.doc_id: r for r in stages["secrets"].collect()}
    assert before.keys() == after.keys()
    changed = [k for k in before if before[k] != after[k].text]
    assert all("[SECRET]" in after[k].text and after[k].n_chars == len(after[k].text) for k in changed)
    assert not any(" token = " in r.text for r in after.values())
    for r in stages["tokens"].collect():
        assert r.decoded_sha256 == hashlib.sha256(after[r.doc_id].text.encode()).hexdigest()


def test_stages_on_odd_rows(spark, sf):
    rows = [(1, None, "en", "s", None), (1, None, "en", "s", None), (2, "", None, "s", 0), (3, "a b", "en", None, 3), (None, "secret = abcdefgh1", "en", "s", 18), (5, "z" * 20000, "en", "s", 20000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, f"odd-{name}")
            stage(spark, docs, sf).write.parquet(path)
            docs = spark.read.parquet(path)
        # one of the two rows that repeat without a word stays, or both: they link with nothing
        assert docs.count() in (n, max(0, n - 1))


def test_held_out_toxicity(spark, sf):
    rows = queries.op2_counterfactual_toxicity(spark, sf.replace("0.001", "0.01")).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.CUT) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_token_query_as_the_library(spark, sf):
    ranks = bpe.Vocabulary(queries.BPE_RANKS).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest((r.text or "").encode())))
    assert sorted(map(tuple, queries.op1_byte_bpe(spark, sf).collect())) == sorted(want)


def test_language_query(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_marginal_langid(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [(r.lang_pred, lang[r.doc_id]) for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_shard_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_best_fit_shards(spark, sf).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows} == {k: (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None) for k, t in texts.items()}
    of = {k: [r for r in rows if r.shard == k] for k in range(40)}
    assert sum(map(len, of.values())) == len(rows) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in of.values())
    share, group = sum(r["size"] for r in rows) / 40, {}
    for r in rows:
        group.setdefault(texts[r.doc_id], []).append(r)
    # whole groups only, but for those over an even share
    assert all(len({r.shard for r in g}) == 1 for g in group.values() if sum(r["size"] for r in g) <= share)
    whole = max(sum(r["size"] for r in g) for g in group.values())
    loads = [sum(r["size"] for r in x) for x in of.values()]
    assert max(loads) <= max(1.02 * share, whole)


def test_pii_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op7_skip_chain_pii(spark, sf).collect():
        base = brute_pii(texts[r.doc_id])
        told = [f"{pii.KINDS[k]}:{a}:{z}" for k, a, z in sorted(base)]
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == i for k, *_ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(told) <= set(spans) and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))


def test_secret_query(spark, sf):
    """Base spans by the patterns, and random tokens by the battery and Benjamini-Hochberg, in plain Python."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokens = [(k, m.start(), m.end(), battery_by_hand(m[0])) for k, t in texts.items() for m in re.finditer(secrets.TOKEN, t)]
    tokens = [(k, a, z, int(p * secrets.BINS_PER_DECADE)) for k, a, z, p in tokens if p is not None]
    least, seen = 1 << 30, 0
    for b in sorted({x[3] for x in tokens}, reverse=True):
        seen += sum(x[3] == b for x in tokens)
        if 10 ** (-b / secrets.BINS_PER_DECADE) <= 0.05 * seen / len(tokens):
            least = b
    near = [x for x in tokens if abs(x[3] - least) <= 3 and x[3] != least]
    assert not near, "a token at the border, which rounding could decide"
    for r in queries.op8_randomness_secrets(spark, sf).collect():
        base = brute_secrets(texts[r.doc_id])
        new = [(a, 3, z) for k, a, z, b in tokens if k == r.doc_id and b >= least and not any(x <= a and z <= y for x, _, y in base)]
        name = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest() and r.spans == name([*base, *new])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name]).select(*cols).fetchall()
    assert sorted(map(tuple, df.select(cols).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op1_byte_bpe", "op3_marginal_langid", "op4_best_fit_shards", "op5_warc_in_zip", "op7_skip_chain_pii", "op8_randomness_secrets", "op10_chosen_path_join"])
def test_queries_return_every_row(spark, sf, name):
    table = "pages" if name.startswith("op5") else "documents"
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
