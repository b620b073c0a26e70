"""The pipeline's stages, each against plain Python on what its predecessor kept; queries over whole tables."""

import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from oracle import compare, connect

import corpus_pipeline
from cadastrum.llm import imatch, queries

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's stored result, by name, and the documents themselves."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        docs = found[name] = spark.read.parquet(f"{folder}/{name}")
    return found


def test_quality_keeps_what_scores_enough(spark, stages):
    kept = {r.doc_id for r in queries.op2_quality_rules(spark, SF_DIR).collect() if r.predicted == 1}
    assert rows_of(stages["quality"]) == [r for r in rows_of(stages["documents"]) if r[0] in kept]


def test_held_out_accuracy(spark):
    larger = SF_DIR.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    scored = [r for r in queries.op2_quality_rules(spark, larger).collect() if r.held_out and r.doc_id in labels]
    assert len(scored) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert sum(r.predicted == labels[r.doc_id] for r in scored) >= 0.95 * len(scored)


def test_one_of_each_near_group_stays(stages):
    before = rows_of(stages["quality"])
    groups = brute.components([brute.simhash(r[1]) for r in before])
    assert rows_of(stages["near_duplicates"]) == [r for r, g in zip(before, groups, strict=True) if before[g] is r]


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    before = rows_of(stages["near_duplicates"])
    hit = {d for d, _, n, _ in brute.contamination([r[:2] for r in before], items) if n}
    assert rows_of(stages["decontamination"]) == [r for r in before if r[0] not in hit]


def test_mix_comes_near_its_targets(stages):
    before, after = rows_of(stages["decontamination"]), Counter(rows_of(stages["mixing"]))
    assert set(after) <= set(before) and max(after.values()) <= 2
    sizes, taken, largest = Counter(), Counter(), Counter()
    for row in before:
        size = brute.size_of(row[1])
        sizes[row[3]] += size
        taken[row[3]] += size * after[row]
        largest[row[3]] = max(largest[row[3]], size)
    for source, target in brute.mix_targets(sizes).items():
        assert abs(taken[source] - target) <= largest[source]


def test_token_files_hold_the_mix(spark, stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    expected, start = [], 0
    for row in rows_of(stages["mixing"]):
        ids = np.array([*library.encode(row[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected.append((row[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in stages["token_files"].select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == expected
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, queries.QUERIES[name], queries.ORACLES[name], SF_DIR) is None


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").select("doc_id", "text", "source").collect()]


def test_every_fingerprint_and_likeness_is_recomputed(spark):
    docs = documents(spark)
    words = brute.lexicon([text for _, text, _ in docs], imatch.LEAST_SHARE, imatch.MOST_SHARE)
    own = [brute.imatch(text, words) for _, text, _ in docs]
    got = queries.op7_imatch(spark, SF_DIR).orderBy("doc_id").collect()
    for i, ((doc, text, _), r) in enumerate(zip(docs, got, strict=True)):
        after = (i + 1) % len(docs)
        changed = brute.edited(text, docs[after][1])
        print_ = brute.imatch(changed, words)
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc, len(text), brute.sha(changed))
        assert (r.fingerprint, r.edited_fingerprint) == (brute.digits(own[i]), brute.digits(print_))
        assert r.near_edited == pytest.approx(brute.imatch_likeness(own[i], print_))
        assert r.near_next == pytest.approx(brute.imatch_likeness(own[i], own[after]))
    assert np.mean([r.near_edited for r in got]) > 0.25 > 0.05 > np.mean([r.near_next for r in got])


def test_digest_queries(spark):
    docs = documents(spark)
    placed = {r.doc_id: r for r in queries.op1_sharding(spark, SF_DIR).collect()}
    assert all((placed[d]["size"], placed[d].text_crc32) == (len(t.encode()) + 1, brute.crc(t)) for d, t, _ in docs)
    assert {r.shard for r in placed.values()} == set(range(8)) and len(placed) == len(docs)
    found = {r.doc_id: r for r in queries.op8_secrets(spark, SF_DIR).collect()}
    for doc, text, _ in docs:
        spans = [f"{k}:{a}:{b}" for k, a, b in brute.secrets(text)]
        assert found[doc].base_sha256 == brute.sha(",".join(spans)) and set(spans) <= set(found[doc].spans.split(",")) | {""}
    prints = [brute.simhash(t) for _, t, _ in docs]
    groups = brute.components(prints)
    linked = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF_DIR).collect()}
    assert linked == {d: (f"{p:016x}", docs[g][0]) for (d, *_), p, g in zip(docs, prints, groups, strict=True)}
    mixed = {r.doc_id: r for r in queries.op5_mixing(spark, SF_DIR).collect()}
    assert all(mixed[d]["size"] == brute.size_of(t) and mixed[d].taken <= 2 * mixed[d]["size"] for d, t, _ in docs)


def test_every_operator_has_one_query():
    numbers = Counter(name[2:].split("_")[0] for name in queries.QUERIES)
    assert numbers == {str(n): 1 for n in range(1, 14)}
