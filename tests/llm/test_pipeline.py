from collections import Counter, defaultdict

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from sparkloom.llm import queries


@pytest.fixture(scope="module")
def stages(spark, docs):
    """What each stage gets and gives."""
    out, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        given = now
        now = corpus_pipeline.written(stage(spark, now, ""), "test-stage")
        out[name] = (given.collect(), now.collect(), now.columns)
    return out


def test_stages(stages, docs):
    names = list(stages)
    assert names == ["language ID", "SimHash near-dedup", "substring dedup", "source mix", "best-fit packing"]
    assert all(stages[n][2] == docs.columns for n in names[:-1]) and corpus_pipeline.ORACLE_SQL is None
    given, kept, _ = stages["language ID"]
    assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in given} and len(kept) > 0.9 * len(given)
    given, kept, _ = stages["SimHash near-dedup"]
    assert len({r["text"] for r in kept}) == len(kept) and {r["text"] for r in given} >= {r["text"] for r in kept}
    given, kept, _ = stages["substring dedup"]
    assert sum(r["n_chars"] for r in kept) <= sum(r["n_chars"] for r in given) and all(r["n_chars"] == len(r["text"]) for r in kept)
    texts = {r["doc_id"]: r["text"] for r in given}
    assert all(r["text"].split()[:3] and set(r["text"].split()) <= set(texts[r["doc_id"]].split()) for r in kept)


def test_mix_and_packing(stages):
    given, out, _ = stages["source mix"]
    size = {r["doc_id"]: len(r["text"].split()) for r in given}
    taken = Counter()
    for r in out:
        taken[r["doc_id"]] += len(r["text"].split())
    assert all(taken[i] <= 3 * size[i] for i in taken)
    given, pieces, _ = stages["best-fit packing"]
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r["doc_id"] for r in given)
    held = defaultdict(int)
    for r in pieces:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 4096 and len(held) <= -(-sum(held.values()) // 4096) + 1


def test_run(spark, data, stages):
    rows = corpus_pipeline.run(spark, data).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert Counter(map(key, rows)) == Counter(map(key, stages["best-fit packing"][1]))


def test_entry(spark, data):
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)} and names >= set(queries.queries()) | {"pipeline"}
    assert set(entry.oracle_sql()) <= names
    contracts = {
        "op1": "doc_id held_out score predicted", "op2": "query_id rank vec_id score", "op3": "doc_id size text_crc32 law shard slot grown_shard",
        "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op5": "doc_id held_out lang_pred score",
        "op6": "doc_id piece start length ids_crc32 sequence_id offset", "op7": "doc_id fingerprint component_id",
        "op8": "doc_id held_out n_tokens n_known train_tokens base_score score", "op9": "doc_id other_id start end other_start other_end identity",
        "op10": "doc_id size source_size target taken",
    }
    for name, fn in queries.queries().items():
        df = fn(spark, data)
        assert set(contracts[name.split("_")[0]].split()) <= set(df.columns), name
