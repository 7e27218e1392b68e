"""The stages one by one against brute force on what each got."""

import re

import corpus_pipeline
from tests.llm.conftest import SMALL
from tests.llm.test_near import exact
from tests.llm.test_native import base_of


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
            rows = {r.doc_id: r for r in out.collect()}
            kept[name] = (before, rows)
            docs = spark.createDataFrame(list(rows.values()), docs.schema)
    before, rows = kept["toxicity"]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [i for i in before if toxic.get(i) == 0]
    assert sum(i in rows for i in clean) >= 0.97 * len(clean)
    before, rows = kept["near_duplicates"]
    want = exact({i: r.text for i, r in before.items()}, 5, 80)
    assert set(rows) == {i for i, (_, c) in want.items() if i == c}
    before, rows = kept["decontamination"]
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    bench = [words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for i, r in before.items():
        held = words(r.text)
        if any(b in held for b in bench):
            assert i not in rows
        elif not any(b[a:a + 40] in held for b in bench for a in range(0, max(1, len(b) - 40), 5)):
            assert i in rows
    before, rows = kept["secrets"]
    assert set(rows) == set(before)
    for i, r in before.items():
        if base_of(r.text):
            assert "[SECRET]" in rows[i].text and not [s for s in base_of(rows[i].text) if s[1] > 0]
        elif rows[i].text != r.text:
            assert "[SECRET]" in rows[i].text
    last = corpus_pipeline.run(spark, SMALL)
    found = last.collect()
    assert {r.doc_id for r in found} == set(rows)
    at = {}
    for r in found:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, SMALL)
        assert out.columns == odd_docs.columns, name
        ids = [r.doc_id for r in out.collect()]
        assert None in ids and 2 in ids and 7 in ids and len(ids) >= (9 if name == "near_duplicates" else 11)
        assert stage(spark, no_docs, SMALL).count() == 0
    assert corpus_pipeline.packed(spark, no_docs, SMALL).count() == 0


def test_stages_keep_the_callers_columns(spark, odd_docs):
    """Columns named like the stages' own come back with their values and types; only masked texts change."""
    docs = odd_docs.selectExpr("*", "cast(doc_id as double) AS base", "concat('c', doc_id) AS candidates", "array(doc_id) AS evidence", "'r' AS row")
    key = lambda r: tuple(map(str, (r.doc_id, r.score, r.shard, r.spans, r.ids, r.base, r.candidates, r.evidence, r.row)))
    before = sorted(key(r) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes, name
        after = sorted(key(r) for r in out.collect())
        assert set(after) <= set(before)
        if name in ("toxicity", "secrets"):
            assert after == before, name
