"""The pipeline, stage by stage against plain Python, and on odd tables."""

import random
import zlib

import numpy as np
import pytest
from conftest_llm import ODD, SCHEMA, rows
from test_duplicates import changed, classes
from test_native import leaked

import corpus_pipeline
from loomwork.llm import packing
from loomwork.llm.common import kept
from loomwork.llm.mixing import in_mixed_order

INSULTS = ["zwonk", "blarf", "quimby"]


def written(spark, folder, documents, labels, benchmark):
    for name, df in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, prose, tmp_path_factory):
    rng, items = random.Random(2), [(i, prose(20 + i, 900 + i)) for i in range(5)] + [(9, None)]
    texts = list(ODD)
    for i in range(70):
        t = prose(80, i)
        texts += [t, t, changed(t, 1, i)] if i < 8 else [f"{t} {items[i % 5][1]} {prose(9, i)}"] if i < 14 else [t]
    toxic = []
    for i in range(240):
        w = prose(60, 5000 + i).split()
        if i % 4 == 0:
            for j in range(0, 60, 12):
                w[j + rng.randint(0, 5)] = rng.choice(INSULTS)
            toxic.append(len(texts))
        texts.append(" ".join(w))
    ids = [None, None, *range(2, len(texts))]
    given = rows(texts + texts[20:25], ids + ids[20:25])  # repeated rows
    label = [(i, 1, int(i in toxic)) for i in range(len(ODD) + 50, len(texts))] + [(None, None, 1), (3, 0, None)]
    folder = tmp_path_factory.mktemp("tables")
    return written(spark, folder, spark.createDataFrame(given, SCHEMA), spark.createDataFrame(label, "doc_id long, quality int, toxic int"), spark.createDataFrame(items, "item_id long, text string")), toxic, items


def test_each_stage_against_plain_python(spark, tables):
    sf, toxic, items = tables
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = now.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        if name == "token_ids":
            order = [r.doc_id for r in in_mixed_order(now).orderBy("mixed_order").collect()]
        before = [(r.doc_id, r.text) for r in now.collect()] if "text" in now.columns else []
        now = kept(stage(spark, now, sf), f"test-{name}")
        seen[name] = before, [(r.doc_id, r.text) for r in now.collect()] if name != "token_ids" else now.collect()
        assert name == "token_ids" or now.dtypes == columns
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    before, after = seen["toxicity"]
    gone = {i for i, _ in before} - {i for i, _ in after}
    assert gone <= set(toxic) and len(gone) > 0.9 * len(toxic)
    before, after = seen["near_duplicates"]
    ordered = sorted(before, key=lambda r: (r[0] is None, *key(r)))
    assert sorted(after, key=key) == sorted({ordered[c] for c in set(classes(ordered))}, key=key)
    before, after = seen["decontamination"]
    bad = leaked(list(enumerate(t for _, t in before)), items)
    assert sorted(after, key=key) == sorted((r for n, r in enumerate(before) if n not in {d for d, _ in bad}), key=key) and bad
    before, after = seen["mixing"]
    assert all(1 <= after.count(r) <= 2 for r in before) and set(after) == set(before)
    before, after = seen["token_ids"]
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(packing.word_bpe()), 0
    assert len(after) == len(before) and sorted(map(key, [(r.doc_id, "") for r in after])) == sorted(map(key, [(i, "") for i, _ in before]))
    text = dict(before)
    for r in sorted(after, key=lambda r: r.start):
        ids = np.array(tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert r.start == start and (r.doc_id is None or (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())))
        start += r.n_tokens
    assert [r.doc_id for r in sorted(after, key=lambda r: r.start)] == order != sorted(order, key=lambda i: (i is not None, i))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    sf = written(spark, tmp_path, none, spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_run_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).toPandas().sort_values("start")
    assert len(out) > 100 and (out.start.to_numpy()[1:] == (out.start + out.n_tokens).to_numpy()[:-1]).all()
