"""The corpus pipeline, stage by stage, on a small table."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tallyboard.llm import common, simhash

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score int, shard string, body int, "
    "_body int, _coverage int, _key string, _copy int, toxicity int, row int, plan int, key int"
)
MORE = (7, 8, "k", 9, 1, 2, 3, 4)


def print_of(text):
    hashes = simhash.shingle_hashes(text.encode(), 3)
    return int(simhash.bit_majority(np.array(hashes, np.uint64), np.array([0]), np.array([len(hashes)]))[0])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = {i: " ".join(word() for _ in range(150)) for i in range(300)}
    toxic = set(range(0, 300, 4))
    for i in toxic:
        texts[i] = texts[i].replace(" ", " vile ", 3)
    # One word changed, where that changes no more than two bits.
    near = [texts[1].split() for _ in range(150)]
    for at, words in enumerate(near):
        words[at] = "changed"
    near = [" ".join(words) for words in near]
    texts |= {300: next(t for t in near if 0 < (print_of(t) ^ print_of(texts[1])).bit_count() <= 2), 301: texts[2], 302: None, 303: "", 304: None}
    item = [f"b{i}" for i in range(40)]
    texts[305] = " ".join([*(word() for _ in range(150)), *item[20:], "and", *item[:20]])
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 1, "x", 2, *MORE) for i, t in texts.items()]
    rows += [rows[5], (None, " ".join(word() for _ in range(90)), None, None, None, None, None, None, *MORE)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(250)], "doc_id long, toxic int").write.parquet(
        f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = common.stored(stage(spark, docs, folder), name)
        seen[name] = Counter(r.doc_id for r in docs.collect())
        if name != "sharding":
            assert docs.columns == columns
    clean = seen["toxicity"]
    assert sum(i in clean for i in range(0, 300, 4)) <= 3
    assert sum(i in clean for i in range(300) if i % 4) >= 220
    kept = seen["near_duplicates"]
    assert 300 not in kept and 301 not in kept and {1, 2, 5, None} <= set(kept)
    assert set(kept.values()) == {1}
    assert len({302, 303, 304} & set(kept)) == 1
    assert set(clean) - set(kept) == {300, 301, 303, 304}
    untested = seen["decontamination"]
    assert set(kept) - set(untested) == {305}
    mixed = seen["mixing"]
    assert set(mixed) <= set(untested) and max(mixed.values()) <= 3
    assert seen["sharding"] == mixed
    places = [(r["shard"], r.slot) for r in docs.collect()]
    sizes = Counter(s for s, _ in places)
    assert len(set(places)) == len(places) and max(sizes.values()) - min(sizes.values()) <= 1


def test_an_empty_table(spark, folder):
    docs = common.table(spark, folder, "documents").where("false")
    for name, stage in pipeline.STAGES:
        docs = common.stored(stage(spark, docs, folder), f"none-{name}")
        assert docs.count() == 0
