"""The corpus pipeline against a brute-force version of its stages, and the shingle join against its SQL."""

import glob
import os
import random
import re

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from recordloom.llm import queries
from recordloom.llm.common import tokenizer_path
from tests.llm.test_operators import brute

SF = "/root/testdata/sf0.001"


def test_shingle_join_against_sql(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.queries()["op9_shingle_join"](spark, SF)
    want = con.execute(queries.oracle_sql()["op9_shingle_join"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Plain sentences, their copies and near copies, texts that the base rules reject, and marked junk."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        if i % 8 == 7:
            text = rng.choice([None, "", "too short", "again and again and again " * 30])
        elif i % 4 == 3:
            text = " ".join(rng.choices(["$$$", "###", "%%junk%%", "&&&", "***", "win"], k=rng.randint(20, 60)))
        elif i % 4 == 2:
            text = rows[-1][1]
            if i % 8 == 2:
                text += " tail"
        else:
            text = " ".join(rng.choices(words, k=rng.randint(30, 120)))
        rows.append((i, text, "en", "made", len(text or "")))
        labels.append((i, int(i % 4 != 3), 0))
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict((r[0], r[1]) for r in rows)


def base_failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    repeated = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 5)}
    return len(words) < 10 or 100 * len(repeated) > 20 * len(words)


def test_pipeline(spark, tables, tmp_path):
    folder, texts = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        rows = docs.collect()
        assert all(r.text == texts[r.doc_id] for r in rows)
        seen[name] = {r.doc_id for r in rows}
        assert len(rows) == len(seen[name])
    clean = {i for i in texts if i % 4 != 3}
    for name in ("quality_rules", "quality_classifier"):
        assert not any(base_failed(texts[i]) for i in seen[name])
        # clean documents stay and marked junk goes
        assert clean <= seen[name]
    assert seen["quality_classifier"] == clean
    components = brute([(i, texts[i]) for i in sorted(clean)])
    assert seen["near_duplicates"] == {i for i, (_, c) in components.items() if i == c}
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    lengths, filled = {}, {}
    for r in corpus_pipeline.run(spark, folder).collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert lengths == {i: len(t.encode(texts[i], add_special_tokens=False).ids) + 1 for i in seen["near_duplicates"]}
    for items in filled.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))] and sum(n for _, n in items) <= 2048
