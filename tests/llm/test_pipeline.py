"""The pipeline: each stage on its predecessor's rows, its decisions in effect, clean documents kept."""

import os

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 8)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(rng.integers(8, 25))) for _ in range(n))
    junk = lambda: " ".join(f"{word()}{x}" for x in rng.choice(["###", "$$$", "%%%"], 60))
    docs, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        docs.append((i, prose(rng.integers(2, 8)) if good else junk()))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good), 0))
    item = " ".join(word() for _ in range(30))
    passage = " ".join(word() for _ in range(60))
    docs += [(1001, prose(3) + "\n" + item + "\n" + prose(2)), (1002, passage + "\n" + prose(3)), (1003, prose(2) + "\n" + passage), (1004, docs[1][1])]
    whole = [word() for _ in range(300)]
    broken = lambda at: "\n".join(" ".join(x) for x in [whole[:at], *(whole[i : i + 14] for i in range(at, 300, 14))])
    docs += [(1005, broken(14)), (1006, broken(9)), (1007, broken(5).upper().lower()), (1008, None), (1009, ""), (1009, "")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(docs), item, passage


def test_stages(spark, folder):
    path, docs, item, passage = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, path)
        where = f"{path}/out/{name}"
        out.write.parquet(where)
        df = spark.read.parquet(where)
        seen[name] = df
        if name != "best_fit_packing":
            assert df.columns == COLUMNS
            assert all(r.n_chars == len(r.text or "") for r in df.collect())
    text = {name: {r.doc_id: r.text for r in x.collect()} for name, x in seen.items() if "text" in x.columns}
    good = text["quality_classifier"]
    assert not {i for i in good if i < 240 and i % 4 == 0} and {i for i in range(240) if i % 4} <= set(good)
    lines = text["line_dedup"]
    assert passage in lines[1002] and passage not in lines[1003] and 1004 not in lines
    assert {i for i in range(240) if i % 4} <= set(lines)
    one = text["ngram_jaccard_join"]
    assert 1005 in one and not {1006, 1007} & set(one)
    clean = text["benchmark_decontamination"]
    assert item in one[1001] and item not in clean[1001] and {i for i in range(240) if i % 4} <= set(clean)
    assert {r.doc_id for r in seen["best_fit_packing"].collect()} == set(clean)


def test_run_gives_the_stages_rows(spark, folder):
    path = folder[0]
    rows = corpus_pipeline.run(spark, path).select("doc_id", "piece", "length", "ids_crc32").collect()
    kept = spark.read.parquet(f"{path}/out/best_fit_packing").select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(rows) == sorted(kept)


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
    assert os.path.exists(entry.__file__)


def test_near_copies_from_four_fifths_on_go(spark):
    """Of 200 words, 4 changed ones (apart from each other) leave 176 of 216 runs of 5 words in common, 186 of 210 of 3; 5 leave 171 of 221."""
    base = [f"w{i}" for i in range(200)]
    changed = lambda n: " ".join(f"x{i}" if i % 30 == 20 and i < 30 * n else w for i, w in enumerate(base))
    df = spark.createDataFrame([(1, changed(0)), (2, changed(4)), (3, " ".join(f"y{i}" for i in range(200))), (4, changed(4).replace("w", "z"))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, df, "").collect()) == [1, 3, 4]
    far = spark.createDataFrame([(1, changed(0)), (2, changed(5))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, far, "").collect()) == [1, 2]


def test_line_dedup_stage_leaves_no_pair_of_a_large_bucket_out(spark):
    """80 documents of one line under 15 shared words, with default settings: each is like one other alone, and one of each two goes."""
    import random

    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)})
    words = [r.w for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "hash(w) & 2147483647 h").orderBy("h").collect()]
    texts = []
    for i in range(40):
        line = words[:15] + rng.sample(words[100:], 20)
        texts += [" ".join(line), " ".join([*line[:-1], words[20 + i]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 80, 2))
