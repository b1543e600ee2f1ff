"""Line dedup against all pairs of lines, with buckets that force the leader rounds."""

import os
import re

import numpy as np
import pytest

from tessera.llm import line_dedup as ld
from tessera.llm._shared import shared_dir
from tessera.plans.engine import _operators


def norm(line):
    return re.sub(r"[\W_]+", " ", line).strip(" ").lower()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefg"), rng.integers(2, 7)))
    bases = [[word() for _ in range(rng.integers(5, 30))] for _ in range(6)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.integers(0, 6)):
            w = list(bases[rng.integers(6)]) if rng.random() < 0.6 else [word() for _ in range(rng.integers(1, 20))]
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = word()
            lines.append((rng.choice([" ", "  ", "\t"])).join(w).capitalize() if rng.random() < 0.9 else "")
        docs.append((i, "\n".join(lines)))
    return docs


def groups_of(texts, percent=20):
    """Connected groups of lines by all pairs of edit similarity, whatever words they share."""
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            longest = max(len(a), len(b))
            if 100 * abs(len(a) - len(b)) <= percent * longest and 100 * distance(a, b) <= percent * longest:
                root[top(a)] = top(b)
    return {t: top(t) for t in texts}


@pytest.mark.parametrize("seed,light", [(0, 16), (1, 2), (3, 1)])
def test_against_all_pairs(spark, seed, light):
    """No line goes that all pairs would keep, and nine in ten of those that all pairs would drop do go: in small buckets, under leaders and in split buckets."""
    docs = [*corpus(seed, 70), (500, None), (501, "")]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, n_lines string")
    occurrences = {}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if norm(line):
                occurrences.setdefault(norm(line), []).append((i, k))
    groups = {}
    for t, r in groups_of(sorted(occurrences)).items():
        groups.setdefault(r, []).extend(occurrences[t])
    want = {x for g in groups.values() for x in set(g) if x != min(g)}
    exact = {x for g in occurrences.values() for x in set(g) if x != min(g)}
    out = ld.dedup_lines(df, ld.Settings(light=light))
    assert out.columns[:3] == ["doc_id", "text", "n_lines"] and len(out.columns) == 5 and out.count() == len(docs)
    got = {(r.doc_id, k) for r in ld.dropped_lines(df, ld.Settings(light=light)).collect() for k in r.gone}
    assert exact <= got <= want and len(got - exact) >= 0.9 * len(want - exact) and len(want - exact) > 20
    texts = dict(docs)
    for r in out.collect():
        if r.text is not None:
            assert r.text == "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, k) not in got)


def test_pigeonhole(spark):
    """Lines that differ in one of 5 to 60 words share a block whole."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 9)))
    rows = []
    for i in range(200):
        a = [word() for _ in range(5 + i % 56)]
        b = list(a)
        b[rng.integers(len(b))] = word()
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    keys = lambda c: ld.block_keys(ld.sketch(ld.F.col(c), ld.Settings()), ld.Settings())
    assert df.where(ld.F.arrays_overlap(keys("a"), keys("b"))).count() >= 198


def test_sketch_is_the_smallest_weighted_hashes(spark):
    text = "ab cd ef gh ij ab a longer words " + " ".join(f"w{i}" for i in range(40))
    got = ld.hashed_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), ld.Settings()).first().sketch
    words = spark.createDataFrame([(w,) for w in set(text.split())], "w string").selectExpr("w", "hash(w) h").collect()
    assert got == sorted((r.h & 0x7FFFFFFF) >> (min(len(r.w), 4) - 1) for r in words)[:15]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup_lines(df).count() == 0


def test_ties_link(spark):
    """2 of 10 and 10 of 50 characters differ: a similarity of exactly 0.8."""
    df = spark.createDataFrame([(1, "aaaa bbbb cccc dddd eeee ffff gggg hhhh iiii jklmn", "aaaa bbbb cccc dddd eeee ffff gggg hhhh iiii nmlkj"), (2, "a b c d ef", "a b c d fe"), (3, "x" * 50, "x" * 40 + "y" * 10), (4, "x" * 50, "x" * 39 + "y" * 11)], "id long, x string, y string")
    pairs = df.selectExpr("2 * id a", "2 * id + 1 b")
    lines = ld.with_texts(df.selectExpr("stack(2, 2 * id, split(x, ' '), 2 * id + 1, split(y, ' ')) as (id, words)"))
    assert sorted(r.a for r in ld.linked(pairs, lines, ld.Settings()).collect()) == [2, 4, 6]


def test_long_lines_are_compared_by_words(spark):
    a = [f"word{i}" for i in range(3000)]
    few, many = list(a), list(a)
    few[::10] = ["other"] * 300
    many[::3] = ["other"] * 1000
    lines = ld.with_texts(spark.createDataFrame([(1, a), (2, few), (3, many), (4, a[:2000])], "id long, words array<string>"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    assert [r.b for r in ld.linked(pairs, lines, ld.Settings()).collect()] == [2]


def test_null_ids_and_repeated_rows(spark):
    """A null id is smaller than all others; rows that repeat id and text are one occurrence."""
    two = [(502, "one two three four five"), (502, "ONE two  three four five\nonly here are these words")]
    texts = sorted(r.text for r in ld.dedup_lines(spark.createDataFrame(two, "doc_id long, text string")).collect())
    assert texts in (["", two[1][1]], ["one two three four five", "only here are these words"])
    rows = [(None, "some words of a line here"), (None, "other words of another line"), (3, "some words of a line here"), (4, "only this"), (4, "only this"), (5, "only this")]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, [*rows[:2], (3, ""), *rows[3:5], (5, "")]))


def gone(spark, texts, settings=None):
    """The ids whose text lost a line."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.doc_id for r in ld.dedup_lines(df, settings).where("n_gone > 0").orderBy("doc_id").collect()]


def test_marks_do_not_tell_lines_apart(spark):
    plain = "one two three four five six"
    texts = [plain, "one### two### three### four### five### six###", "| ONE | two | three | four | five | six |", "one_two,three-four;five...six!", "seven eight nine ten eleven twelve"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [" ".join(r.words) for r in ld.every_line(df).orderBy("doc_id").collect()] == [re.sub(r"[\W_]+", " ", t).strip(" ").lower() for t in texts]
    assert gone(spark, texts) == [1, 2, 3]


def test_exact_copies_of_short_lines_go(spark):
    texts = ["All rights reserved.", "all rights reserved", "所有权利均予保留未经许可不得转载", "all rights deserved", "所有权利均予保留未经许可不得转载", "###\n \n\nx", "### \n\n"]
    assert gone(spark, texts) == [1, 4, 6]
    df = spark.createDataFrame([(1, "a\n\n \na"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_gone) for r in ld.dedup_lines(df).collect()) == [(1, "a\n\n ", 1), (2, None, 0)]


def test_recall_against_all_pairs_of_edit_similarity(spark):
    """Changed words in lines of 8 to 50 words: nearly every pair of similarity 0.8 meets, whatever its bits."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 9)))
    texts, like = [], []
    for i in range(120):
        a = [word() for _ in range((8, 10, 20, 50)[i % 4])]
        b = list(a)
        for at in rng.choice(len(a), max(1, len(a) // 10), replace=False):
            b[at] = word()
        a, b = " ".join(a), " ".join(b)
        texts += [a, b]
        if 100 * distance(a, b) <= 20 * max(len(a), len(b)):
            like.append(2 * i + 1)
    found = gone(spark, texts)
    assert len(like) > 100 and set(found) <= set(like) and len(found) >= 0.98 * len(like)


@pytest.mark.parametrize("shared", [15, 8, 4])
def test_no_pair_of_a_large_bucket_is_left_out(spark, shared):
    """80 lines share the smallest hashes of their sketches and no leader links most of them; each is like one other, and like that alone."""
    rng = np.random.default_rng(9)
    words = sorted({"".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)})
    words = [r.w for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "hash(w) & 2147483647 h").orderBy("h").collect()]
    texts = []
    for i in range(40):
        own = list(rng.choice(words[100:], 35 - shared, replace=False))
        a = words[:shared] + own
        b = a[:-1] + [words[20 + i]]
        texts += [" ".join(a), " ".join(b)]
    found = gone(spark, texts, ld.Settings(light=2))
    assert found == list(range(1, 80, 2))


def test_leaders_that_link_nothing_are_given_up(spark, monkeypatch):
    """A bucket of unlike classes has one round of leaders, not three, and a comparison deals out the texts of its pairs alone."""
    names = []
    monkeypatch.setattr(ld, "written", lambda df, name, f=ld.written: (names.append(name), f(df, name))[1])
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    ranked = [r.w for r in spark.createDataFrame([(w,) for w in sorted(set(words))], "w string").selectExpr("w", "hash(w) & 2147483647 h").orderBy("h").collect()]
    texts = [" ".join([*ranked[:8], *rng.choice(ranked[100:], 20, replace=False)]) for _ in range(60)]
    assert gone(spark, [*texts, f"{texts[7]} more"], ld.Settings(light=20)) == [60]
    assert names.count("led") <= 2
    pairs, lines = spark.createDataFrame([(1, 2)], "a long, b long"), ld.with_texts(spark.createDataFrame([(i, ["x"]) for i in range(9)], "id long, words array<string>"))
    assert "LeftSemi" in ld.linked(pairs, lines, ld.Settings())._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1 << 16, 50])
def test_brief_classes_meet_all_of_their_bucket(spark, monkeypatch, most):
    """Classes apart from the rest of a bucket meet all of it, in one task or in many, and rows of the rest are not repeated for that."""
    monkeypatch.setattr(ld, "TASK_MET", most, raising=False)
    rng = np.random.default_rng(3)
    sketches = [sorted(rng.choice(12, 6, replace=False).tolist()) for _ in range(60)]
    roots = [i if i in (7, 20, 41) else 0 for i in range(60)]
    rows = [(1, i, sketches[i], 30, roots[i], 60, 0, 3, True, roots[i] != 0) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, id long, sketch array<int>, chars int, root long, m long, big long, apart long, few boolean, brief boolean")
    pairs = ld._brief_pairs(df, ld.Settings())
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if roots[a] != roots[b] and 100 * len({*sketches[a]} & {*sketches[b]}) >= 45 * 6}
    assert {(r.a, r.b) for r in pairs.collect()} == want and 20 < len(want)
    run = pairs._jdf.queryExecution()
    run.toRdd().count()
    assert sum(counted["numOutputRows"] for _, name, counted in _operators(run.executedPlan(), 0) if name == "Generate") <= 3 * ld.SALTS


def test_tables_of_lines_and_classes_go_when_nothing_reads_them(spark):
    folder = os.path.join(shared_dir(spark).removeprefix("file:"), "tessera")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = ld.dedup_lines(spark.createDataFrame([(1, "one two three four\nfive six seven"), (2, "one two three four\nelse")], "doc_id long, text string"))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert "gone" in left and not left & {"lines", "classes", "rows", "met", "texts", "places", "grouped"}
    assert sorted(r.text for r in out.collect()) == ["else", "one two three four\nfive six seven"]
