"""Quotation linking on hand-made threads, and against its SQL."""

import duckdb
import numpy as np
import pytest

from tessera.llm import quotation as ql

COLUMNS = ["conv_id", "turn", "role", "text", "n_quoted", "n_linked", "max_level", "reply_to", "by_quote", "position"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_a_thread(spark):
    thread = [
        (1, 0, "a", "Shall we meet at noon?\nI bring the plans."),
        (1, 1, "b", "No idea about the plans.\nNoon is fine."),
        (1, 2, "c", "On Monday a wrote:\n> Shall we  MEET at noon\n> I bring the plans.\nYes, both."),
        (1, 3, "d", "> > I bring the plans.\n> Yes, both.\nGood."),
        (1, 4, "e", "> never said\nHm."),
        (1, 5, "f", None),
        (2, 0, "a", "> Yes, both.\nAlone."),
    ]
    got = {(r.conv_id, r.turn): r for r in ql.link(spark.createDataFrame(thread, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 2].text, got[1, 2].reply_to, got[1, 2].by_quote, got[1, 2].n_quoted, got[1, 2].n_linked) == ("Yes, both.", 0, True, 2, 2)
    assert (got[1, 3].text, got[1, 3].reply_to, got[1, 3].max_level) == ("Good.", 2, 2)
    assert (got[1, 4].text, got[1, 4].reply_to, got[1, 4].by_quote) == ("Hm.", 3, False)
    assert (got[1, 5].text, got[1, 5].reply_to) == (None, 4)
    assert (got[2, 0].text, got[2, 0].reply_to, got[2, 0].by_quote) == ("Alone.", None, False)


def threads(seed, n):
    rng = np.random.default_rng(seed)
    line = lambda: " ".join(rng.choice(list("abcd"), rng.integers(0, 3)))
    rows = []
    for c in range(n):
        said = []
        for t in range(rng.integers(1, 9)):
            parts = []
            for _ in range(rng.integers(0, 6)):
                if said and rng.random() < 0.5:
                    source = said[rng.integers(len(said))].split("\n")
                    parts += ["> " + x for x in source[: rng.integers(1, len(source) + 1)]]
                else:
                    parts.append(line() if rng.random() < 0.9 else "X wrote:")
            said.append("\n".join(parts))
            rows.append((c if c else None, t * int(rng.choice([1, 1, 300])) if t else 0, rng.choice(["user", "assistant"]), said[-1] if rng.random() < 0.95 else None))
    seen = {(c, t): (c, t, r, x) for c, t, r, x in rows}
    return list(seen.values())


@pytest.mark.parametrize("seed", [0, 1])
def test_against_sql(spark, seed):
    rows = threads(seed, 60)
    rows += rows[:5]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = sorted((tuple(r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ql.ORACLE})").fetchall()), key=str)
    assert rows_of(ql.link(df)) == want


def test_plan_is_native_and_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = ql.link(df)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
