"""Each stage of the pipeline on rows with nulls, empty texts, repeated rows and ids, extra columns, and on empty tables."""

import random

import pytest

import corpus_pipeline as c

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot long, component_id long, rate double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, LEAK), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


RNG = random.Random(21)
BASE = [text(RNG, 60) for _ in range(8)]
LEAK = text(RNG, 30)
ROWS = [(k, t, "en", f"s{k % 2}") for k, t in enumerate(BASE)]
ODD = [(None, None, None, None), (None, "", "en", None), (40, "  ", None, "s0"), (41, "12 34", "en", "s0")]


def made(spark, rows):
    return spark.createDataFrame([(*r, None, 7, 8, 9.0) for r in rows], SCHEMA).repartition(3)


def stage(name):
    return dict(c.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in c.STAGES])
def test_empty_table(spark, folder, name):
    out = stage(name)(spark, made(spark, []), folder)
    assert out.count() == 0 and (name == "token_output" or out.columns == c.COLUMNS)


def test_language(spark, folder):
    rows = [*ROWS, *ODD, ROWS[0], (50, "ωωωωωωωω", None, "s1")]
    out = stage("language_id")(spark, made(spark, rows), folder)
    assert out.columns == c.COLUMNS
    assert sorted(r.doc_id for r in out.collect()) == [0, *range(8)]  # null, empty, without letters, and of no known n-gram


def test_near_copies(spark, folder):
    near = BASE[3] + " tail"
    unique = made(spark, [*ROWS, (20, near, "en", "s0"), (21, BASE[1], "en", "s1"), (40, "  ", None, "s0"), (42, None, None, None)])
    out = stage("ngram_jaccard_join")(spark, unique, folder)
    assert out.columns == c.COLUMNS and sorted(r.doc_id for r in out.collect()) == [*range(8), 40, 42]
    rows = [*ROWS, ROWS[0], ROWS[0], (3, text(RNG, 50), "en", "s0"), (3, BASE[2], "en", "s1"), (None, BASE[4], "en", "s0"), (None, text(RNG, 50), "en", "s0"), *ODD]
    out = stage("ngram_jaccard_join")(spark, made(spark, rows), folder).collect()
    kept = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in out)
    assert kept == sorted(
        [(k, BASE[k]) for k in (0, 1, 2, 3, 5, 6, 7)] + [(3, rows[10][1]), (-1, BASE[4]), (-1, rows[13][1]), (-1, ""), (-1, ""), (40, "  "), (41, "12 34")]
    )


def test_leaks(spark, folder):
    rows = [*ROWS, *ODD, (30, f"{BASE[0]} {LEAK} {BASE[1]}", "en", "s0"), (None, LEAK, None, None), (31, LEAK.upper(), "en", "s1"), (31, LEAK.upper(), "en", "s1"), ROWS[0]]
    out = stage("benchmark_decontamination")(spark, made(spark, rows), folder)
    assert out.columns == c.COLUMNS
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == [-1, -1, 0, *range(8), 40, 41]


def test_mixing(spark, folder):
    rows = [(k, "t", "en", "big" if k % 10 else None) for k in range(2000)] + [(5, "t", "en", "big")]
    out = stage("source_mixing")(spark, made(spark, rows), folder)
    got = out.collect()
    assert out.columns == c.COLUMNS and abs(sum(r.source is None for r in got) / len(got) - 0.5) < 0.1
    assert sum(r.doc_id == 5 for r in got) % 2 == 0 and abs(len(got) - 2001) < 300


def test_tokens(spark, folder):
    rows = [*ROWS, *ODD, ROWS[0]]
    got = sorted(stage("token_output")(spark, made(spark, rows), folder).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got))) and sorted(-1 if r.doc_id is None else r.doc_id for r in got if r.seq_no == 0) == [-1, -1, 0, *range(8), 40, 41]
