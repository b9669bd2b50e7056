"""Every registered query of the subpackage over the smallest tables: against its SQL, or against brute force."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from test_near_and_repeats import brute_components, brute_repeats

import __spark_entry__ as entry
from tomewatch.llm.token_shards import TOKENIZER, encoder, read_slots, vocabulary

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if re.match(r"op\d+_", n)]


@pytest.fixture(scope="module")
def documents():
    return {d: t for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def fold(d, n):
    return zlib.crc32(str(d).encode()) % n


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    want = [dict(zip([d[0] for d in found.description], r, strict=True)) for r in found.fetchall()]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([plain(r[c]) for c in columns]) for r in want)


def test_quality(spark, documents):
    got = {r.doc_id: r for r in rows(spark, "op2_quality_crf")}
    assert got.keys() == documents.keys() and all(r.held_out == (fold(d, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    known = {d: q for d, q in duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall()}
    good, bad = ([got[d].score for d, q in known.items() if q == k and d in got and got[d].held_out] for k in (1, 0))
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.9


def test_repeats(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op4_suffix_dedup")}
    assert got == brute_repeats([(t, d) for d, t in documents.items()], 100)


def test_language(spark, documents):
    got = {r.doc_id: r for r in rows(spark, "op6_language_id")}
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    assert got.keys() == documents.keys() and all(r.held_out == (fold(d, 4) == 2) for d, r in got.items())
    asked = [d for d, r in got.items() if r.held_out and r.lang_pred != "und"]
    assert asked and np.mean([got[d].lang_pred == lang[d] for d in asked]) > 0.95


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_leaks(spark, documents):
    """Items that stand in a text word for word are found; texts that share no five words in a row with any item are clean."""
    items = {i: plain(t) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()}
    got = {r.doc_id: r for r in rows(spark, "op7_benchmark_decontamination")}
    assert got.keys() == documents.keys()
    fives = {tuple(w[i : i + 5]) for w in items.values() for i in range(len(w) - 4)}
    for d, text in documents.items():
        words = plain(text)
        whole = f" {' '.join(words)} "
        assert {i for i, w in items.items() if f" {' '.join(w)} " in whole} <= set(got[d].item_ids)
        if not any(tuple(words[i : i + 5]) in fives for i in range(len(words) - 4)):
            assert not got[d].contaminated


def test_components(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op8_ngram_jaccard_join")}
    assert got == brute_components([(t, d) for d, t in documents.items()], 4, 85, 100)


def test_order(spark, documents):
    got = sorted(rows(spark, "op9_training_order"), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got))) and [r.doc_id for r in got] != sorted(r.doc_id for r in got)
    folder = got[0].path.rsplit("/", 1)[0]
    assert [p.tobytes() for p in read_slots(folder, 3)] == [bytes(r.tokens) for r in got[3:]]
    held = {}
    for r in sorted(got, key=lambda r: r.seq_no):
        held.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.tokens), "<u2")[: r.n_tokens].tolist())
    decode = encoder(vocabulary(TOKENIZER)).decode
    assert {d: decode(t[:-1]) for d, t in held.items()} == {d: t or "" for d, t in documents.items()}


def test_pipeline(spark, documents):
    """What is left has letters, no near copies and no benchmark items, and every slot is on its shard."""
    got = sorted(rows(spark, "pipeline"), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    kept = sorted({r.doc_id for r in got})
    assert kept and set(kept) <= documents.keys() and all(re.search(r"[^\W\d_]", documents[d]) for d in kept)
    components = brute_components([(documents[d], d) for d in kept], 5, 80, 100)
    assert [d for d in kept if components[d][1] != d] == []
    items = [f" {' '.join(plain(t))} " for _, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    assert not any(i in f" {' '.join(plain(documents[d]))} " for d in kept for i in items)
    assert [p.tobytes() for p in read_slots(got[0].path.rsplit("/", 1)[0])] == [bytes(r.tokens) for r in got]
