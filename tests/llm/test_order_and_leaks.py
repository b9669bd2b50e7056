"""Token shards by exact round trip, mixing by its distribution, leaks and language by planted cases, WARC records."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewatch.llm import language_id, line_crf
from tomewatch.llm.decontaminate import _lcs, find_leaks
from tomewatch.llm.exact_dedup import exact_dedup
from tomewatch.llm.mixing import poisson_mix
from tomewatch.llm.token_shards import END, TOKENIZER, encode, encoder, permute, read_slots, token_ids, training_order, vocabulary, write_shards
from tomewatch.llm.warc import record_text, responses_of_pages, warc_derivatives

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot long, n string, rate double, copy string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], DOCS)


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        got = permute(np.arange(n), n, key=5)
        assert sorted(got.tolist()) == list(range(n))
    assert permute(np.arange(1000), 1000, 5).tolist() != permute(np.arange(1000), 1000, 6).tolist()


def test_long_white_space():
    encoding = encoder(vocabulary(TOKENIZER))
    rng = random.Random(1)
    for _ in range(12):
        parts = [rng.choice(["a", "Bé x", "12", "!?", "'s"]) + rng.choice([" ", "\n", "\t \n", "\u3000"]) * rng.choice([1, 3, 6_000, 11_000]) for _ in range(4)]
        for t in ("".join(parts), "".join(parts) + "end", " " * 10_000 + parts[0]):
            assert encode(encoding, t) == encoding.encode_ordinary(t)
    assert encode(encoding, None) == [] and encoding.decode(encode(encoding, " " * 3_000_000 + "x")) == " " * 3_000_000 + "x"


def test_pieces_and_ids():
    import tiktoken

    encoding = encoder(vocabulary(TOKENIZER))
    published = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    plain = tiktoken.Encoding("published", pat_str=published, mergeable_ranks=encoding._mergeable_ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["a", "é", " ", "  ", "\n", "\r\n", "\u3000", "1", "٣", "!", "'s", "'re", "'S", "'", "<|endoftext|>", "\u0301", "😀", "\x1c", "\x85", "中"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        got = token_ids(encoding, t)
        assert isinstance(got, np.ndarray) and got.tolist() == plain.encode_ordinary(t) and len(got) <= len(t.encode())


def test_training_order_round_trip(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "béta", "γ", "12,5", "x\ny"]) for _ in range(rng.choice([0, 1, 30, 400]))) for _ in range(60)]
    texts += [None, "", texts[0], "z" * 50_000]
    rows = [(k if k != 5 else None, t) for k, t in enumerate(texts)]
    got = training_order(docs(spark, rows).repartition(3), sequence=16, shard=10)
    out = got.collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    assert all(r.shard == r.slot // 10 and r.byte_offset == r.slot % 10 * 32 and len(r.tokens) == 32 for r in out)
    by_doc = {}
    for r in sorted(out, key=lambda r: r.seq_no):
        by_doc.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.tokens), np.uint16)[: r.n_tokens].tolist())
    decode = encoder(vocabulary(TOKENIZER)).decode
    for k, t in rows:
        assert by_doc[k][-1] == END and decode(by_doc[k][:-1]) == (t or "")
    written = {r.shard: r for r in write_shards(got, f"file://{tmp_path}").collect()}
    slots = {r.slot: bytes(r.tokens) for r in out}
    for s, r in written.items():
        data = (tmp_path / f"shard-{s:08d}.bin").read_bytes()
        assert len(data) == r.bytes and data == b"".join(slots[k] for k in sorted(slots) if k // 10 == s)
    for start in (0, 1, 9, 10, 37, len(slots) - 1, len(slots)):
        assert [p.tobytes() for p in read_slots(f"file://{tmp_path}", start)] == [slots[k] for k in range(start, len(slots))]
    assert training_order(docs(spark, [])).count() == 0
    # the same rows again, onto the files that are there, and a folder of no sequences
    before = {p.name: p.read_bytes() for p in tmp_path.glob("shard-*.bin")}
    assert {r.shard: r for r in write_shards(got, f"file://{tmp_path}").collect()} == written and {p.name: p.read_bytes() for p in tmp_path.glob("shard-*.bin")} == before
    assert not list((tmp_path / "_temporary").iterdir())
    write_shards(training_order(docs(spark, []), sequence=16, shard=10), f"file://{tmp_path}/none").collect()
    assert list(read_slots(f"file://{tmp_path}/none")) == []
    # an incomplete or cut folder is no shorter one
    last = max(written)
    (tmp_path / f"shard-{last:08d}.bin").write_bytes(b"xx")
    with pytest.raises(ValueError):
        list(read_slots(f"file://{tmp_path}"))
    (tmp_path / "shard-00000001.bin").unlink()
    reader = read_slots(f"file://{tmp_path}")
    assert [next(reader).tobytes() for _ in range(10)] == [slots[k] for k in range(10)]
    with pytest.raises(FileNotFoundError):
        next(reader)
    with pytest.raises(FileNotFoundError):
        next(read_slots(f"file://{tmp_path}/nowhere"))


def test_put_where_a_move_refuses(tmp_path):
    """File systems that do not rename onto a file: the attempt that comes second drops its own."""
    from pyarrow import fs

    from tomewatch.llm.token_shards import put

    store = fs.LocalFileSystem()

    class Refusing:
        get_file_info, delete_file = store.get_file_info, store.delete_file
        meanwhile = False

        def move(self, name, target):
            if self.meanwhile:
                (tmp_path / "there").write_bytes(b"1")
            raise OSError("exists")

    (tmp_path / "a").write_bytes(b"1")
    with pytest.raises(OSError):
        put(Refusing(), str(tmp_path / "a"), str(tmp_path / "there"))
    late = Refusing()
    late.meanwhile = True
    put(late, str(tmp_path / "a"), str(tmp_path / "there"))
    assert (tmp_path / "there").read_bytes() == b"1" and not (tmp_path / "a").exists()


def test_mixing(spark):
    rows = [(k, f"t{k}", "en", "big" if k % 3 else ("small" if k % 2 else None)) for k in range(3000)] + [(7, "t7", "en", "big")]
    got = poisson_mix(docs(spark, rows), weights={"big": 1, "small": 2, None: 1}).withColumn("p", F.spark_partition_id()).collect()
    share = {s: sum(r.source == s for r in got) / len(rows) for s in ("big", "small", None)}
    assert abs(share["big"] - 0.25) < 0.05 and abs(share["small"] - 0.5) < 0.06 and abs(share[None] - 0.25) < 0.05
    assert [(r.p, r.mix_key) for r in got] == sorted((r.p, r.mix_key) for r in got) and len({r.mix_key for r in got}) > 2900
    for p in {r.p for r in got}:  # every partition is a mix of all sources and ids
        mine = [r for r in got if r.p == p]
        assert {r.source for r in mine} == {"big", "small", None} and abs(np.corrcoef([r.doc_id for r in mine], range(len(mine)))[0, 1]) < 0.15
    columns = poisson_mix(docs(spark, rows)).columns
    assert len(columns) == len(set(columns))
    per = {}
    for r in got:
        per.setdefault((r.doc_id, r.source), []).append(r.copy)
    assert all(sorted(set(c)) == list(range(max(c) + 1)) for c in per.values())
    counts = [len(per.get((k, "small"), [])) for k in range(3, 3000, 6)]
    rate = 3001 * 0.5 / 500
    assert abs(np.mean(counts) - rate) < 0.3 and abs(np.var(counts) - rate) < 0.7
    assert poisson_mix(docs(spark, [])).count() == 0
    assert poisson_mix(docs(spark, [(1, None, None, None)]), epochs=900.0).count() > 700


def test_exact(spark):
    rng = random.Random(4)
    texts = [rng.choice(["", None, "A", "a", "É", "é", "x" * 500 + rng.choice("ab"), "Y" * 500 + "b", str(rng.random())]) for _ in range(300)]
    rows = [(k * 7 % 300, t) for k, t in enumerate(texts)] + [(None, "A"), (None, "only null id")]
    for limit in (0, 1000):
        got = exact_dedup(docs(spark, rows), broadcast_groups=limit).collect()
        low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        groups = {}
        for k, t in rows:
            groups.setdefault(low(t), []).append(-1 if k is None else k)
        assert len(got) == len(rows)
        for r in got:
            g = groups[low(r.text)]
            own = -1 if r.doc_id is None else r.doc_id
            assert r.group_size == len(g) and (r.keep_id if r.keep_id is not None else -1) == max(g) and r.kept == (own == max(g))
    assert exact_dedup(docs(spark, [])).count() == 0


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = random.Random(3)
    for _ in range(200):
        a, b = [np.array([rng.randrange(6) for _ in range(rng.randrange(1, 70))], np.uint64) for _ in range(2)]
        assert _lcs(a, b) == brute_lcs(a.tolist(), b.tolist())


def test_leaks(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(rng.choice([12, 20, 40, 60, 150])) for _ in range(60)]
    rows, want = [], {}
    for k in range(120):
        body = [text(rng.choice([0, 10, 100, 400])), text(rng.choice([0, 30, 300]))]
        if k % 2 == 0:
            w = items[k // 2].split()
            if k % 4 == 0:  # a paraphrase: one word in eight changed, some dropped
                w = [word() if j % 8 == 3 else x for j, x in enumerate(w) if j % 16 != 9]
            body.insert(1, " ".join(w) + "!!")
            want[k] = k // 2
        rows.append((k, rng.choice(["\n", " "]).join(body).upper() if k % 6 == 0 else "\n".join(body)))
    rows += [(1000, None), (1001, ""), (None, "x"), (1002, items[0] + " ," + items[1]), (1003, "the of and " * 20_000)]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(90, "", "x"), (91, None, "x"), (None, "y", "x")], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in find_leaks(docs(spark, rows), bench, keep=("source",)).collect()}
    assert len(got) == len(rows)
    hit = [k for k, i in want.items() if i in got[k].item_ids]
    assert len(hit) >= 0.95 * len(want), set(want) - set(hit)
    assert not [k for k in range(1, 120, 2) if got[k].contaminated]
    assert got[1002].item_ids == [0, 1] and not any(got[k].contaminated for k in (1000, 1001, 1003, None))
    parts = find_leaks(docs(spark, rows), bench, passages_at_once=25).collect()
    assert {r.doc_id: r.item_ids for r in parts} == {k: r.item_ids for k, r in got.items()}
    assert find_leaks(docs(spark, []), bench).count() == 0
    assert find_leaks(docs(spark, rows[:3]), bench.limit(0)).where("contaminated").count() == 0


def test_order_query_and_stage_write_shards(spark, tmp_path):
    """The query and the pipeline's last stage leave every slot's tokens at its offset in a shard."""
    import corpus_pipeline as c
    from tomewatch.llm.queries import op9_training_order

    frame = docs(spark, [(k, f"text number {k} " * (200 * (k % 7))) for k in range(400)])
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    for ordered in (op9_training_order(spark, str(tmp_path)), c.write_tokens(spark, frame, str(tmp_path))):
        out = ordered.collect()
        size = {}
        for r in out:
            with open(r.path.removeprefix("file://"), "rb") as f:
                f.seek(r.byte_offset)
                assert f.read(len(r.tokens)) == bytes(r.tokens)
            size[r.path.removeprefix("file://")] = size.get(r.path.removeprefix("file://"), 0) + len(r.tokens)
        files = list(Path(out[0].path.removeprefix("file://")).parent.iterdir())
        assert {str(f): f.stat().st_size for f in files if f.suffix == ".bin"} == size and not [f for f in files if f.name.startswith(".shard") and f.suffix != ".crc"]


def test_leaks_of_common_words(spark):
    """Words that every document holds still lead to a leak, in a table of one document too."""
    rng = random.Random(12)
    item = [f"w{rng.randrange(400)}" for _ in range(40)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [r.item_ids for r in find_leaks(docs(spark, [(1, " ".join(item))]), bench).collect()] == [[7]]
    around = [(k, f"{' '.join(f'd{k}x{j}' for j in range(30))} {' '.join(item)} end{k}") for k in range(20)]
    assert all(r.item_ids == [7] for r in find_leaks(docs(spark, around), bench).collect())


def test_leaks_miss_none_of_brute_force(spark):
    """Far more passages than the rank, over few words: all leaks that cover half of a passage's weight, and none that the checks reject."""
    rng = random.Random(13)
    word = lambda: f"w{int(rng.random() ** 3 * 300)}"
    items = [[word() for _ in range(rng.choice([3, 10, 25, 64, 110]))] for _ in range(150)]
    rows = []
    for k in range(150):
        held = [w if rng.random() > 0.25 else word() for w in rng.choice(items)]
        held = [w for w in held if rng.random() > rng.choice([0, 0.1, 0.3])]
        rows.append((k, " ".join([word() for _ in range(rng.randrange(120))] + held + [word() for _ in range(rng.randrange(120))])))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    code = {}
    ids = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws], np.uint64)
    passages = [(k, ids(t[s : s + 64])) for k, t in enumerate(items) for s in range(0, max(1, len(t) - 32), 32)]
    texts = {k: ids(t.split()) for k, t in rows}
    df = np.bincount(np.concatenate([np.unique(t) for t in texts.values()]).astype(int), minlength=len(code))
    weight = np.log((2 + len(rows)) / (1 + df)) ** 2
    want, may = {}, {}
    for k, text in texts.items():
        windows = [text[max(0, s - 16) : s + 80] for s in range(0, len(text), 16)]
        for i, p in passages:
            for w in windows:
                part = _lcs(p, w) / len(p)
                if part >= 0.9 or part >= 0.7 and _lcs(p[-6:], w) / len(p[-6:]) >= 0.5:
                    may.setdefault(k, set()).add(i)
                    if weight[p[np.isin(p, w)].astype(int)].sum() >= 0.5001 * weight[p.astype(int)].sum():
                        want.setdefault(k, set()).add(i)
    got = {r.doc_id: set(r.item_ids) for r in find_leaks(docs(spark, rows), bench).where("contaminated").collect()}
    assert len(want) > 50 and all(want[k] <= got.get(k, set()) for k in want) and all(got[k] <= may.get(k, set()) for k in got)


def test_language(spark):
    rng = random.Random(8)
    say = {"aa": ["kato", "mina", "suro", "peli"], "bb": ["wrax", "thug", "blorn", "strek"], "ru": ["слово", "дом", "река"]}
    rows = [(k, " ".join(rng.choice(say[l]) for _ in range(rng.choice([3, 40]))).title(), l) for k in range(150) for l in [rng.choice(list(say))]]
    model = language_id.train(docs(spark, [*rows, (900, None, "aa"), (901, "x", None)]))
    tests = [*rows, (1000, None, None), (1001, "", None), (1002, "12 !!", None), (1003, "qq", None), (None, "река " * 60_000, None), (1, rows[1][1], None)]
    got = language_id.identify(docs(spark, tests), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(tests) and sum(by[k].lang_pred == l for k, _, l in rows) == len(rows)
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[None].lang_pred == "ru" and by[1003].lang_pred in say
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(docs(spark, tests), language_id.train(docs(spark, []))).where("lang_pred <> 'und'").count() == 0


def test_languages_beyond_one_word(spark):
    """More than 64 languages; a document's votes equal those counted from sets of n-grams, but for false bits."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    say = {f"l{k:03d}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(3)] for k in range(150)}
    rows = [(k, " ".join(rng.choice(say[l]) for _ in range(12)), l) for k, l in enumerate([*say, *say, *say])]
    model = language_id.train(docs(spark, rows))
    assert model.names == sorted(say) and model.masks.shape[0] == 3
    held = {l: set() for l in say}
    grams = lambda text: [f" {w} "[i : i + 4] for w in text.split() for i in range(len(w) - 1)]
    for _, text, l in rows:
        held[l].update(grams(text))
    tests = [(k, " ".join(rng.choice(say[l]) for _ in range(8)), l) for k, l in enumerate(say)]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, tests), model).collect()}
    for k, text, l in tests:
        votes = {name: sum(g in own for g in grams(text)) for name, own in held.items()}
        assert got[k].lang_pred == max(sorted(votes), key=votes.get) == l
        assert abs(got[k].score - votes[l] / sum(votes.values())) < 0.02


def brute_marginals(odds, same):
    n, total, good = len(odds), 0.0, np.zeros(len(odds))
    for s in range(1 << n):
        y = [(s >> k) & 1 for k in range(n)]
        w = np.exp(sum(o * v for o, v in zip(odds, y)) + same * sum(a == b for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_marginals():
    rng = np.random.default_rng(1)
    row = np.repeat([0, 1, 2, 3], [1, 5, 3, 7])
    odds = rng.normal(size=len(row)) * 2
    got = line_crf.marginals(odds, row, 0.7)
    for r in range(4):
        assert np.allclose(got[row == r], brute_marginals(odds[row == r], 0.7))


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["plain", "words", "in", "a", "line"]) for _ in range(12)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$"]) for _ in range(12))
    rows = [(k, "\n".join((bad if k % 3 == 0 else good)() for _ in range(rng.randrange(1, 9)))) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0, "x") for k in range(150)], "doc_id long, quality int, toxic int, text string")
    field = line_crf.train(docs(spark, rows), labels)
    tests = [*rows, (900, None), (901, ""), (902, "\n \n"), (None, rows[1][1]), (903, good() + "\n" + (bad() + "\n") * 6000)]
    got = {r.doc_id: r for r in line_crf.score_documents(docs(spark, tests), field).collect()}
    assert all((got[k].score > 0.5) == (k % 3 > 0) for k in range(200)) and [got[k].score for k in (900, 901, 902)] == [0, 0, 0]
    assert got[903].n_lines == 6001 and got[903].n_bad_lines >= 5999 and got[None].score == got[1].score
    assert line_crf.train(docs(spark, rows), labels.limit(0)) is None
    assert line_crf.score_documents(docs(spark, []), field).count() == 0


def test_mixed_pages(spark):
    """Lines are latent: documents marked bad for half of their lines get good and bad lines apart."""
    rng = random.Random(10)
    good = lambda: " ".join(rng.choice(["plain", "words", "in", "a", "line"]) for _ in range(12)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "CLICK"]) for _ in range(16))
    page = lambda n, m: "\n".join([good() for _ in range(n)] + [bad() for _ in range(m)])
    rows = [(k, page(8, 0) if k % 3 else page(2, 9)) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(240)], "doc_id long, quality int")
    field = line_crf.train(docs(spark, rows + rows[:50]), labels)
    tests = [(k, page(6, 6)) for k in range(20)] + [(20, page(12, 0)), (21, page(0, 12)), (22, page(900, 900))]
    got = {r.doc_id: r for r in line_crf.score_documents(docs(spark, tests), field).collect()}
    assert all(got[k].n_lines == 12 and 4 <= got[k].n_bad_lines <= 7 for k in range(20))
    assert got[20].n_bad_lines == 0 and got[21].n_bad_lines == 12 and 850 <= got[22].n_bad_lines <= 901


def test_tilt():
    """After the tilt every document's length-weighted marginal agrees with its label, and those that did are untouched."""
    rng = np.random.default_rng(2)
    doc = np.repeat(np.arange(6), [1, 4, 9, 3, 5, 2])
    labels, odds = np.array([1, 0, 1, 0, 1, 0]), rng.normal(size=len(doc)) * 3
    share = rng.random(len(doc)) + 0.1
    share /= np.bincount(doc, weights=share)[doc]
    level = lambda o: np.bincount(doc, weights=share * line_crf.marginals(o, doc, 0.5))
    moved = line_crf.tilted(odds, doc, 0.5, share, doc, labels)
    before, after = level(odds), level(moved)
    assert all(after[labels == 1] >= line_crf.GOOD - 1e-3) and all(after[labels == 0] <= line_crf.BAD + 1e-3)
    fine = np.where(labels == 1, before >= line_crf.GOOD, before <= line_crf.BAD)
    assert np.array_equal(moved[fine[doc]], odds[fine[doc]])


def test_warc(spark):
    page = '<html lang="de"><head><title>T &amp;\n x</title><style>p{}</style></head><body><p>Gr&uuml;&#223;e&nbsp;&#x21;<br>a<b>b</b></p><script>no<p></script><a href="/u">L</a><!-- c -->'
    rows = [(1, "http://a/", page), (2, None, None), (1, "http://a/", page), (3, "http://b/", "plain &#xD800; &#99999999;" + "<p>z" * 30_000), (None, "u", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string")
    got = warc_derivatives(responses_of_pages(pages), keys=("page_id",)).withColumn("whole", record_text("header", "block")).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.whole == r.header + "\r\n" + r.block + "\r\n\r\n" and f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and r.record_id != r.refers_to
    text = next(r.block for r in got if r.page_id == 1 and r.record_type == "conversion")
    assert text == "T & x\nGrüße !\nab\nL"
    meta = next(r.block for r in got if r.page_id == 1 and r.record_type == "metadata")
    assert "title: T & x\r\nlanguage: de\r\noutlink: /u\r\n" in meta and "sourceDigest: sha256:" + hashlib.sha256(page.encode()).hexdigest() in meta
    assert warc_derivatives(responses_of_pages(pages.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["und", "kept"])
def test_pipeline_stages(spark, tmp_path, name):
    import corpus_pipeline as c

    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    base = [text(80) for _ in range(12)]
    leak = text(30)
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(20, base[0] + " tail", "en", "s0", 5), (21, base[1], "en", "s1", 5), (22, f"{text(40)} {leak} {text(40)}", "en", "s1", 4), (23, "123", "en", "s2", 3), (24, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path / "sf")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    if name == "und":
        out = frame
        for stage, left in zip([f for _, f in c.STAGES[:3]], [set(range(12)) | {20, 21, 22}, set(range(12)) | {22}, set(range(12))], strict=True):
            out = stage(spark, out, folder)
            assert out.columns == c.COLUMNS and {r.doc_id for r in out.collect()} == left
        return
    got = c.run(spark, folder).collect()
    tokens = encoder(vocabulary(TOKENIZER))
    kept = {r.doc_id for r in got}
    assert kept <= set(range(12)) and sorted(r.slot for r in got) == list(range(len(got)))
    one = next(r for r in got if r.seq_no == 0)
    assert tokens.decode(np.frombuffer(bytes(one.tokens), np.uint16)[: one.n_tokens - 1].tolist()) == base[one.doc_id]


def test_mixing_steep_sources(spark):
    """A source of one row among many: counts as the exact distribution says, copies spread over tasks, in steps as the root of the rate."""
    import math
    import time
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    n = 200_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "one").when(F.col("id") < 40, "few").otherwise("many").alias("source"), F.lit("w").alias("text"))
    began = time.time()
    mixed = poisson_mix(rows).withColumn("p", F.spark_partition_id())
    got = mixed.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "copy").alias("d"), F.countDistinct("p").alias("p"), F.max("n_copies").alias("most"), F.max("rate").alias("rate")).collect()
    assert time.time() - began < 60
    of = {r["source"]: r for r in got}
    assert all(r["n"] == r["d"] and r["p"] > 1 and abs(r["n"] - n / 3) < 6 * math.sqrt(n / 3) for r in got)
    rate = of["one"]["rate"]
    u = int(__import__("hashlib").md5(b"17:7").hexdigest()[:13], 16) / (1 << 52)
    term = total = (-Decimal(rate)).exp()
    k = 0
    while total <= Decimal(u):
        k += 1
        term = term * Decimal(rate) / k
        total += term
    assert of["one"]["most"] == of["one"]["n"] == k


def test_mixing_of_literals(spark):
    """A frame whose source is a literal."""
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    assert poisson_mix(rows).count() == poisson_mix(spark.createDataFrame(rows.collect(), rows.schema)).count()
