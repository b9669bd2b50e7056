"""Benchmark decontamination by latent semantic retrieval and a join on rare words, then longest-common-subsequence and answer checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, integer_ids
from .kernels import SKETCH_CELLS, U, chunks, count_sketch, distinct_sorted, span_hashes, words

#: Least rank of the latent space and extra random directions of the randomised SVD; its power iterations.
RANK, OVERSAMPLE, POWER = 48, 12, 2
#: Words of a benchmark passage, and words from one passage of an item to its next.
PASSAGE, STEP = 64, 32
#: Words of a block of a document; windows of two and of four blocks are compared with the passages.
BLOCK = 16
#: Benchmark passages that are held in memory and broadcast at once (some 15 MB); further ones are taken in turn.
PASSAGES_AT_ONCE = 20_000
#: A window is a candidate if its cosine and the part of the passage that it covers reach these.
MIN_COSINE, MIN_COVER = 0.5, 0.5
#: A candidate is a leak if its LCS holds ANSWERED of the passage and the document ANSWER of the item's answer, or if the LCS
#: holds SURE of the passage. The answer is the last words of the item, of which a document may hold the last passage only.
ANSWERED, ANSWER, SURE = 0.7, 0.5, 0.9
ANSWER_WORDS = 6
#: Hits among a passage's rarest words that the exact way asks of a window, and counts that it holds at once.
RARE_HITS, COUNTS_AT_ONCE = 6, 1 << 19
#: Blocks of a window as it is checked: one before its first and four after it.
SPREAD = 6
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of a chunk of lower-case texts: runs of letters and digits."""
    simple = _PLAIN[data]
    starts, ends, row = words(simple, offsets)
    return span_hashes(simple, starts, ends), row


def _cells(h: np.ndarray) -> np.ndarray:
    return (h % U(SKETCH_CELLS)).astype(np.int64)


@dataclass
class Space:
    """Latent space: per sketch cell a row of ``basis`` (or -1), weighted by its IDF. At most 200 MB at the least rank, by SKETCH_CELLS."""

    row_of: np.ndarray
    basis: np.ndarray


@dataclass
class Block:
    """Some benchmark passages: their items, words, item's answers, squared IDF of words, places in the latent space, rarest words.

    ``ends`` tells the passages that hold their item's answer themselves.

    Cell c of a rare word is in the passages ``owners[bounds[rare_of[c]] : bounds[rare_of[c] + 1]]``; ``need`` is how
    many of its rare words every leak of a passage holds.
    """

    items: np.ndarray
    tokens: list[np.ndarray]
    answers: list[np.ndarray]
    ends: np.ndarray
    weights: list[np.ndarray]
    latent: np.ndarray
    rare_of: np.ndarray
    bounds: np.ndarray
    owners: np.ndarray
    need: np.ndarray


def benchmark_passages(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words, answer, ends) of the passages of every item, at most PASSAGE words each, overlapping by half.

    ``answer`` is the item's last ANSWER_WORDS words, ``ends`` whether the passage is the one that they close.
    """

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in chunks(pc.utf8_lower(b.column(1))):
                h, row = plain_words(data, offsets)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                items, held, answers, ends = [], [], [], []
                for k in range(hi - lo):
                    own = h[cut[k] : cut[k + 1]]
                    for s in range(0, max(1, len(own) - STEP), STEP):
                        if len(own):
                            items.append(b.column(0)[lo + k].as_py())
                            held.append(own[s : s + PASSAGE].tobytes())
                            answers.append(own[-ANSWER_WORDS:].tobytes())
                            ends.append(s + PASSAGE >= len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.int64()), pa.array(held, pa.binary()), pa.array(answers, pa.binary()), pa.array(ends, pa.bool_())], ["item", "words", "answer", "ends"]
                )

    named = benchmark.where(F.col(item_col).isNotNull()).select(integer_ids(benchmark, item_col), F.col(text_col).cast("string"))
    return named.mapInArrow(run, "item long, words binary, answer binary, ends boolean").distinct()


def document_frequency(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """In how many documents each cell's words occur, over all rows; a table of a fixed size."""
    return count_sketch(docs, lambda d, o: distinct_sorted(*plain_words(d, o))[0], text_col, pc.utf8_lower)


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(cells, basis): right singular vectors of the TF-IDF matrix of ``passages``, by cell that occurs.

    Randomised subspace iteration. The matrix stays distributed: each task multiplies its rows with the current
    directions and emits one vector per cell that it touched, which Spark sums. The driver holds and
    orthonormalises the directions only: cells (at most SKETCH_CELLS) times rank plus OVERSAMPLE numbers.
    """
    sc = passages.sparkSession.sparkContext
    width = rank + OVERSAMPLE
    weight = sc.broadcast(idf)
    columns = ["cell", *[f"v{k}" for k in range(width)]]

    def project(held):
        def run(batches):
            row_of, basis = held.value
            for b in batches:
                sums: dict[int, np.ndarray] = {}
                for w in b.column(0):
                    cell, n = np.unique(_cells(np.frombuffer(w.as_buffer(), U)), return_counts=True)
                    x = n * weight.value[cell]
                    x = x / (np.linalg.norm(x) or 1)
                    y = x @ basis[row_of[cell]]
                    for c, v in zip(cell.tolist(), x.tolist(), strict=True):
                        sums[c] = sums[c] + v * y if c in sums else v * y
                if sums:
                    m = np.array(list(sums.values()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *[pa.array(m[:, k]) for k in range(width)]], columns)

        rows = passages.select("words").mapInArrow(run, ", ".join(f"{c} {'long' if c == 'cell' else 'double'}" for c in columns))
        return rows.groupBy("cell").agg(*[F.sum(c).alias(c) for c in columns[1:]]).toPandas().sort_values("cell")

    def used(batches):
        for b in batches:
            cells = [_cells(np.frombuffer(w.as_buffer(), U)) for w in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(cells)) if cells else [], pa.int64())], ["cell"])

    cells = np.sort(passages.select("words").mapInArrow(used, "cell long").distinct().toPandas()["cell"].to_numpy(dtype=np.int64))
    row_of = np.full(SKETCH_CELLS, -1, np.int32)
    row_of[cells] = np.arange(len(cells))
    if not len(cells):
        return cells, np.zeros((0, rank), np.float32)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(cells), width)))[0]
    basis = np.hstack([basis, np.zeros((len(cells), width - basis.shape[1]))])
    for step in range(POWER + 1):
        sums = project(sc.broadcast((row_of, basis)))
        image = sums[columns[1:]].to_numpy()
        if step < POWER:
            q = np.linalg.qr(image)[0]
            basis = np.hstack([q, np.zeros((len(cells), width - q.shape[1]))])
    # Rayleigh-Ritz: the directions' own small eigenproblem orders them by singular value
    values, turn = np.linalg.eigh(basis.T @ image)
    best = np.argsort(-values)[:rank]
    return cells, (basis @ turn[:, best]).astype(np.float32)


def _lcs(pattern: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit of one number per word of ``pattern``."""
    masks: dict[int, int] = {}
    for k, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | (1 << k)
    full = (1 << len(pattern)) - 1
    v = full
    for w in text.tolist():
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


def rank_of(passages: int) -> int:
    """The rank for a number of passages: twice its root, at least RANK."""
    return max(RANK, 2 * math.isqrt(passages))


def _space(passages: DataFrame, idf: np.ndarray) -> Space:
    cells, basis = randomised_svd(passages, idf, rank_of(passages.count()))
    row_of = np.full(SKETCH_CELLS, -1, np.int32)
    row_of[cells] = np.arange(len(cells))
    return Space(row_of, basis * idf[cells][:, None].astype(np.float32))


def _rare_words(tokens: list[np.ndarray], frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rare_of, bounds, owners, need) of a block.

    A leak leaves out at most L - T of a passage's L words, T being ANSWERED of them. So of its L - T + k rarest
    words it holds at least k, whichever they are; ``frequency`` only decides how many windows that leaves.
    """
    cells, owners, need = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for p, t in enumerate(tokens):
        least = math.ceil(ANSWERED * len(t) - 1e-9)
        need.append(min(least, RARE_HITS))
        own = _cells(t)
        rarest = np.unique(own[np.argsort(frequency[own], kind="stable")[: len(t) - least + need[-1]]])
        cells.append(rarest)
        owners.append(np.full(len(rarest), p))
    cell, owner = np.concatenate(cells), np.concatenate(owners)
    order = np.argsort(cell, kind="stable")
    known, count = np.unique(cell, return_counts=True)
    rare_of = np.full(SKETCH_CELLS, -1, np.int32)
    rare_of[known] = np.arange(len(known))
    return rare_of, np.append(0, np.cumsum(count)), owner[order], np.array(need, np.uint8)


def _blocks(passages: DataFrame, space: Space, frequency: np.ndarray, idf: np.ndarray, size: int) -> Iterator[Block]:
    """All passages in blocks of ``size``, one block at a time on the driver."""
    items, tokens, answers, ends = [], [], [], []

    def block() -> Block:
        latent = np.stack([space.basis[space.row_of[_cells(t)]].sum(0) for t in tokens]) if tokens else np.zeros((0, space.basis.shape[1]), np.float32)
        return Block(np.array(items, np.int64), list(tokens), list(answers), np.array(ends, bool), [idf[_cells(t)] ** 2 for t in tokens], latent, *_rare_words(tokens, frequency))

    for r in passages.orderBy("item", "words", "answer", "ends").toLocalIterator():
        if len(items) == size:
            yield block()
            items, tokens, answers, ends = [], [], [], []
        items.append(r["item"])
        answers.append(np.frombuffer(bytes(r["answer"]), U))
        ends.append(r["ends"])
        tokens.append(np.frombuffer(bytes(r["words"]), U))
    yield block()


def _rare_windows(index: Block, h: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block, passage) of all windows that hold enough of a passage's rarest words, every leak among them.

    The words of a passage are counted by block, densely for some blocks at a time, and added up over windows.
    """
    size = len(index.items)
    # rows lie SPREAD - 1 empty blocks apart, so no window counts words of two rows
    at = np.arange(len(starts)) + (SPREAD - 1) * np.cumsum(np.append(0, owner[1:] != owner[:-1])) + 1
    known = index.rare_of[_cells(h)]
    hit = np.flatnonzero(known >= 0)
    known = known[hit]
    place = at[np.searchsorted(starts, hit, "right") - 1]
    step = max(1, COUNTS_AT_ONCE // size)
    for lo in range(0, len(starts), step):
        wanted = at[lo : lo + step]
        base, width = int(wanted[0]) - 1, int(wanted[-1] - wanted[0]) + SPREAD
        a, b = np.searchsorted(place, [base, base + width])
        if a == b:
            continue
        begin, count = index.bounds[known[a:b]], np.diff(index.bounds)[known[a:b]]
        ends = np.cumsum(count)
        passage = index.owners[np.arange(ends[-1]) + np.repeat(begin - ends + count, count)]
        held = np.bincount(np.repeat((place[a:b] - base) * size, count) + passage, minlength=width * size).astype(np.uint8).reshape(width, size)
        total = held[: width - SPREAD + 1].copy()
        for k in range(1, SPREAD):
            total += held[k : width - SPREAD + 1 + k]
        window, passage = np.nonzero(total[wanted - 1 - base] >= index.need)
        yield window + lo, passage


def _leaks(space: Space, index: Block, h: np.ndarray, row: np.ndarray, rows: int) -> dict[int, dict[int, tuple[float, float]]]:
    """{row: {item: (lcs part, cosine)}} of a chunk's words."""
    found: dict[int, dict[int, tuple[float, float]]] = {}
    if not len(h) or not len(index.items):
        return found
    length = np.linalg.norm(index.latent, axis=1)
    usable = np.flatnonzero(length > 0)
    first = np.searchsorted(row, np.arange(rows))
    place = np.arange(len(h)) - first[row]
    starts = np.flatnonzero(place % BLOCK == 0)
    known = space.row_of[_cells(h)]
    hit = np.flatnonzero(known >= 0)
    block = np.searchsorted(starts, hit, "right") - 1
    sums = np.zeros((len(starts), index.latent.shape[1]), np.float32)
    if len(hit):
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        sums[block[cut]] = np.add.reduceat(space.basis[known[hit]], cut, axis=0)
    owner = row[starts]
    masks: dict[int, dict[int, int]] = {}
    done: set[tuple[int, int]] = set()

    def answered(r: int, p: int, text: np.ndarray) -> bool:
        answer = index.answers[p]
        if not index.ends[p]:  # the answer may stand anywhere in the document
            whole = h[first[r] : first[r + 1] if r + 1 < rows else len(h)]
            text = whole[np.isin(whole, answer)]
        return _lcs(answer, text) / len(answer) >= ANSWER

    def judge(b: int, p: int, span: int, window: np.ndarray, covered: bool) -> None:
        r = int(owner[b])
        lo_word = max(int(first[r]), int(starts[b]) - BLOCK)
        hi_word = min(int(starts[b]) + (span + 1) * BLOCK, int(first[r + 1]) if r + 1 < rows else len(h))
        item = index.tokens[p]
        if p not in masks:
            masks[p] = dict.fromkeys(item.tolist(), 0)
        shared = [w for w in h[lo_word:hi_word].tolist() if w in masks[p]]
        if len(shared) < ANSWERED * len(item) - 1e-9:
            return
        text = np.array(shared, U)
        part_of = _lcs(item, text) / len(item)
        if part_of >= SURE or part_of >= ANSWERED and answered(r, p, text):
            if not covered:
                share = index.weights[p][np.isin(item, text)].sum() / index.weights[p].sum()
                if share < MIN_COVER:
                    return
            size = float(np.linalg.norm(window)) * float(length[p])
            cosine = float(window @ index.latent[p]) / size if size > 0 else 0.0
            best = found.setdefault(r, {}).get(int(index.items[p]), (0.0, 0.0))
            found[r][int(index.items[p])] = max(best, (part_of, cosine))

    for span in (2, 4):
        window = sums.copy()
        for k in range(1, span):
            joint = owner[k:] == owner[:-k] if len(owner) > k else np.zeros(0, bool)
            window[: len(joint)][joint] += sums[k:][joint]
        if not len(usable):
            continue
        size = np.linalg.norm(window, axis=1)
        # a window shorter in the latent space than the cover asked for covers no passage
        large = np.flatnonzero(size >= MIN_COVER * length[usable].min())
        for lo in range(0, len(large), 4096):
            part = large[lo : lo + 4096]
            dot = window[part] @ index.latent[usable].T
            ok = (dot >= MIN_COSINE * size[part][:, None] * length[usable]) & (dot >= MIN_COVER * length[usable] ** 2)
            for w, q in zip(*np.nonzero(ok), strict=True):
                b, p = int(part[w]), int(usable[q])
                if span == 4:
                    done.add((b, p))
                judge(b, p, span, window[b], covered=True)
    # windows of four blocks that the latent space missed; window now holds their sums
    for blocks, passages in _rare_windows(index, h, starts, owner):
        for b, p in zip(blocks.tolist(), passages.tolist(), strict=True):
            if (b, p) not in done:
                judge(b, p, 4, window[b], covered=False)
    return found


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: tuple[str, ...] = (),
    passages_at_once: int = PASSAGES_AT_ONCE,
) -> DataFrame:
    """Every row of ``docs`` with the benchmark items it leaks.

    Returns the id, ``contaminated``, ``item_ids`` (ascending) and ``matches`` (item_id, lcs, cosine), and the
    columns named in ``keep``.

    1. Document frequencies of all words over all of ``docs``, in a sketch of fixed size, give the IDF.
    2. A distributed randomised SVD of the TF-IDF benchmark passages gives the latent space.
    3. Every document's windows of 32 and 64 words, 16 words apart, are projected, in blocks of windows against
       all passages, ``passages_at_once`` of them held at a time. Words outside the benchmark project to
       nothing. A window is a candidate by its cosine and by how much of the passage's length it covers.
       Windows of 64 words that hold RARE_HITS of the passage's rarest words are candidates too, whatever the
       latent space says of them, if their words make up MIN_COVER of the passage's squared IDF. Step 4 lets no
       window with fewer rare words pass, so no rank and no cosine decides over a leak that covers its passage.
    4. A candidate, with a block more on both sides, is a leak if the longest common subsequence of words holds
       at least 70 % of the passage and if half of the item's answer, its last six words, stands there too, or if it
       holds 90 % of the passage. For passages that do not reach their item's end the answer is looked for in the
       whole document. Words are runs of letters and digits in lower case, so a paraphrase may change, add and drop words.

    A map over documents, so no document or passage is repeated over the network and no skew arises; each
    further block of passages costs a shared checkpoint and a pass. Item ids must be integers. Null and empty texts leak nothing, nor do
    benchmark rows without id or words. Null ids pass through; repeated rows are judged alike.
    """
    total = max(1, docs.count())
    frequency = document_frequency(docs, text_col)
    # above zero also for words that every document holds
    idf = np.log((2 + total) / (1 + np.minimum(frequency, total)))
    passages = checkpointed(benchmark_passages(benchmark, item_col))
    sc = docs.sparkSession.sparkContext
    space = sc.broadcast(_space(passages, idf))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("lcs", pa.float64()), ("cosine", pa.float64())]))
    names = [id_col, *[c for c in keep if c not in (id_col, text_col)]]

    def search(block):
        def run(batches):
            for b in batches:
                for lo, hi, data, offsets in chunks(pc.utf8_lower(b.column(0))):
                    h, row = plain_words(data, offsets)
                    found = _leaks(space.value, block.value, h, row, hi - lo)
                    out = []
                    for r, before in enumerate(b.column(1).slice(lo, hi - lo).to_pylist()):
                        best = {m["item_id"]: (m["lcs"], m["cosine"]) for m in before or ()}
                        for item, score in found.get(r, {}).items():
                            best[item] = max(best.get(item, (0.0, 0.0)), score)
                        out.append([{"item_id": i, "lcs": s[0], "cosine": s[1]} for i, s in sorted(best.items())])
                    rest = [c.slice(lo, hi - lo) for c in b.columns]
                    yield pa.RecordBatch.from_arrays([rest[0], pa.array(out, kind), *rest[2:]], b.schema.names)

        return run

    matches = "array<struct<item_id: long, lcs: double, cosine: double>>"
    judged = docs.select(F.col(text_col).cast("string").alias("_text"), F.array().cast(matches).alias("matches"), *names)
    schema = f"_text string, matches {matches}, " + ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    for k, block in enumerate(_blocks(passages, space.value, frequency, idf, passages_at_once)):
        judged = (checkpointed(judged) if k else judged).mapInArrow(search(sc.broadcast(block)), schema)
    items = F.transform("matches", lambda m: m["item_id"])
    text = [F.col("_text").alias(text_col)] if text_col in keep else []
    return judged.select(*names, *text, "matches", (F.size("matches") > 0).alias("contaminated"), items.alias("item_ids"))
