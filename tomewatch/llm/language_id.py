"""Language identification with bit-sliced Bloom filters of n-grams.

Slot i of the filter holds one bit per language. An n-gram is set in k slots with the bit of every language that
contains it, so AND-ing its k slots gives the bitmask of all languages that contain it in one look-up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .kernels import U, chunks, mix

UNDETERMINED = "und"
#: Least number of slots of the filter (a power of two), and slots for each n-gram that it holds.
SLOTS, SLOTS_A_GRAM = 1 << 18, 8
HASHES = 3
#: A language contains an n-gram if it is at least this part of the language's n-grams; at most 500,000 n-grams are.
MIN_SHARE = 2e-6
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class LanguageFilters:
    """names[i] is the language of bit i mod 64 of word i div 64 of a slot; false_rate[i] is the chance of a false bit."""

    names: list[str]
    masks: np.ndarray
    false_rate: np.ndarray


def _padded(texts: pa.Array) -> pa.Array:
    lowered = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    return pc.binary_join_element_wise("", lowered, "", " ")


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-byte windows as numbers, row) of padded texts; the middle bytes are letters, other bytes count as spaces."""
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    letter = _LETTER[data]
    code = np.where(letter, data, 32).astype(np.uint32)
    keep = letter[1:-2] & letter[2:-1]
    # windows that cross into another row
    for k in (1, 2, 3):
        at = offsets[1:-1] - k
        keep[at[(at >= 0) & (at < len(keep))]] = False
    at = np.flatnonzero(keep)
    gram = (code[at] << 24) | (code[at + 1] << 16) | (code[at + 2] << 8) | code[at + 3]
    return gram, np.searchsorted(offsets, at, "right") - 1


def _slots(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    """HASHES slots of each n-gram."""
    h = mix(grams.astype(U) + U(0x632BE59BD9B4E019))
    return [(mix(h + U(j)) & U(slots - 1)).astype(np.int64) for j in range(HASHES)]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageFilters:
    """Count the n-grams of every row with a language, and build the filters.

    All rows and whole texts are counted: each task sums its own counts per language and Spark adds them up. A
    language contains the n-grams of a share of MIN_SHARE or more, so at most 1 / MIN_SHARE of them whatever the
    input's size; rarer ones say nothing about a language. The filter has SLOTS_A_GRAM slots for each, of one 64-bit word
    for every 64 languages; executors set its bits and the driver gets the slots that are not empty. Null languages
    teach nothing.
    """
    names = sorted(r[0] for r in docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string")).distinct().collect())

    def count(batches):
        held: list[list[tuple]] = [[] for _ in names]

        def merge(parts):
            keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            new, at = np.unique(keys, return_inverse=True)
            return new, np.bincount(at, weights=counts).astype(np.int64)

        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for k, name in enumerate(names):
                mine = np.flatnonzero(langs == name)
                if not len(mine):
                    continue
                for _, _, data, offsets in chunks(_padded(b.column(1).take(pa.array(mine)))):
                    keys, counts = np.unique(_grams(data, offsets)[0], return_counts=True)
                    held[k].append((keys, counts))
                    if len(held[k]) > 20:
                        held[k] = [merge(held[k])]
        for k, parts in enumerate(held):
            if parts:
                keys, counts = merge(parts)
                for lo in range(0, len(keys), 20_000):
                    part = slice(lo, lo + 20_000)
                    n = len(keys[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, k, np.int32)), pa.array(keys[part].astype(np.int64)), pa.array(counts[part])], ["lang", "gram", "n"]
                    )

    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    counted = labelled.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    member = counted.join(F.broadcast(totals), "lang").where(F.col("n") >= MIN_SHARE * F.col("total")).select("lang", "gram")
    member = checkpointed(member)
    grams = member.select("gram").distinct().count()
    slots = max(SLOTS, 1 << (SLOTS_A_GRAM * max(grams, 1) - 1).bit_length())

    def set_bits(batches):
        for b in batches:
            lang = b.column(0).to_numpy()
            bit = (U(1) << (lang % 64).astype(U)).view(np.int64)
            for at in _slots(b.column(1).to_numpy(), slots):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang // 64, pa.int32()), pa.array(bit)], ["slot", "word", "bits"])

    filled = member.mapInArrow(set_bits, "slot long, word int, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toPandas()
    masks = np.zeros((max(1, -(-len(names) // 64)), slots), U)
    masks[filled["word"].to_numpy(dtype=np.int64), filled["slot"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64).view(U)
    fill = np.array([((masks[k // 64] >> U(k % 64)) & U(1)).mean() for k in range(len(names))])
    return LanguageFilters(names, masks, fill**HASHES)


def identify(
    docs: DataFrame, model: LanguageFilters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``, and the columns named in ``keep``.

    Each 4-byte window of the lower-cased text that has letters in its middle votes for all languages in its
    mask. A language's count c of n windows is corrected for the filter's false positives: (c - n f) / (1 - f),
    at least 0. The largest corrected count wins, ties going to the first name; the score is its share of all
    corrected counts. A text without a letter, empty or null, is ``und`` with score 0; a text with letters of
    which no window is known gets the first name with score 0. Whole texts are read; a map over rows without a
    shuffle, one broadcast of the filter (2 MB, or 64 bytes an n-gram and 64 languages if that is more). Null ids pass through; repeated rows are judged alike; other columns are
    not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            lettered = pc.match_substring_regex(b.column(1).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            padded = _padded(b.column(1))
            names, scores = [], []
            for lo, hi, data, offsets in chunks(padded):
                gram, row = _grams(data, offsets)
                mask = np.full((len(m.masks), len(gram)), ~U(0))
                for slot in _slots(gram, m.masks.shape[1]):
                    mask &= m.masks[:, slot]
                n = np.bincount(row, minlength=hi - lo)
                votes = np.zeros((hi - lo, max(1, len(m.names))))
                for k, f in enumerate(m.false_rate):
                    c = np.bincount(row, weights=((mask[k // 64] >> U(k % 64)) & U(1)).astype(np.float64), minlength=hi - lo)
                    votes[:, k] = np.maximum(0, (c - n * f) / (1 - f)) if f < 1 else 0
                best, total = votes.argmax(1), votes.sum(1)
                score = np.divide(votes.max(1), total, out=np.zeros(hi - lo), where=total > 0)
                for j in range(hi - lo):
                    ok = lettered[lo + j] and m.names
                    names.append(m.names[best[j]] if ok else UNDETERMINED)
                    scores.append(float(score[j]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, *keep, "lang_pred", "score"]
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text"), *keep).mapInArrow(run, f"{schema}, lang_pred string, score double")
