"""Language identification by bit-sliced Bloom filters of byte n-grams.

A slot of the filter holds one bit for each language, so one lookup of an n-gram returns all languages that
contain it. A language's popcount over a document's n-grams is corrected for the false positives that its
filter's fill predicts, and the largest corrected share decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.llm.registry import query, table
from footlamp.llm.sampling import about
from footlamp.llm.words import held_out
from footlamp.plans.storage import cut_lineage

#: The filter is fitted on about so many documents of each language, and on so many of the commonest languages.
TRAIN_DOCS = 4000
MAX_LANGUAGES = 1024
#: Bits of a slot number: the filter has 2**SLOT_BITS slots and every n-gram sets two of them.
SLOT_BITS = 21
#: An n-gram belongs to a language that it makes up this share of (so a language has at most 100,000 of
#: them) and where it is at least a tenth as common as in the language that has it most.
LEAST_SHARE = 1e-5
LEAST_RATIO = 0.1
SLICE = 4_000_000
UNKNOWN = "und"

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


def ngrams(text: bytes) -> Iterator[np.ndarray]:
    """4-byte n-grams of the letters of a UTF-8 text, every run of other characters being one space.

    A long text is taken in slices; the last three bytes of one are carried into the next, so none is lost or doubled.
    """
    carry = np.zeros(0, dtype=np.uint8)
    for at in range(0, max(1, len(text)), SLICE):
        part = text[at : at + SLICE]
        raw = b" " * (at == 0) + part + b" " * (at + SLICE >= len(text))
        b = np.concatenate([carry, _FOLD[np.frombuffer(raw, dtype=np.uint8)]])
        keep = np.ones(len(b), dtype=bool)
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
        b = b[keep]
        carry = b[-3:]
        b = b.astype(np.uint32)
        if len(b) > 3:
            yield b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)


def slots(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of each n-gram, by multiplicative hashing."""
    g = grams.astype(np.uint64)
    shift = np.uint64(64 - SLOT_BITS)
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> shift, (g * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[int, list[np.ndarray]] = defaultdict(list)
        for no, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            by[no] += ngrams(text.as_py())
        for no, parts in by.items():
            if parts:
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), no, dtype=np.int32)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["no", "gram", "n"],
                )


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, second = slots(batch.column(1).to_numpy())
        no = np.concatenate([batch.column(0).to_numpy()] * 2)
        slot = np.concatenate([first, second]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(slot)], ["no", "slot"])


@dataclass
class LanguageModel:
    """``languages`` in code point order; ``masks[slot, word]`` has a bit for each of them; ``fill`` per language."""

    languages: list[str]
    common: str | None
    masks: np.ndarray
    fill: np.ndarray

    def shares(self, text: bytes) -> np.ndarray:
        """For each language the share of the text's n-grams that it contains, corrected for false positives."""
        hits, n = np.zeros(len(self.languages)), 0
        for grams in ngrams(text):
            a, b = slots(grams)
            n += len(grams)
            found = self.masks[a] & self.masks[b]
            if self.masks.dtype == np.uint8 and self.masks.shape[1] == 1:
                bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
                per = np.bincount(found[:, 0], minlength=256) @ bits
            else:
                view = np.ascontiguousarray(found).view(np.uint8).reshape(len(grams), -1)
                per = sum(np.unpackbits(view[i : i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(view), 65536))
            hits += per[: len(self.languages)]
        false = self.fill**2
        return np.maximum(0.0, hits / max(n, 1) - false) / np.maximum(1e-9, 1 - false)

    def decide(self, text: bytes) -> tuple[str, float]:
        """Language and score of a text that has a letter; ties go to the first language."""
        if not self.languages:
            return UNKNOWN, 0.0
        shares = self.shares(text)
        best = int(np.argmax(shares))
        if shares[best] <= 0:
            return self.common or UNKNOWN, 0.0
        return self.languages[best], float(min(1.0, shares[best]))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit the filter on the documents outside the held-out third that have a language and a text.

    Counting, choosing n-grams and setting bits are Spark aggregates; the driver gets one row for each slot in use, at most
    2**SLOT_BITS. Without such documents the model has no language.
    """
    rows = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(text)).alias("key"), F.col(text).cast("binary").alias("text")
    )
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    common = counts[0]["lang"] if counts else None
    languages = sorted((r["lang"] for r in counts), key=lambda s: s.encode())
    words = max(1, -(-len(languages) // 64))
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    masks = np.zeros((1 << SLOT_BITS, words), dtype=kind)
    if languages:
        spark = docs.sparkSession
        numbers = spark.createDataFrame(pa.table({"lang": pa.array(languages), "no": pa.array(range(len(languages)), pa.int32())}))
        sample = about(rows, "lang", F.col("key"), train_docs, {r["lang"]: r["n"] for r in counts}).join(numbers, "lang").select("no", "text")
        grams = sample.mapInArrow(_count, "no int, gram bigint, n bigint").groupBy("no", "gram").agg(F.sum("n").alias("n"))
        grams = cut_lineage(grams)
        total = grams.groupBy("no").agg(F.sum("n").alias("all"))
        share = grams.join(total, "no").select("no", "gram", (F.col("n") / F.col("all")).alias("share"))
        most = share.groupBy("gram").agg(F.max("share").alias("most"))
        chosen = share.join(most, "gram").where((F.col("share") >= LEAST_SHARE) & (F.col("share") >= LEAST_RATIO * F.col("most")))
        bits = chosen.select("no", "gram").mapInArrow(_slots, "no int, slot bigint")
        bit = F.expr("shiftleft(1L, no % 64)")
        word = F.floor(F.col("no") / 64).cast("int").alias("word")
        got = bits.groupBy("slot", word).agg(F.bit_or(bit).alias("mask")).toArrow()
        masks[got.column("slot").to_numpy(), got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64).astype(kind)
    fill = np.array([((masks[:, i // 64] >> kind(i % 64)) & kind(1)).mean() for i in range(len(languages))])
    return LanguageModel(languages, common, masks, fill)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` beside the columns ``keep`` of ``docs`` (all, if not given).

    ``score`` is the corrected share of the predicted language. Null texts and texts without a letter are ``und``
    with score 0. A text with letters but no known n-gram gets the commonest language with score 0. The filter, of
    a fixed number of slots, is broadcast; texts are not shuffled.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(keep))]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = zip(batch.column(len(names)), batch.column(len(names) + 1).to_pylist())
            said = [own.decide(t.as_py()) if letter else (UNKNOWN, 0.0) for t, letter in rows]
            extra = [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *extra], [*names, "told", "share"])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = "".join(f"{n} {t}, " for n, (_, t) in zip(names, kept.dtypes))
    asked = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(text).cast("binary").alias("text"), letter.alias("letter"))
    return asked.mapInArrow(predict, schema + "told string, share double").toDF(*keep, "lang_pred", "score")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    told = identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return told
