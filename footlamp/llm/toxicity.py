"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of a bounded sample of labelled documents. A term weighs by its use in the text, its idf over all documents, and
how strongly its presence tells the labels of the sample apart (the root of its likelihood ratio statistic), so that words that
both labels use alike count for little; none is left out. Rare terms have
postings; common ones have blocks of examples with the largest weight kept for each block. A search sums the postings, which puts
a floor under the ``K``-th cosine, and reads only blocks whose upper bound reaches it: the neighbours are exact. Votes fall with distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.llm.registry import query, table
from footlamp.llm.sampling import about
from footlamp.llm.words import held_out
from footlamp.plans.storage import cut_lineage

#: Labelled examples of each label in the index (about).
EXAMPLES = 2000
K = 10
#: A neighbour votes by its cosine over the nearest's, to this power.
VOTE_POWER = 8
#: Weight of the base rate among the votes, as that of the nearest neighbour.
PRIOR_WEIGHT = 0.25
BLOCK = 32
THRESHOLD = 0.7
#: Terms that more than this share of the examples hold are kept in blocks with their largest weights, others as postings.
COMMON_SHARE = 0.1
#: Cosines that differ by less may tie.
SLACK = 1e-11


def word_of(token: str) -> str:
    """A token from its first to its last letter; empty without a letter."""
    if token.isalpha():
        return token
    start, end = 0, len(token)
    while start < end and not token[start].isalpha():
        start += 1
    while end > start and not token[end - 1].isalpha():
        end -= 1
    return token[start:end]


def word_counts(text: str) -> Counter:
    """Lower-case words of a text with their counts."""
    found: Counter = Counter()
    for token, n in Counter(text.lower().split()).items():
        found[word_of(token)] += n
    del found[""]
    return found


def term_numbers(text: str, vocabulary: dict[str, int]) -> Counter:
    """Numbers of a text's terms for a fixed vocabulary, with their counts."""
    found: Counter = Counter()
    for token, n in Counter(text.lower().split()).items():
        number = vocabulary.get(token)
        if number is None and not (token[0].isalpha() and token[-1].isalpha()):
            number = vocabulary.get(word_of(token))
        if number is not None:
            found[number] += n
    return found


@dataclass
class ToxicityModel:
    """Postings of rare terms (``example`` and ``weight`` by term); blocks of weights and their largest of ``common`` terms."""

    vocabulary: dict[str, int]
    scale: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    base: float
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, BLOCK)))
    largest: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers in order and their weights, of length one."""
        terms = np.fromiter(counts, dtype=np.int64, count=len(counts))
        uses = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        order = np.argsort(terms)
        terms, uses = terms[order], uses[order]
        weights = (1.0 + np.log(uses)) * self.scale[terms]
        norm = np.sqrt((weights**2).sum())
        return terms, weights / norm if norm > 0 else weights

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Set the examples' vectors, in the order of ``ids``: postings of rare terms, blocks of common ones."""
        n_terms, n_blocks = len(self.scale), -(-len(vectors) // BLOCK)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        example = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        often = np.nonzero(np.bincount(term, minlength=n_terms) > COMMON_SHARE * len(vectors))[0]
        self.common = np.full(n_terms, -1, dtype=np.int32)
        self.common[often] = np.arange(len(often))
        dense = self.common[term] >= 0
        filled = np.zeros((len(often), n_blocks * BLOCK))
        filled[self.common[term[dense]], example[dense]] = weight[dense]
        self.blocks = filled.reshape(len(often), n_blocks, BLOCK)
        self.largest = self.blocks.max(axis=2, initial=0.0)
        term, weight, example = term[~dense], weight[~dense], example[~dense]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def from_rare(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the postings of rare terms add to the cosine of each example, by blocks."""
        low = self.starts[terms]
        sizes = self.starts[terms + 1] - low
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        n_blocks = self.largest.shape[1]
        return np.bincount(self.example[at], np.repeat(weights, sizes) * self.weight[at], minlength=n_blocks * BLOCK).reshape(n_blocks, BLOCK)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the ``k`` nearest examples with a cosine above 0, ties to the smaller id.

        The ``k``-th sum over rare terms is a floor of the ``k``-th cosine; blocks whose bound does not reach it are left out.
        """
        if not len(self.ids):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        sums = self.from_rare(terms, weights)
        row = self.common[terms]
        row, weights = row[row >= 0], weights[row >= 0]
        bounds = sums.max(axis=1) + weights @ self.largest[row]
        floor = np.partition(sums.ravel(), -k)[-k] if sums.size >= k else 0.0
        held = np.nonzero((bounds > 0) & (bounds >= floor - SLACK))[0]
        cosines = sums[held] + np.tensordot(weights, self.blocks[row[:, None], held], 1)
        at, found = (held[:, None] * BLOCK + np.arange(BLOCK)).ravel(), cosines.ravel()
        if len(found) > k:
            floor = max(floor, np.partition(found, -k)[-k])
        near = np.nonzero((found > 0) & (found >= floor - SLACK))[0]
        at, found = at[near], found[near]
        order = np.lexsort((self.ids[at], -np.round(found, 12)))[:k]
        return at[order], found[order]

    def score(self, counts: Counter) -> tuple[float, list[int], list[float]]:
        """Score, and as evidence the neighbours' ids and cosines."""
        at, cosine = self.nearest(*self.vector(counts)) if counts else ((), ())
        if not len(at):
            return self.base, [], []
        vote = (cosine / cosine[0]) ** VOTE_POWER * self.votes[at]
        prior = PRIOR_WEIGHT * self.votes[at[0]]
        score = (float((vote * self.labels[at]).sum()) + prior * self.base) / (float(vote.sum()) + prior)
        return min(1.0, max(0.0, score)), self.ids[at].tolist(), cosine.tolist()


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [word_counts(t.as_py()) for t in batch.column(3)]
        lists = [pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["id", "label", "share", "terms", "counts"])


def strengths(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The root of the likelihood ratio statistic of each term: in how many examples of each label it is, against equal rates."""
    rate = (toxic + clean) / max(1, n_toxic + n_clean)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1.0) / np.maximum(expected, 1e-300)), 0.0)

    sides = ((toxic, n_toxic), (clean, n_clean))
    return np.sqrt(np.maximum(0.0, 2 * sum(part(c, n * rate) + part(n - c, n * (1 - rate)) for c, n in sides)))


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int], text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and of documents with each term of the vocabulary, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                seen[-1] += 1
                if value.is_valid:
                    seen[list(term_numbers(value.as_py(), shared.value))] += 1
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "n"])

    got = docs.select(F.col(text).cast("string")).mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on about ``examples`` labelled documents of each label outside the held-out third.

    Rows with a null id, label or text are left out. An id with several labels counts as toxic if one says so,
    and one with several texts is learnt by the first of them in order. Without examples of both labels every
    text scores the base rate (0 without labels).
    """
    asked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    asked = asked.groupBy(F.col(key).alias("id")).agg(F.max((F.col(label) == 1).cast("int")).alias("label"))
    rates = asked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    base = sum(r["n"] for r in rates if r["label"]) / max(1, sum(r["n"] for r in rates))
    chosen = cut_lineage(about(asked, "label", F.col("id"), examples, {r["label"]: r["n"] for r in rates}).select("id", "label", "share"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    sample = cut_lineage(texts.join(chosen, "id").groupBy("id", "label", "share").agg(F.min("text").alias("text")))
    rows = sample.select(F.col("id").cast("bigint").alias("id"), "label", "share", "text")
    rows = rows.mapInArrow(_sample_terms, "id bigint, label int, share double, terms array<string>, counts array<bigint>").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["terms"]), key=lambda r: r["id"])
    n_toxic = sum(r["label"] for r in rows)
    if not 0 < n_toxic < len(rows):
        return ToxicityModel({}, np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0), base)
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    seen = np.zeros((2, len(vocabulary)))
    for r in rows:
        r["terms"] = [vocabulary[t] for t in r["terms"]]
        seen[r["label"], r["terms"]] += 1
    total, df = document_frequencies(docs, vocabulary, text)
    scale = (np.log((1 + total) / (1 + df)) + 1) * strengths(seen[1], seen[0], n_toxic, len(rows) - n_toxic)
    # examples with the same strongest term stand together, so that few blocks have a high bound
    rows.sort(key=lambda r: (-scale[r["terms"]].max(), r["terms"][int(scale[r["terms"]].argmax())], r["id"]))
    weight = {r["label"]: 1 / r["share"] for r in rows}
    least = min(weight.values())
    model = ToxicityModel(
        vocabulary, scale, np.array([r["id"] for r in rows], dtype=np.int64), np.array([float(r["label"]) for r in rows]),
        np.array([weight[r["label"]] / least for r in rows]), base,
    )
    model.index([model.vector(Counter(dict(zip(r["terms"], r["counts"])))) for r in rows])
    return model


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours, cosines`` of every row.

    Texts that are null, empty or without a word of the examples score the base rate. Equal texts are searched once a batch.
    The model grows with the sample only and is broadcast; texts are not shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            known: dict[str, tuple] = {}
            told = []
            for value in batch.column(2):
                value = value.as_py() or ""
                if value not in known:
                    known[value] = own.score(term_numbers(value, own.vocabulary))
                told.append(known[value])
            scores = [t[0] for t in told]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                 pa.array([t[1] for t in told], pa.list_(pa.int64())), pa.array([t[2] for t in told], pa.list_(pa.float64()))],
                ["doc_id", "held_out", "score", "predicted", "neighbours", "cosines"],
            )

    asked = docs.select(F.col(key).cast("bigint").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return asked.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, neighbours array<bigint>, cosines array<double>")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, with its nearest examples as evidence."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
