"""Toxicity: a linear classifier over words, regularised by counterfactual sentences.

In every labelled text that names a group, the group's word is swapped for every other word of its family, and training penalises the
squared change of the score, beside the logistic loss and a ridge. A group's name thus carries no weight of its own, and a
neutral mention is not a sign of toxicity, even where the labelled texts happen to mention some groups in toxic texts only.

Features are the words of a text (lower case, punctuation stripped) and their first four letters, each counted once a text. Spark counts, in a bounded
sample of labelled rows (``sample_rows``), in how many texts of either label each occurs; the ``features`` most telling ones are the
model's vocabulary, a table of bounded size. Scoring is one pass over all rows and whole texts without a shuffle.

Defined cases: null texts count as empty; an empty text has no features and gets the score of the intercept; without usable labels
every score is 0.5; rows are scored one by one, so repeated rows repeat their score; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import codes_of, distinct, held_out, labelled_sample, pieces_of, slices, texts_of
from fieldloom.session import materialise

SAMPLE_ROWS, FEATURES, LEAST_TEXTS, STEM = 20_000, 4096, 4, 4
# Words that name groups of people, by family; a word is swapped within its family only.
FAMILIES = (
    ("women", "men", "girls", "boys", "mothers", "fathers", "females", "males"),
    ("woman", "man", "girl", "boy", "mother", "father", "female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants"),
    ("immigrant", "refugee", "foreigner", "native", "migrant"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
)


def features_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The distinct features of every text: the text each belongs to, and its name ("w:" a word, "s:" the start of one)."""
    words, owner = pieces_of(pc.ascii_split_whitespace(pc.utf8_lower(texts)))
    code, names = codes_of(words)
    plain = pc.utf8_trim(names, characters=".,;:!?\"'()[]{}<>#*$%&|-_/\\")
    keep = pc.greater(pc.utf8_length(plain), 0).to_numpy(zero_copy_only=False)
    long = pc.greater(pc.utf8_length(plain), STEM).to_numpy(zero_copy_only=False)
    word = pc.binary_join_element_wise(pa.scalar("w"), plain, ":")
    stem = pc.binary_join_element_wise(pa.scalar("s"), pc.utf8_slice_codeunits(plain, 0, STEM), ":")
    own, alias = codes_of(pa.concat_arrays([word, stem]))
    pairs = [owner[keep[code]] * len(alias) + own[:len(names)][code[keep[code]]], owner[long[code]] * len(alias) + own[len(names):][code[long[code]]]]
    found = distinct(np.concatenate(pairs))
    return found // max(1, len(alias)), alias.take(pa.array(found % max(1, len(alias)))) if len(found) else pa.array([], pa.string())


@dataclass
class Linear:
    names: list
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, names = features_of(texts)
        place = pc.index_in(names, value_set=pa.array(self.names, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        known = place >= 0
        total = np.bincount(owner[known], self.weights[place[known]], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def swaps(names: list, families=FAMILIES) -> list[list[tuple[int, ...]]]:
    """For each family the features (word and start) of its words, as places in ``names``."""
    place = {n: i for i, n in enumerate(names)}
    return [[tuple(place[f] for f in (f"w:{w}", f"s:{w[:STEM]}") if f in place) for w in family] for family in families]


def fit_linear(rows: list[np.ndarray], label: np.ndarray, names: list, families=FAMILIES, counterfactual: float = 4.0, ridge: float = 1e-3,
               steps: int = 400, rate: float = 0.1) -> Linear:
    """Minimise logistic loss + ridge + counterfactual * mean squared score change under swaps, by full-batch Adam steps.

    ``rows`` holds the places in ``names`` of every text's features.
    """
    n, width = len(rows), len(names)
    if n == 0:
        return Linear(names, np.zeros(width), 0.0)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    place = np.concatenate(rows).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    mean = (label.sum() + 0.5) / (n + 1)
    weight_of = np.where(label == 1, 0.5 / mean, 0.5 / (1 - mean))  # both labels count alike
    gone, come, pair = [], [], []  # features that a swap takes away and brings
    has = [set(r.tolist()) for r in rows]
    count = 0
    for family in swaps(names, families):
        for own in has:
            for i, word in enumerate(family):
                if word and own.issuperset(word):
                    for j, other in enumerate(family):
                        if i != j:
                            away, new = set(word) - set(other), set(other) - set(word) - own
                            if away or new:
                                gone.append((count, sorted(away))), come.append((count, sorted(new)))
                                count += 1
    swap_row = np.array([k for side in (gone, come) for k, f in side for _ in f], np.int64)
    swap_place = np.array([x for side in (gone, come) for _, f in side for x in f], np.int64)
    swap_sign = np.concatenate([np.full(sum(len(f) for _, f in gone), -1.0), np.full(sum(len(f) for _, f in come), 1.0)])
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[place], n) + b
        slope = weight_of * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / n
        grad = np.bincount(place, slope[owner], width) + ridge * w
        if count:
            change = np.bincount(swap_row, swap_sign * w[swap_place], count)
            grad += counterfactual / count * np.bincount(swap_place, swap_sign * change[swap_row], width)
        g = np.append(grad, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Linear(names, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, families=FAMILIES, counterfactual: float = 4.0,
        label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """Fit on at most ``sample_rows`` labelled documents and ``features`` features; both bound what is broadcast and gathered."""
    sample = labelled_sample(labels, label, sample_rows, id_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(sample), id_col).select(F.col(id_col).cast("string").alias("id"), "text", "label")

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                owner, names = features_of(texts_of(part, "text"))
                at = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(at, pa.int32()), names.cast(pa.string()))], ["id", "label", "names"])

    described = materialise(rows.mapInArrow(describe, "id string, label int, names array<string>").orderBy("id", "label").limit(sample_rows), "toxicity-sample")
    sums = described.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, pos = sums["n"], sums["pos"] or 0
    counted = described.select("label", F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("texts"), F.sum("label").alias("toxic"))
    # how far the share of toxic texts with the feature is from the overall share, in standard deviations
    share = F.lit(pos / n if n else 0.0)
    telling = F.abs(F.col("toxic") - F.col("texts") * share) / F.sqrt(F.col("texts") * share * (1 - share) + 1e-9)
    group_words = [f"{k}:{w if k == 'w' else w[:STEM]}" for family in families for w in family for k in "ws"]
    chosen = counted.where(F.col("texts") >= LEAST_TEXTS).orderBy(telling.desc(), "name").limit(features).select("name").toArrow()["name"].to_pylist()
    present = counted.where(F.col("name").isin(group_words)).select("name").toArrow()["name"].to_pylist()
    names = sorted({*chosen, *present})
    table = _restricted(described, names).toArrow()
    place = {x: i for i, x in enumerate(names)}
    places = [np.array([place[x] for x in r], np.int64) for r in table["names"].to_pylist()]
    return fit_linear(places, table["label"].to_numpy().astype(np.float64), names, families, counterfactual)


def _restricted(described: DataFrame, names: list) -> DataFrame:
    """label and those features of each sampled text that the vocabulary holds."""
    wanted = pa.array(names, pa.string())

    def restrict(batches):
        for batch in batches:
            lists = batch.column(1)
            values, owner = pieces_of(lists)
            keep = pc.is_in(values, value_set=wanted)
            at = np.searchsorted(owner[keep.to_numpy(zero_copy_only=False)], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values.filter(keep))], ["label", "names"])

    return described.select("label", "names").mapInArrow(restrict, "label int, names array<string>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, sample_rows)

    def score(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(texts_of(part, "text")))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, docs.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
