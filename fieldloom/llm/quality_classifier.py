"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are numpy reductions over Arrow batches of whole texts. The trees are fitted on a bounded sample of labelled rows
(``sample_rows``), whose statistics - a small float matrix - are gathered; scoring is one pass over all rows without a shuffle.
The trees are complete and flattened into arrays, so that a batch walks all trees level by level with array indexing.

Defined cases: a null text counts as empty; an empty text has zero in every statistic and gets the score of that point; without
usable labels every score is 0.5, with labels of one class only the score tends to that class; rows are scored one by one, so
repeated rows repeat their score; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import bytes_of, codes_of, held_out, labelled_sample, pieces_of, slices, texts_of, unused

SAMPLE_ROWS = 20_000
STATISTICS = 22


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS floats per text; every value is a ratio or a logarithm, so long texts need no special case."""
    n = len(texts)
    data, at = bytes_of(texts)
    size = np.diff(at).astype(np.float64)

    def share(mask):
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    def per(values, whole):
        return np.divide(values, whole, out=np.zeros(n), where=whole > 0)

    def is_any(chars):
        table = np.zeros(256, bool)
        table[list(chars)] = True
        return table[data]

    letters = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    upper, lower = share(letters[0]), share(letters[1])
    words, doc = pieces_of(pc.ascii_split_whitespace(texts))
    n_words = np.bincount(doc, minlength=n).astype(np.float64)
    word_bytes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.float64)
    code, _ = codes_of(words)
    span = int(code.max(initial=0)) + 1
    kinds, times = np.unique(doc * span + code, return_counts=True)
    kind_doc = kinds // span
    most = np.zeros(n)
    np.maximum.at(most, kind_doc, times)
    same = (doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, bool)
    triple_doc = doc[2:][same] if len(doc) > 2 else doc[:0]
    mixed = (code[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ code[1:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
             ^ (code[2:].astype(np.uint64) + np.uint64(1)) * np.uint64(0x165667B19E3779F9))[same] if len(doc) > 2 else np.zeros(0, np.uint64)
    order = np.lexsort((mixed, triple_doc))
    a, b = mixed[order], triple_doc[order]
    repeat = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])]) if len(a) else np.zeros(0, bool)
    again = np.bincount(b[repeat], minlength=n)
    triples = np.bincount(triple_doc, minlength=n).astype(np.float64)
    next_same = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (code[1:] == code[:-1])], minlength=n) if len(doc) > 1 else np.zeros(n)
    lines, line_doc = pieces_of(pc.split_pattern(texts, "\n"))
    n_lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    line_code, _ = codes_of(lines)
    line_kinds = np.unique(line_doc * (int(line_code.max(initial=0)) + 1) + line_code) // (int(line_code.max(initial=0)) + 1)
    first = np.zeros(len(words), bool)
    if len(words):
        head = np.frombuffer(bytes_of(words)[0], np.uint8)[bytes_of(words)[1][:-1]]
        first = (head >= 65) & (head <= 90)
    tail = np.zeros(len(lines), bool)
    if len(lines):
        line_data, line_at = bytes_of(lines)
        tail = np.isin(line_data[line_at[1:] - 1], list(b".!?"))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, word_bytes)
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), per(np.bincount(doc, word_bytes, n), n_words), np.log1p(longest),
        per(share(is_any(b"#*$%&|<>{}[]=~^_\\")), size), per(share(is_any(b"|")), size), per(share(is_any(b"!?")), size),
        per(share(is_any(b".,;:")), size), per(share(is_any(range(48, 58))), size), per(upper, (upper + lower).astype(np.float64)),
        per(lower, size), per(share(data >= 128), size), per(share(is_any(b" \t\r\n\x0b\x0c")), size),
        per(np.bincount(kind_doc, minlength=n), n_words), per(most, n_words), per(again, triples), per(next_same, n_words),
        np.log1p(n_lines), per(size, n_lines), 1 - per(np.bincount(line_kinds, minlength=n), n_lines) * (n_lines > 0) - (n_lines == 0),
        per(np.bincount(doc[first], minlength=n), n_words), per(np.bincount(line_doc[tail], minlength=n), n_lines),
    ]).astype(np.float32)


@dataclass
class Trees:
    """Complete trees of one depth: node i has the children 2i+1 and 2i+2; ``leaf`` holds the values of the last level."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def scores(self, rows: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.empty(len(rows))
        trees, inner = self.feature.shape
        every = np.arange(trees)[None, :]
        for k in range(0, len(rows), block):
            part = rows[k:k + block]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                value = part[np.arange(len(part))[:, None], self.feature[every, node]]
                node = 2 * node + 1 + (value > self.cut[every, node])
            out[k:k + block] = self.start + self.leaf[every, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_trees(rows: np.ndarray, label: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0,
              least: float = 0.3) -> Trees:
    """Boost on the logistic loss; every level's gradient histograms are one ``bincount`` over (node, statistic, bin)."""
    inner = 2 ** depth - 1
    if len(rows) == 0:
        return Trees(np.zeros((1, inner), np.int64), np.zeros((1, inner), np.float32), np.zeros((1, inner + 1)), 0.0)
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[j], rows[:, j], side="left") for j in range(width)])
    mean = (label.sum() + 0.5) / (n + 1)
    start = float(np.log(mean / (1 - mean)))
    score = np.full(n, start)
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    flat = binned + np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - label, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, count = 2 ** level - 1, 2 ** level
            key = ((node - base)[:, None] * (width * bins) + flat).ravel()
            shape = (count, width, bins)
            G = np.bincount(key, np.repeat(g, width), count * width * bins).reshape(shape).cumsum(2)
            H = np.bincount(key, np.repeat(h, width), count * width * bins).reshape(shape).cumsum(2)
            g_all, h_all = G[:, :, -1:], H[:, :, -1:]
            gain = G ** 2 / (H + ridge) + (g_all - G) ** 2 / (h_all - H + ridge) - g_all ** 2 / (h_all + ridge)
            gain[(H < least) | (h_all - H < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    features[t, base + k], thresholds[t, base + k] = j, cuts[j][b]
            node = 2 * node + 1 + (rows[np.arange(n), features[t, node]] > thresholds[t, node])
        place = node - inner
        leaves[t] = -rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + ridge)
        score += leaves[t][place]
    return Trees(features, thresholds, leaves, start)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label: str = "quality", id_col: str = "doc_id",
        text_col: str = "text") -> Trees:
    """Fit on the statistics of at most ``sample_rows`` labelled documents; the id list of that many rows bounds the broadcast."""
    sample = labelled_sample(labels, label, sample_rows, id_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(sample), id_col).select(F.col(id_col).cast("string").alias("id"), "text", "label")

    def measure(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values = statistics(texts_of(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(list(values), pa.list_(pa.float32()))], ["id", "label", "values"])

    found = rows.mapInArrow(measure, "id string, label int, values array<float>").orderBy("id", "label").limit(sample_rows).toArrow()
    matrix = np.array(found["values"].to_pylist(), np.float32).reshape(found.num_rows, STATISTICS)
    return fit_trees(matrix, found["label"].to_numpy().astype(np.float64))


def with_quality(docs: DataFrame, model: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text, from one pass without a shuffle."""
    if score_col in docs.columns:
        raise ValueError(f"docs has a column {score_col} already")

    def score(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                got = model.scores(statistics(texts_of(part, text_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], [*part.schema.names, score_col])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, sample_rows)
    return with_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    column = unused("quality_score", docs.columns)
    return with_quality(docs, fit(docs, labels, sample_rows), score_col=column).where(F.col(column) >= threshold).drop(column)
