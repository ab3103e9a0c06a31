"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The statistics are computed where the texts are; only those of at most LABELLED labelled rows come to the driver, which
grows the trees. Scoring is one pass over all documents without a shuffle.

Edge cases. Null and empty texts have statistics of zero and are scored like any text. Texts of any length count whole.
Repeated rows are scored each. Without labels the score is 0.5. Extra columns pass through in `scored`, one
named like the score gives way to it; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, giving_way, in_small_batches, slices
from .gbdt import Trees, train
from .labelled import LABELLED, held_out, training

_CLASSES = [*map(bytes, ([32, 9], [10, 13], range(48, 58), range(65, 91), range(97, 123), b".,;:?", b"!", b"|", b"#", b"$", b"%", b"&", b"*", b"'\"()-", b"<>{}[]\\/=+_^~`@", range(194, 245), [*range(0, 9), 11, 12, *range(14, 32), 127]))]
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _MEMBER[list(_c), _k] = 1
N_FEATURES = len(_CLASSES) + 19


def statistics(text: bytes) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    n = len(text)
    k = len(_CLASSES)
    out[:k] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MEMBER / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = len(words)
    if not m:
        out[k] = np.log1p(n)
        return out
    sizes = np.fromiter(map(len, words), np.int64, m)
    counts = Counter(words)
    of_lines = Counter(lines)
    upper = sum(map(bytes.isupper, words))
    titled = sum(map(bytes.istitle, words))
    same = sum(map(bytes.__eq__, words, words[1:])) if m > 1 else 0
    top = sum(c for _, c in counts.most_common(3))
    packed = len(zlib.compress(text, 1))
    per_line = np.fromiter(map(len, lines), np.int64, len(lines))
    out[k:] = [np.log1p(n), np.log1p(m), sizes.mean(), sizes.std(), sizes.max(), (sizes == 1).mean(), (sizes > 15).mean(), len(counts) / m, len(counts) / np.sqrt(m), top / m, upper / m, titled / m, same / m, packed / n, np.log1p(len(lines)), 1 - len(of_lines) / len(lines), max(of_lines.values()) / len(lines), per_line.mean(), per_line.std()]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", limit: int = LABELLED) -> Trees:
    """Trees that tell label 1 from label 0, learned from at most `limit` labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [statistics(x).tobytes() for x in as_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(rows, pa.binary()), batch.column("y")], names=["id", "x", "y"])

    rows = in_small_batches(training(docs, labels, label, key, text, limit)).mapInArrow(run, "id long, x binary, y int").collect()
    rows = sorted(rows, key=lambda r: (r["id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(-1, N_FEATURES)
    return train(x, np.array([r["y"] for r in rows], float))


def scored(df: DataFrame, model: Trees, text: str = "text", score: str = "score", keep_text: bool = True) -> DataFrame:
    """Adds the column `score`."""
    df = giving_way(df, [score], text)
    kept = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                x = np.array([statistics(t) for t in as_bytes(batch.column(text))]).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(x), pa.float64())], names=schema.names)

    return in_small_batches(df).mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels), keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
