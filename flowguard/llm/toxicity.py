"""Toxicity of whole texts by a recurrent network, learnt from labelled rows.

Only the text is an input. The network is trained on a bounded sample of
labelled rows outside the held-out third; scoring reads every window of every
text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gru import Network, Scorer, train
from .texts import SPACE, whole

#: Rows trained on, at most, of either label. Their texts are whole.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2_000, 3_000
#: The score that a text at the network's own threshold gets.
THRESHOLD = 0.7
#: Texts whose words are numbered together.
TEXTS = 512

_SPACES = re.compile(SPACE)


def words(text: str) -> list[str]:
    return [w for w in _SPACES.split(text.lower()) if w]


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 1 by 3. NULL ids aren't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_toxic: int = SAMPLE_TOXIC,
    sample_clean: int = SAMPLE_CLEAN,
    seed: int = 42,
    epochs: int = 8,
) -> Network:
    """A network from the labelled rows with the smallest hash of the id, at most so many of either label.

    The rows' whole texts are read, very long ones too: they are what the driver holds.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).alias("id"), (F.col(label) == 1).alias("toxic"))
    order = [F.xxhash64("id", F.lit(seed)), F.col("id")]
    chosen = [known.where(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in ((True, sample_toxic), (False, sample_clean))]
    # Bounded by the sample's size, so that broadcasting it is safe at any size of the input.
    texts = docs.select(F.col(id_col).alias("id"), whole(text).alias("text"))
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").limit(sample_toxic + sample_clean).toArrow()
    found = sorted(zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True))
    return train((words(t) for t, _ in found), [k for _, k in found], seed=seed, epochs=epochs)


def scores(logits: np.ndarray, shift: float) -> np.ndarray:
    """Probabilities that give THRESHOLD at the logit ``shift``; 0 for texts without words (-inf)."""
    at = np.where(np.isfinite(logits), logits.astype(np.float64) - shift, -np.inf)
    return 1 / (1 + np.exp(-np.clip(at + np.log(THRESHOLD / (1 - THRESHOLD)), -700, 700))) * np.isfinite(at)


def score(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1) and predicted (1 from a score of THRESHOLD).

    The score is that of the strongest of all overlapping windows of the whole
    text. NULL and empty texts have the score 0. Without a toxic row to learn
    from all scores are 0. NULL ids count as not held out; NULL and repeated
    ids are passed on; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    # A model of fixed size, sent once to each executor.
    model = spark.sparkContext.broadcast(net)
    narrow = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text).alias("text"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                logits = scorer.logits([words(t.as_py() or "") for t in part.column("text")])
                values = scores(logits, model.value.shift)
                columns = [part.column("id"), part.column("held_out"), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "score", "predicted"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(each, f"id {id_type}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
