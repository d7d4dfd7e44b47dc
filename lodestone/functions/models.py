"""Models as columns: a function over batches of texts, loaded once a worker and called for a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Makes a model on a worker: a function from arrays of texts, one for each input, to an array or matrix with a row for each.
Maker = Callable[[], Callable[..., np.ndarray]]


def scores(make: Maker, batch: int = 64) -> Callable[..., Column]:
    """A column of numbers from columns of texts, by Spark's batch prediction: the model is made once for a Python worker."""
    return predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch)


def vectors(make: Maker, batch: int = 64) -> Callable[..., Column]:
    """A column of vectors from columns of texts."""
    return predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)


def answers(make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 16) -> Callable[[Column], Column]:
    """A column of texts from a column of messages; a null answer stays null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.tolist()
            yield pd.Series([a for at in range(0, len(texts), batch) for a in model(texts[at : at + batch])], dtype=object)

    return run
