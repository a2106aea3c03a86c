"""V1 with a model: the verdict of a scorer on the values that no rule names.

``promoter(model)`` is a hook for ``promote_unknown``. The model is any picklable callable from a
batch of fields and values (numpy arrays of bytes) to verdicts; it is broadcast, so a worker
fetches it once and a task unpickles it once, however many batches it scores. It only gets the
``unknown`` rows of the Arrow batches of an iterator pandas UDF; nothing is read twice for it. Fields and values go there as bytes: they need not be UTF-8.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.functions import constants as K


@dataclass
class LinearScorer:
    """Whole-number weights of byte counts: a value of at least ``threshold`` points is a secret."""
    weights: dict[str, int] = field(default_factory=lambda: {"length": 2, "digits": 3, "lower": -1, "upper": 2, "spaces": -10})
    threshold: int = 60

    def points(self, values: np.ndarray) -> np.ndarray:
        sizes = np.array([len(v) for v in values], np.int64)
        data = np.frombuffer(b"".join(values), np.uint8)
        own = np.repeat(np.arange(len(values)), sizes)
        kinds = {"length": np.ones(len(data), bool), "digits": (data >= 48) & (data <= 57), "lower": (data >= 97) & (data <= 122),
                 "upper": (data >= 65) & (data <= 90), "spaces": data == 32}
        return sum(w * np.bincount(own[kinds[k]], minlength=len(values)) for k, w in self.weights.items())

    def __call__(self, fields: np.ndarray, values: np.ndarray) -> list[str]:
        return [K.CLASS_SECRET if p >= self.threshold else K.CLASS_UNKNOWN for p in self.points(values)]


def promoter(model: Callable[[np.ndarray, np.ndarray], list[str]]) -> Callable[[DataFrame], DataFrame]:
    def hook(fps: DataFrame) -> DataFrame:
        held = fps.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

        @F.pandas_udf("string")
        def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            score = cloudpickle.loads(held.value)
            for fields, values in batches:
                asked = values.notna().to_numpy()
                said = np.full(len(values), None, object)
                if asked.any():
                    said[asked] = score(fields.to_numpy()[asked], values.to_numpy()[asked])
                yield pd.Series(said, dtype=object)

        unknown = F.col("classification") == K.CLASS_UNKNOWN
        said = verdict(F.when(unknown, F.col("field").cast("binary")), F.when(unknown, F.col("value_bin")))
        return fps.withColumn("classification", F.when(unknown, said).otherwise(F.col("classification")))
    hook.in_place = True
    return hook


# Ship this module's code with the UDF, so workers need no import path to it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
