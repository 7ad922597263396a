"""The hook for a text model: prompts in, texts and token counts out. The model's client is the caller's."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ADDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()), T.StructField("error", T.StringType())])


def passing(e: Exception) -> bool:
    """Errors that a later try may not meet: of connections, time limits and the like."""
    return isinstance(e, OSError)


def completed(
    prompts: DataFrame, client: Callable[[], Callable[[str], tuple[str, int, int]]], prompt: str = "prompt",
    in_flight: int = 6, retries: int = 2, pause: float = 0.5, again: Callable[[Exception], bool] = passing,
) -> DataFrame:
    """Adds text, input_tokens, output_tokens and error. ``client`` is called once per partition and gives the function that
    answers one prompt. Up to ``in_flight`` prompts of a partition are asked at a time, from threads; rows keep their order.
    An error of which ``again`` holds is tried ``retries`` times more, after ``pause`` seconds and twice as long each time. A
    prompt that fails, or a null one, has an error and no text, and the others go on."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()

        def one(p: str | None) -> tuple:
            if p is None:
                return None, None, None, "no prompt"
            for k in itertools.count():
                try:
                    return *ask(p), None
                except Exception as e:  # a model's client may raise anything
                    if k >= retries or not again(e):
                        return None, None, None, f"{type(e).__name__}: {e}"
                    time.sleep(pause * 2**k)

        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in it:
                found = pd.DataFrame(list(pool.map(one, pdf[prompt])), columns=ADDED.names, index=pdf.index)
                yield pdf.assign(**{c: found[c].astype("object" if c in ("text", "error") else "Int64") for c in ADDED.names})

    return prompts.mapInPandas(rows, T.StructType([*(f for f in prompts.schema if f.name not in ADDED.names), *ADDED]))
