"""Array functions that Spark has no type or expression for: Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_tokenizers: dict[str, object] = {}


def half(vec: Column) -> Column:
    """Each element rounded to half precision, kept as float: what storage in float16 leaves of it."""

    @F.pandas_udf("array<float>")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))

    return rounded(vec)


#: Bits of the mantissa that a float of each precision keeps.
MANTISSA = {"fp16": 10, "bf16": 7}


def lowered(x: Column, precision: str) -> Column:
    """A number rounded as a precision would: fp16 and bf16 to so many bits of mantissa, int8 to 1/127 steps of [-1, 1].

    Expressions only; for exact half precision of whole vectors there is half()."""
    if precision == "int8":
        return F.greatest(F.least(F.rint(x * 127), F.lit(127.0)), F.lit(-127.0)) / 127
    if precision not in MANTISSA:
        raise ValueError(f"unknown precision {precision}")
    size = F.when(x == 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - MANTISSA[precision]))
    return F.rint(x / size) * size


def tokenizer_offsets(path: str) -> Callable[[Column], Column]:
    """A tokenizer file's token offsets in code points: stands in for the pieces between spaces."""

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def offsets(s: pd.Series) -> pd.Series:
        if path not in _tokenizers:
            from tokenizers import Tokenizer

            _tokenizers[path] = Tokenizer.from_file(path)
        return s.map(lambda t: None if t is None else [{"s": a, "e": b} for a, b in _tokenizers[path].encode(t, add_special_tokens=False).offsets])

    return offsets
