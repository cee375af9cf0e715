"""Training export: chat format, loss mask, truncation, removal of benchmark items."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.functions.text import fit_size, join_path
from figloom.operators.sampling import repeat

MAX_TOKENS = 2048
IGNORED = -100


def chat_prompt(instruction: Column, text: Column) -> Column:
    """System and user turn and the opening of the answer, in the chat template of the model."""
    return F.concat(
        F.lit("<|im_start|>system\n"), F.coalesce(instruction, F.lit("")), F.lit("<|im_end|>\n<|im_start|>user\n"), F.coalesce(text, F.lit("")),
        F.lit("<|im_end|>\n<|im_start|>assistant\n"),
    )


def word_ids(text: Column) -> Column:
    """Stand-in tokenizer: the length of each word between blanks; it lets Catalyst and SQL count alike."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.length(w))


def tokenizer(encode: Callable[[], Callable[[str], list[int]]]) -> Callable[[Column], Column]:
    """Column function of a real tokenizer; ``encode`` makes it, once per Python worker and batch stream."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        f = encode()
        return texts.map(lambda t: f(t or ""))

    return run


def masked(rows: DataFrame, prompt_ids: str, answer_ids: str, pad: int = 0, most: int = MAX_TOKENS) -> DataFrame:
    """input_ids, attention_mask and labels: prompt, answer and closing pad, no loss on the prompt, all cut at ``most``."""
    end = F.array(F.lit(pad).cast("int"))
    p, a = F.col(prompt_ids), F.col(answer_ids)
    ids = F.concat(p, a, end)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size(p)), a, end)
    return rows.withColumns({
        "input_ids": F.slice(ids, 1, most), "attention_mask": F.slice(F.array_repeat(F.lit(1), F.size(ids)), 1, most), "labels": F.slice(labels, 1, most),
    })


def generated_suffix(output_ids: Column, prompt_ids: Column) -> Column:
    """Ids after the prompt."""
    return F.slice(output_ids, F.size(prompt_ids) + 1, F.greatest(F.size(output_ids) - F.size(prompt_ids), F.lit(0)))


def without_benchmark(rows: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the benchmark; null keys stay."""
    return rows.join(benchmark.select(key).distinct(), key, "left_anti")


def image_list(image: Column) -> Column:
    """One path or a JSON list of paths as an array."""
    return F.when(image.startswith("["), F.from_json(image, "array<string>")).otherwise(F.array(image))


def export(rows: DataFrame, base: str, file_key: str, width: str, height: str, times: int = 1, max_pixels: int = 1_048_576) -> DataFrame:
    """The unified training dataset: ``file_key`` under the base path, ``width`` and ``height`` fitted to ``max_pixels`` and
    divisible by 16, every row ``times`` times with its number in ``repeat``."""
    size = fit_size(F.col(width), F.col(height), max_pixels)
    sized = rows.withColumns({file_key: join_path(base, F.col(file_key)), "_size": size}).drop(*{width, height} - {"width", "height"})
    return repeat(sized.withColumns({"width": F.col("_size.width"), "height": F.col("_size.height")}).drop("_size"), times)
