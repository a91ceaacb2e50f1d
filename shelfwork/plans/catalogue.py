"""Preparation of a catalogue: balance, text assembly, cleaning, long texts, enrichment.

Which rows are drawn is decided first, on keys and labels alone. The costly stages
then run once over the drawn rows: each is a function DataFrame -> DataFrame,
chosen by settings and applied in order with ``DataFrame.transform``. Enrichment
calls a user's function, which may cost money or answer differently the next
time: its texts and replies are written to a store before anything reads them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import task_text
from ..functions import text as T
from ..operators import balance as B
from ..operators import columns as C
from ..operators import enrich as L
from ..operators import outliers as O

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    """What to run and with which values."""

    separator: str = "; "
    on_equal: str = "title"
    cleaning: tuple[Callable[[Column], Column], ...] = (task_text.html_to_text, task_text.fix_encoding)
    shorten: bool = True
    word_threshold: int = 200
    similarity: float = 0.8
    summary_sentences: int = 3
    enrichment: Callable | None = None
    store: str | None = None
    model: str = "model"
    chunk_rows: int = 250
    balance: str = "none"
    seed: int = 42
    paths: dict[str, str] = field(default_factory=dict)


def stages(key: str, label: str, title: str, description: str, settings: Settings) -> list[Stage]:
    """The chosen stages that work on the text, in order."""
    s = settings
    merged = T.merge_title_description(title, description, s.separator, on_equal=s.on_equal)
    chosen: list[Stage] = [lambda df: df.withColumn("text", merged)]
    if s.paths:
        chosen.append(lambda df: C.with_paths(df, s.paths, label=label))
    for clean in s.cleaning:
        chosen.append(lambda df, clean=clean: C.on_columns(df, ["text"], clean))
    if s.shorten:
        chosen.append(
            lambda df: O.transform_long_texts(df, key, "text", s.word_threshold, s.similarity, s.summary_sentences)
        )
    return chosen


def prepare(rows: DataFrame, key: str, label: str, title: str, description: str, settings: Settings | None = None) -> DataFrame:
    """The prepared catalogue. With an enrichment ``settings.store`` names the folder of its texts and replies.

    A second run with the same store asks only for what has no good reply yet.
    """
    s = settings or Settings()
    if s.enrichment is not None and s.store is None:
        raise ValueError("an enrichment needs a store for its replies")
    drawn = B.balance(rows.select(key, label), s.balance, label, key, s.seed)
    out = rows if s.balance == "none" else rows.join(drawn.select(key).distinct(), key, "left_semi")
    for stage in stages(key, label, title, description, s):
        out = out.transform(stage)
    if s.enrichment is not None:
        out.write.mode("overwrite").parquet(f"{s.store}/texts")
        out = rows.sparkSession.read.parquet(f"{s.store}/texts")
        replies = L.enrich_resumable(out, key, "text", s.enrichment, f"{s.store}/replies", s.chunk_rows)
        out = out.join(replies.select(key, F.col("reply").alias(C.output_column("text", s.model))), key, "left")
    return out.join(drawn.select(key, "copy"), key) if "copy" in drawn.columns else out
