"""A training corpus from raw documents: reject, dedup lines, dedup documents, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and rereads it
for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import linededup, mixing, neardup, packing, quality
from engram.llm.common import columns_of, discard, masked, materialize, read

THRESHOLD = 0.3


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``THRESHOLD``, by a classifier fitted on ``labels``.

    Null and empty texts are scored as empty; null and repeated ids stay; no rows give no rows.
    """
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.accepted(docs, model, THRESHOLD)


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; all rows stay, emptied ones too. ``n_chars`` follows the text, null with it.

    A null id comes first; rows of one id are ordered by their text; equal rows are cut alike; no rows give no rows.
    """
    rows = masked(docs, "doc_id", "text", "n_chars")
    out = linededup.dedup_lines(rows)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns_of(rows.columns)).toDF(*docs.columns)


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates (5-word shingles, similarity 0.8, all links verified).

    Rows without an id, or of one id, stay if their texts differ; texts without words are one group; no rows give no rows.
    """
    return neardup.one_of_each(docs)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are never taken; a null source is one of its own; ids may be null or repeat, and repeated rows are taken
    each on its own; no rows give no rows.
    """
    # Rows are numbered once, in a table, so repeated rows are rows of their own in the mix and in the join.
    held = materialize(masked(docs, "doc_id", "text", "source").withColumn("mix_row", F.monotonically_increasing_id()), "mix-rows")
    taken = mixing.mix(held.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text", "source", "mix_row"), carry=("mix_row",)).where("repeats > 0")
    taken = taken.select("mix_row", F.col("repeats").cast("int").alias("mix_repeats"))
    out = held.join(taken, "mix_row").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_repeats"))))
    return out.drop("mix_row", "mix_repeats", "mix_copy").toDF(*docs.columns)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. Null and empty texts are the separator alone; other columns are ignored; no rows give no pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
