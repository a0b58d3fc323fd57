"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark
decontamination, mixing sources to target weights.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns the columns of ``documents``; the last adds what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import decontaminate, language_id, simhash
from tilespark.llm.common import BROADCAST_ROWS, PLACE, crc_mod, few, placed, stored
from tilespark.llm.exact_dedup import exact_dedup
from tilespark.llm.queries import table
from tilespark.llm.source_mix import mix_sources


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null texts too).  How sure the language is does not matter: a short
    text may fit several.  Ids do not matter, all rows are judged alone."""
    model = language_id.train(docs, crc_mod("doc_id", 4) != 2)
    if not model.languages:  # no labelled row, so every document would be unknown
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = placed(docs)
    told = language_id.identify(rows.select(*PLACE, "text"), model, pred_col="lang_pred", score_col="score", keep=PLACE)
    gone = few(told.where(F.col("lang_pred") == language_id.UNKNOWN).select(*PLACE), "no-language")
    return rows.join(gone, PLACE, "left_anti").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: that with the largest id."""
    return exact_dedup(docs, keep="max", carry=True).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that with the smallest id (null last), among rows
    that share an id the first by its place in the stored table.

    Only fingerprints and places are grouped; the rows that go, few or many, are then left out of the table."""
    rows = placed(docs)
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), *PLACE)
    groups = simhash.near_groups(rows.select(key.alias("__key"), "text"), shingle=3, max_bits=2, id_col="__key")
    gone = few(groups.where(F.col("__key") != F.col("component_id")).select("__key.__file", "__key.__row"), "near-copies")
    return rows.join(gone, PLACE, "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of nothing else goes.  A null text has none.  ``n_chars`` of a
    document that was cut is that of its new text.  Every row is judged alone, whatever its id."""
    rows = placed(docs)
    found = decontaminate.find_hits(rows.select(*PLACE, "text"), table(spark, sf_dir, "benchmark"), keep=PLACE)
    hit = stored(found.where(F.size("spans") > 0).select(*PLACE, F.col("n_words").alias("__n_words"), F.col("spans").alias("__spans")), "hit-rows")
    size = hit.agg(F.coalesce(F.sum(F.size("__spans") + 4), F.lit(0))).first()[0]  # numbers to send, by twos
    hit = F.broadcast(hit) if size <= BROADCAST_ROWS else hit
    free = rows.join(hit.select(*PLACE), PLACE, "left_anti").select(docs.columns)
    # names that find_hits uses are put aside in the few rows that are cut
    aside = {c: f"__own_{c}" for c in ("n_words", "spans", "items")}
    cut = decontaminate.without_hits(rows.join(hit, PLACE).drop(*PLACE).withColumnsRenamed(aside)
                                     .withColumnsRenamed({"__n_words": "n_words", "__spans": "spans"}))
    chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    cut = cut.withColumn("n_chars", chars).drop("n_words", "spans").withColumnsRenamed({v: k for k, v in aside.items()})
    return free.unionByName(cut.select(docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).
    A null source is a source of its own; rows that share an id, or have none, are taken one by one."""
    return mix_sources(docs, carry=docs.columns).where("taken > 0")


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near),
          ("benchmark decontamination", decontaminated), ("mixing sources", mixed)]

#: Language ID, SimHash and their effects on what follows have no SQL form; tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``, each one's result stored in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
