"""The corpus pipeline: toxicity, near-dedup, personal data, mixing and packing, in this order."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned
from panelspark.llm import hyperminhash, mixing, packing, pii, toxicity

#: Rows of whole texts that go to a Python worker at once. At Spark's default of 10,000 a batch, its
#: strings and its results add tens of MB to each worker and to the executor's buffers.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS``; a smaller setting stays. Results do not depend on it.

    It has to hold when a stage's lazy result is written, so it is not set back.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a model of the labelled documents.

    Null and empty texts are scored as texts without words; repeated rows share their score; an empty
    table stays empty. Columns pass through as they are.
    """
    in_small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs.where(toxicity.scored(model)(F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, of the smallest id; documents without words stay.

    Near copies share at least 0.8 of their five-word shingles. 29 bands of 4 registers miss a pair
    at 0.8 with probability (1 - 0.8 ** 4) ** 29, about 2e-7.

    A row is known by its id and text, so of rows that repeat both one stays, and of two texts under
    one id each is kept or dropped for itself. Rows without an id or without words all stay. An empty
    table stays empty. Columns pass through as they are, whatever their names.
    """
    in_small_batches(spark)
    return hyperminhash.without_near_copies(docs, percent=80, width=5, bands=29, rows=4)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets.

    Null and empty texts stay as they are; repeated rows are treated alike; an empty table stays empty.
    """
    in_small_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: at most 3 times, not at all where it is not needed.

    Documents without words add nothing to their source's target; a null source is one of the sources;
    repeated rows are taken alike; an empty table stays empty.
    """
    return mixing.mixed(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placements of all pieces in length buckets and batches.

    A document without words is one piece (its end mark); repeated rows are placed one by one; an
    empty table has no placements.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]
#: Not expressible in SQL: a trained classifier decides the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole documents table, each written before the next reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = pinned(stage(spark, docs, sf_dir))
    return docs
