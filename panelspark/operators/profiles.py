"""Source scans, inventory, header check and column profiles."""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from panelspark.functions.bits import WORD, bit_in_block, block_ends, block_members, block_of
from panelspark.functions.columns import ratio
from panelspark.functions.ordering import pinned
from panelspark.operators.quality import stacked
from panelspark.plans.registry import table
from panelspark.sources import files
from panelspark.sources.contracts import CONTRACTS


def source_files(w, kind):
    """Folder holding the sources as files of one kind, written once per warehouse."""
    written = w.__dict__.setdefault("_files", {})
    if kind not in written:
        folder = files.work_folder(w.spark, f"sources-{kind}")
        if kind == "csv":
            for source in CONTRACTS:
                files.write_csv(w.raw(source), f"{folder}/{source}.csv")
            written[kind] = folder, None
        else:
            log = files.curate(w.spark, w.raw, folder, "manual")
            written[kind] = folder, log
    return written[kind]


def _scan_summary(read):
    """Rows, columns and missing cells of each source, one scan each."""
    frames = []
    for source in CONTRACTS:
        df = read(source)
        empty = sum(
            (F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), start=F.lit(0)
        )
        frames.append(
            df.agg(
                F.lit(source).alias("source_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.lit(len(df.columns)).cast("bigint").alias("column_count"),
                F.coalesce(F.sum(empty), F.lit(0)).alias("null_cells"),
            )
        )
    return stacked(frames)


@table("source")
def read_source(w):
    folder, _ = source_files(w, "csv")
    return _scan_summary(files.csv_sources(w.spark, folder))


@table("source")
def read_parquet(w):
    folder, _ = source_files(w, "parquet")
    return _scan_summary(files.parquet_sources(w.spark, folder))


@table("source")
def curate_parquet(w):
    return source_files(w, "parquet")[1]


@table("source")
def write_table(w):
    """A mart written as CSV with a header and read back by its schema."""
    df = w["mart_category_weekly"]
    path = f"{files.work_folder(w.spark, 'table')}/mart_category_weekly"
    files.write_csv(df, path)
    return w.spark.read.schema(df.schema).option("header", True).csv(path)


def header_of(spark, folder, source):
    """Column names on the first line of a CSV source, or None when the file is absent."""
    try:
        first = spark.read.text(f"{folder}/{source}.csv").limit(1)
    except AnalysisException:
        return None
    return first.select(F.split("value", ",").alias("names"))


def contract_check(spark, folder):
    """Missing, unexpected and repeated columns per source; repeats rank first."""
    frames = []
    for source, contract in CONTRACTS.items():
        head = header_of(spark, folder, source)
        named = [F.lit(source).alias("source_name"), F.lit(f"{source}.csv").alias("file_name")]
        if head is None:
            blank = F.lit("")
            frames.append(
                spark.range(1).select(
                    *named,
                    F.lit("missing_file").alias("status"),
                    blank.alias("missing_columns"),
                    blank.alias("unexpected_columns"),
                    blank.alias("duplicate_columns"),
                    F.lit(None).cast("bigint").alias("observed_column_count"),
                )
            )
            continue
        wanted = F.array(*map(F.lit, contract.columns))
        seen = F.col("names")
        repeated = F.filter(
            F.array_distinct(seen), lambda x: F.size(F.filter(seen, lambda y: y == x)) > 1
        )
        lists = {
            "missing_columns": F.array_except(wanted, seen),
            "unexpected_columns": F.array_except(seen, wanted),
            "duplicate_columns": repeated,
        }
        status = (
            F.when(F.size("duplicate_columns") > 0, "duplicate_columns")
            .when(F.size("missing_columns") > 0, "missing_columns")
            .when(F.size("unexpected_columns") > 0, "unexpected_columns")
            .otherwise("ok")
        )
        found = head.select(
            *[F.array_sort(c).alias(n) for n, c in lists.items()],
            F.size("names").cast("bigint").alias("observed_column_count"),
        )
        frames.append(
            found.select(
                *named,
                status.alias("status"),
                *[F.concat_ws("|", n).alias(n) for n in lists],
                "observed_column_count",
            )
        )
    return stacked(frames)


@table("source")
def schema_contract_check(w):
    return contract_check(w.spark, source_files(w, "csv")[0])


def inventory(spark, folder):
    """Row and column counts, header hash and distance to the expected rows per source file."""
    frames = []
    for source, contract in CONTRACTS.items():
        expected = F.lit(contract.expected_rows).cast("bigint")
        named = [F.lit(source).alias("source_name"), F.lit(f"{source}.csv").alias("file_name")]
        try:
            rows = spark.read.option("header", True).csv(f"{folder}/{source}.csv")
        except AnalysisException:
            none = F.lit(None).cast("bigint")
            frames.append(
                spark.range(1).select(
                    *named,
                    none.alias("row_count"),
                    expected.alias("expected_row_count"),
                    none.alias("row_count_delta"),
                    F.lit("missing").alias("planning_expectation_status"),
                    none.alias("column_count"),
                    F.lit(None).cast("string").alias("column_names_hash"),
                    F.lit("missing").alias("load_status"),
                )
            )
            continue
        n = F.count(F.lit(1))
        frames.append(
            rows.agg(
                *named,
                n.alias("row_count"),
                expected.alias("expected_row_count"),
                (n - expected).alias("row_count_delta"),
                F.when(n == expected, "match")
                .otherwise("review")
                .alias("planning_expectation_status"),
                F.lit(len(rows.columns)).cast("bigint").alias("column_count"),
                F.sha2(F.lit("|".join(rows.columns)), 256).alias("column_names_hash"),
                F.lit("ok").alias("load_status"),
            )
        )
    return stacked(frames)


@table("source")
def source_inventory(w):
    return inventory(w.spark, source_files(w, "csv")[0])


@table("source")
def source_profile_summary(w):
    return stacked(
        [
            w.raw(source).agg(
                F.lit(source).alias("source_name"),
                F.lit(f"{source}.csv").alias("source_filename"),
                F.count(F.lit(1)).alias("row_count"),
                F.lit(len(contract.columns)).cast("bigint").alias("column_count"),
            )
            for source, contract in CONTRACTS.items()
        ]
    )


def _scale(kind):
    """Decimal places of a column type whose values are whole numbers of 64 bits once scaled, else None.

    Beyond 6 places small decimals are shown with an exponent, so that texts do not sort as digits do.
    """
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return 0
    parts = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
    return int(parts[2]) if parts and int(parts[1]) <= 18 and int(parts[2]) <= 6 else None


def cell_counts(df):
    """Every distinct cell of a frame, by column number (``place``), with how often it occurs (``n``).

    Whole numbers and decimals are held as blocks of 64 numbers: ``block`` is a block's first number and
    ``bits`` tells which of it occur. A task so sends one row for up to 64 near values. Other cells
    are held as texts (``value``); nulls have neither.
    """
    cells = []
    for place, (name, kind) in enumerate(df.dtypes):
        scale, cell = _scale(kind), F.col(f"`{name}`")
        number = F.lit(None) if scale is None else cell * F.lit(10**scale) if scale else cell
        number = number.cast("bigint")
        cells.append(
            F.struct(
                F.lit(place).alias("place"),
                block_of(number).alias("block"),
                bit_in_block(number).alias("bit"),
                (cell if scale is None else F.lit(None)).cast("string").alias("value"),
            )
        )
    return (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .groupBy("c.place", "c.block", "c.value")
        .agg(F.bit_or("c.bit").alias("bits"), F.count(F.lit(1)).alias("n"))
    )


@table("internal")
def column_profile(w):
    """Per column: rows, blanks, distinct values and text range, by one exchange per source."""
    frames = []
    for source in CONTRACTS:
        df = w.raw(source)
        names, kinds = (F.array(*map(F.lit, parts)) for parts in zip(*df.dtypes))
        frames.append(
            _column_summary(cell_counts(df), df).select(
                F.lit(source).alias("source_name"),
                F.get(names, F.col("place")).alias("column_name"),
                F.get(kinds, F.col("place")).alias("column_type"),
                "row_count",
                "null_or_blank_count",
                "distinct_count",
                "min_value",
                "max_value",
            )
        )
    return pinned(stacked(frames))


#: Standard error of a sketch of 2**k registers, as a share of the distinct count.
def sketch_error(k):
    return 1.04 / 2 ** (k / 2)


def column_sketches(df, k=14, by=()):
    """Mergeable per-column summaries: one row per column (and ``by`` group) with counts, text range and a
    distinct-count sketch of fixed size.

    Nothing is shuffled by value: a task sends one row per column. Summaries of parts of a table
    (days, files) may be kept and merged by :func:`sketched_profile`.
    """
    columns = [c for c in df.columns if c not in by]

    def text(c):
        return F.col(c).cast("string")

    summary = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(dict(df.dtypes)[c]).alias("column_type"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(text(c).isNull() | (F.trim(text(c)) == "")).alias("null_or_blank_count"),
                # a mark before every value, since sketches leave out the empty text
                F.hll_sketch_agg(F.concat(F.lit("="), text(c)), F.lit(k)).alias("sketch"),
                F.min(text(c)).alias("min_value"),
                F.max(text(c)).alias("max_value"),
            )
            for c in columns
        ]
    )
    return df.groupBy(*by).agg(summary.alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*")


def sketched_profile(sketches):
    """The profile of :func:`column_profile` from summaries, distinct counts within :func:`sketch_error`."""
    return sketches.groupBy("column_name", "column_type").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_or_blank_count").alias("null_or_blank_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
    )


def approximate_profile(w, k=14):
    """The source profile with sketched distinct counts: the option for sources whose distinct values
    are too many to shuffle. The exact form, ``column_profile``, stays the default."""
    frames = [
        sketched_profile(column_sketches(w.raw(source), k)).select(F.lit(source).alias("source_name"), "*")
        for source in CONTRACTS
    ]
    return stacked(frames)


def _column_summary(counted, df):
    """One row per column of ``df`` from its :func:`cell_counts`."""
    value, block, bits = F.col("value"), F.col("block"), F.col("bits")
    places = {}  # by type of decimal
    for place, (_, kind) in enumerate(df.dtypes):
        if _scale(kind):
            places.setdefault(kind, []).append(place)

    def text(number):
        shown = number.cast("string")
        for kind, of in places.items():
            scale = _scale(kind)
            unit = F.lit(f"1e-{scale}").cast(f"decimal({scale + 1},{scale})")
            scaled = (number.cast("decimal(19,0)") * unit).cast(kind).cast("string")
            shown = F.when(F.col("place").isin(of), scaled).otherwise(shown)
        return shown

    # Numbers of one sign and of equally many digits sort as their texts do, or the other way round.
    alike = F.length(block.cast("string")) == F.length((block + (WORD - 1)).cast("string"))
    numbers = F.when(alike, F.array(*block_ends(block, bits))).otherwise(block_members(block, bits))
    texts = F.when(block.isNull(), F.array(value)).otherwise(F.transform(numbers, text))
    empty = block.isNull() & (value.isNull() | (F.trim(value) == ""))
    return (
        counted.select("*", texts.alias("texts"))
        .groupBy("place")
        .agg(
            F.sum("n").alias("row_count"),
            F.sum(F.when(empty, F.col("n")).otherwise(0)).alias("null_or_blank_count"),
            F.sum(F.when(block.isNull(), value.isNotNull().cast("int")).otherwise(F.bit_count(bits)))
            .alias("distinct_count"),
            F.min(F.array_min("texts")).alias("min_value"),
            F.max(F.array_max("texts")).alias("max_value"),
        )
    )


@table("source")
def source_null_profile(w):
    return w["column_profile"].select(
        "source_name",
        "column_name",
        "column_type",
        "row_count",
        "null_or_blank_count",
        ratio("null_or_blank_count", "row_count").alias("null_or_blank_pct"),
        "distinct_count",
        "min_value",
        "max_value",
    )


@table("source")
def source_cardinality(w):
    return w["column_profile"].select(
        "source_name",
        F.concat("source_name", F.lit(".csv")).alias("source_filename"),
        "column_name",
        "row_count",
        "distinct_count",
        ratio("distinct_count", "row_count").alias("cardinality_ratio"),
    )
