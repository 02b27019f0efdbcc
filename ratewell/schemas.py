"""Column layouts of the tables that pass between operators and files."""

from pyspark.sql import types as T

# One row per read time of a plate; the wells are data, not columns.
PLATE_READS = T.StructType([
    T.StructField("plate_id", T.StringType()),
    T.StructField("read_idx", T.LongType()),
    T.StructField("time_text", T.StringType()),
    T.StructField("temperature_c", T.DoubleType()),
    T.StructField("wells", T.ArrayType(T.DoubleType())),
])

# One row per well of a plate template.
PLATE_MAP = T.StructType([
    T.StructField("plate_id", T.StringType()),
    T.StructField("well_idx", T.IntegerType()),
    T.StructField("well", T.StringType()),
    T.StructField("label", T.StringType()),
])

# Rate tables as exchanged between the assay step and the curve step.
RATES = T.StructType([
    T.StructField("org", T.StringType()),
    T.StructField("max_slope", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("intercept", T.DoubleType()),
])

CONDITION_RATES = T.StructType(RATES.fields + [T.StructField("condition", T.StringType())])

CHROMATOGRAM = T.StructType([
    T.StructField("time_min", T.DoubleType()),
    T.StructField("value_m_au", T.DoubleType()),
])
