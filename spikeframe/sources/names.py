"""Table function `parse_names`: any table with a column of benchmark names, plus the names' parts.

    SELECT * FROM parse_names(TABLE(readings), 'name')

The result has the table's own columns, whatever they are, and impl, dist, size, max_value; they are
NULL where a name does not parse. For DataFrames `functions.columns.parse_run_name` does the same
inside generated code; the function is for SQL users.
"""

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult

PARTS = T.StructType([T.StructField("impl", T.StringType()), T.StructField("dist", T.StringType()),
                      T.StructField("size", T.LongType()), T.StructField("max_value", T.LongType())])
_NAME = re.compile(r"([^/]*)/([^/]*)/\s*([+-]?[0-9]+)\s*/\s*([+-]?[0-9]+)\s*(?:/.*)?", re.S)


class ParseNames:
    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        if column.value not in table.dataType.fieldNames():
            raise ValueError(f"the table has no column {column.value!r}")
        taken = set(table.dataType.fieldNames()) & set(PARTS.fieldNames())
        if taken:
            raise ValueError(f"the table has columns {sorted(taken)} of its own")
        return AnalyzeResult(T.StructType([*table.dataType.fields, *PARTS.fields]))

    def eval(self, row, column):
        match = _NAME.fullmatch(row[column] or "")
        yield (*row, *((match[1], match[2], int(match[3]), int(match[4])) if match else (None,) * 4))


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("parse_names", udtf(ParseNames))
