"""Table functions in Python whose columns depend on the table that they are called with."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from fitspark.cluster import ship


class Spans:
    """fit_spans(TABLE(t), split_by => 'a', order_by => 'b', header => 'c'): the spans that headers begin.

    In each group of `split_by` and in the order of `order_by`, a row whose `header` is
    not null begins a span, which goes on to the row before the next one. Returns the
    group, the header (null for rows before the first), the first and the last value of the order, and
    the number of rows; names and types come from the table. A group's rows are read
    one by one and none is kept, so a group may be of any size. Null keys form a group.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, split_by: AnalyzeArgument, order_by: AnalyzeArgument, header: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(rows.dataType, StructType):
            raise ValueError("the first argument must be a table")
        fields = {f.name: f for f in rows.dataType.fields}
        for what, argument in (("split_by", split_by), ("order_by", order_by), ("header", header)):
            if not argument.isConstantExpression or argument.value not in fields:
                raise ValueError(f"{what} must name a column: {', '.join(fields)}")
        at = fields[order_by.value].dataType
        columns = [fields[split_by.value], fields[header.value], StructField("first", at), StructField("last", at), StructField("n_rows", LongType())]
        return AnalyzeResult(StructType(columns), partitionBy=[PartitioningColumn(split_by.value)], orderBy=[OrderingColumn(order_by.value)])

    def __init__(self) -> None:
        self.span: list[Any] | None = None

    def eval(self, rows: Row, split_by: str, order_by: str, header: str):
        if self.span is not None and rows[header] is None:
            self.span[3] = rows[order_by]
            self.span[4] += 1
            return
        if self.span is not None:
            yield tuple(self.span)
        self.span = [rows[split_by], rows[header], rows[order_by], rows[order_by], 1]

    def terminate(self):
        if self.span is not None:
            yield tuple(self.span)


def register_tables(spark: SparkSession) -> list[str]:
    """Register the table functions in the session; returns their names."""
    ship(spark)
    spark.udtf.register("fit_spans", udtf(Spans))
    return ["fit_spans"]
