"""Sinks: typed CSV, JSON and XML tables, and structure files of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_lines(df: DataFrame) -> tuple[DataFrame, str]:
    """A text line for each row, and the header: names and texts quoted with doubled quotes inside, numbers bare.

    A null is an empty field, an empty text is "". A text may hold line feeds inside its quotes.
    """
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    shown = [F.coalesce(quote(F.col(f"`{f.name}`")) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`").cast("string"), F.lit("")) for f in df.schema]
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    return df.select(F.array_join(F.array(*shown), ",").alias("value")), header


def write_csv(df: DataFrame, path: str) -> None:
    """csv_lines() as files that have the header on top each, also where there are no rows."""
    lines, header = csv_lines(df)
    if lines.isEmpty():
        lines = df.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value"))
    else:
        # the number of a row in its partition is in the lower 33 bits
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        lines = lines.select(F.when(first, F.concat(F.lit(header + "\n"), F.col("value"))).otherwise(F.col("value")).alias("value"))
    lines.write.option("lineSep", "\n").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "Entry", root_tag: str = "Entries") -> None:
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def atom_line(charge: Column | None = None) -> Column:
    """An ATOM or HETATM line of fixed width from an atom's columns; with a charge column at its end if given."""
    name = F.when(F.length("name") < 4, F.concat(F.lit(" "), F.rpad("name", 3, " "))).otherwise(F.substring("name", 1, 4))
    line = F.format_string("%-6s%5d %4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.col("record_name"), F.col("atom_id"), name, F.col("res_name"), F.col("chain"), F.col("res_seq"), F.rpad(F.col("ins_code"), 1, " "), F.col("x"), F.col("y"), F.col("z"), F.coalesce(F.col("occupancy"), F.lit(1.0)), F.coalesce(F.col("temperature_factor"), F.lit(0.0)), F.col("element"))
    return line if charge is None else F.concat(line, F.format_string(" %8.4f", F.coalesce(charge, F.lit(0.0))))


def pattern_texts(long: DataFrame, by: list[str], charge: Column | None = None) -> DataFrame:
    """by and one text for each pattern of rows (by, atom columns), atoms in id order."""
    lines = long.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("atom_id", atom_line(charge).alias("line")))).alias("_l"))
    return lines.select(*by, F.concat(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\nEND")).alias("value"))


def write_patterns(long: DataFrame, path: str, statistics_only: bool = False) -> None:
    """A text for each pattern (query_id, pattern_id) under its query; none if only statistics are wanted."""
    if not statistics_only:
        pattern_texts(long, ["query_id", "pattern_id"]).select("query_id", "value").write.partitionBy("query_id").text(path)
