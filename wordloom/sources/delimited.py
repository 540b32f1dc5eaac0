"""Delimited text: dialect detection, tolerant reading, clean writing."""

import csv
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordloom.constants import DELIMITERS, MAX_HEADER_CELL
from wordloom.functions import text as T
from wordloom.operators.ranking import top_per_group

_HEAD_LINES = 25


def head_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines of the first block of each file, in file order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), "value")
    return lines.filter("block = 0").drop("block")


def _occurrences(value: Column, delimiter: str) -> Column:
    return (F.length(value) - F.length(F.replace(value, F.lit(delimiter), F.lit("")))).cast("bigint")


def sniff_dialect(lines: DataFrame, file: str = "file", order: str = "line_no", value: str = "value") -> DataFrame:
    """(file, delimiter): the separator that is on each of the first 25 non-blank lines most evenly."""
    filled = lines.filter(~T.is_blank(F.col(value)))
    head = top_per_group(filled, [file], [F.col(order)], _HEAD_LINES)
    ends = []
    for i, d in enumerate(DELIMITERS):
        n = _occurrences(F.col(value), d)
        ends += [F.min(n).alias(f"low_{i}"), F.max(n).alias(f"high_{i}")]
    stats = head.groupBy(file).agg(*ends)
    choices = F.array(*[F.struct(
        F.when(F.col(f"low_{i}") >= 1, F.col(f"low_{i}") * 10 - (F.col(f"high_{i}") - F.col(f"low_{i}"))).alias("score"),
        F.lit(-i).alias("turn"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)])
    # A negative score never beats the default.
    usable = F.filter(choices, lambda c: c["score"] >= 0)
    return stats.select(file, F.coalesce(F.array_max(usable)["delimiter"], F.lit(",")).alias("delimiter"))


def looks_like_header(first_rows: list[list[str]]) -> bool:
    """Whether the first of at least two rows reads like column names."""
    if len(first_rows) < 2:
        return False
    head = [c.strip() for c in first_rows[0]]
    numeric = [c.removeprefix("-").replace(".", "", 1) for c in head]
    return (bool(head) and all(head) and len(set(head)) == len(head) and max(map(len, head)) <= MAX_HEADER_CELL
            and not all(c.isascii() and c.isdigit() and not n.startswith(".") and not n.endswith(".")
                        for c, n in zip(numeric, head)))


@dataclass
class Delimited:
    """What was read, the delimiter of most files, whether they had a header, and whether quotes were read literally."""

    data: DataFrame
    delimiter: str
    had_header: bool
    recovered_from_quotes: bool


def _single(value: Column) -> Column:
    """Without doubled quote marks, which stand for one inside a quoted field."""
    return F.replace(value, F.lit('""'), F.lit(""))


def _opens_quote(value: Column, delimiter: str) -> Column:
    """Whether a line has a field that starts with a quote mark and does not end with one."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    rest = F.regexp_replace(_single(value), f'(^|{d})"[^"]*+"(?={d}|$)', "$1")
    return rest.rlike(f'(^|{d})"')


def _misquoted(spark: SparkSession, paths: list[str], quoted: DataFrame, names: list[str]) -> bool:
    """Whether reading records over several lines went wrong too.

    A stray quote mark leaves an odd number in its file, or a field that begins with the mark, or
    a record of another width.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    odd = lines.groupBy("file").agg(F.sum(_occurrences(_single(F.col("value")), '"')).alias("n")).filter("n % 2 = 1")
    if odd.limit(1).count():
        return True
    fields = F.array(*[F.col(f"`{n}`") for n in names])
    raw = F.exists(fields, lambda f: F.coalesce(f.startswith('"') & F.contains(f, F.lit("\n")), F.lit(False)))
    return quoted.filter(raw | F.col("_broken").isNotNull()).limit(1).count() > 0


def _read_alike(spark: SparkSession, paths: list[str], delimiter: str, header: list[str] | None) -> tuple[DataFrame, bool]:
    """Rows of files with one delimiter and one header (or none), and whether quote marks were read literally."""
    lines = spark.read.text(paths)
    base = (spark.read.option("sep", delimiter).option("header", str(header is not None).lower()).option("mode", "PERMISSIVE")
            .option("enforceSchema", "true").option("maxCharsPerColumn", "-1").option("escape", '"'))
    names = header
    if names is None:
        plain = F.regexp_replace(_single(F.col("value")), '"[^"]*+"', "")
        widest = lines.agg(F.max(_occurrences(plain, delimiter)).alias("n")).first()
        names = [f"column_{i + 1}" for i in range((widest.n or 0) + 1)]
    schema = ", ".join(f"`{n}` string" for n in names)
    recovered = False
    if lines.filter(_opens_quote(F.col("value"), delimiter)).limit(1).count() == 0:
        data = base.schema(schema).csv(paths)
    else:
        whole = base.option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken")
        quoted = whole.schema(schema + ", `_broken` string").csv(paths)
        recovered = _misquoted(spark, paths, quoted, names)
        plain_reader = base.option("multiLine", "false").option("quote", "")
        data = plain_reader.schema(schema).csv(paths) if recovered else quoted.drop("_broken")
    filled_row = F.lit(False)
    for n in names:
        filled_row = filled_row | ~T.is_blank(F.col(f"`{n}`"))
    return data.filter(filled_row), recovered


def _as_path(uri: str) -> str:
    """A file's URI as a path that Spark does not take for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def read_delimited(spark: SparkSession, path: str) -> Delimited:
    """Read delimited files as strings; rows are never lost to stray quotes or to another file's dialect.

    Delimiter and header are judged file by file, by a file's own first two rows; a file of one line
    has a header if it repeats that of another file. Files that agree are read together. A file
    without a header takes the names of the headed files of the same width if these agree, else column_1 and so on;
    rows are united by column name. Well-quoted single-line records are read in splits. If some line
    leaves a quote open, whole files are tried with records over several lines; if that goes wrong
    too, quote marks are read literally. The driver holds two lines of each file.
    """
    head = head_lines(spark, path)
    first = top_per_group(head.filter(~T.is_blank(F.col("value"))), ["file"], [F.col("line_no")], 2)
    files = first.join(sniff_dialect(head), "file").groupBy("file", "delimiter").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("lines")).collect()
    firsts = {f.file: (f.delimiter, list(csv.reader([r.value for r in f.lines], delimiter=f.delimiter))) for f in files}
    names = {f: tuple(c.strip() for c in rows[0]) for f, (_, rows) in firsts.items()}
    looks = {f for f, (_, rows) in firsts.items() if looks_like_header(rows)}
    headers = {(firsts[f][0], names[f]) for f in looks}
    groups: dict[tuple, list[str]] = {}
    for file in sorted(firsts):  # a file that repeats another one's header has one too, even if it has no more lines
        own = (firsts[file][0], names[file])
        group = own if own in headers else (own[0], None)
        groups.setdefault(group, []).append(_as_path(file))
    if not groups:
        return Delimited(spark.createDataFrame([], "column_1 string"), ",", False, False)
    by_size = sorted(groups, key=lambda g: (-len(groups[g]), g[0], g[1] or ()))
    read = {g: _read_alike(spark, groups[g], g[0], list(g[1]) if g[1] else None) for g in by_size}
    known = {g[1] for g in groups if g[1]}
    widths = {len(h): h for h in known if sum(len(o) == len(h) for o in known) == 1}
    parts = [df.toDF(*widths[len(df.columns)]) if g[1] is None and len(df.columns) in widths else df for g, (df, _) in read.items()]
    data = parts[0]
    for part in parts[1:]:
        data = data.unionByName(part, allowMissingColumns=True)
    return Delimited(data.na.fill(""), by_size[0][0], by_size[0][1] is not None, any(r for _, r in read.values()))


def write_clean_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quote marks doubled, a header in every part file."""
    cells = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    cells.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def write_results(df: DataFrame, path: str, format: str = "json") -> None:
    """Result records as JSON lines or Parquet."""
    if format not in ("json", "parquet"):
        raise ValueError(f"unknown format {format!r}")
    df.write.format(format).save(path)
