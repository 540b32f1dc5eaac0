"""Line-based text: one document per line, labeled lines, 0/1 label columns before the text."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordloom.functions import text as T
from wordloom.functions.rows import posexplode_rows
from wordloom.sources.delimited import head_lines


def text_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Trimmed non-empty lines as documents."""
    return lines.withColumn(value, T.strip(F.col(value))).filter(F.col(value) != "").withColumnRenamed(value, "text")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark.read.text(path))


def write_text_lines(df: DataFrame, path: str, value: str = "value") -> None:
    df.select(value).write.text(path)


def split_paragraphs(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, position, paragraph): blank lines and sentence ends separate, counted from 1."""
    return posexplode_rows(df, T.paragraphs(F.col(text)), "position", "paragraph", id)


@dataclass
class MultilabelLayout:
    """How the lines of a multi-label text file are built."""

    separator: str
    label_columns: list[str]
    has_header: bool


def _bare(cell: str) -> str:
    cell = cell.strip()
    cell = cell[1:] if cell[:1] in ("'", '"') else cell
    return cell[:-1] if cell[-1:] in ("'", '"') else cell


def detect_multilabel(first: str, second: str | None) -> MultilabelLayout | None:
    """The layout told by the first two lines, or None for plain text."""
    separator = next((s for s in ("\t", ",") if s in first), None)
    if separator is None:
        return None
    parts = first.split(separator)
    leading: list[str] = []
    for part in map(_bare, parts[:-1]):
        if part not in ("0", "1") and (len(part) >= 20 or " " in part):
            break
        leading.append(part)
    last = parts[-1].strip()
    if not leading or not (len(last) > 20 or last.startswith('"')):
        return None
    named = not any(p in ("0", "1") for p in leading)
    has_header = bool(second) and named and _bare(second.split(separator)[0]) in ("0", "1")
    names = leading if has_header else [f"label{i}" for i in range(len(leading))]
    return MultilabelLayout(separator, names, has_header)


def parse_multilabel(lines: DataFrame, layout: MultilabelLayout, value: str = "value") -> DataFrame:
    """(text, one 0/1 column per label) of every line with text; other columns are kept."""
    n = len(layout.label_columns)
    cells = F.split(F.col(value), layout.separator)
    tail = T.strip(F.array_join(F.slice(cells, n + 1, F.greatest(F.size(cells) - n, F.lit(0))), layout.separator))
    rows = lines.withColumn("_cells", cells).withColumn("text", T.unquote(tail)).filter(F.col("text") != "")
    flags = {c: (T.unquote(T.strip(F.coalesce(F.get("_cells", F.lit(i)), F.lit("")))) == "1").cast("int")
             for i, c in enumerate(layout.label_columns)}
    return rows.withColumns(flags).drop("_cells", value)


def read_multilabel_txt(spark: SparkSession, path: str) -> DataFrame | None:
    """Read a multi-label text file, or None if its first lines are not of that kind."""
    head = head_lines(spark, path).filter(~T.is_blank(F.col("value")))
    start = [r.value for r in head.orderBy("file", "line_no").limit(2).collect()]
    layout = detect_multilabel(start[0], start[1] if len(start) > 1 else None) if start else None
    if layout is None:
        return None
    lines = spark.read.text(path).filter(~T.is_blank(F.col("value")))
    if layout.has_header:
        lines = lines.filter(F.col("value") != start[0])
    return parse_multilabel(lines, layout)
