"""Table grids: spans, headers, fill-down and trimming over cells (table_id, r, c, text, ...)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels that make a first row a header.
HEADER_LABELS = (
    "Dataset", "Method", "Symbol", "Description", "Type", "Category", "Task", "Setting", "Model", "Configuration", "Component", "Step",
    r"Hyper-?parameter", "Layer", "Methods?", "Models?", "Datasets?", r"Threat\s*Model", r"Defense\s*Strategy", r"Attack\s*Type",
    r"Target(?:ed)?\s*(?:LLM|Model)?", "Defense", "Attack", "Hyperparameter",
)
#: What a cell of measurements looks like, a short name in capitals, and such that are headers all the same.
METRIC, SHORT, HEADER_SHORT = r"^\d[\d.,()+\-*\s]*$|\(\+\d", r"^[A-Z]{2,5}$", frozenset({"DATASET", "METHOD", "TABLE", "ABBR"})
#: The longest span of a cell, as browsers have it: a page can ask for any.
MOST_SPAN = 1000
#: The longest text in which a label may stand among other words.
LOOSE = 60
_LABEL = re.compile("|".join(f"(?:{x})" for x in HEADER_LABELS), re.IGNORECASE)
_WITHIN = re.compile(rf"\b(?:{_LABEL.pattern})\b", re.IGNORECASE)


def fill_down(cells: DataFrame, column: str = "text", order: str = "r", *keys: str) -> DataFrame:
    """Blank cells take the last value above them."""
    over = Window.partitionBy(*(keys or ("table_id", "c"))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("filled", F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(over))


def header_run(rows: DataFrame, ok: Column, *keys: str) -> DataFrame:
    """Which rows belong to the unbroken run of header rows at a table's top."""
    over = Window.partitionBy(*(keys or ("table_id",))).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_header", F.min(ok.cast("int")).over(over) == 1)


def trim_empty_columns(cells: DataFrame, *keys: str) -> DataFrame:
    """Drop empty columns at the right end, but leave two."""
    own = keys or ("table_id",)
    last = F.max(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.col("c"))).over(Window.partitionBy(*own))
    return cells.withColumn("_last", F.greatest(F.coalesce(last, F.lit(-1)), F.lit(1))).where("c <= _last").drop("_last")


def is_label(text: str) -> bool:
    """Whether a cell names a column: a label alone, bold or not, or a label in a short text."""
    alone = text.strip().strip("*").strip()
    return bool(_LABEL.fullmatch(alone)) or len(text.strip()) <= LOOSE and bool(_WITHIN.search(text))


def _continues(row: list[dict], width: int) -> bool:
    """Whether a row below a header can be one too, in a table of that width."""
    enough = len(row) >= max(3, width // 2)
    flat = sum(c["colspan"] for c in row) <= width + 1 and max((c["rowspan"] for c in row), default=1) <= 2
    data = (c["text"] for c in row if re.search(METRIC, c["text"].strip()) or c["text"] not in HEADER_SHORT and re.match(SHORT, c["text"]))
    return width >= 4 and enough and flat and next(data, None) is None


def header_rows(rows: list[list[dict]]) -> int:
    """How many rows at the top are headers: rows are lists of cells with text, colspan, rowspan and is_header."""
    marked = [bool(r) and all(c.get("is_header") for c in r) for r in rows]
    top = marked.index(False) if False in marked else len(rows)
    if not top:
        top = int(bool(rows) and any(is_label(c["text"]) for c in rows[0]))
    below = rows[top:]
    width = max((sum(c["colspan"] for c in r) for r in below), default=sum(c["colspan"] for c in rows[0]) if rows else 0)
    return top + next((i for i, r in enumerate(below) if not _continues(r, width)), len(below)) if top else 0


def expand_grid(rows: list[list[dict]]) -> list[list[str]]:
    """A rectangle of texts in which a cell fills all places that it spans, of one table; span_grid does so for tables of rows."""
    grid: list[dict[int, str]] = [{} for _ in rows]
    until: dict[int, int] = {}
    for r, row in enumerate(rows):
        behind = 0
        for cell in row:
            c, behind = _placed(until, r, behind, cell["colspan"], cell["rowspan"])
            for i in range(r, min(len(rows), r + max(1, cell["rowspan"]))):
                for j in range(c, behind):
                    grid[i].setdefault(j, cell["text"])
    width = max((max(g, default=-1) + 1 for g in grid), default=0)
    return [[g.get(j, "") for j in range(width)] for g in grid]


def _placed(until: dict[int, int], r: int, c: int, colspan: int | None, rowspan: int | None) -> tuple[int, int]:
    """The first column from c on that nothing covers in row r, and the one behind the cell that is put there; until says up to
    which row a column is covered."""
    while until.get(c, -2) >= r:
        c += 1
    behind = c + min(MOST_SPAN, max(1, colspan or 1))
    for j in range(c, behind):
        until[j] = max(until.get(j, -2), r + min(MOST_SPAN, max(1, rowspan or 1)) - 1)
    return c, behind


def placed_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """cells (keys, r, ord, colspan, rowspan, more) with c, the column where each begins.

    A sweep down each table: a cell takes the first column of its row that no span from above and no cell before covers. Where it
    begins depends on all cells before it, so tables are exchanged once and pass as sorted streams; a task holds for each column of
    one table up to which row it is covered, and no table. Null spans count as one, null rows and orders come first.
    """
    own, given = list(keys or ("table_id",)), cells.columns
    ordered = cells.withColumn("_row", F.coalesce(F.col("r").cast("int"), F.lit(-1))).repartition(*own).sortWithinPartitions(*own, "_row", "ord")
    schema = T.StructType([*cells.schema.fields, T.StructField("c", T.IntegerType())])

    def run(batches):
        table, begun, row, next_, until = None, False, None, 0, {}
        for batch in batches:
            out = []
            at = zip(*(batch.column(k).to_pylist() for k in own))
            for key, r, colspan, rowspan in zip(at, *(batch.column(n).to_pylist() for n in ("_row", "colspan", "rowspan"))):
                if key != table or not begun:
                    table, begun, row, until = key, True, None, {}
                row, next_ = r, next_ if r == row else 0
                c, next_ = _placed(until, r, next_, colspan, rowspan)
                out.append(c)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in given), pa.array(out, pa.int32())], names=[*given, "c"])

    return ordered.mapInArrow(run, schema)


def span_grid(cells: DataFrame, *keys: str) -> DataFrame:
    """Tables of cells (keys, r, ord, text, colspan, rowspan) as grids: keys, r, texts, one for each of the table's columns.

    A cell fills all places that it spans, down to the last row of its table; where cells overlap the first stays; places that none
    fills are empty. Cells without a row are left out, spans end at MOST_SPAN.
    """
    own = list(keys or ("table_id",))
    span = lambda c: F.greatest(F.lit(1), F.least(F.coalesce(F.col(c).cast("int"), F.lit(1)), F.lit(MOST_SPAN))).alias(c)
    placed = placed_cells(cells.where("r is not null").select(*own, F.col("r").cast("int").alias("r"), "ord", "text", span("colspan"), span("rowspan")), *own)
    table = Window.partitionBy(*own)  # and no join with an aggregate, for which all cells would be placed again
    told = placed.dropna(subset=own).select("*", F.max("r").over(table).alias("_last"), F.max(F.col("c") + F.col("colspan")).over(table).alias("_width"))
    down = F.explode(F.sequence(F.col("r"), F.least(F.col("_last"), F.col("r") + F.col("rowspan") - 1)))
    across = told.select(*own, "_width", F.struct("r", "ord").alias("from"), "text", "c", "colspan", down.alias("r"))
    filled = across.select(*own, "_width", "from", "text", "r", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("colspan") - 1)).alias("c"))
    first = filled.groupBy(*own, "r", "c", "_width").agg(F.min_by(F.coalesce("text", F.lit("")), "from").alias("text"))
    texts = F.map_from_entries(F.collect_list(F.struct("c", "text")))
    rows = first.groupBy(*own, "r", "_width").agg(texts.alias("_texts"))
    whole = F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda c: F.coalesce(F.try_element_at("_texts", c), F.lit("")))
    return rows.select(*own, "r", whole.alias("texts"))


def grid_markdown(grid: DataFrame, *keys: str, headers: int = 1) -> DataFrame:
    """Grids (keys, r, texts) as Markdown tables: keys, table_md. The first ``headers`` rows fold into one, pieces of a column
    joined and told once; bars in cells are escaped. Tables of bounded size: one row each."""
    own = list(keys or ("table_id",))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("r", "texts"))), lambda x: F.transform(x["texts"], lambda t: F.replace(t, F.lit("|"), F.lit("\\|"))))
    whole = grid.groupBy(*own).agg(rows.alias("rows"))
    width = F.size(F.get("rows", F.lit(0)))
    pieces = lambda c: F.array_distinct(F.filter(F.transform(F.slice("rows", 1, max(1, headers)), lambda row: F.get(row, c)), lambda t: t != ""))
    header = F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.array_join(pieces(c), "<br>"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(F.slice("rows", max(1, headers) + 1, F.size("rows")), line)
    return whole.select(*own, F.array_join(F.concat(F.array(line(header), line(F.array_repeat(F.lit("---"), width))), body), "\n").alias("table_md"))


def table_width(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, width: the most columns that the cells (keys, r, colspan, is_header) of a row below the headers take, or those of the
    first row where all are headers."""
    own = list(keys or ("table_id",))
    taken = F.sum(F.greatest(F.lit(1), F.coalesce("colspan", F.lit(1))))
    rows = cells.groupBy(*own, "r").agg(taken.alias("n"), F.bool_and(F.coalesce("is_header", F.lit(False))).alias("header"))
    return rows.groupBy(*own).agg(F.coalesce(F.max(F.when(~F.col("header"), F.col("n"))), F.min_by("n", "r")).cast("int").alias("width"))


def fold_header(grid: list[list[str]], n: int) -> tuple[list[str], list[list[str]]]:
    """One header row of the first n, pieces of a column joined; without any the first row is it."""
    n = max(1, n)
    width = len(grid[0]) if grid else 0
    return ["<br>".join(dict.fromkeys(g[c] for g in grid[:n] if g[c])) for c in range(width)], grid[n:]


def to_markdown(header: list[str], body: list[list[str]]) -> str:
    while len(header) > 2 and not header[-1] and not any(row[-1] for row in body):
        header, body = header[:-1], [row[:-1] for row in body]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, body)])


def column_weights(cells: DataFrame, *keys: str) -> DataFrame:
    """Share of a page that each column (keys, c) of a table gets: little for columns that are formulas for four fifths or more."""
    from quillspark.functions.text import is_pure_math

    own = keys or ("table_id",)
    weight = F.when(F.avg(is_pure_math(F.col("text")).cast("int")) >= 0.8, 1.2).otherwise(3.0)
    per = cells.groupBy(*own, "c").agg(weight.alias("weight"))
    return per.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(*own)))


def occupied(cells: DataFrame, *keys: str) -> DataFrame:
    """Places (keys, r, c) that a cell above covers by its rowspan, in the column where that begins: an equi-join by column
    made by exploding each span, so no rows are compared in pairs."""
    own = keys or ("table_id",)
    return cells.where("rowspan > 1").select(*own, F.explode(F.sequence(F.col("r") + 1, F.col("r") + F.col("rowspan") - 1)).alias("r"), "c").distinct()
