"""Page parsers as table functions, for SQL with LATERAL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillspark.sources.html import BLOCKS, bibliography, blocks_of, tree
from quillspark.sources.write_back import LEAVES, leaves_of


def _rows(names: list[str], make: Callable[[str], list[dict]]) -> type:
    class Rows:
        def eval(self, page: str) -> Iterator[tuple]:
            for i, row in enumerate(make(page) if page else []):
                yield tuple(i if n == "block_idx" else row.get(n) for n in names)

    return Rows


def register(spark: SparkSession) -> None:
    """parse_blocks(html), parse_bibliography(html) and text_leaves(html): the rows of the functions of these names for one page, without
    its doc_id. A null or empty page gives none. Rows go back without Arrow, which would make a table of each page's."""
    titles = lambda html: [{"anchor": a, "title": t} for a, t in bibliography(tree(html)).items()]
    for name, schema, make in (("parse_blocks", BLOCKS, blocks_of), ("parse_bibliography", "doc_id string, anchor string, title string", titles), ("text_leaves", LEAVES, leaves_of)):
        columns = schema.split(", ")[1:]
        spark.udtf.register(name, udtf(_rows([c.split()[0] for c in columns], make), returnType=", ".join(columns), useArrow=False))
