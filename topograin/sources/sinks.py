"""Writers: scorer files, TSV, JSON lines, names, LaTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the header that scorers of this format read.
HEADER = "TOKEN\tNE-COARSE-LIT\tNE-COARSE-METO\tNE-FINE-LIT\tNE-FINE-METO\tNE-FINE-COMP\tNE-NESTED\tNEL-LIT\tNEL-METO\tMISC"


def write_scorer_file(lines: DataFrame, path: str) -> None:
    """(doc_id, sent_idx, lines) as a scorer file: a header, then sentences in order, each after a
    comment with its id and before an empty line."""
    body = F.concat(F.lit("# sentence_id = "), F.concat_ws("_", "doc_id", "sent_idx"), F.lit("\n"), F.col("lines"), F.lit("\n"))
    head = lines.sparkSession.range(1).select(F.lit(HEADER + "\n").alias("value"), F.lit(0).alias("o"), F.lit("").alias("d"), F.lit(0).alias("s"))
    rows = lines.select(body.alias("value"), F.lit(1).alias("o"), F.col("doc_id").cast("string").alias("d"), F.col("sent_idx").cast("int").alias("s"))
    head.unionByName(rows).orderBy("o", "d", "s").select("value").write.text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    flat.write.csv(path, sep="\t", header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_names(names: DataFrame, path: str) -> None:
    names.select("name").write.text(path)


def latex(rows: list, columns: list[str]) -> str:
    """A small report as a LaTeX table."""
    line = lambda cells: " & ".join("" if c is None else str(c).replace("_", r"\_") for c in cells) + r" \\"
    body = [line([r[c] for c in columns]) for r in rows]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", line(columns), r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
