"""File sources and exports: text files as documents, validated ingestion, CSV, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Accepted types of documents and the most characters and structured rows of one; fixed values.
DOCUMENT_TYPES = ["fir", "cdr", "financial", "surveillance", "social", "criminal_history", "intel"]
MAX_CHARS, MAX_ROWS = 200_000, 20_000


def text_files(spark: SparkSession, path: str, document_type: str = "fir") -> DataFrame:
    """One document per text file: whole text, trimmed; blank files are left out; ids are hashes of path and text."""
    t = spark.read.text(path, wholetext=True).select(F.trim("value").alias("raw_text"), F.input_file_name().alias("source_path")).filter("raw_text <> ''")
    return t.select(F.concat(F.lit("doc-"), F.substring(F.sha1(F.concat_ws("|", "source_path", "raw_text").cast("binary")), 1, 12)).alias("id"), F.lit(document_type).alias("document_type"), "raw_text", "source_path")


def validated(docs: DataFrame, known: DataFrame | None = None, cases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``) documents; ids that are known or come twice, and unknown cases, are rejected."""
    d = docs.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    reason = (
        F.when(F.col("id").isNull() | (F.trim("id") == ""), "no id")
        .when(F.col("raw_text").isNull() | (F.trim("raw_text") == ""), "blank text")
        .when(F.length("raw_text") > MAX_CHARS, "text too long")
        .when(F.col("document_type").isNull() | ~F.lower(F.trim("document_type")).isin(DOCUMENT_TYPES), "unknown type")
        .when(F.col("_n") > 1, "duplicate id")
    )
    d = d.withColumn("reason", reason).drop("_n")
    if known is not None:
        d = d.join(known.select("id").distinct().withColumn("_k", F.lit(True)), "id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_k"), "duplicate id"))).drop("_k")
    if cases is not None:
        d = d.join(cases.select(F.col("id").alias("case_id")).distinct().withColumn("_c", F.lit(True)), "case_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_c").isNull(), "missing case"))).drop("_c")
    return d.filter("reason IS NULL").drop("reason"), d.filter("reason IS NOT NULL")


def csv_export(rows: DataFrame, path: str, separator: str = ";") -> None:
    """CSV with arrays joined and booleans as yes and no."""
    out = rows
    for f in rows.schema.fields:
        if f.dataType.typeName() == "array":
            out = out.withColumn(f.name, F.array_join(F.transform(f.name, lambda x: x.cast("string")), separator))
        elif f.dataType.typeName() == "boolean":
            out = out.withColumn(f.name, F.when(F.col(f.name), "yes").when(~F.col(f.name), "no"))
    out.write.mode("overwrite").option("header", True).csv(path)


def graph_json(vertices: DataFrame, edges: DataFrame, case: str = "case_id") -> DataFrame:
    """(case_id, graph) with nodes and edges of each case as one JSON text, for cases small enough to be drawn."""
    v = vertices.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("id", "label", "type"))).alias("nodes"))
    e = edges.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "relation_type", "confidence"))).alias("edges"))
    return v.join(e, case, "left").select(case, F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges"))).alias("graph"))


def markdown_report(title: str, summary: DataFrame, findings: DataFrame, most: int = 200) -> str:
    """A report of small tables as Markdown; at most ``most`` rows of each reach the driver."""

    def part(df: DataFrame) -> list[str]:
        rows = df.limit(most).collect()
        return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)] + ["| " + " | ".join("" if c is None else str(c) for c in r) + " |" for r in rows]

    return "\n".join([f"# {title}", "", *part(summary), "", "## Findings", "", *part(findings), "", "Findings are leads for review, tied to their documents."])
