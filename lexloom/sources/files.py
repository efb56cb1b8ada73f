"""File sources and sinks: CSV, JSON, JSON lines, GEXF, partitioned and matrix outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a corpus file.
CORPUS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("post_id", "body")]
    + [T.StructField("createdAt", T.TimestampNTZType())]
    + [T.StructField(n, T.StringType()) for n in ("subreddit", "type", "comment_id", "parent_id", "source")]
)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Quoted fields may span lines; a byte-order mark before the first name is dropped. Globs and lists are unions."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("\ufeff")) if first.startswith("\ufeff") else df


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first path that exists in its own file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    raise FileNotFoundError(f"none of {list(candidates)}")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_jsonl_last(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Lines that don't parse are left out; of each key the last entry by ``order`` stays."""
    raw = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema + ", _bad string").json(path)
    good = raw.where(F.col("_bad").isNull() & F.col(key).isNotNull()).drop("_bad")
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return good.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def write_top(df: DataFrame, path: str, order: Sequence, n: int) -> None:
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One file for a graph of bounded size (checked)."""
    from xml.sax.saxutils import quoteattr

    if edges.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges")
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf version="1.2"><graph defaultedgetype="undirected">\n<nodes>\n')
        for r in nodes.toLocalIterator():
            f.write(f'<node id={quoteattr(r["term"])} label={quoteattr(r["term"])} freq="{r["freq"]}"/>\n')
        f.write("</nodes>\n<edges>\n")
        for i, r in enumerate(edges.toLocalIterator()):
            f.write(f'<edge id="{i}" source={quoteattr(r["src"])} target={quoteattr(r["dst"])} weight="{r["weight"]}"/>\n')
        f.write("</edges>\n</graph></gexf>\n")


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _freq long").load(path).select(F.col("_id").alias("term"), F.col("_freq").alias("freq"))
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, _weight long").load(path)
    return nodes, edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_weight").alias("weight"))


def matrix(edges: DataFrame, names: Sequence[str]) -> DataFrame:
    """A labelled square matrix of a bounded list of names, zeros where there is no edge."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.where(F.col("src").isin(*names)).groupBy(F.col("src").alias("term")).pivot("dst", list(names)).agg(F.first("weight")).na.fill(0)


#: The columns of a table of seed terms.
SEED_TERMS = T.StructType([T.StructField(n, T.StringType()) for n in ("term", "provenance_case_id", "pattern_type", "confidence", "retrieval_action")])


def read_seed_terms(spark: SparkSession, path: str, most: int = 10_000) -> list[tuple[str, str, str]]:
    """``(term, confidence, action)`` of a small table; more than ``most`` rows are an error."""
    rows = read_csv(spark, path, SEED_TERMS).where("term is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} seed terms")
    return [(r["term"], r["confidence"], r["retrieval_action"]) for r in rows]


def read_strata(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, pattern: str, name: str = "stratum") -> DataFrame:
    """The union of files with a column that ``pattern``'s first group finds in each file's name."""
    return read_csv(spark, path, schema).withColumn(name, F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), pattern, 1))


def write_csv(df: DataFrame, path: str, fallback: str | None = None) -> str:
    """Writes to ``path``, or to ``fallback`` where ``path`` can't be written; returns where."""
    try:
        df.write.mode("overwrite").option("header", True).csv(path)
        return path
    except Exception:
        if fallback is None:
            raise
        df.write.mode("overwrite").option("header", True).csv(fallback)
        return fallback


def write_summary(df: DataFrame, path: str) -> None:
    """A small aggregate as one JSON file, one object a row; columns of nested types stay nested."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lexicon(spark: SparkSession, lexicons: dict[str, Sequence[str]], path: str) -> None:
    """Named sets of terms as JSON, terms sorted and each once."""
    rows = [(name, sorted(set(terms))) for name, terms in sorted(lexicons.items())]
    spark.createDataFrame(rows, "name string, terms array<string>").coalesce(1).write.mode("overwrite").json(path)


def write_embeddings(df: DataFrame, path: str, id_col: str, vec: str) -> None:
    """Parquet of ``row_index, id, embedding`` with a gapless index in the order of the ids."""
    from lexloom.operators.corpus import row_index

    row_index(df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<float>").alias("embedding")), "id").write.mode("overwrite").parquet(path)


def write_report(sections: Sequence[tuple[str, DataFrame]], path: str, most: int = 500) -> None:
    """A Markdown report: each section's small table as text, written by one task. More than ``most`` rows in a section are an error."""
    spark = sections[0][1].sparkSession
    lines: list[str] = []
    for title, df in sections:
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"section {title!r} has more than {most} rows")
        lines += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows] + [""]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
