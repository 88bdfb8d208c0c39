"""Reports and keyed stores: JSON findings, append-only logs, partitioned catalogs, staged overwrites."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, in folders by code, so that a reader prunes."""
    findings.write.mode("overwrite").partitionBy("code").json(path)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file", "sheet").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("findings"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_catalog(samples: DataFrame, path: str) -> None:
    samples.write.mode("append").partitionBy("category_slug").parquet(path)


def write_texts(texts: DataFrame, path: str) -> None:
    """Mirrors of documents: (file, text) as plain text, a folder for each file name, so names need no list on the driver."""
    texts.select("file", "text").write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path)


def front_matter(fields: dict[str, Column], kinds: dict[str, str], body: Column) -> Column:
    """A mirror file: its fields between rules as YAML, and the text below. kinds: text (quoted, with quotes and backslashes
    escaped), list (quoted texts in brackets), or plain (numbers, dates, true and false as they are). Null is null."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    form = {"text": quoted, "list": lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ", "), F.lit("]")), "plain": lambda c: c.cast("string")}
    rows = [F.concat(F.lit(f"{name}: "), F.coalesce(form[kinds.get(name, "plain")](c), F.lit("null"))) for name, c in fields.items()]
    return F.concat(F.concat_ws("\n", F.lit("---"), *rows, F.lit("---")), F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))


def with_provenance(texts: DataFrame, mark: str = "## Примечания") -> DataFrame:
    """(file, text): corpus texts below a header of where they come from, with the notes (if any) at the end, behind a mark.
    texts: (file, source_url, fetched, reason, body, notes)."""
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in ("source_url", "fetched", "reason")])
    tail = F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit(f"\n{mark}\n"), "notes")).otherwise("")
    return texts.select("file", F.concat(head, F.lit("\n\n"), "body", tail).alias("text"))


def manifest(files: DataFrame, package: str) -> DataFrame:
    """One row for each package: how many files it has, their bytes, and a digest of their names and contents in order.
    files: (package, label, content_hash, n_bytes)."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "content_hash"))), lambda x: F.concat(x["label"], F.lit(" "), x["content_hash"])), "\n")
    return files.groupBy(package).agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.sha2(parts, 256).alias("digest"))


def replace(rows: DataFrame, path: str, keep: int = 5) -> None:
    """Write beside, read back, then swap by rename. The table before becomes a numbered copy, of which the `keep` newest
    stay; where the second rename fails, the copy goes back to its place. Between the two renames there is no table
    under the name, so readers that must not see that moment read through a lock or a table format."""
    spark = rows.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    back = spark.read.parquet(staged)
    if back.dtypes != rows.dtypes:
        fs.delete(P(staged), True)
        raise ValueError("what was written reads back with other columns")
    back.count()
    copies = sorted(int(n) for f in fs.listStatus(P(path).getParent()) for n in [f.getPath().getName().removeprefix(P(path).getName() + ".copy-")] if n.isdigit())
    copy = P(f"{path}.copy-{(copies[-1] if copies else 0) + 1}")
    had = fs.exists(P(path))
    if had:
        fs.rename(P(path), copy)
    if not fs.rename(P(staged), P(path)):
        if had:
            fs.rename(copy, P(path))
        raise OSError(f"{staged} could not take the place of {path}")
    for n in copies[: max(0, len(copies) + had - keep)]:
        fs.delete(P(f"{path}.copy-{n}"), True)
