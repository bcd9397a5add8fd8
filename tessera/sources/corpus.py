"""JSON-lines records through an acceptance gate to the corpus tables, and safe replacement of tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.functions.text import fold_author, fold_search, text_key, tokens, work_id

#: Kinds, qualities, required fields, and of claims predicates, assertion types and states.
KINDS = ("text", "translation", "commentary", "apparatus", "reference")
QUALITIES = ("source_text", "machine_corrected_ocr", "machine_ocr", "mixed_content", "needs_review")
SEARCHABLE = QUALITIES[:2]
REQUIRED = ("id", "source", "source_url", "raw_path", "raw_sha256", "text")
PREDICATES = ("lemma", "morphology", "dialect_label", "sense_gloss", "equivalent_form", "variant_reading", "editorial_state", "grammar_rule", "author_alias", "literary_dialect", "parallel_proposal")
ASSERTIONS = ("quoted_source", "extracted_annotation", "model_inference")
STATES = ("source_claim", "machine_proposed", "needs_review")
_TEXT = ("id", "source", "source_url", "raw_path", "raw_sha256", "author", "work", "edition", "citation", "language", "license", "kind", "quality", "text", "parent_id")
RECORD = StructType(
    [StructField(n, StringType()) for n in _TEXT]
    + [StructField("metadata", StringType()), StructField("lines", ArrayType(StructType([StructField("label", StringType()), StructField("text", StringType())]))), StructField("bad", StringType())]
)
CLAIM_EVIDENCE = StructType([StructField(n, StringType()) for n in ("record_id", "source_url", "raw_path", "raw_sha256", "quote", "locator")])
CLAIM = StructType(
    [StructField("id", StringType()), StructField("subject", StructType([StructField("type", StringType()), StructField("id", StringType()), StructField("passage_id", StringType()), StructField("form", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])),
     StructField("predicate", StringType()), StructField("object", StringType()), StructField("evidence", ArrayType(CLAIM_EVIDENCE)), StructField("assertion_type", StringType()), StructField("status", StringType()), StructField("method", StringType()), StructField("source_family", StringType())]
)


class Rejected(ValueError):
    """Input that must not replace what is there."""


@dataclass
class Gate:
    accepted: list[str]
    quarantined: dict[str, str]
    expected: dict[str, int]


def gate(folder: str, manifest: dict) -> Gate:
    """Files whose hash has a PASS in the manifest; the others with the reason why not."""
    accepted, quarantined, expected = [], {}, {}
    for path in sorted(Path(folder).glob("*.jsonl")):
        entry = manifest.get("files", {}).get(path.name)
        digest = hashlib.sha256()
        with path.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        if not entry:
            quarantined[path.name] = "not in the manifest"
        elif entry.get("verdict") != "PASS":
            quarantined[path.name] = f"verdict {entry.get('verdict')}"
        elif entry.get("sha256") != digest.hexdigest():
            quarantined[path.name] = "other content than accepted"
        else:
            accepted.append(str(path))
            expected[path.name] = entry["records"]
    return Gate(accepted, quarantined, expected)


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, line_no, value) of non-blank lines, split at \\n only, numbered from 1 within a file.

    A file's splits are counted apart and numbered on from each other, so that no
    task gathers a whole file.
    """
    rows = spark.read.option("lineSep", "\n").text(list(paths)).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "^\\uFEFF|\\r$", "").alias("value"))
    splits = rows.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))  # one row for each split
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    started = splits.select(F.col("file").alias("_file"), F.col("_block").alias("_start"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at"))
    numbered = rows.withColumn("_no", within).join(started, (F.col("file") == F.col("_file")) & (F.col("_block") == F.col("_start")))
    return numbered.where(F.trim("value") != "").select("file", (F.col("_before") + F.col("_no")).cast("int").alias("line_no"), "value")


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Collector records with file and line; ``bad`` holds a line that is no JSON object; ``data`` the source line."""
    parsed = read_lines(spark, paths).withColumn("_r", F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    return parsed.select("file", "line_no", F.col("value").alias("data"), "_r.*")


def broken_records(records: DataFrame) -> DataFrame:
    """(file, line_no, reason) of records that stop a build."""
    missing = F.array_join(F.filter(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull()), ",")
    copies = F.count(F.lit(1)).over(Window.partitionBy("id"))
    reason = F.when(F.col("bad").isNotNull(), "no JSON object").when(missing != "", F.concat(F.lit("missing: "), missing)).when(copies > 1, "identifier is not unique")
    return records.select("file", "line_no", reason.alias("reason")).where("reason is not null")


def passages(records: DataFrame) -> DataFrame:
    """Validated records to the passage table, defaults filled in, with keys and places in their works."""
    known = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", "unknown").otherwise(F.col(c))
    rows = records.select(
        "id", "source", "source_url", known("author").alias("author"), known("work").alias("work"), known("edition").alias("edition"), known("citation").alias("citation"), known("language").alias("language"), known("license").alias("license"),
        F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("reference").alias("kind"),
        F.when(F.col("quality").isin(*QUALITIES), F.col("quality")).otherwise("needs_review").alias("quality"),
        "text", "parent_id", "data", "file", "line_no",
    )
    rows = rows.withColumn("work_id", work_id(*[F.col(c) for c in ("source", "author", "work", "edition", "language")]))
    place = F.row_number().over(Window.partitionBy("work_id").orderBy("file", "line_no")) - 1
    return rows.withColumns({"normalized": fold_search(F.col("text")), "author_canonical": fold_author(F.col("author")), "text_key": text_key(F.col("language"), F.col("kind"), F.col("text")), "sequence": place})


def corpus_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """passages, works, passage_authors, tokens and vocabulary."""
    searchable = rows.where(F.col("quality").isin(*SEARCHABLE) & F.col("kind").isin("text", "translation"))
    forms = searchable.select(F.col("id").alias("passage_id"), F.explode(tokens(F.col("text"))).alias("form"))
    token_rows = forms.groupBy("passage_id", "form").agg(F.count(F.lit(1)).alias("count")).withColumn("normalized", fold_search(F.col("form")))
    return {
        "passages": rows,
        "works": rows.groupBy(F.col("work_id").alias("id"), "author", "work", "edition", "source", "language", "author_canonical").agg(F.count(F.lit(1)).alias("count")),
        "passage_authors": rows.select(F.col("id").alias("passage_id"), F.explode(F.array_distinct(F.split("author_canonical", " / "))).alias("author_key")),
        "tokens": token_rows,
        "vocabulary": token_rows.groupBy("normalized").agg(F.min("form").alias("form"), F.sum("count").alias("count")),
    }


def build_corpus(spark: SparkSession, folder: str, manifest: dict, target: str) -> dict:
    """Accepted files to the corpus tables below ``target``; nothing is replaced if any row or count is wrong."""
    passed = gate(folder, manifest)
    if not passed.accepted:
        raise Rejected("no accepted file")
    records = read_records(spark, passed.accepted).cache()
    broken = broken_records(records).orderBy("file", "line_no").limit(5).collect()
    if broken:
        raise Rejected("; ".join(f"{r['file']}:{r['line_no']}: {r['reason']}" for r in broken))
    counts = {r["file"]: r["count"] for r in records.groupBy("file").count().collect()}  # one row for each file
    wrong = {f: (n, counts.get(f, 0)) for f, n in passed.expected.items() if counts.get(f, 0) != n}
    if wrong:
        raise Rejected(f"other numbers of records than accepted: {wrong}")
    tables = corpus_tables(passages(records))
    for name, df in tables.items():
        replace_table(df, f"{target}/{name}")
    records.unpersist()
    return {"schema": 2, "files": counts, "quarantined": passed.quarantined, "passages": sum(counts.values())}


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), expected: int | None = None) -> None:
    """Write beside the table, check, then take its place; a failure leaves the old table."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    staged, old = (jvm.org.apache.hadoop.fs.Path(f"{path}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    df.write.partitionBy(*partition_by).parquet(staged.toString())
    if expected is not None and (found := spark.read.parquet(staged.toString()).count()) != expected:
        files.delete(staged, True)
        raise Rejected(f"{found} rows written, {expected} expected")
    if files.exists(target):
        files.rename(target, old)
    if not files.rename(staged, target):
        files.rename(old, target)
        raise Rejected(f"can't replace {path}")
    files.delete(old, True)


def broken_claims(claims: DataFrame) -> DataFrame:
    """(id, reason) of claims that stop a build."""
    start, end = F.col("subject.start"), F.col("subject.end")
    reasons = [
        (F.coalesce(F.col("id"), F.lit("")) == "", "no identifier"),
        (~F.coalesce(F.col("predicate").isin(*PREDICATES), F.lit(False)), "unknown predicate"),
        (~F.coalesce(F.col("assertion_type").isin(*ASSERTIONS), F.lit(False)), "unknown assertion type"),
        (~F.coalesce(F.col("status").isin(*STATES), F.lit(False)), "unknown status"),
        (F.coalesce(F.size("evidence"), F.lit(0)) == 0, "no evidence"),
        (F.exists("evidence", lambda e: ~F.coalesce(e["raw_sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)) | (F.coalesce(e["quote"], F.lit("")) == "")), "evidence without hash or quote"),
        (start.isNull() != end.isNull(), "one offset without the other"),
        ((start < 0) | (start >= end), "offsets out of order"),
        (start.isNotNull() & F.col("subject.passage_id").isNull(), "offsets without a passage"),
    ]
    reason = F.lit(None).cast("string")
    for bad, name in reversed(reasons):
        reason = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(reason)
    return claims.select("id", reason.alias("reason")).where("reason is not null")


def read_claims(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return read_lines(spark, paths).withColumn("_c", F.from_json("value", CLAIM)).select("file", "line_no", F.sha2("value", 256).alias("line_sha256"), "_c.*")


def write_json_lines(df: DataFrame, path: str, split: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).json(path)


def publish_vectors(vectors: DataFrame, path: str, model: str, dimensions: int, partition_by: Sequence[str] = ()) -> dict:
    """Vectors as a table with a manifest; those of another length or norm stop the publication."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    wrong = vectors.where((F.size("embedding") != dimensions) | ~norm.between(0.99, 1.01)).limit(1).count()
    if wrong:
        raise Rejected("vectors of another length or norm")
    replace_table(vectors, path, partition_by)
    return json.loads(json.dumps({"model": model, "dimensions": dimensions, "rows": vectors.count()}))


def report_markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as Markdown; more rows than ``most`` are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]) + "\n"
