"""Sources and sinks: records as JSON Lines, tables with a header, summaries, matrices, Atom feeds, archives of TeX sources."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RECORD = "id string, published string, primary_category string, categories array<string>, title string, abstract string"
ATOM_ENTRY = "id string, published string, updated string, title string, summary string, category array<struct<_term:string>>"
MOST_BYTES = 14_000_000
AUTHORED = (".tex", ".bbl", ".txt")


# JSON Lines


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of a declared schema: nothing is inferred."""
    return spark.read.schema(schema).json(path)


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def append_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream has now; the checkpoint keeps a repeated run from writing a record twice."""
    return records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def not_done(records: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What a resumed run still has to do."""
    return records.join(done.select(key).distinct(), key, "left_anti")


# Tables, summaries, matrices


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue="")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, nullValue="")


def summary(df: DataFrame, key: str, values: Sequence[str], name: str) -> DataFrame:
    """One row of JSON text: ``{name: {key: {values}}}``, keys in order. For the few rows of a report."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.struct(*values).alias("value"))))
    return df.agg(F.to_json(F.map_from_arrays(F.array(F.lit(name)), F.array(F.map_from_entries(entries)))).alias("value"))


def write_summary(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str, name: str, values: str) -> DataFrame:
    """key and the fields in ``values`` (a DDL struct body such as ``n:bigint,rate:double``) of every entry."""
    parsed = F.from_json("value", f"struct<`{name}`:map<string,struct<{values}>>>")
    return spark.read.text(path, wholetext=True).select(F.explode(parsed[name]).alias("key", "v")).select("key", "v.*")


def write_matrix(pairs: DataFrame, path: str) -> None:
    """A symmetric matrix as rows (w1, w2, ...) with w1 <> w2, both halves; the diagonal is undefined and has no rows."""
    other = pairs.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), *[c for c in pairs.columns if c not in ("w1", "w2")])
    pairs.unionByName(other).write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str, words: Sequence[str], value: str) -> DataFrame:
    """A row per word of ``words`` and a column for each; null on the diagonal and where no pair was written."""
    rows = spark.read.parquet(path).where(F.col("w1").isin(*words) & F.col("w2").isin(*words))
    return rows.groupBy("w1").pivot("w2", list(words)).agg(F.first(value))


# Atom


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """The entries of Atom feeds as records; the id is the tail of the entry's."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path)
    terms = F.transform("category", lambda c: c["_term"])
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.select(F.element_at(F.split("id", "/"), -1).alias("id"), "published", F.get(terms, 0).alias("primary_category"), terms.alias("categories"), tidy("title").alias("title"), tidy("summary").alias("abstract"))


def atom_total(spark: SparkSession, path: str) -> DataFrame:
    """path and total: how many results each feed says there are."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.regexp_extract("value", r"<(?:\w+:)?totalResults[^>]*>\s*(\d+)", 1).try_cast("bigint").alias("total"))


# Archives


def text_of(data: bytes) -> str:
    """Decoded bytes; empty if more than 2 % of the first 4,000 characters are control characters."""
    text = data.decode("utf-8", "ignore")
    head = text[:4000]
    odd = sum(ord(c) < 9 or 13 < ord(c) < 32 for c in head)
    return "" if odd > 0.02 * len(head) else text


def _members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Names and bytes of the authored files of a tar archive, compressed or not; a damaged member is passed over."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as archive:
        for m in archive.getmembers():
            if m.isfile() and m.name.lower().endswith(AUTHORED):
                try:
                    yield m.name, archive.extractfile(m).read()
                except (tarfile.TarError, OSError, EOFError, zlib.error):
                    continue


def extract(data: bytes) -> tuple[str, int]:
    """The authored text of an archive and its number of .tex files: tar of any compression, else gzip (one file), else raw (none)."""
    try:
        found = [(name, text) for name, body in _members(data) if (text := text_of(body))]
        return "\n".join(t for _, t in found), sum(name.lower().endswith(".tex") for name, _ in found)
    except (tarfile.TarError, OSError, EOFError, zlib.error):
        pass
    try:
        return text_of(gzip.decompress(data)), 1
    except (OSError, EOFError, zlib.error):
        return text_of(data), 0


def unpack(rows: DataFrame, content: str = "content", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with text and n_tex instead of ``content``, bytes, skipped_large (null text, nothing read) and has_source."""
    kept = [c for c in rows.columns if c != content]
    sized = rows.withColumn("bytes", F.octet_length(content).cast("bigint"))
    sized = sized.withColumn("skipped_large", F.coalesce(F.col("bytes") > most_bytes, F.lit(False)))
    sized = sized.select(*kept, "bytes", "skipped_large", F.when(~F.col("skipped_large"), F.col(content)).alias(content))
    schema = sized.drop(content).withColumns({"text": F.lit(None).cast("string"), "n_tex": F.lit(None).cast("int")}).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a text at a time
                row = batch.slice(k, 1)
                data = row.column(row.num_columns - 1)[0].as_py()
                text, n = extract(data) if data is not None else (None, 0)
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([text], pa.string()), pa.array([n], pa.int32())], names=schema.names)

    return sized.mapInArrow(read, schema).withColumn("has_source", has_source(F.col("n_tex"), F.col("text")))


def has_source(n_tex: Column, text: Column) -> Column:
    return (n_tex > 0) | (F.coalesce(F.length(text), F.lit(0)) > 200)


def read_archives(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, bytes, skipped_large, text, n_tex and has_source of the files; the content of larger ones is not read."""
    files = spark.read.format("binaryFile").load(path)
    small = unpack(files.where(F.col("length") <= most_bytes).select("path", "content"), most_bytes=most_bytes)
    large = files.where(F.col("length") > most_bytes).select("path", F.col("length").alias("bytes"), F.lit(True).alias("skipped_large"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("n_tex"), F.lit(False).alias("has_source"))
    return small.unionByName(large)


def done_months(spark: SparkSession, path: str) -> list[str]:
    """The months that a progress file (one JSON object) names as done; none if there is no file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return []
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    return sorted({f"{y}-{m:02d}" for r in rows for y, m in json.loads(r["value"])["done_months"]})
