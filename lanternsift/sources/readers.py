"""Readers and writers: manifests, documents of several kinds, CSV, JSON lines; pruning and pushdown are Spark's."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATHS = ("text_path", "path", "file", "doc_path", "zip_path")
OFFICE = ("docx", "pptx", "xlsx")
MARKUP = ("htm", "html", "xhtml", "xml")
PLAIN = ("csv", "json", "jsonl", "log", "md", "text", "tsv", "txt", "yaml", "yml")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def dataset_dirs(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders of a root, in order."""
    fs, where = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())


def resolve_dataset(spark: SparkSession, root: str, name: str) -> str:
    """The one folder whose name has the stem of name, whatever sizes it carries; none or several are an error."""
    from lanternsift.operators.crosswalk import canonical_stem

    rows = spark.createDataFrame([(n, n == name) for n in [*dataset_dirs(spark, root), name]], "folder string, asked boolean")
    found = rows.select("folder", canonical_stem(F.col("folder")).alias("stem")).collect()
    stem = found[-1]["stem"]
    hits = [r["folder"] for r in found[:-1] if r["stem"] == stem]
    if len(hits) != 1:
        raise (FileNotFoundError if not hits else ValueError)(f"{len(hits)} folders of {root} have the stem {stem!r}: {hits}")
    return f"{root}/{hits[0]}"


def parquet_split(spark: SparkSession, folder: str, split: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """The files of one split; only the named columns are read."""
    rows = spark.read.parquet(f"{folder}/{split}-*.parquet").select(*columns)
    return rows if limit is None else rows.limit(limit)


def slice_of(rows: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows with start <= key < stop: stable, and pushed into the scan."""
    return rows.where((F.col(key) >= start) & (F.col(key) < stop))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a bad line is an error that names its file and the number of its first bad line.

    Lines are read in parallel; only where one is bad is its file counted through.
    """
    raw = spark.read.text(path).select("value", F.input_file_name().alias("_file"))
    parsed = raw.where(F.trim("value") != "").select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "_file", "value")
    first = parsed.where("r._bad IS NOT NULL").select("_file", "value").first()
    if first:
        lines = spark.read.text(first["_file"], wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
        at = lines.where(F.rtrim(F.replace("line", F.lit("\r"))) == first["value"].rstrip()).agg(F.min("n")).first()[0]
        raise ValueError(f"{first['_file']}:{(at or 0) + 1}: not a JSON object of the schema")
    return parsed.select("r.*").drop("_bad")


def manifest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """labels.jsonl if there is one, else manifest.json as a list or as an object with rows."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/labels.jsonl")):
        return json_lines(spark, f"{folder}/labels.jsonl", schema)
    whole = spark.read.text(f"{folder}/manifest.json", wholetext=True)
    item = "struct<" + ",".join(":".join(field.split(None, 1)) for field in schema.split(",")) + ">"
    # An object read as an array would be a row of NULLs, so the first character decides.
    rows = F.from_json("value", f"struct<rows:array<{item}>>")["rows"]
    as_list = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(rows)
    return whole.select(F.explode(as_list).alias("r")).select("r.*")


def document_path(columns: tuple[str, ...] = PATHS) -> Column:
    """The first path that isn't blank; NULL if it is absolute or leaves its folder."""
    first = F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))
    return F.when(~first.rlike(r"^(?:/|\\|[A-Za-z]:)|(?:^|[/\\])[.][.](?:[/\\]|$)"), first)


def surname_shares(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Latin-1 table, as it is or zipped, in which a withheld share is (S) and counts as zero."""
    options = {"header": True, "encoding": "ISO-8859-1", "nullValue": "(S)", "schema": schema}
    if not path.endswith(".zip"):
        return spark.read.csv(path, **options).na.fill(0.0)

    @F.udf("array<string>")
    def lines(content):  # one small archive, read once
        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
            name = next(n for n in sorted(z.namelist()) if n.lower().endswith(".csv"))
            return z.read(name).decode("latin-1").splitlines()

    rows = spark.read.format("binaryFile").load(path).select(F.explode(lines("content")).alias("value"))
    head = rows.first()["value"]
    parsed = rows.where(F.col("value") != head).select(F.from_csv("value", schema, {"nullValue": "(S)"}).alias("r")).select("r.*")
    return parsed.na.fill(0.0)


def clean_manifest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the other columns of a manifest of documents that hold nothing, as strings."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if "doc_id" not in rows.columns:
        raise ValueError(f"{path} has no doc_id")
    return rows


def tag_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """name, vertical and tag of a catalogue in CSV; names are slugged, blank ones are left out."""
    from lanternsift.operators.corpus import tag_slug

    rows = spark.read.csv(path, header=True, schema="name string, vertical string")
    return rows.where(F.trim("name") != "").select("name", F.lower(F.trim("vertical")).alias("vertical"), tag_slug(F.col("name"), F.lower(F.trim("vertical"))).alias("tag"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files; bytes that aren't UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("string")
    def decoded(content):
        return content.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return raw.select("path", decoded("content").alias("text"))


def strip_tags(html: Column, window: int | None = None) -> Column:
    """Tags to blanks, common entities to characters, white space to single blanks, trimmed and cut."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return text if window is None else F.left(text, F.lit(window))


def _office(content: bytes, most: int = 1 << 28) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = sorted(n for n in z.namelist() if n.endswith(".xml"))
        if sum(z.getinfo(n).file_size for n in parts) > most:
            raise ValueError("the archive unpacks to too much")
        return " ".join(re.sub("<[^>]+>", " ", z.read(n).decode("utf-8", "replace")) for n in parts)


def _strings(content: bytes, least: int = 4) -> str:
    """Runs of printable ASCII, for files of no known kind."""
    return " ".join(m.decode() for m in re.findall(rb"[\x20-\x7e\t]{%d,}" % least, content))


def _pdf(content: bytes) -> str:
    """Text operators of a PDF's streams; fonts that map characters elsewhere are beyond it."""
    import zlib

    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF")
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.DOTALL):
        try:
            body = zlib.decompress(m[1])
        except zlib.error:
            body = m[1]
        for part in re.findall(rb"\[((?:\((?:\\.|[^\\)])*\)|[^\]()])*)\]\s*TJ|(\((?:\\.|[^\\)])*\))\s*(?:Tj|'|\")", body):
            text = b"".join(re.findall(rb"\(((?:\\.|[^\\)])*)\)", part[0] or part[1]))
            out.append(re.sub(rb"\\([()\\])", rb"\1", text).decode("latin-1"))
    return " ".join(out)


def documents(spark: SparkSession, path: str, window: int | None = None) -> DataFrame:
    """path, kind, text, error of markup, office, PDF, plain and other files; one that can't be read has an error, not a text."""
    raw = spark.read.format("binaryFile").load(path).withColumn("kind", F.lower(F.substring_index("path", ".", -1)))

    @F.pandas_udf("struct<text:string,error:string>")
    def read(content, kind):
        import pandas as pd

        out = []
        for b, k in zip(content, kind):
            try:
                b = bytes(b)
                plain = k in MARKUP or k in PLAIN
                out.append((_office(b) if k in OFFICE else _pdf(b) if k == "pdf" else b.decode("utf-8", "replace") if plain else _strings(b), None))
            except (ValueError, KeyError, zipfile.BadZipFile) as e:
                out.append((None, type(e).__name__))
        return pd.DataFrame(out, columns=["text", "error"])

    got = raw.withColumn("r", read("content", "kind"))
    return got.select("path", "kind", F.when(F.col("kind").isin(*MARKUP, *OFFICE, "pdf"), strip_tags(F.col("r.text"), window)).otherwise(F.col("r.text")).alias("text"), "r.error")


def parse_spans(text: Column) -> Column:
    """A list of spans written as JSON or as a Python literal."""
    kind = "array<struct<start:int,end:int,text:string,label:string>>"
    return F.coalesce(F.from_json(text, kind, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}), F.array().cast(kind))


def marked(text: Column) -> tuple[Column, Column]:
    """Plain text and gold spans of [[TYPE:content]] markup."""
    from lanternsift.functions.spans import matches

    mark = r"(?s)\[\[[0-9A-Z_]+:.*?\]\]"
    plain = F.regexp_replace(text, r"(?s)\[\[[0-9A-Z_]+:(.*?)\]\]", "$1")
    kind = "struct<cut:int,out:array<struct<type:string,start:int,end:int,text:string>>>"
    start = F.struct(F.lit(0).alias("cut"), F.array().cast("array<struct<type:string,start:int,end:int,text:string>>").alias("out")).cast(kind)

    def step(acc: Column, m: Column) -> Column:
        name = F.regexp_extract(m["hit"], "^..([0-9A-Z_]+):", 1)
        body = F.substring(m["hit"], F.length(name) + 4, F.length(m["hit"]) - F.length(name) - 5)
        at = m["start"] - acc["cut"]
        one = F.struct(name.alias("type"), at.alias("start"), (at + F.length(body)).alias("end"), body.alias("text"))
        return F.struct((acc["cut"] + F.length(name) + 5).alias("cut"), F.concat(acc["out"], F.array(one)).alias("out"))

    return plain, F.aggregate(matches(text, mark), start, step, lambda a: a["out"])


def verify_package(files: DataFrame, manifest_: DataFrame) -> DataFrame:
    """file, state for every file that differs from its manifest row: missing, extra, size or digest."""
    have = files.select(F.substring_index("path", "/", -1).alias("file"), F.length("content").cast("bigint").alias("n"), F.sha2("content", 256).alias("d"))
    both = have.join(manifest_, "file", "full_outer")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("bytes").isNull(), "extra").when(F.col("n") != F.col("bytes"), "size").when(F.col("d") != F.col("sha256"), "digest")
    return both.select("file", state.alias("state")).where("state IS NOT NULL")


def feature_cache(spark: SparkSession, folder: str, corpora: list[str] | None = None) -> DataFrame:
    """Cached features of all corpora of a folder partitioned by corpus, or of some: the others' files aren't read."""
    rows = spark.read.parquet(folder)
    return rows if corpora is None else rows.where(F.col("corpus").isin(*corpora))


def write_feature_cache(features: DataFrame, folder: str) -> None:
    """Features (with a column corpus) as one partition a corpus."""
    features.write.mode("overwrite").partitionBy("corpus").parquet(folder)


def weights_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A saved tagger by its format: its tables by name. linear: weights, thresholds; bag: embeddings, head, thresholds;
    cascade: gate, weights, thresholds; fusion: strategies, thresholds. A format that isn't known is an error."""
    parts = {"linear": ("weights", "thresholds"), "bag": ("embeddings", "head", "thresholds"), "cascade": ("gate", "weights", "thresholds"), "fusion": ("strategies", "thresholds")}
    kind = spark.read.json(f"{folder}/format.json").first()["format"]
    if kind not in parts:
        raise ValueError(f"{folder} has the format {kind!r}; known are {sorted(parts)}")
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in parts[kind]}


def save_model(spark: SparkSession, folder: str, kind: str, tables: dict[str, DataFrame]) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    spark.createDataFrame([(kind,)], "format string").coalesce(1).write.mode("overwrite").json(f"{folder}/format.json")


def runs_of(spark: SparkSession, path: str) -> DataFrame:
    """One row a metric of a store of runs in JSON lines (run, params, metrics as maps); a file cut by a crash loses its last line only."""
    raw = spark.read.text(path).select(F.from_json("value", "run string, params map<string,string>, metrics map<string,double>").alias("r")).where("r.run IS NOT NULL")
    return raw.select("r.run", "r.params", F.explode("r.metrics").alias("metric", "value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
