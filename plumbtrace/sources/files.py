"""Readers. Every reader returns plain columns with trimmed names and typed values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

INDEX_PREFIX = "Unnamed"

ATTRIBUTION_SCHEMA = T.StructType([
    T.StructField("sample_index", T.LongType()),
    T.StructField("base_value", T.DoubleType()),
    T.StructField("feature_values", T.MapType(T.StringType(), T.StringType())),
    T.StructField("shap_values", T.ArrayType(T.DoubleType())),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("prediction", T.DoubleType()),
    T.StructField("true_label", T.DoubleType()),
    T.StructField("feature_importance", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()),
        T.StructField("shap_value", T.DoubleType()),
        T.StructField("feature_value", T.StringType()),
    ]))),
    T.StructField("predicted_class_name", T.StringType()),
    T.StructField("true_class_name", T.StringType()),
    T.StructField("prediction_correct", T.BooleanType()),
    T.StructField("prediction_status", T.StringType()),
])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred by one extra pass."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return normalise_headers(reader.csv(path))


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trim blanks around column names."""
    names = [c.strip() for c in df.columns]
    return df if names == df.columns else df.toDF(*names)


def drop_index_columns(df: DataFrame, prefix: str = INDEX_PREFIX) -> DataFrame:
    """Remove row-number columns left by earlier exports."""
    return df.select([F.col(f"`{c}`") for c in df.columns if not c.strip().startswith(prefix)])


def scan_json_records(spark: SparkSession, path: str, record: T.StructType, wrapper: str = "judgments") -> DataFrame:
    """JSON files holding a list of records, or an object with the list under `wrapper`."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = T.StructType([T.StructField(wrapper, T.ArrayType(record))])
    text = F.ltrim(F.col("value"))
    rows = F.when(text.startswith("["), F.from_json(text, T.ArrayType(record))).otherwise(
        F.from_json(text, wrapped)[wrapper]
    )
    return raw.select(F.inline(rows))


def scan_json_array(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Large JSON arrays: Spark streams the array elements, no whole file in one string."""
    return spark.read.schema(record).option("multiLine", True).json(path)


def scan_lenient_json(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """A JSON array, or objects joined by commas without the brackets."""
    raw = spark.read.text(path, wholetext=True)
    text = F.trim(F.col("value"))
    trimmed = F.regexp_replace(text, r",\s*$", "")
    array = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), trimmed, F.lit("]")))
    return raw.select(F.inline(F.from_json(array, T.ArrayType(record))))


def scan_attribution_documents(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Attribution documents, one row per (document, feature), in importance order."""
    docs = spark.read.schema(ATTRIBUTION_SCHEMA).option("multiLine", multiline).json(path)
    return attribution_rows(docs.withColumn("document", F.input_file_name()))


def attribution_rows(docs: DataFrame) -> DataFrame:
    """Long table: document header repeated next to (rank, feature, attribution, value)."""
    exploded = docs.select(
        *[c for c in docs.columns if c in ("document", "sample_index", "base_value", "prediction", "true_label")],
        F.posexplode("feature_importance").alias("pos", "item"),
    )
    return exploded.select(
        *[c for c in exploded.columns if c not in ("pos", "item")],
        (F.col("pos") + 1).alias("rank"),
        F.col("item.feature").alias("feature"),
        F.col("item.shap_value").alias("attribution"),
        # booleans stand next to numbers in these documents
        F.when(F.col("item.feature_value") == "true", 1.0)
        .when(F.col("item.feature_value") == "false", 0.0)
        .otherwise(F.col("item.feature_value").try_cast("double")).alias("feature_value"),
    )


# Layout of the surrogate text documents.
SURROGATE_HEADER = r"LIME Explanation for Sample (\d+)"
SURROGATE_PREDICTION = r"(?m)^Prediction: (.*)$"
SURROGATE_TRUTH = r"(?m)^True Label: (.*)$"
SURROGATE_RULE = r"(?m)^\s*(\d+)\. (.+): (-?\d+\.\d+)\s*$"


def parse_surrogate_documents(docs: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Surrogate texts, one row per ranked rule, with the rule cut into its parts."""
    t = F.col(text)
    numbered = F.arrays_zip(
        F.regexp_extract_all(t, F.lit(SURROGATE_RULE), 1).alias("rank"),
        F.regexp_extract_all(t, F.lit(SURROGATE_RULE), 2).alias("rule"),
        F.regexp_extract_all(t, F.lit(SURROGATE_RULE), 3).alias("weight"),
    )
    rows = docs.select(
        *keep,
        F.regexp_extract(t, SURROGATE_HEADER, 1).cast("long").alias("sample_id"),
        F.trim(F.regexp_extract(t, SURROGATE_PREDICTION, 1)).alias("prediction"),
        F.trim(F.regexp_extract(t, SURROGATE_TRUTH, 1)).alias("true_label"),
        F.explode(numbered).alias("r"),
    )
    rows = rows.select(
        *keep, "sample_id", "prediction", "true_label",
        F.col("r.rank").cast("int").alias("rank"),
        F.col("r.rule").alias("rule"),
        F.col("r.weight").cast("double").alias("weight"),
    )
    return split_rules(rows, "rule")


NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
RULE_BETWEEN = rf"^({NUMBER}) < (.+) <= ({NUMBER})$"
RULE_ONE_SIDED = rf"^(.+) (<=|>=|<|>|=) ({NUMBER})$"


def split_rules(df: DataFrame, rule: str) -> DataFrame:
    """Add feature, op, lower and upper for `a > v`, `a <= v` and `lo < a <= hi`."""
    r = F.col(rule)
    between = r.rlike(RULE_BETWEEN)
    bound = F.regexp_extract(r, RULE_ONE_SIDED, 3)
    op = F.regexp_extract(r, RULE_ONE_SIDED, 2)

    def number(c: Column) -> Column:
        return F.when(c != "", c).cast("double")

    return df.select(
        "*",
        F.when(between, F.regexp_extract(r, RULE_BETWEEN, 2))
        .otherwise(F.regexp_extract(r, RULE_ONE_SIDED, 1)).alias("feature"),
        F.when(between, F.lit("between")).otherwise(op).alias("op"),
        F.when(between, number(F.regexp_extract(r, RULE_BETWEEN, 1)))
        .when(op.isin(">", ">=", "="), number(bound)).alias("lower"),
        F.when(between, number(F.regexp_extract(r, RULE_BETWEEN, 3)))
        .when(op.isin("<", "<=", "="), number(bound)).alias("upper"),
    )


def scan_surrogate_documents(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).withColumn("document", F.input_file_name())
    return parse_surrogate_documents(docs, keep=("document",))


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text file: path and whole text."""
    docs = spark.read.text(folder, wholetext=True)
    return docs.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


QUERY_SCHEMA = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("id", "category", "sample_id", "xai_file", "query", "ground_truth")
])


def scan_query_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_SCHEMA).option("multiLine", True).json(path)


def scan_relevance(spark: SparkSession, path: str) -> DataFrame:
    """{query: [chunk, ...]} to one row per judgement; an empty list keeps one null row."""
    raw = spark.read.text(path, wholetext=True)
    lists = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    pairs = raw.select(F.explode(lists).alias("query_id", "chunks"))
    return pairs.select("query_id", F.explode_outer("chunks").alias("chunk_id"))


# Which artifact kind a file name stands for, and which extension wins.
ARTIFACT_EXTENSIONS = ("txt", "md", "json")


def latest_artifacts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Pick one file per (model, artifact): text before markdown before JSON.

    Paths follow <dataset>/<task>/<model>/<artifact>.<extension>.
    """
    p = F.col(path)
    pattern = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)\.([a-z]+)$"
    priority = F.array_position(F.array(*[F.lit(e) for e in ARTIFACT_EXTENSIONS]), F.regexp_extract(p, pattern, 5))
    tagged = files.select(
        F.regexp_extract(p, pattern, 1).alias("dataset"),
        F.regexp_extract(p, pattern, 2).alias("task"),
        F.regexp_extract(p, pattern, 3).alias("model"),
        F.regexp_extract(p, pattern, 4).alias("artifact"),
        F.struct(priority.alias("priority"), F.regexp_extract(p, pattern, 5).alias("extension")).alias("choice"),
        F.col(content).alias("content"),
    ).filter("choice.priority > 0")
    return tagged.groupBy("dataset", "task", "model", "artifact").agg(
        F.min("choice.priority").alias("priority"),
        F.min_by("choice.extension", "choice").alias("extension"),
        F.min_by("content", "choice").alias("content"),
    ).drop("priority")


#: Files of more bytes are not read as one value.
WHOLE_FILE = 64 << 20
#: Bytes of a piece of a large file.
PIECE = 1 << 20
MARK = b"\xef\xbb\xbf"


def input_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every input file.

    A file of up to `WHOLE_FILE` bytes is hashed where it is read. A larger one is read in splits as lines that end in a line feed,
    whatever their bytes, packed to pieces, and hashed piece by piece in file order by one task, as the digest demands; a value
    holds a piece, or a line if that is longer. Where lines and file don't have the same size, the query fails.
    Files that Spark would unpack because of their name's ending are read whole at any size.
    """
    def whole(files: DataFrame) -> DataFrame:
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))

    reader, large = spark.read.format("binaryFile"), F.col("length") > WHOLE_FILE
    found = reader.load(path).select("path", "length", "_metadata.file_path", F.col("path").rlike(PACKED).alias("packed")).where(large).collect()
    named, packed = [r for r in found if not r["packed"]], [r["path"] for r in found if r["packed"]]
    if not named:
        return whole(reader.load(path))
    # a plain bound on the length keeps the reader from opening larger files
    small = whole(reader.load(path).where(~large))
    if packed:
        small = small.unionByName(whole(reader.load(packed)))
    lines = spark.read.option("lineSep", "\n").text([r["path"] for r in named]).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    dealt = lines.mapInArrow(_pieces, "file string, start long, number long, piece binary").repartition(len(named), "file").sortWithinPartitions("file", "start", "number")
    known = {r["file_path"]: (r["path"], r["length"]) for r in named}
    return small.unionByName(dealt.mapInArrow(lambda frames: _digests(frames, known), small.schema))


#: Endings that make Spark's line reader unpack a file.
PACKED = r"\.(?i:gz|bz2|deflate|lz4|snappy|zst|zstd)$"


def _pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their line feeds as pieces of some `PIECE` bytes, numbered inside each split."""
    at, number, held, size = None, 0, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [at[0]], "start": [at[1]], "number": [number], "piece": [b"".join(held)]}, schema=PIECES)

    for f in frames:
        for file, start, line in zip(f.column("file").to_pylist(), f.column("start").to_pylist(), f.column("line").to_pylist()):
            if at != (file, start):
                if held:
                    yield piece()
                at, number, held, size = (file, start), 0, [], 0
            held += line, b"\n"
            size += len(line) + 1
            if size >= PIECE:
                yield piece()
                number, held, size = number + 1, [], 0
    if held:
        yield piece()


PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("piece", pa.binary())])


def _digests(frames: Iterator[pa.RecordBatch], known: dict[str, tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """The digest of each file from its pieces in order."""
    file, digest, left, sizes = None, None, b"", 0

    def ended() -> pa.RecordBatch:
        path, length = known[file]
        # the last line of a file may lack the line feed, and the reader leaves out a mark at the file's start
        marked = length - sizes in (2, 3)
        whole = digest[1 if marked else 0]
        rest = length - sizes - (3 if marked else 0)
        if rest not in (0, -1):
            raise ValueError(f"{path}: {length} bytes, but lines of {sizes}")
        whole.update(left if rest == 0 else left[:-1])
        return pa.RecordBatch.from_pydict({"path": [path], "length": [length], "sha256": [whole.hexdigest()]})

    for f in frames:
        for name, piece in zip(f.column("file").to_pylist(), f.column("piece")):
            if name != file:
                if file is not None:
                    yield ended()
                file, digest, left, sizes = name, (hashlib.sha256(), hashlib.sha256(MARK)), b"", 0
            for d in digest:
                d.update(left)
            left = piece.as_py()
            sizes += len(left)
    if file is not None:
        yield ended()
