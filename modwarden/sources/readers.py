"""Inputs: tables, labelled CSV, severity lists, thread corpora, pages, images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden import fixed_values as fv
from modwarden.functions import text as tx
from modwarden.operators.lexicon import severity_tier
from modwarden.profiles import OcrPolicy


INPUT_PARTITIONS = "spark.modwarden.inputPartitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Small benchmark files hold one row group, which is one task; a bench may set
    ``spark.modwarden.inputPartitions`` to share them out. It is unset everywhere else, whatever the size."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def read_labelled_csv(
    spark: SparkSession, paths: str | Sequence[str], schema: str = "text string, label int, lang string", multi_line: bool = True
) -> DataFrame:
    """Header CSV splits; rows without text or label are dropped.

    Texts may hold line breaks, and then a file is one task: keep files at split size, or pass
    ``multi_line=False`` for files whose texts have none, which Spark splits.
    """
    names = [f.split()[0] for f in schema.split(",")]
    df = spark.read.csv(
        paths, header=True, schema=schema, multiLine=multi_line, quote='"', escape='"', enforceSchema=False
    )
    return df.na.drop(subset=[n for n in ("text", "label", "labels") if n in names])


def read_severity_lexicon(spark: SparkSession, path: str, lang: str = "other", encoding: str = "ISO-8859-1") -> DataFrame:
    """Headerless ``term,gloss,severity``; unreadable severities are skipped, one row per term and tier."""
    raw = spark.read.csv(path, schema="term string, gloss string, severity string", encoding=encoding)
    sev = F.regexp_extract(F.trim("severity"), r"^[+-]?\d+", 0).try_cast("int")
    df = raw.select(F.lower(F.trim("term")).alias("term"), sev.alias("severity"))
    return (
        df.filter(F.col("severity").isNotNull() & (F.col("term") != ""))
        .withColumn("tier", severity_tier("severity"))
        .groupBy("term", "tier")
        .agg(F.max("severity").alias("severity"))
        .select("term", F.lit("token").alias("kind"), F.lit(lang).alias("lang"), "severity", "tier")
    )


THREAD_SCHEMA = "tweet_id string, tweet string, comments array<struct<tweet_id:string,tweet:string>>"


def thread_posts(threads: DataFrame) -> DataFrame:
    """Root and every comment of each thread as one row, in thread order."""
    root = F.array(F.struct("tweet_id", "tweet"))
    comments = F.coalesce("comments", F.array().cast("array<struct<tweet_id:string,tweet:string>>"))
    keep = [c for c in threads.columns if c not in ("tweet_id", "tweet", "comments")]
    return threads.select(*keep, F.posexplode(F.concat(root, comments)).alias("pos", "p")).select(
        *keep, "pos", F.col("p.tweet_id").alias("id"), F.coalesce("p.tweet", F.lit("")).alias("text")
    )


def attach_thread_labels(posts: DataFrame, labels: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Labelled posts only; of an id that occurs more than once the first is kept.

    ``labels`` has one row per id: ``(<on>, id, mark)`` with mark HOF or another word.
    """
    matched = posts.join(labels, [*on, "id"]).withColumn("label", binarize_mark("mark"))
    cols = [c for c in matched.columns if c != "mark"]
    first = matched.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return first.select(*[F.col("_r")[c].alias(c) for c in cols])


def binarize_mark(mark: Column | str) -> Column:
    return F.when(tx._col(mark) == "HOF", 1).otherwise(0)


def read_thread_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``<archive>/data/<split>/<topic>/<thread>/{data,labels}.json`` to labelled rows.

    Unreadable files give null columns and fall out at the joins.
    """
    where = r"/data/([^/]+)/([^/]+)/([^/]+)/[^/]+$"

    def placed(df: DataFrame) -> DataFrame:
        path = F.col("_metadata.file_path")
        return df.withColumn("thread", F.regexp_extract(path, r"^(.*)/[^/]+$", 1)).withColumn(
            "split", F.regexp_extract(path, where, 1)
        ).withColumn("topic", F.regexp_extract(path, where, 2))

    def read(name: str) -> DataFrame:
        return spark.read.text(f"{root}/*/data/*/*/*/{name}.json", wholetext=True)

    threads = placed(read("data")).select(
        "thread", "split", "topic", F.from_json("value", THREAD_SCHEMA, {"mode": "PERMISSIVE"}).alias("d")
    )
    marks = placed(read("labels")).select("thread", F.from_json("value", "map<string,string>").alias("m"))
    posts = thread_posts(threads.filter("d.tweet_id is not null").select("thread", "split", "topic", "d.*"))
    labels = marks.select("thread", F.explode("m").alias("id", "mark"))
    return attach_thread_labels(posts, labels, ["thread"], ["thread", "pos"]).select(
        "id", "text", "label", "topic", "split"
    )


def read_eval_set(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested ``{sentences:[{text,label}]}`` to rows in their order.

    A set in one nested file is one record and one task. A set written in ranges (``sinks.write_eval_set``) has a record a
    line, each with the ``offset`` of its first sentence; with ``multi_line=False`` such files are read by many tasks.
    """
    df = spark.read.json(path, multiLine=multi_line, schema="offset bigint, sentences array<struct<text:string,label:int>>")
    rows = df.select(F.coalesce("offset", F.lit(0)).alias("at"), F.posexplode("sentences").alias("i", "s"))
    return rows.select((F.col("at") + F.col("i")).alias("ix"), "s.text", "s.label")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def sniff_format(content: Column | str) -> Column:
    """Image format from the first bytes."""
    head = F.hex(F.substring(tx._col(content), 1, 16))
    return (
        F.when(head.startswith("89504E47"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("474946"), "gif")
        .when(head.startswith("424D"), "bmp")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )


def validate_image(content: Column | str, length: Column | str, mime: Column | None = None, policy: OcrPolicy = OcrPolicy()) -> Column:
    """``struct<format,reason>``: the format of usable bytes, or why they are refused."""
    size, fmt = tx._col(length), sniff_format(content)
    mime = F.lit("") if mime is None else F.coalesce(mime, F.lit(""))
    wrong_mime = (mime != "") & ~mime.startswith("image/") & ~mime.contains("octet-stream")
    reason = (
        F.when(size.isNull(), "no-blob")
        .when(size == 0, "empty-blob (0 bytes)")
        .when(size > policy.max_bytes, F.concat(F.lit("too-large ("), size.cast("string"), F.lit(f" > {policy.max_bytes})")))
        .when(wrong_mime, F.concat(F.lit("non-image MIME: "), mime))
        .when(fmt.isNull(), "unrecognised-image-bytes")
    )
    return F.struct(F.when(reason.isNull(), fmt).alias("format"), reason.alias("reason"))


def read_images_validated(spark: SparkSession, path: str, policy: OcrPolicy = OcrPolicy()) -> DataFrame:
    """Binary image files with format or refusal reason.

    Spark's file scan leaves files of no bytes out, so those show as missing paths; blobs held in a
    table get their reason from :func:`validate_image`.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", "length", "content", validate_image("content", "length", policy=policy).alias("v")).select(
        "path", "length", "content", "v.format", "v.reason"
    )


def feedback_columns(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fv.FEEDBACK_COLUMNS]
