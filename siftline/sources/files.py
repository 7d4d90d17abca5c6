"""Scans of text, JSON, XML, archives and catalogue files."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import any_of

FORMATS = ("txt", "json", "jsonl", "parquet", "xml", "csv", "tsv")


def extension(path: str) -> str:
    """The format that a file's name tells; an error if it is none of ours."""
    kind = path.removesuffix(".gz").rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ValueError(f"{path}: not one of {', '.join(FORMATS)}")
    return kind


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", terms: Sequence[str] = (), column: str = "text") -> DataFrame:
    """(file, value): lines of text files or values of a Parquet column, of which some term must be in each."""
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path).select(F.input_file_name().alias("file"), F.col(column).alias("value"))
    elif encoding.upper() == "UTF-8":
        rows = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    else:
        quiet = {"sep": "\u0001", "quote": "", "escape": "", "encoding": encoding, "header": "false"}
        rows = spark.read.options(**quiet).schema("value string").csv(path).select(F.input_file_name().alias("file"), "value")
    return rows.where(any_of(F.col("value"), terms)) if terms else rows


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): a document a file."""
    return spark.read.text(path, wholetext=True).select(file_stem(F.input_file_name()).alias("id"), F.col("value").alias("text"))


def read_line_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): a document a line, with stable numbers."""
    rows = spark.read.text(path, wholetext=True).select(file_stem(F.input_file_name()).alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)).alias("n", "text"))
    return rows.select(F.concat_ws("_", "file", "n").alias("id"), "text")


def read_json(spark: SparkSession, path: str, schema: str | None = None, by_line: bool | None = None) -> DataFrame:
    """Objects of JSON (one or an array) or JSONL files; lines that cannot be read are dropped."""
    by_line = path.rstrip("/*").removesuffix(".gz").endswith("jsonl") if by_line is None else by_line
    reader = spark.read.option("mode", "DROPMALFORMED").option("multiLine", not by_line)
    return (reader.schema(schema) if schema else reader).json(path)


def read_documents(spark: SparkSession, path: str, text: str = "text", key: str | None = None) -> DataFrame:
    """(id, text) from a JSON, JSONL or Parquet scan; without a key the text's SHA-256 is the id."""
    df = spark.read.parquet(path) if extension(path) == "parquet" else read_json(spark, path)
    if text not in df.columns:
        raise ValueError(f"{path} has no column {text}")
    name = F.col(key).cast("string") if key and key in df.columns else F.sha2(F.col(text), 256)
    return df.where(F.col(text).isNotNull()).select(name.alias("id"), F.col(text).alias("text"))


def read_xml_texts(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """(id, tag, text): every element with text of its own; the id is an attribute or the text's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                for _, e in ElementTree.iterparse(io.BytesIO(content)):
                    if e.text and e.text.strip():
                        rows.append((e.get(key), e.tag, e.text.strip()))
            yield pd.DataFrame(rows, columns=["id", "tag", "text"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id string, tag string, text string")
    return rows.withColumn("id", F.coalesce("id", F.sha2("text", 256)))


def read_directory(spark: SparkSession, folder: str, text: str = "text", key: str = "id") -> DataFrame:
    """(id, text) of all files of a folder, each by the reader of its ending."""
    from functools import reduce

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    kinds = {f.getPath().getName().rpartition(".")[2] for f in files}
    parts = []
    for kind in sorted(kinds):
        glob = f"{folder}/*.{kind}"
        if kind == "txt":
            parts.append(read_whole(spark, glob))
        elif kind in ("json", "jsonl", "parquet"):
            parts.append(read_documents(spark, glob, text, key))
        elif kind == "xml":
            parts.append(read_xml_texts(spark, glob, key).select("id", "text"))
    if not parts:
        return spark.createDataFrame([], "id string, text string")
    return reduce(DataFrame.unionByName, parts)


def list_files(spark: SparkSession, folder: str, ending: str = "*") -> DataFrame:
    """(path, length) of all files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", ending).load(folder).select("path", "length")


def read_tabular(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str | None = None) -> DataFrame:
    """csv (any separator), tsv or Parquet with a header, all columns as strings."""
    kind = extension(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.options(header="true", sep=sep or ("\t" if kind == "tsv" else ","), encoding=encoding, multiLine="true", escape='"').csv(path)


def read_archives(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, member, value): lines of the first member of zip and gz files; a line is held at a time beside the packed file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"]):
                if path_.endswith(".zip"):
                    packed = zipfile.ZipFile(io.BytesIO(content))
                    member = packed.namelist()[0]
                    stream = packed.open(member)
                else:
                    member, stream = path_.rpartition("/")[2].removesuffix(".gz"), gzip.open(io.BytesIO(content))
                held = []
                for line in io.TextIOWrapper(stream, encoding):
                    held.append((path_, member, line.rstrip("\n")))
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=["path", "member", "value"])
                        held = []
                yield pd.DataFrame(held, columns=["path", "member", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, value string")


def read_institutes(spark: SparkSession, glob: str, schema: str = "file string, pseudo_pagenum int, text string") -> DataFrame:
    """Pages of ``<institute>_texts.jsonl`` files with the institute from the name; bad lines are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(glob)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)_texts\.jsonl", 1).alias("institute"), "*")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract, pubdate_year, pubdate_month, mesh_ids, mesh_terms, pmc, language) of citation XML; rows without pmid, title or abstract are dropped."""
    raw = spark.read.text(path, wholetext=True, lineSep=None)
    articles = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<PubmedArticle[ >].*?</PubmedArticle>)"), F.lit(1))).alias("x"))
    squeeze = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    bare = F.regexp_replace("x", r"(?s)<CopyrightInformation>.*?</CopyrightInformation>", "")
    abstract = F.array_join(F.xpath(bare, F.lit("//Abstract//text()")), " ")
    title = F.array_join(F.xpath("x", F.lit("//ArticleTitle//text()")), " ")
    one = lambda p: F.nullif(F.xpath_string("x", F.lit(p)), F.lit(""))
    rows = articles.select(
        one("(//PMID)[1]").alias("pmid"), squeeze(title).alias("title"), squeeze(abstract).alias("abstract"), F.coalesce(one("//PubDate/Year"), F.lit("")).alias("pubdate_year"), F.coalesce(one("//PubDate/Month"), F.lit("")).alias("pubdate_month"),
        F.xpath("x", F.lit("//MeshHeadingList//@UI")).alias("mesh_ids"), F.xpath("x", F.lit("//MeshHeadingList//DescriptorName/text()")).alias("mesh_terms"), one("//ArticleId[@IdType='pmc']").alias("pmc"), one("//Language").alias("language"),
    )
    return rows.where("pmid IS NOT NULL AND title IS NOT NULL AND abstract IS NOT NULL")


def article_record(df: DataFrame, open_access: bool = True) -> DataFrame:
    """(text, meta): title and abstract with the rest as a struct; without ``open_access`` rows that have a full text elsewhere go."""
    rows = df if open_access else df.where(F.col("pmc").isNull())
    meta = F.struct("pmid", "language", "mesh_ids", "mesh_terms", "pubdate_year", "pubdate_month")
    return rows.select(F.concat_ws("\n", "title", "abstract").alias("text"), meta.alias("meta"))


def read_abstract_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value): abstract texts of files that hold many XML documents one after another."""
    whole = spark.read.text(path, wholetext=True)
    docs = whole.select(F.explode(F.split("value", r"<\?xml[^>]*\?>")).alias("x"))
    return docs.select(F.explode(F.regexp_extract_all("x", F.lit(r"(?s)<AbstractText[^>]*>(.*?)</AbstractText>"), F.lit(1))).alias("value"))


def body_paragraphs(text: Column, body: str = "body") -> Column:
    """Array of the <p> contents inside <body> elements."""
    bodies = F.regexp_extract_all(text, F.lit(f"(?s)<{body}(?:\\s[^>]*)?>(.*?)</{body}>"), F.lit(1))
    return F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))))


def keyword_records(df: DataFrame, keyword: str, column: str = "abstract") -> DataFrame:
    """Records whose abstract holds a keyword, whatever the case."""
    return df.where(F.contains(F.lower(column), F.lit(keyword.lower())))


def marker_documents(spark: SparkSession, path: str, split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lines of whole files with numbers, given to a splitter such as ``split_by_marker``."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("pos", "text"))
    return split(rows)


def repair_xml(text: Column) -> Column:
    from ..functions import rules as R
    from ..functions.text import fold

    prolog, doctype, ends, angle = R.XML_ENVELOPE
    return fold(F.concat(F.lit("<xml>"), F.trim(fold(text, [prolog, doctype])), F.lit("</xml>")), [ends, angle])


def safe_stem(name: str) -> str:
    return re.sub("[^A-Za-z0-9]", "", name)[:20]
