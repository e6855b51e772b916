"""Reading documents: folders of texts, Word files, scanned runs, JSON and HTML pages. Schemas are declared."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import zipfile
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """(style name, text) of each paragraph of the body, in order; tables are not entered."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names, default = {}, "Normal"
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                if style.get(f"{_W}type") == "paragraph" and name is not None:
                    said = name.get(f"{_W}val") or ""
                    names[style.get(f"{_W}styleId")] = said[:1].upper() + said[1:] if said.lower().startswith("heading") else said
                    if style.get(f"{_W}default") in ("1", "true"):
                        default = names[style.get(f"{_W}styleId")]
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        said = []
        for node in p.iter():
            if node.tag == f"{_W}t":
                said.append(node.text or "")
            elif node.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr") and node.tag != f"{_W}tabs":
                said.append("\t" if node.tag == f"{_W}tab" else "\n")
        out.append((names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else default, "".join(said)))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of Word files: (doc_id, block_idx, style, text). Files are read whole, one a row, by the executors."""

    def parse(frames):
        for frame in frames:
            rows = [(d, i, s, t) for d, c in zip(frame["path"], frame["content"], strict=True) for i, (s, t) in enumerate(docx_blocks(bytes(c)))]
            yield pd.DataFrame(rows, columns=["doc_id", "block_idx", "style", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, schemas.BLOCK)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of whole text files; doc_id is the file's name without its ending."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("text"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, text): the folder's ``*.txt`` that are not blank."""
    texts = read_texts(spark, f"{path.rstrip('/')}/*.txt").select(F.col("doc_id").alias("sample_id"), T.strip(F.col("text")).alias("text"))
    return texts.where("text != ''")


def essays_in(samples: DataFrame) -> DataFrame:
    return samples.select(T.group_of(F.col("sample_id")).alias("essay")).distinct().agg(F.count("*").alias("n_essays"))


def read_tsv(spark: SparkSession, path: str, page_break: str = "---PAGEBREAK---") -> DataFrame:
    """Scanned runs of tab-separated files; lines without five fields are dropped, break lines part pages."""
    return runs_of(read_texts(spark, path).withColumnRenamed("doc_id", "essay"), page_break)


def runs_of(texts: DataFrame, page_break: str = "---PAGEBREAK---") -> DataFrame:
    lines = texts.select("essay", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    upto = Window.partitionBy("essay").orderBy("pos")
    paged = lines.withColumn("page", F.sum((F.col("line") == page_break).cast("int")).over(upto).cast("int")).withColumn("f", F.split("line", "\t", -1)).where(F.size("f") == 5)
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    at = F.row_number().over(Window.partitionBy("essay", "page").orderBy("pos")) - 1
    return paged.select("essay", "page", at.alias("run_idx"), F.get("f", F.lit(0)).alias("text"), number(1).alias("x"), number(2).alias("y"), number(3).alias("w"), number(4).alias("conf"))


def text_layer(texts: DataFrame, min_words: int = 0) -> DataFrame:
    """(doc_id, para_idx, text): paragraphs of extracted text, parted by blank lines, on one line each."""
    each = texts.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n", -1)).alias("para_idx", "raw"))
    return each.select("doc_id", "para_idx", T.flat(F.col("raw")).alias("text")).where((F.col("text") != "") & (T.word_count(F.col("text")) >= min_words))


def read_pdf(spark: SparkSession, path: str, min_words: int = 0, tool: str = "pdftotext") -> DataFrame:
    """(doc_id, para_idx, text) of PDF files with a text layer, by the executors' ``tool``; no text, no rows."""

    def extract(frames):
        if shutil.which(tool) is None:
            raise RuntimeError(f"reading PDF files needs {tool} on the executors")
        for frame in frames:
            texts = [subprocess.run([tool, "-", "-"], input=bytes(c), capture_output=True, check=True).stdout.decode("utf-8", "replace") for c in frame["content"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts})

    name = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    files = spark.read.format("binaryFile").load(path).select(name.alias("doc_id"), "content")
    return text_layer(files.mapInPandas(extract, "doc_id string, text string"), min_words)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON array or object with a declared schema; keys that lack are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


class _Blocks(HTMLParser):
    """Text by block element: headings by level, everything else as Normal."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.style, self.text, self.hidden = "Normal", [], []

    def cut(self, style: str = "Normal"):
        said = " ".join("".join(self.text).split())
        if said:
            self.blocks.append((self.style, said))
        self.style, self.text = style, []

    def handle_starttag(self, tag, attrs):
        if tag in _UNSEEN:
            self.hidden.append(tag)
        elif tag == "br":
            self.text.append(" ")
        elif tag not in _WITHIN:
            self.cut(f"Heading {tag[1]}" if re.fullmatch("h[1-6]", tag) else "Normal")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        elif tag not in _WITHIN and tag != "br":
            self.cut()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


_UNSEEN = {"script", "style", "title", "template", "noscript"}
_WITHIN = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "em", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "u", "var", "wbr"}


def html_blocks(html: str | None, references: tuple[str, ...] | None = None) -> list[tuple[str, str]]:
    """(style, text) of a page's blocks, in order; character references resolved, scripts and comments left out.

    With ``references`` only those names, as ``&name;``, are resolved; all others stay as they are written.
    """
    html = html or ""
    if references is not None:
        html = re.sub(f"&(?!(?:{'|'.join(map(re.escape, references)) or '(?!)'});)", "&amp;", html)
    page = _Blocks()
    page.feed(html)
    page.close()
    page.cut()
    return page.blocks


#: Characters of blocks that a worker holds before it hands them on.
_HELD = 1 << 20


def page_blocks(pages: DataFrame, references: tuple[str, ...] | None = None) -> DataFrame:
    """Blocks of HTML pages (page_id, html): (doc_id, block_idx, style, text). Pages are parsed by the executors.

    ``references`` as for ``html_blocks``. Pages are taken one by one and blocks leave in small batches, so a worker
    holds one batch of pages as Spark sends it and little else.
    """

    said = pages.select(F.col("page_id").cast("string").alias("doc_id"), "html")
    return said.mapInArrow(lambda batches: _parsed(batches, references), schemas.BLOCK)


def _parsed(batches: Iterable[pa.RecordBatch], references: tuple[str, ...] | None) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for d, html in zip(batch.column(0), batch.column(1), strict=True):
            name = d.as_py()
            for i, (style, text) in enumerate(html_blocks(html.as_py(), references)):
                rows.append((name, i, style, text))
                held += len(text)
            if held >= _HELD or len(rows) >= _HELD >> 6:
                yield _block_batch(rows)
                rows, held = [], 0
    if rows:
        yield _block_batch(rows)


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.string()), ("block_idx", pa.int32()), ("style", pa.string()), ("text", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
