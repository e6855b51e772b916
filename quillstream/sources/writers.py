"""Writing results: texts, JSON reports, samples and manifests.

``write_rows`` and ``write_reports`` are distributed writes of rows. A file a sample is what calibration folders are
made of; such corpora are some hundred samples, so ``write_texts`` and the manifest go through the driver, with a
bound that is checked.
"""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file a sample, and a manifest, are for calibration corpora; more rows than this are written by ``write_rows``.
MOST_FILES = 100_000


def write_rows(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are tasks: texts of any number of documents."""
    rows.write.mode("overwrite").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON object a line, with null keys."""
    reports.select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_texts(samples: DataFrame, folder: str) -> int:
    """``<id>.txt`` for each sample (id, text), with a trailing newline that is no part of its digest."""
    if samples.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} samples: write them as rows")
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for r in samples.toLocalIterator():
        (Path(folder) / f"{r['id']}.txt").write_text(r["text"] + "\n", encoding="utf-8")
        n += 1
    return n


def write_manifest_rows(rows: list[dict], path: str, append: bool = False) -> None:
    """A JSON array of rows in their order; with ``append`` new ids replace old ones and all come in order of id."""
    file = Path(path)
    if append and file.exists():
        new = {r["id"] for r in rows}
        rows = sorted([r for r in json.loads(file.read_text(encoding="utf-8")) if r["id"] not in new] + rows, key=lambda r: r["id"])
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(rows, indent=2, ensure_ascii=False), encoding="utf-8")


def write_manifest(new: DataFrame, path: str, append: bool = False) -> None:
    """The rows of a table, in its order, as a manifest."""
    if new.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} rows: write them as rows")
    write_manifest_rows([r.asDict(recursive=True) for r in new.collect()], path, append)


def write_docx(blocks: list[tuple[str, str]], path: str) -> None:
    """A Word file of (style name, text) paragraphs: the least that readers of such files accept."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    ids = {name: name.replace(" ", "") for name, _ in blocks}
    kinds = "".join(f'<Override PartName="/word/{part}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{kind}+xml"/>' for part, kind in (("document", "document.main"), ("styles", "styles")))
    relation = '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
    relations = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{escape(i)}"><w:name w:val="{escape(n)}"/></w:style>' for n, i in ids.items())
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{escape(ids[s])}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for s, t in blocks)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}</Types>',
        "_rels/.rels": relations.format(relation.format("officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": relations.format(relation.format("styles", "styles.xml")),
        "word/styles.xml": f'<w:styles xmlns:w="{space}">{styles}</w:styles>',
        "word/document.xml": f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
