"""DOCX files as tables of paragraphs, table cells, drawings, footnotes and numbering.

Files are read with ``binaryFile`` and parsed one by one in Arrow batches; a broken file becomes a row with an
error.  Only what the parts hold is read: no layout is computed.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import headings

# Namespaces, and units of length in EMU.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
V = "{urn:schemas-microsoft-com:vml}"
VML_SHAPES = ("shape", "line", "roundrect", "rect", "oval")
VML_KINDS = {"arrow": (13, 14, 15, 16, 66, 67, 68, 69), "line": (32, 33, 34, 35, 36, 37, 75), "bracket": (76, 77, 87, 88)}
DXA, POINT = 635, 12_700
DEFAULT_ROW = 14 * POINT

PARAGRAPHS = "path string, ord int, text string, style string, outline int, bold boolean, size double, num_id int, ilvl int, error string"
CELLS = "path string, table int, row int, col int, text string, x bigint, y bigint, w bigint, h bigint"
DRAWINGS = "path string, drawing int, paragraph int, kind string, direction string, x bigint, y bigint, w bigint, h bigint"
FOOTNOTES = "path string, id int, text string"
LEVELS = "path string, num_id int, ilvl int, start int, format string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``content`` of the DOCX files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")


def part(content: bytes, name: str) -> ElementTree.Element | None:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def value(element: ElementTree.Element | None, name: str = "val") -> str | None:
    return None if element is None else element.get(W + name)


def number(text: str | None) -> int | None:
    return int(float(text)) if text not in (None, "") else None


def text_of(element: ElementTree.Element) -> str:
    marks = {W + "tab": "\t", W + "br": "\n"}
    return "".join(e.text or "" if e.tag == W + "t" else marks.get(e.tag, "") for e in element.iter())


def paragraphs_of(content: bytes) -> list[tuple]:
    """(ord, text, style, outline, bold, size, num_id, ilvl) of each paragraph."""
    out = []
    for i, p in enumerate(part(content, "word/document.xml").iter(W + "p")):
        properties = p.find(W + "pPr")
        get = lambda path: None if properties is None else properties.find("/".join(W + x for x in path.split("/")))  # noqa: B023, E731
        bold_chars = chars = 0
        sizes = []
        for r in p.iter(W + "r"):
            n, rp = len(text_of(r)), r.find(W + "rPr")
            chars += n
            b = None if rp is None else rp.find(W + "b")
            bold_chars += n * (b is not None and value(b) not in ("0", "false"))
            if rp is not None and (s := value(rp.find(W + "sz"))):
                sizes.append(float(s) / 2)
        out.append((i, text_of(p), value(get("pStyle")), number(value(get("outlineLvl"))), bool(chars) and bold_chars / chars > 0.5, max(sizes, default=None), number(value(get("numPr/numId"))), number(value(get("numPr/ilvl")))))
    return out


def cells_of(content: bytes) -> list[tuple]:
    """(table, row, col, text, x, y, w, h): boxes in EMU; covered slots of merged cells are left out."""
    out = []
    for t, table in enumerate(part(content, "word/document.xml").iter(W + "tbl")):
        widths = [int(c.get(W + "w", "0")) * DXA for c in table.findall(f"{W}tblGrid/{W}gridCol")]
        y, open_at = 0, {}
        for r, row in enumerate(table.findall(W + "tr")):
            h = value(row.find(f"{W}trPr/{W}trHeight"))
            height, col = int(h) * DXA if h else DEFAULT_ROW, 0
            for cell in row.findall(W + "tc"):
                span = int(value(cell.find(f"{W}tcPr/{W}gridSpan")) or 1)
                merge = cell.find(f"{W}tcPr/{W}vMerge")
                if merge is not None and value(merge) != "restart" and col in open_at:
                    out[open_at[col]][7] += height
                else:
                    out.append([t, r, col, "\n".join(text_of(p) for p in cell.iter(W + "p")), sum(widths[:col]), y, sum(widths[col : col + span]), height])
                    open_at.pop(col, None)
                    if merge is not None:
                        open_at[col] = len(out) - 1
                col += span
            y += height
    return [tuple(x) for x in out]


def drawing_kind(preset: str) -> str:
    low = preset.lower()
    return "arrow" if "arrow" in low else "bracket" if "brac" in low else "line" if "line" in low or "connector" in low else "shape"


def direction(w: int, h: int) -> str | None:
    return "horizontal" if w >= 2 * h else "vertical" if h >= 2 * w else None


def vml_box(style: str | None) -> list[int]:
    """Left, top, width and height of a VML style in EMU: its numbers are points."""
    found = {}
    for item in (style or "").split(";"):
        name, colon, text = item.partition(":")
        number_ = re.match(r"-?\d+(\.\d*)?|-?\.\d+", text.strip())
        if colon and number_:
            found[name.strip().lower()] = round(float(number_[0]) * POINT)
    return [found.get(k, 0) for k in ("left", "top", "width", "height")]


def vml_kind(shape: ElementTree.Element) -> str:
    number_ = re.search(r"t(\d+)$", shape.get("type") or "", re.I)
    if shape.tag == V + "line":
        return "line"
    return next((kind for kind, types in VML_KINDS.items() if number_ and int(number_[1]) in types), "shape")


def shapes_of(element: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """The drawings of a paragraph in order: of an alternative the choice if it has any drawing, else the legacy shapes of
    its fallback.  A drawing inside another is a part of it."""
    for e in element:
        if e.tag in (WP + "anchor", WP + "inline"):
            yield e
        elif e.tag == MC + "AlternateContent":
            chosen = [x for c in e.findall(MC + "Choice") for x in shapes_of(c)]
            yield from chosen or (x for f in e.findall(MC + "Fallback") for x in f.iter() if x.tag in {V + n for n in VML_SHAPES} and any(vml_box(x.get("style"))[2:]))
        elif e.tag != W + "p":
            yield from shapes_of(e)


def drawings_of(content: bytes) -> list[tuple]:
    """(drawing, paragraph, kind, direction, x, y, w, h); a shape's own box overrides its anchor's."""
    out = []
    for i, p in enumerate(part(content, "word/document.xml").iter(W + "p")):
        for anchor in shapes_of(p):
            if anchor.tag.startswith(V):
                box = vml_box(anchor.get("style"))
                out.append((len(out), i, vml_kind(anchor), direction(*box[2:]), *box))
                continue
            extent = anchor.find(WP + "extent")
            place = [number((anchor.findtext(f"{WP}{axis}/{WP}posOffset"))) or 0 for axis in ("positionH", "positionV")]
            box = place + [number(extent.get(k)) or 0 if extent is not None else 0 for k in ("cx", "cy")]
            preset = next((g.get("prst", "") for g in anchor.iter(A + "prstGeom")), None)
            off, ext = next(anchor.iter(A + "off"), None), next(anchor.iter(A + "ext"), None)
            if preset is not None and off is not None:
                box[:2] = [box[0] + int(off.get("x", 0)), box[1] + int(off.get("y", 0))]
            if preset is not None and ext is not None and ext.get("cx"):
                box[2:] = [int(ext.get("cx")), int(ext.get("cy"))]
            picture = any(e.tag.endswith("}pic") for e in anchor.iter())
            out.append((len(out), i, "image" if picture else drawing_kind(preset or ""), direction(*box[2:]), *box))
    return out


def footnotes_of(content: bytes) -> list[tuple]:
    root = part(content, "word/footnotes.xml")
    found = [] if root is None else root.findall(W + "footnote")
    return [(int(f.get(W + "id")), text_of(f).strip()) for f in found if int(f.get(W + "id")) > 0 and f.get(W + "type") not in ("separator", "continuationSeparator")]


def levels_of(content: bytes) -> list[tuple]:
    root = part(content, "word/numbering.xml")
    if root is None:
        return []
    abstract = {a.get(W + "abstractNumId"): a for a in root.findall(W + "abstractNum")}
    out = []
    for n in root.findall(W + "num"):
        for lvl in abstract.get(value(n.find(W + "abstractNumId")), ElementTree.Element("none")).findall(W + "lvl"):
            out.append((int(n.get(W + "numId")), int(lvl.get(W + "ilvl")), number(value(lvl.find(W + "start"))) or 1, value(lvl.find(W + "lvlText")) or ""))
    return out


def _table(files: DataFrame, parse, schema: str, errors: bool = False) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out += [(path, *row, *([None] if errors else [])) for row in parse(bytes(content))]
                except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, KeyError, ElementTree.ParseError, AttributeError, ValueError) as e:
                    # damaged, truncated or encrypted members, unknown compressions, missing parts
                    if errors:
                        out.append((path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names).astype(object)

    return files.mapInPandas(run, schema)


def paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs of all files; a file that can't be read gives one row with its error."""
    return _table(files, paragraphs_of, PARAGRAPHS, errors=True)


def table_cells(files: DataFrame) -> DataFrame:
    return _table(files, cells_of, CELLS)


def drawings(files: DataFrame) -> DataFrame:
    return _table(files, drawings_of, DRAWINGS)


def footnotes(files: DataFrame) -> DataFrame:
    return _table(files, footnotes_of, FOOTNOTES)


def numbering_levels(files: DataFrame) -> DataFrame:
    return _table(files, levels_of, LEVELS)


#: Fixed value: a block element, up to the first end of the same name.
ELEMENT = r"(?is)<(p|h[1-6]|table|li|ol|ul)[^>]*>.*?</\1>"


def html_elements(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """``id_col``, ``ord`` (from 0), ``tag``, ``element`` and ``text`` of a page's block elements in order.

    An element ends with the first end tag of its own name, so what it holds stays in it: ``<li><p>a</p> b</li>`` is one.
    """
    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(ELEMENT), F.lit(0))).alias("ord", "element"))
    return found.select(id_col, "ord", F.lower(F.regexp_extract("element", "(?i)^<(p|h[1-6]|table|li|ol|ul)", 1)).alias("tag"), "element", T.inline_text(F.col("element")).alias("text"))


#: What a paragraph's properties give an element.
PROPERTIES = ("bold", "size", "num_id", "ilvl", "style")


def with_properties(elements: DataFrame, properties: DataFrame, id_col: str) -> DataFrame:
    """Elements (``ord``, ``tag``, ``element``, ``text``) with the properties of the paragraphs that they were made of.

    The k-th element with a text takes the k-th paragraph (``ord``, ``text``, ``PROPERTIES``) with that text in the same
    document: each is taken once, in order.  Without one an element is bold if its HTML says so.  ``style`` is that of
    a heading tag, ``paragraph_style`` the paragraph's.
    """

    def numbered(rows: DataFrame, *kept: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(id_col, "print").orderBy("ord"))
        return rows.withColumn("print", T.fingerprint(F.col("text"))).where("print <> ''").select(id_col, "print", n.alias("n"), *kept)

    taken = numbered(elements, "ord").join(numbered(properties, *PROPERTIES).withColumn("found", F.lit(True)), [id_col, "print", "n"]).drop("print", "n")
    joined = elements.join(taken, [id_col, "ord"], "left")
    heading = F.regexp_extract("tag", "^h([1-6])$", 1)
    return joined.select(
        id_col, "ord", "tag", "element", "text", F.when(heading != "", F.concat(F.lit("heading "), heading)).alias("style"),
        F.when(F.col("found"), F.col("bold")).otherwise(F.rlike("element", F.lit(r"(?i)<strong|<b[\s>]"))).alias("bold"), "size", "num_id", "ilvl", F.col("style").alias("paragraph_style"),
    )


def assembled(elements: DataFrame, base_size: DataFrame, id_col: str, deepest: int = 4) -> DataFrame:
    """Blocks of documents under their headings: ``section`` (the heading's ``ord``), ``title``, ``level``, ``ord``, ``kind``, ``content``.

    ``elements`` are those of ``with_properties``; ``base_size`` has each document's font size.  Tables are blocks of
    their own, list items and other texts are blocks unless they are headings down to level ``deepest``.  A document
    without headings is one section of level 0; with headings, blocks before the first are in none.
    """
    sized = elements.join(base_size, id_col, "left").withColumn("outline", F.lit(None).cast("int"))
    found = headings.detect(sized, F.coalesce("base_size", F.lit(12.0)))
    is_heading = (F.col("tag") != "table") & F.col("level").isNotNull() & (F.col("level") <= deepest)
    marked = found.withColumn("heading", F.coalesce(is_heading, F.lit(False))).where("heading or text <> '' or tag = 'table'")
    before = Window.partitionBy(id_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    under = marked.withColumn("under", F.last(F.when(F.col("heading"), F.struct("ord", F.trim("text").alias("title"), "level")), ignorenulls=True).over(before))
    some = under.withColumn("some", F.max("heading").over(Window.partitionBy(id_col)))
    cells = T.html_table(F.col("element"))
    rows = F.concat(F.array(F.array_join(cells["headers"], " | ")), F.transform(cells["rows"], lambda r: F.array_join(r, " | ")))
    content = F.when(F.col("tag") == "table", F.array_join(rows, "\n")).otherwise(F.col("text"))
    kind = F.when(F.col("tag") == "table", "table").when(F.col("tag") == "li", "list").otherwise("paragraph")
    blocks = some.where("not heading and (under is not null or not some)")
    return blocks.select(id_col, F.coalesce("under.ord", F.lit(0)).alias("section"), F.coalesce("under.title", F.lit("Document")).alias("title"), F.coalesce("under.level", F.lit(0)).alias("level"), "ord", kind.alias("kind"), content.alias("content"))
