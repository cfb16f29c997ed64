"""Plain sources and sinks: rule files, JSON, CSV, TSV and text reports, DOCX reports, ZIP archives."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def taxonomy(spark: SparkSession, zones: list[dict]) -> DataFrame:
    """Zones and subzones (nested under ``subzones``) as one row each, with dotted keys."""
    rows = []
    for z in zones:
        rows.append((z["key"], None, "zone", list(z.get("patterns", []))))
        rows += [(f"{z['key']}.{s['key']}", z["key"], "subzone", list(s.get("patterns", []))) for s in z.get("subzones", [])]
    return spark.createDataFrame(rows, "section string, parent string, kind string, patterns array<string>")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A YAML file of zones; the file is small settings, so the driver reads it whole through Spark."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    return taxonomy(spark, yaml.safe_load(text)["zones"])


def write_report(summary: DataFrame, per_document: DataFrame, titles: DataFrame, path: str) -> None:
    """Summary and documents as JSON, the zones' distribution with shares as CSV and TSV, titles as text."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    per_document.write.mode("overwrite").json(f"{path}/per-document")
    zones = distribution(per_document, "zone")
    for kind, gap in (("csv", ","), ("tsv", "\t")):
        zones.write.mode("overwrite").option("header", True).option("sep", gap).csv(f"{path}/zone-distribution-{kind}" if kind != "csv" else f"{path}/zone-distribution")
    titles.select("title").write.mode("overwrite").text(f"{path}/unclassified-titles")


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """How many rows have each value, and their share of all in percent with one decimal, the most frequent first."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))  # one row
    return counts.crossJoin(whole).select(column, "n", F.round(100 * F.col("n") / F.col("whole"), 1).alias("percent")).orderBy(F.desc("n"), column)


# The types of facts.
VALUE_TYPES = ("string", "integer", "float", "boolean", "date", "duration", "range", "ratio", "list", "object")
LIST_FIELDS = ("labels_ru", "labels_en", "topics")
REGISTRY = "fact_key string, category string, value_type string, priority int, confidence string, description string, labels_ru array<string>, labels_en array<string>, topics array<string>, error string"


def fact_registry(spark: SparkSession, categories: dict[str, object]) -> DataFrame:
    """Facts nested under their categories as one row each; a row that breaks the schema keeps its key and has an ``error``.

    What isn't a list of facts under a category is left out, as headers of a file are; missing lists are empty.
    """
    rows, seen = [], set()
    for category, facts in (categories or {}).items():
        for fact in facts if isinstance(facts, list) else ():
            fact = fact if isinstance(fact, dict) else {"fact_key": None if fact is None else str(fact)}
            key = fact.get("fact_key")
            lists = [fact.get(f) if fact.get(f) is not None else [] for f in LIST_FIELDS]
            wrong = [f for f, v in zip(LIST_FIELDS, lists) if not isinstance(v, list)]
            checks = (
                (not isinstance(key, str) or not key, "no fact_key"), (key in seen, "repeated fact_key"), (fact.get("value_type") not in VALUE_TYPES, f"unknown value_type {fact.get('value_type')}"),
                (fact.get("priority") is not None and not isinstance(fact.get("priority"), int), f"priority {fact.get('priority')} isn't a number"), (bool(wrong), f"{', '.join(wrong)}: not a list"),
            )
            error = "; ".join(text for broken, text in checks if broken) or None
            seen.add(key)
            text = lambda name: None if fact.get(name) is None else str(fact[name])  # noqa: B023, E731
            rows.append((text("fact_key"), category, text("value_type"), fact["priority"] if isinstance(fact.get("priority"), int) else None, text("confidence"), text("description"), *([str(x) for x in v] if isinstance(v, list) else [] for v in lists), error))
    return spark.createDataFrame(rows, REGISTRY)


def read_fact_registry(spark: SparkSession, path: str) -> DataFrame:
    """A YAML file of facts by category; the file is small settings, so the driver reads it whole through Spark."""
    import yaml

    return fact_registry(spark, yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]))


def section_priors(registry: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``fact_key`` and its ``expected_sections``, sorted: the topics of the registry's rows and those of ``more`` together."""
    rows = registry.where("error is null").select("fact_key", "topics")
    both = rows if more is None else rows.unionByName(more.select("fact_key", "topics"))
    return both.select("fact_key", F.explode("topics").alias("topic")).groupBy("fact_key").agg(F.array_sort(F.collect_set("topic")).alias("expected_sections"))


def fact_queries(registry: DataFrame, anchors: DataFrame) -> DataFrame:
    """What a fact is searched by (``fact_key``, ``query``): its anchors (``ru`` and ``en`` keywords), else the words of its key."""
    words = anchors.select("fact_key", F.array_join(F.concat(F.coalesce("ru", F.array().cast("array<string>")), F.coalesce("en", F.array().cast("array<string>"))), " ").alias("anchored"))
    joined = registry.where("error is null").select("fact_key").join(words, "fact_key", "left")
    return joined.select("fact_key", F.coalesce("anchored", F.replace("fact_key", F.lit("_"), F.lit(" "))).alias("query"))


#: Bytes that a member of an archive is written in at a time.
COPY_BYTES = 1 << 20
#: Fixed value: characters of a file's name.
UNSAFE = r"[^\w.-]+"


def write_archives(members: DataFrame, group: str, path: str) -> DataFrame:
    """One ZIP file for each ``group`` below ``path``, of its members (``name``, ``content``) in order of their names; a row for
    each file (``group``, ``file``, ``n_members``).

    A group's members stream by, sorted on disk; a file is written under a name of its attempt and renamed when it is
    whole, so a task that is lost or run twice leaves no half file.  ``path`` is a folder that all executors share, as a
    mounted one.  Of members with equal names the later ones get a number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, held, names, begun = None, None, set(), ""
        done: list[tuple] = []

        def end() -> None:
            archive.close()
            final = os.path.join(path, f"{held}.zip")
            os.replace(begun, final)
            done.append((held, final, len(names)))

        for batch in batches:
            for key, name, content in zip(batch["group"], batch["name"], batch["content"]):
                if key != held:
                    if archive is not None:
                        end()
                    held, names = key, set()
                    os.makedirs(path, exist_ok=True)
                    begun = os.path.join(path, f".{key}-{uuid.uuid4().hex}.part")
                    archive = zipfile.ZipFile(begun, "w", zipfile.ZIP_DEFLATED)
                stem, dot, ending = name.rpartition(".")
                unique, n = name, 1
                while unique in names:
                    n += 1
                    unique = f"{stem}-{n}.{ending}" if dot else f"{name}-{n}"
                names.add(unique)
                # the same members give the same bytes, whenever they are written
                with archive.open(zipfile.ZipInfo(unique), "w") as out:
                    for s in range(0, len(content), COPY_BYTES):
                        out.write(content[s : s + COPY_BYTES])
            yield pd.DataFrame(done, columns=["group", "file", "n_members"])
            done.clear()
        if archive is not None:
            end()
            yield pd.DataFrame(done, columns=["group", "file", "n_members"])

    safe = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("none")), UNSAFE, "_")
    rows = members.select(safe(group).alias("group"), safe("name").alias("name"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    return rows.repartition("group").sortWithinPartitions("group", "name", F.sha2("content", 256)).mapInPandas(run, "group string, file string, n_members long")


# The parts of a minimal DOCX file.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def word_report(title: str, headers: list[str], rows: Iterable[Iterable[object]]) -> bytes:
    """A DOCX file of a heading and a table."""
    # characters that XML can't hold go
    text = lambda v: escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", "" if v is None else str(v)))
    run = lambda v, bold=False: f"<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t xml:space=\"preserve\">{text(v)}</w:t></w:r>"
    line = lambda values, bold: "<w:tr>" + "".join(f"<w:tc><w:p>{run(v, bold)}</w:p></w:tc>" for v in values) + "</w:tr>"
    grid = "".join('<w:gridCol w:w="2000"/>' for _ in headers)
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run(title)}</w:p><w:tbl><w:tblGrid>{grid}</w:tblGrid>{line(headers, True)}{"".join(line(r, False) for r in rows)}</w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in PARTS.items():
            z.writestr(zipfile.ZipInfo(name), content)
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def word_reports(rows: DataFrame, group: str, columns: list[str], order: list[str], title: str) -> DataFrame:
    """One DOCX report for each group, of its rows in order: ``group``, ``name`` and ``content``.

    A report is one document's findings, which a person reads: a group is as small as that.
    """

    def make(found: pd.DataFrame) -> pd.DataFrame:
        key = found[group].iloc[0]
        values = found.sort_values(order, kind="stable")[columns].astype(object).where(lambda c: c.notna(), None).itertuples(index=False)
        return pd.DataFrame([(str(key), f"{key}.docx", word_report(f"{title} {key}", columns, values))], columns=["group", "name", "content"])

    return rows.select(group, *dict.fromkeys([*columns, *order])).groupBy(group).applyInPandas(make, "group string, name string, content binary")
