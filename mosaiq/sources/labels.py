"""Label scans: XML elements, fields by candidate paths, axes, ``KEY = VALUE`` labels.

A label that doesn't parse gives one row with status UNREADABLE; it never stops the scan.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ELEMENTS = "path string, ordinal int, chain array<string>, name string, namespace string, value string, leaf boolean, status string"


def _parts(tag) -> tuple[str | None, str]:
    if not isinstance(tag, str):  # a comment or processing instruction
        return None, ""
    uri, _, name = tag.rpartition("}")
    return (uri[1:] or None), name


def _walk(content: bytes):
    """(chain of local names, namespace, text, leaf) in document order."""
    todo = [(ElementTree.fromstring(content), ())]
    while todo:
        node, above = todo.pop()
        uri, name = _parts(node.tag)
        here = (*above, name)
        children = list(node)
        yield here, uri, (node.text or "").strip(), not children
        todo += [(c, here) for c in reversed(children)]


def _elements(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                found = [(path, i, list(chain), chain[-1], uri, text, leaf, "OK") for i, (chain, uri, text, leaf) in enumerate(_walk(bytes(content or b"")))]
            except ElementTree.ParseError:
                found = [(path, None, None, None, None, None, None, "UNREADABLE")]
            rows += found
        out = pd.DataFrame(rows, columns=["path", "ordinal", "chain", "name", "namespace", "value", "leaf", "status"], dtype=object)
        yield out


def elements(files: DataFrame) -> DataFrame:
    """Every element of the XML labels ``files`` (path, content), in document order.

    (path, ordinal, chain of local names from the root, name, namespace, value trimmed, leaf, status).
    """
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(_elements, _ELEMENTS)


def leaves(found: DataFrame) -> DataFrame:
    """Leaf elements with a text: (path, ordinal, element, name, namespace, value, is_numeric)."""
    return found.filter("leaf and value <> ''").select("path", "ordinal", F.array_join("chain", "/").alias("element"), "name", "namespace", "value", F.expr("try_cast(value as double)").isNotNull().alias("is_numeric"))


def namespaces(found: DataFrame) -> DataFrame:
    """(path, namespace, n): elements by namespace; elements of none count as ``(none)``."""
    return found.filter("status = 'OK'").groupBy("path", F.coalesce("namespace", F.lit("(none)")).alias("namespace")).agg(F.count("*").alias("n"))


def _under(candidate: str) -> Column:
    """Whether ``chain`` ends in the last name of ``candidate`` and holds the others in that order above it."""
    names = candidate.split("/")
    pattern = "".join(f"(?:[^/]+/)*?{n}/" for n in names[:-1]) + "(?:[^/]+/)*" + names[-1] + "$"
    return F.concat(F.array_join("chain", "/")).rlike("^(?:[^/]+/)*?" + pattern)


def fields(found: DataFrame, wanted: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """A row for each label and field: (path, field, raw, number, status).

    ``wanted`` maps a field to its type (``string``, ``int`` or ``double``) and candidate paths, tried in
    order; of one path the first element of the document counts. A field that no path finds is
    UNRESOLVED; a text that isn't of the type is COERCE_FAILED and keeps its raw text.
    """
    hits = []
    for field, (kind, paths) in wanted.items():
        rank = F.lit(None).cast("int")
        for i, p in reversed(list(enumerate(paths))):
            rank = F.when(_under(p), i).otherwise(rank)
        hits.append(F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), rank.alias("rank")))
    ok = found.filter("status = 'OK'")
    each = ok.select("path", "ordinal", "value", F.explode(F.array(*hits)).alias("h"))
    best = each.groupBy("path", "h.field", "h.kind").agg(F.min_by("value", F.when(F.col("h.rank").isNotNull(), F.struct("h.rank", "ordinal"))).alias("raw"), F.count("h.rank").alias("_n"))
    number = F.when(F.col("kind") == "int", F.expr("try_cast(case when raw rlike '^[+-]?[0-9]+$' then raw end as bigint)").cast("double")).when(F.col("kind") == "double", F.expr("try_cast(raw as double)"))
    raw = F.when(F.col("_n") > 0, F.col("raw"))
    status = F.when(raw.isNull(), "UNRESOLVED").when((F.col("kind") != "string") & number.isNull(), "COERCE_FAILED").otherwise("RESOLVED")
    return best.select("path", "field", raw.alias("raw"), F.when(raw.isNotNull(), number).alias("number"), status.alias("status"))


def axes(found: DataFrame, parent: str = "Axis_Array") -> DataFrame:
    """(path, axes): an array of (sequence, name, elements) per label by sequence; incomplete axes are passed over.

    A child belongs to the last ``parent`` element that opens before it in its label.
    """
    ok = found.filter((F.col("status") == "OK") & ((F.col("name") == parent) | (F.try_element_at("chain", F.lit(-2)) == parent)))
    opened = F.sum((F.col("name") == parent).cast("int")).over(Window.partitionBy("path").orderBy("ordinal"))

    def child(name: str, kind: str) -> Column:
        return F.expr(f"try_cast(min(case when name = '{name}' then value end) as {kind})")

    each = ok.withColumn("_axis", opened).groupBy("path", "_axis").agg(child("sequence_number", "int").alias("sequence"), child("axis_name", "string").alias("name"), child("elements", "bigint").alias("elements"))
    good = each.filter("sequence is not null and name is not null and elements is not null")
    return good.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("sequence", "name", "elements"))).alias("axes"))


def keywords(files: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(path, key, value) of ``KEY = VALUE`` labels; the first value of a key counts, keys in upper case.

    The label ends at a line END, or before the line that would pass ``most`` bytes: a label attached to
    an image is part of the format, the image is not. DataFrame functions only.
    """
    text = F.decode(F.substring(F.col("content").cast("binary"), 1, most), "ISO-8859-1")
    lines = files.select("path", F.posexplode(F.split(text, "\r?\n")).alias("no", "line"))
    end = F.min(F.when(F.trim("line") == "END", F.col("no")))
    pairs = lines.groupBy("path").agg(end.alias("end"), F.collect_list(F.when(F.col("line").rlike(_KEYWORD), F.struct("no", "line"))).alias("kept"))
    rows = pairs.select("path", "end", F.explode("kept").alias("k")).filter("end is null or k.no < end")
    key, value = F.upper(F.regexp_extract("k.line", _KEYWORD, 1)), F.trim(F.regexp_extract("k.line", _KEYWORD, 2))
    return rows.groupBy("path", key.alias("key")).agg(F.min_by(F.btrim(value, F.lit('"')), F.col("k.no")).alias("value"))


_KEYWORD = r"^\s*([\^A-Za-z][\w:]*)\s*=\s*(.+?)\s*$"
