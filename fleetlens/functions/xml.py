"""XML helpers.

Plan and event documents are parsed once per row with ``from_xml`` against
a schema that names only the needed parts (the parser skips the rest), or
tested with a cheap ``contains`` before any parse.  Spark's XML reader is
namespace-agnostic, so the showplan default namespace needs no handling.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import col_of


def parse_xml(col, schema: T.StructType | str) -> Column:
    """``from_xml`` with attributes as ``_name`` fields (G17 building block)."""
    return F.from_xml(col_of(col), schema, {"attributePrefix": "_", "valueTag": "_VALUE", "ignoreNamespace": "true"})


def xml_scalar(col, path: str, kind: str = "string") -> Column:
    """Scalar XPath over a document (G18): ``kind`` in string, int, long,
    double, boolean.  Parses per call; prefer ``parse_xml`` when several
    values of one document are needed."""
    fn = {"string": "xpath_string", "int": "xpath_int", "long": "xpath_long",
          "double": "xpath_double", "boolean": "xpath_boolean"}[kind]
    return F.call_function(fn, col_of(col), F.lit(path))


def xml_rows(df, col: str, schema: str, path: list[str], alias: str = "node", outer: bool = True,
             doc_alias: str | None = None):
    """Shred an XML column to one row per node (G17): parse once with
    ``schema``, follow ``path`` (field names down to an array of nodes) and
    explode it — ``outer=True`` keeps rows without nodes (OUTER APPLY),
    ``False`` drops them (CROSS APPLY).  With ``doc_alias`` the parsed
    document is kept in that column, so other values of the same document
    are read without a second parse."""
    doc = doc_alias or "_xml_doc"
    parsed = df.withColumn(doc, parse_xml(F.col(col), schema))
    node = F.col(doc)
    for p in path:
        node = node[p]
    out = parsed.select("*", (F.explode_outer(node) if outer else F.explode(node)).alias(alias))
    return out if doc_alias else out.drop(doc)
