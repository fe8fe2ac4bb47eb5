"""Column-level helpers: every function returns a Spark ``Column`` built from
built-in expressions, so it stays inside whole-stage codegen."""

from .numeric import exact_ratio, int_div, rounded_key, safe_ratio
from .text import contains_ci, quote_name, render_statement, rewrite_text, statement_slice
from .xml import parse_xml, xml_rows, xml_scalar

__all__ = ["exact_ratio", "int_div", "rounded_key", "safe_ratio", "contains_ci", "quote_name",
           "render_statement", "rewrite_text", "statement_slice", "parse_xml", "xml_rows", "xml_scalar"]
