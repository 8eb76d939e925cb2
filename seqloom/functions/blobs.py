"""Raw JSON lines read with a narrow schema of text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.text import stripped


def json_object(line: Column | str, fields: tuple[str, ...]) -> Column:
    """A struct of ``fields`` as text, null where the line isn't one whole JSON object.

    Of a key that occurs twice the last value counts, as JSON readers do.  Fields that aren't named
    are never materialised.
    """
    c = F.col(line) if isinstance(line, str) else line
    # a reader stops at the end of the first value; inside an array of an object what follows is an error
    schema = "x array<struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">>, `_broken` string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}
    parsed = F.from_json(F.concat(F.lit('{"x":['), c, F.lit("]}")), schema, options)
    is_object = stripped(c).startswith("{") & stripped(c).endswith("}")
    return F.when(is_object & parsed["_broken"].isNull() & (F.size(parsed["x"]) == 1), parsed["x"][0])
