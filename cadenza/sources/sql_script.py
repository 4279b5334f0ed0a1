"""SQL scripts from files: statements apart, parameter marks in Spark's form.

A script is cut at semicolons outside quotes, quoted names, dollar quotes and
comments; comments go. Parameter marks of database drivers become Spark's own
outside quotes: ``%(name)s`` -> ``:name``, ``%s`` -> ``?``, ``$1`` -> ``:p1``,
``%%`` -> ``%``. Values travel as arguments, never as text.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.trigram import register_sql_functions

_TOKEN = re.compile(r"""
    (?P<comment>--[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))
  | (?P<dollar>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)
  | (?P<quoted>'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`)
  | (?P<named>%\((?P<name>\w+)\)s)
  | (?P<plain>%s)
  | (?P<percent>%%)
  | (?P<numbered>\$(?P<number>\d+))
  | (?P<end>;)
""", re.X | re.S)


def statements(script: str) -> list[str]:
    """The script's statements without comments, parameter marks translated."""
    out, part, at = [], [], 0
    for m in _TOKEN.finditer(script):
        part.append(script[at:m.start()])
        at = m.end()
        if m["comment"]:
            part.append(" ")
        elif m["named"]:
            part.append(":" + m["name"])
        elif m["plain"]:
            part.append("?")
        elif m["percent"]:
            part.append("%")
        elif m["numbered"]:
            part.append(":p" + m["number"])
        elif m["dollar"]:
            body = m["dollar"][len(m["tag"]) + 2:-len(m["tag"]) - 2]
            part.append("'" + body.replace("'", "''") + "'")
        elif m["end"]:
            out.append("".join(part).strip())
            part = []
        else:
            part.append(m["quoted"])
    out.append("".join([*part, script[at:]]).strip())
    return [s for s in out if s]


def read_script(spark: SparkSession, path: str) -> list[str]:
    """The statements of a ``.sql`` file in any store that Spark reads."""
    return statements("\n".join([r.value for r in spark.read.text(path, wholetext=True).collect()]))


#: Statements that prepare a database for trigram search; here they register the functions.
_PREPARES = re.compile(r"CREATE\s+EXTENSION\b.*\bpg_trgm\b", re.I | re.S)
#: Secondary indexes have no counterpart in a scan; the stored index is ``operators.fuzzy.TrigramIndex``.
_INDEXES = re.compile(r"CREATE\s+(UNIQUE\s+)?INDEX\b", re.I)


def run_script(spark: SparkSession, script: Sequence[str], args: Mapping[str, object] | Sequence[object] | None = None) -> DataFrame | None:
    """Run statements in order; the last one's result. ``args`` goes to the statements that have marks: a mapping for
    named (and, as ``p1``, ``p2``..., for numbered) ones, a sequence for ``?``. Numbered marks may also be given a sequence."""
    last = None
    for s in script:
        if _PREPARES.match(s):
            register_sql_functions(spark)
        elif not _INDEXES.match(s):
            bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", "", s)
            if args is not None and re.search(r":[A-Za-z_]\w*|\?", bare):
                given = args
                if not isinstance(args, Mapping) and "?" not in bare:
                    given = {f"p{i + 1}": v for i, v in enumerate(args)}
                last = spark.sql(s, args=dict(given) if isinstance(given, Mapping) else list(given))
            else:
                last = spark.sql(s)
    return last
