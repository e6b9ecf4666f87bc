"""Table functions that SQL texts can call."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

#: Name -> (parameters, columns, body): table functions in SQL, which Catalyst puts in place of the call.
SQL_TABLES = {
    "changed_lines": ("doc string", "no int, sign string, line string", r"select pos + 1, substring(col, 1, 1), substring(col, 2) from posexplode(split(doc, '\n')) where col rlike '^[+-]' and not col rlike '^(---|[+]{3}) '"),
    "path_parts": ("path string", "no int, part string", "select pos + 1, col from posexplode(filter(split(path, '/'), x -> x <> ''))"),
}


@udtf(returnType="file string, status string, hunk int, sign string, line string")
class DiffReader:
    """SRC-11 as a table function over the lines of a diff: select * from diff_reader(table(lines) partition by diff_id order by no). A line's file, status and
    hunk come from the markers before it; one instance reads one partition, and holds nothing but these."""

    def __init__(self) -> None:
        self.old = self.new = None
        self.hunk = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        line = row["line"] or ""
        if line.startswith("--- "):
            self.old = line[4:].removeprefix("a/")
        elif line.startswith("+++ "):
            self.new = line[4:].removeprefix("b/")
        elif line.startswith("@@"):
            self.hunk += 1
        elif self.hunk and line[:1] in (" ", "+", "-") and line:
            status = "added" if self.old == "/dev/null" else "removed" if self.new == "/dev/null" else "modified"
            yield self.old if status == "removed" else self.new, status, self.hunk, line[0], line[1:]


@udtf(returnType="path string, content string")
class Unzip:
    """SRC-01 as a table function: the text files of a zip archive, one at a time; nothing for null or for what is no archive."""

    def eval(self, content: bytes | None) -> Iterator[tuple]:
        if content and zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    if not name.endswith("/"):
                        yield name, z.read(name).decode("utf-8", "replace")


def register(spark: SparkSession) -> list[str]:
    """UDF-05: makes the table functions known to this session; their names."""
    for name, (parameters, columns, body) in SQL_TABLES.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns table({columns}) return {body}")
    spark.udtf.register("diff_reader", DiffReader)
    spark.udtf.register("unzip", Unzip)
    return [*SQL_TABLES, "diff_reader", "unzip"]
