"""Column functions over paths, names and code text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
PRUNED_FOLDERS = ["target", "build", ".git", ".idea", "node_modules", ".mvn", "out", "dist", ".gradle"]
TRIVIAL_METHODS = ["equals", "hashCode", "toString", "canEqual"]
LIBRARY_PACKAGES = ["java", "javax", "org.springframework", "lombok"]
STEREOTYPES = ["RestController", "Controller", "Service", "Repository", "Component", "Configuration"]
CONTROLLERS = ["REST_CONTROLLER", "CONTROLLER"]

SQL_STATEMENT = r"(?is)(?:CREATE\s+(?:TABLE|INDEX|VIEW|PROCEDURE|FUNCTION|TRIGGER)|ALTER\s+TABLE|DROP\s+(?:TABLE|INDEX|VIEW)|INSERT\s+INTO|UPDATE\s+\w+\s+SET|SELECT\b)[^;]+;"
SQL_ELEMENT = r"(?i)(?:TABLE|VIEW|PROCEDURE|FUNCTION|INDEX|INTO|UPDATE)\s+(\w+)"
SCORE = r"\b([0-9]|10)\b"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def pruned(path: Column) -> Column:
    """Whether a path lies below a folder that is never scanned."""
    folders = "|".join(f.replace(".", r"\.") for f in PRUNED_FOLDERS)
    return path.rlike(f"/({folders})/")


def is_test_file(path: Column) -> Column:
    return path.contains("/test/") | path.endswith("Test.java") | path.endswith("Tests.java") | path.endswith("Spec.java")


def is_project_type(name: Column) -> Column:
    """Whether a type name is qualified and not of a well-known library."""
    packages = "|".join(p.replace(".", r"\.") for p in LIBRARY_PACKAGES)
    return name.contains(".") & ~name.rlike(rf"^({packages})\.")


def is_trivial_method(name: Column, start: Column, end: Column) -> Column:
    return (end - start < 3) | name.isin(TRIVIAL_METHODS)


def mentions_null(content: Column) -> Column:
    low = F.lower(content)
    return low.contains("null") | low.contains("optional")


def sql_element(statement: Column) -> Column:
    """The first name after a keyword; `unknown` without one."""
    return F.coalesce(F.nullif(F.regexp_extract(statement, SQL_ELEMENT, 1), F.lit("")), F.lit("unknown"))


def sql_kind(statement: Column) -> Column:
    s = F.upper(F.trim(statement))
    kind = F.when(s.startswith("CREATE TABLE"), "CREATE_TABLE").when(s.startswith("CREATE INDEX"), "CREATE_INDEX")
    kind = kind.when(s.startswith("CREATE PROCEDURE") | s.startswith("CREATE FUNCTION"), "STORED_PROCEDURE")
    return kind.when(s.startswith("ALTER TABLE"), "ALTER_TABLE").when(s.startswith("INSERT INTO"), "INSERT").otherwise("OTHER")


def parsed_score(answer: Column) -> Column:
    """The first number from 0 to 10 in a model's answer, 5 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(answer, SCORE, 1), F.lit("")).cast("double"), F.lit(5.0))


def preview(content: Column, most: int, mark: str = "...") -> Column:
    """Text cut at `most` characters, with a mark where it was."""
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit(mark))).otherwise(content)


def approximate_name(service: Column, cls: Column, element: Column) -> Column:
    """service[.class].element, null without an element."""
    return F.when(element.isNotNull(), F.concat_ws(".", service, cls, element))


def enriched_text(service: Column, file: Column, kind: Column, element: Column, extra: Column, content: Column) -> Column:
    """A chunk's text behind header lines; the entries of the map `extra` in the order of their keys."""
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce(extra, F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    line = lambda name, value: F.concat(F.lit(name + ": "), value)  # noqa: E731  null without a value, and then left out
    head = F.concat(F.array(line("Service", service), line("File", file), line("Type", kind), line("Element", element)), entries)
    return F.concat(F.array_join(head, "\n"), F.lit("\n\n"), content)
