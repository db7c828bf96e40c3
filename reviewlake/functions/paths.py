"""What a changed path is: production code, test, generated, document, build file. Rules are data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PathRules:
    """Prefixes, infixes and suffixes of each kind of path. Defaults are fixed values of the layout reviewed."""

    prod: tuple[str, ...] = ("src/java/", "pylib/")
    test: tuple[str, ...] = ("test/",)
    test_inside: str = "/test/"
    resource: tuple[str, ...] = ("test/resources/", "test/data/", "test/conf/")
    generated: tuple[str, ...] = ("src/gen-java/",)
    generated_inside: str = "/gen/"
    generated_end: tuple[str, ...] = (".db", ".bin")
    doc: tuple[str, ...] = ("doc/",)
    doc_end: tuple[str, ...] = (".adoc", ".md")
    doc_never: tuple[str, ...] = ("src/",)
    build: tuple[str, ...] = (".build/", ".circleci/", ".jenkins/", "build.xml", "ide/", ".github/")
    suites: tuple[tuple[str, str], ...] = (
        ("test/unit/", "unit"), ("test/distributed/", "distributed"), ("test/burn/", "burn"), ("test/long/", "long"), ("test/microbench/", "microbench"), ("test/simulator/", "simulator"),
        ("test/harry/", "harry"), ("test/memory/", "memory"), ("test/anttasks/", "anttasks"), ("pylib/shell/test/", "shell"),
    )
    marker: str = "org/project/"
    code: tuple[str, ...] = (".java", ".py", ".g", ".sh", ".xml", ".yaml")


RULES = PathRules()


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def starts(path: Column, prefixes) -> Column:
    return any_of(path.startswith(p) for p in prefixes)


def ends(path: Column, suffixes) -> Column:
    return any_of(path.endswith(s) for s in suffixes)


def is_test(path: Column, r: PathRules = RULES) -> Column:
    return starts(path, r.test) | path.contains(r.test_inside)


def is_prod(path: Column, r: PathRules = RULES) -> Column:
    return starts(path, r.prod) & ~is_test(path, r)


def is_test_resource(path: Column, r: PathRules = RULES) -> Column:
    return starts(path, r.resource)


def is_generated(path: Column, r: PathRules = RULES) -> Column:
    return starts(path, r.generated) | ends(path, r.generated_end) | path.contains(r.generated_inside)


def is_doc(path: Column, r: PathRules = RULES) -> Column:
    return starts(path, r.doc) | (ends(path, r.doc_end) & ~starts(path, r.doc_never))


def is_build(path: Column, r: PathRules = RULES) -> Column:
    return starts(path, r.build)


def is_code(path: Column, r: PathRules = RULES) -> Column:
    return ends(path, r.code)


def file_kind(path: Column, r: PathRules = RULES) -> Column:
    """The first kind that fits: test resource, test, generated, production, doc, build, else other."""
    tests = [("test resource", is_test_resource), ("test", is_test), ("generated", is_generated), ("production", is_prod), ("doc", is_doc), ("build", is_build)]
    return F.coalesce(*[F.when(f(path, r), k) for k, f in tests], F.lit("other"))


def test_suite(path: Column, r: PathRules = RULES) -> Column:
    """The suite of the first prefix that fits, other for further tests, else null."""
    return F.coalesce(*[F.when(path.startswith(p), s) for p, s in r.suites], F.when(is_test(path, r), "other"))


def subsystem(path: Column, r: PathRules = RULES) -> Column:
    """The package right under the marker, (root) for files directly there, null elsewhere."""
    at = F.instr(path, r.marker)
    rest = F.substring(path, at + len(r.marker), F.length(path))
    return F.when(at > 0, F.when(rest.contains("/"), F.split_part(rest, F.lit("/"), F.lit(1))).otherwise("(root)"))


def counted(path: Column, binary: Column, r: PathRules = RULES) -> Column:
    """Whether a file counts toward the size of a change."""
    return ~(is_generated(path, r) | is_test_resource(path, r) | F.coalesce(binary, F.lit(False)))
