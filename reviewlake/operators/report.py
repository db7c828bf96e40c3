"""The report model: one nested row a change, from tables that are bucketed by change, and the rules it must keep."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import bucketed  # noqa: F401
from .checks import STATUSES


def model(changes: DataFrame, lists: dict[str, tuple[DataFrame, list[str]]], ones: dict[str, DataFrame], key: str = "pr") -> DataFrame:
    """changes with a column for each derived table: of `lists` an array of structs in the given order, empty where a change has none, of
    `ones`, which have a row a change, a struct or null. What the list of a change holds is in one row, as the model is."""
    out = changes
    for name, (df, order) in lists.items():
        row = F.struct(*order, *[c for c in df.columns if c != key and c not in order])
        per = df.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias(name))
        out = out.join(per, key, "left").withColumn(name, F.coalesce(name, F.array().cast(per.schema[name].dataType)))
    for name, df in ones.items():
        out = out.join(df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name)), key, "left")
    return out


@dataclass(frozen=True)
class Rule:
    """A field and what must hold for it; null doesn't hold. A field `list[].x` is asked of each element, `holds` being given it."""

    field: str
    holds: Callable[[Column], Column]


VERDICTS = ("draft", "needs-contributor-work", "needs-work", "insufficient-evidence", "awaiting-review", "requirements-met-unreviewed", "ready")
BUILD_STATUSES = ("pass", "build-failed", "tests-failed", "timeout", "unknown", "not-built")
RULES = (
    Rule("pr", lambda c: c.isNotNull()), Rule("title", lambda c: c.isNotNull()), Rule("head", lambda c: c.rlike("^[0-9a-f]{32}$|^[0-9a-f]{40}$")), Rule("checks[].check_id", lambda c: c.isNotNull()), Rule("checks[].status", lambda c: c.isin(*STATUSES)), Rule("checks[].evidence", lambda c: c.isNotNull()),
    Rule("recommendation.verdict", lambda c: c.isin(*VERDICTS)), Rule("triage.rating", lambda c: c.isin("easy", "moderate", "hard")), Rule("files[].path", lambda c: c.isNotNull() & (c != "")), Rule("build.status", lambda c: c.isNull() | c.isin(*BUILD_STATUSES)),
)


def broken(rules: tuple[Rule, ...]) -> Column:
    """The first field that breaks its rule, in the rules' order; rules of one list that follow each other are asked element by element.
    Null where all hold."""
    found: list[Column] = []
    k = 0
    while k < len(rules):
        if "[]." not in rules[k].field:
            found.append(F.when(~F.coalesce(rules[k].holds(F.col(rules[k].field)), F.lit(False)), rules[k].field))
            k += 1
            continue
        name = rules[k].field.split("[]")[0]
        some = []
        while k < len(rules) and rules[k].field.startswith(f"{name}[]."):
            some.append((rules[k], rules[k].field.split("[].")[1]))
            k += 1
        found.append(F.try_element_at(F.filter(F.transform(name, element_fault(name, some)), lambda x: x.isNotNull()), F.lit(1)))
    return F.coalesce(*found)


def element_fault(name: str, rules: list[tuple[Rule, str]]) -> Callable[[Column, Column], Column]:
    """The field of an element, with its place, that breaks the first of these rules."""

    def at(x: Column, i: Column) -> Column:
        return F.coalesce(*[F.when(~F.coalesce(r.holds(x[f]), F.lit(False)), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{f}"))) for r, f in rules])

    return at


def validated(models: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """models with error: `invalid: field`, null for a valid one."""
    return models.withColumn("_e", broken(rules)).withColumn("error", F.when(F.col("_e").isNotNull(), F.concat(F.lit("invalid: "), "_e"))).drop("_e")


def quarantined(models: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(the valid models, the others with error)."""
    v = validated(models, rules)
    return v.filter("error IS NULL").drop("error"), v.filter("error IS NOT NULL")
