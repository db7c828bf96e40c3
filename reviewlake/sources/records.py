"""Landed JSON, HTML and reports, and what is written out."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE = "struct<number:long,title:string,body:string,state:string,merged_at:string,draft:boolean,user:struct<login:string>,base:struct<ref:string>,head:struct<ref:string,sha:string,repo:struct<full_name:string>>,labels:array<struct<name:string>>,created_at:timestamp,updated_at:timestamp>"
COMMENT = "struct<id:long,user:struct<login:string>,body:string,path:string,line:long,original_line:long,created_at:timestamp>"


def parsed(df: DataFrame, text: str, schema: str) -> DataFrame:
    return df.withColumn("_j", F.from_json(text, schema))


def changes(df: DataFrame, text: str = "value") -> DataFrame:
    """Landed change documents as rows: nulls of title and body are empty, merged and draft are booleans, labels a list of names."""
    j = F.col("_j")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return parsed(df, text, CHANGE).filter("_j.number IS NOT NULL").select(
        j["number"].alias("pr"), empty(j["title"]).alias("title"), empty(j["body"]).alias("body"), j["user"]["login"].alias("author"), j["state"].alias("state"), j["merged_at"].isNotNull().alias("merged"), F.coalesce(j["draft"], F.lit(False)).alias("draft"),
        j["base"]["ref"].alias("base"), j["head"]["ref"].alias("branch"), j["head"]["sha"].alias("head"), j["head"]["repo"]["full_name"].alias("head_repo"), F.transform(j["labels"], lambda x: x["name"]).alias("labels"), j["created_at"].alias("created_at"), j["updated_at"].alias("updated_at"),
    )


def comments(df: DataFrame, text: str = "value") -> DataFrame:
    """Review comments: the line, else the original line."""
    j = F.col("_j")
    return parsed(df, text, COMMENT).select(j["id"].alias("id"), j["user"]["login"].alias("author"), F.coalesce(j["body"], F.lit("")).alias("body"), j["path"].alias("path"), F.coalesce(j["line"], j["original_line"]).alias("line"), j["created_at"].alias("created_at"))


def flattened_pages(df: DataFrame, text: str = "value", item: str = "string") -> DataFrame:
    """One row per item of a list of pages, each page a list."""
    return df.select(F.explode(F.flatten(F.from_json(text, f"array<array<{item}>>"))).alias("item"))


def link(outward: Column, inward: Column, out_name: Column, in_name: Column) -> Column:
    """(relation, key): the outward side where there is one, else the inward."""
    return F.when(outward.isNotNull(), F.struct(out_name.alias("relation"), outward.alias("key"))).otherwise(F.struct(in_name.alias("relation"), inward.alias("key")))



class _Lines(HTMLParser):
    block = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "section", "article", "footer", "nav", "header", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = [""]
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.block:
            self.out.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.block:
            self.out.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.out[-1] += data


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_lines(html: pd.Series) -> pd.Series:
    """Visible lines of a page: script and style skipped, block tags break lines, spaces collapsed, empty lines dropped."""

    def one(h):
        p = _Lines()
        p.feed(h or "")
        p.close()
        return [s for s in (" ".join(x.split()) for x in p.out) if s]

    return html.map(one)


def ci_page(lines: Column) -> Column:
    """layout, ref, overall, passed, failed of a CI page's lines: a heading `CI results for REF: PASS|FAIL` with `- passed: N`
    lines, or a [Totals] block of key value lines; error says what is missing."""
    head = F.try_element_at(F.filter(lines, lambda x: x.rlike("^CI results for ")), F.lit(1))
    totals = F.array_contains(lines, "[Totals]")

    def number(rx):
        return F.try_element_at(F.transform(F.filter(lines, lambda x: x.rlike(rx)), lambda x: F.regexp_extract(x, rx, 1).cast("long")), F.lit(1))

    passed, failed = number(r"(?i)^(?:- )?passed:? (\d+)$"), number(r"(?i)^(?:- )?failed:? (\d+)$")
    layout = F.when(head.isNotNull(), "classic").when(totals, "totals")
    error = F.when(layout.isNull(), "unknown layout").when(passed.isNull(), "no count of passed tests")
    return F.struct(layout.alias("layout"), F.regexp_extract(head, r"^CI results for ([^:]+)", 1).alias("ref"), F.when(failed == 0, "PASS").when(failed.isNotNull(), "FAIL").alias("overall"), passed.alias("passed"), failed.alias("failed"), error.alias("error"))


SUITE = "_name string, `system-out` string, `system-err` string, testcase array<struct<_classname:string,_name:string,error:struct<_VALUE:string,_message:string>,failure:struct<_VALUE:string,_message:string>,skipped:struct<_VALUE:string,_message:string>>>"
RULE_FILE = "_name string, violation array<struct<_beginline:int,_endline:int,_rule:string,_ruleset:string,_class:string,_method:string,_VALUE:string>>"
STYLE_FILE = "_name string, error array<struct<_line:int,_source:string,_message:string>>"
COVERED_PACKAGE = "_name string, sourcefile array<struct<_name:string,line:array<struct<_nr:int,_mi:int,_ci:int,_mb:int,_cb:int>>>>"
DUPLICATION = "_lines int, _tokens int, file array<struct<_path:string,_line:int,_endline:int>>"
RULE_SET = "_name string, rule array<struct<_ref:string>>"
MODULE = "_name string, property array<struct<_name:string,_value:string>>"


def xml_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One row per element of that tag in the files of path; large files are read in a stream, element by element."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def xml_texts(df: DataFrame, text: str, schema: str) -> DataFrame:
    """The same from a column that holds one element each."""
    return df.select(F.from_xml(text, schema).alias("_x")).select("_x.*")


def junit(suites: DataFrame) -> DataFrame:
    """suite, cls, test, kind (error, failure or skipped), message (the first line that isn't blank, 300 characters at most), bucket: environment,
    timeout, failure, skipped or passed. suites: records of SUITE."""
    x = suites.select(F.col("_name").alias("suite"), F.concat_ws("\n", "`system-out`", "`system-err`").alias("console"), F.explode("testcase").alias("t"))
    body = F.coalesce(F.col("t.error._VALUE"), F.col("t.failure._VALUE"), F.lit(""))
    text = F.coalesce(F.col("t.error._message"), F.col("t.failure._message"), F.try_element_at(F.filter(F.split(body, "\n"), lambda s: F.trim(s) != ""), F.lit(1)), F.lit(""))
    env = F.concat_ws("\n", "console", body).rlike("(?i)operation not permitted|address already in use")
    kind = F.when(F.col("t.error").isNotNull(), "error").when(F.col("t.failure").isNotNull(), "failure").when(F.col("t.skipped").isNotNull(), "skipped")
    bucket = F.when(kind.isNull(), "passed").when(kind == "skipped", "skipped").when(env, "environment").when(F.concat_ws("\n", text, body).contains("Timeout occurred"), "timeout").otherwise("failure")
    return x.select("suite", F.coalesce("t._classname", "suite").alias("cls"), F.col("t._name").alias("test"), kind.alias("kind"), F.substring(F.trim(text), 1, 300).alias("message"), bucket.alias("bucket"))


def junit_totals(tests: DataFrame) -> DataFrame:
    """Per suite: tests run, classes, failed and errors (real failures of either kind), skipped, and how many fell in other buckets."""
    real = lambda k: F.count(F.when((F.col("bucket") == "failure") & (F.col("kind") == k), 1))
    return tests.groupBy("suite").agg(F.count(F.lit(1)).alias("run"), F.count_distinct("cls").alias("classes"), real("failure").alias("failed"), real("error").alias("errors"), *[F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in ("skipped", "timeout", "environment", "passed")])


def rule_report(files: DataFrame) -> DataFrame:
    """file, rule, category (a slug), begin, end, message (spaces collapsed, 200 characters at most). files: records of RULE_FILE."""
    x = files.select(F.col("_name").alias("file"), F.explode("violation").alias("v"))
    return x.select("file", F.col("v._rule").alias("rule"), F.lower(F.regexp_replace("v._ruleset", r"\s+", "")).alias("category"), F.col("v._beginline").alias("begin"), F.col("v._endline").alias("end"), F.substring(F.trim(F.regexp_replace("v._VALUE", r"\s+", " ")), 1, 200).alias("message"))


def method_scores(report: DataFrame) -> DataFrame:
    """file, rule, method, score, begin of rule rows whose message says `The method 'x' has a ... of N`."""
    rx = r"(?:method|constructor) '([^']+)' has an? .*? of (\d+)"
    return report.select("file", "rule", F.regexp_extract("message", rx, 1).alias("method"), F.regexp_extract("message", rx, 2).alias("n"), "begin").filter("n <> ''").select("file", "rule", "method", F.col("n").cast("int").alias("score"), "begin")


def style_report(files: DataFrame) -> DataFrame:
    """file, rule (last dotted part without Check), line, message; a file without errors keeps one row of nulls. files: records of STYLE_FILE."""
    x = files.select(F.col("_name").alias("file"), F.explode_outer("error").alias("e"))
    return x.select("file", F.regexp_replace(F.element_at(F.split("e._source", r"\."), -1), "Check$", "").alias("rule"), F.col("e._line").alias("line"), F.col("e._message").alias("message"))


def coverage_report(packages: DataFrame) -> DataFrame:
    """file, line, mi, ci, mb, cb. packages: records of COVERED_PACKAGE."""
    x = packages.select(F.col("_name").alias("p"), F.explode("sourcefile").alias("s"))
    x = x.select(F.concat_ws("/", "p", "s._name").alias("file"), F.explode("s.line").alias("l"))
    return x.select("file", F.col("l._nr").alias("line"), F.col("l._mi").alias("mi"), F.col("l._ci").alias("ci"), F.col("l._mb").alias("mb"), F.col("l._cb").alias("cb"))


def duplicate_report(blocks: DataFrame) -> DataFrame:
    """block, tokens, lines, file, line, endline, one row per occurrence. blocks: records of DUPLICATION."""
    x = blocks.withColumn("block", F.xxhash64(F.to_json("file"))).select("block", F.col("_tokens").alias("tokens"), F.col("_lines").alias("lines"), F.explode("file").alias("f"))
    return x.select("block", "tokens", "lines", F.col("f._path").alias("file"), F.col("f._line").alias("line"), F.col("f._endline").alias("endline"))


def rule_catalogue(sets: DataFrame, never: tuple[str, ...] = ("CognitiveComplexity", "CyclomaticComplexity", "NPathComplexity")) -> DataFrame:
    """rule, category of the references of a rule set; complexity rules are left out. sets: records of RULE_SET."""
    r = sets.select(F.explode("rule").alias("r")).select(F.regexp_extract("r._ref", r"([^/]+)\.xml/(\w+)$", 2).alias("rule"), F.regexp_extract("r._ref", r"([^/]+)\.xml/(\w+)$", 1).alias("category"))
    return r.filter((F.col("rule") != "") & ~F.col("rule").isin(*never)).distinct()


def banned_rules(modules: DataFrame) -> DataFrame:
    """kind, pattern of style modules that ban line patterns, imports or instantiations. modules: records of MODULE."""
    p = modules.select(F.col("_name").alias("kind"), F.map_from_entries(F.transform("property", lambda x: F.struct(x["_name"], x["_value"]))).alias("p"))
    line = p.filter("kind = 'RegexpSinglelineJava'").select("kind", F.col("p")["format"].alias("pattern"))

    def listed(kind, key, before, after):
        names = F.explode(F.split(F.col("p")[key], r"\s*,\s*"))
        quoted = lambda n: F.replace(n, F.lit("."), F.lit("\\."))
        return p.filter((F.col("kind") == kind) & F.col("p")[key].isNotNull()).select("kind", names.alias("n")).select("kind", F.concat(F.lit(before), quoted("n"), F.lit(after)).alias("pattern"))

    imports = listed("IllegalImport", "illegalPkgs", r"import (static )?", r"\.").unionByName(listed("IllegalImport", "illegalClasses", r"import (static )?", r"\b"))
    return line.unionByName(imports).unionByName(listed("IllegalInstantiation", "classes", r"new ", r"\b"))


#: Our names of custom fields, and theirs; trackers give them ids of their own.
FIELD_NAMES = {"reviewers": "Reviewers", "authors": "Authors", "test_doc_plan": "Test and Documentation Plan", "impacts": "Impacts", "since_versions": "Since Version", "source_control_link": "Source Control Link"}


def at(v: Column, path: str | Column, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def items(v: Column) -> Column:
    """The elements of a list, or a single object as a list of one; anything else has none."""
    none = F.array().cast("array<variant>")
    return F.when(kind_of(v, "ARRAY"), at(v, "$", "array<variant>")).when(kind_of(v, "OBJECT"), F.array(v)).otherwise(none)


def objects(v: Column) -> Column:
    return F.filter(items(v), lambda x: kind_of(x, "OBJECT"))


def first_text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(at(v, p), F.lit("")) for p in paths])


def names(v: Column) -> Column:
    return F.transform(objects(v), lambda x: first_text(x, "$.name", "$.value"))


def users(v: Column) -> Column:
    return F.transform(objects(v), lambda x: F.struct(first_text(x, "$.name", "$.key").alias("name"), at(x, "$.displayName").alias("display")))


def plain_text(v: Column) -> Column:
    """A scalar as text, a list or object as its names, nothing as ''."""
    nested = kind_of(v, "ARRAY") | kind_of(v, "OBJECT")
    return F.when(nested, F.array_join(names(v), ", ")).otherwise(F.coalesce(at(v, "$"), F.lit("")))


def tickets(df: DataFrame, fields: DataFrame, base: str, text: str = "value", remote: str | None = None, wanted: dict[str, str] = FIELD_NAMES) -> DataFrame:
    """Landed tickets (tracker, text) as rows: key, url, summary, description, status, resolution, issuetype, components, labels, fix_versions,
    since_versions, reviewers, authors, assignee, test_doc_plan, impacts, source_control_link, comments, attachments, issuelinks and
    remotelinks, and error for a text that is no ticket, with nulls.

    A document is read once, as a Variant, whatever fields it has, where it lies: trackers are few, and dealt out by tracker all documents would
    meet in as many tasks, so up to 10,000 are broadcast; more are joined as Spark sees fit. Custom fields are found by name: fields (tracker, id, name) gives each
    tracker's ids, one row a tracker after grouping, and a field is read at the path of its id. remote: a column with the landed
    list of remote links.
    """
    low = fields.filter(F.col("name").isin(*wanted.values())).groupBy("tracker").agg(F.map_from_entries(F.collect_list(F.struct("name", "id"))).alias("_ids"))
    few = low.limit(10_001).count() <= 10_000
    t = df.join(F.broadcast(low) if few else low, "tracker", "left").withColumn("_v", F.try_parse_json(text))
    v = F.col("_v")
    f = lambda path, kind="variant": at(v, f"$.fields.{path}", kind)
    custom = lambda name: at(v, F.concat(F.lit("$.fields['"), F.coalesce(F.try_element_at("_ids", F.lit(wanted[name])), F.lit("-")), F.lit("']")), "variant")
    url = lambda key: F.concat(F.lit(f"{base}/browse/"), key)
    empty = lambda c: F.coalesce(c, F.lit(""))
    key = at(v, "$.key")
    comment = lambda c: F.struct(at(c, "$.id").alias("id"), at(c, "$.author.name").alias("author"), at(c, "$.author.displayName").alias("display"), at(c, "$.created").alias("created"), empty(at(c, "$.body")).alias("body"), F.concat(url(key), F.lit("?focusedCommentId="), at(c, "$.id")).alias("url"))
    attachment = lambda a: F.struct(at(a, "$.id").alias("id"), at(a, "$.filename").alias("filename"), at(a, "$.size", "bigint").alias("size"), at(a, "$.created").alias("created"), at(a, "$.author.name").alias("author"), at(a, "$.content").alias("url"))

    def link(x: Column) -> Column:
        out = at(x, "$.outwardIssue.key").isNotNull()
        side = lambda path: F.when(out, at(x, f"$.outwardIssue.{path}")).otherwise(at(x, f"$.inwardIssue.{path}"))
        relation = F.coalesce(F.when(out, at(x, "$.type.outward")).otherwise(at(x, "$.type.inward")), at(x, "$.type.name"))
        return F.struct(relation.alias("relation"), side("key").alias("key"), empty(side("fields.summary")).alias("summary"), side("fields.status.name").alias("status"), url(side("key")).alias("url"))

    links = F.try_parse_json(remote) if remote else F.lit(None).cast("variant")
    return t.select(
        key.alias("key"), url(key).alias("url"), empty(f("summary", "string")).alias("summary"), empty(f("description", "string")).alias("description"), f("status.name", "string").alias("status"), f("resolution.name", "string").alias("resolution"), f("issuetype.name", "string").alias("issuetype"),
        names(f("components")).alias("components"), F.transform(F.filter(items(f("labels")), lambda x: kind_of(x, "STRING")), lambda x: at(x, "$")).alias("labels"), names(f("fixVersions")).alias("fix_versions"), names(custom("since_versions")).alias("since_versions"), users(custom("reviewers")).alias("reviewers"), users(custom("authors")).alias("authors"),
        users(f("assignee")).alias("assignee"), plain_text(custom("test_doc_plan")).alias("test_doc_plan"), names(custom("impacts")).alias("impacts"), plain_text(custom("source_control_link")).alias("source_control_link"), F.transform(items(f("comment.comments")), comment).alias("comments"), F.transform(items(f("attachment")), attachment).alias("attachments"),
        F.transform(items(f("issuelinks")), link).alias("issuelinks"), F.transform(items(links), lambda r: F.struct(at(r, "$.object.title").alias("title"), at(r, "$.object.url").alias("url"))).alias("remotelinks"), F.when(key.isNull(), "unreadable").alias("error"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_values(text: pd.Series) -> pd.Series:
    """JSON values printed back to back, nested lists flattened; what follows the first unreadable character is left out."""
    import json

    def one(s):
        out, at, d = [], 0, json.JSONDecoder()

        def put(v):
            if isinstance(v, list):
                for x in v:
                    put(x)
            else:
                out.append(json.dumps(v, sort_keys=True))

        s = s or ""
        while at < len(s):
            if s[at].isspace():
                at += 1
                continue
            try:
                v, at = d.raw_decode(s, at)
            except ValueError:
                break
            put(v)
        return out

    return text.map(one)


def selected_cases(cases: DataFrame, selector: str) -> DataFrame:
    """Cases by all, a full id, a short id (before the hyphen), or a comma list of them, in request order."""
    if selector == "all":
        return cases.withColumn("ord", F.lit(0))
    spark = cases.sparkSession
    want = spark.createDataFrame([(k, s.strip()) for k, s in enumerate(selector.split(","))], "ord int, want string")
    hit = (F.col("id") == F.col("want")) | (F.split_part("id", F.lit("-"), F.lit(1)) == F.col("want"))
    return cases.join(F.broadcast(want), hit).groupBy(*cases.columns).agg(F.min("ord").alias("ord"))


def case_error(url: Column, terms: Column, severity: Column, lines: Column) -> Column:
    """The first rule that a benchmark case breaks; null for none."""
    return F.coalesce(F.when(~F.coalesce(url.rlike("^https?://"), F.lit(False)), "url"), F.when(F.coalesce(F.size(terms), F.lit(0)) < 1, "terms"), F.when(~severity.isin("blocker", "major", "minor", "nit"), "severity"), F.when(lines.isNotNull() & ((F.size(lines) != 2) | (lines[0] > lines[1])), "lines"))


def reviewer_output(text: Column) -> Column:
    """The JSON of a reviewer's reply: the inside of a code fence, else the outermost braces; null where it is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.try_parse_json(F.when(fenced != "", fenced).when(braces != "", braces))


def embedded_model(html: Column, name: str = "report-model") -> Column:
    """The JSON document in a page's script of that id."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, rf'(?s)<script id="{name}">\s*(?:window\.\w+ = )?(.*?);?\s*</script>', 1), F.lit("")))


def model_json(*columns: str) -> Column:
    """One JSON document per row, safe inside a page: the smaller-than sign escaped."""
    return F.replace(F.to_json(F.struct(*columns)), F.lit("<"), F.lit("\\u003c"))


def leak_guard(rows: DataFrame, text: str, private: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to publish, rows held back because their text holds a private path)."""
    from ..functions.paths import any_of

    bad = F.coalesce(any_of(F.col(text).contains(p) for p in private), F.lit(False))
    return rows.filter(~bad), rows.filter(bad)


def dimension(spark: SparkSession, json_text: str | None, key: str = "key", value: str = "value") -> DataFrame:
    """A JSON map as (key, value) rows; nothing gives an empty table."""
    df = spark.createDataFrame([(json_text,)], "j string")
    return df.select(F.explode(F.from_json("j", "map<string,string>")).alias(key, value))
