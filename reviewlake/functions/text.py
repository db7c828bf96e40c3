"""Text of changes, tickets and findings, as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say nothing about a finding.
STOP = (
    "a an the and or of to in on is are was be it its this that for with as by at from not no but if then so than into out up we can may will would should could does do did has have had which what "
    "when where who how also only still any all each more most other such same too very just about after before over under again there their them they you your"
).split()
#: Endings taken off, the first that fits, where four letters at least are left.
ENDINGS = ("ations", "ation", "ings", "ing", "ed", "es", "s")
#: Whole words that can't be identifiers nor parts of one: small letters, after a capital or none.
PLAIN = r"(?<![A-Za-z0-9_.])[A-Z]?[a-z]++(?![A-Za-z0-9_.])"
#: Severities, worst first.
SEVERITIES = ("blocker", "major", "minor", "nit")
#: Words that stand for no name.
PLACEHOLDERS = ("tbd", "tba", "?", "", "none", "n/a")
PROJECT = "PROJ"
#: Trailers that are split out of a commit message.
TRAILERS = ("co-authored-by", "assisted-by", "generated-by", "signed-off-by")


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def keys_in_text(text: Column, project: str = PROJECT) -> Column:
    """Ticket keys in order, canonical: the project's name in any case, an optional separator, three to six digits."""
    return F.transform(all_matches(text, rf"(?i)\b{project}[-_ ]?(\d{{3,6}})\b"), lambda n: F.concat(F.lit(f"{project}-"), n))


def keys_in_branch(branch: Column, project: str = PROJECT) -> Column:
    """Keys as in text, else bare numbers of four to six digits between separators."""
    found = keys_in_text(branch, project)
    tokens = F.split(F.coalesce(branch, F.lit("")), "[/_-]")
    bare = F.transform(F.filter(tokens, lambda t: t.rlike(r"^\d{4,6}$")), lambda n: F.concat(F.lit(f"{project}-"), n))
    return F.when(F.size(found) > 0, found).otherwise(bare)


def key_struct(title: Column, branch: Column, body: Column, commits: Column, project: str = PROJECT) -> Column:
    """key: the first of title, branch, body, commits that has one; sources: where it stands; conflicts: other keys of title
    or branch; mentioned: all, sorted. commits is an array of messages."""
    found = {"title": keys_in_text(title, project), "branch": keys_in_branch(branch, project), "body": keys_in_text(body, project), "commits": F.flatten(F.transform(commits, lambda m: keys_in_text(m, project)))}
    key = F.coalesce(*[F.try_element_at(v, F.lit(1)) for v in found.values()])
    sources = F.filter(F.array(*[F.when(F.array_contains(v, key), s) for s, v in found.items()]), lambda s: s.isNotNull())
    named = F.array_distinct(F.concat(found["title"], found["branch"]))
    return F.struct(key.alias("key"), F.when(key.isNotNull(), sources).otherwise(F.array().cast("array<string>")).alias("sources"), F.array_sort(F.filter(named, lambda k: k != key)).alias("conflicts"), F.array_sort(F.array_distinct(F.concat(*found.values()))).alias("mentioned"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def names_in(text: Column) -> Column:
    """Names of a credit, parted by commas, and, & or +; placeholders dropped."""
    parts = F.split(F.regexp_replace(F.trim(text), r"\.+$", ""), r"(?i)\s*(?:,|\band\b|&|\+)\s*")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(p), "^['\"]+|['\"]+$", "")))
    return F.filter(clean, lambda p: ~F.lower(p).isin(*PLACEHOLDERS))


def primary_key(message: Column, project: str = PROJECT) -> Column:
    """The key of the credit line (after for), else the first key of the message, upper-cased."""
    flat = collapsed(message)
    mine = F.upper(F.regexp_extract(flat, rf"(?i)\bfor\s+({project}-\d+)", 1))
    first = F.upper(F.regexp_extract(F.coalesce(message, F.lit("")), rf"(?i)\b{project}-\d+\b", 0))
    return F.nullif(F.when((mine != "") & flat.rlike("(?i)patch by"), mine).otherwise(first), F.lit(""))


def credit(message: Column, project: str = PROJECT) -> Column:
    """authors, reviewers, key and credited of `patch by A; reviewed by B for KEY`, verbs spelt loosely, or of `patch by A`."""
    flat = collapsed(message)
    full = rf"(?i)patch by (.+?)[;,]\s*re[a-z]*w[a-z]*[- ]by (.+?)(?:\s+for\s+({project}-\d+)|\s*$)"
    short = rf"(?i)patch by (.+?)(?:\s+for\s+({project}-\d+)|\s*$)"
    has, some = flat.rlike(full), flat.rlike(short)
    none = F.array().cast("array<string>")
    authors = F.when(has, names_in(F.regexp_extract(flat, full, 1))).when(some, names_in(F.regexp_extract(flat, short, 1))).otherwise(none)
    reviewers = F.when(has, names_in(F.regexp_extract(flat, full, 2))).otherwise(none)
    key = F.when(has, F.nullif(F.upper(F.regexp_extract(flat, full, 3)), F.lit(""))).when(some, F.nullif(F.upper(F.regexp_extract(flat, short, 2)), F.lit("")))
    return F.struct(authors.alias("authors"), reviewers.alias("reviewers"), F.coalesce(key, primary_key(message, project)).alias("key"), (has | some).alias("credited"))


def trailers(message: Column) -> Column:
    """(name, value) of `name: value` lines whose name is a known trailer."""
    lines = F.split(F.coalesce(message, F.lit("")), "\n")
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([A-Za-z-]+):\s*(.*)$", 1))).alias("name"), F.trim(F.regexp_extract(x, r"^([A-Za-z-]+):\s*(.*)$", 2)).alias("value")))
    return F.filter(pairs, lambda p: p["name"].isin(*TRAILERS))


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    """Names without accents (compatibility decomposition, marks dropped) and case; null is empty."""
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c)).casefold()
    return names.map(plain, na_action=None)


def normalise_name(name: Column) -> Column:
    """Accents off, case folded, punctuation to spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(name), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def stem(word: Column) -> Column:
    """The word without the first ending that fits and leaves four letters."""
    return F.coalesce(*[F.when(word.endswith(e) & (F.length(word) - len(e) >= 4), F.substring(word, F.lit(1), F.length(word) - len(e))) for e in ENDINGS], word)


def words(text: Column) -> Column:
    """Set of stemmed lower-case words of three letters or more, stop words left out. All words of a text are stemmed by one pattern, whose
    leftmost match is the first ending that fits, as no ending comes before one that it ends with."""
    found = all_matches(F.lower(text), "([a-z]{3,})")
    said = F.array_join(F.filter(found, lambda w: ~w.isin(*STOP)), " ")
    return F.array_distinct(all_matches(F.regexp_replace(said, rf"(?<=[a-z]{{4}})(?:{'|'.join(ENDINGS)})(?![a-z])", ""), "([a-z]+)"))


def identifiers(text: Column) -> Column:
    """Set of tokens that look like code: camelCase, two capitals then a small letter, or dotted, with its such parts."""
    telling = F.regexp_replace(F.coalesce(text, F.lit("")), PLAIN, " ")
    found = F.filter(all_matches(telling, r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)"), lambda t: ~t.endswith("java"))
    parts = F.flatten(F.transform(found, lambda t: F.when(t.contains("."), F.concat(F.array(t), F.split(t, r"\."))).otherwise(F.array(t))))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike("[a-z][A-Z]") | p.rlike("^[A-Z]{2,}[a-z]") | p.contains(".")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; 0 for two empty sets."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


def location(text: Column) -> Column:
    """(path, line) of `path.ext:line`, nulls for anything else."""
    rx = r"^(.*\.\w+):(\d+)$"
    return F.struct(F.nullif(F.regexp_extract(text, rx, 1), F.lit("")).alias("path"), F.nullif(F.regexp_extract(text, rx, 2), F.lit("")).try_cast("long").alias("line"))


def severity_rank(severity: Column) -> Column:
    """0 for the worst; unknown ones last."""
    return F.coalesce(*[F.when(severity == s, k) for k, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))


def version_branch(version: Column, branches: list[str], trunk: str = "trunk") -> Column:
    """The branch a fix version lands on: same major, minor equal or left open (highest then); unknown majors go to trunk, what is
    no version is null. branches: release branch names `<anything>-major.minor`."""
    rx = r"^(\d+)(?:\.(\d+|x))?"
    major, minor = F.regexp_extract(version, rx, 1), F.regexp_extract(version, rx, 2)
    known = []
    for b in branches:
        m, n = b.rsplit("-", 1)[-1].split(".")[:2]
        known.append((int(m), int(n), b))
    picks = [F.when((major == str(m)) & ((minor == str(n)) | minor.isin("", "x")), b) for m, n, b in sorted(known, reverse=True)]
    return F.when(major != "", F.coalesce(*picks, F.lit(trunk)))


def plus_one(text: Column) -> Column:
    """A +1 at the start or after a space or bracket, not followed by a letter or digit."""
    return text.rlike(r"(^|[\s(\[])\+1\b")


def clip(text: Column, n: int) -> Column:
    """text with spaces collapsed, cut to n characters with an ellipsis as the last."""
    flat = collapsed(text)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…")))


def at_word(text: Column, limit: int) -> Column:
    """text, if longer than limit cut at the last space before it, without punctuation at the end, with an ellipsis; an inline
    code span that the cut would leave open goes as well."""
    cut = F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*$", "")
    odd = F.size(F.split(cut, "`")) % 2 == 0
    cut = F.when(odd, F.regexp_replace(cut, "`[^`]*$", "")).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:]+$", ""), F.lit("…")))


def first_sentence(text: Column, limit: int = 150) -> Column:
    """Up to the first full stop before a space that ends no abbreviation, without end punctuation, cut at a word."""
    flat = collapsed(text)
    got = F.regexp_extract(flat, r"^(.+?)(?<!e\.g)(?<!i\.e)(?<!etc)(?<!vs)\. ", 1)
    return at_word(F.regexp_replace(F.when(got != "", got).otherwise(flat), r"[.:;]+$", ""), limit)


def clean_title(title: Column, most: int = 80) -> Column:
    """Spaces collapsed; null when empty or too long, never cut."""
    flat = collapsed(title)
    return F.when((flat != "") & (F.length(flat) <= most), flat)


def humanise(rule: Column, limit: int = 90) -> Column:
    """A rule's name as a label: slugs become words, a sentence stays. A longer one loses a parenthesis at its end, then what
    follows a colon, and is cut at a word only then."""
    r = collapsed(rule)
    r = F.when(r.contains(" "), r).otherwise(F.regexp_replace(r, "[_-]+", " "))
    r = F.when(F.length(r) > limit, F.regexp_replace(r, r"\s*\([^()]*\)\s*$", "")).otherwise(r)
    r = F.when(F.length(r) > limit, F.trim(F.split_part(r, F.lit(":"), F.lit(1)))).otherwise(r)
    cut = F.concat(F.regexp_replace(F.regexp_replace(F.substring(r, 1, limit), " [^ ]*$", ""), "[ ,;:]+$", ""), F.lit("…"))
    r = F.when(F.length(r) > limit, cut).otherwise(r)
    return F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))


def short_location(location: Column) -> Column:
    """name:line of a location, else the first file name in it, else its words."""
    line = F.regexp_extract(location, r"([^/\s:()]+:[0-9]+)", 1)
    file = F.regexp_extract(location, r"([^/\s:()]+\.\w+)", 1)
    return F.when(line != "", line).when(file != "", file).otherwise(collapsed(location))


def finding_title(title: Column, rule: Column, location: Column) -> Column:
    """The title where it is short enough, else the rule's label and the short location."""
    r, place = F.nullif(humanise(rule), F.lit("")), F.nullif(short_location(location), F.lit(""))
    return F.coalesce(clean_title(title), F.when(r.isNotNull() & place.isNotNull(), F.concat(r, F.lit(" — "), place)), r, place, F.lit("Code review finding"))


def sanitise_title(text: Column, limit: int = 80) -> Column:
    """ASCII letters, digits, spaces and -_.:() only, spaces collapsed, cut."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9\s_.:()-]", "")
    return F.trim(F.substring(F.trim(F.regexp_replace(kept, r"\s+", " ")), 1, limit))


def loose_location(text: Column) -> Column:
    """(path, line) of what begins like a path with an extension; the line may be missing."""
    rx = r"^\s*([\w./-]+\.\w+)(?::(\d+))?"
    return F.struct(F.nullif(F.regexp_extract(text, rx, 1), F.lit("")).alias("path"), F.nullif(F.regexp_extract(text, rx, 2), F.lit("")).try_cast("long").alias("line"))


def attachment_kind(name: Column) -> Column:
    """summary, archive or other, by an attachment's name."""
    low = F.lower(name)
    return F.when(low.contains("ci_summary") & low.endswith(".html"), "summary").when(low.endswith(".gz") | low.endswith(".zip"), "archive").otherwise("other")


def runnable_test(text: Column, bases: tuple[str, ...] = ("UnitBase", "ClusterBase")) -> Column:
    """Whether a class has something to run: a test or runner annotation, or a known base class."""
    return text.contains("@Test") | text.contains("@RunWith") | text.rlike(rf"\bextends\s+({'|'.join(bases)})\b")


def size_band(lines: Column, bands=((1000, "very large"), (400, "large"), (100, "medium")), rest: str = "small") -> Column:
    """The first band whose bound is exceeded."""
    return F.coalesce(*[F.when(lines > n, label) for n, label in bands], F.lit(rest))


def complexity_band(score: Column, threshold: int = 15) -> Column:
    return F.when(score >= 30, "darkred").when(score >= threshold, "red").when(score >= 10, "yellow").otherwise("green")


def change_label(base: Column, head: Column) -> Column:
    return F.when(base.isNull(), "new").when(head > base, "worse").when(head < base, "better").otherwise("same")


def label_key(case: Column, where: Column, problem: Column) -> Column:
    """A short stable key of a finding, for people's labels."""
    return F.substring(F.sha1(F.concat_ws("|", F.coalesce(case, F.lit("")), F.coalesce(where, F.lit("")), F.substring(F.coalesce(problem, F.lit("")), 1, 200)).cast("binary")), 1, 16)


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"\S"))).cast("long")


def nonblank_within(texts: DataFrame, ranges: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, lines: lines of each text that aren't blank and lie in one of its ranges (key, begin, end), each once."""
    spans = ranges.groupBy(key).agg(F.collect_list(F.struct("begin", "end")).alias("_r"))
    rows = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("t")))
    inside = F.filter(rows, lambda x: x["t"].rlike(r"\S") & F.exists("_r", lambda r: x["n"].between(r["begin"], r["end"])))
    return texts.join(spans, key).select(key, F.size(inside).cast("long").alias("lines"))
