"""Workspace operators over a table of files ``(path, n_lines)``.

Paths are relative, '/' separated.  Ignore rules follow .gitignore:
``*`` and ``?`` stay inside one folder, ``**`` crosses folders, ``[abc]`` is one of some characters (``[!abc]`` none
of them), a backslash takes the next character as it is, a pattern with an
inner '/' is anchored at the root (else it matches a name at any depth),
a trailing '/' (or ``dir_only``) matches folders only, ``!`` (or
``negated``) re-includes, lines that begin with ``#`` and trailing blanks do not count, later rules override earlier ones,
and everything below an ignored folder is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import file_key, repo_key

# Characters of a pattern's literal beginning or end by which it meets names.
ANCHOR = 8
# Parts over which rules without any literal text are copied; the names are dealt to them.
FREE_PARTS = 64
# One piece of a pattern: an escaped character, a class, stars, or any character.
GLOB_PIECE = r"(?s)(\\.|\[!?\]?[^\]]*\]|\*\*/|\*\*|.)"


def relative_path(path, root: str) -> Column:
    """Strip ``root/`` from the front when present, else unchanged."""
    c = F.col(path) if isinstance(path, str) else path
    prefix = root.rstrip("/") + "/"
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def filter_subfolders(files: DataFrame, subfolders: str) -> DataFrame:
    """Keep files under any of the comma separated relative folders.

    An OR of ``startswith`` predicates: Parquet scans take it as pushed
    filters.  An empty list keeps everything.
    """
    folders = [f.strip().strip("/") for f in (subfolders or "").split(",") if f.strip().strip("/")]
    if not folders:
        return files
    cond = None
    for f in folders:
        c = F.col("path").startswith(f + "/")
        cond = c if cond is None else (cond | c)
    return files.where(cond)


def glob_regex(pattern: Column) -> Column:
    """Anchored Java regex of an ignore pattern (without '!' and trailing '/')."""
    def quoted(c):
        return F.regexp_replace(c, r"([^A-Za-z0-9_/])", r"\\$1")

    def piece(x):
        inner = F.regexp_replace(F.substring(x, 2, 1 << 20), r"^!", "^")
        return (F.when((F.length(x) == 2) & x.startswith("\\"), quoted(F.substring(x, 2, 1)))
                .when((F.length(x) > 2) & x.startswith("["), F.concat(F.lit("(?!/)["), F.regexp_replace(inner, r"([\[&\\])", r"\\$1")))
                .when(x == "**/", F.lit("(?:.*/)?")).when(x == "**", F.lit(".*"))
                .when(x == "*", F.lit("[^/]*")).when(x == "?", F.lit("[^/]")).otherwise(quoted(x)))
    anchored = F.rtrim(pattern, F.lit("/")).contains("/")
    body = F.array_join(F.transform(F.regexp_extract_all(F.ltrim(pattern, F.lit("/")), F.lit(GLOB_PIECE), 1), piece), "")
    return F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), body, F.lit("$"))


def parsed_rules(rules: DataFrame) -> DataFrame:
    """``[repo], rule_no, ignore, dir_only, literal, anchored, rx, anchor``: the rules that count.  ``literal``: the path or name that a
    pattern without special characters means, else null.  ``anchor``: what every path that the others match has (``_item_anchors``): the
    beginning or the end of its name, whichever is known in more characters, else the name of its first folder, else nothing."""
    r0 = repo_key(rules)
    flag = {c: F.coalesce(F.col(c), F.lit(False)) if c in rules.columns else F.lit(False) for c in ("negated", "dir_only")}
    r = rules.select(*r0, "rule_no", *(flag[c].alias(c) for c in flag), F.regexp_replace("pattern", r"(?<!\\)[ \t]+$", "").alias("p")) \
        .where(~F.col("p").startswith("#"))
    r = r.withColumn("negated", F.col("negated") | F.col("p").startswith("!")).withColumn("p", F.regexp_replace("p", r"^!", ""))
    r = r.withColumn("dir_only", F.col("dir_only") | F.col("p").endswith("/")).withColumn("p", F.regexp_replace("p", r"/+$", "")).where("p <> ''")
    plain = ~F.col("p").rlike(r"[\\\[*?]")
    # Literal text at both ends of the last part, and the first part of an anchored pattern if it is literal.  Escapes and classes end it.
    last = F.regexp_extract("p", r"([^/]*)$", 1)
    special = r"[\\\[\]*?]"
    head, tail = F.regexp_extract(last, r"^([^\\\[\]*?]*)", 1), F.regexp_extract(last, r"([^\\\[\]*?]*)$", 1)
    begin = F.when(last.contains("**"), "").otherwise(F.substring(head, 1, ANCHOR))  # ``x**`` goes on through folders
    end = F.expr(f"right(tail, {ANCHOR})")
    first = F.regexp_extract("p", r"^/?([^/]+)/.", 1)
    anchor = (F.when((F.length(begin) >= F.length(end)) & (begin != ""), F.concat(F.lit("b"), begin)).when(end != "", F.concat(F.lit("e"), end))
              .when((first != "") & ~first.rlike(special), F.concat(F.lit("d"), first)))
    return r.withColumn("tail", tail).withColumn("anchor", anchor).select(
        *r0, "rule_no", (~F.col("negated")).alias("ignore"), "dir_only", F.when(plain, F.ltrim("p", F.lit("/"))).alias("literal"),
        F.col("p").contains("/").alias("anchored"), glob_regex(F.col("p")).alias("rx"), "anchor")


def _item_anchors(x: Column, name: Column) -> Column:
    """All anchors that a rule for this path can have."""
    n = F.greatest(F.lit(0), F.least(F.lit(ANCHOR), F.length(name)))
    sizes = F.transform(F.array_repeat(F.lit(0), n), lambda _x, i: i + 1)
    begins = F.transform(sizes, lambda i: F.concat(F.lit("b"), F.substring(name, F.lit(1), i)))
    ends = F.transform(sizes, lambda i: F.concat(F.lit("e"), F.substring(name, F.length(name) - i + 1, i)))
    return F.concat(begins, ends, F.array(F.concat(F.lit("d"), F.regexp_extract(x, r"^([^/]*)", 1)),
                                          F.concat(F.lit("f"), F.pmod(F.xxhash64(x), F.lit(FREE_PARTS)).cast("string"))))


def _ancestors(path: Column) -> Column:
    parts = F.split(path, "/")
    n = F.greatest(F.size(parts) - 1, F.lit(0))
    return F.transform(F.array_repeat(F.lit(0), n),
                       lambda _x, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def _rule_key(files: DataFrame, rules: DataFrame) -> list[str]:
    """Rules of a repository count there, rules without one everywhere."""
    return [c for c in repo_key(rules) if c in files.columns]


def _ignored_by_rule(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of the distinct ``items([repo], x, is_dir)`` whose last matching rule ignores them.  Rules without
    special characters meet them by equality; the others by the literal text that they begin or end with, and only where
    that fits is the pattern tried.  Rules that have none are tried on all names, dealt over FREE_PARTS parts."""
    r, own, rk = parsed_rules(rules), repo_key(items), _rule_key(items, rules)
    fits = "(is_dir or not dir_only)"
    items = items.withColumn("_name", F.regexp_extract("x", r"([^/]*)$", 1))
    out = [*own, "x", "is_dir", "rule_no", "ignore"]
    plain, glob = r.where("literal is not null"), r.where("literal is null")
    free = F.transform(F.sequence(F.lit(0), F.lit(FREE_PARTS - 1)), lambda i: F.concat(F.lit("f"), i.cast("string")))
    glob = glob.withColumn("_key", F.explode(F.when(F.col("anchor").isNull(), free).otherwise(F.array("anchor"))))
    keyed = items.withColumn("_key", F.explode(_item_anchors(F.col("x"), F.col("_name"))))
    found = items.join(plain.where("anchored").withColumn("x", F.col("literal")), [*rk, "x"]).where(fits).select(*out) \
        .union(items.join(plain.where("not anchored").withColumn("_name", F.col("literal")), [*rk, "_name"]).where(fits).select(*out)) \
        .union(keyed.join(glob, [*rk, "_key"]).where(F.expr(f"{fits} and rlike(x, rx)")).select(*out))
    return found.groupBy(*own, "x", "is_dir").agg(F.max_by("ignore", "rule_no").alias("ignore")).where("ignore").select(*own, "x", "is_dir")


def _ignored_dirs(dirs: DataFrame, rules: DataFrame) -> DataFrame:
    """``[repo], path`` of the folders of ``dirs`` that are ignored, themselves or with one above them."""
    k, r = file_key(dirs), repo_key(dirs)
    own = _ignored_by_rule(dirs.select(*r, F.col("path").alias("x"), F.lit(True).alias("is_dir")), rules)
    above = dirs.select(*k, F.explode(F.concat(_ancestors(F.col("path")), F.array("path"))).alias("x"))
    return above.join(own.select(*r, "x"), [*r, "x"], "left_semi").select(*k).distinct()


def _dirs(files: DataFrame) -> DataFrame:
    return files.select(*repo_key(files), F.explode(_ancestors(F.col("path"))).alias("path")).distinct()


def apply_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop ignored files: those in ignored folders, then those that a rule names.  Rules are data of any
    number, of one workspace or with a ``repo`` of their own; nothing is collected, and no rule meets all files."""
    r = repo_key(files)
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    gone = _ignored_dirs(_dirs(files), rules).withColumnRenamed("path", "_parent")
    kept = files.withColumn("_parent", parent).join(gone, [*r, "_parent"], "left_anti").select(*files.columns)
    own = _ignored_by_rule(files.select(*r, F.col("path").alias("x"), F.lit(False).alias("is_dir")).distinct(), rules)
    return kept.join(own.select(*r, F.col("x").alias("path")), [*r, "path"], "left_anti").select(*files.columns)


def list_files(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Non-ignored files."""
    kept = files if rules is None else apply_ignore_rules(files, rules)
    return kept.select("path", *[c for c in kept.columns if c != "path"])


def list_dirs(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Every non-ignored folder at any depth (relative, root left out), of each repository."""
    dirs = _dirs(files)
    return dirs if rules is None else dirs.join(_ignored_dirs(dirs, rules), file_key(dirs), "left_anti")


def file_counts(files: DataFrame) -> DataFrame:
    """Files directly inside each folder ('' is the root)."""
    parent = F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1)
    return files.groupBy(*file_key(files)[:-1], parent.alias("folder")).agg(F.count(F.lit(1)).cast("bigint").alias("n_files"))


def new_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files with no index entry."""
    k = file_key(files)
    return files.select(*k).join(index.select(*k), k, "left_anti")
