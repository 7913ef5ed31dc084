"""Column functions: ``Column -> Column``, built only from Spark SQL
expressions so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for equal results.
# Hunk header body as written by git with zero context lines: "-a[,b] +c[,d]".
HUNK_HEADER_PATTERN = r"^-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?$"
# Hunk categories, in the order the reference tests them.
FEW_REPLACED_WITH_SINGLE = "few_replaced_with_single"
FEW_REPLACED_WITH_FEW = "few_replaced_with_few"
SINGLE_DELETED = "single_deleted"
FEW_DELETED = "few_deleted"
SINGLE_REPLACED_WITH_SINGLE = "single_replaced_with_single"
NEW_LINES_ADDED = "new_lines_added"
NONE_FOUND = "none_found"
# Remotes that have a web page per commit.
GITHUB_REMOTE_PATTERN = r"^(?:git@github\.com:|https://github\.com/)(.+?)(?:\.git)?$"
GITHUB_COMMIT_PREFIX = "https://github.com/"
SHORT_HASH_LENGTH = 7
DEFAULT_TOP_K = 10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Trim all leading and trailing white space (Spark ``trim`` only drops blanks)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def hunk_header_body(line) -> Column:
    """``@@ -a,b +c,d @@ ctx`` -> ``-a,b +c,d`` (text between the first two ``@@``)."""
    c = _col(line)
    return trim_ws(F.regexp_extract(c, r"^\s*@@(.*?)@@", 1))


def parse_hunk_header(c) -> Column:
    """struct(old_start, old_count, new_start, new_count); an absent count is 1,
    text that does not match gives null."""
    c = _col(c)

    def grp(i):
        return F.regexp_extract(c, HUNK_HEADER_PATTERN, i)

    def num(i, default=None):
        g = F.nullif(grp(i), F.lit(""))
        if default is not None:
            g = F.coalesce(g, F.lit(str(default)))
        return g.cast("bigint")

    return F.when(c.rlike(HUNK_HEADER_PATTERN), F.struct(
        num(1).alias("old_start"), num(2, 1).alias("old_count"),
        num(3).alias("new_start"), num(4, 1).alias("new_count")))


def categorize_change(old_count, new_count) -> Column:
    """Hunk category from its two counts; null counts give null."""
    m, p = _col(old_count), _col(new_count)
    return (F.when(m.isNull() | p.isNull(), F.lit(None).cast("string"))
            .when((m > 1) & (p == 1), F.lit(FEW_REPLACED_WITH_SINGLE))
            .when((m >= 1) & (p > 1), F.lit(FEW_REPLACED_WITH_FEW))
            .when((m == 1) & (p == 0), F.lit(SINGLE_DELETED))
            .when((m > 1) & (p == 0), F.lit(FEW_DELETED))
            .when((m == 1) & (p == 1), F.lit(SINGLE_REPLACED_WITH_SINGLE))
            .when((m == 0) & (p > 0), F.lit(NEW_LINES_ADDED))
            .otherwise(F.lit(NONE_FOUND)))


def edit_distance(a, b) -> Column:
    """Levenshtein distance over characters."""
    return F.levenshtein(_col(a), _col(b))


def is_similar(a, b, threshold: int) -> Column:
    """Distance <= threshold; Spark stops early and returns -1 beyond it."""
    return F.levenshtein(_col(a), _col(b), int(threshold)) >= 0


def commit_url(remote, commit_hash) -> Column:
    """Web address of a commit for GitHub SSH/HTTPS remotes, else ''."""
    r = trim_ws(remote)
    repo_path = F.regexp_extract(r, GITHUB_REMOTE_PATTERN, 1)
    return F.when(r.rlike(GITHUB_REMOTE_PATTERN),
                  F.concat(F.lit(GITHUB_COMMIT_PREFIX), repo_path, F.lit("/commit/"),
                           _col(commit_hash))).otherwise(F.lit(""))


def split_message(c) -> Column:
    """struct(title, body): first line of the trimmed message, trimmed; the rest, trimmed."""
    msg = trim_ws(c)
    parts = F.split(msg, "\n", 2)
    return F.struct(trim_ws(F.element_at(parts, 1)).alias("title"),
                    F.coalesce(trim_ws(F.get(parts, 1)), F.lit("")).alias("body"))


def short_hash(c) -> Column:
    """Strip one leading ``^`` (boundary commits in blame), keep 7 characters."""
    return F.substring(F.regexp_replace(_col(c), r"^\^", ""), 1, SHORT_HASH_LENGTH)


def strip_marker(c) -> Column:
    """Remove one leading ``+``."""
    return F.regexp_replace(_col(c), r"^\+", "")


def trim_list(c, k: int = DEFAULT_TOP_K) -> Column:
    """First k items of a comma separated list (no trailing comma)."""
    return F.array_join(F.slice(F.split(_col(c), ","), 1, int(k)), ",")


def line_count(text) -> Column:
    """Lines of a text; a final newline adds none, the empty text has none."""
    t = _col(text)
    body = F.regexp_replace(t, r"\n\z", "")
    return F.when(t.isNull(), F.lit(None).cast("bigint")) \
        .when(t == "", F.lit(0).cast("bigint")) \
        .otherwise(F.size(F.split(body, "\n", -1)).cast("bigint"))


def split_lines(text) -> Column:
    """Lines of a text as an array, with the same rule as ``line_count``."""
    t = _col(text)
    return F.when(t == "", F.array().cast("array<string>")) \
        .otherwise(F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1))


def join_ids(arr) -> Column:
    """Array of ids -> comma separated text (for display and oracle checks)."""
    return F.array_join(F.transform(_col(arr), lambda x: x.cast("string")), ",")
