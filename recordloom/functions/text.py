"""Functions of text, as columns: slugs, titles, lines, front matter, sections, paths, globs, remotes.

White space and digits are those of Unicode where the rules say so, so patterns carry (?U); `\\z` ends a text, since `$`
also stands before a last line end.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that ends a line.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slug(x: Column | str, most: int | None = None, fallback: str = "item") -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one `-`, none at the ends; cut after that."""
    own = F.regexp_replace(F.regexp_replace(F.lower(_col(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    own = F.when(own == "", F.lit(fallback)).otherwise(own)
    return F.substring(own, 1, most) if most else own


def clean_title(x: Column | str) -> Column:
    """Without a leading tracker number and its separator, unless nothing would be left."""
    own = F.trim(F.regexp_replace(_col(x), "(?U)^\\s*\\d+\\s*[—–:-]\\s+", ""))
    return F.when(own == "", _col(x)).otherwise(own)


def split_number(name: Column | str) -> tuple[Column, Column]:
    """Number (null if there is none) and slug of `TODO-001-some-name`."""
    pattern = "(?Us)^(?:[A-Za-z]{2,}[-_ ])?(\\d+)[-_ ]+(.*)$"
    own = _col(name)
    number = F.regexp_extract(own, pattern, 1)
    return F.nullif(number, F.lit("")), F.when(number != "", slug(F.regexp_extract(own, pattern, 2))).otherwise(slug(own))


def clean_inline(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(x), "[`*_]", ""))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x told once, where f has it in lambdas, which would tell it anew for each element."""
    return F.transform(F.array(x), f)[0]


def lines(x: Column | str) -> Column:
    """The lines of a text; an end of line at its end begins no further one."""
    own = F.split(_col(x), LINE_END, -1)
    return F.when(F.element_at(own, -1) == "", F.slice(own, 1, F.size(own) - 1)).otherwise(own)


def first_heading(x: Column | str, fallback: Column | str) -> Column:
    """The text of the first `# ` heading, without a tracker number."""
    found = F.regexp_extract(_col(x), "(?m)^[ \\t]*#[ \\t]+(\\S.*?)[ \\t]*$", 1)
    return F.when(found != "", clean_title(found)).otherwise(_col(fallback))


#: Words in a heading that tell a lifecycle, looked for in this order, anywhere in the heading.
SECTIONS = (
    ("completed", ("done", "complete", "shipped", "released", "delivered")),
    ("deferred", ("later", "future", "someday", "deferred", "icebox", "parking", "wishlist")),
    ("blocked", ("blocked", "on hold", "waiting")),
    ("active", ("now", "next", "in progress", "doing", "active", "todo", "to do", "planned", "backlog")),
)


def section_lifecycle(heading: Column | str) -> Column:
    low, out = F.lower(_col(heading)), F.lit(None).cast("string")
    for state, tellers in reversed(SECTIONS):
        out = F.when(F.exists(F.array(*map(F.lit, tellers)), lambda w: F.contains(low, w)), F.lit(state)).otherwise(out)
    return out


def section(x: Column | str, title: str | Column) -> Column:
    """The body below `## title`, up to the next `## ` or the end; null if there is no such heading."""
    name = F.regexp_replace(F.lit(title) if isinstance(title, str) else title, "([^A-Za-z0-9])", "\\\\$1")
    pattern = F.concat(F.lit("(?ms)^##\\s+"), name, F.lit("[^\\n]*\\n(.*?)(?=^##\\s+|\\z)"))
    found = F.regexp_extract_all(_col(x), pattern, F.lit(1))
    return F.when(F.size(found) > 0, found[0])


def fenced(x: Column | str) -> Column:
    """What the first fenced block holds, or the whole text if there is none."""
    found = F.regexp_extract_all(_col(x), F.lit("(?s)```(.*?)```"), F.lit(1))
    return F.when(F.size(found) > 0, found[0]).otherwise(_col(x))


def front_matter(x: Column | str) -> Column:
    """Map of a document's front matter: `key: value` lines between two `---` lines; null if it is malformed.

    The last of equal keys counts. Values are as written, for scalar() and items() to read.
    """
    # Equal keys: only the last stays, whatever the session does with duplicates.
    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    pair = lambda v: F.struct(F.trim(F.substring_index(v, ":", 1)).alias("k"), F.trim(F.regexp_replace(v, "(?s)^[^:]*:", "")).alias("v"))
    read = lambda inner: F.when(F.forall(inner, lambda v: F.contains(v, F.lit(":"))), F.map_from_entries(_once(F.transform(inner, pair), last)))

    def matter(own: Column) -> Column:
        end = lambda: F.array_position(F.transform(F.slice(own, 2, F.size(own)), lambda v: F.trim(v) == "---"), F.lit(True))
        inner = lambda end: F.filter(F.slice(own, 2, (end - 1).cast("int")), lambda v: F.trim(v) != "")
        return F.when(F.trim(own[0]) == "---", _once(end(), lambda end: F.when(end > 0, _once(inner(end), read))))

    return _once(F.split(_col(x), LINE_END, -1), matter)


def scalar(value: Column) -> Column:
    return F.regexp_replace(value, "^[\"']+|[\"']+$", "")


def is_list(value: Column) -> Column:
    return value.startswith("[") & value.endswith("]")


def items(value: Column) -> Column:
    """The items of an inline list `[a, b]`, split at each comma; an empty array for anything else."""
    inner = F.regexp_replace(F.regexp_replace(value, "^\\[", ""), "\\]$", "")
    own = F.filter(F.transform(F.split(inner, ","), lambda v: scalar(F.trim(v))), lambda v: v != "")
    return F.when(is_list(value), own).otherwise(F.array().cast("array<string>"))


def is_date(x: Column) -> Column:
    """An ISO date: extended or basic calendar form, or a week date."""
    extended = x.rlike("^\\d{4}-\\d{2}-\\d{2}\\z") & x.try_cast("date").isNotNull()
    basic = x.rlike("^\\d{8}\\z") & F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)).try_cast("date").isNotNull()
    week = x.rlike("^\\d{4}-?W(0[1-9]|[1-4]\\d|5[0-3])(-?[1-7])?\\z")
    return F.coalesce(extended | basic | week, F.lit(False))


def is_timestamp(x: Column) -> Column:
    """An ISO 8601 date, with a time and an offset or not."""
    time = x.rlike("^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}(:\\d{2}(:\\d{2}([.,]\\d+)?)?)?(Z|[+-]\\d{2}(:?\\d{2}(:?\\d{2})?)?)?\\z")
    return F.coalesce(is_date(x) | (time & F.substring(x, 1, 10).try_cast("date").isNotNull() & (F.substring(x, 12, 2).cast("int") < 24)), F.lit(False))


def glob_regex(glob: str) -> str:
    """An anchored pattern for a shell glob whose `*` also crosses `/`."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        end = glob.find("]", i + (glob[i : i + 1] in ("!", "]")) + (glob[i : i + 2] == "!]")) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and end >= 0:
            inner = glob[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else "\\" + inner if inner[0] == "^" else inner) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)\\A(?:{out})\\z"


def glob_head(glob: str) -> str:
    """The text before the first wildcard."""
    return re.split(r"[*?\[]", glob, maxsplit=1)[0]


def glob_pattern(glob: Column | str) -> tuple[Column, Column]:
    """glob_regex and glob_head of a column of globs; classes are taken as they are, with `!` as `^`."""
    own = F.regexp_replace(F.regexp_replace(_col(glob), "([.\\\\+(){}|^$])", "\\\\$1"), "\\[(?=[^\\]]*\\z)", "\\\\[")
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(own, "\\[!", "[^"), "\\*", ".*"), "\\?", ".")
    return F.concat(F.lit("(?s)\\A(?:"), own, F.lit(")\\z")), F.regexp_extract(_col(glob), "^[^*?\\[]*", 0)


_END = "(\\.[^./]*)\\z"


def _without_classes(glob: Column | str) -> Column:
    """All from the first `[` to the last `]` as one `*`."""
    return F.regexp_replace(_col(glob), "(?s)\\[.*\\]", "*")


def glob_keys(glob: Column | str) -> Column:
    """What a path must have in common with a glob, as texts: see path_keys(). A glob without a wildcard is the path itself.

    Otherwise one is the last folder before the first wildcard, and the ending (`.md`) after the last one, `*` where it has
    none; the others are its words, literal texts with `/`, `.` or an end of the glob on both sides.
    """
    head, tail = F.regexp_extract(_col(glob), "^[^*?\\[]*", 0), F.regexp_extract(_col(glob), "[^*?\\[\\]]*\\z", 0)
    end = F.regexp_extract(tail, _END, 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(head, "(?s)^(.*)/[^/]*\\z", 1), F.lit("\0"), F.when(end == "", "*").otherwise(end))
    words = F.regexp_extract_all(_without_classes(glob), F.lit("(?:(?<=[/.])|\\A)[^/.*?\\[\\]]+(?=[/.]|\\z)"), F.lit(0))
    return F.when(head == _col(glob), F.array(F.concat(F.lit("="), head))).otherwise(F.array_distinct(F.concat(F.array(folder), F.transform(words, lambda w: F.concat(F.lit("w"), w)))))


def glob_middle(glob: Column | str) -> Column:
    """The longest literal text of a glob between two wildcards, empty if there is none."""
    parts = F.split(_without_classes(glob), "[*?]")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.aggregate(inner, F.lit(""), lambda most, x: F.when(F.length(x) > F.length(most), x).otherwise(most))


def path_keys(path: Column | str) -> Column:
    """The keys of all globs that may match a path: itself, each folder above it with its ending and with any, and its words."""
    parts = F.split(_col(path), "/")
    above = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    end = F.regexp_extract(_col(path), _END, 1)
    of = lambda end: F.flatten(F.transform(above, lambda a: F.array_distinct(F.array(F.concat(F.lit("/"), a, F.lit("\0*")), F.concat(F.lit("/"), a, F.lit("\0"), end)))))
    keys = _once(F.when(end == "", "*").otherwise(end), of)
    words = F.transform(F.array_distinct(F.filter(F.split(_col(path), "[/.]"), lambda w: w != "")), lambda w: F.concat(F.lit("w"), w))
    return F.concat(F.array(F.concat(F.lit("="), _col(path))), keys, words)


def parent(path: Column | str) -> Column:
    """The folder of a path, `.` at the top."""
    own = F.regexp_extract(_col(path), "(?s)^(.*)/[^/]*$", 1)
    return F.when(own == "", F.lit(".")).otherwise(own)


def name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def normal_path(path: Column | str) -> Column:
    """Without `.`, empty and `a/..` parts; parts that climb out stay as leading `..`."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    own = F.array_join(F.aggregate(F.split(F.translate(_col(path), "\\", "/"), "/"), F.array().cast("array<string>"), step), "/")
    return F.when(own == "", F.lit(".")).otherwise(own)


def escapes(path: Column | str) -> Column:
    own = normal_path(path)
    return (own == "..") | own.startswith("../") | _col(path).startswith("/")


def relative_path(path: Column | str, start: Column | str) -> Column:
    """path as seen from the folder start; both normal and from the same root."""
    a, b = (F.filter(F.split(x, "/"), lambda p: (p != ".") & (p != "")) for x in (_col(path), _col(start)))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.try_element_at(a, i) == F.try_element_at(b, i)), i).otherwise(n))
    up = F.array_repeat(F.lit(".."), F.size(b) - same)
    own = F.array_join(F.concat(up, F.slice(a, same + 1, F.size(a))), "/")
    return F.when(own == "", F.lit(".")).otherwise(own)


def repo_key(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_col(x), "\\.git$", ""), "^/+|/+$", ""))


def canonical_remote(url: Column | str) -> Column:
    """owner/repo of an https, ssh or scp-like remote; null for any other."""
    own = F.regexp_replace(F.trim(_col(url)), "\\.git$", "")
    found = F.regexp_extract(own, "^(?:(?:https?|ssh|git)://(?:[^@/]+@)?[^/:]+(?::\\d+)?/|[^@/\\s]+@[^:/\\s]+:)([^/\\s]+/[^/\\s]+?)/?$", 1)
    return F.nullif(found, F.lit(""))


def is_absolute_url(x: Column | str) -> Column:
    return _col(x).rlike("^[A-Za-z][A-Za-z0-9+.-]*:")


def url_path(x: Column | str) -> Column:
    """A path percent-encoded by its parts."""
    return F.array_join(F.transform(F.split(_col(x), "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def rstrip_chars(x: Column | str, chars: str) -> Column:
    """Without any of these characters at the end."""
    return F.regexp_replace(_col(x), "[" + re.escape(chars) + "]+$", "")


def unix_ends(content: Column | str) -> Column:
    """Bytes with CR LF as LF."""
    return F.replace(_col(content).cast("string"), F.lit("\r\n"), F.lit("\n")).cast("binary")
