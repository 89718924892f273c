"""Path patterns compiled to Columns.

Styles: pf full path, pp path prefix, fm fnmatch (``*`` crosses ``/``), sh shell
(``*`` stops at ``/``, ``**/`` crosses, ``{a,b}`` alternatives), re regular
expression. A rule list is one ``when`` chain, first match wins; full-path rules
are tried before all others. Archive names have the styles id, sh and re, which
match the whole name.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLES = ("fm", "sh", "pp", "pf", "re")
INCLUDE, EXCLUDE, EXCLUDE_NO_RECURSE = "+", "-", "!"


def _quote(c: str) -> str:
    return "\\" + c if c in r"\.+*?()|[]{}^$-&~#" else c


def _class(body: str, shell: bool) -> str:
    """Inside of a bracket expression as a class that Java and RE2 read alike."""
    negated = body.startswith("!")
    if negated:
        body = body[1:]
    if not body:
        return "."
    out, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high or shell:
                out.append(f"{_quote(low)}-{_quote(high)}")
            i += 3
        else:
            out.append(_quote(body[i]))
            i += 1
    if not out:
        return "[\\s\\S]" if negated else "[^\\s\\S]"
    return f"[{'^' if negated else ''}{''.join(out)}]"


def _bracket(pattern: str, i: int) -> int:
    """Index of the ``]`` that ends the class opened before i, or -1."""
    j = i + (pattern[i : i + 1] == "!")
    j += pattern[j : j + 1] == "]"
    return pattern.find("]", j)


def fnmatch_regex(pattern: str) -> str:
    """Whole-string regular expression of an fnmatch pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := _bracket(pattern, i)) >= 0:
            out.append(_class(pattern[i:end], shell=False))
            i = end + 1
        else:
            out.append(_quote(c))
    return rf"(?s)\A{''.join(out)}\z"


def _alternatives(pattern: str) -> dict[int, str]:
    """Places of braces and commas that stand for a group: index -> regular expression syntax."""
    stack: list[tuple[int, list[int]]] = []
    out: dict[int, str] = {}
    for i, c in enumerate(pattern):
        escaped = i > 0 and pattern[i - 1] == "\\"
        if escaped:
            continue
        if c == "{":
            stack.append((i, []))
        elif c == "," and stack:
            for _, commas in stack:
                commas.append(i)
        elif c == "}" and stack:
            opened, commas = stack.pop()
            if commas:
                out[opened], out[i] = "(", ")"
                out.update(dict.fromkeys(commas, "|"))
    return out


def shell_regex(pattern: str, end: str = r"\z") -> str:
    """Regular expression of a shell pattern, anchored at its start."""
    groups = _alternatives(pattern)
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if i - 1 in groups:
            out.append(groups[i - 1])
        elif pattern.startswith("**/", i - 1):
            out.append("(?:[^/]*/)*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (stop := _bracket(pattern, i)) >= 0:
            out.append(_class(pattern[i:stop], shell=True))
            i = stop + 1
        elif c == "\\" and pattern[i : i + 1] in ("(", "|", ")") and i < len(pattern):
            out.append(_quote(pattern[i]))
            i += 1
        elif c in "(|)":
            out.append(c)
        else:
            out.append(_quote(c))
    return rf"(?ms)\A{''.join(out)}{end}"


def _clean(path: str) -> str:
    cleaned = posixpath.normpath(path) if path else "."
    return cleaned[1:] if cleaned.startswith("//") else cleaned


def path_regex(style: str, pattern: str) -> str:
    """The expression that fm, sh and re patterns search for (fm and sh in path + '/')."""
    if style == "re":
        return pattern
    rest = "/*" if style == "fm" else "/**/*"
    whole = _clean(pattern)
    expr = whole.removesuffix("/") + rest + "/" if pattern.endswith("/") else whole + rest
    expr = expr.removeprefix("/")
    return fnmatch_regex(expr) if style == "fm" else shell_regex(expr, "")


def matches(path: Column, style: str, pattern: str) -> Column:
    """Whether a path matches one pattern."""
    if style == "pf":
        return path == _clean(pattern).removeprefix("/")
    if style == "pp":
        return F.concat(path, F.lit("/")).startswith((_clean(pattern).removesuffix("/") + "/").removeprefix("/"))
    if style in ("fm", "sh"):
        return F.concat(path, F.lit("/")).rlike(path_regex(style, pattern))
    if style == "re":
        return path.rlike(pattern)
    raise ValueError(f"unknown pattern style {style!r}")


def parse(text: str, fallback: str) -> tuple[str, str]:
    """(style, pattern) of a pattern with an optional two-letter style prefix."""
    if re.match(r"[A-Za-z0-9]{2}:", text):
        return text[:2], text[3:]
    return fallback, text


@dataclass(frozen=True)
class Rule:
    cmd: str
    style: str
    pattern: str

    @classmethod
    def read(cls, line: str, fallback: str = "sh") -> Rule:
        """A rule such as ``- sh:**/*.tmp``."""
        line = line.strip()
        if not line or line[0] not in "+-!":
            raise ValueError(f"{line!r} is no rule")
        return cls(line[0], *parse(line[1:].strip(), fallback))


def read_rules(lines: Sequence[str], fallback: str = "sh") -> tuple[list[Rule], list[str]]:
    """(rules, roots) of a pattern file: # comments, R roots, P changes the style without prefix."""
    rules, roots = [], []
    for raw in lines:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line[:2] == "R ":
            roots.append(line[2:].strip())
        elif line[:2] == "P ":
            fallback = line[2:].strip()
            if fallback not in STYLES:
                raise ValueError(f"unknown pattern style {fallback!r}")
        else:
            rules.append(Rule.read(line, fallback))
    return rules, roots


def read_excludes(lines: Sequence[str], fallback: str = "fm") -> list[Rule]:
    """One exclude pattern per line."""
    return [Rule(EXCLUDE, *parse(x.strip(), fallback)) for x in lines if x.strip() and not x.strip().startswith("#")]


def included(path: Column, rules: Sequence[Rule], include_paths: Sequence[str] = ()) -> Column:
    """Whether a path passes a rule list; positional include paths turn the fallback to exclude."""
    rules = [Rule(INCLUDE, *parse(p, "pp")) for p in include_paths] + list(rules)
    exact: dict[str, bool] = {}
    for rule in rules:
        if rule.style == "pf":
            exact.setdefault(_clean(rule.pattern).removeprefix("/"), rule.cmd == INCLUDE)
    chain = None
    for verdict in (True, False):
        own = [p for p, v in exact.items() if v is verdict]
        if own:
            chain = (F.when if chain is None else chain.when)(path.isin(own), F.lit(verdict))
    for rule in rules:
        if rule.style != "pf":
            chain = (F.when if chain is None else chain.when)(matches(path, rule.style, rule.pattern), F.lit(rule.cmd == INCLUDE))
    fallback = F.lit(not include_paths)
    return fallback if chain is None else chain.otherwise(fallback)


def unmatched(paths: DataFrame, include_paths: Sequence[str], path: str = "path") -> DataFrame:
    """pattern: positional include paths that no row matches, counted in one pass."""
    counts = paths.agg(*[F.count_if(matches(F.col(path), *parse(p, "pp"))).alias(str(i)) for i, p in enumerate(include_paths)])
    pairs = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(str(i)).alias("n")) for i, p in enumerate(include_paths)])
    return counts.select(F.explode(pairs).alias("x")).where("x.n = 0").select("x.pattern")


def name_regex(pattern: str) -> str:
    """Whole-name expression of an archive pattern: id: (default), sh: or re:."""
    if pattern.startswith("sh:"):
        return rf"\A(?:{shell_regex(pattern[3:], '').removeprefix('(?ms)').removeprefix(chr(92) + 'A')})\z"
    if pattern.startswith("re:"):
        return rf"\A(?:{pattern[3:]})\z"
    return rf"\A(?:{''.join(map(_quote, pattern.removeprefix('id:')))})\z"


def excluded_by_tag(items: DataFrame, tag_names: Sequence[str], keep_tags: bool = False) -> DataFrame:
    """Items not under a directory that holds one of the marker files; optionally the directory and markers stay."""
    base, parent = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"/?[^/]*$", "")
    tagged = items.where(base.isin(list(tag_names))).select(parent.alias("dir")).distinct()
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    hit = items.select("path", F.explode(above).alias("dir")).join(tagged, "dir", "left_semi")
    gone = hit
    if keep_tags:
        gone = hit.where((F.col("path") != F.col("dir")) & ~((parent == F.col("dir")) & base.isin(list(tag_names))))
    return items.join(gone.select("path").distinct(), "path", "left_anti")


NODUMP = 0x1


def excluded_by_attribute(xattrs: Column, flags: Column) -> Column:
    """nodump flag, or an extended attribute that asks to be left out."""
    robots = F.coalesce(xattrs["user.xdg.robots.backup"].cast("string") == "false", F.lit(False))
    excluded = F.coalesce(F.map_contains_key(xattrs, "com.apple.metadata:com_apple_backup_excludeItem"), F.lit(False))
    return robots | excluded | (F.coalesce(flags.bitwiseAND(F.lit(NODUMP)), F.lit(0)) != 0)
