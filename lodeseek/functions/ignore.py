"""Ignore policies: a subset of gitignore, compiled to column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EXTENSIONS

#: Directories that hold no documents of the user's.
NOISE = "node_modules .git .svn .hg Library Pods .build DerivedData venv .venv env __pycache__ .cache Caches .Trash vendor dist build .next target".split()


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    dir_only: bool


def _segment(glob: str) -> str:
    """A regular expression for one path segment: ``*``, ``?`` and classes; a malformed class is literal."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            body = i + 1 + (glob[i + 1 : i + 2] in ("!", "^"))
            end = glob.find("]", body + 1)
            if end < 0:
                out += r"\["
            else:
                inside = glob[body:end].replace("\\", "\\\\").replace("[", r"\[").replace("]", r"\]").replace("&&", r"&\&").replace("^", r"\^")
                out += ("[^/" if body > i + 1 else "[") + inside + "]"
                i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def parse(text: str) -> list[Rule]:
    """The rules of a policy text, in order; blank lines and comments are none."""
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        if negated or line.startswith(("\\#", "\\!")):
            line = line[1:]
        dir_only = line.endswith("/")
        line = re.sub("/+", "/", line).rstrip("/")
        anchored = "/" in line
        parts = [x for x in line.split("/") if x]
        if not parts:
            continue
        if not anchored:
            parts = ["**", *parts]
        body = ""
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part == "**":
                body += "(?:.*)" if last else "(?:[^/]+/)*"
            else:
                body += _segment(part) + ("" if last or (k == len(parts) - 2 and parts[-1] == "**") else "/")
        tail = "" if parts[-1] == "**" else "(?:/.*)?"
        if parts[-1] == "**" and len(parts) > 1:
            body = body[: -len("(?:.*)")] + "(?:/.*)?"
        rules.append(Rule(f"(?is)^/?{body}{tail}$", negated, dir_only))
    return rules


def ignored(path: Column, is_dir: Column, rules: list[Rule]) -> Column:
    """Whether the last rule that matches, if any, is not a negated one; rules for directories skip files."""
    if not rules:
        return F.lit(False)
    hits = F.array(*(F.when(path.rlike(r.regex) & (is_dir if r.dir_only else F.lit(True)), k) for k, r in enumerate(rules)))
    last = F.array_max(F.filter(hits, lambda x: x.isNotNull()))
    keeps = F.array(*(F.lit(not r.negated) for r in rules))
    return F.coalesce(F.get(keeps, last), F.lit(False))


def ancestors(path: Column) -> Column:
    """The directories above a path, from the root down."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def ignored_with_ancestors(path: Column, is_dir: Column, rules: list[Rule]) -> Column:
    depth = F.size(F.split(F.regexp_replace(path, "^/", ""), "/"))
    above = F.when(depth > 1, F.exists(ancestors(path), lambda a: ignored(a, F.lit(True), rules))).otherwise(F.lit(False))
    return above | ignored(path, is_dir, rules)


def synthesise(enabled_kinds: set[str] = frozenset(EXTENSIONS), disabled_extensions: set[str] = frozenset()) -> str:
    """The default policy: noise directories, the extensions of kinds that are off, and single extensions that are."""
    off = [k for k in EXTENSIONS if k not in enabled_kinds]
    of_kinds = {e for k in off for e in EXTENSIONS[k]}
    parts = [["# Folders without documents of one's own", *(f"{x}/" for x in NOISE)]]
    parts += [[f"# Kind: {k}", *(f"*.{e}" for e in sorted(EXTENSIONS[k]))] for k in off]
    single = sorted(set(disabled_extensions) - of_kinds)
    parts += [["# Extensions", *(f"*.{e}" for e in single)]] if single else []
    return "\n\n".join("\n".join(p) for p in parts) + "\n"


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def preview(files: DataFrame, rules: list[Rule], root: str = "/") -> DataFrame:
    """(kept, removed, samples, danger) that a policy would leave of the indexed files."""
    gone = ignored_with_ancestors(F.col("path"), F.lit(False), rules)
    out = files.select("path", gone.alias("gone")).agg(F.count_if(~F.col("gone")).alias("kept"), F.count_if("gone").alias("removed"))
    least = files.where(gone).select("path").orderBy("path").limit(12).agg(F.array_sort(F.collect_list("path")).alias("samples"))
    danger = F.when((F.col("removed") > 0) & (F.col("kept") == 0), "all").when(F.col("removed") * 2 >= F.col("kept") + F.col("removed"), F.when(F.col("removed") > 0, "half").otherwise("")).otherwise("")
    return out.crossJoin(F.broadcast(least)).withColumn("danger", danger)
