"""Path patterns with ``{name}`` wildcards: parsing on the driver, matching and filling in as Column expressions."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    """A pattern, constraint or template that can't be used."""


@dataclass(frozen=True)
class Pattern:
    """A parsed pattern: pieces are ("text", s) or ("wild", name)."""

    raw: str
    pieces: tuple[tuple[str, str], ...]

    @property
    def names(self) -> list[str]:
        """Wildcards in the order in which they first occur."""
        return list(dict.fromkeys(v for k, v in self.pieces if k == "wild"))

    def regex(self, constraints: dict[str, str] | None = None) -> str:
        """An anchored regular expression with a group for each occurrence; a wildcard without a constraint is one path
        segment or a part of it."""
        constraints = constraints or {}
        for name in set(constraints) & set(self.names):
            check_constraint(name, constraints[name])
        body = "".join(quote(v) if k == "text" else f"({no_groups(constraints.get(v, '[^/]+'))})" for k, v in self.pieces)
        return f"\\A{body}\\z"


_PIECE = re.compile(r"\{\{(?P<kept>.*?)\}\}|\{(?P<name>[^{}]*)\}|(?P<bad>[{}])|(?P<text>[^{}]+)", re.S)


def parse_pattern(raw: str) -> Pattern:
    """``{x}`` is a wildcard and ``{{x}}`` the text ``{x}``."""
    pieces: list[tuple[str, str]] = []
    for m in _PIECE.finditer(raw):
        if m["bad"]:
            raise PatternError(f"unmatched brace in {raw!r}")
        if m["name"] is None:
            text = m["text"] if m["text"] is not None else "{" + m["kept"] + "}"
            if pieces and pieces[-1][0] == "text":
                pieces[-1] = ("text", pieces[-1][1] + text)
            else:
                pieces.append(("text", text))
            continue
        name = m["name"]
        if not name:
            raise PatternError(f"empty wildcard in {raw!r}")
        if not re.fullmatch(r"\w+", name):
            raise PatternError(f"bad wildcard name {name!r} in {raw!r}")
        if pieces and pieces[-1][0] == "wild":
            raise PatternError(f"adjacent wildcards in {raw!r}")
        pieces.append(("wild", name))
    return Pattern(raw, tuple(pieces))


def quote(text: str) -> str:
    """A literal for Java's, Python's and RE2's regular expressions alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def no_groups(expression: str) -> str:
    """The expression with its own groups, numbered or named, made non-capturing, so that group numbers are the
    wildcards'; what is escaped or stands in a character class is left as it is."""
    out, at, inside = [], 0, False
    while at < len(expression):
        c = expression[at]
        if c == "\\":
            out.append(expression[at : at + 2])
            at += 2
            continue
        named = None if inside else re.match(r"\(\?P?<[A-Za-z_]\w*>", expression[at:])
        if inside:
            inside = c != "]" or expression[at - 1] == "[" or expression[at - 2 : at] == "[^"
        elif c == "[":
            inside = True
        if named:
            out.append("(?:")
            at += len(named[0])
            continue
        out.append("(?:" if c == "(" and not inside and expression[at + 1 : at + 2] != "?" else c)
        at += 1
    return "".join(out)


def compiled(pattern: Pattern, constraints: dict[str, str] | None = None, tail: str = "") -> re.Pattern:
    """:meth:`Pattern.regex` for the driver, where the end of a text is written otherwise; ``tail`` may follow it."""
    return re.compile(pattern.regex(constraints)[:-2] + tail + r"\Z")


def check_constraint(name: str, expression: str) -> None:
    """Look-around and back-references are refused: not every engine that reads the rules has them."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\(\?P=|\\[1-9]", expression):
        raise PatternError(f"constraint of {name!r} uses look-around or a back-reference")
    try:
        re.compile(no_groups(expression))
    except re.error as e:
        raise PatternError(f"constraint of {name!r}: {e}") from None


def resolve(pattern: Pattern, path: Column, constraints: dict[str, str] | None = None) -> Column:
    """The wildcards of a path as a map by name; null if it doesn't match, or if one wildcard would have two values."""
    rx = pattern.regex(constraints)
    groups = [v for k, v in pattern.pieces if k == "wild"]
    values = {i: F.regexp_extract(path, rx, i + 1) for i in range(len(groups))}
    fits = path.rlike(rx)
    for i, name in enumerate(groups):
        first = groups.index(name)
        if first != i:
            fits = fits & (values[i] == values[first])
    pairs = [x for name in sorted(set(groups)) for x in (F.lit(name), values[groups.index(name)])]
    found = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(fits, found)


def interpolate(pattern: Pattern, wildcards: Column) -> Column:
    """The path of a map of wildcards; null if one is missing."""
    parts = [F.lit(v) if k == "text" else F.try_element_at(wildcards, F.lit(v)) for k, v in pattern.pieces]
    return F.concat(*parts) if parts else F.lit("")


def fill(pattern: Pattern, wildcards: dict[str, str]) -> str:
    """:func:`interpolate` for one set of wildcards on the driver."""
    missing = [n for n in pattern.names if n not in wildcards]
    if missing:
        raise PatternError(f"no value for {missing[0]!r} in {pattern.raw!r}")
    return "".join(v if k == "text" else wildcards[v] for k, v in pattern.pieces)


def match(pattern: Pattern, path: str, constraints: dict[str, str] | None = None) -> dict[str, str] | None:
    """:func:`resolve` for one path on the driver."""
    m = compiled(pattern, constraints).match(path)
    if not m:
        return None
    found: dict[str, str] = {}
    for name, value in zip((v for k, v in pattern.pieces if k == "wild"), m.groups(), strict=True):
        if found.setdefault(name, value) != value:
            return None
    return dict(sorted(found.items()))


def within(constraints: dict[str, str], wildcards: Column) -> Column:
    """Whether each constrained wildcard that is there matches its constraint in full."""
    fine = F.lit(True)
    for name, expression in sorted(constraints.items()):
        check_constraint(name, expression)
        value = F.try_element_at(wildcards, F.lit(name))
        fine = fine & F.coalesce(value.rlike(f"\\A(?:{expression})\\z"), F.lit(True))
    return fine


def job_id(rule: Column, wildcards: Column) -> Column:
    """``rule-v1-v2`` over the values by sorted name, with % and - escaped."""
    values = F.transform(F.array_sort(F.map_entries(wildcards)), lambda e: F.replace(F.replace(e["value"], F.lit("%"), F.lit("%25")), F.lit("-"), F.lit("%2D")))
    return F.when(F.size(wildcards) > 0, F.concat(rule, F.lit("-"), F.array_join(values, "-"))).otherwise(rule)


def job_id_of(rule: str, wildcards: dict[str, str]) -> str:
    return "-".join([rule, *(v.replace("%", "%25").replace("-", "%2D") for _, v in sorted(wildcards.items()))])


def with_tags(tags: Column, wildcards: Column) -> Column:
    """Explicit tags win, wildcard values fill in."""
    return F.map_zip_with(tags, wildcards, lambda _, a, b: F.coalesce(a, b))


def config_substituted(text: str, config: dict[str, list[str] | str], strict: bool = True) -> str:
    """``{config.X}`` replaced by a scalar; an unknown or list key is an error, or stays where not ``strict``."""

    def value(m: re.Match) -> str:
        found = config.get(m[1])
        if isinstance(found, str):
            return found
        if strict:
            raise PatternError(f"no scalar config value {m[1]!r}")
        return m[0]

    return re.sub(r"\{config\.([A-Za-z0-9_]+)\}", value, text)


def command(
    template: str,
    inputs: list[tuple[str | None, str]],
    outputs: list[tuple[str | None, str]],
    wildcards: dict[str, str],
    params: dict[str, str] | None = None,
    config: dict[str, str] | None = None,
    resources: dict[str, str] | None = None,
    log: str | None = None,
) -> str:
    """A command template filled in, from the most specific form to the bare wildcard: named and numbered files,
    wildcards, params, config, log, threads, resources, all files, ``{x}``."""
    resources = resources or {}
    steps: list[tuple[str, str]] = []
    for kind, files in (("input", inputs), ("output", outputs)):
        for name in dict.fromkeys(n for n, _ in files if n):
            steps.append((f"{{{kind}.{name}}}", " ".join(p for n, p in files if n == name)))
        steps += [(f"{{{kind}[{i}]}}", p) for i, (_, p) in enumerate(files)]
    steps += [(f"{{wildcards.{k}}}", v) for k, v in wildcards.items()]
    steps += [(f"{{params.{k}}}", v) for k, v in (params or {}).items()]
    steps += [(f"{{config.{k}}}", v) for k, v in (config or {}).items()]
    steps += [("{log}", log)] if log is not None else []
    steps += [("{threads}", resources["cpu"])] if "cpu" in resources else []
    steps += [(f"{{resources.{k}}}", v) for k, v in resources.items()]
    steps += [(f"{{{kind}}}", " ".join(p for _, p in files)) for kind, files in (("input", inputs), ("output", outputs))]
    steps += [(f"{{{k}}}", v) for k, v in wildcards.items()]
    for what, value in steps:
        template = template.replace(what, value)
    return template


def normal_path(path: str, base: str | None = None) -> str:
    """A path without ``.`` and ``..`` steps, relative to ``base`` if it lies in it; symbolic links aren't followed."""
    clean = posixpath.normpath(path) if path else "."
    if base:
        root = posixpath.normpath(base)
        if clean.startswith(root.rstrip("/") + "/"):
            return clean[len(root.rstrip("/")) + 1 :]
    return clean
