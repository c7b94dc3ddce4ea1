"""Format declarations: TOML files, checked as a whole, and the registry that holds them."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.patterns import Groups, LinePredicate, PatternError, continuation_test, java_error, opening_test
from tidelog.functions.timestamps import FormatError, TimestampFormat, local_zone
from tidelog.plans.compiler import Facet

BUNDLED = Path(__file__).parent / "bundled"
SUFFIX = ".logprofile.toml"
USER_FOLDER = Path.home() / ".tidelog" / "profiles"

#: The keys of a profile (fixed values): any other key is an error.
_KEYS = {
    "": {"name", "description", "priority", "detect", "entry", "parse", "fields", "markers"},
    "detect": {"filename", "sample", "min_match"},
    "entry": {"opens", "continues", "strip_continuation_indent"},
    "parse": {"regex"},
    "fields": {"role", "label", "format", "zone", "assume_year", "order", "labels", "facet"},
    "markers": {"regex", "role"},
}
_ROLES, _MARKER_ROLES, _MODES = ("timestamp", "level", "facet", "message"), ("section", "notice"), ("auto", "always", "never")


class ProfileError(ValueError):
    """Everything that is wrong with a profile, at once."""

    def __init__(self, name: str, problems: Sequence[str]) -> None:
        self.profile, self.problems = name, list(problems)
        super().__init__(f"profile '{name}': " + "; ".join(problems))


@dataclass(frozen=True)
class Marker:
    pattern: str
    role: str


@dataclass
class Profile:
    """A format that can be applied."""

    name: str
    description: str
    priority: int
    filename: str | None
    sample: int
    min_match: float
    groups: Groups
    time_group: str
    time: TimestampFormat
    level_group: str | None
    levels: list[str]
    level_labels: dict[str, str]
    facets: list[Facet]
    message_group: str | None
    opens: LinePredicate | None
    continues: LinePredicate | None
    strip_indent: bool
    markers: list[Marker]
    warnings: list[str] = field(default_factory=list)

    def parses(self, line: Column) -> Column:
        """Whether the line opens an entry, but for its time."""
        full = line.rlike(self.groups.whole())
        return self.opens.column(line) & full if self.opens else full

    def level_ordinal(self, token: Column) -> Column:
        """The token's place in the scale, case and all; -1 for others and for none."""
        if not self.levels:
            return F.lit(-1).cast("tinyint")
        return F.coalesce(F.array_position(F.array(*map(F.lit, self.levels)), token) - 1, F.lit(-1)).cast("tinyint")

    def level_name(self, ordinal: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.levels)), ordinal.cast("int")) if self.levels else F.lit(None).cast("string")

    def marks(self, line: Column) -> Column:
        """The role of the first marker that the line has, or null."""
        out = F.lit(None).cast("string")
        for marker in reversed(self.markers):
            out = F.when(line.rlike(marker.pattern), F.lit(marker.role)).otherwise(out)
        return out

    def accounts(self, line: Column) -> Column:
        """Whether detection counts the line as explained: blank, opening, continuing or marked, whatever stands before it."""
        out = (line == "") | self.parses(line)
        if self.continues:
            out = out | self.continues.column(line)
        return out | self.marks(line).isNotNull()


def _strict(raw: dict, problems: list[str]) -> None:
    for section, part in [("", raw), *((k, raw.get(k, {})) for k in ("detect", "entry", "parse")), *(("fields", x) for x in raw.get("fields", {}).values()), *(("markers", x) for x in raw.get("markers", []))]:
        problems += [f"unknown key '{f'{section}.' if section else ''}{k}'" for k in part if k not in _KEYS[section]]


def compile_profile(source: str | dict, zone: str | None = None, now: datetime | None = None) -> Profile:
    """A profile from TOML text or its tables. zone: what 'local' means; now: what decides the year of formats without one."""
    try:
        raw = tomllib.loads(source) if isinstance(source, str) else source
    except tomllib.TOMLDecodeError as error:
        raise ProfileError("?", [str(error)]) from error
    problems: list[str] = []
    warnings: list[str] = []
    local = zone or local_zone()
    name = raw.get("name") or "?"
    if "name" not in raw:
        problems.append("'name' is missing")
    _strict(raw, problems)
    detect, entry, fields = raw.get("detect", {}), raw.get("entry", {}), raw.get("fields", {})
    regex = raw.get("parse", {}).get("regex")
    groups = Groups("")
    if regex is None:
        problems.append("'parse.regex' is missing")
    elif error := java_error(regex):
        problems.append(f"parse.regex does not compile: {error}")
    else:
        try:
            groups = Groups.of(regex)
        except PatternError as error:
            problems.append(str(error))
        problems += [f"field '{f}' names no group of the pattern" for f in fields if f not in groups.numbers]
        problems += [f"group '{g}' has no field" for g in groups.numbers if g not in fields]
    by_role: dict[str, list[str]] = {r: [] for r in _ROLES}
    for f, spec in fields.items():
        if spec.get("role") in by_role:
            by_role[spec["role"]].append(f)
        else:
            problems.append(f"field '{f}' has no role out of {', '.join(_ROLES)}")
        if spec.get("facet", "auto") not in _MODES:
            problems.append(f"field '{f}': facet is one of {', '.join(_MODES)}")
    if len(by_role["timestamp"]) != 1:
        problems.append(f"a profile has one timestamp, this one {len(by_role['timestamp'])}")
    for role in ("level", "message"):
        if len(by_role[role]) > 1:
            problems.append(f"a profile has one {role} at most, this one {len(by_role[role])}")
    time = None
    for f in by_role["timestamp"][:1]:
        spec = fields[f]
        if "format" not in spec:
            problems.append(f"field '{f}' needs a format")
            continue
        try:
            time = TimestampFormat.compile(spec["format"], spec.get("zone"), spec.get("assume_year"), local, now)
        except FormatError as error:
            problems.append(f"field '{f}': {error}")
            continue
        if time.assumes_year and "assume_year" not in spec:
            warnings.append(f"'{spec['format']}' has no year; {time.year} is assumed")
        if not time.is_fixed:
            warnings.append(f"'{spec['format']}' is not of fixed width and reads slower")
    levels: list[str] = []
    for f in by_role["level"][:1]:
        levels = fields[f].get("order", [])
        if not levels:
            problems.append(f"field '{f}' needs the order of its levels")
        elif len({*levels}) < len(levels):
            problems.append(f"field '{f}' lists a level twice")
    tests: dict[str, str | None] = {"entry.opens": entry.get("opens"), "entry.continues": entry.get("continues"), "detect.filename": detect.get("filename")}
    tests |= {f"markers[{k}]": m.get("regex") for k, m in enumerate(raw.get("markers", []))}
    for key, pattern in tests.items():
        if pattern is not None and (error := java_error(pattern)):
            problems.append(f"{key} does not compile: {error}")
    for k, m in enumerate(raw.get("markers", [])):
        if m.get("role") not in _MARKER_ROLES or "regex" not in m:
            problems.append(f"markers[{k}] needs a regex and a role out of {', '.join(_MARKER_ROLES)}")
    if problems:
        raise ProfileError(name, problems)
    opens = opening_test(entry["opens"]) if "opens" in entry else None
    if "opens" in entry and opens is None:
        warnings.append("entry.opens begins with nothing that can be tested, so it is not used")
    continues = continuation_test(entry["continues"]) if "continues" in entry else None
    if continues is None:
        warnings.append("without entry.continues every line that is no entry is unrecognised")
    elif not continues.cheap:
        warnings.append("entry.continues is no literal start and reads slower")
    level = by_role["level"][0] if by_role["level"] else None
    return Profile(
        name, raw.get("description", ""), raw.get("priority", 0), detect.get("filename"), detect.get("sample", 200), detect.get("min_match", 0.8), groups,
        by_role["timestamp"][0], time, level, levels, fields[level].get("labels", {}) if level else {},
        [Facet(f, fields[f].get("label", f), fields[f].get("facet", "auto")) for f in by_role["facet"]], by_role["message"][0] if by_role["message"] else None,
        opens, continues, entry.get("strip_continuation_indent", False), [Marker(m["regex"], m["role"]) for m in raw.get("markers", [])], warnings,
    )


@dataclass
class Registry:
    """Profiles in order, and the files that could not be used."""

    profiles: list[Profile]
    problems: list[str] = field(default_factory=list)

    def __add__(self, other: Registry) -> Registry:
        return Registry(self.profiles + other.profiles, self.problems + other.problems)

    def named(self, name: str) -> Profile | None:
        return next((p for p in self.profiles if p.name == name), None)

    def excluding(self, names: Iterable[str]) -> Registry:
        away = {*names}
        return Registry([p for p in self.profiles if p.name not in away], self.problems)

    @classmethod
    def of_folder(cls, folder: Path, zone: str | None = None, now: datetime | None = None) -> Registry:
        """The profiles of a folder by file name; a broken one is told, the others are used."""
        out = cls([])
        for path in sorted(Path(folder).glob(f"*{SUFFIX}")) if Path(folder).is_dir() else []:
            try:
                out.profiles.append(compile_profile(path.read_text("utf-8"), zone, now))
            except (ProfileError, OSError, UnicodeDecodeError) as error:
                out.problems.append(f"{path.name}: {error}")
        return out

    @classmethod
    def bundled(cls, zone: str | None = None, now: datetime | None = None) -> Registry:
        return cls.of_folder(BUNDLED, zone, now)

    @classmethod
    def bundled_plus_user(cls, folder: Path | None = None, zone: str | None = None, now: datetime | None = None) -> Registry:
        return cls.bundled(zone, now) + cls.of_folder(folder or USER_FOLDER, zone, now)


def bundled_names() -> list[str]:
    return sorted(p.name for p in BUNDLED.glob(f"*{SUFFIX}"))


def bundled_source(file_name: str) -> str:
    """The text of a bundled profile, to start one's own from."""
    return (BUNDLED / file_name).read_text("utf-8")


def copy_template(file_name: str, folder: Path) -> Path:
    """A copy of a bundled profile under a name that is free in the folder: -copy, -copy-2 and so on."""
    base = file_name.removesuffix(SUFFIX)
    folder.mkdir(parents=True, exist_ok=True)
    n = 1
    while (path := folder / f"{base}-copy{'' if n == 1 else f'-{n}'}{SUFFIX}").exists():
        n += 1
    text = re.sub(r'(?m)^name(\s*)=(\s*)"[^"]*"', lambda m: f'name{m[1]}={m[2]}"{path.name.removesuffix(SUFFIX)}"', bundled_source(file_name), count=1)
    path.write_text(text, "utf-8")
    return path
