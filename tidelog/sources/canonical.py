"""The text that records of a container become, and the pattern that reads it back: both from one list of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.text import flattened, folded, padded

#: The time's layout and width, which is also the indent of continuations.
TIME, TIME_PATTERN, WIDTH = "yyyy-MM-dd HH:mm:ss.SSS", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}", 23
INDENT = " " * WIDTH


@dataclass(frozen=True)
class Slot:
    """A column between the time and the message. kind: number (right-aligned in width), letter (one of alphabet), word (one of words, in brackets), free (in brackets)."""

    name: str
    kind: str
    width: int = 0
    alphabet: str = ""
    words: tuple[str, ...] = ()
    brackets_inside: bool = False

    def pattern(self) -> str:
        group = {"number": r"\d+", "letter": f"[{self.alphabet}]", "word": "|".join(self.words), "free": ".*?" if self.brackets_inside else r"[^\]]*"}[self.kind]
        named = f"(?<{self.name}>{group})"
        return rf"\s+{named}" if self.kind == "number" else f" {named}" if self.kind == "letter" else rf" \[{named}\]"

    def opening(self) -> str:
        return " " if self.kind in ("number", "letter") else r" \["

    def column(self, value: Column) -> Column:
        if self.kind == "number":
            return F.concat(F.lit(" "), padded(value, self.width))
        if self.kind == "letter":
            return F.concat(F.lit(" "), value)
        return F.concat(F.lit(" ["), value if self.kind == "word" else flattened(value), F.lit("]"))

    def text(self, value: str) -> str:
        if self.kind == "number":
            return " " + value.rjust(self.width)
        if self.kind == "letter":
            return " " + value
        return f" [{value if self.kind == 'word' else value.replace(chr(10), ' ').replace(chr(13), ' ')}]"


@dataclass(frozen=True)
class Layout:
    """The slots of a line, checked: names differ, and a slot whose value may hold a bracket is followed by one that may not."""

    slots: tuple[Slot, ...]

    def __post_init__(self) -> None:
        names = [s.name for s in self.slots]
        if not names or len({*names}) < len(names) or {"ts", "message"} & {*names}:
            raise ValueError(f"slots need names of their own: {names}")
        for slot, after in zip(self.slots, [*self.slots[1:], None], strict=True):
            if slot.brackets_inside and (after is None or after.kind not in ("free", "word") or after.brackets_inside):
                raise ValueError(f"'{slot.name}' may hold a bracket, so the slot after it must be one that may not")

    def parse_pattern(self) -> str:
        return f"^(?<ts>{TIME_PATTERN}){''.join(s.pattern() for s in self.slots)} (?<message>.*)$"

    def opens_pattern(self) -> str:
        return f"^{TIME_PATTERN}{self.slots[0].opening()}"

    def continues_pattern(self) -> str:
        return f"^ {{{WIDTH}}}"

    def rendered(self, time: Column, values: dict[str, Column], message: Column, extras: Column | None = None) -> Column:
        """The entry's text; time is already written out. Every slot needs its value."""
        if missing := [s.name for s in self.slots if s.name not in values]:
            raise ValueError(f"no value for {', '.join(missing)}")
        line = F.concat(time, *(s.column(values[s.name]) for s in self.slots), F.lit(" "), folded(message, INDENT))
        if extras is None:
            return line
        return F.when(F.coalesce(extras, F.lit("")) != "", F.concat(line, F.lit("\n" + INDENT), flattened(extras))).otherwise(line)

    def written(self, time: str, values: dict[str, str], message: str, extras: str = "") -> str:
        """The same for one record, in Python."""
        head = time + "".join(s.text(values[s.name]) for s in self.slots) + " "
        body = ("\n" + INDENT).join(message.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
        return head + body + ("\n" + INDENT + extras.replace("\n", " ").replace("\r", " ") if extras else "")
