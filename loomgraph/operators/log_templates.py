"""Log lines of many programs into one row per entry.

A fixed-depth template tree does the parsing.  A line is masked: times, levels,
numbers, tags, program names and key=value pairs become classes.  The tree routes
a masked line by its number of tokens and its leading tokens to a leaf, where it
joins the most similar template or founds one; positions at which merged lines
differ become wildcards.  Lines are masked and kept in templates whole, however long.
Every partition grows a tree over all of its lines, another one where its templates
take HELD tokens, and each line keeps its template's number and the values of its
leading tokens.

Which positions hold time, level and component is inferred from the templates of
all trees: from the classes a template begins with, from what encloses a position,
and, where that leaves two readings, from the lines that templates of one kind have.
Only the kinds of fronts reach the driver, which have no words of messages in them.
A line's fields are then read at its template's positions.

Entries are put together without gathering a run in one task: lines are windowed
in blocks of BLOCK line numbers, the last entry start of each block is carried to
the blocks behind it, and entries are aggregated by (run, first line).
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed, parallel

DEPTH = 3
SIMILARITY = 0.5
CHILDREN = 48
TEMPLATES = 48
BLOCK = 65_536
#: Tokens of templates after which a partition goes on with another tree, and characters of lines remembered or templates sent at once.
HELD = 2_000_000
SENT = 1 << 24
#: The year of times that state none, where a line has no time of receipt.
YEAR = 2026

# Level words and what they are called here.
LEVELS = {
    "trace": "TRACE", "finest": "TRACE", "finer": "TRACE", "verbose": "TRACE",
    "debug": "DEBUG", "fine": "DEBUG", "dbg": "DEBUG",
    "info": "INFO", "notice": "INFO", "information": "INFO",
    "warn": "WARN", "warning": "WARN",
    "error": "ERROR", "err": "ERROR", "severe": "ERROR",
    "fatal": "FATAL", "critical": "FATAL", "crit": "FATAL", "emerg": "FATAL", "alert": "FATAL", "panic": "FATAL",
}
LETTERS = {"T": "TRACE", "V": "TRACE", "D": "DEBUG", "I": "INFO", "N": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL"}
SYSLOG = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
#: Names of JSON fields, and of key=value pairs at a line's front, by what they hold.
TIME_KEYS = ("timestamp", "@timestamp", "ts", "time", "datetime", "date")
LEVEL_KEYS = ("level", "lvl", "severity", "loglevel", "log.level")
COMPONENT_KEYS = ("component", "logger", "target", "module", "name", "program", "file", "tag")

_ANSI = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]")
_ZONE = r"(?P<zone>Z|z|UTC|GMT|[+-]\d\d:?\d\d)?"
_TIMES = {
    "iso": r"(?P<y>\d{4})-(?P<mo>\d\d)-(?P<d>\d\d)(?P<sep>[T ])(?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:(?P<point>[.,])(?P<f>\d{1,9}))?(?: ?" + _ZONE + r")(?![\w:])",
    "slash": r"(?P<y>\d{4})/(?P<mo>\d\d)/(?P<d>\d\d)(?P<sep> )(?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:(?P<point>[.,])(?P<f>\d{1,9}))?(?: ?" + _ZONE + r")(?![\w:])",
    "dmy": r"(?P<d>\d{1,2})[-/ ](?P<mon>[A-Z][a-z]{2})[-/ ](?P<y>\d{4})[ :](?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:(?P<point>[.,])(?P<f>\d{1,9}))?(?: ?" + _ZONE + r")(?![\w:])",
    "syslog": r"(?P<mon>[A-Z][a-z]{2}) (?P<d>[ \d]\d) (?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:(?P<point>[.,])(?P<f>\d{1,9}))?(?![\w:])",
    "epoch": r"(?P<ms>\d{13})(?=\||\b)(?![.:\-/])",
}
_TIME = {k: re.compile(v) for k, v in _TIMES.items()}
_GLOG = re.compile(r"(?P<lv>[TVDIWEFC])(?P<mo>\d\d)(?P<d>\d\d) (?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:\.(?P<f>\d{1,9}))?(?![\w:])")
_PRI = re.compile(r"<(\d{1,3})>(1 )?")
_LEVEL_WORD = re.compile(r"(?i)(" + "|".join(sorted(LEVELS, key=len, reverse=True)) + r")(?![\w.\-/])")
_TAGGED = re.compile(r"(##)?\[([^\[\]]+)\]")
_TAG = re.compile(r"[A-Za-z][\w.:/\-]*")
_PROGRAM = re.compile(r"([A-Za-z][\w./\-]*)\[(\d+)\]:?(?=\s|$)")
_FILE = re.compile(r"([\w./\-]+\.\w+):(\d+)\](?=\s|$)")
_PAIR = re.compile(r"(@?[A-Za-z][\w.]*)=(\"(?:[^\"\\]|\\.)*\"|[^\s,;]*)[,;]?")
_NEXT_PAIR = re.compile(r"[ \t]*" + _PAIR.pattern)
_NUMBER = re.compile(r"[-+]?\d[\d.,]*(?:%|[a-zµμ]{1,2})?[.,;:]?$")
_DIGITS = re.compile(r"\d+")

_REPO = re.compile(r"(?<![\w.@-])repo=(\"[^\"]*\"|[^\s,;\"')\]}]+)")
_CWE = re.compile(r"(?<![\w.@-])cwe=\"?(?:cwe-?)?(\d+)(?![\w.])", re.IGNORECASE)
_ENGINE = re.compile(r"(?<![\w.@-])engine=\"?(\d+)(?:\.(\d+))?(ns|us|µs|μs|ms|s)(?!\w)")
_NODES = re.compile(r"(?<![\w.@-])nodes=\"?(\d+)(?![\w.])")
_UNIT = {"s": 6, "ms": 3, "us": 0, "µs": 0, "μs": 0, "ns": -3}
_FRONT_TOKENS = 7


def _year(received: tuple[int, int] | None, month: int, day: int) -> int:
    """The year of a day that states none: the one nearest before the (year, day of the year) of receipt, with two days' grace."""
    if received is None:
        return YEAR
    year, at = received
    ahead = datetime(2000, month, day).timetuple().tm_yday - at
    return year - 1 if ahead > 2 else year + 1 if ahead < -362 else year


def _utc(m: re.Match, received: tuple[int, int] | None = None) -> str:
    """A matched time as UTC text, cut to milliseconds; '' where it names no real time."""
    g = m.groupdict()
    try:
        if g.get("ms"):
            at = datetime(1970, 1, 1) + timedelta(milliseconds=int(g["ms"]))
        else:
            month = MONTHS[g["mon"].lower()] if g.get("mon") else int(g["mo"])
            at = datetime(int(g.get("y") or _year(received, month, int(g["d"]))), month, int(g["d"]), int(g["h"]), int(g["mi"]), min(int(g["s"]), 59), int((g.get("f") or "0").ljust(6, "0")[:6]))
            zone = g.get("zone") or ""
            if zone[:1] in ("+", "-"):
                shift = timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
                at = at - shift if zone[0] == "+" else at + shift
    except (ValueError, KeyError, OverflowError):
        return ""
    return at.strftime("%Y-%m-%d %H:%M:%S.") + f"{at.microsecond // 1000:03d}"


def _any_time(value: object) -> str:
    """A time in a JSON field or key=value pair: text, or a number of seconds or milliseconds."""
    if isinstance(value, bool) or value is None:
        return ""
    if isinstance(value, (int, float)):
        ms = int(value) if abs(value) >= 1e11 else int(value * 1000)
        at = datetime.fromtimestamp(ms // 1000, timezone.utc).replace(microsecond=ms % 1000 * 1000) if 0 <= ms < 4e12 else None
        return at.strftime("%Y-%m-%d %H:%M:%S.") + f"{at.microsecond // 1000:03d}" if at else ""
    text = str(value).strip()
    for pattern in _TIME.values():
        if m := pattern.match(text):
            return _utc(m)
    return _any_time(float(text)) if re.fullmatch(r"\d{10}(?:\.\d+)?", text) else ""


def _level(word: object) -> str:
    return LEVELS.get(str(word).strip().lower(), "")


def _scan(line: str, limit: int, parts: bool = False) -> tuple[list[str], list[str], int]:
    """The classes of a line's leading tokens, what each stands for, and where they end; with `parts` only as far as parts of a front go."""
    classes: list[str] = []
    values: list[str] = []
    at, size = 0, len(line)

    def add(kind: str, value: str) -> None:
        classes.append(kind)
        values.append(value)

    if m := _PRI.match(line):
        add("<PRI5>" if m[2] else "<PRI3>", m[1])
        at = m.end()
    if m := _GLOG.match(line, at):
        add("<GLOG>", m[0])
        at = m.end()
    if line.startswith("[", at):
        for kind in ("iso", "slash", "dmy"):
            if m := _TIME[kind].match(line, at + 1):
                add("[", "[")
                at += 1
                break
    seen_time = False
    while at < size and len(classes) < limit and not (parts and not all(_part_at(classes, i) for i in range(max(len(classes) - 3, 0), len(classes)))):
        c = line[at]
        if c in " \t":
            at += 1
            continue
        if not seen_time and (c.isdigit() or c.isupper()):
            for kind, pattern in _TIME.items():
                if m := pattern.match(line, at):
                    # How a time is written tells layouts apart.
                    form = kind if kind != "iso" else ("isoT" if m["sep"] == "T" else "iso") + (m["point"] or "") + ("+" if (m["zone"] or "")[:1] in ("+", "-") else "")
                    add(f"<TIME:{form}>", m[0])
                    at, seen_time = m.end(), True
                    break
            else:
                m = None
            if m:
                continue
        if c == "|":
            add("|", "|")
            at += 1
            continue
        if c in "[#" and (m := _TAGGED.match(line, at)):
            text = m[2].strip() or " "
            if _level(text):
                add(f"{m[1] or ''}[<LEVEL>]", text)
                at = m.end()
                continue
            if not m[1]:
                add("[<TAG>]" if _TAG.fullmatch(text) else "[<TEXT>]", text)
                at = m.end()
                continue
        # Outside of brackets and fields only capitals are a level: `notice:` is a word like any other.
        if (m := _LEVEL_WORD.match(line, at)) and m[1].isupper():
            add("<LEVEL>", m[1])
            at = m.end()
            if line.startswith(":", at):
                add(":", ":")
                at += 1
            continue
        if classes and classes[-1] == "|" and c in LETTERS and line.startswith("|", at + 1):
            add("<LETTER>", c)
            at += 1
            continue
        if m := _PROGRAM.match(line, at):
            add("<PROGRAM>", m[1])
            at = m.end()
            continue
        if m := _FILE.match(line, at):
            add("<FILE>", m[1])
            at = m.end()
            continue
        if m := _PAIR.match(line, at):
            add(*_pair(m))
            at = m.end()
            continue
        end = at
        stop = "|" if classes and classes[-1] == "|" else None
        while end < size and line[end] not in " \t" and line[end] != stop:
            end += 1
        word = line[at:end]
        after_level = len(classes) > 1 and classes[-1] == ":" and classes[-2] == "<LEVEL>"
        if after_level and ":" in word:
            word = word[: _name_end(word)]
            add("<NAME>", word)
            add(":", ":")
            at += len(word) + 1
            continue
        if word.endswith(":") and len(word) > 1:
            add("<NAME:>", word[:-1])
        elif word.endswith("]") and classes and classes[0] == "[":
            add("<NAME]>", word[:-1])
        elif _NUMBER.match(word):
            add("<N>", word)
        elif len(word) > 1 and re.fullmatch(r"[A-Za-z_][\w$]*(?:(?:\.|::|/)[A-Za-z_][\w$]*)+", word):
            add("<NAME>", word)
        else:
            add(_DIGITS.sub("<N>", word), word)
        at = end
    return classes, values, at


def mask(line: str) -> tuple[list[str], list[str]]:
    """The tokens of a line as classes, and what each stands for; the front is scanned, the message is split at blanks."""
    classes, values, at = _scan(line, _FRONT_TOKENS)
    if at < len(line) and all(c.startswith("<KV") for c in classes):
        # A front of pairs goes as far as they do; past its leading tokens only the fields it lacks are kept.
        ahead = at
        while m := _NEXT_PAIR.match(line, ahead):
            kind, value = _pair(m)
            if kind != "<KV>" and kind not in classes:
                classes.append(kind)
                values.append(value)
            ahead = m.end()
    elif at < len(line) and _goes_on(classes):
        # Other fronts go as far as the time and the level they lack, two tokens more with them.
        far = _leading(_scan(line, len(line), True)[0])
        if far > _FRONT_TOKENS:
            classes, values, at = _scan(line, far)
    for word in line[at:].split():
        if "=" in word and _PAIR.match(word):
            continue  # pairs come in any number and order and tell nothing of the layout
        classes.append("<N>" if _NUMBER.match(word) else _DIGITS.sub("<N>", word))
        values.append(word)
    return classes, values


def _pair(m: re.Match) -> tuple[str, str]:
    """The class of a matched pair and its value without quotes."""
    key = m[1].lower()
    value = m[2][1:-1] if m[2][:1] == '"' and len(m[2]) > 1 else m[2]
    return "<KV:time>" if key in TIME_KEYS else "<KV:level>" if key in LEVEL_KEYS else "<KV:component>" if key in COMPONENT_KEYS else "<KV>", value


def _name_end(word: str) -> int:
    """Where a name ends that is followed by a single colon; `::` belongs to names."""
    at = 0
    while (at := word.find(":", at)) >= 0:
        if word.startswith("::", at):
            at += 2
            continue
        return at
    return len(word)


class TemplateTree:
    """A fixed-depth tree of templates: number of tokens, DEPTH leading tokens, then a list of similar templates."""

    def __init__(self) -> None:
        self.leaves: dict[tuple, list[int]] = {}
        self.children: dict[tuple, int] = {}
        #: [template, lines] by number.
        self.known: list[list] = []
        #: Tokens of all templates.
        self.held = 0
        self._seen: dict[str, int] = {}
        self._remembered = 0

    def _route(self, classes: list[str]) -> tuple:
        path: tuple = (len(classes),)
        for token in classes[:DEPTH]:
            step = (*path, token)
            if step not in self.children:
                if self.children.get(path, 0) < CHILDREN:
                    self.children[path] = self.children.get(path, 0) + 1
                else:
                    step = (*path, "<*>")
                self.children.setdefault(step, 0)
            path = step
        return path

    @staticmethod
    def _alike(template: list[str], classes: list[str]) -> float:
        return sum(map(str.__eq__, template, classes)) / max(len(classes), 1)

    def add(self, classes: list[str], count: int = 1) -> int:
        """The number of the template that a masked line joins or founds."""
        exact = " ".join(classes)  # no token has a blank
        if (number := self._seen.get(exact)) is not None:
            self.known[number][1] += count
            return number
        leaf = self.leaves.setdefault(self._route(classes), [])
        want = front(classes)
        best, score = -1, -1.0
        for number in leaf:
            template = self.known[number][0]
            # The classes of the front hold fields and are never merged away.
            if (alike := self._alike(template, classes)) > score and front(template) == want:
                best, score = number, alike
        if best >= 0 and (score >= SIMILARITY or len(leaf) >= TEMPLATES):
            entry = self.known[best]
            entry[0] = [a if a == b else "<*>" for a, b in zip(entry[0], classes, strict=True)]
            entry[1] += count
        else:
            best = len(self.known)
            self.known.append([list(map(sys.intern, classes)), count])
            self.held += len(classes)
            leaf.append(best)
        if len(self._seen) > 100_000 or self._remembered > SENT:
            self._seen.clear()
            self._remembered = 0
        self._seen[exact] = best
        self._remembered += len(exact)
        return best

    def templates(self) -> Iterator[tuple[list[str], int]]:
        for template, count in self.known:
            yield template, count


_FRONT_CLASS = re.compile(r"<(?:PRI[35]|GLOG|TIME:[^>]*|LEVEL|LETTER|PROGRAM|FILE|KV:\w+|NAME[:\]]?)>|(?:##)?\[<\w+>\]|[|:\-\[]$")
_OPENS = re.compile(r"<(?:PRI[35]|GLOG|TIME:[^>]*|LEVEL|KV:(?:time|level|component))>|(?:##)?\[<LEVEL>\]|\[<TAG>\]|\[$")
#: What a front is made of, words between separators aside.
_PART = re.compile(r"<(?:PRI[35]|GLOG|TIME:[^>]*|LEVEL|LETTER)>|(?:##)?\[<LEVEL>\]|\[<(?:TAG|TEXT)>\]|[|:\-\[]$")
_FREE = ("<*>", "<NAME>")
_LEVELLED = frozenset(("<LEVEL>", "[<LEVEL>]", "##[<LEVEL>]", "<LETTER>", "<GLOG>", "<PRI3>", "<PRI5>"))
_PAIRED = ("<KV:time>", "<KV:level>", "<KV:component>")


@lru_cache(maxsize=100_000)
def _class(token: str) -> str:
    return token if _FRONT_CLASS.match(token) else "<*>"


def _part_at(classes: list[str], i: int) -> bool:
    """Whether a token is a part of a front or a word that separators enclose; the last word has none behind it yet."""
    kind = _class(classes[i])
    if kind in _FREE:
        return i > 0 and classes[i - 1] in ("|", "-") and (i + 1 == len(classes) or classes[i + 1] == classes[i - 1])
    return _PART.match(kind) is not None


def _is_time(kind: str) -> bool:
    return kind.startswith("<TIME") or kind == "<GLOG>"


def _goes_on(classes: list[str]) -> bool:
    """Whether the leading tokens are all parts of a front that lacks a time or a level."""
    leading = classes[:_FRONT_TOKENS]
    return (_LEVELLED.isdisjoint(leading) or not any(map(_is_time, leading))) and all(_part_at(classes, i) for i in range(len(leading)))


def _leading(classes: list[str]) -> int:
    """How many tokens a front may take: the leading ones, and those with fields behind them that `mask` kept."""
    end = _FRONT_TOKENS
    if classes[0].startswith("<KV"):
        while end < len(classes) and classes[end] in _PAIRED:
            end += 1
    elif len(classes) > end and _goes_on(classes):
        level, time = not _LEVELLED.isdisjoint(classes[:end]), any(map(_is_time, classes[:end]))
        for i in range(end, len(classes)):
            if level and time or not _part_at(classes, i):
                break
            if not level and classes[i] in _LEVELLED or not time and _is_time(classes[i]):
                level, time, end = level or classes[i] in _LEVELLED, time or _is_time(classes[i]), i + 3
    return end


def front(classes: list[str]) -> tuple[str, ...]:
    """The classes at a line's front; words between them are wildcards."""
    return tuple(map(_class, classes[: _leading(classes)]))


def _run(kind: tuple[str, ...]) -> int:
    """How many leading positions are parts of a front, words among them only where separators enclose them."""
    i = 0
    while i < len(kind):
        if kind[i] in _FREE:
            if not (i and kind[i - 1] in ("|", "-") and kind[i + 1 : i + 2] == (kind[i - 1],)):
                break
        elif not _PART.match(kind[i]):
            break
        i += 1
    return i


def opens(kind: tuple[str, ...]) -> bool:
    """Whether a front is an entry's: it begins with a time, a level or a tag."""
    if kind and kind[0].startswith("<KV"):
        return "<KV:time>" in kind or "<KV:level>" in kind
    return bool(kind) and _OPENS.match(kind[0]) is not None


def _tag(kind: tuple[str, ...], run: int) -> int:
    """The last tag in brackets among a front's parts, -1 without one."""
    return max((i for i in range(run) if kind[i] in ("[<TAG>]", "[<TEXT>]")), default=-1)


def named_after_tag(kinds: dict[tuple[str, ...], int]) -> set[tuple[str, ...]]:
    """Beginnings, up to a tag after the level, behind which most lines have a name of several parts: there the tag is a thread, the name the component."""
    lines: dict[tuple[str, ...], list[int]] = {}
    for kind, count in kinds.items():
        run = _run(kind)
        tag = _tag(kind, run)
        if tag >= 0 and tag == run - 1 and "<LEVEL>" in kind[:tag] and opens(kind):
            votes = lines.setdefault(kind[: tag + 1], [0, 0])
            votes[0] += count
            votes[1] += count * (kind[run : run + 1] == ("<NAME>",))
    return {beginning for beginning, (whole, named) in lines.items() if 2 * named > whole}


def positions(kind: tuple[str, ...], named: set[tuple[str, ...]]) -> dict[str, int] | None:
    """Which positions of a front hold which field; None where it is not an entry's.

    `named` has what `named_after_tag` found over all templates.
    """
    if not opens(kind):
        return None
    if kind[0].startswith("<KV"):
        return {c[4:-1]: i for i, c in reversed(list(enumerate(kind))) if c.startswith("<KV:")}
    run = _run(kind)
    out: dict[str, int] = {}
    for i in reversed(range(run)):
        if _is_time(kind[i]):
            out["time"] = i
        if kind[i] in _LEVELLED:
            out["level"] = i
    component = _component(kind, run, out, named)
    return out if component < 0 else out | {"component": component}


def _component(kind: tuple[str, ...], run: int, fields: dict[str, int], named: set[tuple[str, ...]]) -> int:
    """The position of the component in a front, -1 without one."""
    rest = kind[run:]
    level = kind[fields["level"]] if "level" in fields else ""
    # A program with its process or a file with its line names itself; a host or thread may stand before it.
    for i in (run, run + 1):
        if kind[i : i + 1] in (("<PROGRAM>",), ("<FILE>",)):
            return i
    if kind[0] == "[" and rest[:1] == ("<NAME]>",):
        return run
    if level.endswith("[<LEVEL>]"):
        return -1  # brackets around a level close the front
    # The last word that separators enclose, or that one separates from the message.
    enclosed = [i for i in range(run) if kind[i] in _FREE]
    if enclosed:
        return enclosed[-1]
    if rest[:1] and rest[0] in _FREE and rest[1:2] == ("-",) and level == "<LEVEL>":
        return run
    if ":" in kind[:run]:
        return run if rest[:1] in (("<NAME>",), ("<*>",)) and rest[1:2] == (":",) else -1
    if kind[0] == "<PRI5>":
        return run + 1 if "time" in fields and len(rest) > 1 else -1  # host, then program
    if kind[0] == "<PRI3>" and rest[1:2] == ("<NAME:>",):
        return run + 1
    tag = _tag(kind, run)
    if level == "<LEVEL>" and rest[:1] == ("<NAME:>",) and tag < fields["level"]:
        return run
    if kind[: tag + 1] in named and rest:
        return run
    return tag


def _normal(kind: str, value: str, received: tuple[int, int] | None) -> str:
    """The value of a token as a field would state it."""
    if kind == "<KV:time>":
        return _any_time(value)
    if kind == "<GLOG>":
        return value
    if kind.startswith("<TIME:"):
        return next((_utc(m, received) for p in _TIME.values() if (m := p.match(value))), "")
    if kind.startswith("<PRI"):
        return SYSLOG[int(value) % 8]
    if kind == "<LETTER>":
        return LETTERS[value]
    if kind.endswith("LEVEL>") or kind.endswith("LEVEL>]") or kind == "<KV:level>":
        return _level(value)
    return value


def _object(line: str) -> dict | None:
    """The JSON object that a whole line is, if it states a time or a level."""
    if not (line.startswith("{") and line.rstrip().endswith("}")):
        return None
    try:
        value = json.loads(line)
    except ValueError:
        return None
    if isinstance(value, dict) and any(k.lower() in TIME_KEYS or k.lower() in LEVEL_KEYS for k in value):
        return value
    return None


def _pairs(line: str) -> tuple[str | None, str | None, int | None, int | None]:
    """repo, cwe, engine in microseconds and nodes stated as key=value."""
    repo = cwe = engine = nodes = None
    if "repo=" in line and (m := _REPO.search(line)):
        repo = m[1].strip('"')
    if "cwe=" in line.lower() and (m := _CWE.search(line)):
        cwe = f"CWE-{int(m[1])}"
    if "engine=" in line and (m := _ENGINE.search(line)):
        engine = _microseconds(m)
    if "nodes=" in line and (m := _NODES.search(line)):
        nodes = int(m[1])
    return repo, cwe, engine, nodes


def _microseconds(m: re.Match) -> int:
    places = _UNIT[m[3]]
    digits = m[1] + (m[2] or "").ljust(9, "0")
    keep = len(m[1]) + places
    return int(digits[:keep] or "0")


def _json_fields(value: dict) -> tuple[str, str, str, str | None, str | None, int | None, int | None]:
    low = {k.lower(): v for k, v in value.items()}
    time = next((t for k in TIME_KEYS if (t := _any_time(low.get(k)))), "")
    level = next((t for k in LEVEL_KEYS if (t := _level(low.get(k, "")))), "")
    component = next((str(low[k]) for k in COMPONENT_KEYS if isinstance(low.get(k), str) and low[k]), "")
    parts = []
    for k in ("repo", "cwe", "engine", "nodes"):
        if k in low and not isinstance(low[k], (dict, list, bool)) and low[k] is not None:
            parts.append(f"{k}={low[k]}")
    repo, cwe, engine, nodes = _pairs(" ".join(parts[1:] if parts and parts[0].startswith("repo=") else parts))
    if isinstance(low.get("repo"), str) and low["repo"]:
        repo = low["repo"]
    return time, level, component, repo, cwe, engine, nodes


def _clean(line: str | None) -> str:
    line = (line or "").rstrip("\r\n")
    return _ANSI.sub("", line) if "\x1b" in line else line


def _may_begin(line: str) -> bool:
    """Whether a line is not indented; others are never masked."""
    return bool(line) and not line[0].isspace()


_LINE_SCHEMA = "run_id string, line_no bigint, template bigint, front array<string>, repo string, cwe string, engine_us bigint, nodes bigint, kind string, tokens string, lines bigint"
#: The number of JSON lines that state a time or a level, whose front is time, level and component.
JSON_LINES = -1


def _parts(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows of texts and numbers, SENT characters or 10,000 rows at a time."""
    part: list[tuple] = []
    size = 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size > SENT or len(part) == 10_000:
            yield part
            part, size = [], 0
    if part:
        yield part


def parsed_lines(run_log: DataFrame) -> DataFrame:
    """Every line with its template's number, the normal values of its leading tokens, and its pairs; and a row for each template of each partition, with its front's kind and its lines.

    Lines that are indented or blank have no template.
    """

    def run(batches):
        tree = TemplateTree()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        names = [x.split()[0] for x in _LINE_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int64()]

        def grown():
            at = base
            for part in _parts((" ".join(front(t)), " ".join(t), n) for t, n in tree.templates()):
                size = len(part)
                empty = [pa.nulls(size, k) for k in kinds[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(size, pa.string()), pa.nulls(size, pa.int64()), pa.array(range(at, at + size), pa.int64()), *empty, *(pa.array(c, k) for c, k in zip(zip(*part, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True))], names
                )
                at += size

        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            years, days = batch.column("year").to_pylist(), batch.column("day").to_pylist()
            for i, line in enumerate(batch.column("raw_line").to_pylist()):
                line = _clean(line)
                number = values = pairs = None
                if _may_begin(line):
                    if line[0] == "{":
                        if (value := _object(line)) is not None:
                            *values, repo, cwe, engine, nodes = _json_fields(value)
                            number, pairs = JSON_LINES, (repo, cwe, engine, nodes)
                    else:
                        classes, tokens = mask(line)
                        number = base + tree.add(classes)
                        if _OPENS.match(classes[0]) or classes[0].startswith("<KV"):
                            received = (years[i], days[i]) if years[i] else None
                            values = [_normal(c, v, received) for c, v in zip(classes[: _leading(classes)], tokens, strict=False)]
                            if classes[0] == "<GLOG>":
                                values.append(_utc(_GLOG.match(tokens[0]), received))
                                values[0] = LETTERS[tokens[0][0]]
                if pairs is None:
                    pairs = _pairs(line) if "=" in line else (None, None, None, None)
                for column, value in zip(out, (number, values, *pairs), strict=True):
                    column.append(value)
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("line_no"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), pa.nulls(size, pa.string()), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64())], names)
            if tree.held > HELD:
                yield from grown()
                tree, base = TemplateTree(), base + len(tree.known)
        yield from grown()

    received = [F.year("received_at").alias("year"), F.dayofyear("received_at").alias("day")] if "received_at" in run_log.columns else [F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("day")]
    return run_log.select("run_id", "line_no", "raw_line", *received).mapInArrow(run, _LINE_SCHEMA)


def placed(parsed: DataFrame) -> DataFrame:
    """(template, time_at, level_at, component_at) of every template whose front is an entry's, inferred over the templates of all partitions; positions count from 1, 0 is none.

    The driver gets the kinds of fronts, which have classes and no words.
    """
    known = parsed.where("kind is not null")
    kinds = {tuple(r["kind"].split(" ")): r["lines"] for r in known.groupBy("kind").agg(F.sum("lines").alias("lines")).collect() if opens(tuple(r["kind"].split(" ")))}
    named = named_after_tag(kinds)
    rows = []
    for kind in sorted(kinds):
        where = positions(kind, named)
        at = {k: i + 1 for k, i in where.items()}
        if kind[0] == "<GLOG>":
            at["time"] = -1  # its time follows the leading tokens
        rows.append((" ".join(kind), at.get("time", 0), at.get("level", 0), at.get("component", 0)))
    spark = parsed.sparkSession
    table = spark.createDataFrame(rows, "kind string, time_at int, level_at int, component_at int")
    of_json = spark.createDataFrame([(JSON_LINES, 1, 2, 3)], "template bigint, time_at int, level_at int, component_at int")
    return known.select("template", "kind").join(table, "kind").drop("kind").unionByName(of_json)


def templates(run_log: DataFrame) -> DataFrame:
    """(template, tokens, lines) of the trees over a run log that begin entries; those alike are merged, kind by kind.  Lines that begin no entry have none."""

    def grown(batches):
        at, tree = None, TemplateTree()
        for batch in batches:
            for kind, size, tokens, lines in zip(*(batch.column(c).to_pylist() for c in ("kind", "size", "tokens", "lines")), strict=True):
                if not opens(tuple(kind.split(" "))):
                    continue
                if at != (kind, size):
                    yield from ((" ".join(t), len(t), n) for t, n in tree.templates())
                    at, tree = (kind, size), TemplateTree()
                tree.add(tokens.split(" "), lines)
        yield from ((" ".join(t), len(t), n) for t, n in tree.templates())

    def run(batches):
        for part in _parts(grown(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], ["template", "tokens", "lines"])

    known = parsed_lines(parallel(run_log)).where("kind is not null").groupBy("kind", "tokens").agg(F.sum("lines").alias("lines"))
    # Templates of different kinds or sizes are never merged: one tree at a time is held.
    known = known.withColumn("size", F.size(F.split("tokens", " "))).repartition("kind", "size").sortWithinPartitions("kind", "size", "tokens")
    return known.mapInArrow(run, "template string, tokens int, lines bigint").groupBy("template", "tokens").agg(F.sum("lines").alias("lines"))


def entries(run_log: DataFrame) -> DataFrame:
    """One row per log entry: run_id, first_line, last_line, logged_at, log_level, component, repo, cwe, engine_us, nodes.

    Lines delivered twice change nothing.  Lines ahead of a run's first entry
    belong to none.  A null raw_line counts as a blank one; rows without run_id
    or line_no are left out.  What an entry doesn't state is '' or -1.
    """
    run_log = parallel(run_log.where("run_id is not null and line_no is not null"))
    # Written once: templates, the blocks' summary and the entries are read from the parsed lines.
    parsed = checkpointed(parsed_lines(run_log))
    field = lambda name: F.when(F.col(f"{name}_at") != 0, F.element_at("front", F.col(f"{name}_at")))
    lines = parsed.where("kind is null").join(placed(parsed), "template", "left").select(
        "run_id", "line_no", F.col("time_at").isNotNull().alias("begins"), field("time").alias("logged_at"), field("level").alias("log_level"), field("component").alias("component"), "repo", "cwe", "engine_us", "nodes"
    )
    lines = lines.withColumn("block", F.floor(F.col("line_no") / BLOCK))
    inside = Window.partitionBy("run_id", "block").orderBy("line_no").rangeBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("begins"), F.col("line_no"))
    lines = lines.withColumn("start", F.max(start).over(inside)).withColumn("upto", F.max(start).over(Window.partitionBy("run_id", "block")))
    # The last start of earlier blocks: one row per block and run, and only runs longer than a block have several.
    blocks = lines.groupBy("run_id", "block").agg(F.max("upto").alias("upto"))
    carried = blocks.select("run_id", "block", F.max("upto").over(Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("line_no", c)))[c]
    front = lambda c: F.max(F.when(F.col("begins") & (F.col("line_no") == F.col("first_line")), F.col(c)))
    entry = lines.join(carried, ["run_id", "block"]).withColumn("first_line", F.coalesce("start", "carried")).where("first_line is not null")
    rows = entry.groupBy("run_id", "first_line").agg(
        F.max("line_no").alias("last_line"), front("logged_at").alias("logged_at"), front("log_level").alias("log_level"), front("component").alias("component"), first("repo").alias("repo"), first("cwe").alias("cwe"), first("engine_us").alias("engine_us"), first("nodes").alias("nodes")
    )
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("logged_at", "log_level", "component", "repo", "cwe")]
    return rows.select("run_id", "first_line", "last_line", *text, *(F.coalesce(c, F.lit(-1).cast("bigint")).alias(c) for c in ("engine_us", "nodes")))
