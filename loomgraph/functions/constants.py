"""Constants: evaluation of expressions, propagation of single assignments, string calls and collections.

Everything is a pure function of text.  `UNKNOWN` stands for what can't be told.
"""

from __future__ import annotations

import re
from collections.abc import Callable

UNKNOWN = object()

_TOKENS = re.compile(r"\s*(?:(\d+\.\d+|\d+)|(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(&&|\|\||==|!=|<=|>=|[-+*/%<>!()?:,.\[\]])|(not\s+in\b|[A-Za-z_]\w*))")
_WORDS = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None}


def tokens(text: str) -> list[tuple[str, object]] | None:
    """(kind, value) of an expression's tokens; None where something is no token."""
    out: list[tuple[str, object]] = []
    at, text = 0, text.strip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if m is None:
            return None
        at = m.end()
        number, string, sign, word = m.groups()
        if number is not None:
            out.append(("value", float(number) if "." in number else int(number)))
        elif string is not None:
            out.append(("value", re.sub(r"\\(.)", r"\1", string[1:-1])))
        elif sign is not None:
            out.append(("sign", {"&&": "and", "||": "or", "!": "not"}.get(sign, sign)))
        elif word in _WORDS:
            out.append(("value", _WORDS[word]))
        elif word in ("and", "or", "not", "in") or word.startswith("not "):
            out.append(("sign", "not in" if word.startswith("not ") else word))
        else:
            out.append(("name", word))
    return out


#: String methods by the names both languages give them.
STRING_CALLS: dict[str, Callable] = {
    "contains": lambda s, x: x in s,
    "indexOf": lambda s, x: s.find(x),
    "find": lambda s, x: s.find(x),
    "equals": lambda s, x: s == x,
    "equalsIgnoreCase": lambda s, x: s.lower() == x.lower(),
    "startsWith": lambda s, x: s.startswith(x),
    "startswith": lambda s, x: s.startswith(x),
    "endsWith": lambda s, x: s.endswith(x),
    "endswith": lambda s, x: s.endswith(x),
    "substring": lambda s, a, b=None: s[a:b] if 0 <= a <= len(s) and (b is None or a <= b <= len(s)) else UNKNOWN,
    "charAt": lambda s, i: s[i] if 0 <= i < len(s) else UNKNOWN,
    "trim": lambda s: s.strip(),
    "strip": lambda s: s.strip(),
    "toLowerCase": lambda s: s.lower(),
    "lower": lambda s: s.lower(),
    "toUpperCase": lambda s: s.upper(),
    "upper": lambda s: s.upper(),
    "replace": lambda s, a, b: s.replace(a, b),
    "replaceAll": lambda s, a, b: s.replace(a, b) if re.fullmatch(r"[\w\s]*", a) and "$" not in b else UNKNOWN,
    "length": lambda s: len(s),
    "isEmpty": lambda s: not s,
}


class _Evaluator:
    """Precedence from `or` down to unary signs; what is left over makes the whole unknown."""

    def __init__(self, items: list[tuple[str, object]], names: dict[str, object]) -> None:
        self.items, self.at, self.names = items, 0, names

    def sign(self, *signs: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] == "sign" and self.items[self.at][1] in signs:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def whole(self):
        value = self.choice()
        return value if self.at == len(self.items) else UNKNOWN

    def choice(self):
        value = self.any_of()
        if self.sign("?"):
            yes = self.choice()
            if not self.sign(":"):
                return UNKNOWN
            no = self.choice()
            return UNKNOWN if value is UNKNOWN else yes if value else no
        return value

    def any_of(self):
        value = self.all_of()
        while self.sign("or"):
            other = self.all_of()
            value = True if value is True or other is True else UNKNOWN if UNKNOWN in (value, other) else bool(value or other)
        return value

    def all_of(self):
        value = self.opposite()
        while self.sign("and"):
            other = self.opposite()
            value = False if value is False or other is False else UNKNOWN if UNKNOWN in (value, other) else bool(value and other)
        return value

    def opposite(self):
        if self.sign("not"):
            value = self.opposite()
            return UNKNOWN if value is UNKNOWN else not value
        return self.compared()

    def compared(self):
        value = self.sum()
        while sign := self.sign("==", "!=", "<", "<=", ">", ">=", "in", "not in"):
            other = self.sum()
            if value is UNKNOWN or other is UNKNOWN:
                value = UNKNOWN
                continue
            try:
                value = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b}[sign](value, other)
            except TypeError:
                value = UNKNOWN
        return value

    def sum(self):
        value = self.product()
        while sign := self.sign("+", "-"):
            other = self.product()
            if sign == "+" and (isinstance(value, str) or isinstance(other, str)) and UNKNOWN not in (value, other):
                value = f"{value}{other}"
            else:
                value = _arithmetic(sign, value, other)
        return value

    def product(self):
        value = self.unary()
        while sign := self.sign("*", "/", "%"):
            value = _arithmetic(sign, value, self.unary())
        return value

    def unary(self):
        if self.sign("-"):
            value = self.unary()
            return -value if isinstance(value, (int, float)) and not isinstance(value, bool) else UNKNOWN
        if self.sign("not"):
            value = self.unary()
            return UNKNOWN if value is UNKNOWN else not value
        return self.called()

    def called(self):
        value = self.primary()
        while self.sign("."):
            if self.at >= len(self.items) or self.items[self.at][0] != "name":
                return UNKNOWN
            method = self.items[self.at][1]
            self.at += 1
            if not self.sign("("):
                value = UNKNOWN
                continue
            args = []
            while not self.sign(")"):
                args.append(self.choice())
                if not self.sign(",") and not (self.at < len(self.items) and self.items[self.at] == ("sign", ")")):
                    return UNKNOWN
            value = string_call(value, method, args)
        return value

    def primary(self):
        if self.sign("("):
            value = self.choice()
            return value if self.sign(")") else UNKNOWN
        if self.at < len(self.items) and self.items[self.at][0] in ("value", "name"):
            kind, value = self.items[self.at]
            self.at += 1
            return value if kind == "value" else self.names.get(value, UNKNOWN)
        self.at = len(self.items) + 1
        return UNKNOWN


def _arithmetic(sign: str, a: object, b: object) -> object:
    """Whole numbers only; division cuts towards zero, by zero it is unknown."""
    if not (isinstance(a, int) and isinstance(b, int)) or isinstance(a, bool) or isinstance(b, bool):
        return UNKNOWN
    if sign in "/%":
        if b == 0:
            return UNKNOWN
        quotient = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return quotient if sign == "/" else a - quotient * b
    return {"+": a + b, "-": a - b, "*": a * b}[sign]


def string_call(value: object, method: str, args: list) -> object:
    """A string method of constants, UNKNOWN where it isn't one."""
    call = STRING_CALLS.get(method)
    if call is None or not isinstance(value, str) or UNKNOWN in args:
        return UNKNOWN
    try:
        return call(value, *args)
    except (TypeError, AttributeError, IndexError):
        return UNKNOWN


def evaluate(text: str, names: dict[str, object] | None = None) -> object:
    """The value of an expression of constants and known names."""
    items = tokens(text)
    return UNKNOWN if not items else _Evaluator(items, names or {}).whole()


def propagate(assigned: list[tuple[str, str, bool]]) -> dict[str, object]:
    """Values of names from (name, expression, unconditional) in order: only names that are assigned once, and always, have one."""
    times: dict[str, int] = {}
    for name, _, _ in assigned:
        times[name] = times.get(name, 0) + 1
    known: dict[str, object] = {}
    for name, text, always in assigned:
        if times[name] == 1 and always and (value := evaluate(text, known)) is not UNKNOWN:
            known[name] = value
    return known


class Collection:
    """A list or map of constants, as far as its calls tell."""

    def __init__(self) -> None:
        self.items: list[object] = []
        self.keyed: dict[object, object] = {}

    def add(self, value: object) -> None:
        self.items.append(value)

    def insert(self, index: int, value: object) -> None:
        self.items.insert(index, value)

    def put(self, key: object, value: object) -> None:
        self.keyed[key] = value

    def get(self, key: object) -> object:
        if key in self.keyed:
            return self.keyed[key]
        return self.items[key] if isinstance(key, int) and 0 <= key < len(self.items) else UNKNOWN

    def remove(self, key: object) -> object:
        """A key of the map, or an index of the list, behind which the rest moves up."""
        if key in self.keyed:
            return self.keyed.pop(key)
        return self.items.pop(key) if isinstance(key, int) and 0 <= key < len(self.items) else UNKNOWN

    def __len__(self) -> int:
        return len(self.items) + len(self.keyed)

    def merged(self, other: Collection) -> Collection:
        """What holds in both: entries that differ become unknown."""
        out = Collection()
        out.items = [a if a == b else UNKNOWN for a, b in zip(self.items, other.items, strict=False)]
        out.keyed = {k: v if other.keyed.get(k, UNKNOWN) == v else UNKNOWN for k, v in self.keyed.items()} | {k: UNKNOWN for k in other.keyed if k not in self.keyed}
        return out


# Small readings of expressions.


def container_access(text: str) -> tuple[str, str] | None:
    """(container, key) of `x[k]` or `x.get(k)`."""
    m = re.fullmatch(r"\s*([A-Za-z_][\w.]*)\s*(?:\[\s*(.+?)\s*\]|\.get\(\s*(.+?)\s*\))\s*", text)
    return (m[1], m[2] or m[3]) if m else None


def uses(text: str, name: str) -> bool:
    """Whether an expression uses a name outside of its string literals; `x[*]` stands for any element of x."""
    bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", lambda m: m[0][0] * 2, text)
    if name.endswith("[*]"):
        return re.search(rf"(?<![\w.]){re.escape(name[:-3])}\s*(?:\[|\.get\()", bare) is not None
    if access := container_access(name):
        return re.search(rf"(?<![\w.]){re.escape(access[0])}\s*(?:\[\s*{re.escape(access[1])}\s*\]|\.get\(\s*{re.escape(access[1])}\s*\))", text) is not None
    return re.search(rf"(?<![\w.]){re.escape(name)}(?!\w)", bare) is not None


def same_name(a: str, b: str) -> bool:
    """Whether two names or container elements are the same, in any case."""
    x, y = container_access(a), container_access(b)
    return (x[0].lower(), x[1].lower()) == (y[0].lower(), y[1].lower()) if x and y else a.strip().lower() == b.strip().lower()


def receiver(callee: str) -> str:
    """The text before a call's last dot."""
    return callee.rpartition(".")[0]


def parameter_name(text: str) -> str:
    """A parameter without annotations, modifiers, types and defaults."""
    text = re.sub(r"@\w+(?:\([^)]*\))?\s*", "", text).split("=")[0]
    if ":" in text:
        text = text.split(":")[0]
    return re.sub(r"\b(?:final|const)\b", "", text).strip().split()[-1].strip("*.[]&") if text.strip() else ""


def folded_branches(code: str, java: bool = False) -> list[tuple[int, str, bool]]:
    """(line, condition, value) of the `if` conditions that constants decide, single unconditional assignments known."""
    assigned, found = [], []
    pattern = re.compile(r"^(\s*)(?:(?:final\s+)?(?:int|long|boolean|String|char|double)\s+)?([A-Za-z_]\w*)\s*=\s*([^=].*?);?\s*$")
    lines = code.split("\n")
    for line in lines:
        if m := pattern.match(line):
            assigned.append((m[2], m[3], len(m[1].expandtabs(4)) <= (8 if java else 4)))
    known = propagate(assigned)
    for i, line in enumerate(lines, 1):
        m = re.match(r"\s*(?:\}\s*else\s+)?if\s*\((.*)\)\s*\{?\s*$" if java else r"\s*(?:if|elif)\s+(.*):\s*$", line)
        if m and isinstance(value := evaluate(m[1], known), bool):
            found.append((i, m[1], value))
    return found
