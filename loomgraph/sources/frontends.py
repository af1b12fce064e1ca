"""Python and Java files lowered to three-address instructions, one row each.

Instructions: Assign, BinaryOp, Call, Alloc, HeapLoad, HeapStore, Branch, Jump,
Label, Return.  Operands are text: a variable's name, `%n` for a temporary, `=` and
the source text for a constant.  Code outside of functions is in the method
`<module>`.  A file that does not parse gives one row of kind `Error`.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import parallel

MODULE = "<module>"
FIELDS = ("method", "pos", "kind", "dest", "callee", "args", "field", "label", "line")
SCHEMA = "file_id bigint, language string, method string, pos int, kind string, dest string, callee string, args array<string>, field string, label string, line int"


class _Writer:
    """The instructions of the methods of one file."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.params: dict[str, list[str]] = {}
        self.method = MODULE
        self._next: dict[str, int] = {}
        self._temps = 0
        self._labels = 0

    def emit(self, kind: str, line: int, dest: str | None = None, callee: str | None = None, args: list[str] | None = None, field: str | None = None, label: str | None = None) -> str | None:
        pos = self._next.get(self.method, 0)
        self._next[self.method] = pos + 1
        self.rows.append((self.method, pos, kind, dest, callee, args or [], field, label, line))
        return dest

    def temp(self) -> str:
        self._temps += 1
        return f"%{self._temps}"

    def label(self) -> str:
        self._labels += 1
        return f"L{self._labels}"


class PythonFrontend(_Writer):
    def __init__(self, tree: ast.Module) -> None:
        super().__init__()
        self.classes = {n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}
        self._block(tree.body, "")

    def _block(self, body: list[ast.stmt], scope: str) -> None:
        for statement in body:
            self._statement(statement, scope)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, scope: str) -> None:
        outer = self.method
        self.method = f"{scope}{node.name}"
        a = node.args
        self.params[self.method] = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
        self._next.setdefault(self.method, 0)
        self._block(node.body, f"{self.method}.")
        self.method = outer

    def _statement(self, node: ast.stmt, scope: str) -> None:
        line = node.lineno
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                self._function(node, scope)
            case ast.ClassDef():
                self._block(node.body, f"{scope}{node.name}.")
            case ast.Assign():
                value = self._value(node.value)
                for target in node.targets:
                    self._store(target, value, line)
            case ast.AnnAssign() if node.value is not None:
                self._store(node.target, self._value(node.value), line)
            case ast.AugAssign():
                old, new, out = self._value(node.target), self._value(node.value), self.temp()
                self.emit("BinaryOp", line, out, args=[old, new])
                self._store(node.target, out, line)
            case ast.Return():
                self.emit("Return", line, args=[self._value(node.value)] if node.value is not None else [])
            case ast.If():
                yes, end = self.label(), self.label()
                self.emit("Branch", line, args=[self._value(node.test)], label=yes)
                self._block(node.orelse, scope)
                self.emit("Jump", line, label=end)
                self.emit("Label", line, label=yes)
                self._block(node.body, scope)
                self.emit("Label", line, label=end)
            case ast.While() | ast.For() | ast.AsyncFor():
                start, body, end = self.label(), self.label(), self.label()
                self.emit("Label", line, label=start)
                if isinstance(node, ast.While):
                    test = self._value(node.test)
                else:
                    test = self._value(node.iter)
                    self._store(node.target, test, line)
                self.emit("Branch", line, args=[test], label=body)
                self.emit("Jump", line, label=end)
                self.emit("Label", line, label=body)
                self._block(node.body, scope)
                self.emit("Jump", line, label=start)
                self.emit("Label", line, label=end)
                self._block(node.orelse, scope)
            case ast.With() | ast.AsyncWith():
                for item in node.items:
                    value = self._value(item.context_expr)
                    if item.optional_vars is not None:
                        self._store(item.optional_vars, value, line)
                self._block(node.body, scope)
            case ast.Try() | ast.TryStar():
                self._block(node.body, scope)
                for handler in node.handlers:
                    self._block(handler.body, scope)
                self._block(node.orelse, scope)
                self._block(node.finalbody, scope)
            case ast.Match():
                self._value(node.subject)
                for case in node.cases:
                    self._block(case.body, scope)
            case _:
                for child in ast.iter_child_nodes(node):
                    if isinstance(child, ast.expr):
                        self._value(child)

    def _store(self, target: ast.expr, value: str, line: int) -> None:
        match target:
            case ast.Name():
                self.emit("Assign", line, target.id, args=[value])
            case ast.Attribute():
                self.emit("HeapStore", line, self._value(target.value), args=[value], field=target.attr)
            case ast.Subscript():
                self.emit("HeapStore", line, self._value(target.value), args=[value], field="[]")
            case ast.Tuple() | ast.List():
                for part in target.elts:
                    self._store(part, value, line)
            case ast.Starred():
                self._store(target.value, value, line)

    def _name(self, node: ast.expr) -> str:
        match node:
            case ast.Name():
                return node.id
            case ast.Attribute():
                base = self._name(node.value)
                return f"{base}.{node.attr}" if base else node.attr
            case ast.Call():
                return ""
        return ""

    def _value(self, node: ast.expr | None) -> str:
        if node is None:
            return "=None"
        line = node.lineno
        match node:
            case ast.Name():
                return node.id
            case ast.Constant():
                return "=" + repr(node.value)[:80]
            case ast.Call():
                # The receiver of a method is its first argument, as `self` is.
                receiver = [self._value(node.func.value)] if isinstance(node.func, ast.Attribute) and self._name(node.func.value) not in self.classes else []
                args = [*receiver, *(self._value(a) for a in node.args), *(self._value(k.value) for k in node.keywords)]
                callee = self._name(node.func) or "<call>"
                return self.emit("Alloc" if callee in self.classes else "Call", line, self.temp(), callee, args)
            case ast.Attribute():
                return self.emit("HeapLoad", line, self.temp(), args=[self._value(node.value)], field=node.attr)
            case ast.Subscript():
                base = self._value(node.value)
                self._value(node.slice) if not isinstance(node.slice, ast.Slice) else None
                return self.emit("HeapLoad", line, self.temp(), args=[base], field="[]")
            case ast.NamedExpr():
                value = self._value(node.value)
                self._store(node.target, value, line)
                return value
            case ast.Lambda():
                return "=<lambda>"
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp() | ast.DictComp():
                for generator in node.generators:
                    self._store(generator.target, self._value(generator.iter), line)
                parts = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
                return self.emit("BinaryOp", line, self.temp(), args=[self._value(p) for p in parts])
        parts = [self._value(c) for c in ast.iter_child_nodes(node) if isinstance(c, ast.expr)]
        if not parts:
            return "=" + type(node).__name__
        return self.emit("BinaryOp", line, self.temp(), args=parts)


_JAVA_HEADER = re.compile(r"^(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?[\w<>\[\], .?]+?\s+(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws [\w., ]+)?$")
_JAVA_TYPE = re.compile(r"\b(?:class|interface|enum|record)\s+(\w+)")
_JAVA_EACH = re.compile(r"^for\s*\(\s*(?:final\s+)?[\w<>\[\], .?]+\s+(\w+)\s*:\s*(.+)\)$", re.DOTALL)
_JAVA_KEYWORDS = frozenset("if for while switch catch return new throw synchronized else do try super this assert case instanceof".split())
_JAVA_PIECE = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*|\d[\w.]*|->|::|[-+*/%<>=!&|^?:]+|\S")


def java_statements(code: str) -> list[tuple[int, str, str]]:
    """(line, text, ending) of each logical line of Java: text up to `;`, `{` or `}` outside of strings, comments and brackets."""
    out: list[tuple[int, str, str]] = []
    at, line, depth, begin, text = 0, 1, 0, 1, []
    size = len(code)
    while at < size:
        c = code[at]
        if c == "\n":
            line += 1
            text.append(" ")
        elif code.startswith("//", at):
            end = code.find("\n", at)
            at = size if end < 0 else end
            continue
        elif code.startswith("/*", at):
            end = code.find("*/", at)
            end = size if end < 0 else end + 2
            line += code.count("\n", at, end)
            at = end
            continue
        elif c in "\"'":
            quote = '"""' if code.startswith('"""', at) else c
            end = at + len(quote)
            while end < size and not code.startswith(quote, end):
                end += 2 if code[end] == "\\" else 1
            end = min(end + len(quote), size)
            if not text or not "".join(text).strip():
                begin = line
            text.append(code[at:end] if quote == c else '""')
            line += code.count("\n", at, end)
            at = end
            continue
        elif c in ";{}" and depth <= 0:
            out.append((begin, "".join(text).strip(), c))
            text, depth = [], 0
        else:
            if not c.isspace() and not "".join(text[-1:]).strip() and not "".join(text).strip():
                begin = line
            depth += (c in "([") - (c in ")]")
            text.append(c)
        at += 1
    return out


class JavaFrontend(_Writer):
    def __init__(self, code: str) -> None:
        super().__init__()
        depth, owner, opened = 0, "", []
        for line, text, ending in java_statements(code):
            if ending == "{":
                depth += 1
                if m := _JAVA_TYPE.search(text):
                    owner = m[1]
                    opened.append((depth, "type", MODULE))
                elif (m := _JAVA_HEADER.match(text)) and m[1] not in _JAVA_KEYWORDS and "=" not in text.split("(")[0] and not text.startswith(("new ", "return ", "else")):
                    opened.append((depth, "method", self.method))
                    self.method = f"{owner}.{m[1]}" if owner else m[1]
                    self.params[self.method] = [p.split()[-1].strip("[]. ") for p in re.split(r",(?![^<]*>)", m[2]) if p.strip()]
                    self._next.setdefault(self.method, 0)
                elif text:
                    self._line(text, line)
                continue
            if text:
                self._line(text, line)
            if ending == "}":
                if opened and opened[-1][0] == depth:
                    self.method = opened.pop()[2]
                depth -= 1

    def _line(self, text: str, line: int) -> None:
        if text.startswith(("import ", "package ", "@")) and "=" not in text:
            return
        if m := _JAVA_EACH.match(text):
            self.emit("Assign", line, m[1], args=[self._value(m[2], line)])
            return
        if m := re.match(r"^(?:\}?\s*else\s+)?(?:if|while|for|switch|catch|synchronized|try)\s*\((.*)\)$", text, re.DOTALL):
            for part in m[1].split(";"):
                self._line(part.strip(), line) if part.strip() else None
            return
        if text.startswith("return"):
            rest = text[6:].strip()
            self.emit("Return", line, args=[self._value(rest, line)] if rest else [])
            return
        if text.startswith("throw "):
            self._value(text[6:], line)
            return
        pieces = list(_JAVA_PIECE.finditer(text))
        depth = 0
        for p in pieces:
            t = p[0]
            depth += (t in "([") - (t in ")]")
            if depth == 0 and t in ("=", "+=", "-="):
                left, right = text[: p.start()].strip(), text[p.end() :].strip()
                value = self._value(right, line)
                target = re.sub(r"\[.*", "", left.split()[-1]) if left else ""
                if t != "=":
                    value = self.emit("BinaryOp", line, self.temp(), args=[target, value])
                if "." in target:
                    base, field = target.rsplit(".", 1)
                    self.emit("HeapStore", line, base, args=[value], field=field)
                elif target:
                    self.emit("Assign", line, target, args=[value])
                return
        self._value(text, line)

    def _value(self, text: str, line: int) -> str:
        operands, _ = self._operands([m[0] for m in _JAVA_PIECE.finditer(text)], 0, line, ())
        real = [o for o in operands if not o.startswith("=")]
        if len(operands) == 1:
            return operands[0]
        if not real:
            return operands[0] if operands else "="
        return self.emit("BinaryOp", line, self.temp(), args=real)

    def _operands(self, tokens: list[str], at: int, line: int, stop: tuple[str, ...]) -> tuple[list[str], int]:
        """Operands of an expression from a token on, up to a stop token at its own depth."""
        out: list[str] = []
        new = False
        while at < len(tokens):
            t = tokens[at]
            if t in stop:
                break
            if t == "new":
                new = True
            elif t == "(":
                inner, at = self._operands(tokens, at + 1, line, (")",))
                out += inner
            elif t == "[":
                inner, at = self._operands(tokens, at + 1, line, ("]",))
            elif t[0] in "\"'":
                out.append("=" + t[:80])
                new = False
            elif t[0].isdigit() or t in ("true", "false", "null"):
                out.append("=" + t)
            elif t[0].isalpha() or t[0] in "_$":
                name = re.sub(r"\s+", "", t)
                ahead = at + 1
                if new and ahead < len(tokens) and tokens[ahead] == "<":
                    depth = 0
                    while ahead < len(tokens):
                        depth += tokens[ahead].count("<") - tokens[ahead].count(">")
                        ahead += 1
                        if depth <= 0:
                            break
                if ahead < len(tokens) and tokens[ahead] == "(" and name not in _JAVA_KEYWORDS:
                    args, at = self._arguments(tokens, ahead + 1, line)
                    owner, _, method = name.rpartition(".")
                    if new:
                        last = name.rsplit(".", 1)[-1]
                        dest = self.emit("Call", line, self.temp(), f"{last}.{last}", args)
                    else:
                        receiver = [owner] if owner and owner[0].islower() and "." not in owner else []
                        dest = self.emit("Call", line, self.temp(), name if owner and owner[0].isupper() else method, [*receiver, *args])
                    # A chain of calls: each next one has this result as its receiver.
                    while at + 1 < len(tokens) and tokens[at + 1] == "." and at + 3 < len(tokens) and tokens[at + 3] == "(":
                        method = tokens[at + 2].rsplit(".", 1)[-1]
                        more, at = self._arguments(tokens, at + 4, line)
                        dest = self.emit("Call", line, self.temp(), method, [dest, *more])
                    out.append(dest)
                elif name not in _JAVA_KEYWORDS and not new:
                    base, _, field = name.rpartition(".")
                    if base and base[0].islower() and "." not in base:
                        out.append(self.emit("HeapLoad", line, self.temp(), args=[base], field=field))
                    elif name[0].islower() or name[0] in "_$":
                        out.append(name)
                    else:
                        out.append("=" + name)
                new = False
            at += 1
        return out, at

    def _arguments(self, tokens: list[str], at: int, line: int) -> tuple[list[str], int]:
        """Arguments up to the closing bracket: one operand each, in order."""
        args: list[str] = []
        while at < len(tokens) and tokens[at] != ")":
            operands, at = self._operands(tokens, at, line, (",", ")"))
            real = [o for o in operands if not o.startswith("=")]
            if len(real) > 1:
                args.append(self.emit("BinaryOp", line, self.temp(), args=real))
            elif operands:
                args.append(real[0] if real else operands[0])
            if at < len(tokens) and tokens[at] == ",":
                at += 1
        return args, at


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def unindented(code: str) -> str:
    """Python code whose first line is indented by eight or more, made to parse; other code stays as it is.

    Lines ahead of the first class or function lose their indentation.  Between a class's
    line and its first function, lines that only make sense elsewhere (deeply indented, or
    closing what they never opened) become one `pass`, and comments after that.
    """
    lines = code.split("\n")
    if _indent(next((x for x in lines if x.strip()), "")) < 8:
        return code
    heads = [i for i, x in enumerate(lines) if x.strip().startswith(("class ", "def "))]
    top = heads[0] if heads else len(lines)
    out = [x.lstrip() if i < top else x for i, x in enumerate(lines)]
    for i, start in enumerate(heads):
        if not lines[start].strip().startswith("class "):
            continue
        opened, passed = 0, False
        for at in range(start + 1, heads[i + 1] if i + 1 < len(heads) else len(lines)):
            text = lines[at].strip()
            if not text:
                continue
            change = sum(map(text.count, "([{")) - sum(map(text.count, ")]}"))
            stray = (change < 0 and not opened) or (_indent(lines[at]) >= 12 and not text.startswith(("#", '"""', "'''")))
            if stray:
                out[at] = f"# stripped: {text}" if passed else "    pass"
                passed = True
            else:
                opened = max(0, opened + change)
    return "\n".join(out)


def lower_python(code: str) -> tuple[list[tuple], dict[str, list[str]]]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        front = PythonFrontend(ast.parse(unindented(code)))
    return front.rows, front.params


def lower_java(code: str) -> tuple[list[tuple], dict[str, list[str]]]:
    front = JavaFrontend(code)
    return front.rows, front.params


#: A frontend gives the instructions of a file and the parameters of its methods; others may be added by language.
FRONTENDS: dict[str, Callable[[str], tuple[list[tuple], dict[str, list[str]]]]] = {"python": lower_python, "java": lower_java}


def lower(code: str | None, language: str | None) -> tuple[list[tuple], dict[str, list[str]]]:
    """A file's instructions and parameters; an `Error` row where it can't be read."""
    front = FRONTENDS.get(language or "")
    if not code or front is None:
        return [], {}
    try:
        return front(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [(MODULE, 0, "Error", None, type(error).__name__, [], None, None, getattr(error, "lineno", None) or 0)], {}


def instructions(code_files: DataFrame) -> DataFrame:
    """The instruction table of all files (file_id, language, code)."""

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(FIELDS) + 2)]
            for file_id, language, code in zip(*(batch.column(c).to_pylist() for c in ("file_id", "language", "code")), strict=True):
                for row in lower(code, language)[0]:
                    for column, value in zip(columns, (file_id, language, *row), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_id", "language", *FIELDS])

    return parallel(code_files.select("file_id", "language", "code")).mapInArrow(run, SCHEMA)


def parameters(code_files: DataFrame) -> DataFrame:
    """(file_id, method, pos, name) of the parameters of all methods."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for file_id, language, code in zip(*(batch.column(c).to_pylist() for c in ("file_id", "language", "code")), strict=True):
                for method, names in lower(code, language)[1].items():
                    rows += [(file_id, method, i, n) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int32(), pa.string()))], ["file_id", "method", "pos", "name"])

    return parallel(code_files.select("file_id", "language", "code")).mapInArrow(run, "file_id bigint, method string, pos int, name string")
