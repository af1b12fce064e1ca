"""A syntax check of Java 17 source files.

Tokens become one character each (identifiers `i`, literals `L`, each keyword a
character of its own), and a recursive-descent parser works on that string.
Statements and headers without nested blocks are looked up by their character
strings first: code repeats the shapes of its statements, so most are parsed once
for thousands of files.  Functions take a position and give the one behind what
they parsed, or -1.
"""

from __future__ import annotations

import re

# The keywords of the language, and the words that are keywords only in places.
KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface "
    "long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while _"
).split()
CONTEXTUAL = "record sealed non permits yield var module open".split()
_CODE = {w: chr(0x4E00 + n) for n, w in enumerate(KEYWORDS + CONTEXTUAL)}
_LITERAL_WORDS = {"true", "false", "null"}
#: Operators of several characters, longest first; `>` stays single for type arguments.
_OPERATORS = {"...": "…", "<<=": "=", ">>>=": "=", ">>=": "=", "->": "→", "::": "∷", "++": "±", "--": "±", "&&": "∧", "||": "∧", "==": "≟", "!=": "≟", "<=": "≤", ">=": "≤", "+=": "≔", "-=": "≔", "*=": "≔", "/=": "≔", "&=": "≔", "|=": "≔", "^=": "≔", "%=": "≔", "<<": "≪"}
_OPERATORS |= {"<<=": "≔", ">>=": "≔", ">>>=": "≔"}

_ESCAPE = r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})"
_TOKEN = re.compile(
    r"""[ \t\f\r\n]+|//[^\r\n]*|/\*(?s:.*?)\*/"""
    r"""|(?P<open>/\*)"""
    r"""|(?P<word>[^\W\d][\w$]*|\$[\w$]*)"""
    r'|(?P<string>"""[ \t\f]*\r?\n(?s:(?:[^"\\]|\\(?:[btnfrs"\'\\\r\n]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})|"(?!""))*?)"""'
    r'|"(?!"")(?:[^"\\\r\n]|' + _ESCAPE + r')*"|""(?!")' + r"|'(?:[^'\\\r\n]|" + _ESCAPE + r")')"
    r"|(?P<number>0[xX](?:[0-9a-fA-F][0-9a-fA-F_]*)?(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d[\d_]*)?[lLfFdD]?|0[bB][01][01_]*[lL]?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?)(?![\w$])"
    r"|(?P<op>>>>=|>>=|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/&|^%]=|<<|[-+*/%&|^!~?:;,.=<>(){}\[\]@])"
)
_END = "\0"


def shape(code: str) -> str | None:
    """The code's tokens as characters, None where a piece of it is no token."""
    if "\\u" in code:
        code = re.sub(r"(?<!\\)((?:\\\\)*)\\u+([0-9a-fA-F]{4})", lambda m: m[1] + chr(int(m[2], 16)), code)
    code = code.removeprefix("﻿").removesuffix("\x1a")
    out: list[str] = []
    at = 0
    known = _CODE.get
    for m in _TOKEN.finditer(code):
        kind = m.lastgroup
        if m.start() != at or kind == "open":
            return None
        at = m.end()
        if kind == "word":
            word = m[0]
            out.append(known(word) or ("L" if word in _LITERAL_WORDS else "i" if word.isascii() or word.isidentifier() or "$" in word else "?!"))
        elif kind == "op":
            op = m[0]
            out.append(_OPERATORS.get(op, op))
        elif kind:
            out.append("L" if kind == "number" else "S")
    if at != len(code) or "?!" in out:
        return None
    return "".join(out) + _END


def _chars(words: str) -> frozenset[str]:
    return frozenset(_CODE[w] for w in words.split())


K = _CODE
_NAME = frozenset("i") | _chars(" ".join(CONTEXTUAL))
_PRIMITIVE = _chars("boolean byte char short int long float double")
_MODIFIER = _chars("public protected private static abstract final native synchronized transient volatile strictfp default sealed")
_LITERAL = frozenset("LS")
_BINARY = frozenset("∧|^&≟<>≤≪+-*/%")
_ASSIGN = frozenset("=≔")
_CONTROL = "".join(K[w] for w in "if else while do for try switch case default synchronized class interface enum finally catch".split())
_SIMPLE = re.compile(rf"[^;{{}}{_CONTROL}]*;")
_BODY_HEAD = re.compile(r"[^;{}=]*\{")
_FIELD = re.compile(r"[^;{}]*;")
_PAREN = re.compile(r"\([^;{}]*\)(?=\{)")


class _Cache(dict):
    """Remembered shapes, emptied when full."""

    most = 300_000

    def keep(self, key, value):
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


_statements, _headers, _fields, _parens = _Cache(), _Cache(), _Cache(), _Cache()


# ---- names, types, annotations ------------------------------------------------


def _name(s: str, i: int) -> int:
    if s[i] not in _NAME:
        return -1
    i += 1
    while s[i] == "." and s[i + 1] in _NAME:
        i += 2
    return i


def _annotations(s: str, i: int) -> int:
    while s[i] == "@" and s[i + 1] != K["interface"]:
        i = _name(s, i + 1)
        if i < 0:
            return -1
        if s[i] == "(":
            i += 1
            if s[i] == ")":
                i += 1
                continue
            while True:
                if s[i] in _NAME and s[i + 1] == "=":
                    i += 2
                i = _element(s, i)
                if i < 0:
                    return -1
                if s[i] != ",":
                    break
                i += 1
            if s[i] != ")":
                return -1
            i += 1
    return i


def _element(s: str, i: int) -> int:
    if s[i] == "@":
        return _annotations(s, i)
    if s[i] == "{":
        i += 1
        while s[i] != "}":
            i = _element(s, i)
            if i < 0:
                return -1
            if s[i] == ",":
                i += 1
            elif s[i] != "}":
                return -1
        return i + 1
    return _ternary(s, i)


def _dims(s: str, i: int) -> int:
    while True:
        j = _annotations(s, i) if s[i] == "@" else i
        if j >= 0 and s[j] == "[" and s[j + 1] == "]":
            i = j + 2
        else:
            return i


def _type(s: str, i: int, dims: bool = True) -> int:
    i = _annotations(s, i)
    if i < 0:
        return -1
    if s[i] in _PRIMITIVE:
        i += 1
    else:
        while True:
            if s[i] not in _NAME:
                return -1
            i += 1
            if s[i] == "<":
                i = _type_args(s, i)
                if i < 0:
                    return -1
            if s[i] == "." and (s[i + 1] in _NAME or s[i + 1] == "@"):
                i = _annotations(s, i + 1)
                if i < 0:
                    return -1
                continue
            break
    return _dims(s, i) if dims else i


def _type_args(s: str, i: int) -> int:
    """`<...>`, also empty."""
    i += 1
    if s[i] == ">":
        return i + 1
    while True:
        i = _annotations(s, i)
        if i < 0:
            return -1
        if s[i] == "?":
            i += 1
            if s[i] in (K["extends"], K["super"]):
                i = _type(s, i + 1)
        else:
            i = _type(s, i)
        if i < 0:
            return -1
        if s[i] == ",":
            i += 1
            continue
        return i + 1 if s[i] == ">" else -1


def _type_params(s: str, i: int) -> int:
    i += 1
    while True:
        i = _annotations(s, i)
        if i < 0 or s[i] not in _NAME:
            return -1
        i += 1
        if s[i] == K["extends"]:
            i = _bound(s, i + 1)
            if i < 0:
                return -1
        if s[i] == ",":
            i += 1
            continue
        return i + 1 if s[i] == ">" else -1


def _bound(s: str, i: int) -> int:
    i = _type(s, i)
    while i >= 0 and s[i] == "&":
        i = _type(s, i + 1)
    return i


def _types(s: str, i: int) -> int:
    i = _type(s, i)
    while i >= 0 and s[i] == ",":
        i = _type(s, i + 1)
    return i


def _modifiers(s: str, i: int) -> int:
    while True:
        if s[i] == "@" and s[i + 1] != K["interface"]:
            i = _annotations(s, i)
            if i < 0:
                return -1
        elif s[i] == K["sealed"] and s[i + 1] not in _NAME and s[i + 1] not in _MODIFIER and s[i + 1] not in (K["class"], K["interface"], "@"):
            return i
        elif s[i] in _MODIFIER and not (s[i] == K["default"] and s[i + 1] in ":→"):
            i += 1
        elif s[i] == K["non"] and s[i + 1] == "-" and s[i + 2] == K["sealed"]:
            i += 3
        else:
            return i


# ---- expressions -----------------------------------------------------------------


def _closing(s: str, i: int) -> int:
    """The partner of the bracket at i, -1 where it has none."""
    depth = 0
    for j in range(i, len(s)):
        c = s[j]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return j
        elif c == _END:
            return -1
    return -1


def _expression(s: str, i: int) -> int:
    c = s[i]
    if c in _NAME and s[i + 1] == "→":
        return _lambda_body(s, i + 2)
    if c == "(":
        end = _closing(s, i)
        if end < 0:
            return -1
        if s[end + 1] == "→":
            return _lambda_body(s, end + 2) if _lambda_params(s, i + 1) == end else -1
    i = _ternary(s, i)
    if i >= 0 and s[i] in _ASSIGN:
        return _expression(s, i + 1)
    return i


def _lambda_params(s: str, i: int) -> int:
    if s[i] == ")":
        return i
    if s[i] in _NAME and s[i + 1] in ",)":
        while s[i] in _NAME:
            i += 1
            if s[i] != ",":
                return i
            i += 1
        return -1
    return _params(s, i)


def _lambda_body(s: str, i: int) -> int:
    return _block(s, i) if s[i] == "{" else _expression(s, i)


def _ternary(s: str, i: int) -> int:
    i = _binary(s, i)
    if i >= 0 and s[i] == "?":
        i = _expression(s, i + 1)
        if i < 0 or s[i] != ":":
            return -1
        i += 1
        return _expression(s, i) if _is_lambda(s, i) else _ternary(s, i)
    return i


def _is_lambda(s: str, i: int) -> bool:
    if s[i] in _NAME:
        return s[i + 1] == "→"
    if s[i] == "(":
        end = _closing(s, i)
        return end > 0 and s[end + 1] == "→"
    return False


def _binary(s: str, i: int) -> int:
    i = _unary(s, i)
    while i >= 0:
        c = s[i]
        if c in _BINARY:
            if c == ">":
                while s[i + 1] == ">":
                    i += 1
                i += 1
            else:
                i += 1
            i = _unary(s, i)
        elif c == K["instanceof"]:
            i = _modifiers(s, i + 1)
            i = _type(s, i) if i >= 0 else -1
            if i >= 0 and s[i] in _NAME:
                i += 1
        else:
            return i
    return -1


def _unary(s: str, i: int) -> int:
    c = s[i]
    while c in "+-!~±":
        i += 1
        c = s[i]
    if c == "(":
        end = _closing(s, i)
        if end < 0:
            return -1
        after = s[end + 1]
        primitive = s[i + 1] in _PRIMITIVE
        if after in _NAME or after in _LITERAL or after in "(!~" or after in _PRIMITIVE or after in (K["this"], K["super"], K["new"], K["switch"], K["void"]) or (primitive and after in "+-±"):
            j = _bound(s, i + 1)
            if j == end:
                return _expression(s, end + 1) if _is_lambda(s, end + 1) else _unary(s, end + 1)
    return _postfix(s, _primary(s, i))


def _args(s: str, i: int) -> int:
    """Behind the closing bracket of `(...)` at i."""
    i += 1
    if s[i] == ")":
        return i + 1
    while True:
        i = _expression(s, i)
        if i < 0:
            return -1
        if s[i] == ",":
            i += 1
            continue
        return i + 1 if s[i] == ")" else -1


def _primary(s: str, i: int) -> int:
    c = s[i]
    if c in _LITERAL:
        return i + 1
    if c in _NAME:
        i += 1
        if s[i] == "(":
            return _args(s, i)
        if s[i] == "<" or (s[i] == "." and "<" in s[i : i + 40]):
            # A generic type before `::`.
            j = _type(s, i - 1)
            if j > 0 and s[j] == "∷":
                return j
        if s[i] == "[" and s[i + 1] == "]":
            j = _dims(s, i)
            return j if s[j] == "∷" else j + 2 if s[j] == "." and s[j + 1] == K["class"] else -1
        return i
    if c == "(":
        i = _expression(s, i + 1)
        return i + 1 if i >= 0 and s[i] == ")" else -1
    if c == K["this"]:
        return _args(s, i + 1) if s[i + 1] == "(" else i + 1
    if c == K["super"]:
        if s[i + 1] == "(":
            return _args(s, i + 1)
        return i + 1 if s[i + 1] in ".∷" else -1
    if c == K["new"]:
        return _creation(s, i + 1)
    if c == K["switch"]:
        return _switch(s, i)
    if c in _PRIMITIVE or c == K["void"]:
        j = _dims(s, i + 1)
        if s[j] == "." and s[j + 1] == K["class"]:
            return j + 2
        return j if s[j] == "∷" else -1
    if c == "@":
        return _annotations(s, i)
    return -1


def _postfix(s: str, i: int) -> int:
    while i >= 0:
        c = s[i]
        if c == ".":
            d = s[i + 1]
            if d in _NAME:
                i += 2
                if s[i] == "(":
                    i = _args(s, i)
                elif s[i] == "[" and s[i + 1] == "]":
                    j = _dims(s, i)
                    i = j if s[j] == "∷" else j + 2 if s[j] == "." and s[j + 1] == K["class"] else -1
                elif s[i] == "<":
                    # `a.b.C<D>::new`
                    j = _type_args(s, i)
                    j = _dims(s, j) if j >= 0 else -1
                    if j >= 0 and s[j] == "∷":
                        i = j
            elif d == "<":
                i = _type_args(s, i + 1)
                if i < 0 or not (s[i] in _NAME or s[i] == K["super"]) or s[i + 1] != "(":
                    return -1
                i = _args(s, i + 1)
            elif d == K["new"]:
                i = _creation(s, i + 2)
            elif d in (K["this"], K["class"]):
                i += 2
            elif d == K["super"]:
                i += 2
                if s[i] == "(":
                    i = _args(s, i)
                elif s[i] not in ".∷":
                    return -1
            else:
                return -1
        elif c == "[":
            i = _expression(s, i + 1)
            if i < 0 or s[i] != "]":
                return -1
            i += 1
        elif c == "∷":
            i += 1
            if s[i] == "<":
                i = _type_args(s, i)
            if i < 0 or not (s[i] in _NAME or s[i] == K["new"]):
                return -1
            i += 1
        elif c == "±":
            i += 1
        else:
            return i
    return -1


def _creation(s: str, i: int) -> int:
    i = _annotations(s, i)
    if i >= 0 and s[i] == "<":
        i = _type_args(s, i)
    i = _type(s, i, dims=False) if i >= 0 else -1
    if i < 0:
        return -1
    i = _annotations(s, i)
    if i >= 0 and s[i] == "[":
        if s[i + 1] == "]":
            i = _dims(s, i)
            return _array(s, i) if s[i] == "{" else -1
        while s[i] == "[" and s[i + 1] != "]":
            i = _expression(s, i + 1)
            if i < 0 or s[i] != "]":
                return -1
            i += 1
        return _dims(s, i)
    if i < 0 or s[i] != "(":
        return -1
    i = _args(s, i)
    return _members(s, i) if i >= 0 and s[i] == "{" else i


def _array(s: str, i: int) -> int:
    i += 1
    while s[i] != "}":
        i = _array(s, i) if s[i] == "{" else _expression(s, i)
        if i < 0:
            return -1
        if s[i] == ",":
            i += 1
        elif s[i] != "}":
            return -1
    return i + 1


def _switch(s: str, i: int) -> int:
    i = _condition(s, i + 1)
    if i < 0 or s[i] != "{":
        return -1
    i += 1
    while s[i] != "}":
        if s[i] == K["case"]:
            while True:
                i += 1
                if s[i] == K["default"]:
                    i += 1
                else:
                    j = _type(s, i)
                    # A type pattern is a type and a name.
                    i = j + 1 if j > 0 and s[j] in _NAME and s[j + 1] in ":→,∧" else _ternary(s, i)
                if i < 0:
                    return -1
                if s[i] == "∧":
                    i = _ternary(s, i + 1)
                    if i < 0:
                        return -1
                if s[i] != ",":
                    break
        elif s[i] == K["default"]:
            i += 1
        else:
            return -1
        if s[i] == ":":
            i += 1
            while s[i] not in ("}", K["case"]) and not (s[i] == K["default"] and s[i + 1] in ":→"):
                i = _block_statement(s, i)
                if i < 0:
                    return -1
        elif s[i] == "→":
            i += 1
            if s[i] == "{":
                i = _block(s, i)
            elif s[i] == K["throw"]:
                i = _statement(s, i)
            else:
                i = _expression(s, i)
                i = i + 1 if i >= 0 and s[i] == ";" else -1
            if i < 0:
                return -1
        else:
            return -1
    return i + 1


# ---- statements ----------------------------------------------------------------------


def _condition(s: str, i: int) -> int:
    """Behind `( expression )` at i."""
    if s[i] != "(":
        return -1
    if m := _PAREN.match(s, i):
        text = m[0]
        good = _parens.get(text)
        if good is None:
            part = text + _END
            j = _expression(part, 1)
            good = _parens.keep(text, j == len(text) - 1)
        if good:
            return m.end()
    i = _expression(s, i + 1)
    return i + 1 if i >= 0 and s[i] == ")" else -1


def _block(s: str, i: int) -> int:
    if s[i] != "{":
        return -1
    i += 1
    while s[i] != "}":
        i = _block_statement(s, i)
        if i < 0:
            return -1
    return i + 1


def _block_statement(s: str, i: int) -> int:
    if m := _SIMPLE.match(s, i):
        text = m[0]
        good = _statements.get(text)
        if good is None:
            good = _statements.keep(text, _any_statement(text + _END, 0) == len(text))
        if good:
            return m.end()
    return _any_statement(s, i)


def _declarators(s: str, i: int) -> int:
    """Names with dims and initial values, from a name on."""
    while True:
        if s[i] not in _NAME:
            return -1
        i = _dims(s, i + 1)
        if s[i] == "=":
            i = _array(s, i + 1) if s[i + 1] == "{" else _expression(s, i + 1)
            if i < 0:
                return -1
        if s[i] != ",":
            return i
        i += 1


def _local(s: str, i: int) -> int:
    """Behind a declaration of local variables without its semicolon, -1 where there is none."""
    j = _modifiers(s, i)
    if j < 0:
        return -1
    j = _type(s, j)
    return _declarators(s, j) if j > 0 and s[j] in _NAME else -1


def _begins_type(s: str, i: int) -> bool:
    c = s[i]
    return c in (K["class"], K["interface"], K["enum"]) or (c == "@" and s[i + 1] == K["interface"]) or (c == K["record"] and s[i + 1] in _NAME and s[i + 2] in "(<")


def _any_statement(s: str, i: int) -> int:
    c = s[i]
    if c in _MODIFIER and c != K["synchronized"] or c == "@" or _begins_type(s, i) or (c == K["synchronized"] and s[i + 1] != "("):
        j = _modifiers(s, i)
        if j >= 0 and _begins_type(s, j):
            return _type_declaration(s, j)
        if c not in _NAME:
            i = _local(s, i)
            return i + 1 if i >= 0 and s[i] == ";" else -1
    if (c in _NAME or c in _PRIMITIVE) and s[i + 1] != ":" and s[i + 1] not in "=(±≔":
        j = _local(s, i)
        if j >= 0:
            if s[j] == ";":
                return j + 1
            if c in _PRIMITIVE:
                return -1
    return _statement(s, i)


def _statement(s: str, i: int) -> int:
    c = s[i]
    if c == "{":
        return _block(s, i)
    if c == ";":
        return i + 1
    if c in _NAME and s[i + 1] == ":":
        return _statement(s, i + 2)
    if c == K["if"]:
        i = _condition(s, i + 1)
        i = _statement(s, i) if i >= 0 else -1
        if i >= 0 and s[i] == K["else"]:
            return _statement(s, i + 1)
        return i
    if c == K["while"]:
        i = _condition(s, i + 1)
        return _statement(s, i) if i >= 0 else -1
    if c == K["do"]:
        i = _statement(s, i + 1)
        if i < 0 or s[i] != K["while"]:
            return -1
        i = _condition(s, i + 1)
        return i + 1 if i >= 0 and s[i] == ";" else -1
    if c == K["for"]:
        return _for(s, i + 1)
    if c == K["switch"]:
        j = _switch(s, i)
        if j < 0:
            return -1
        if s[j] != ".":
            return j
    if c == K["return"]:
        if s[i + 1] == ";":
            return i + 2
        i = _expression(s, i + 1)
        return i + 1 if i >= 0 and s[i] == ";" else -1
    if c == K["throw"]:
        i = _expression(s, i + 1)
        return i + 1 if i >= 0 and s[i] == ";" else -1
    if c in (K["break"], K["continue"]):
        i += 1
        if s[i] in _NAME:
            i += 1
        return i + 1 if s[i] == ";" else -1
    if c == K["yield"] and s[i + 1] not in "=.[±≔":
        j = _expression(s, i + 1)
        if j >= 0 and s[j] == ";":
            return j + 1
    if c == K["assert"]:
        i = _expression(s, i + 1)
        if i >= 0 and s[i] == ":":
            i = _expression(s, i + 1)
        return i + 1 if i >= 0 and s[i] == ";" else -1
    if c == K["synchronized"]:
        i = _condition(s, i + 1)
        return _block(s, i) if i >= 0 else -1
    if c == K["try"]:
        return _try(s, i + 1)
    i = _statement_expression(s, i)
    return i + 1 if i >= 0 and s[i] == ";" else -1


def _statement_expression(s: str, i: int) -> int:
    """An expression that may be a statement: an assignment, a step up or down, a call or a creation."""
    begin = i
    j = i
    while s[j] == "±":
        j += 1
    if j > i:
        return _unary(s, i)
    j = _unary(s, i)
    if j < 0:
        return -1
    if s[j] in _ASSIGN:
        return _expression(s, j + 1)
    last = s[j - 1]
    if last == "±":
        return j
    if last == ")":
        # A call, not a bracketed expression or a cast.
        return j if s[begin] != "(" or _postfix_begins(s, begin, j) else -1
    if s[begin] == K["new"] or K["new"] in s[begin:j]:
        return j if last == "}" else -1
    return -1


def _postfix_begins(s: str, begin: int, end: int) -> bool:
    close = _closing(s, begin)
    return 0 < close < end - 1 and s[close + 1] in ".[±"


def _for(s: str, i: int) -> int:
    if s[i] != "(":
        return -1
    i += 1
    j = _modifiers(s, i)
    j = _type(s, j) if j >= 0 else -1
    if j > 0 and s[j] in _NAME and s[_dims(s, j + 1)] == ":":
        i = _expression(s, _dims(s, j + 1) + 1)
        return _statement(s, i + 1) if i >= 0 and s[i] == ")" else -1
    if s[i] != ";":
        j = _local(s, i)
        i = j if j >= 0 else _expressions(s, i)
        if i < 0:
            return -1
    if s[i] != ";":
        return -1
    i += 1
    if s[i] != ";":
        i = _expression(s, i)
        if i < 0 or s[i] != ";":
            return -1
    i += 1
    if s[i] != ")":
        i = _expressions(s, i)
        if i < 0 or s[i] != ")":
            return -1
    return _statement(s, i + 1)


def _expressions(s: str, i: int) -> int:
    i = _statement_expression(s, i)
    while i >= 0 and s[i] == ",":
        i = _statement_expression(s, i + 1)
    return i


def _try(s: str, i: int) -> int:
    resources = s[i] == "("
    if resources:
        i += 1
        while True:
            j = _local(s, i)
            i = j if j >= 0 else _expression(s, i)
            if i < 0:
                return -1
            if s[i] == ";":
                i += 1
                if s[i] != ")":
                    continue
            if s[i] != ")":
                return -1
            i += 1
            break
    i = _block(s, i)
    handled = resources
    while i >= 0 and s[i] == K["catch"]:
        if s[i + 1] != "(":
            return -1
        i = _modifiers(s, i + 2)
        i = _type(s, i) if i >= 0 else -1
        while i >= 0 and s[i] == "|":
            i = _type(s, i + 1)
        if i < 0 or s[i] not in _NAME or s[i + 1] != ")":
            return -1
        i = _block(s, i + 2)
        handled = True
    if i >= 0 and s[i] == K["finally"]:
        i = _block(s, i + 1)
        handled = True
    return i if handled else -1


# ---- declarations ----------------------------------------------------------------------


def _params(s: str, i: int) -> int:
    """At the closing bracket of formal parameters that begin at i."""
    if s[i] == ")":
        return i
    while True:
        i = _modifiers(s, i)
        i = _type(s, i) if i >= 0 else -1
        if i < 0:
            return -1
        if s[i] == "@":
            i = _annotations(s, i)
            if i < 0:
                return -1
        if s[i] == "…":
            i += 1
        if s[i] == K["this"]:
            i += 1
        elif s[i] in _NAME:
            i += 1
            while s[i] == "." and s[i + 1] in _NAME:
                i += 2
            if s[i] == "." and s[i + 1] == K["this"]:
                i += 2
            i = _dims(s, i)
        else:
            return -1
        if s[i] == ",":
            i += 1
            continue
        return i if s[i] == ")" else -1


def _type_declaration(s: str, i: int) -> int:
    """A type from its keyword on, behind its body."""
    kind = s[i]
    i += 2 if kind == "@" else 1
    if s[i] not in _NAME:
        return -1
    i += 1
    if s[i] == "<":
        i = _type_params(s, i)
        if i < 0:
            return -1
    if kind == K["record"]:
        if s[i] != "(":
            return -1
        i = _params(s, i + 1)
        if i < 0:
            return -1
        i += 1
    for word in ("extends", "implements", "permits"):
        if s[i] == K[word]:
            i = _types(s, i + 1)
            if i < 0:
                return -1
    if s[i] != "{":
        return -1
    return _enum_body(s, i) if kind == K["enum"] else _members(s, i)


def _enum_body(s: str, i: int) -> int:
    i += 1
    while s[i] not in ";}":
        i = _annotations(s, i)
        if i < 0 or s[i] not in _NAME:
            return -1
        i += 1
        if s[i] == "(":
            i = _args(s, i)
        if i >= 0 and s[i] == "{":
            i = _members(s, i)
        if i < 0:
            return -1
        if s[i] == ",":
            i += 1
        elif s[i] not in ";}":
            return -1
    return i + 1 if s[i] == "}" else _member_list(s, i + 1)


def _members(s: str, i: int) -> int:
    return _member_list(s, i + 1)


def _member_list(s: str, i: int) -> int:
    while s[i] != "}":
        i = _member(s, i)
        if i < 0:
            return -1
    return i + 1


def _member(s: str, i: int) -> int:
    if m := _FIELD.match(s, i):
        text = m[0]
        good = _fields.get(text)
        if good is None:
            good = _fields.keep(text, _any_member(text + _END, 0, False) == len(text))
        if good:
            return m.end()
    elif m := _BODY_HEAD.match(s, i):
        text = m[0]
        good = _headers.get(text)
        if good is None:
            # A method's header up to its body.
            good = _headers.keep(text, _any_member(text + _END, 0, True) == len(text) - 1)
        if good:
            return _block(s, m.end() - 1)
    return _any_member(s, i, False)


def _any_member(s: str, i: int, header: bool) -> int:
    """A member of a class; with `header`, up to the opening brace of a method's body."""
    if s[i] == ";":
        return -1 if header else i + 1
    if s[i] == "{":
        return i if header else _block(s, i)
    if s[i] == K["static"] and s[i + 1] == "{":
        return i + 1 if header else _block(s, i + 1)
    i = _modifiers(s, i)
    if i < 0:
        return -1
    if _begins_type(s, i):
        return -1 if header else _type_declaration(s, i)
    if s[i] == "<":
        i = _type_params(s, i)
        i = _annotations(s, i) if i >= 0 else -1
        if i < 0:
            return -1
    if s[i] in _NAME and s[i + 1] == "(":
        return _method(s, i + 1, header)
    if s[i] in _NAME and s[i + 1] == "{":
        return i + 1 if header else _block(s, i + 1)  # a record's compact constructor
    if s[i] == K["void"]:
        i += 1
    else:
        i = _type(s, i)
        if i < 0:
            return -1
    if s[i] not in _NAME:
        return -1
    if s[i + 1] == "(":
        return _method(s, i + 1, header)
    if header:
        return -1
    i = _declarators(s, i)
    return i + 1 if i >= 0 and s[i] == ";" else -1


def _method(s: str, i: int, header: bool) -> int:
    i = _params(s, i + 1)
    if i < 0:
        return -1
    i = _dims(s, i + 1)
    if s[i] == K["throws"]:
        i = _types(s, i + 1)
        if i < 0:
            return -1
    if s[i] == K["default"]:
        i = _element(s, i + 1)
        if i < 0:
            return -1
    if s[i] == ";":
        return -1 if header else i + 1
    if s[i] != "{":
        return -1
    return i if header else _block(s, i)


def _module(s: str, i: int) -> int:
    """A module declaration: names, commas and words in a brace."""
    i = _annotations(s, i)
    if i >= 0 and s[i] == K["open"]:
        i += 1
    if i < 0 or s[i] != K["module"]:
        return -1
    i = _name(s, i + 1)
    if i < 0 or s[i] != "{":
        return -1
    m = re.compile(rf"(?:[i{''.join(K[w] for w in CONTEXTUAL)}{K['static']}.,]+;)*\}}").match(s, i + 1)
    return m.end() if m else -1


def _unit(s: str) -> bool:
    i = _annotations(s, 0)
    if i >= 0 and s[i] == K["package"]:
        i = _name(s, i + 1)
        if i < 0 or s[i] != ";":
            return False
        i += 1
    else:
        i = 0
    while s[i] in (K["import"], ";"):
        if s[i] == ";":
            i += 1
            continue
        i += 2 if s[i + 1] == K["static"] else 1
        i = _name(s, i)
        if i < 0:
            return False
        if s[i] == "." and s[i + 1] == "*":
            i += 2
        if s[i] != ";":
            return False
        i += 1
    if s[i] in (K["open"], K["module"]) or (s[i] == "@" and K["module"] in s):
        j = _module(s, i)
        if j >= 0:
            return s[j] == _END
    while s[i] != _END:
        if s[i] == ";":
            i += 1
            continue
        i = _modifiers(s, i)
        if i < 0 or not _begins_type(s, i):
            return False
        i = _type_declaration(s, i)
        if i < 0:
            return False
    return True


def parses(code: str) -> bool:
    """Whether a text is a whole file of Java 17 as far as syntax goes; an empty or comment-only text is."""
    s = shape(code)
    if s is None:
        return False
    try:
        return _unit(s)
    except RecursionError:
        return False
